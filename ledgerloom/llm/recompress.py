"""Removal of word sequences that an earlier document holds too, found by recompression.

A text's words are compressed in rounds: runs of equal symbols become one symbol (in the rounds ``RUNS``), then, as each symbol's name puts it on the left or on the right, every pair of a left and a
right symbol becomes one. A name is a hash of what it stands for, so it is the same in every text and task, and equal strings get equal symbols but for some at
their ends. How far to each side a symbol depends on its surroundings is carried along with it: inside a window of ``LENGTH`` words those symbols are
certain whose dependence lies within the window, whatever stands around it. Of the certain ones the window takes one of the highest round, the longest of these, the first
of equals, as its anchor; words are symbols of round 0, so every window has one. Equal windows have equal anchors at equal offsets.

Spark rounds then settle the anchors over all texts. Names that only one document has reveal no repeat and are done with. The neighbourhood of an anchor is all words of the windows
that took it. Where the same neighbourhood stands in a smaller document, all its windows go; that settles copies. What is left are neighbourhoods of
the smallest document of their kind, whose name other kinds share: their windows are compared one by one with those of the smaller documents. Names only reveal: repeats are verified by
two hashes of the words themselves, 128 bits together with another base for each half, of whole neighbourhoods or of windows. No pairs are made, and a hot name or window is counted before it is shuffled.

Edge cases: null texts have no words; texts shorter than ``LENGTH`` words lose nothing; documents of one id are not earlier than each other, so repeated rows have one fate; a null id is smaller than all others; bytes that are no white
space are parts of words, whatever they are; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, stored
from .substrings import Hashed, mix, slices

#: After six rounds symbols are of eight words on average, and windows hold several certain ones; more rounds leave some windows without any.
LENGTH, ROUNDS = 50, 6
#: Rounds that begin with runs: a run looks at both its neighbours, which costs certainty, and after words hardly any come up.
RUNS = (0,)
#: Stands for a missing id.
NO_ID = -(1 << 63)
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
ODD = np.random.default_rng(23).integers(1 << 62, size=4 + ROUNDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words:
    """The words of some texts, one after the other: two hashes of each, their texts, and prefix hashes of sequences."""

    def __init__(self, raws: list[bytes]) -> None:
        sizes = np.array([len(r) + 1 for r in raws], np.int64)
        raw = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
        space = SPACES[raw]
        begin = np.flatnonzero(~space & np.append(True, space[:-1]))
        end = np.flatnonzero(space & np.append(False, ~space[:-1]))
        self.one, self.two = (mix(Hashed(raw, k).at(begin, end - begin) + (end - begin).astype(np.uint64)) for k in (0, 1))
        bounds = np.searchsorted(begin, np.append(0, np.cumsum(sizes)))
        self.first, self.last = bounds[:-1], bounds[1:]
        self.text = np.repeat(np.arange(len(raws)), self.last - self.first)

    def starts(self, length: int) -> np.ndarray:
        """Words at which a window starts."""
        return np.flatnonzero(np.arange(len(self.text)) + length <= self.last[self.text])

    def sequences(self, begin: np.ndarray, size: np.ndarray | int) -> list[np.ndarray]:
        """Two hashes of each sequence of words."""
        out = []
        for which, values in enumerate((self.one, self.two)):
            hashed = Hashed(np.zeros(len(values), np.uint8), which)  # for the powers
            np.cumsum(values * hashed.power[: len(values)], out=hashed.sums[1:])
            out.append(mix(hashed.at(begin, size) + np.asarray(size).astype(np.uint64)).view(np.int64))
        return out


class Symbols:
    """A text's symbols of some round: name, first word, text, and the words [lo, hi) that make it certain; beyond its text where it hangs on the text's end."""

    def __init__(self, words: Words) -> None:
        at = np.arange(len(words.text))
        self.words, self.name, self.start, self.text, self.lo, self.hi = words, words.one, at, words.text, at, at + 1

    def sizes(self) -> np.ndarray:
        return np.diff(np.append(self.start, len(self.words.text)))

    def around(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(does a symbol of the same text follow, lo of the symbol before, hi of the one after)."""
        follows = np.append(self.text[1:] == self.text[:-1], False)[: len(self.text)]
        before = np.where(np.append(False, follows[:-1])[: len(self.text)], np.append(0, self.lo[:-1])[: len(self.text)], self.words.first[self.text] - 1)
        after = np.where(follows, np.append(self.hi[1:], 0)[: len(self.text)], self.words.last[self.text] + 1)
        return follows, before, after

    def become(self, keep: np.ndarray, name: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Symbols:
        out = object.__new__(Symbols)
        out.words, out.start, out.text, out.name, out.lo, out.hi = self.words, self.start[keep], self.text[keep], name, lo, hi
        return out

    def runs(self) -> Symbols:
        follows, before, after = self.around()
        same = np.append(self.name[1:] == self.name[:-1], False)[: len(self.name)] & follows
        head = np.flatnonzero(~np.append(False, same[:-1])[: len(same)])
        count = np.diff(np.append(head, len(self.name)))
        name = np.where(count > 1, mix(self.name[head] * ODD[0] + count.astype(np.uint64)), self.name[head])
        return self.become(head, name, before[head], after[head + count - 1])

    def pairs(self, nth: int) -> Symbols:
        follows, before, after = self.around()
        left = mix(self.name + ODD[4 + nth]) >> np.uint64(63) == 1
        merged = left & np.append(~left[1:], False)[: len(left)] & follows
        keep = np.flatnonzero(~np.append(False, merged[:-1])[: len(merged)])
        merged, left, right = merged[keep], left[keep], np.minimum(keep + 1, len(self.name) - 1)
        name = np.where(merged, mix(self.name[keep] * ODD[1] + mix(self.name[right] + ODD[2]) * ODD[3]), self.name[keep])
        return self.become(keep, name, np.where(left, self.lo[keep], before[keep]), np.where(left, after[keep], self.hi[keep]))


def least_of(key: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where the least key of each range [begin, end) is, the first of equals; no range is empty."""
    depth = np.zeros(len(key) + 1, np.int64)
    np.add.at(depth, begin, 1)
    np.add.at(depth, end, -1)
    used = np.flatnonzero(np.cumsum(depth[:-1]) > 0)
    begin, end = np.searchsorted(used, begin), np.searchsorted(used, end)
    level, size, best, out = np.arange(len(used)), 1, key[used], np.zeros(len(begin), np.int64)
    span = end - begin
    while len(span):
        mine = np.flatnonzero((span >= size) & (span < 2 * size))
        a, b = level[begin[mine]], level[end[mine] - size]
        out[mine] = np.where(best[b] < best[a], b, a)
        if span.max() < 2 * size:
            break
        a, b = level[:-size], level[size:]
        level, size = np.where(best[b] < best[a], b, a), size * 2
    return used[out]


def anchored(words: Words, length: int) -> tuple[np.ndarray, ...]:
    """(first window, windows, name) of every run of windows of a text that take one anchor; windows are named by the word they start at."""
    rounds = [Symbols(words)]
    for nth in range(ROUNDS):
        last = rounds[-1]
        rounds.append((last.runs() if nth in RUNS else last).pairs(nth))
    starts = words.starts(length)
    place, name = np.full(len(starts), -1, np.int64), np.zeros(len(starts), np.uint64)
    for nth, symbols in reversed(list(enumerate(rounds))):
        open_ = np.flatnonzero(place < 0)
        if not len(open_):
            break
        begin, end = np.searchsorted(symbols.lo, starts[open_]), np.searchsorted(symbols.hi, starts[open_] + length, "right")
        some = end > begin
        at, begin, end = open_[some], begin[some], end[some]
        key = (np.uint64(255) - np.minimum(symbols.sizes(), 255).astype(np.uint64)) << np.uint64(56) | symbols.name >> np.uint64(8)
        chosen = least_of(key, begin, end)
        place[at], name[at] = chosen * (ROUNDS + 1) + nth, symbols.name[chosen]
    head = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1))[: len(starts)])
    return starts[head], np.diff(np.append(head, len(starts))), name[head].view(np.int64)


def doc_key() -> list[Column]:
    """doc and t: the id, and a hash of the text, which tells the rows of one id."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("t")]


def anchors(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """(name, doc, t, first, more, one, two) for every run of windows that take one anchor, from (doc, t, text); one and two tell their words."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            docs, keys, raws = batch["doc"].to_numpy(), batch["t"].to_numpy(), [(x or "").encode() for x in batch["text"]]
            for part in slices(raws):
                words = Words(raws[part])
                first, count, name = anchored(words, length)
                one, two = words.sequences(first, count - 1 + length)
                text = words.text[first]
                yield pd.DataFrame({"name": name, "doc": docs[part][text], "t": keys[part][text], "first": first - words.first[text], "more": count - 1, "one": one, "two": two})

    return documents.select("doc", "t", "text").mapInPandas(work, "name long, doc long, t long, first int, more int, one long, two long")


def packed(documents: DataFrame) -> DataFrame:
    """(doc, t, packed): texts as compressed bytes, which are shuffled by id twice."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pd.DataFrame({"doc": batch["doc"], "t": batch["t"], "packed": [pack.compress(x.encode()) for x in batch["text"]]})

    return documents.select("doc", "t", "text").mapInPandas(work, "doc long, t long, packed binary").repartition(partitions(documents.sparkSession), "doc", "t")


def unpacked(column: pd.Series) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(x) for x in column]


def settled(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, t, first, more, late) of the runs of windows under names that several documents have: late if a smaller document holds the same words; the others are open, if their name has words of a smaller document at all."""
    found = anchors(documents, length)
    shared = cut(found.groupBy("name").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("name"))  # apart, so that Spark can split the join's hot keys
    shared, kind = stored(found.join(shared, "name"), "runs", "zstd"), ["name", "one", "two"]
    kinds = stored(shared.groupBy(*kind).agg(F.min("doc").alias("least")), "kinds", "zstd")
    told = shared.join(kinds, kind).select("name", "doc", "t", "first", "more", (F.col("doc") > F.col("least")).alias("late"))
    least = cut(kinds.groupBy("name").agg(F.min("least").alias("least"), F.max("least").alias("_most")).where("least < _most").drop("_most"))
    told = stored(told, "told", "zstd")
    open_ = told.where("not late").join(least, "name").drop("least")
    return stored(told.where("late").unionByName(open_).drop("name"), "settled", "zstd")


def repeats(documents: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(documents of (doc, t, packed), dealt by these; (doc, t, first, end) of the ranges of words that an earlier document holds), lazily; ranges may overlap."""
    runs = settled(documents, length)
    asked = runs.where("not late").groupBy("doc", "t").agg(F.collect_set(F.struct("first", "more")).alias("asked"))  # of one text

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            docs, keys, raws = batch["doc"].to_numpy(), batch["t"].to_numpy(), unpacked(batch["packed"])
            for part in slices(raws):
                words, own = Words(raws[part]), batch["asked"].iloc[part].tolist()
                text = np.repeat(np.arange(len(own)), [len(x) for x in own])
                count = np.array([a["more"] + 1 for x in own for a in x], np.int64)
                first = np.array([a["first"] for x in own for a in x], np.int64)
                begin = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                text = np.repeat(text, count)
                one, two = words.sequences(begin + words.first[text], length)
                yield pd.DataFrame({"doc": docs[part][text], "t": keys[part][text], "first": begin, "one": one, "two": two})

    by_key = packed(documents)
    windows = by_key.join(asked, ["doc", "t"]).select("doc", "t", "packed", "asked").mapInPandas(fetch, "doc long, t long, first int, one long, two long")
    windows = stored(windows, "windows", "zstd")
    earliest = cut(windows.groupBy("one", "two").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most"))
    single = windows.join(earliest, ["one", "two"]).where("doc > least").select("doc", "t", "first", (F.col("first") + length).alias("end"))
    late = runs.where("late").select("doc", "t", "first", (F.col("first") + F.col("more") + length).alias("end"))
    return by_key, late.unionByName(single)


def without_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of (doc_id, text); kept is the remaining words, joined by single spaces."""
    rows = documents.select(*doc_key(), F.coalesce("text", F.lit("")).alias("text"))
    by_key, ranges = repeats(rows, length)
    lists = ranges.groupBy("doc", "t").agg(F.collect_set(F.struct("first", "end")).alias("ranges"))  # of one text

    def strike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, raw, spans in zip(batch["doc"], unpacked(batch["packed"]), batch["ranges"], strict=True):
                words = raw.split()  # at white space of ASCII
                if spans is None or not len(spans):
                    out.append((doc, len(words), 0, b" ".join(words)))
                    continue
                depth = np.zeros(len(words) + 1, np.int32)
                np.add.at(depth, [s["first"] for s in spans], 1)
                np.add.at(depth, [s["end"] for s in spans], -1)
                kept = np.flatnonzero(np.cumsum(depth[:-1]) == 0)
                out.append((doc, len(words), len(words) - len(kept), b" ".join([words[k] for k in kept.tolist()])))
            yield pd.DataFrame(out, columns=["doc", "n_words", "n_removed", "kept"])

    struck = by_key.join(lists, ["doc", "t"], "left").select("doc", "packed", "ranges").mapInPandas(strike, "doc long, n_words long, n_removed long, kept binary")
    return struck.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept")


def digests(struck: DataFrame) -> DataFrame:
    return struck.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
