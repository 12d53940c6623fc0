"""Alignment of two tokenizers over the same texts, and which of their tokens belong together.

Both tokenizers encode a space and the text. Where a single space stands between two characters that are no white space, neither lets a token reach over the
place, so a text is cut into chunks there and each different chunk is encoded once by a worker, which keeps what it found. (That no piece of the second
vocabulary has a space behind another character is checked when it is loaded; if one has, chunks are whole texts.) The ends of the tokens are told
coarsely by the tokenizers: character offsets of the first, and the spans of the second's immutable proto, which its current release hands out as ``offset_mapping``. An end inside a
character of several bytes, or of a byte-fallback token, is refined: the tokens' decoded bytes are counted on from the last end that is settled. Decoded bytes
must equal the text's; a chunk where they do not leaves its text without tokens.

Byte places where tokens of both end cut the tokens into groups; a link is a pair of tokens that share bytes. The number of texts that hold a pair of ids linked is summed
over all texts by Spark, from counts that tasks have summed before. Each text's different pairs are kept in a written table, and are joined to the counts row by row.
The counts are broadcast only behind a check of their size; beyond it the same join is shuffled.

Edge cases: null and empty texts, and texts that one of the tokenizers does not give back byte by byte (U+2581 reads as a space), have no tokens, zeros and an empty
digest; strings of special tokens are plain text; ties in count are all best; repeated rows, repeated and null ids are rows like others, each counted; very long texts are taken whole; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import sentencepiece
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

FIRST, SECOND = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Different chunks that a worker keeps, characters of text that it takes at a time, and rows of counts up to which they are broadcast.
KEPT, SLICE, BROADCAST_ROWS = 500_000, 2_000_000, 2_000_000
#: Chunks that are encoded in a row, and rows of them at a time: what the tokenizers hand out takes hundreds of bytes a token.
BLOCK, BLOCKS = 256, 32
CUT = re.compile(r" (?<=\S )(?=\S)")
ROW = "doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Chunks:
    """What is known of chunks; ``of`` gives their numbers here, and the arrays are read by number."""

    def __init__(self, first: str, second: str) -> None:
        self.a = tokenizers.Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        letters = byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_fallback = np.array([self.b.is_byte(i) for i in range(len(pieces))])
        self.b_bytes = [bytes([int(p[3:5], 16)]) if fallback else p.replace("▁", " ").encode() for p, fallback in zip(pieces, self.b_fallback, strict=True)]
        self.whole = any(re.search("[^▁]▁", p) for p in pieces)
        self.sizes = [np.array([len(x) for x in table]) for table in (self.a_bytes, self.b_bytes)]
        self.names = [np.array([f"{i}{mark}" for i in range(len(table)) for mark in (",", end)], object) for table, end in ((self.a_bytes, "|"), (self.b_bytes, ";"))]
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []  # empty for a chunk that has no tokens
        self.counts = np.zeros((0, 4), np.int64)  # A's tokens, B's tokens, groups, links
        self.begin = np.zeros(1, np.int64)
        self.pairs = np.zeros(0, np.int64)
        self.hits = np.zeros(0, np.int64)

    def forget(self) -> None:
        """Keep the chunks that have come back."""
        keep = np.flatnonzero(self.hits > 1)
        names = list(self.number)
        lengths = np.diff(self.begin)[keep]
        self.pairs = self.pairs[np.repeat(self.begin[keep], lengths) + places(lengths)]
        self.begin = np.append(0, np.cumsum(lengths))
        self.number = {names[i]: k for k, i in enumerate(keep)}
        self.groups = [self.groups[i] for i in keep]
        self.counts, self.hits = self.counts[keep], np.zeros(len(keep), np.int64)

    def cut(self, text: str) -> list[str]:
        """The chunks of a space and the text, each without the space before it."""
        if self.whole:
            return [text]
        single = all(line and " ".join(line.split()) == line for line in text.split("\n"))  # then every space stands alone
        return text.split(" ") if single else CUT.split(text)

    def of(self, chunks: list[str]) -> np.ndarray:
        if len(self.number) > KEPT:
            self.forget()
        new = [c for c in dict.fromkeys(chunks) if c not in self.number]
        plain, odd = [], []
        for c in new:
            (odd if not c or c[0].isspace() or c[-1].isspace() else plain).append(c)
        # plain chunks are encoded in a row, which is cheaper; where that is not given back, each by itself tells which one is to blame
        blocks = [plain[k : k + BLOCK] for k in range(0, len(plain), BLOCK)]
        for k in range(0, len(blocks), BLOCKS):
            odd += self.learn(blocks[k : k + BLOCKS])
        for k in range(0, len(odd), BLOCK):
            self.learn([[c] for c in odd[k : k + BLOCK]])
        found = np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))
        self.hits += np.bincount(found, minlength=len(self.hits))
        return found

    def learn(self, blocks: list[list[str]]) -> list[str]:
        """Take up the chunks of the blocks, but for those of blocks of several that are not given back, which are returned."""
        if not blocks:
            return []
        texts = [" ".join(b) for b in blocks]
        raws = [b" " + t.encode() for t in texts]
        base = np.append(0, np.cumsum([len(r) for r in raws]))
        # offsets are of characters: bytes before each character of the blocks, one after the other
        codes = np.frombuffer("".join(" " + t for t in texts).encode("utf-32-le"), np.uint32)
        bytes_before = np.append(0, np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)))
        chars = np.array([len(t) + 1 for t in texts])
        first_char = np.cumsum(chars) - chars
        sides = []
        said_a = self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)
        said_b = self.b.encode(texts, num_threads=1, return_type="offset_mapping")
        for which, ids, offsets in ((0, [t.ids for t in said_a], [t.offsets for t in said_a]), (1, [t["ids"] for t in said_b], [t["offsets"] for t in said_b])):
            n = np.array([len(x) for x in ids], np.int64)
            flat = np.fromiter(itertools.chain.from_iterable(ids), np.int64, n.sum())
            spans = np.fromiter(itertools.chain.from_iterable(itertools.chain.from_iterable(offsets)), np.int64, 2 * len(flat)).reshape(-1, 2)
            sides.append(self.ends(which, raws, base, n, flat, bytes_before[spans + np.repeat(first_char + which, n)[:, None]]))  # B's leave out the space before the block
        good = sides[0][2] & sides[1][2]
        (a_id, a_end), (b_id, b_end) = ((ids[good[block]], ends[good[block]]) for ids, ends, _, block in sides)
        single = np.array([len(b) == 1 for b in blocks])
        taken = [c for b, ok in zip(blocks, good | single, strict=True) if ok for c in b]
        length = np.array([len(c.encode()) + 1 for b in blocks for c in b])
        ends = np.cumsum(length)[np.repeat(good | single, [len(b) for b in blocks])]
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        every = np.union1d(a_end, b_end)
        links = (a_id[np.searchsorted(a_end, every)] << 32) | b_id[np.searchsorted(b_end, every)]
        upto = [np.searchsorted(x, ends, "right") for x in (a_end, b_end, both, every)]
        # each group's tokens of A, then those of B
        a_group, b_group = (np.searchsorted(both, x) for x in (a_end, b_end))
        said = np.empty(len(a_id) + len(b_id), object)
        said[np.arange(len(a_id)) + np.searchsorted(b_group, a_group)] = self.names[0][a_id * 2 + np.isin(a_end, both, assume_unique=True)]
        said[np.arange(len(b_id)) + np.searchsorted(a_group, b_group, "right")] = self.names[1][b_id * 2 + np.isin(b_end, both, assume_unique=True)]
        said, stops = said.tolist(), (upto[0] + upto[1]).tolist()
        self.groups += ["".join(said[s:e]) for s, e in zip([0, *stops], stops, strict=False)]
        self.number |= {c: len(self.number) + k for k, c in enumerate(taken)}
        self.counts = np.concatenate([self.counts, np.stack([np.diff(x, prepend=0) for x in upto], 1)])
        self.begin = np.concatenate([self.begin, len(self.pairs) + upto[3]])
        self.pairs = np.concatenate([self.pairs, links])
        self.hits = np.append(self.hits, np.zeros(len(taken), np.int64))
        return [c for b, ok in zip(blocks, good | single, strict=True) if not ok for c in b]

    def ends(self, which: int, raws: list[bytes], base: np.ndarray, n: np.ndarray, ids: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, ...]:
        """(ids, byte ends, blocks given back by their tokens, block of each token): coarse ends by the spans, refined by decoded bytes."""
        table, listed, stops = (self.a_bytes, self.b_bytes)[which], ids.tolist(), np.cumsum(n).tolist()
        good = np.array([b"".join([table[i] for i in listed[s:e]]) == raw for s, e, raw in zip([0, *stops], stops, raws, strict=False)], bool)
        block = np.repeat(np.arange(len(raws)), n)
        last = np.append(block[1:] != block[:-1], True)[: len(ids)]
        inside = ~last & (np.append(spans[1:, 0], 0)[: len(ids)] < spans[:, 1])  # the next token begins in the same character
        if which == 1:
            inside |= self.b_fallback[ids] & ~last
        told, decoded = np.where(last, base[block + 1], spans[:, 1]), np.cumsum(self.sizes[which][ids])
        # the last settled end before: bytes decoded since then, or since the block began, lead to the others
        settled = np.maximum.accumulate(np.where(inside, -1, np.arange(len(ids))))
        begin = (np.cumsum(n) - n)[block]
        known = settled >= begin
        start = np.where(known, told[settled], base[block])
        before = np.where(known, decoded[settled], np.append(0, decoded)[begin])
        return ids, np.where(inside, start + decoded - before, told), good, block


def places(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the lengths."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


@functools.lru_cache(maxsize=1)
def chunks_of(first: str, second: str) -> Chunks:
    return Chunks(first, second)


def align(known: Chunks, ids: list, texts: list[str]) -> pd.DataFrame:
    """A row for each text, as ``ROW`` says."""
    own = [known.cut(t) if t else [] for t in texts]
    n = np.array([len(x) for x in own], np.int64)
    found = known.of(list(itertools.chain.from_iterable(own)))
    text = np.repeat(np.arange(len(texts)), n)
    bad = np.bincount(text[known.counts[found, 2] == 0], minlength=len(texts)) > 0
    totals = np.zeros((len(texts), 4), np.int64)
    for k in range(4):
        totals[:, k] = np.bincount(text, known.counts[found, k], len(texts))  # sums below 2**53
    totals[bad] = 0
    stops = np.cumsum(n).tolist()
    digest, groups, numbers = [], known.groups, found.tolist()
    for begin, end, none in zip([0, *stops], stops, (bad | (n == 0)).tolist(), strict=False):
        digest.append("" if none else hashlib.sha256("".join([groups[i] for i in numbers[begin:end]])[:-1].encode()).hexdigest())
    # different chunks of a text, then the different pairs of these
    at, times = np.unique((text * len(known.groups) + found)[~bad[text]], return_counts=True)
    text, found = np.divmod(at, max(len(known.groups), 1))
    lengths = known.begin[found + 1] - known.begin[found]
    different, pair = np.unique(known.pairs[np.repeat(known.begin[found], lengths) + places(lengths)], return_inverse=True)
    key = np.repeat(text, lengths) * len(different) + pair
    bits = int(times.max(initial=0)).bit_length()
    packed = np.sort(key << bits | np.repeat(times, lengths))
    key, times = packed >> bits, packed & ((1 << bits) - 1)
    heads = np.flatnonzero(np.append(True, np.diff(key) != 0)[: len(key)])
    sums = np.add.reduceat(times, heads) if len(heads) else times
    text, pair = np.divmod(key[heads], max(len(different), 1))
    where = np.searchsorted(text, np.arange(1, len(texts)))
    out = pd.DataFrame({"doc_id": ids, "n_a": totals[:, 0], "n_b": totals[:, 1], "n_groups": totals[:, 2], "n_links": totals[:, 3], "groups_sha256": digest})
    out["pairs"] = np.split(different[pair], where)
    out["times"] = np.split(sums.astype(np.int32), where)
    return out


def tokens_of(documents: DataFrame, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """``ROW`` of each row of (doc_id, text): numbers, the digest of the groups, and the different linked pairs of ids (A's in the high half) with how often each is linked."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = chunks_of(first, second)
        for batch in batches:
            ids, texts = batch["doc_id"].to_numpy(), [t if isinstance(t, str) else "" for t in batch["text"]]
            stops = np.cumsum([len(t) for t in texts]) // SLICE
            for _, part in itertools.groupby(range(len(texts)), key=stops.__getitem__):
                own = list(part)
                yield align(known, ids[own], [texts[i] for i in own])

    # ids go as strings: pandas has no long with nulls
    return documents.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(work, ROW).withColumn("doc_id", F.col("doc_id").cast("long"))


def links(documents: DataFrame, first: str = FIRST, second: str = SECOND, most: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of (doc_id, text)."""
    rows = stored(tokens_of(documents, first, second).withColumn("row", F.monotonically_increasing_id()), "tokens", "zstd")
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    counts = stored(each.groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    best = Window.partitionBy(F.shiftright("pair", 32))  # a row for each id of B at most
    counts = counts.select("pair", "n", (F.col("n") == F.max("n").over(best)).alias("best"))
    if counts.count() <= most:
        counts = F.broadcast(counts)
    sums = each.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
