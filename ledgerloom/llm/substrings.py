"""Removal of repeated byte strings with a hash-compared suffix sort.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts anywhere else. The window of bytes that
starts at each place of each text is given to the anchor in it: the place of the least hashed ``GRAM``-byte string, the last of equals. Equal
windows have equal anchors at equal offsets, so windows need to be compared only where their anchors' strings are
equal, and an anchor whose string is nowhere else is done with. Anchors whose whole neighbourhoods (the bytes of all
their windows) are equal form a class, and a class of several repeats all its windows; that settles copies in a count.

What is left are the edges of repeats. One neighbourhood of each class is fetched, and the suffixes at its windows are sorted among those of the same anchor string
and offset: a bottom-up merge sort whose comparisons find the common extension of two suffixes by binary search over
prefix polynomial hashes, in steps over all suffixes at once. Neighbours with ``LENGTH`` bytes in common are
compared byte by byte, so a hash collision is not taken for a repeat. Equal neighbourhoods are told by three hashes, the anchor string's and two of the whole, of 192 bits
together. An anchor string with more than ``SORTED`` different
neighbourhoods, which no task should hold, is dealt out by its windows: those whose hashes are nowhere else are done with, and the others are sorted and compared byte by byte in groups of about ``SORTED``, each
together with the first window of their hashes.

Edge cases: null texts count as empty; texts shorter than ``LENGTH`` bytes lose nothing; repeated rows are repeats of
each other; the texts of an id, or of null ids, are taken one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions, row_key

LENGTH, GRAM = 200, 80
SORTED = 4096
SLICE = 1 << 20
_rng = np.random.default_rng(17)
#: Two tables of random byte values and two odd bases: prefix hashes are sums modulo 2**64.
VALUES = _rng.integers(1 << 63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = _rng.integers(1 << 62, size=2, dtype=np.uint64) * np.uint64(8) + np.uint64(5)
LOW = np.uint64(0xFFFFFFFF)


class Hashed:
    """Prefix polynomial hashes of a buffer."""

    powers: dict[int, np.ndarray] = {}
    inverses: dict[int, np.ndarray] = {}

    def __init__(self, raw: np.ndarray, which: int = 0) -> None:
        n = len(raw) + 1
        if len(self.powers.get(which, ())) < n:
            size, base = 1 << n.bit_length(), int(BASES[which])
            for table, factor in ((self.powers, base), (self.inverses, pow(base, -1, 1 << 64))):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                table[which] = np.cumprod(steps)
        self.power, self.inverse = self.powers[which], self.inverses[which]
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(VALUES[which][raw] * self.power[: n - 1], out=self.sums[1:])

    def at(self, begin: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[begin + length] - self.sums[begin]) * self.inverse[begin]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def slices(raws: list[bytes], most: int = SLICE) -> Iterator[slice]:
    begin, total = 0, 0
    for k, r in enumerate(raws):
        total += len(r)
        if total >= most:
            yield slice(begin, k + 1)
            begin, total = k + 1, 0
    if begin < len(raws):
        yield slice(begin, len(raws))


def anchors_of(raws: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, place, gram hash, two neighbourhood hashes) of every anchor; a place packs first window, windows after it, anchor after it."""
    sizes = np.array([len(r) for r in raws], np.int64)
    raw = np.frombuffer(b"".join(raws), np.uint8)
    n = len(raw)
    if n < length:
        return (np.zeros(0, np.int64),) * 5
    hashed, spread = Hashed(raw), length - gram + 1
    places = n - gram + 1
    grams = mix((hashed.sums[gram:] - hashed.sums[:places]) * hashed.inverse[:places])
    least = (grams & ~LOW) | (LOW - np.arange(places, dtype=np.uint64))
    span = 1
    while span * 2 <= spread:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < spread:
        least = np.minimum(least[: len(least) - (spread - span)], least[spread - span :])
    begins = np.cumsum(sizes) - sizes
    left = np.repeat(begins + sizes, sizes)[: len(least)] - np.arange(len(least))
    starts = np.flatnonzero(left >= length)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 5
    anchor = (LOW - (least[starts] & LOW)).astype(np.int64)
    change = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    first, last, at = starts[change], starts[np.append(change[1:], len(starts)) - 1], anchor[change]
    text = np.repeat(np.arange(len(raws)), sizes)[first]
    around, check = (mix(h.at(first, last - first + length) + (last - first).astype(np.uint64)) for h in (hashed, Hashed(raw, 1)))
    place = ((first - begins[text]) << 16) | ((last - first) << 8) | (at - first)
    return text, place, grams[at].view(np.int64), around.view(np.int64), check.view(np.int64)


def anchors(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, place, gram, around, check) for every anchor of (id, text)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, raws = batch["id"].to_numpy(), [(t or "").encode() for t in batch["text"]]
            for part in slices(raws):
                text, place, key, around, check = anchors_of(raws[part], length, gram)
                yield pd.DataFrame({"id": ids[part][text], "place": place, "gram": key, "around": around, "check": check})

    return documents.select("id", "text").mapInPandas(work, "id long, place long, gram long, around long, check long")


def common(hashed: Hashed, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Bytes that the suffixes at a and at b have in common, up to ``most``, by binary search over prefix hashes."""
    found = np.zeros(len(a), np.int64)
    step = 1 << (most.bit_length() - 1)
    sums, power = hashed.sums, hashed.power
    while step:
        longer = found + step
        fits = longer <= most
        longer = np.where(fits, longer, found)
        equal = (sums[a + longer] - sums[a]) * power[b] == (sums[b + longer] - sums[b]) * power[a]
        found = np.where(fits & equal, longer, found)
        step >>= 1
    return found


def sort_suffixes(raw: np.ndarray, hashed: Hashed, starts: np.ndarray, segment: np.ndarray, length: int) -> np.ndarray:
    """An order of the suffixes by their first ``length`` bytes within each segment; segments stand together."""
    n = len(starts)
    order = np.arange(n)
    begins = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
    ends = np.append(begins[1:], n)
    begin, end = np.repeat(begins, ends - begins), np.repeat(ends, ends - begins)
    inside, width = np.arange(n) - begin, 1
    while width < (ends - begins).max(initial=0):
        run = inside // width
        live = np.flatnonzero(begin + (run | 1) * width < end)  # of pairs of runs with a second one
        other = np.minimum(begin[live] + (run[live] ^ 1) * width, end[live])
        lo, hi = other.copy(), np.minimum(other + width, end[live])
        second = run[live] % 2 == 1
        mine = starts[order[live]]
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            middle = (lo[open_] + hi[open_]) // 2
            a, b = mine[open_], starts[order[middle]]
            same = common(hashed, a, b, length)
            byte = np.minimum(same, length - 1)
            # the other one goes first if it is less, or equal and of the first run
            goes = np.where(same >= length, second[open_], raw[b + byte] < raw[a + byte])
            lo[open_] = np.where(goes, middle + 1, lo[open_])
            hi[open_] = np.where(goes, hi[open_], middle)
        to = np.arange(n)
        to[live] = begin[live] + (run[live] // 2) * 2 * width + inside[live] % width + (lo - other)
        merged = np.empty_like(order)
        merged[to] = order
        order, width = merged, width * 2
    return order


def repeated_windows(raw: np.ndarray, starts: np.ndarray, segment: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes share their first ``length`` bytes with another one of their segment."""
    hashed = Hashed(raw)
    order = sort_suffixes(raw, hashed, starts, segment, length)
    a, b = starts[order[:-1]], starts[order[1:]]
    equal = (segment[order[:-1]] == segment[order[1:]]) & (common(hashed, a, b, length) == length)
    at = np.flatnonzero(equal)
    reach = np.arange(length)
    for k in range(0, len(at), 4096):  # collisions: the bytes decide
        part = at[k : k + 4096]
        true = (raw[a[part][:, None] + reach] == raw[b[part][:, None] + reach]).all(1)
        for bad in np.unique(segment[order[part[~true]]]):
            own = np.flatnonzero(segment == bad)
            slot = np.flatnonzero(segment[order] == bad)
            by_bytes = sorted(own, key=lambda i: raw[starts[i] : starts[i] + length].tobytes())
            order[slot] = by_bytes
            equal[slot[:-1]] = [raw[starts[i] : starts[i] + length].tobytes() == raw[starts[j] : starts[j] + length].tobytes() for i, j in zip(by_bytes, by_bytes[1:], strict=False)]
    out = np.zeros(len(starts), bool)
    out[order[:-1]] |= equal
    out[order[1:]] |= equal
    return out


def sort_edges(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, begin, end) of runs of repeated windows, from (gram, id, place, bytes): the suffixes of each gram are sorted together."""

    def work(batch: pd.DataFrame) -> pd.DataFrame:
        place, raws = batch["place"].to_numpy(), batch["bytes"].tolist()
        count, anchor = (place >> 8 & 255) + 1, place & 255
        raw = np.frombuffer(b"".join(raws), np.uint8)
        sizes = np.array([len(r) for r in raws])
        row = np.repeat(np.arange(len(batch)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        starts = (np.cumsum(sizes) - sizes)[row] + nth
        gram = np.unique(batch["gram"].to_numpy(), return_inverse=True)[1]
        segment = gram[row] * 256 + anchor[row] - nth + 128
        by = np.argsort(segment, kind="stable")
        hit = np.zeros(len(row), bool)
        hit[by] = repeated_windows(raw, starts[by], segment[by], length)
        at = np.flatnonzero(hit)
        head = np.append(True, (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]]))[: len(at)]
        tail = np.append(head[1:], True)[: len(at)]
        first = (place >> 16)[row] + nth
        return pd.DataFrame({"id": batch["id"].to_numpy()[row[at[head]]], "begin": first[at[head]], "end": first[at[tail]] + length})

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for batch in batches:
            for k in range(0, len(batch), 2048):
                part = batch.iloc[k : k + 2048]
                part = part if rest is None else pd.concat([rest, part], ignore_index=True)
                grams = part["gram"].to_numpy()
                cuts = np.flatnonzero(grams[1:] != grams[:-1])
                if len(cuts):
                    yield work(part.iloc[: cuts[-1] + 1])
                    rest = part.iloc[cuts[-1] + 1 :]
                else:
                    rest = part
        if rest is not None and len(rest):
            yield work(rest)

    return rows.repartition(partitions(rows.sparkSession), "gram").sortWithinPartitions("gram").mapInPandas(stream, "id long, begin long, end long")


def dealt_edges(rows: DataFrame, length: int = LENGTH, most: int = SORTED) -> DataFrame:
    """The same for grams with very many neighbourhoods: windows whose hashes repeat are sorted in groups of about ``most``, each with the first window of its hashes."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for owner, place, raw in batch[["id", "place", "bytes"]].itertuples(index=False):
                data, count = np.frombuffer(raw, np.uint8), (place >> 8 & 255) + 1
                starts = np.arange(count)
                one, two = (Hashed(data, k).at(starts, length).view(np.int64) for k in (0, 1))
                yield pd.DataFrame({"id": owner, "begin": (place >> 16) + starts, "one": one, "two": two, "bytes": [raw[k : k + length] for k in starts]})

    hashed = rows.select("id", "place", "bytes").mapInPandas(work, "id long, begin long, one long, two long, bytes binary")
    several = cut(hashed.groupBy("one", "two").agg(F.count("*").alias("n"), F.min(F.struct("id", "begin")).alias("first")).where("n > 1"))
    groups = F.ceil(F.col("n") / most).cast("int")
    own = F.array(F.pmod(F.xxhash64("id", "begin"), groups).cast("int"))
    at = F.when((F.col("id") == F.col("first.id")) & (F.col("begin") == F.col("first.begin")), F.sequence(F.lit(0), groups - 1)).otherwise(own)
    dealt = hashed.join(several, ["one", "two"]).select("id", "begin", "bytes", "one", "two", F.explode(at).alias("group"))
    return sort_edges(dealt.select(F.xxhash64("one", "two", "group").alias("gram"), "id", F.shiftleft("begin", 16).alias("place"), "bytes"), length)


def repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = SORTED) -> tuple[DataFrame, DataFrame]:
    """(documents of (id, doc_id, named, text) by id, (id, begin, end) of byte ranges that are repeated), lazily; ranges may overlap."""
    found = anchors(documents, length, gram)
    shared = cut(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))  # apart, so that Spark can split the join's hot keys
    shared, whole = cut(found.join(shared, "gram")), ["gram", "around", "check"]
    classes = shared.groupBy(*whole).agg(F.count("*").alias("n"), F.min(F.struct("id", "place")).alias("r"))
    classes = cut(classes.select(*whole, "n", "r.id", "r.place"))
    first, more = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(255)
    several = shared.join(classes.where("n > 1").select(*whole), whole).select("id", first.alias("begin"), (first + more + length).alias("end"))
    differing = classes.groupBy("gram").agg(F.count("*").alias("classes")).where("classes > 1")
    asked = classes.join(differing, "gram").select("gram", "id", "place", "classes")
    lists = asked.groupBy("id").agg(F.collect_list(F.struct("gram", "place", "classes")).alias("asked"))  # a text's own anchors

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for owner, text, wanted in batch[["id", "text", "asked"]].itertuples(index=False):
                raw = text.encode()
                for w in wanted:
                    begin = w["place"] >> 16
                    rows.append((w["gram"], owner, w["place"], w["classes"], raw[begin : begin + (w["place"] >> 8 & 255) + length]))
            yield pd.DataFrame(rows, columns=["gram", "id", "place", "classes", "bytes"])

    by_id = documents.repartition(partitions(documents.sparkSession), "id")  # twice in the plan with the same columns, one exchange
    edges = by_id.join(lists, "id").select("id", "doc_id", "named", "text", "asked").mapInPandas(fetch, "gram long, id long, place long, classes long, bytes binary")
    ranges = several.unionByName(sort_edges(edges.where(F.col("classes") <= most), length))
    if differing.where(F.col("classes") > most).limit(1).count():
        ranges = ranges.unionByName(dealt_edges(edges.where(F.col("classes") > most), length, most))
    return by_id, ranges


def without_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = SORTED) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row of (doc_id, text); kept is the remaining bytes."""
    ids = F.col("doc_id").cast("long")
    rows = documents.select(row_key().alias("id"), F.coalesce(ids, F.lit(0)).alias("doc_id"), ids.isNotNull().alias("named"), F.coalesce("text", F.lit("")).alias("text"))
    by_id, ranges = repeats(rows, length, gram, most)
    lists = ranges.groupBy("id").agg(F.collect_set(F.struct("begin", "end")).alias("ranges"))  # at most one a byte of the text

    def strike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for owner, named, text, spans in batch[["doc_id", "named", "text", "ranges"]].itertuples(index=False):
                raw = np.frombuffer(text.encode(), np.uint8)
                if spans is None or not len(spans):
                    out.append((owner, named, len(raw), 0, 0, raw.tobytes()))
                    continue
                depth = np.zeros(len(raw) + 1, np.int32)
                np.add.at(depth, [s["begin"] for s in spans], 1)
                np.add.at(depth, [s["end"] for s in spans], -1)
                gone = np.cumsum(depth[:-1]) > 0
                out.append((owner, named, len(raw), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()), raw[~gone].tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "named", "n_bytes", "n_removed", "n_spans", "kept"])

    struck = by_id.join(lists, "id", "left").select("id", "doc_id", "named", "text", "ranges").mapInPandas(strike, "doc_id long, named boolean, n_bytes long, n_removed long, n_spans long, kept binary")
    return struck.select(F.when(F.col("named"), F.col("doc_id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def digests(struck: DataFrame) -> DataFrame:
    return struck.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
