"""Near-duplicate join on word n-grams: a MinHash LSH forest, then exact verification.

Texts with equal sets of shingles form one class, and only one text of a class goes on. Each of ``TREES`` trees is a prefix trie
over keys of ``LONGEST`` MinHash values; the trie is one table, sorted by tree and key, so the texts below a node stand together. All
trees are climbed in step, from whole keys to shorter prefixes: at each depth the texts that share a prefix are compared by sketches of their signatures.
A node that one child fills brings nothing new and is passed over. After each depth the links found so far tell how many are still missing: a link of
similarity s shares a prefix of d values in some tree with chance p = 1 - (1 - s^d)^TREES, so each found one stands for (1 - p) / p that are not.
Climbing ends when the share of found ones reaches ``RECALL``, a link at the asked similarity being reckoned in besides, so that few or no links don't end it early; where
all links are far closer than asked, it ends at long prefixes, and where many are at the asked similarity, at short ones.

Sketches are compared at a similarity far below the asked one, which leaves small candidate components; within
these every pair is compared by its whole shingle sets, which decides on links, components and counts.

No group is held whole: a trie node, or a candidate component, of more than a block's texts is dealt out as pairs of
blocks, each a group of its own that gives a forest of its links and a count for each text, never its pairs. So a node of m different
texts costs m * m / BLOCK rows; copies cost nothing, as they are in one class. Components come from star steps in Spark.

Edge cases: a text of fewer than ``n`` words, but not none, is one shingle; null texts and texts without words are alone
in their class, without links; repeated rows are copies of each other; the texts of an id are taken one by one; a null id is never
the name of a class that has another, and null ids are not one id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, partitions, release, row_key, scratch, written
from .components import components
from .linededup import free

SHINGLE, SIMILARITY = 5, 0.8
TREES, LONGEST, RECALL = 16, 8, 0.9998
#: Bytes of a MinHash value in a key.
VALUE = 4
#: Links at the asked similarity that are reckoned in when the recall is estimated.
PRIOR = 1.0
NODE_BLOCK, PAIR_BLOCK = 8192, 512
#: How far under the asked similarity the sketches' estimate may be: over four times its deviation.
SLACK = 0.16
#: Seconds that Spark gets to let go what a step leaves behind, twice.
WAIT = 0.1
CHARS = 1 << 20
WORD = re.compile(r"\w+")
SIGNED = "row long, doc_id long, named boolean, shingles long, key binary, sketch binary, keys binary"


def meets(similarity: float | np.ndarray, depth: int, trees: int = TREES) -> float | np.ndarray:
    """The chance that two texts of this similarity share a prefix of ``depth`` values in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def missing(similarity: float, depth: int) -> float:
    """Links that are not found for each found one."""
    p = meets(similarity, depth)
    return (1 - p) / p


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[str | None], n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted different shingle hashes of each text."""
    known: dict[str, int] = {}
    flat, ends = [], [0]
    for text in texts:
        for w in WORD.findall((text or "").lower()):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            flat.append(h)
        ends.append(len(flat))
    words = np.array(flat, np.uint64)
    rng = np.random.default_rng(5)
    factors = rng.integers(1 << 62, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    places = max(0, len(words) - n + 1)
    rolled = np.zeros(places, np.uint64)
    for j in range(n):
        rolled += words[j : j + places] * factors[j]
    rolled = mix64(rolled)
    out = []
    for b, e in zip(ends[:-1], ends[1:], strict=True):
        if e - b >= n:
            out.append(np.unique(rolled[b : e - n + 1]))
        elif e > b:
            out.append(mix64(np.array([(words[b:e] * factors[: e - b]).sum() + np.uint64(e - b)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def slices(texts: list[str | None]) -> Iterator[slice]:
    begin, total = 0, 0
    for k, t in enumerate(texts):
        total += len(t or "")
        if total >= CHARS:
            yield slice(begin, k + 1)
            begin, total = k + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def signatures(sets: list[np.ndarray], count: int, seed: int = 11) -> np.ndarray:
    """MinHash values, one row a set; sets must not be empty."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(1 << 62, size=(2, count), dtype=np.uint64)
    flat = np.concatenate(sets)
    begins = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), count), np.uint32)
    for k in range(count):
        out[:, k] = np.minimum.reduceat(((flat * (a[k] * np.uint64(2) + np.uint64(1)) + b[k]) >> np.uint64(32)).astype(np.uint32), begins)
    return out


def sign(documents: DataFrame, n: int = SHINGLE) -> DataFrame:
    """(row, doc_id, shingles, key of the whole set, sketch, keys of all trees one after the other)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.pop("text").tolist()
            for part in slices(texts):
                sets = shingle_sets(texts[part], n)
                full = [k for k, s in enumerate(sets) if len(s)]
                values = signatures([sets[k] for k in full], TREES * LONGEST) if full else np.zeros((0, TREES * LONGEST), np.uint32)
                frame = batch.iloc[part].assign(shingles=[len(s) for s in sets])
                frame["key"] = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                sketch, keys = [None] * len(sets), [None] * len(sets)
                for row, k in enumerate(full):
                    sketch[k], keys[k] = (values[row] & 255).astype(np.uint8).tobytes(), values[row].astype(">u4").tobytes()
                yield frame.assign(sketch=sketch, keys=keys)

    ids = F.col("doc_id").cast("long")
    rows = documents.select(row_key().alias("row"), F.coalesce(ids, F.lit(0)).alias("doc_id"), ids.isNotNull().alias("named"), "text")  # a null would make all ids of a batch floats
    return rows.mapInPandas(work, SIGNED).withColumn("doc_id", F.when(F.col("named"), F.col("doc_id"))).drop("named")


def forest(near: np.ndarray | None, n: int, row_of=None) -> np.ndarray:
    """The root of each of n things, -1 for roots; ``row_of(i, rest)`` tells which of ``rest`` are near i."""
    roots, rest = np.full(n, -1), np.arange(n)
    while len(rest):
        root, stack, rest = rest[0], [rest[0]], rest[1:]
        while stack and len(rest):
            hit = row_of(stack.pop(), rest)
            if hit.any():
                roots[rest[hit]] = root
                stack += rest[hit].tolist()
                rest = rest[~hit]
    return roots


def in_blocks(rows: DataFrame, group: list[str], block: int) -> DataFrame:
    """Rows of (group, size, ...) with ``_i``, ``_j``, ``_own``: once if the group fits in a block, else once for each pair of blocks with theirs."""
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("rep", F.lit(3)), blocks).cast("int")
    rows = rows.withColumn("_blocks", blocks).withColumn("_own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    return rows.withColumn("_other", other).withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other")).drop("_blocks", "_other")


def by_group(rows: DataFrame, group: list[str], work, schema: str) -> DataFrame:
    """Apply ``work`` to the rows of each group, which stand together in sorted partitions; many groups go through one call of pandas."""

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            change = np.zeros(len(batch), bool)
            for c in group:
                values = batch[c].to_numpy()
                change[1:] |= values[1:] != values[:-1]
            cuts = np.flatnonzero(change)
            if not len(cuts):
                rest = batch
                continue
            rest = batch.iloc[cuts[-1] :]
            yield work(batch.iloc[: cuts[-1]], [0, *cuts[:-1]])
        if rest is not None and len(rest):
            yield work(rest, [0])

    return rows.repartition(partitions(rows.sparkSession), *group).sortWithinPartitions(*group, "rep").mapInPandas(stream, schema)


def trie(reps: DataFrame, path: str) -> DataFrame:
    """(tree, key, rep, common) of all trees, sorted by tree and key, written at a path: common is how many values a key shares with a neighbour in that order.

    Texts below a node stand together, so a key that shares nothing with its neighbours shares nothing with any, and is left out. The first and the last row of a
    partition, whose other neighbour is elsewhere, stay.
    """
    size = LONGEST * VALUE

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, before = None, LONGEST  # the last row so far, and what it shares with the row before it
        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(batch):
                continue
            keys, tree = np.frombuffer(b"".join(batch["key"]), ">u4").reshape(-1, LONGEST), batch["tree"].to_numpy()
            with_next = np.cumprod((keys[1:] == keys[:-1]) & (tree[1:] == tree[:-1])[:, None], axis=1).sum(1)
            common = np.maximum(np.concatenate([[before], with_next[:-1]]), with_next) if len(with_next) else with_next
            out = batch.iloc[:-1].assign(common=common.astype(np.int32))
            yield out[out["common"] > 0]
            held, before = batch.iloc[-1:], int(with_next[-1]) if len(with_next) else before
        if held is not None:
            yield held.assign(common=np.int32(LONGEST))

    rows = reps.select("rep", F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.substring(F.col("keys"), t * size + 1, F.lit(size)).alias("key")))).alias("k"))
    ordered = rows.select("k.tree", "k.key", "rep").repartitionByRange(partitions(reps.sparkSession), "tree", "key", "rep").sortWithinPartitions("tree", "key")
    return written(ordered.mapInPandas(compare, "tree int, key binary, rep long, common int"), path)


def links_at(rows: DataFrame, reps: DataFrame, depth: int, similarity: float) -> DataFrame:
    """(u, v, similarity by sketch): a forest of links for every trie node of this depth that has several children, or at whole keys several texts."""
    width, least = TREES * LONGEST, max(0.0, similarity - SLACK)
    enough = int(np.ceil(width * (least + (1 - least) / 256)))
    node = F.xxhash64("tree", F.substring("key", 1, depth * VALUE))  # nodes that share a hash are compared for nothing, no more
    below = rows.where(F.col("common") >= depth).select("rep", node.alias("node"), F.substring("key", 1, (depth + 1) * VALUE).alias("child"))
    several = F.count("*") > 1 if depth == LONGEST else F.min("child") < F.max("child")
    nodes = below.groupBy("node").agg(F.count("*").alias("size"), several.alias("_several")).where("_several").drop("_several")
    placed = below.select("rep", "node").join(nodes, "node").join(reps.select("rep", "sketch"), "rep")
    dealt = in_blocks(placed, ["node"], NODE_BLOCK).select("node", "_i", "_j", "rep", "sketch")

    def work(batch: pd.DataFrame, begins: list[int]) -> pd.DataFrame:
        rep, all_sketches = batch["rep"].to_numpy(), np.frombuffer(b"".join(batch["sketch"]), np.uint8).reshape(-1, width)
        u, v, alike = [], [], []
        for b, e in zip(begins, [*begins[1:], len(batch)], strict=True):
            sketches, own = all_sketches[b:e], rep[b:e]
            roots = forest(None, e - b, lambda i, rest, s=sketches: (s[rest] == s[i]).sum(1) >= enough)
            hit = np.flatnonzero(roots >= 0)
            u.append(own[roots[hit]])
            v.append(own[hit])
            alike.append(((sketches[hit] == sketches[roots[hit]]).mean(1) - 1 / 256) / (1 - 1 / 256))
        return pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v), "similarity": np.concatenate(alike)})

    return by_group(dealt, ["node", "_i", "_j"], work, "u long, v long, similarity double").where("u <> v")


def candidates(reps: DataFrame, similarity: float, folder: str, recall: float = RECALL) -> DataFrame:
    """(u, v): links by sketch of all texts (rep, sketch, keys) that meet in the forest, climbed until the recall is reached; read from a folder of written tables."""
    rows, found = trie(reps, f"{folder}/trie"), None
    for depth in range(LONGEST, 0, -1):
        new = links_at(rows, reps, depth, similarity).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "similarity")
        found = written((new if found is None else found.unionByName(new)).groupBy("u", "v").agg(F.max("similarity").alias("similarity")), f"{folder}/{depth}")
        discard(reps.sparkSession, f"{folder}/{depth + 1}")
        # one link a text, its closest: else a large group of near copies would speak for all
        close = found.where(F.col("similarity") >= similarity).groupBy("v").agg(F.max("similarity").alias("s"))
        p = 1 - F.pow(1 - F.pow(F.least("s", F.lit(1.0)), F.lit(depth)), F.lit(TREES))
        known, gone = close.agg(F.count("*"), F.coalesce(F.sum((1 - p) / p), F.lit(0.0))).first()
        del new, close
        release(reps.sparkSession, WAIT)
        if (known + PRIOR) / (known + gone + PRIOR * (1 + missing(similarity, depth))) >= recall:
            break
    return found.select("u", "v")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every left with every right set, by products of 0/1 matrices of ``columns`` shingles."""
    rows = np.repeat(np.arange(len(left)), [len(s) for s in left])
    names, ids = np.unique(np.concatenate(left), return_inverse=True)
    there = np.concatenate(right)
    at = np.minimum(np.searchsorted(names, there), len(names) - 1)
    match = names[at] == there
    their_rows, their_ids = np.repeat(np.arange(len(right)), [len(s) for s in right])[match], at[match]
    used, their_ids = np.unique(their_ids, return_inverse=True)  # only shingles of both sides count
    spot = np.searchsorted(used, ids)
    mine = (spot < len(used)) & (used[np.minimum(spot, max(len(used) - 1, 0))] == ids) if len(used) else np.zeros(len(ids), bool)
    rows, ids = rows[mine], spot[mine]
    out = np.zeros((len(left), len(right)), np.float32)
    mine_order, their_order = np.argsort(ids, kind="stable"), np.argsort(their_ids, kind="stable")
    rows, ids, their_rows, their_ids = rows[mine_order], ids[mine_order], their_rows[their_order], their_ids[their_order]
    for k in range(0, len(used), columns):
        a, b = (np.zeros((len(x), min(columns, len(used) - k)), np.float32) for x in (left, right))
        lo, hi = np.searchsorted(ids, [k, k + columns])
        a[rows[lo:hi], ids[lo:hi] - k] = 1
        lo, hi = np.searchsorted(their_ids, [k, k + columns])
        b[their_rows[lo:hi], their_ids[lo:hi] - k] = 1
        out += a @ b.T
    return out


def verified(documents: DataFrame, members: DataFrame, similarity: float, n: int) -> DataFrame:
    """(rep, linked, root): for each text and pair of blocks the documents of the texts linked to it, and its root in a forest of links.

    members: (component, size, rep, copies).
    """
    own = [F.first(c).alias(c) for c in ("component", "size", "copies")]  # one for each rep; taken along, so that the sets need no join
    texts = documents.select(row_key().alias("rep"), "text").join(members, "rep").groupBy("rep").agg(F.min("text").alias("text"), *own)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            every = batch.pop("text").tolist()
            for part in slices(every):
                yield batch.iloc[part].assign(shingles=[s.tobytes() for s in shingle_sets(every[part], n)])

    sets = texts.mapInPandas(read, "rep long, component long, size long, copies long, shingles binary")
    rows = in_blocks(sets, ["component"], PAIR_BLOCK).select("component", "_i", "_j", "_own", "rep", "copies", "shingles")

    def work(batch: pd.DataFrame, begins: list[int]) -> pd.DataFrame:
        every, copies, own, first, second = (batch[c].to_numpy() for c in ("rep", "copies", "_own", "_i", "_j"))
        raw, out = batch["shingles"].tolist(), []
        for b, e in zip(begins, [*begins[1:], len(batch)], strict=True):
            own_sets = [np.frombuffer(x, np.uint64) for x in raw[b:e]]
            sizes, cross = np.array([len(s) for s in own_sets]), first[b] != second[b]
            # in a pair of two blocks only links between them are new
            left = np.flatnonzero(own[b:e] == first[b]) if cross else np.arange(e - b)
            right = np.flatnonzero(own[b:e] == second[b]) if cross else left
            if not len(left) or not len(right):
                continue
            both = shared_counts([own_sets[k] for k in left], [own_sets[k] for k in right])
            # |a & b| >= t * |a | b|, in whole numbers as far as t allows
            near = both >= similarity * (sizes[left][:, None] + sizes[right][None, :] - both) - 1e-6
            full = np.zeros((e - b, e - b), bool)
            full[np.ix_(left, right)] = near
            full |= full.T
            np.fill_diagonal(full, False)
            roots = forest(None, e - b, lambda i, rest, f=full: f[i, rest])
            out.append(pd.DataFrame({"rep": every[b:e], "linked": full.astype(np.int64) @ copies[b:e], "root": np.where(roots >= 0, every[b:e][roots], every[b:e])}))
        return pd.concat(out) if out else pd.DataFrame({"rep": np.zeros(0, int), "linked": np.zeros(0, int), "root": np.zeros(0, int)})

    return by_group(rows, ["component", "_i", "_j"], work, "rep long, linked long, root long")


def grouped(documents: DataFrame, similarity: float = SIMILARITY, n: int = SHINGLE, taken: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """(row, doc_id, head, n_links, copies) for every row of (doc_id, text) that is taken.

    head is the (unnamed, doc_id, row) of the component's least row by id, null ids last; null for texts without words. taken picks from rows with a doc_id
    those that are grouped: texts are not moved for it. What a step leaves behind is let go before the next, so that the disks need not hold all of them.
    """
    spark, folder = documents.sparkSession, scratch(documents.sparkSession, "near")
    signed = cut(taken(sign(documents, n)))
    head = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("head")
    classes = signed.where("shingles > 0").groupBy("key").agg(F.min(F.struct("row", "sketch", "keys")).alias("r"), head, F.count("*").alias("copies"))
    reps = written(classes.select("key", F.col("r.row").alias("rep"), "r.sketch", "r.keys", "head", "copies"), f"{folder}/pairs/reps")
    rows, named = cut(signed.select("row", "doc_id", "key")), written(reps.select("key", "rep", "head", "copies"), f"{folder}/named")
    del signed, classes
    release(spark, WAIT)
    links = components(candidates(reps.select("rep", "sketch", "keys"), similarity, f"{folder}/pairs"))
    discard(spark, f"{folder}/pairs")
    sizes = links.groupBy("component").agg(F.count("*").alias("size"))
    members = cut(links.join(sizes, "component").join(named.select(F.col("rep").alias("node"), "copies"), "node").select("component", "size", F.col("node").alias("rep"), "copies"))
    del reps, links, sizes
    release(spark, WAIT)
    found = cut(verified(documents, members, similarity, n))
    del members
    release(spark, WAIT)
    counts = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    joined = components(found.where("rep <> root").select(F.col("rep").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "rep")
    first = joined.join(named.select("rep", "head"), "rep").groupBy("component").agg(F.min("head").alias("first"))
    known = named.join(counts, "rep", "left").join(joined.join(first, "component").select("rep", "first"), "rep", "left")
    known = known.select("key", F.coalesce("first", "head").alias("head"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    return rows.join(known, "key", "left").drop("key")


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY, n: int = SHINGLE) -> DataFrame:
    """(doc_id, class_id, n_links, copies) for every row of (doc_id, text).

    class_id is the least id of the text's component of links, null if it has none; n_links counts the other documents, copies included,
    whose shingle sets are as similar as asked; copies counts the documents of its own shingle set.
    """
    out = grouped(documents, similarity, n)
    return out.select("doc_id", F.coalesce("head.doc_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))


def kept_ids(documents: DataFrame, taken: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY, n: int = SHINGLE) -> DataFrame:
    """(doc_id) of what one_of_each keeps of the taken documents, each of which has an id of its own; no text is moved for it."""
    return grouped(documents, similarity, n, taken).where("head is null or head.row = row").select("doc_id")


def one_of_each(documents: DataFrame, similarity: float = SIMILARITY, n: int = SHINGLE, taken: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """The documents that are taken, with one row kept of each component, that of the least id; all rows without words are kept."""
    key = free("_row", documents.columns)
    found = grouped(documents, similarity, n, taken).where("head is null or head.row = row")
    kept = cut(found.groupBy("row").agg(F.count("*").alias("n"), F.first(F.col("head").isNull()).alias("alone")).withColumnRenamed("row", key))
    del found
    release(documents.sparkSession, WAIT)
    rows = documents.withColumn(key, row_key())
    single = rows.join(kept.where("alone or n = 1"), key, "left_semi")
    several = rows.join(kept.where("not alone and n > 1"), key, "left_semi").dropDuplicates([key])
    return single.unionByName(several).select(*[f"`{c}`" for c in documents.columns])
