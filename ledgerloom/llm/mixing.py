"""Mixing sources to target weights with a low-discrepancy schedule.

Targets come from water filling: every source gets its weight's share of all words, but at most
``max_repeats`` times its own words. Slot ``i`` of the schedule stands for one block of ``block`` words
and goes to the source in whose interval of the cumulative shares the golden-ratio point ``frac(i * phi)``
lies; the rank of a slot within its source names the block it takes. The documents of a source, in the
order of a hash, make up a stream of words that is cut into equal blocks and starts again at its end.
Because the points are so even, the ranks miss a source's target by a few blocks only; those are taken
off the end of its ranks or added after the last slot, and the last block of each source ends at its target.

All orders are found in two steps (counts per bucket, then inside a bucket), so that no source has to
be sorted in one task, however large it is. The tables that stay whole are one row per source, and one row
per source and bucket.

Edge cases: a null text or one without words has size 0, gets no slot and is returned with taken 0; null is a
source like others, ordered last; rows are told apart by document id and text, equal rows get equal results
(each counts as words of its source); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut as keep

WEIGHTS = (5, 2, 1)
BLOCK = 256
MAX_REPEATS = 3
PHI = "0.618033988749894848"
#: Rows of one bucket, on average; buckets are sorted in one task each.
BUCKET_ROWS = 20_000
#: Cells of the unit interval, by which points find the interval that they lie in.
CELLS = 4096


def size_of(text: Column) -> Column:
    """Number of runs of characters other than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size): one row per source, water filled.

    Sorted by the level at which they are full, the sources up to some place are capped and the others share what
    is left by weight; the level of that place decides. One window over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("_cap", F.col("source_size") * max_repeats)
    by_level = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(by_level), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_level), F.lit(0)))
    levelled = ranked.withColumn("_level", level).withColumn("_open", F.col("_cap") > F.col("_level") * F.col("weight"))
    water = F.max(F.when(F.col("_open"), F.col("_level"))).over(every)  # levels fall from the first open place on
    return levelled.withColumn("_water", water).select(
        "source", "source_size", "weight", F.when(F.col("_water").isNull(), F.col("_cap").cast("double")).otherwise(F.least(F.col("_cap").cast("double"), F.col("weight") * F.col("_water"))).alias("target")
    )


def _ranked(rows: DataFrame, keys: list[str], bucket: Column, order: list[Column], amount: Column, out: str) -> DataFrame:
    """Running sum of ``amount`` before each row within ``keys``, in order of ``bucket`` then ``order``, in two steps."""
    rows = rows.withColumn("_bucket", bucket)
    totals = rows.groupBy(*keys, "_bucket").agg(F.sum(amount).alias("_amount"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bucket", F.coalesce(F.sum("_amount").over(before), F.lit(0)).alias("_offset"))
    joined = rows.alias("r").join(offsets.alias("o"), [F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys] + [F.col("r._bucket") == F.col("o._bucket")])
    inside = Window.partitionBy(*[F.col(f"r.{k}") for k in keys], F.col("r._bucket")).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.select("r.*", (F.col("o._offset") + F.coalesce(F.sum(amount).over(inside), F.lit(0))).cast("long").alias(out)).drop("_bucket")


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, max_repeats: int = MAX_REPEATS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with size and hash, targets, segments); a segment is (slot, source, doc_id, _hash, start, n_words)."""
    spark = documents.sparkSession
    # numbers and a hash for each row; kept, so that the texts are read once
    sized = keep(documents.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "text")).alias("_hash")))
    goals = targets(sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), weights, max_repeats)
    # one row per source; names and sums only
    shares = goals.where("target > 0").withColumn("_take", F.round("target").cast("long"))
    total = Window.partitionBy()
    up_to = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    shares = shares.select(
        "source", "source_size", "_take", F.ceil(F.col("_take") / block).cast("long").alias("_quota"), (F.sum("target").over(up_to) / F.sum("target").over(total)).alias("_to"), F.sum("_take").over(total).alias("_all")
    ).withColumn("_from", F.lag("_to", 1, 0.0).over(Window.orderBy(F.col("source").asc_nulls_last())))
    shares = shares.withColumn("_to", F.when(F.lead("_to").over(Window.orderBy(F.col("source").asc_nulls_last())).isNull(), F.lit(2.0)).otherwise(F.col("_to")))
    documents_there, words = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_slots = -(-int(words) // block)

    point = ((F.col("id").cast("decimal(19,0)") * F.lit(PHI).cast("decimal(18,18)")) % F.lit(1)).cast("double")
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), point.alias("_point"))
    cells = shares.select("source", "_from", "_to", F.explode(F.sequence(F.floor(F.col("_from") * CELLS), F.floor(F.least(F.col("_to"), F.lit(1.0)) * CELLS))).alias("_cell"))
    slots = slots.withColumn("_cell", F.floor(F.col("_point") * CELLS)).join(cells, "_cell").where((F.col("_point") >= F.col("_from")) & (F.col("_point") < F.col("_to")))
    drawn = _ranked(slots.select("slot", "source"), ["source"], F.floor(F.col("slot") / BUCKET_ROWS), [F.col("slot")], F.lit(1).cast("long"), "rank")
    met = drawn.groupBy("source").agg(F.count("*").alias("_met"))
    short = shares.alias("s").join(met.alias("m"), F.col("s.source").eqNullSafe(F.col("m.source")), "left").select("s.source", F.coalesce("m._met", F.lit(0)).alias("_met"), "s._quota").where("_met < _quota")
    added = short.select(F.lit(None).cast("long").alias("slot"), "source", F.explode(F.sequence(F.col("_met"), F.col("_quota") - 1)).alias("rank"))
    ranks = drawn.select("slot", "source", "rank").unionByName(added)

    buckets = max(1, int(documents_there) // BUCKET_ROWS)
    spread = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)
    placed = _ranked(sized.where("size > 0"), ["source"], F.floor(spread), [F.col("_hash"), F.col("doc_id")], F.col("size"), "_at")
    placed = placed.join(shares.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # A document stands in the endless stream once for each pass that the target reaches.
    passes = placed.select("doc_id", "source", "_hash", "size", "_take", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_take") - 1) / F.col("source_size")))).alias("_pass"), "_at", "source_size")
    passes = passes.withColumn("_begin", F.col("_at") + F.col("_pass") * F.col("source_size")).withColumn("_end", F.least(F.col("_begin") + F.col("size"), F.col("_take"))).where("_begin < _end")
    cut = passes.select("doc_id", "source", "_hash", "_begin", "_end", F.explode(F.sequence(F.floor(F.col("_begin") / block), F.floor((F.col("_end") - 1) / block))).alias("rank"))
    segments = cut.alias("c").join(ranks.alias("k"), F.col("c.source").eqNullSafe(F.col("k.source")) & (F.col("c.rank") == F.col("k.rank")))
    first, last = F.greatest(F.col("c._begin"), F.col("c.rank") * block), F.least(F.col("c._end"), (F.col("c.rank") + 1) * block)
    return sized, goals, segments.select("k.slot", "c.source", "c.rank", "c.doc_id", "c._hash", (first - F.col("c._begin")).alias("start"), (last - first).alias("n_words"))


def mixed_documents(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row."""
    sized, goals, segments = mix(documents, weights, block, max_repeats)
    copies = sized.groupBy("doc_id", "_hash", "source").agg(F.count("*").alias("_copies"))
    taken = segments.groupBy("doc_id", "_hash", "source").agg(F.sum("n_words").alias("_words"))
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}._hash") == F.col(f"{b}._hash")) & F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    each = copies.alias("c").join(taken.alias("t"), same("c", "t"), "left").select("c.doc_id", "c._hash", "c.source", F.coalesce("t._words", F.lit(0)).alias("_words"), "c._copies")
    out = sized.alias("d").join(each.alias("e"), same("d", "e")).join(goals.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
    return out.select("d.doc_id", "d.size", "g.source_size", "g.target", F.floor(F.col("e._words") / F.col("e._copies")).cast("long").alias("taken"))
