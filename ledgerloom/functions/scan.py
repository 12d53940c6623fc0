"""Running sums and last values by key, for keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def running(rows: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """Adds sums so far, and last values so far that are not null, of each key's rows in ascending order, the own row included.

    A key may hold most rows, so rows are dealt to ranges of key and order, and each range goes by itself. What a key has come to in the ranges before is carried into
    the next: only the first key of a range can have come from another one, so carries are a row a range at most, and are broadcast. The ranges are kept, as drawing them again could give
    others. Nulls in the order come first; equal places are in no order; a null key is a key.
    """
    sums, lasts = sums or {}, lasts or {}
    taken = [f"_scan{k}" for k in range(len(order) + len(sums) + len(lasts))]
    places, parts, values = taken[: len(order)], dict(zip(taken[len(order) :], sums, strict=False)), dict(zip(taken[len(order) + len(sums) :], lasts, strict=True))
    named = {**dict(zip(places, order, strict=True)), **{k: sums[v] for k, v in parts.items()}, **{k: lasts[v] for k, v in values.items()}}
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.withColumns(named).repartitionByRange(ranges, *by, *places).withColumn("_range", F.spark_partition_id()))
    last = lambda k: F.max(F.when(F.col(k).isNotNull(), F.struct(*places, F.col(k).alias("v"))))["v"].alias(k)
    ends = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_rows"), *[F.sum(k).alias(k) for k in parts], *[last(k) for k in values])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    carry = ends.select(*[F.col(b).alias(f"_of{i}") for i, b in enumerate(by)], F.col("_range").alias("_into"), F.count("*").over(before).alias("_ranges"), *[F.sum(k).over(before).alias(f"{k}c") for k in parts], *[F.last(k, True).over(before).alias(f"{k}c") for k in values])
    same = F.col("_range") == F.col("_into")
    for i, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"_of{i}"))
    joined = dealt.join(F.broadcast(carry.where("_ranges > 0")), same, "left")
    inside = Window.partitionBy(*by, "_range").orderBy(*places).rowsBetween(Window.unboundedPreceding, 0)
    total = lambda k: F.when(F.sum(k).over(inside).isNull() & F.col(f"{k}c").isNull(), None).otherwise(F.coalesce(F.sum(k).over(inside), F.lit(0)) + F.coalesce(F.col(f"{k}c"), F.lit(0)))
    out = {v: total(k) for k, v in parts.items()} | {v: F.coalesce(F.last(k, True).over(inside), F.col(f"{k}c")) for k, v in values.items()}
    kept = [c for c in rows.columns if c not in out]
    return joined.withColumns(out).select(*[F.col(f"`{c}`") for c in kept], *out)
