"""Connected components by alternating star steps, for edges that no task and no driver has to hold.

Each round is one job over a written table, which goes when the next one is there; what tells the end is observed while it is written. The driver keeps a
record of every task it has run, so a round must not take more of them than it needs; what else a round leaves there goes before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, release, scratch, written

#: Seconds that Spark gets to let go what a round leaves behind, twice.
WAIT = 0.1


def _each(rows: DataFrame, *pairs: tuple[str, str], names: tuple[str, str] = ("u", "v")) -> DataFrame:
    """A row for each pair of columns, in one pass over the rows."""
    return rows.select(F.explode(F.array(*[F.struct(*[F.col(c).alias(n) for c, n in zip(p, names, strict=True)]) for p in pairs])).alias("_e")).select("_e.*")


def _to_least(neighbours: DataFrame) -> DataFrame:
    """(u, v) with the least of u and its neighbours as m; the least is found with map-side combining."""
    least = neighbours.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return neighbours.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of its component, for each node of (u, v) with u <> v. Null ends are ignored."""
    spark, last, step = edges.sparkSession, None, 0
    folder = scratch(spark, "components")
    edges = written(edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).where("u <> v").distinct(), f"{folder}/0")
    while True:
        large = _to_least(_each(edges, ("u", "v"), ("v", "u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = _each(_to_least(large), ("u", "m"), ("v", "m")).where("u <> v").distinct()
        seen = Observation()
        edges = written(new.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), f"{folder}/{step + 1}")
        discard(spark, f"{folder}/{step}")
        now, step = seen.get, step + 1
        del large, new, seen
        release(spark, WAIT)
        if now == last:
            break
        last = now
    return _each(edges, ("u", "v"), ("v", "v"), names=("node", "component")).distinct()
