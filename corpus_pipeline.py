"""A corpus pipeline: toxic documents go, repeated lines go, one of each group of near copies stays, contaminated documents go, and what is left is mixed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
documents. ``run`` writes each stage's result as Parquet in the shared folder and reads it again as the next one's documents, so that a stage
starts from a table that outlives its executors; the folder goes when the driver ends.

Edge cases, in every stage: an empty table gives no rows; other columns, whatever their names, are kept as they are; null and repeated ids are no names, rows are told apart
by id and text, and equal rows have one fate. A null or empty text says nothing: toxicity scores it as such, it has no lines to lose, no near copies and no
contamination, and size 0 in the mix; so it stays. Very long texts are taken whole. Of equal rows near_duplicates keeps one, if they have words; documents are grouped by their texts before line_dedup, too. line_dedup sets ``n_chars``, if it is there, of the texts that it changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontam, linededup, mixing, nearjoin, toxicity
from ledgerloom.llm.common import cut, release, scratch, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network rejects, with a score of 0.5 or more, go; it learns from the labels whose crc32(doc_id) mod 5 is not 0."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    labels = toxicity.first_rows(table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic"), F.xxhash64("doc_id"))
    learnt = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id").select("text", "toxic")  # at most TOXIC + CLEAN rows
    score, verdict = (linededup.free(x, docs.columns) for x in ("_toxicity", "_toxic"))
    scored = toxicity.score(docs, toxicity.fit(learnt), *[F.col(f"`{c}`") for c in docs.columns], score=score, verdict=verdict)
    return scored.where(F.col(verdict) == 0).select(*[f"`{c}`" for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.without_repeated_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near copies stays, by the texts as they came in, then by what is left of them: line deduplication strips what near copies share.

    A document is known again by its id, if one row has it there and here, and if its lines are among those that came in; the others are compared as they are.
    """
    came = table(spark, sf_dir, "documents").where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    lines = F.array_distinct(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.xxhash64(x)))
    once = lambda df, name: df.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n"), F.any_value(lines).alias(name)).where("n = 1").drop("n")
    named = cut(once(docs, "here").join(once(came, "there"), "doc_id").where(F.size(F.array_except("here", "there")) == 0).select("doc_id"))
    kept = stored(nearjoin.kept_ids(came, lambda rows: rows.join(named, "doc_id", "left_semi")), "kept")
    gone = cut(named.join(kept, "doc_id", "left_anti"))
    del named
    release(spark)
    return nearjoin.one_of_each(docs, taken=lambda rows: rows.join(gone, "doc_id", "left_anti"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The network of the first stage is beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), scratch(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
