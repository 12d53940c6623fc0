"""Frames of the library's shapes over the driver's tables, and the same as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-03 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of whole texts for work by the text. One of fewer files than there are cores is dealt out, as a file of one row group is one task."""
    rows = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def pick(number, *values):
    """One of the values by the remainder of a number."""
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notices: equal texts share an identity, and the other fields follow from the id."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(
        n.alias("id"), "source", F.concat(F.lit("k"), n.cast("string")).alias("source_key"), F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"), pick(n, "grant", "tender", "call").alias("kind"),
        pick(n, "closed", "open", "open", "unknown").alias("application_status"), pick(n, "partial", "verified", "verified", "verified", "verified").alias("detail_status"), (n % 13 == 0).alias("deadline_conflict"),
        pick(n, "unknown", "outside", "confirmed", "confirmed", "confirmed", "confirmed").alias("geography"), F.when(n % 9 != 0, F.date_add(F.lit("2023-12-24").cast("date"), (n * 7 % 31).cast("int"))).alias("deadline"),
        F.timestamp_seconds(F.lit(1704067200) + (n % 4000) * 60).alias("fetched_at"), F.when(F.length("text") % 5 != 0, F.md5("text")).alias("identity_key"), F.md5(F.concat_ws("|", "source", "text")).alias("content_hash"), "lang",
    )


NOTICES = """notices AS (
  SELECT doc_id AS id, source, 'k' || doc_id AS source_key, substring(split_part(text, chr(10), 1), 1, 80) AS title, (['grant', 'tender', 'call'])[doc_id % 3 + 1] AS kind,
         (['closed', 'open', 'open', 'unknown'])[doc_id % 4 + 1] AS application_status, CASE WHEN doc_id % 5 = 0 THEN 'partial' ELSE 'verified' END AS detail_status, doc_id % 13 = 0 AS deadline_conflict,
         (['unknown', 'outside', 'confirmed', 'confirmed', 'confirmed', 'confirmed'])[doc_id % 6 + 1] AS geography, CASE WHEN doc_id % 9 <> 0 THEN DATE '2023-12-24' + CAST(doc_id * 7 % 31 AS INTEGER) END AS deadline,
         TIMESTAMP '2024-01-01' + to_minutes(doc_id % 4000) AS fetched_at, CASE WHEN length(text) % 5 <> 0 THEN md5(text) END AS identity_key, md5(source || '|' || text) AS content_hash, lang
  FROM documents
), keyed AS (
  SELECT *, coalesce(identity_key, 'id:' || id) AS group_key, fetched_at > TIMESTAMP '2024-01-02' AS fresh FROM notices
)"""


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stages of one proposal a user."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type").isin("view", "click"), "done").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "running").otherwise("queued")
    return e.select(F.col("user_id").alias("proposal_id"), F.col("event_id").alias("seq"), status.alias("status"), F.col("ts").alias("heartbeat"), (F.col("user_id") % 17).alias("order_id"))


STAGES = """stages AS (
  SELECT user_id AS proposal_id, event_id AS seq, CASE WHEN event_type IN ('view', 'click') THEN 'done' WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'running' ELSE 'queued' END AS status,
         ts AS heartbeat, user_id % 17 AS order_id FROM events
)"""
