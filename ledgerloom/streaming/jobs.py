"""Structured Streaming jobs over event logs. Late data is taken until the watermark and then dropped, but for jobs that commute.

Each function takes a DataFrame, streaming or not; on a batch, watermarks have no effect and the result is that of all events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.catalogue import upsert_latest
from ..schemas import STREAM_EVENT

DELAY = "10 minutes"


def read_events(spark: SparkSession, path: str, schema: str = STREAM_EVENT) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def fixed_windows(events: DataFrame, key: str, most: int, size: str = "1 hour", delay: str = DELAY) -> DataFrame:
    """Hits of a key in windows from the epoch on, and whether they are allowed."""
    g = events.withWatermark("ts", delay).groupBy(F.window("ts", size), key).agg(F.count("*").alias("hits"))
    return g.select(key, F.col("window.start").alias("window_start"), "hits", (F.col("hits") <= most).alias("allowed"))


def sliding_rates(events: DataFrame, hit: str, size: str = "1 hour", step: str = "15 minutes", delay: str = DELAY) -> DataFrame:
    """Share of events of type ``hit`` in sliding windows."""
    g = events.withWatermark("ts", delay).groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n"), F.count(F.when(F.col("event_type") == hit, 1)).alias("hits"))
    return g.select(F.col("window.start").alias("window_start"), "n", "hits", (F.col("hits") / F.col("n")).alias("rate"))


def first_sight(events: DataFrame, keys: list[str], delay: str = DELAY) -> DataFrame:
    """Events without repeats of the same keys within the watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", delay: str = DELAY) -> DataFrame:
    """Visits: events of a key with no longer pause than ``gap``."""
    g = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("events"), F.max("ts").alias("last_ts"))
    return g.select(key, F.col("session_window.start").alias("started"), "last_ts", "events")


def silences(events: DataFrame, key: str, patience: str = "3 minutes", delay: str = DELAY) -> DataFrame:
    """(key, last_ts, stale_at): spans that ended because nothing came for ``patience``."""
    g = events.withWatermark("ts", delay).groupBy(F.session_window("ts", patience), key).agg(F.max("ts").alias("last_ts"), F.count("*").alias("beats"))
    return g.select(key, "last_ts", F.col("session_window.end").alias("stale_at"), "beats")


ANCHORED = "user_id long, action string, ts timestamp, hits long, allowed boolean"


def anchored_windows(events: DataFrame, most: int, size: str = "1 hour", delay: str = DELAY) -> DataFrame:
    """(user_id, action, ts, hits, allowed): windows that begin with the first hit of a user and action and are reset after ``size``.

    State is the window's begin and its hits; it times out with the watermark. Events of one batch are taken in order of time.
    """
    span = pd.Timedelta(size)

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        begin, hits = (pd.Timestamp(state.get[0]), state.get[1]) if state.exists else (None, 0)
        rows, out = pd.concat(list(batches)).sort_values("ts"), []
        for at in rows["ts"]:
            if begin is None or at >= begin + span:
                begin, hits = at, 0
            hits += 1
            out.append((*key, at, hits, hits <= most))
        state.update((begin.to_pydatetime(), hits))
        state.setTimeoutTimestamp(int((begin + span).timestamp() * 1000) + 1 if state.getCurrentWatermarkMs() < int((begin + span).timestamp() * 1000) else state.getCurrentWatermarkMs() + 1)
        yield pd.DataFrame(out, columns=["user_id", "action", "ts", "hits", "allowed"])

    keyed = events.select("user_id", F.col("event_type").alias("action"), "ts")
    if events.isStreaming:
        return keyed.withWatermark("ts", delay).groupBy("user_id", "action").applyInPandasWithState(follow, ANCHORED, "begin timestamp, hits long", "append", GroupStateTimeout.EventTimeTimeout)

    def passing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, begin, hits = None, None, 0  # all that is carried from batch to batch
        for batch in batches:
            out = []
            for user, action, at in batch[["user_id", "action", "ts"]].itertuples(index=False):
                if key != (user, action):
                    key, begin = (user, action), None
                if begin is None or at >= begin + span:
                    begin, hits = at, 0
                hits += 1
                out.append((hits, hits <= most))
            yield batch.assign(hits=[h for h, _ in out], allowed=[a for _, a in out])

    ordered = keyed.where(F.col("user_id").isNotNull() & F.col("action").isNotNull() & F.col("ts").isNotNull()).repartition("user_id", "action").sortWithinPartitions("user_id", "action", "ts")
    return ordered.mapInPandas(passing, ANCHORED)


SPAN = "key string, nth long, last timestamp, at timestamp, fresh boolean"


def fresh_spans(events: DataFrame, key: str, life: str = "24 hours", as_of: str | None = None, delay: str = DELAY) -> DataFrame:
    """(key, nth, last, at, fresh): a row as a key turns fresh, with its first event or the first after a pause longer than ``life``, and a row as it turns stale, ``life`` after its last event.

    A stream tells that a key turned stale without any new event of it, by a timer on event time. Events wait in the state until the watermark has come to them and are taken in their order, so the state is one time, one number and
    the times of the delay. A batch takes the events up to ``as_of`` as a stream would whose watermark has come there; without ``as_of`` it takes all, and every span ends. Null keys and times are left out.
    """
    rows = events.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(F.col(key).cast("string").alias("key"), "ts")
    span = pd.Timedelta(life)
    if not events.isStreaming:
        until = F.lit(as_of).cast("timestamp") if as_of else None
        rows = rows if until is None else rows.where(F.col("ts") <= until)
        by, length = Window.partitionBy("key").orderBy("ts"), F.expr(f"interval {life}")
        begins = rows.withColumn("_b", F.lag("ts").over(by)).withColumn("_first", (F.col("_b").isNull() | (F.col("ts") > F.col("_b") + length)).cast("int")).withColumn("nth", F.sum("_first").over(by).cast("long"))
        told = begins.groupBy("key", "nth").agg(F.min("ts").alias("begin"), F.max("ts").alias("last"))
        ends = told.select("key", "nth", "last", (F.col("last") + length).alias("at"), F.lit(False).alias("fresh"))
        return told.select("key", "nth", F.col("begin").alias("last"), F.col("begin").alias("at"), F.lit(True).alias("fresh")).unionByName(ends if until is None else ends.where(F.col("at") < until))
    micros = int(span.value // 1000)

    def follow(own: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, nth, waiting = (state.get[0], state.get[1], list(state.get[2])) if state.exists else (None, 0, [])
        if not state.hasTimedOut:
            for batch in batches:
                waiting += (batch["ts"].astype("datetime64[us]").astype("int64")).tolist()
        now, out, left = state.getCurrentWatermarkMs() * 1000, [], []
        for at in sorted(waiting):
            if at > now:
                left.append(at)
                continue
            if last is not None and at > last + micros:
                out.append((own[0], nth, last, last + micros, False))
                last = None
            if last is None:
                nth += 1
                out.append((own[0], nth, at, at, True))
            last = at
        if last is not None and last + micros < now:
            out.append((own[0], nth, last, last + micros, False))
            last = None
        state.update((last, nth, left))
        due = [t for t in (left[0] if left else None, None if last is None else last + micros) if t is not None]
        if due:
            state.setTimeoutTimestamp(max(min(due) // 1000 + 1, now // 1000 + 1))
        found = pd.DataFrame(out, columns=["key", "nth", "last", "at", "fresh"])
        for c in ("last", "at"):
            found[c] = pd.to_datetime(found[c], unit="us")
        yield found

    return rows.withWatermark("ts", delay).groupBy("key").applyInPandasWithState(follow, SPAN, "last long, nth long, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def attempts(beats: DataFrame, key: str, most: int, patience: str = "3 minutes", as_of: str | None = None, delay: str = DELAY) -> DataFrame:
    """(key, attempt, last_ts, stale_at, status): every span of beats is an attempt; its silence sends the work back as pending, or ends it as failed once ``most`` attempts are spent. What comes after that is not told."""
    ended = fresh_spans(beats, key, patience, as_of, delay).where(~F.col("fresh") & (F.col("nth") <= most))
    return ended.select("key", F.col("nth").alias("attempt"), F.col("last").alias("last_ts"), F.col("at").alias("stale_at"), F.when(F.col("nth") >= most, "failed").otherwise("pending").alias("status"))


def settle_invoices(events: DataFrame) -> DataFrame:
    """(invoice_id, paid_at, reversed_at, state) of a table, in whatever order events came: a reversal voids the invoice that comes later, too. For streams, which can't keep every invoice, there is ``settlements``."""
    at = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("ts")))
    g = events.groupBy("invoice_id").agg(at("paid").alias("paid_at"), at("reversed").alias("reversed_at"))
    return g.withColumn("state", F.when(F.col("reversed_at").isNotNull(), "void").when(F.col("paid_at").isNotNull(), "settled").otherwise("open"))


def settlements(invoices: DataFrame, reversals: DataFrame, within: str = "7 days", delay: str = DELAY) -> DataFrame:
    """(invoice_id, paid_at, reversed_at, state) of (invoice_id, ts) each: an invoice with a reversal up to ``within`` before or after it is void, without one it is settled, and a reversal alone is told as reversed.

    A full outer join of two streams. What has no partner is told, and its state dropped, once the watermark is past the time in which one could come.
    """
    paid = invoices.select("invoice_id", F.col("ts").alias("paid_at")).withWatermark("paid_at", delay)
    back = reversals.select(F.col("invoice_id").alias("_id"), F.col("ts").alias("reversed_at")).withWatermark("reversed_at", delay)
    near = (F.col("reversed_at") >= F.col("paid_at") - F.expr(f"interval {within}")) & (F.col("reversed_at") <= F.col("paid_at") + F.expr(f"interval {within}"))
    joined = paid.join(back, (F.col("invoice_id") == F.col("_id")) & near, "full_outer")
    state = F.when(F.col("paid_at").isNull(), "reversed").when(F.col("reversed_at").isNotNull(), "void").otherwise("settled")
    return joined.select(F.coalesce("invoice_id", "_id").alias("invoice_id"), "paid_at", "reversed_at", state.alias("state"))


def expired_holds(holds: DataFrame, confirmations: DataFrame, life: str = "6 hours", delay: str = DELAY) -> DataFrame:
    """(hold_id, held_at, confirmed_at, state): confirmed within ``life`` of the hold, or expired; a stream-stream join bounded by time."""
    h = holds.select("hold_id", F.col("ts").alias("held_at")).withWatermark("held_at", delay)
    c = confirmations.select(F.col("hold_id").alias("_id"), F.col("ts").alias("confirmed_at")).withWatermark("confirmed_at", delay)
    joined = h.join(c, (F.col("hold_id") == F.col("_id")) & (F.col("confirmed_at") >= F.col("held_at")) & (F.col("confirmed_at") <= F.col("held_at") + F.expr(f"interval {life}")), "left_outer")
    return joined.select("hold_id", "held_at", "confirmed_at", F.when(F.col("confirmed_at").isNotNull(), "confirmed").otherwise("expired").alias("state"))


def freshness(rows: DataFrame, key: str, at: str, as_of: str, life: str = "24 hours") -> DataFrame:
    """(key, last, fresh): the batch form of a transition by timer."""
    g = rows.groupBy(key).agg(F.max(at).alias("last"))
    return g.withColumn("fresh", F.col("last") > F.lit(as_of).cast("timestamp") - F.expr(f"interval {life}"))


#: Parts of an upserted table. A batch rewrites those that its keys fall into.
PARTS = 64


def _commits(spark: SparkSession, path: str) -> list[tuple[int, str, int, list[int]]]:
    """(version, writer, batch, parts) of every batch that was written whole."""
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        return []
    rows = spark.read.schema("version int, writer string, batch long, parts array<int>").parquet(f"{path}/commits").collect()  # one a batch
    return sorted((r.version, r.writer, r.batch, r.parts) for r in rows)


def _newest(commits: list) -> dict[int, int]:
    """The version that holds each part."""
    return {part: version for version, _, _, parts in commits for part in parts}


def read_upserted(spark: SparkSession, path: str, schema: str | None = None, parts: list[int] | None = None) -> DataFrame | None:
    """The table as of its last whole batch, or those ``parts`` of it; None before the first."""
    held = _newest(_commits(spark, path))
    files = [f"{path}/data/version={v}/_part={p}" for p, v in sorted(held.items()) if parts is None or p in parts]
    if not files:
        return None
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(*files)


def upsert_batch(batch: DataFrame, path: str, keys: list[str], at: str, writer: str, number: int, parts: int = PARTS) -> None:
    """Merge a batch into a table, the newest row of each key staying. Only the parts that its keys fall into are read and written.

    A batch is there once its commit is written, after its parts. One that comes again, by its writer and number, does nothing; one that broke off is written anew over its rests. Parts are at versions of their own; those
    of two versions back are removed, so that whoever reads the version before still can.
    """
    spark = batch.sparkSession
    commits = _commits(spark, path)
    if any(w == writer and n == number for _, w, n, _ in commits):
        return
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
    batch = batch.withColumn("_part", part)
    touched = sorted(r[0] for r in batch.select("_part").distinct().collect())  # at most ``parts``
    version = commits[-1][0] + 1 if commits else 0
    if touched:
        before = read_upserted(spark, path, parts=touched)
        before = batch.limit(0) if before is None else before.withColumn("_part", part)
        merged = upsert_latest(before, batch, keys, at)
        merged.repartition(min(parts, len(touched)), "_part").write.mode("overwrite").partitionBy("_part").parquet(f"{path}/data/version={version}")
    commit = spark.createDataFrame([(version, writer, number, touched)], "version int, writer string, batch long, parts array<int>")
    commit.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    kept = set(_newest(commits).items()) | {(p, version) for p in touched}
    for v, _, _, own in commits:
        for p in own:
            if (p, v) not in kept and p in touched:
                old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data/version={v}/_part={p}")
                old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def upsert_stream(incoming: DataFrame, path: str, keys: list[str], at: str, checkpoint: str, writer: str = "stream", parts: int = PARTS):
    """Keep the newest row of each key in a Parquet table of parts, ``read_upserted`` reads it. ``writer`` names the stream: a batch of it that is replayed changes nothing."""
    return incoming.writeStream.foreachBatch(lambda batch, number: upsert_batch(batch, path, keys, at, writer, number, parts)).option("checkpointLocation", checkpoint)
