"""Streams over the events table give what the batch gives."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import jobs

from .compare import rows_of
from .conftest import SMALL


def drain(df, mode, spark, name, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return spark.table(name)


@pytest.fixture()
def events(spark, tmp_path):
    batch = spark.read.parquet(f"{SMALL}/events.parquet")
    batch.write.parquet(str(tmp_path / "events"))
    return batch, jobs.read_events(spark, str(tmp_path / "events"))


@pytest.mark.parametrize(
    ("name", "job"),
    [("fixed", lambda e: jobs.fixed_windows(e, "user_id", 2)), ("sliding", lambda e: jobs.sliding_rates(e, "error"))],
)
def test_windows(spark, events, tmp_path, name, job):
    batch, stream = events
    assert rows_of(drain(job(stream), "complete", spark, name, tmp_path)) == rows_of(job(batch))


def test_repeats_are_dropped(spark, events, tmp_path):
    batch, stream = events
    assert drain(jobs.first_sight(stream, ["event_id"]), "append", spark, "seen", tmp_path).count() == batch.count()


def test_anchored(spark, events, tmp_path):
    batch, stream = events
    job = lambda e: jobs.anchored_windows(e, 2, "6 hours")
    assert rows_of(drain(job(stream), "append", spark, "anchored", tmp_path)) == rows_of(job(batch))


def files(spark, rows, schema, folder):
    """A stream that takes each list of rows as a file of its own, in order."""
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder / f"f{k}"))
        for f in (folder / f"f{k}").glob("*.parquet"):
            folder.joinpath("in").mkdir(exist_ok=True)
            f.rename(folder / "in" / f"{k:03}.parquet")
            os.utime(folder / "in" / f"{k:03}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


def minutes(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=n)


def test_staleness_comes_by_a_timer(spark, tmp_path):
    """Late events within the delay are taken in their order; a key turns stale though nothing of it comes; stream equals batch at the last watermark."""
    parts = [[("a", 0), ("b", 1)], [("a", 50), ("b", 3)], [("a", 45), ("c", 47)], [("b", 120), ("a", 61)], [("c", 112), ("b", 119)], [("z", 300)], [("z", 420)]]
    rows = [[(k, minutes(m)) for k, m in p] for p in parts]
    stream = files(spark, rows, "k string, ts timestamp", tmp_path)
    got = rows_of(drain(jobs.fresh_spans(stream, "k", "30 minutes", delay="10 minutes"), "append", spark, "spans", tmp_path))
    batch = spark.createDataFrame([r for p in rows for r in p], "k string, ts timestamp")
    assert got == rows_of(jobs.fresh_spans(batch, "k", "30 minutes", as_of="2024-01-01 06:50:00"))  # 420 minutes less the delay
    stale = {(r.key, r.at) for r in spark.table("spans").where("not fresh").collect()}
    assert ("c", minutes(142)) in stale and ("a", minutes(91)) in stale and ("a", minutes(30)) in stale
    job = lambda e: jobs.attempts(e, "k", 2, "30 minutes", "2024-01-01 06:50:00", "10 minutes")
    assert rows_of(drain(job(stream), "append", spark, "attempts", tmp_path)) == rows_of(job(batch))
    assert {(r.key, r.attempt): r.status for r in job(batch).collect()} == {("a", 1): "pending", ("a", 2): "failed", ("b", 1): "pending", ("b", 2): "failed", ("c", 1): "pending", ("c", 2): "failed", ("z", 1): "pending"}


def test_settlements_of_streams(spark, tmp_path):
    """A reversal before its invoice, after it, too far from it, and alone."""
    paid = [[("i1", minutes(100)), ("i2", minutes(100))], [("i3", minutes(110)), ("i4", minutes(120))], [("end", minutes(10_000))], [("end2", minutes(20_000))]]
    back = [[("i1", minutes(80))], [("i3", minutes(130)), ("i9", minutes(115))], [("end3", minutes(10_000))], [("i4", minutes(19_000)), ("end4", minutes(20_000))]]
    for name in ("paid", "back"):
        (tmp_path / name).mkdir()
    schema = "invoice_id string, ts timestamp"
    got = drain(jobs.settlements(files(spark, paid, schema, tmp_path / "paid"), files(spark, back, schema, tmp_path / "back"), "60 minutes"), "append", spark, "settled", tmp_path)
    batch = jobs.settlements(*[spark.createDataFrame([r for p in rows for r in p], schema) for rows in (paid, back)], "60 minutes")
    told = lambda df: sorted((r.invoice_id, r.state) for r in df.collect() if r.invoice_id in ("i1", "i2", "i3", "i9"))
    assert told(got) == told(batch) == [("i1", "void"), ("i2", "settled"), ("i3", "void"), ("i9", "reversed")]
    assert {(r.invoice_id, r.state) for r in batch.collect()} >= {("i4", "settled"), ("i4", "reversed")}


def test_upserts_touch_their_parts_only(spark, tmp_path):
    path, schema = str(tmp_path / "table"), "k int, at int, v string"
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    put = lambda df, writer, n: jobs.upsert_batch(df, path, ["k"], "at", writer, n, parts=8)
    read = lambda: sorted(map(tuple, jobs.read_upserted(spark, path).select("k", "at", "v").collect()))
    assert jobs.read_upserted(spark, path) is None
    put(make(*[(k, 1, "a") for k in range(40)]), "w", 0)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "table" / "data").rglob("*.parquet")}
    put(make((3, 2, "b"), (5, 0, "late"), (99, 1, "new")), "w", 1)
    want = sorted([(k, 1, "a") for k in range(40) if k != 3] + [(3, 2, "b"), (99, 1, "new")])
    assert read() == want
    untouched = [p for p in before if p.exists()]
    assert len(untouched) >= 5 and all(p.stat().st_mtime_ns == before[p] for p in untouched)
    put(make((3, 9, "again")), "w", 1)  # a replay
    assert read() == want
    put(make((3, 9, "other")), "second writer", 0)  # batch 0 of another stream keeps what is there
    assert (3, 9, "other") in read() and len(read()) == 41
    put(make(), "w", 2)
    for n in range(3, 7):
        put(make((3, 9 + n, "more")), "w", n)
    part = [p for p in (tmp_path / "table" / "data").rglob("_part=*") if spark.read.parquet(str(p)).where("k = 3").count()]
    assert len(part) <= 2 and (3, 15, "more") in read() and len(read()) == 41


def test_upsert_stream_with_an_interruption(spark, tmp_path):
    rows = [[(k, n, f"v{n}") for k in range(10 * n, 10 * n + 15)] for n in range(4)]
    stream, path = files(spark, rows, "k int, at int, v string", tmp_path), str(tmp_path / "table")
    jobs.upsert_batch(spark.createDataFrame([(0, 100, "kept"), (500, 1, "old")], "k int, at int, v string"), path, ["k"], "at", "load", 0)
    for _ in range(2):
        jobs.upsert_stream(stream, path, ["k"], "at", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(240)
    newest = {k: (at, v) for part in rows for k, at, v in part} | {0: (100, "kept"), 500: (1, "old")}
    assert {r.k: (r["at"], r.v) for r in jobs.read_upserted(spark, path).collect()} == newest


def test_reversal_before_invoice(spark):
    rows = [("i1", "reversed", 1), ("i1", "paid", 2), ("i2", "paid", 1)]
    df = spark.createDataFrame(rows, "invoice_id string, event_type string, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert {r.invoice_id: r.state for r in jobs.settle_invoices(df).collect()} == {"i1": "void", "i2": "settled"}
