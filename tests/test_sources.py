"""Readers and writers: artifacts and what is wrong with them, publishers' rows, narratives, logs, database tables."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import dates
from ledgerloom.sources import readers

AS_OF = "2024-01-03 00:00:00"


def test_artifacts(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps({"records": [{"source": "ungm", "title": "A", "locations": {"scope": "unknown"}}, {"source": "ppa", "title": "B"}], "coverage": {"scope": "all", "pages": [1, 2]}}))
    (tmp_path / "empty.json").write_text(json.dumps({"records": [], "coverage": None}))
    (tmp_path / "broken.json").write_text('{"records": [{"source": ')
    (tmp_path / "other.json").write_text('{"rows": []}')
    records, coverage, bad = readers.read_catalogue(spark, str(tmp_path / "*.json"))
    assert sorted((r.source, r.title) for r in records.collect()) == [("ppa", "B"), ("ungm", "A")]
    said = coverage.select(F.regexp_extract("file", "([a-z]+).json", 1).alias("f"), F.try_variant_get("coverage", "$.scope", "string").alias("scope"), F.try_variant_get("coverage", "$.pages[1]", "int").alias("page"), "records").collect()
    assert sorted(map(tuple, said)) == [("empty", None, None, 0), ("good", "all", 2, 2)]
    assert sorted((r.file.rsplit("/", 1)[1], r.reason) for r in bad.collect()) == [("broken.json", "not_read"), ("other.json", "no_records")]


@pytest.mark.parametrize(("text", "want"), [("10/07/2026 17:00", "2026-10-07"), ("October 7, 2026 midnight", "2026-10-07"), ("by 7-Oct-2026", "2026-10-07"), ("at 2026-10-07T10:00:00Z", None), ("2026-10-07 10:00", "2026-10-07"), ("2026-02-31 or 1 May 2026", None), ("10/07/1999", None), (None, None)])
def test_publishers_dates(spark, text, want):
    found = spark.range(1).select(dates.publisher_date(F.lit(text).cast("string")).alias("d")).first().d
    assert (None if found is None else str(found)) == want


def rows(spark, *items):
    return spark.createDataFrame([(json.dumps(i),) for i in items], "value string")


def test_bank(spark):
    base = {"id": "OP00000001", "notice_type": "Invitation for Bids", "noticedate": "01-Oct-2023", "notice_status": "Published", "submission_deadline_date": "2024-02-01T00:00:00Z", "submission_deadline_time": "10:30", "project_ctry_name": "Lebanon", "project_name": "Water", "bid_reference_no": "B/7", "bid_description": " Pipes  and\npumps ", "notice_text": "<p>Scope &amp; terms</p><script>x()</script>" + "word " * 800}
    other = lambda n, **k: {**base, "id": f"OP0000000{n}", **k}
    ok, refused = readers.normalise_bank(rows(spark, base, other(2, notice_status="Draft"), other(3, project_ctry_name="Jordan"), other(4, submission_deadline_time="25:00"), other(5, notice_text=""), other(6, bid_description=None), {**base, "id": "X1"}, other(7, notice_text="w" * 12001), other(8, notice_type="Award"), other(9, submission_deadline_date=None)), AS_OF)
    (r,) = ok.collect()
    assert (r.source_key, r.source_url, r.title, str(r.deadline), r.deadline_local, r.application_status) == ("worldbank:OP00000001", readers.BANK_ROOT + "OP00000001", "Pipes and pumps", "2024-02-01", "2024-02-01T10:30", "needs_verification")
    assert r.description == "Pipes and pumps. Water. Invitation for Bids" and r.identity_claim.reference == "OP00000001" and r.geography.evidence[0].text == "Lebanon" and str(r.published_at) == "2023-10-01"
    scope = [e.text for e in r.evidence if e.label.startswith("Publisher notice scope")]
    assert len(scope) == 3 and max(map(len, scope)) <= 1500 and " ".join(scope).split() == ("Scope & terms " + "word " * 800).split() and len(r.evidence) == 3 + 8 and all(e.url == r.source_url for e in r.evidence)
    assert {x.source_key: x.reason for x in refused.collect()} == {"OP00000002": "not_published", "OP00000003": "outside_scope", "OP00000004": "deadline_time_invalid", "OP00000005": "schema_changed", "OP00000006": "schema_changed", "X1": "id_changed", "OP00000007": "text_exceeds_contract", "OP00000008": "type_changed", "OP00000009": "schema_changed"}


def test_procurement_states(spark):
    base = {"noticeId": "a", "title": "T", "type": "Solicitation", "active": "Yes", "postedDate": "2023-12-01", "responseDeadLine": "2024-05-01", "placeOfPerformance": {"country": {"code": "usa", "name": "United States"}}}
    cases = {"a": ({}, "needs_verification"), "b": ({"active": "No"}, "closed"), "c": ({"type": "Award Notice"}, "closed"), "d": ({"baseType": "Cancelled", "active": "Yes"}, "closed"), "e": ({"responseDeadLine": "2024-01-02"}, "closed"), "f": ({"type": "Presolicitation", "responseDeadLine": "2024-01-02"}, "needs_verification"), "g": ({"responseDeadLine": None, "reponseDeadLine": "01/02/2024"}, "closed"), "h": ({"active": None}, "needs_verification")}
    ok, refused = readers.normalise_procurement(rows(spark, *[{**base, **change, "noticeId": k} for k, (change, _) in cases.items()], {"title": "x"}), AS_OF)
    got = {r.source_key.split(":")[1]: r for r in ok.collect()}
    assert {k: r.application_status for k, r in got.items()} == {k: want for k, (_, want) in cases.items()}
    assert [e.text for e in got["a"].evidence if e.label == "Place of performance country"] == ["United States"] and got["a"].source_url == "https://sam.gov/opp/a/view" and refused.count() == 1


def test_grants(spark):
    base = {"id": "1", "number": "N-1", "title": "A &amp; B", "openDate": "10/07/2023", "closeDate": "01/02/2024", "oppStatus": "posted", "alnist": ["10.1"], "synopsis": {"synopsisDesc": "d" * 25_000, "applicantTypes": [{"id": "x"}], "awardFloor": "5"}}
    ok, refused = readers.normalise_grants(rows(spark, base, {**base, "id": "2", "oppStatus": "forecasted", "synopsis": None}, {**base, "id": "3", "synopsis": {"responseDate": "January 9, 2024"}}, {**base, "id": "4", "title": "t" * 2001}, {"number": "5"}), AS_OF)
    got = {r.source_key: r for r in ok.collect()}
    assert {k: (r.application_status, str(r.deadline)) for k, r in got.items()} == {"grants-gov:1": ("closed", "2024-01-02"), "grants-gov:2": ("needs_verification", "2024-01-02"), "grants-gov:3": ("needs_verification", "2024-01-09")}
    one = got["grants-gov:1"]
    assert [e.label for e in one.evidence if e.label.startswith("Opportunity desc")] == [f"Opportunity description ({k}/3)" for k in (1, 2, 3)] and one.title == "A & B"
    assert {e.label: e.text for e in one.evidence}["Assistance Listing numbers"] == '["10.1"]' and {r.reason for r in refused.collect()} == {"text_exceeds_contract", "detail_schema_changed"}


def test_narratives_and_logs(spark, tmp_path):
    (tmp_path / "a.md").write_text("<!-- made\nby hand -->\n# Title\ntext\n")
    (tmp_path / "b.md").write_text("plain <!-- stays -->")
    assert sorted(r.text for r in readers.read_narratives(spark, str(tmp_path / "*.md")).collect()) == ["# Title\ntext\n", "plain <!-- stays -->"]
    runs = spark.createDataFrame([("s", datetime.datetime(2024, 1, 1), None, "ok", 3, 4, "other")], "source string, started_at timestamp, finished_at timestamp, status string, records int, expected_total int, more string")
    events = spark.createDataFrame([("a", "x", "e", "1", "{}", datetime.datetime(2024, 1, d)) for d in (1, 1, 2)], "actor string, action string, entity string, entity_id string, detail string, created_at timestamp")
    for _ in range(2):
        readers.append_source_run(runs, str(tmp_path / "runs"))
        readers.append_events(events, str(tmp_path / "events"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2 and "more" not in spark.read.parquet(str(tmp_path / "runs")).columns
    logged = spark.read.parquet(str(tmp_path / "events"))
    assert logged.count() == 6 and logged.where("day = '2024-01-02'").count() == 2 and (tmp_path / "events" / "day=2024-01-01").exists()


def test_database_tables(spark):
    try:
        spark._jvm.java.lang.Class.forName("org.apache.derby.iapi.jdbc.AutoloadedDriver")
    except Exception:
        pytest.skip("no database driver here")
    url, options = "jdbc:derby:memory:ledger;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(100).selectExpr("id", "id * 2 as twice").write.jdbc(url, "kept", mode="overwrite", properties=options)
    back = readers.jdbc_table(spark, url, "kept", "id", 0, 100, 4, options)
    assert back.rdd.getNumPartitions() == 4 and back.agg(F.sum("twice")).first()[0] == 9900
