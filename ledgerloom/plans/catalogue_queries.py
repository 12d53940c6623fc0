"""Queries of the catalogue and of matching over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogue, matching
from .bindings import AS_OF, NOTICES, notices, pick, table


def board_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    conflicted = catalogue.group_conflict(notices(spark, sf_dir), AS_OF)
    board = catalogue.representative(conflicted, AS_OF).where("rank = 1")
    return board.select("group_key", "id", "n_aliases", "conflict", catalogue.board_status(AS_OF, F.col("conflict")).alias("status"))


def board_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.aliases(notices(spark, sf_dir)).select("group_key", F.array_join(F.transform("aliases", lambda a: a.cast("string")), ",").alias("aliases"))


def group_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.group_version(notices(spark, sf_dir))


def group_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.group_conflict(notices(spark, sf_dir), AS_OF).select("id", "conflict")


def usable_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(spark, sf_dir).select("id", catalogue.is_usable(AS_OF).alias("usable"))


def catalogue_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.filter_catalogue(notices(spark, sf_dir), text="the", kind="grant", status="open").select("id", "group_key")


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    later = events.withColumn("ts", F.col("ts") + F.expr("interval 1 hour")).where("value > 5")
    return catalogue.upsert_latest(events, later, ["user_id", "event_type"], "ts")


def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.status_rollup(table(spark, sf_dir, "documents"), ["source", "lang"], "n_chars")


def status_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.status_rollup(notices(spark, sf_dir), ["application_status", "detail_status"], "fetched_at", cube=True)


def coverage_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    expected = docs.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg((F.count("*") * 2).alias("expected_total"))
    return catalogue.coverage(docs.withColumn("key", F.md5("text")), ["source"], "key", expected)


def batch_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return catalogue.batch_scope(docs.where("lang = 'es'"), docs.where("lang = 'fr'").select("source").distinct())


def reject_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = {
        "https": F.col("url").startswith("https://"),
        "host": F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).rlike(r"\.example\.(com|org)$"),
        "length": F.length("html") >= 2000,
        "title": F.length(F.regexp_extract("html", r"<title>([^<]*)", 1)).between(3, 60),
    }
    return catalogue.validate(pages, rules).select("page_id", F.array_join("reasons", ",").alias("reasons"))


def source_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notices(spark, sf_dir).select("id", "source", F.concat("lang", F.lit(".example")).alias("host"))
    pairs = table(spark, sf_dir, "labels").join(rows, F.col("doc_id") == F.col("id")).where("toxic = 0 and quality = 1").select("source", "host")
    return catalogue.valid_source_pair(rows, pairs).select("id", "paired")


def candidate_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Members, opportunities with fetched_at, and what is blocked, spent and matched."""
    members = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), (F.col("s_suppkey") % 3).alias("revision"), F.array(pick(F.col("s_suppkey"), "ECONOMY", "STANDARD", "PROMO", "SMALL")).alias("opportunity_types"))
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("opportunity_id"), F.col("p_type").alias("kind"), F.concat(F.lit("g"), (F.col("p_partkey") % 500).cast("string")).alias("group_key"), F.col("p_brand").alias("group_version"), (F.col("p_size") > 25).alias("usable"), F.col("p_retailprice").alias("fetched_at")
    )
    items = table(spark, sf_dir, "lineitem")
    done = items.select(F.col("l_suppkey").alias("user_id"), F.col("l_partkey").alias("opportunity_id"), "l_returnflag").join(parts, "opportunity_id").join(members.select("user_id", "revision"), "user_id").drop("kind", "usable", "fetched_at")
    flagged = lambda f: done.where(F.col("l_returnflag") == f)
    keys = ["user_id", "opportunity_id", "revision", "group_version"]
    matched = flagged("N").groupBy("user_id", "opportunity_id").agg(F.max("revision").alias("revision"), F.max("group_version").alias("group_version"))
    return members, parts, flagged("A").select(*keys), flagged("R").select("user_id", "group_key", "revision", "group_version"), matched


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.candidates(*candidate_tables(spark, sf_dir))


def winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notices(spark, sf_dir).withColumn("group_key", catalogue.group_key()).withColumn("allowed_kinds", F.explode(F.array(F.array(F.lit("grant"), F.lit("call")), F.array(F.lit("tender")))))
    return matching.winners(rows, [F.col("fetched_at").desc(), F.col("id").desc()]).select("kind_set", "group_key", "id")


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey", "o_totalprice")
    return catalogue.keyset_page(orders, ["o_orderdate", "o_orderkey"], ("1998-06-01 00:00:00", 100), filters="status=any")


def facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = notices(spark, sf_dir).select(F.array(F.upper("lang")).alias("codes"), F.when(F.col("geography") == "outside", "worldwide").otherwise("countries").alias("scope"))
    every = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"))
    return catalogue.facet(rows, "codes", "scope", every)


def page_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = catalogue.filter_catalogue(notices(spark, sf_dir), kind="tender")
    return shown.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("group_key").alias("groups"))


def alerts_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notices(spark, sf_dir)
    matches = n.join(table(spark, sf_dir, "labels"), F.col("id") == F.col("doc_id")).select(
        (F.col("id") % 97).alias("user_id"), F.col("id").alias("opportunity_id"), "content_hash", F.col("source").alias("group_version"), (F.col("id") % 101).alias("fit"), ((F.col("id") % 50) / 50).alias("confidence"),
        F.when(F.col("quality") == 1, "possible").otherwise("unlikely").alias("eligibility"), (F.col("toxic") == 0).alias("alerts_on"),
    )
    sent = matches.where("opportunity_id % 3 = 0")
    return matching.new_alerts(matches, sent).select("user_id", "opportunity_id", "fit", "confidence")


def latest_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("opportunity_id"), F.col("ts").alias("created_at"))
    return matching.latest_alerts(events)


def match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    p0, p1 = F.col("l_discount"), F.col("l_tax")

    def answer(p2: float, shift: float):
        probabilities = F.create_map(F.lit("0"), p0, F.lit("1"), p1, F.lit("2"), F.lit(p2), F.lit("3"), 1 - p0 - p1 - p2)
        return F.struct(probabilities.alias("probabilities"), (p1 + 2 * F.lit(p2) + 3 * (1 - p0 - p1 - p2) + shift).alias("score"), F.lit("3").alias("choice"))

    rows = items.select(
        "l_orderkey", "l_linenumber", "l_partkey", answer(0.3, 0.0).alias("sector"), answer(0.2, 0.0).alias("capability"), F.when(F.col("l_returnflag") == "N", "possible").otherwise("unlikely").alias("eligibility"), (F.col("l_linestatus") == "O").alias("complete")
    )
    return matching.score_matches(rows).select("l_orderkey", "l_linenumber", "l_partkey", "fit", F.round("confidence", 6).alias("confidence"), "verdict")


def running_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    return matching.running_cap(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "cents", 100_000_000).select("o_orderkey", "running", "accepted")


def cap_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    return matching.first_crossing(matching.running_cap(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "cents", 100_000_000), ["o_custkey"])


def spend_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("status"), F.round(F.col("value") * 100).cast("long").alias("reserved"), F.when(F.col("event_id") % 7 != 0, F.round(F.col("value") * 90).cast("long")).alias("actual"))
    return matching.spend_by_status(e)


def asof_clearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    cleared = events.where("event_type = 'signup'").select("user_id", F.col("ts").alias("cleared_ts"), F.col("event_id").alias("clearance"))
    return matching.asof_latest(bought, cleared, "user_id", "ts", "cleared_ts", "clearance", back="48 hours").select("event_id", "clearance", "matched_at")


def interval_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    charges = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("charge_id"), "ts")
    credits = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("credit_id"), F.col("ts").alias("valid_from"), F.when(F.col("event_id") % 7 == 0, F.col("ts") + F.expr("interval 100 years")).when(F.col("event_id") % 7 != 1, F.col("ts") + F.expr("interval 6 hours")).alias("expires_at"))
    return matching.interval_join(charges, credits, "user_id", "ts", "valid_from", "expires_at", 3600).select("charge_id", "credit_id")


def available_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("credit_id"), F.col("ts").alias("valid_from"), (F.col("ts") + F.expr("interval 5 days")).alias("expires_at"), F.when(F.col("event_type") == "signup", "available").otherwise("spent").alias("state"))
    return matching.available_credits(e, "2024-01-15 00:00:00").select("user_id", "credit_id")


def page_sequence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").withColumn("total", F.lit(4))
    return catalogue.page_sequence_audit(items, "l_orderkey", "l_linenumber", "l_partkey", "total")


def fair_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notices(spark, sf_dir).withColumn("class", F.when(F.col("deadline") >= F.lit("2024-01-03").cast("date"), "future").otherwise("backlog"))
    return catalogue.fair_queue(n, "class", [F.col("fetched_at"), F.col("id")]).select("id", "class", "turn")


def due_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notices(spark, sf_dir).withColumn("tried_at", F.when(F.col("id") % 4 != 0, F.col("fetched_at")))
    return catalogue.due_ids(n, "tried_at", 50).select("id", "tried_at")


def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.md5("event_type").alias("digest"))
    return catalogue.snapshot_changes(e, "user_id", "ts", "digest").select("event_id", "changed")


def locale_set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("key", F.concat_ws("-", "source", (F.col("doc_id") % 41).cast("string")))
    return catalogue.set_difference(docs.where("lang = 'fr'"), docs.where("lang = 'de'"), "key")


def enrichment_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.backlog(notices(spark, sf_dir), AS_OF)


def merged_locales(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notices(spark, sf_dir).select(F.concat_ws("-", "source", (F.col("id") % 23).cast("string")).alias("source_key"), F.col("lang").alias("locale"), "title", "deadline", (F.col("detail_status") == "verified").alias("verified"), "id")
    side = lambda k: n.where(F.col("id") % 2 == k).groupBy("source_key", "locale").agg(F.max(F.struct("id", "title", "deadline", "verified")).alias("r")).select("source_key", "locale", "r.title", "r.deadline", "r.verified")
    return catalogue.merge_locales(side(0), side(1)).withColumn("locales", F.array_join("locales", ","))


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = matching.chunk_text(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 1500, "fixed")
    return cut.select("doc_id", "parts", "part", F.md5("piece").alias("piece_md5"))


def word_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = matching.chunk_text(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 1500, "words")
    return cut.select("doc_id", "parts", "part", F.length("piece").alias("chars"))


QUERIES = {f.__name__: f for f in (
    board_representative, board_aliases, group_version, group_conflict, usable_notices, catalogue_filter, upsert_latest, status_rollup, status_cube, coverage_reconcile, batch_scope, reject_records, source_pairs, candidates, winners, keyset_page, facet_values,
    page_tally, alerts_new, latest_alerts, match_score, running_cap, cap_crossings, spend_by_status, asof_clearance, interval_credit, available_credits, page_sequence_audit, fair_queue, due_ids, snapshot_changes, locale_set_diff, enrichment_backlog,
    merged_locales, text_chunks, word_chunks,
)}

_CONFLICT = f"""{NOTICES}, conflicted AS (
  SELECT *, sum(CASE WHEN detail_status = 'verified' AND fresh THEN 1 ELSE 0 END) OVER (PARTITION BY group_key)
          - sum(CASE WHEN detail_status = 'verified' AND fresh THEN 1 ELSE 0 END) OVER (PARTITION BY group_key, deadline, kind, application_status) > 0 AS conflict,
         geography = 'confirmed' AND detail_status = 'verified' AND NOT deadline_conflict AND application_status = 'open' AND fresh AND deadline > DATE '2024-01-03' AS usable
  FROM keyed
)"""
_CENTS = "r AS (SELECT *, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM orders)"

ORACLES = {
    "word_chunks": r"""WITH RECURSIVE c AS (SELECT doc_id, 0 AS part, '' AS piece, regexp_replace(text, '^\s+|\s+$', '', 'g') AS rest FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, part + 1, CASE WHEN length(rest) <= 1500 THEN rest ELSE regexp_replace(substring(rest, 1, stop), '\s+$', '') END, CASE WHEN length(rest) <= 1500 THEN '' ELSE regexp_replace(substring(rest, stop + 1), '^\s+', '') END
  FROM (SELECT *, coalesce(nullif(length(regexp_extract(substring(rest, 1, 1501), '(?s)^(.*) ', 1)), 0), 1500) AS stop FROM c WHERE rest <> ''))
SELECT doc_id, CAST(max(part) OVER (PARTITION BY doc_id) AS INTEGER) AS parts, CAST(part AS INTEGER) AS part, CAST(length(piece) AS INTEGER) AS chars FROM c WHERE part > 0""",
    "board_representative": f"""WITH {_CONFLICT}, ranked AS (
  SELECT *, count(*) OVER (PARTITION BY group_key) AS n_aliases, row_number() OVER (PARTITION BY group_key ORDER BY usable DESC NULLS FIRST,
    (geography = 'confirmed' AND application_status = 'open' AND (deadline IS NULL OR deadline >= DATE '2024-01-03')) DESC NULLS FIRST, (detail_status = 'verified' AND fresh) DESC NULLS FIRST,
    fetched_at DESC, source DESC, source_key DESC, id DESC) AS rank FROM conflicted)
SELECT group_key, id, n_aliases, conflict, CASE WHEN application_status IN ('closed', 'not_open') OR deadline < DATE '2024-01-03' THEN 'closed'
  WHEN detail_status = 'verified' AND NOT deadline_conflict AND NOT conflict AND fresh AND deadline > DATE '2024-01-03' THEN 'current' ELSE 'needs_review' END AS status FROM ranked WHERE rank = 1""",
    "board_aliases": f"WITH {NOTICES} SELECT group_key, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS aliases FROM keyed GROUP BY 1",
    "group_version": f"WITH {NOTICES} SELECT group_key, count(*) AS n, md5(string_agg(content_hash, '|' ORDER BY source, source_key)) AS version FROM keyed GROUP BY 1",
    "group_conflict": f"WITH {_CONFLICT} SELECT id, conflict FROM conflicted",
    "usable_notices": f"WITH {_CONFLICT} SELECT id, usable FROM conflicted",
    "catalogue_filter": f"WITH {NOTICES}, a AS (SELECT *, bool_or(contains(lower(title), 'the')) OVER (PARTITION BY group_key) AS hit FROM keyed) SELECT id, group_key FROM a WHERE hit AND kind = 'grant' AND application_status = 'open'",
    "upsert_latest": """WITH u AS (SELECT user_id, event_type, ts, event_id, value, 0 AS new FROM events UNION ALL SELECT user_id, event_type, ts + INTERVAL 1 HOUR, event_id, value, 1 FROM events WHERE value > 5)
SELECT user_id, event_type, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, new DESC, event_id DESC, value DESC) AS n FROM u) WHERE n = 1""",
    "status_rollup": "SELECT source, lang, count(*) AS n, max(n_chars) AS latest, CAST(grouping(source, lang) AS BIGINT) AS level FROM documents GROUP BY ROLLUP (source, lang)",
    "status_cube": f"WITH {NOTICES} SELECT application_status, detail_status, count(*) AS n, max(fetched_at) AS latest, CAST(grouping(application_status, detail_status) AS BIGINT) AS level FROM keyed GROUP BY CUBE (application_status, detail_status)",
    "coverage_reconcile": """WITH e AS (SELECT source, count(*) * 2 AS expected_total FROM documents JOIN labels USING (doc_id) GROUP BY 1), f AS (SELECT source, count(*) AS records, count(DISTINCT md5(text)) AS unique_records FROM documents GROUP BY 1)
SELECT coalesce(e.source, f.source) AS source, coalesce(records, 0) AS records, coalesce(unique_records, 0) AS unique_records, expected_total, CASE WHEN expected_total IS NULL THEN 'unexpected_stream' WHEN coalesce(records, 0) <> coalesce(unique_records, 0) THEN 'duplicates'
  WHEN coalesce(unique_records, 0) < expected_total THEN 'incomplete' WHEN unique_records > expected_total THEN 'surplus' ELSE 'complete' END AS verdict FROM e FULL JOIN f ON e.source = f.source""",
    "batch_scope": "SELECT coalesce(a.source, b.source) AS source, b.source IS NULL AS missing, a.source IS NULL AS unexpected FROM (SELECT DISTINCT source FROM documents WHERE lang = 'fr') a FULL JOIN (SELECT DISTINCT source FROM documents WHERE lang = 'es') b ON a.source = b.source",
    "reject_records": r"""SELECT page_id, concat_ws(',', CASE WHEN NOT starts_with(url, 'https://') THEN 'https' END, CASE WHEN NOT regexp_matches(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '\.example\.(com|org)$') THEN 'host' END,
  CASE WHEN NOT length(html) >= 2000 THEN 'length' END, CASE WHEN NOT length(regexp_extract(html, '<title>([^<]*)', 1)) BETWEEN 3 AND 60 THEN 'title' END) AS reasons FROM pages""",
    "source_pairs": "SELECT doc_id AS id, (source, lang) IN (SELECT (source, lang) FROM documents JOIN labels USING (doc_id) WHERE toxic = 0 AND quality = 1) AS paired FROM documents",
    "candidates": """WITH m AS (SELECT s_suppkey AS user_id, s_suppkey % 3 AS revision, (['ECONOMY', 'STANDARD', 'PROMO', 'SMALL'])[s_suppkey % 4 + 1] AS kind FROM supplier),
p AS (SELECT p_partkey AS opportunity_id, p_type AS kind, 'g' || p_partkey % 500 AS group_key, p_brand AS group_version, p_size > 25 AS usable FROM part),
d AS (SELECT l_suppkey AS user_id, l_partkey AS opportunity_id, l_returnflag, group_key, group_version, revision FROM lineitem JOIN p ON l_partkey = opportunity_id JOIN m ON l_suppkey = m.user_id),
k AS (SELECT user_id, opportunity_id, max(revision) AS revision, max(group_version) AS group_version FROM d WHERE l_returnflag = 'N' GROUP BY 1, 2)
SELECT m.user_id, p.opportunity_id, p.group_key, p.group_version, m.revision FROM m JOIN p ON m.kind = p.kind LEFT JOIN k ON k.user_id = m.user_id AND k.opportunity_id = p.opportunity_id
WHERE p.usable AND NOT EXISTS (SELECT 1 FROM d WHERE l_returnflag = 'A' AND d.user_id = m.user_id AND d.opportunity_id = p.opportunity_id AND d.revision = m.revision AND d.group_version = p.group_version)
  AND NOT EXISTS (SELECT 1 FROM d WHERE l_returnflag = 'R' AND d.user_id = m.user_id AND d.group_key = p.group_key AND d.revision = m.revision AND d.group_version = p.group_version)
  AND (k.revision IS NULL OR k.revision <> m.revision OR k.group_version <> p.group_version)""",
    "winners": f"""WITH {NOTICES}, w AS (SELECT 'call,grant' AS kind_set, * FROM keyed WHERE kind IN ('grant', 'call') UNION ALL SELECT 'tender', * FROM keyed WHERE kind = 'tender')
SELECT kind_set, group_key, id FROM (SELECT *, row_number() OVER (PARTITION BY kind_set, group_key ORDER BY fetched_at DESC, id DESC) AS n FROM w) WHERE n = 1""",
    "keyset_page": "SELECT o_orderdate, o_orderkey, o_totalprice, sha256('status=any') AS filter_hash FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1998-06-01', 100) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 51",
    "facet_values": f"WITH {NOTICES} SELECT DISTINCT upper(lang) AS code FROM keyed UNION SELECT 'N' || n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM keyed WHERE geography = 'outside')",
    "page_tally": f"WITH {NOTICES} SELECT source, count(*) AS n, count(DISTINCT group_key) AS groups FROM keyed WHERE kind = 'tender' GROUP BY 1",
    "alerts_new": f"""WITH {NOTICES} SELECT id % 97 AS user_id, id AS opportunity_id, id % 101 AS fit, (id % 50) / 50 AS confidence FROM keyed JOIN labels ON id = doc_id
WHERE id % 101 >= 70 AND (id % 50) / 50 >= 0.65 AND quality = 1 AND toxic = 0 AND id % 3 <> 0""",
    "latest_alerts": "SELECT user_id, opportunity_id, created_at, rank FROM (SELECT user_id, event_id AS opportunity_id, ts AS created_at, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank FROM events) WHERE rank <= 30",
    "match_score": """WITH a AS (SELECT *, l_tax + 2 * CAST(0.3 AS DOUBLE) + 3 * (1 - l_discount - l_tax - CAST(0.3 AS DOUBLE)) + CAST(0 AS DOUBLE) AS s, l_tax + 2 * CAST(0.2 AS DOUBLE) + 3 * (1 - l_discount - l_tax - CAST(0.2 AS DOUBLE)) + CAST(0 AS DOUBLE) AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor((CAST(0.4 AS DOUBLE) * s + CAST(0.6 AS DOUBLE) * c) / 3 * 100 + CAST(0.5 AS DOUBLE)) AS INTEGER) AS fit,
  round(least(1 - l_discount - l_tax - CAST(0.3 AS DOUBLE), 1 - l_discount - l_tax - CAST(0.2 AS DOUBLE)), 6) AS confidence, CASE WHEN l_linestatus <> 'O' THEN 'unclear' WHEN l_returnflag = 'N' THEN 'possible' ELSE 'unlikely' END AS verdict FROM a""",
    "running_cap": f"WITH {_CENTS} SELECT o_orderkey, running, running <= 100000000 AS accepted FROM r",
    "cap_crossings": f"WITH {_CENTS} SELECT o_custkey, min(running) AS crossed_at FROM r WHERE running > 100000000 GROUP BY 1",
    "spend_by_status": "SELECT event_type AS status, count(*) AS calls, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS reserved, CAST(sum(CASE WHEN event_id % 7 <> 0 THEN CAST(round(value * 90) AS BIGINT) END) AS BIGINT) AS actual, count(*) FILTER (event_id % 7 = 0) AS unsettled FROM events GROUP BY 1",
    "asof_clearance": """WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), s AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'signup')
SELECT p.event_id, CASE WHEN s.ts >= p.ts - INTERVAL 48 HOUR THEN s.event_id END AS clearance, CASE WHEN s.ts >= p.ts - INTERVAL 48 HOUR THEN s.ts END AS matched_at FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts >= s.ts""",
    "interval_credit": "SELECT p.event_id AS charge_id, s.event_id AS credit_id FROM events p JOIN events s ON p.user_id = s.user_id AND p.event_type = 'purchase' AND s.event_type = 'signup' AND p.ts >= s.ts AND (s.event_id % 7 IN (0, 1) OR p.ts < s.ts + INTERVAL 6 HOUR)",
    "available_credits": """SELECT user_id, credit_id FROM (SELECT user_id, event_id AS credit_id, row_number() OVER (PARTITION BY user_id ORDER BY ts + INTERVAL 5 DAY, event_id) AS n FROM events
  WHERE event_type = 'signup' AND ts <= TIMESTAMP '2024-01-15' AND ts + INTERVAL 5 DAY > TIMESTAMP '2024-01-15 00:31:00') WHERE n = 1""",
    "page_sequence_audit": """WITH m AS (SELECT *, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b, count(*) OVER (PARTITION BY l_orderkey, l_partkey) AS c FROM lineitem)
SELECT l_orderkey, count(*) AS rows, CASE WHEN max(c) > 1 THEN 'duplicate_id' WHEN max(l_linenumber - coalesce(b, 0)) > 1 THEN 'gap' WHEN count(*) <> 4 THEN 'total_mismatch' ELSE 'ok' END AS fault FROM m GROUP BY 1""",
    "fair_queue": f"WITH {NOTICES}, c AS (SELECT *, CASE WHEN deadline >= DATE '2024-01-03' THEN 'future' ELSE 'backlog' END AS class FROM keyed) SELECT id, class, CAST(row_number() OVER (PARTITION BY class ORDER BY fetched_at, id) AS INTEGER) AS turn FROM c",
    "due_ids": f"WITH {NOTICES} SELECT id, CASE WHEN id % 4 <> 0 THEN fetched_at END AS tried_at FROM keyed ORDER BY CASE WHEN id % 4 <> 0 THEN fetched_at END NULLS FIRST, id LIMIT 50",
    "snapshot_changes": "SELECT event_id, event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS changed FROM events",
    "locale_set_diff": """WITH k AS (SELECT lang, source || '-' || doc_id % 41 AS key FROM documents), f AS (SELECT DISTINCT key FROM k WHERE lang = 'fr'), d AS (SELECT DISTINCT key FROM k WHERE lang = 'de')
SELECT key, 'left' AS side FROM (SELECT key FROM f EXCEPT SELECT key FROM d) UNION ALL SELECT key, 'right' FROM (SELECT key FROM d EXCEPT SELECT key FROM f)""",
    "enrichment_backlog": f"""WITH {NOTICES} SELECT source, count(*) AS scoped, count(*) FILTER (detail_status = 'verified') AS verified, count(*) FILTER (detail_status = 'verified' AND fresh) AS fresh,
  count(*) FILTER (detail_status = 'verified' AND NOT fresh) AS stale, count(*) FILTER (detail_status <> 'verified') AS pending FROM keyed GROUP BY 1""",
    "merged_locales": f"""WITH {NOTICES}, n AS (SELECT source || '-' || id % 23 AS source_key, lang AS locale, title, deadline, detail_status = 'verified' AS verified, id FROM keyed),
o AS (SELECT source_key, locale, arg_max(title, id) AS title, arg_max(struct_pack(d := deadline), id).d AS deadline, arg_max(verified, id) AS verified FROM n WHERE id % 2 = 0 GROUP BY 1, 2),
w AS (SELECT source_key, locale, arg_max(title, id) AS title, arg_max(struct_pack(d := deadline), id).d AS deadline, arg_max(verified, id) AS verified FROM n WHERE id % 2 = 1 GROUP BY 1, 2),
j AS (SELECT coalesce(o.source_key, w.source_key) AS source_key, coalesce(o.locale, w.locale) AS locale, coalesce(o.verified, false) AND NOT coalesce(w.verified, false) AS keep, o.title AS ot, o.deadline AS od, w.title AS wt, w.deadline AS wd FROM o FULL JOIN w ON o.source_key = w.source_key AND o.locale = w.locale),
r AS (SELECT source_key, locale, CASE WHEN keep THEN ot ELSE coalesce(wt, ot) END AS title, CASE WHEN keep THEN od ELSE coalesce(wd, od) END AS deadline, keep AND wt IS NOT NULL AS needs_refresh FROM j)
SELECT source_key, arg_min(title, (CASE WHEN locale = 'en' THEN 0 ELSE 1 END, locale)) AS title, CASE WHEN count(DISTINCT deadline) <= 1 THEN max(deadline) END AS deadline, count(DISTINCT deadline) > 1 AS deadline_conflict, string_agg(locale, ',' ORDER BY locale) AS locales, bool_or(needs_refresh) AS needs_refresh FROM r GROUP BY 1""",
    "text_chunks": "SELECT doc_id, CAST(ceil(length(text) / 1500) AS INTEGER) AS parts, CAST(k AS INTEGER) AS part, md5(substring(text, (k - 1) * 1500 + 1, 1500)) AS piece_md5 FROM (SELECT doc_id, text, unnest(generate_series(1, CAST(ceil(length(text) / 1500) AS BIGINT))) AS k FROM documents)",
}
