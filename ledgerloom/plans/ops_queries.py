"""Queries of stages, verdicts, locks, spend and event streams over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ledger, ops
from ..streaming import jobs
from .bindings import STAGES, pick, stages, table


def stage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.stage_rollup(stages(spark, sf_dir), "proposal_id")


def order_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stages(spark, sf_dir)
    rolled = ops.stage_rollup(s.where("status <> 'failed' or order_id % 2 = 0"), "proposal_id")
    return ops.order_rollup(rolled.withColumn("order_id", F.col("proposal_id") % 17))


def stage_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.ready_stages(stages(spark, sf_dir), "2024-01-30 00:00:00", "1 day").select("proposal_id", "seq")


def latest_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return ops.latest_per(e, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id")


def latest_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'view'")
    return ops.latest_per(e, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 3).select("user_id", "event_id", "rank")


def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.trailing_streak(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


def improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("score", F.when(F.col("event_type") != "error", F.col("value")))
    return ops.improvement(e, "user_id", ["ts", "event_id"], "score").select("event_id", "previous", "improved")


def loop_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.col("user_id").alias("proposal_id"), F.col("event_id").alias("attempt"), F.when(F.col("event_type") == "purchase", "pass").otherwise("hold").alias("verdict"), F.when(F.col("event_type") == "error", "infra").otherwise("quality").alias("hold_class"),
        F.round("value").cast("long").alias("score"), (F.col("event_id") % 5 != 0).alias("material"), ((F.col("event_id") % 10) / 10).alias("changed"), F.lit(1).alias("spend"), (F.col("event_id") % 11 == 0).cast("int").alias("unmeasured"),
    )
    return ops.loop_decision(rows, 60.0).select("attempt", "decision")


def sticky_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("doc", F.col("event_id") % 7)
    return ops.sticky_verdicts(e, ["user_id", "doc"], ["ts", "event_id"], "event_type", F.col("event_type") != "error").select("event_id", "stands", "role")


def lock_arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    claims = o.select(
        (F.col("o_orderkey") % 50).alias("grant_id"), F.col("o_orderkey").alias("claim_id"), (F.col("o_custkey") % 40).alias("org_id"), F.when(F.col("o_orderkey") % 19 == 0, F.lit("short")).otherwise(F.md5((F.col("o_custkey") % 25).cast("string"))).alias("fingerprint"),
        F.col("o_orderdate").alias("at"), (F.col("o_orderpriority") == "1-URGENT").alias("flagged"),
    )
    return ops.arbitrate(claims).select("claim_id", "outcome")


def live_compositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("grant_id"), F.md5((F.col("o_custkey") % 25).cast("string")).alias("fingerprint"), F.when(F.col("o_orderstatus") == "O", "live").otherwise("released").alias("state"))
    return ops.distinct_compositions(o)


def request_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("proposal_id"), (F.col("event_id") % 9).cast("string").alias("key"), F.col("event_type").alias("body"), F.col("ts").alias("at"), F.col("event_id").alias("request_id"))
    return ops.request_replay(e, 6).select("request_id", "outcome")


def usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.when(F.col("event_id") % 6 != 0, F.round(F.col("value") * 100).cast("long")).alias("usd"))
    return ops.usage(e, ["model"])


def cap_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    spent = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("used"))
    return spent.select("user_id", "used", ops.cap_level(F.when(F.col("user_id") % 10 != 0, F.col("used")), F.when(F.col("user_id") % 7 != 0, F.lit(400_000))).alias("level"))


def shared_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.md5(F.floor("c_acctbal").cast("string")).alias("fingerprint"), F.col("c_mktsegment").alias("service"))
    return ops.shared_credentials(c).withColumn("services", F.array_join("services", ","))


def critic_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("doc", F.concat_ws("-", (F.col("user_id") % 50).cast("string"), F.to_date("ts").cast("string")))
    return ops.combine_critics(e.withColumn("verdict", F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") != "signup", "ok")), "doc")


def gate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    score = lambda k: ((F.col("l_partkey") + k * F.col("l_suppkey")) % 5 + 1).cast("int")
    scores = F.create_map(*[x for k in range(1, 11) for x in (F.lit(str(k)), score(k))])
    out = F.create_map(F.lit("late"), F.col("l_returnflag") == "R", F.lit("unsourced"), F.col("l_discount") > 0.08)
    return items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", ops.gate_score(scores, out).alias("score"), F.array_join(ops.bar_failures(scores, out), ",").alias("failures"))


def gate_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "purchase", "pass").otherwise("hold").alias("decision"), F.get_json_object("props", "$.k").alias("doc_hash"))
    return ops.gate_progress(e, "user_id")


def judge_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("source").alias("model"), F.when(F.col("doc_id") % 12 != 0, F.when(F.col("n_chars") > 800, "pass").otherwise("hold")).alias("gate"), F.when(F.col("quality") == 1, "pass").otherwise("hold").alias("asserted"), (F.col("lang") == "es").alias("own_family"), (F.col("toxic") == 1).alias("disputed")
    )
    return ops.judge_agreement(rows, "model")


def kendall_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("x"), F.floor(F.col("o_totalprice") / 50000).cast("int").alias("y"))
    return ops.kendall_tau(o, "o_custkey", "x", "y").withColumn("tau", F.round("tau", 9))


def trip_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.alarms(table(spark, sf_dir, "events"), "user_id", F.col("event_type") == "error", 0.25)


def queue_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.date_trunc("second", "ts"))
    return ops.queue_ages(e.where("event_type = 'view'"), "user_id", "at", "2024-02-01 00:00:00").withColumn("mean_s", F.round("mean_s", 3))


def stranded_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "events").select(F.col("event_id").alias("claim_id"), F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("owner_id"), F.col("ts").alias("claimed_at"), F.when(F.col("event_type") == "purchase", "live").otherwise("done").alias("state"))
    owners = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("owner_id"))
    return ops.stranded_claims(claims, owners, "2024-01-20 00:00:00").select("claim_id")


def ungated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.ungated_orders(table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


def organisation_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    orgs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("org_id"), F.when(F.col("s_suppkey") % 3 != 0, (F.col("s_suppkey") % 60).cast("string")).alias("registration_no"), F.concat(F.lit("M"), (F.col("s_suppkey") % 45).cast("string"), F.lit("@X.org")).alias("email"))
    asked = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 90).cast("string").alias("registration_no"), F.concat(F.lit("m"), (F.col("c_custkey") % 70).cast("string"), F.lit("@x.org")).alias("email"))
    return ops.resolve_organisations(asked, orgs).select("c_custkey", "org_id")


def grant_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("title", F.substring_index("text", "\n", 1))
    known = d.where("lang = 'en'").select(F.col("source").alias("funder"), T.grant_title(F.col("title")).alias("title_normalized"), "doc_id").groupBy("funder", "title_normalized").agg(F.min("doc_id").alias("grant_id"))
    return ops.resolve_grants(d.select("doc_id", F.col("source").alias("funder"), "title"), known, T.grant_title(F.col("title"))).select("doc_id", "grant_id")


def unnotified_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stages(spark, sf_dir).select(F.col("seq").alias("stage_id"), "status", F.col("heartbeat").alias("finished_at"), F.when(F.col("seq") % 3 == 0, F.col("heartbeat")).alias("notified_at"))
    return ops.unnotified(s).select("stage_id", "status", "finished_at")


def composition_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    applicants = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("grant_id"), F.col("c_custkey").alias("applicant_id"))
    axes = table(spark, sf_dir, "nation").select(F.concat(F.lit("axis"), (F.col("n_nationkey") % 5).cast("string")).alias("axis"), F.col("n_name").alias("code"))
    return ledger.draw_compositions(applicants, axes)


def sufficiency_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_type") == "view").alias("dated"), (F.col("event_id") % 3 == 0).alias("compound"), (F.col("event_type") == "click").alias("activity"), (F.col("value") > 9).alias("documented"))
    return ledger.specificity(e, "user_id")


def slot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.slots(table(spark, sf_dir, "events"), "user_id", "event_type", ["view", "click", "purchase", "signup", "error"])


def token_consumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    token = F.md5(F.col("event_id").cast("string"))
    asked = e.select("event_id", F.when(F.col("event_id") % 20 != 0, F.when(F.col("event_id") % 21 != 0, token).otherwise("x")).alias("token"), F.col("event_type").alias("fingerprint"))
    known = e.where("event_type <> 'signup'").select(token.alias("token"), (F.col("event_id") % 6 != 0).alias("cleared"), F.when(F.col("event_id") % 8 != 0, F.col("event_type")).otherwise("other").alias("fingerprint"), (F.col("event_id") % 10 == 0).alias("used"), F.col("ts").alias("issued_at"))
    return ledger.consume_tokens(asked, known, "2024-01-20 03:00:00").select("event_id", "outcome")


def intake_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner_id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 5 == 0, "TBD").otherwise(F.col("c_mktsegment")).alias("sector"), F.when(F.col("c_nationkey") == 0, "0000").otherwise(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("country"))
    return ledger.intake_items(c, [("name", "Organisation name"), ("sector", "Sector"), ("country", "Country")])


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", ledger.axes_fingerprint(F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))).alias("fingerprint"))


def fulfilment_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders for documents as grants, under names of several makes."""
    k = F.col("doc_id")
    name = F.concat(pick(k, "", "www.", "Trust of ", "", "x@"), F.substring_index("text", " ", 1), pick(k % 7, "", " ", "", " e.V."))
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(k % 11 == 0, F.repeat(F.substring("source", 1, 1), 5)).when(k % 13 == 0, "Placeholder").otherwise(name).alias("org_name"), F.col("text").alias("grant_text"), (k % 4 == 0).alias("grant_ok"), F.date_add(F.lit("2023-12-20").cast("date"), (k % 30).cast("int")).alias("deadline"), pick(k, "standard", "full", "trial").alias("tier"))
    return d.select("doc_id", F.array_join(ledger.fulfilment_blockers("2024-01-03"), ",").alias("blockers"))


def rate_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.fixed_windows(table(spark, sf_dir, "events"), "user_id", 2)


def rate_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.anchored_windows(table(spark, sf_dir, "events"), 2, "6 hours")


def alarm_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.sliding_rates(table(spark, sf_dir, "events"), "error")


def dedupe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return jobs.first_sight(e.unionByName(e.where("value > 5")), ["event_id"])


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.sessions(table(spark, sf_dir, "events"), "user_id", "2 hours")


def silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.silences(table(spark, sf_dir, "events"), "event_type", "3 minutes")


def invoice_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("invoice_id", F.concat_ws("-", F.col("user_id").cast("string"), F.get_json_object("props", "$.k")))
    return jobs.settle_invoices(e.withColumn("event_type", F.when(F.col("event_type") == "purchase", "paid").when(F.col("event_type") == "error", "reversed").otherwise("seen")))


def hold_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    holds = e.where("event_type = 'signup'").select(F.col("event_id").alias("hold_id"), "ts", "user_id")
    confirmed = e.where("event_type = 'purchase'").select("user_id", "ts")
    firsts = holds.select("hold_id", "user_id", F.col("ts").alias("_h")).join(confirmed, "user_id").where("ts >= _h").groupBy("hold_id").agg(F.min("ts").alias("ts"))
    return jobs.expired_holds(holds.select("hold_id", "ts"), firsts)


def stale_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As each user turns fresh and stale, with a life of 6 hours, up to a time."""
    return jobs.fresh_spans(table(spark, sf_dir, "events"), "user_id", "6 hours", "2024-01-20 12:00:00").select(F.col("key").cast("long").alias("user_id"), "nth", "last", "at", "fresh")


def beat_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events as beats of one piece of work that has three attempts."""
    return jobs.attempts(table(spark, sf_dir, "events"), "user_id", 3, "12 hours").select(F.col("key").cast("long").alias("user_id"), "attempt", "last_ts", "stale_at", "status")


def invoice_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as invoices and errors as reversals of a user's day."""
    e = table(spark, sf_dir, "events").withColumn("invoice_id", F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")))
    first = lambda kind: e.where(F.col("event_type") == kind).groupBy("invoice_id").agg(F.min("ts").alias("ts"))
    return jobs.settlements(first("purchase"), first("error"), "6 hours")


def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.freshness(table(spark, sf_dir, "events"), "user_id", "ts", "2024-01-30 12:00:00")


QUERIES = {f.__name__: f for f in (
    stage_rollup, order_rollup, stage_ready, latest_hold, latest_uploads, streaks, improvement, loop_decision, sticky_verdict, lock_arbitration, live_compositions, request_replay, usage_by_model, cap_levels, shared_credentials, critic_verdicts, gate_scores, gate_progress,
    judge_agreement, kendall_tau, trip_alarms, queue_ages, stranded_claims, ungated_orders, organisation_resolution, grant_resolution, unnotified_stages, composition_draw, sufficiency_score, slot_counts, token_consumption, intake_ledger, fingerprints, fulfilment_blockers,
    rate_tumbling, rate_anchored, alarm_sliding, dedupe_events, sessions, silences, invoice_settlement, hold_expiry, freshness, stale_changes, beat_attempts, invoice_states,
)}

_ROLL = "CASE WHEN bool_and(status = 'done') THEN 'complete' WHEN bool_or(status IN ('failed', 'held')) THEN 'attention' ELSE 'processing' END"
_CLAIMS = """c AS (SELECT o_orderkey % 50 AS grant_id, o_orderkey AS claim_id, o_custkey % 40 AS org_id, CASE WHEN o_orderkey % 19 = 0 THEN 'short' ELSE md5(CAST(o_custkey % 25 AS VARCHAR)) END AS fingerprint, o_orderdate AS at_, o_orderpriority = '1-URGENT' AS flagged FROM orders)"""
_SESSION = """m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL {gap} THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY {key} ORDER BY ts)), g AS (SELECT *, sum(b) OVER (PARTITION BY {key} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)"""

ORACLES = {
    "stage_rollup": f"WITH {STAGES} SELECT proposal_id, count(*) AS n, {_ROLL} AS state FROM stages GROUP BY 1",
    "order_rollup": f"""WITH {STAGES}, p AS (SELECT proposal_id, {_ROLL} AS state FROM stages WHERE status <> 'failed' OR order_id % 2 = 0 GROUP BY 1)
SELECT proposal_id % 17 AS order_id, CASE WHEN bool_and(state = 'complete') THEN 'complete' WHEN bool_or(state = 'attention') THEN 'attention' ELSE 'processing' END AS state FROM p GROUP BY 1""",
    "stage_ready": f"""WITH {STAGES}, f AS (SELECT *, min(CASE WHEN status <> 'done' THEN seq END) OVER (PARTITION BY proposal_id) AS first, max(CASE WHEN status = 'running' AND heartbeat > TIMESTAMP '2024-01-29' THEN 1 ELSE 0 END) OVER (PARTITION BY proposal_id) AS live FROM stages)
SELECT proposal_id, seq FROM f WHERE status = 'queued' AND seq = first AND live = 0""",
    "latest_hold": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'error') WHERE n = 1",
    "latest_uploads": "SELECT user_id, event_id, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'view') WHERE n <= 3",
    "streaks": """WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS last_type FROM events),
b AS (SELECT user_id, min(n) FILTER (event_type <> last_type) AS stop, count(*) AS total, any_value(last_type) AS event_type FROM l GROUP BY 1) SELECT user_id, event_type, coalesce(stop - 1, total) AS streak FROM b""",
    "improvement": """WITH s AS (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS score FROM events), p AS (SELECT *, last_value(score IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM s)
SELECT event_id, previous, score > previous AS improved FROM p""",
    "loop_decision": """WITH a AS (SELECT user_id AS p, event_id AS attempt, event_type = 'purchase' AS pass, event_type = 'error' AS infra, CAST(round(value) AS BIGINT) AS score, event_id % 5 <> 0 AS material, (event_id % 10) / 10 AS changed, event_id % 11 = 0 AS um FROM events),
b AS (SELECT *, count(*) OVER w AS spent, sum(um::INT) OVER w AS unmeasured, sum((NOT infra)::INT) OVER w AS island, count(*) FILTER (NOT pass AND NOT infra) OVER (PARTITION BY p ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS regens,
  last_value(CASE WHEN NOT pass AND NOT infra THEN score END IGNORE NULLS) OVER (PARTITION BY p ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM a WINDOW w AS (PARTITION BY p ORDER BY attempt ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, sum(infra::INT) OVER (PARTITION BY p, island ORDER BY attempt ROWS UNBOUNDED PRECEDING) AS streak FROM b)
SELECT attempt, CASE WHEN pass THEN 'deliver' WHEN spent + 60.0 / 3 > 60 THEN 'hold' WHEN unmeasured > 4 THEN 'hold' WHEN infra THEN CASE WHEN streak < 3 THEN 'retry' ELSE 'hold' END
  WHEN NOT material OR changed < 0.2 THEN 'refund' WHEN score <= previous THEN 'refund' WHEN regens + 1 > 2 THEN 'refund' ELSE 'regenerate' END AS decision FROM c""",
    "sticky_verdict": """WITH f AS (SELECT *, first_value(CASE WHEN event_type <> 'error' THEN event_id END IGNORE NULLS) OVER w AS fid, first_value(CASE WHEN event_type <> 'error' THEN event_type END IGNORE NULLS) OVER w AS stands FROM events WINDOW w AS (PARTITION BY user_id, event_id % 7 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, stands, CASE WHEN fid IS NULL THEN 'open' WHEN fid = event_id THEN 'first' WHEN event_type = stands THEN 'replayed' ELSE 'superseded' END AS role FROM f""",
    "lock_arbitration": f"""WITH {_CLAIMS}, s AS (SELECT *, NOT flagged AND length(fingerprint) >= 16 AS sound FROM c), o AS (SELECT *, sound AND row_number() OVER (PARTITION BY grant_id, org_id, sound ORDER BY at_, claim_id) = 1 AS org FROM s),
p AS (SELECT *, org AND row_number() OVER (PARTITION BY grant_id, fingerprint, org ORDER BY at_, claim_id) = 1 AS print FROM o)
SELECT claim_id, CASE WHEN flagged THEN 'sanctions_screening' WHEN NOT sound THEN 'malformed_fingerprint' WHEN NOT org THEN 'existing_claim_same_org' WHEN NOT print THEN 'fingerprint_taken' ELSE 'granted' END AS outcome FROM p""",
    "live_compositions": "SELECT o_orderkey % 50 AS grant_id, count(*) AS live, count(DISTINCT o_custkey % 25) AS fingerprints, count(*) - count(DISTINCT o_custkey % 25) AS collisions FROM orders WHERE o_orderstatus = 'O' GROUP BY 1",
    "request_replay": """WITH r AS (SELECT *, row_number() OVER w AS n, first_value(event_type) OVER w AS body FROM events WINDOW w AS (PARTITION BY user_id, event_id % 9 ORDER BY ts, event_id)), k AS (SELECT *, sum((n = 1)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS number FROM r)
SELECT event_id AS request_id, CASE WHEN n > 1 AND event_type <> body THEN 'request_conflict' WHEN n > 1 THEN 'replayed' WHEN number > 6 THEN 'no_revisions_left' ELSE 'accepted' END AS outcome FROM k""",
    "usage_by_model": "SELECT event_type AS model, count(*) AS calls, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens, CAST(sum(CASE WHEN event_id % 6 <> 0 THEN CAST(round(value * 100) AS BIGINT) END) AS BIGINT) AS usd, count(*) FILTER (event_id % 6 = 0) AS unpriced_calls FROM events GROUP BY 1",
    "cap_levels": """WITH s AS (SELECT user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS used FROM events GROUP BY 1)
SELECT user_id, used, CASE WHEN user_id % 10 = 0 THEN 'unknown' WHEN user_id % 7 = 0 THEN 'unmetered' WHEN used >= 400000 THEN 'exhausted' WHEN used >= 400000 * 0.9 THEN 'critical' WHEN used >= 400000 * 0.75 THEN 'warn' ELSE 'ok' END AS level FROM s""",
    "shared_credentials": "SELECT md5(CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR)) AS fingerprint, count(*) AS uses, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS services FROM customer GROUP BY 1 HAVING count(*) > 1",
    "critic_verdicts": """WITH d AS (SELECT (user_id % 50) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS doc, CASE WHEN event_type = 'error' THEN 'fail' WHEN event_type <> 'signup' THEN 'ok' END AS v FROM events)
SELECT doc, count(*) AS critics, count(v) AS verdicts, CASE WHEN bool_or(coalesce(v = 'fail', false)) THEN 'hold' WHEN count(v) < count(*) OR count(v) < 2 THEN 'unavailable' ELSE 'pass' END AS verdict FROM d GROUP BY 1""",
    "gate_scores": """WITH s AS (SELECT *, list_transform(range(1, 11), lambda k: (l_partkey + k * l_suppkey) % 5 + 1) AS sc FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(list_sum(sc) - 10 * ((l_returnflag = 'R')::INT + (l_discount > 0.08)::INT) AS INTEGER) AS score,
  array_to_string(list_sort(list_concat(list_transform(list_filter(range(1, 11), lambda k: sc[k] < 3 OR (k IN (1, 3, 6, 10) AND sc[k] < 4)), lambda k: 'score ' || k), CASE WHEN l_returnflag = 'R' THEN ['disqualifier late'] ELSE [] END, CASE WHEN l_discount > 0.08 THEN ['disqualifier unsourced'] ELSE [] END)), ',') AS failures FROM s""",
    "gate_progress": "SELECT user_id, count(*) AS verdicts, count(*) FILTER (event_type <> 'purchase') AS holds, bool_or(event_type = 'purchase') AS passed, count(DISTINCT json_extract_string(props, '$.k')) AS documents FROM events GROUP BY 1",
    "judge_agreement": """WITH r AS (SELECT source AS model, CASE WHEN doc_id % 12 <> 0 THEN CASE WHEN n_chars > 800 THEN 'pass' ELSE 'hold' END END AS gate, CASE WHEN quality = 1 THEN 'pass' ELSE 'hold' END AS asserted, lang <> 'es' AND toxic <> 1 AS counts FROM labels JOIN documents USING (doc_id))
SELECT model, count(*) FILTER (counts AND gate IS NOT NULL) AS judged, count(*) FILTER (counts AND gate IS NULL) AS missing, count(*) FILTER (counts AND gate = asserted) AS agree, count(*) FILTER (counts AND gate = 'pass' AND asserted = 'hold') AS false_pass,
  count(*) FILTER (counts AND gate = 'hold' AND asserted = 'pass') AS false_hold, count(*) FILTER (counts AND gate IS NOT NULL AND asserted = 'hold') AS baseline, CASE WHEN count(*) FILTER (counts AND gate IS NOT NULL) > 0 THEN count(*) FILTER (counts AND gate = asserted) / count(*) FILTER (counts AND gate IS NOT NULL) END AS agree_rate FROM r GROUP BY 1""",
    "kendall_tau": """WITH o AS (SELECT o_custkey, o_orderkey, CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS x, CAST(floor(o_totalprice / 50000) AS INTEGER) AS y FROM orders),
p AS (SELECT a.o_custkey, CAST(sign(a.x - b.x) AS DOUBLE) AS dx, CAST(sign(a.y - b.y) AS DOUBLE) AS dy FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey)
SELECT o_custkey, count(*) AS pairs, CASE WHEN sum(abs(dx)) > 0 AND sum(abs(dy)) > 0 THEN round(sum(dx * dy) / sqrt(sum(abs(dx)) * sum(abs(dy))), 9) END AS tau FROM p GROUP BY 1""",
    "trip_alarms": "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') / count(*) AS rate, count(*) FILTER (event_type = 'error') / count(*) > 0.25 AS alarm FROM events GROUP BY 1",
    "queue_ages": "WITH a AS (SELECT user_id, 1706745600 - CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS age FROM events WHERE event_type = 'view') SELECT user_id, count(*) AS waiting, max(age) AS oldest_s, round(avg(age), 3) AS mean_s FROM a GROUP BY 1",
    "stranded_claims": "SELECT event_id AS claim_id FROM events WHERE event_type = 'purchase' AND ((event_id % 4 <> 0 AND user_id NOT IN (SELECT s_suppkey FROM supplier)) OR (event_id % 4 = 0 AND ts < TIMESTAMP '2024-01-19 23:58:00'))",
    "ungated_orders": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')",
    "organisation_resolution": """WITH n AS (SELECT CAST(s_suppkey % 60 AS VARCHAR) AS r, min(s_suppkey) AS id FROM supplier WHERE s_suppkey % 3 <> 0 GROUP BY 1), m AS (SELECT s_suppkey % 45 AS e, min(s_suppkey) AS id FROM supplier GROUP BY 1)
SELECT c_custkey, coalesce(n.id, m.id) AS org_id FROM customer LEFT JOIN n ON n.r = CAST(c_custkey % 90 AS VARCHAR) LEFT JOIN m ON m.e = c_custkey % 70""",
    "grant_resolution": """WITH d AS (SELECT doc_id, source AS funder, lang, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9 ]', '', 'g'), ' ') AS t FROM documents), k AS (SELECT funder, t, min(doc_id) AS grant_id FROM d WHERE lang = 'en' GROUP BY 1, 2)
SELECT d.doc_id, k.grant_id FROM d LEFT JOIN k ON d.funder = k.funder AND d.t = k.t""",
    "unnotified_stages": f"WITH {STAGES} SELECT seq AS stage_id, status, heartbeat AS finished_at FROM stages WHERE status IN ('done', 'failed', 'held') AND seq % 3 <> 0 ORDER BY heartbeat, seq LIMIT 10",
    "sufficiency_score": """SELECT user_id, sum(least(3.0, 1 + CASE WHEN event_type = 'view' THEN 0.75 ELSE 0 END + CASE WHEN event_id % 3 = 0 THEN 0.5 ELSE 0 END + CASE WHEN event_type = 'click' THEN 0.5 ELSE 0 END + CASE WHEN value > 9 THEN 1 ELSE 0 END))::DOUBLE AS score, count(*) AS referents FROM events GROUP BY 1""",
    "slot_counts": "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{x}') AS {x if x != 'view' else chr(34) + 'view' + chr(34)}" for x in ("view", "click", "purchase", "signup", "error")) + " FROM events GROUP BY 1",
    "token_consumption": """SELECT event_id, CASE WHEN event_id % 20 = 0 OR event_id % 21 = 0 THEN 'token_absent' WHEN event_type = 'signup' THEN 'token_unknown' WHEN event_id % 6 = 0 THEN 'not_cleared' WHEN event_id % 8 = 0 THEN 'fingerprint_mismatch' WHEN event_id % 10 = 0 THEN 'token_already_used'
  WHEN ts < TIMESTAMP '2024-01-19 21:00:00' THEN 'token_expired' ELSE 'consumed' END AS outcome FROM events""",
    "intake_ledger": """WITH a AS (SELECT c_custkey AS owner_id, list_filter(['Organisation name: ' || c_name, CASE WHEN c_custkey % 5 <> 0 THEN 'Sector: ' || c_mktsegment END, CASE WHEN c_nationkey <> 0 THEN 'Country: n' || c_nationkey END], lambda x: x IS NOT NULL) AS l FROM customer)
SELECT owner_id, 'E-INTAKE-' || k AS item_id, l[k] AS claim FROM (SELECT owner_id, l, unnest(range(1, len(l) + 1)) AS k FROM a)""",
    "fingerprints": "SELECT c_custkey, sha256('nation=' || c_nationkey || ';segment=' || c_mktsegment) AS fingerprint FROM customer",
    "fulfilment_blockers": r"""WITH d AS (SELECT *, trim(regexp_replace(regexp_replace(CASE WHEN doc_id % 11 = 0 THEN repeat(substring(source, 1, 1), 5) WHEN doc_id % 13 = 0 THEN 'Placeholder' ELSE (['', 'www.', 'Trust of ', '', 'x@'])[doc_id % 5 + 1] || string_split(text, ' ')[1] || (['', ' ', '', ' e.V.'])[doc_id % 7 % 4 + 1] END, '[\x00-\x1F\x7F]', ' ', 'g'), ' +', ' ', 'g'), ' ') AS n, DATE '2023-12-20' + CAST(doc_id % 30 AS INTEGER) AS deadline FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 3 = 2 THEN 'tier_unavailable' END, CASE WHEN length(n) < 4 THEN 'org_too_short' WHEN regexp_matches(n, '(?i)^(test|testing|asdf+|demo|sample|example|abc+|xyz+|xxx+|qwerty|none|null|n/?a|foo|bar|placeholder|org|organisation|organization|company|tbd|todo)$') OR (length(n) > 3 AND replace(n, n[1], '') = '') OR NOT regexp_matches(n, '(?i)[aeiouyà-ÿ]') THEN 'org_placeholder'
    WHEN regexp_matches(n, '(?i)^(https?://|www\.)') OR contains(n, '@') THEN 'org_looks_like_address' END,
  CASE WHEN doc_id % 4 <> 0 AND length(trim(text, ' ')) < 600 THEN 'grant_unreadable' END, CASE WHEN deadline < DATE '2024-01-03' THEN 'deadline_passed' END) AS blockers FROM d""",
    "rate_tumbling": "SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS hits, count(*) <= 2 AS allowed FROM events GROUP BY 1, 2",
    "rate_anchored": """WITH RECURSIVE e AS (SELECT user_id, event_type AS action, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS n FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL),
w AS (SELECT user_id, action, ts, n, ts AS begun, 1 AS hits FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.action, e.ts, e.n, CASE WHEN e.ts >= w.begun + INTERVAL 6 HOUR THEN e.ts ELSE w.begun END, CASE WHEN e.ts >= w.begun + INTERVAL 6 HOUR THEN 1 ELSE w.hits + 1 END
  FROM w JOIN e ON e.user_id = w.user_id AND e.action = w.action AND e.n = w.n + 1) SELECT user_id, action, ts, CAST(hits AS BIGINT) AS hits, hits <= 2 AS allowed FROM w""",
    "alarm_sliding": """WITH w AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * k) AS window_start, event_type FROM events, range(0, 4) t(k))
SELECT window_start, count(*) AS n, count(*) FILTER (event_type = 'error') AS hits, count(*) FILTER (event_type = 'error') / count(*) AS rate FROM w GROUP BY 1""",
    "dedupe_events": "SELECT * FROM events",
    "sessions": f"WITH {_SESSION.format(gap='2 HOUR', key='user_id')} SELECT user_id, min(ts) AS started, max(ts) AS last_ts, count(*) AS events FROM g GROUP BY user_id, k",
    "silences": f"WITH {_SESSION.format(gap='3 MINUTE', key='event_type')} SELECT event_type, max(ts) AS last_ts, max(ts) + INTERVAL 3 MINUTE AS stale_at, count(*) AS beats FROM g GROUP BY event_type, k",
    "invoice_settlement": """SELECT user_id || '-' || json_extract_string(props, '$.k') AS invoice_id, min(ts) FILTER (event_type = 'purchase') AS paid_at, min(ts) FILTER (event_type = 'error') AS reversed_at,
  CASE WHEN min(ts) FILTER (event_type = 'error') IS NOT NULL THEN 'void' WHEN min(ts) FILTER (event_type = 'purchase') IS NOT NULL THEN 'settled' ELSE 'open' END AS state FROM events GROUP BY 1""",
    "hold_expiry": """WITH f AS (SELECT h.event_id AS hold_id, any_value(h.ts) AS held_at, min(p.ts) AS t FROM events h LEFT JOIN events p ON p.user_id = h.user_id AND p.event_type = 'purchase' AND p.ts >= h.ts WHERE h.event_type = 'signup' GROUP BY 1)
SELECT hold_id, held_at, CASE WHEN t <= held_at + INTERVAL 6 HOUR THEN t END AS confirmed_at, CASE WHEN t <= held_at + INTERVAL 6 HOUR THEN 'confirmed' ELSE 'expired' END AS state FROM f""",
    "stale_changes": """WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events WHERE ts <= TIMESTAMP '2024-01-20 12:00:00'), s AS (SELECT user_id, ts, sum(CASE WHEN b IS NULL OR ts > b + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS nth FROM e),
g AS (SELECT user_id, CAST(nth AS BIGINT) AS nth, min(ts) AS first, max(ts) AS last FROM s GROUP BY 1, 2)
SELECT user_id, nth, first AS last, first AS at, true AS fresh FROM g UNION ALL SELECT user_id, nth, last, last + INTERVAL 6 HOUR, false FROM g WHERE last + INTERVAL 6 HOUR < TIMESTAMP '2024-01-20 12:00:00'""",
    "beat_attempts": """WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events), s AS (SELECT user_id, ts, sum(CASE WHEN b IS NULL OR ts > b + INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS nth FROM e)
SELECT user_id, CAST(nth AS BIGINT) AS attempt, max(ts) AS last_ts, max(ts) + INTERVAL 12 HOUR AS stale_at, CASE WHEN nth >= 3 THEN 'failed' ELSE 'pending' END AS status FROM s WHERE nth <= 3 GROUP BY user_id, nth""",
    "invoice_states": """WITH e AS (SELECT *, user_id || '-' || strftime(ts, '%Y%m%d') AS id FROM events), p AS (SELECT id, min(ts) AS t FROM e WHERE event_type = 'purchase' GROUP BY 1), r AS (SELECT id, min(ts) AS t FROM e WHERE event_type = 'error' GROUP BY 1)
SELECT coalesce(p.id, r.id) AS invoice_id, p.t AS paid_at, r.t AS reversed_at, CASE WHEN p.t IS NULL THEN 'reversed' WHEN r.t IS NULL THEN 'settled' ELSE 'void' END AS state FROM p FULL JOIN r ON p.id = r.id AND r.t BETWEEN p.t - INTERVAL 6 HOUR AND p.t + INTERVAL 6 HOUR""",
    "freshness": "SELECT user_id, max(ts) AS last, max(ts) > TIMESTAMP '2024-01-29 12:00:00' AS fresh FROM events GROUP BY 1",
}
