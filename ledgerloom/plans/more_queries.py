"""Further queries of qualification, evidence, alerts and ledgers over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalogue, ledger, matching, ops, qualify, textaudit, webcurate
from .bindings import AS_OF, notices, pick, table
from .catalogue_queries import ORACLES as CATALOGUE
from .catalogue_queries import candidate_tables


def _evidence(n):
    """Evidence of a document: its place, its status, and its text."""
    item = lambda label, text: F.struct(F.lit(label).alias("label"), text.alias("text"), F.lit("u").alias("url"))
    return F.array(item("Country", pick(n, "Lebanon", "France", "Worldwide", "GB and FR", "none")), item("Status", pick(n, "Open", "Closed", "", "Awarded")), item("Description", F.col("text")), item("Reference", F.col("source")))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.withColumn("evidence", _evidence(F.col("doc_id")))


def newest_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.newest_candidates(*candidate_tables(spark, sf_dir)).select("user_id", "opportunity_id", "fetched_at")


def application_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("doc_id", qualify.application_status(F.col("evidence")).alias("status"))


def geographies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of documents as notices of four publishers, of which one names countries; every fifth states a place itself."""
    n = F.col("doc_id")
    label = F.lit("Beneficiary countries or territories")
    item = F.struct(label.alias("label"), F.concat_ws(", ", pick(n % 7, "Jordan", "Lebanon", "Syria"), pick(n % 11, "Lebanon", "Iraq", "", "Egypt")).alias("text"), F.lit("u").alias("url"))
    origin = F.struct(F.lit("Applicant origin").alias("label"), pick(n % 13, "Any Arab country", "Europe").alias("text"), F.lit("u").alias("url"))
    stated = F.when(n % 5 == 0, F.struct(pick(n, "outside_lebanon", "unknown", "lebanon_confirmed").alias("status"), F.when(n % 2 == 0, F.array(F.when(n % 4 == 0, item).otherwise(origin.withField("url", F.lit("v"))))).otherwise(F.array().cast("array<struct<label:string,text:string,url:string>>")).alias("evidence")))
    d = table(spark, sf_dir, "documents").select("doc_id", qualify.geography(pick(n, "ppa", "ungm", "mawred", "eeas"), stated, F.array(item, origin), F.lit("p")).alias("g"))
    return d.select("doc_id", F.col("g.status").alias("geography"), F.col("g.error").alias("error"), F.to_json("g.evidence").alias("evidence"))


def country_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of the evidence's places, with a gazetteer of the places that it names."""
    places = _rows(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(a).alias("code"), F.lit(b).alias("alpha3"), F.lit(c).alias("name")) for a, b, c in (("LB", "LBN", "Lebanon"), ("FR", "FRA", "France"), ("GB", "GBR", "United Kingdom"))])).alias("g")).select("g.*").distinct()
    found = catalogue.extract_countries(_rows(spark, sf_dir).select(F.col("doc_id").alias("id"), "evidence"), places)
    return found.select("id", F.array_join("country_codes", ",").alias("codes"), "scope")


def notice_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", qualify.notice_kind(F.concat(pick(F.col("p_size"), "Request for quotation ", "Invitation to bid: ", "", "Expression of interest", "A request for proposal "), pick(F.col("p_partkey"), "Grant support-call for proposal", "invitation to tender", "p"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type")))).alias("kind"))


def call_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    text = F.concat(pick(F.col("doc_id"), "The call is closed. ", "Deadline: 7 May 2026. ", ""), F.col("text"))
    return d.select("doc_id", catalogue.call_statements(text).alias("c")).select("doc_id", "c.closed", "c.deadline_text")


def selected_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = _rows(spark, sf_dir).select("doc_id", matching.select_evidence(F.col("evidence"), F.col("source"), "status|descr", "reference").alias("e"))
    blocked = matching.bounded_payload(F.to_json("e.items"), F.col("e.incomplete"), 1200)
    return picked.select("doc_id", F.size("e.items").alias("items"), F.element_at(F.col("e.items"), 1).label.alias("first_label"), "e.incomplete", (blocked.isNotNull()).alias("blocked"))


def standing_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notices(spark, sf_dir).select((F.col("id") % 97).alias("user_id"), F.col("id").alias("opportunity_id"), "content_hash", F.col("source").alias("group_version"), (F.col("id") % 3).alias("revision"))
    labels = table(spark, sf_dir, "labels")
    matches = n.join(labels, F.col("opportunity_id") == F.col("doc_id")).where("quality = 1")
    profiles = n.select("user_id").distinct().withColumn("revision", F.col("user_id") % 3)
    return matching.standing_alerts(n, n.where("opportunity_id % 10 <> 0"), matches, profiles).select("user_id", "opportunity_id")


def enriched_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = notices(spark, sf_dir).select((F.col("id") % 97).alias("user_id"), F.col("id").alias("opportunity_id"), F.col("source").alias("group_version"))
    matches = board.select("user_id", "opportunity_id", (F.col("opportunity_id") % 101).alias("fit"), F.lit(1).alias("confidence"), F.when(F.col("opportunity_id") % 4 != 0, F.col("group_version")).otherwise("old").alias("group_version"))
    paid = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), F.when(F.col("s_acctbal") > 0, "active").otherwise("ended").alias("state"), F.timestamp_seconds(F.lit(1704067200) + F.col("s_suppkey") * 86400).alias("paid_until"))
    return matching.enrich(board, matches, paid, AS_OF).select("user_id", "opportunity_id", "fit", "confidence")


def unsaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notices(spark, sf_dir)
    groups = n.select(F.col("id").alias("opportunity_id"), catalogue.group_key().alias("group_key"))
    saved = n.select((F.col("id") % 5).alias("user_id"), F.col("id").alias("opportunity_id"))
    return matching.unsave(saved, groups, saved.where("opportunity_id % 7 = 0"))


def reconciled_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderstatus") == "O", "reserved").when(F.col("o_orderstatus") == "P", "revoked").otherwise("spent").alias("state"), (F.col("o_orderkey") % 2 == 0).alias("resolved"), F.col("o_orderdate").alias("created_at"), "o_orderkey")
    return matching.reconcile(o, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")).select("o_orderkey", "c_name")


def paid_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_shipdate").alias("period_start"), F.date_add("l_shipdate", 30).alias("period_end"))).alias("lines"))
    o = table(spark, sf_dir, "orders").join(i, "o_orderkey").select(F.col("o_custkey").alias("subscription_id"), F.col("o_orderkey").alias("invoice_id"), "lines", F.when(F.col("o_orderstatus") != "P", "paid").otherwise("open").alias("status"))
    return matching.paid_cycles(o)


def gate_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("proposal_id")).agg(F.collect_set("event_type").alias("findings"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("proposal_id"), "o_orderkey")
    return ops.gate_outcomes(verdicts, orders).select("proposal_id", "o_orderkey", "n_findings")


def missing_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with each of their first words as headings, against four headings that are asked for."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("## 1. The "), "source", F.lit(": *aims*\n# "), F.substring_index("text", " ", 2), F.lit("\n"), "text").alias("text"))
    asked = F.explode(F.array(F.lit("SRC1 aims"), F.lit("the"), F.lit("Ölé ñ"), F.lit("…"), F.lit("  "), F.lit("é!")))
    return textaudit.missing_headings(d, d.select("doc_id", asked.alias("heading")), "doc_id")


REQUIREMENTS = ["Submit the form online", "Explain the need", "Read the guidance notes", "must explain how the portal serves refugees by the deadline of year two"]


def missing_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.floor(F.col("doc_id") / 6)
    c = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 2 == 0).alias("mandatory"), F.when(F.col("doc_id") % 3 == 0, "missing").otherwise("met").alias("status"), pick(n, *REQUIREMENTS).alias("text"))
    return textaudit.missing_mandatory(c).select("doc_id", "text")


def identity_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 5).alias("name"), pick(F.col("doc_id"), "1163553", "0000", "tbd", "7777").alias("number"))
    return d.select("doc_id", F.array_join(ledger.identity_flags(F.col("name"), F.col("number")), ",").alias("flags"))


def sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(ledger.sanitise(F.concat(F.lit(" \x01"), F.col("text")), 2000)).alias("md5"))


def merged_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("owner_id"), F.col("event_id").cast("string").alias("item_id"), (F.col("event_id") % 5).cast("string").alias("fact_key"), F.col("event_type").alias("claim"))
    parts = {"intake": e.where("claim = 'purchase'"), "upload": e.where("claim = 'signup'"), "website": e.where("claim not in ('purchase', 'signup')")}
    return ledger.merge_ledgers(parts).select("owner_id", "item_id", "preferred", "conflict")


def distinct_referents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("owner"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" "), "p_type")).alias("name"))
    return ledger.distinct_referents(p, "owner")


def budget_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("quantity"), F.round("l_extendedprice").cast("long").alias("unit_cost"))
    envelope = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.round(F.col("o_totalprice") * 20).cast("long").alias("envelope"))
    return textaudit.budget_totals(lines, "l_orderkey", envelope)


def reserved_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.round(F.col("value") * 100).cast("long").alias("reserved"))
    return matching.reserved_total(e, ["user_id"], 500_000)


def starved_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", pick(F.col("page_id"), "succeeded", "js_only", "blocked_bot", "nothing_relevant").alias("outcome"), (F.col("page_id") % 6).alias("referents"))
    return p.select("page_id", webcurate.starved(F.col("outcome"), F.col("referents"), 3).alias("starved"))


def ledger_referents(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("claim"))
    return textaudit.ledger_referents(b, b.select("item_id", F.substring_index("claim", " ", 1).alias("name")), "item_id")


def site_referents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(T.host(F.col("url")).alias("site"), T.strip_tags(F.col("html")).alias("text"))
    return textaudit.site_referents(p, p.select("site", F.split("site", r"\.")[0].alias("name")), "site", "text")


QUERIES = {f.__name__: f for f in (
    newest_candidates, application_statuses, geographies, country_codes, notice_kinds, call_ends, selected_evidence, standing_alerts, enriched_board, unsaved, reconciled_credits, paid_cycles, gate_outcomes, missing_headings, missing_requirements, identity_flags, sanitised,
    merged_ledger, distinct_referents, budget_totals, reserved_totals, starved_documents, ledger_referents, site_referents,
)}

ORACLES = {
    "newest_candidates": f"WITH c AS ({CATALOGUE['candidates']}) SELECT user_id, opportunity_id, p_retailprice AS fetched_at FROM c JOIN part ON p_partkey = opportunity_id ORDER BY p_retailprice DESC, opportunity_id DESC, user_id LIMIT 20",
    "application_statuses": "SELECT doc_id, CASE WHEN (['open', 'closed', '', 'awarded'])[doc_id % 4 + 1] IN ('awarded', 'cancelled', 'canceled', 'closed') THEN 'closed' ELSE 'needs_verification' END AS status FROM documents",
    "geographies": r"""WITH i AS (SELECT doc_id, (['ppa', 'ungm', 'mawred', 'eeas'])[doc_id % 4 + 1] AS source, (['Jordan', 'Lebanon', 'Syria'])[doc_id % 7 % 3 + 1] || ', ' || (['Lebanon', 'Iraq', '', 'Egypt'])[doc_id % 11 % 4 + 1] AS places, (['Any Arab country', 'Europe'])[doc_id % 13 % 2 + 1] AS origin,
  CASE WHEN doc_id % 5 = 0 THEN (['outside_lebanon', 'unknown', 'lebanon_confirmed'])[doc_id % 3 + 1] END AS stated FROM documents), e AS (SELECT *, '{"label":"Beneficiary countries or territories","text":"' || places || '","url":"u"}' AS item, '{"label":"Applicant origin","text":"' || origin || '","url":"' AS applicant FROM i),
j AS (SELECT *, CASE WHEN stated IS NOT NULL AND doc_id % 4 = 2 THEN 'evidence_not_copied' WHEN stated <> 'unknown' AND doc_id % 2 = 1 THEN 'no_evidence' END AS error FROM e)
SELECT doc_id, error, CASE WHEN error IS NOT NULL THEN NULL WHEN stated IS NOT NULL THEN stated WHEN source = 'ppa' THEN 'lebanon_confirmed' WHEN source = 'ungm' AND regexp_matches(places, '(^|[,;\s])Lebanon($|[,;\s])') THEN CASE WHEN len(list_filter(string_split_regex(places, '[,;]'), lambda c: trim(c) <> '')) = 1 THEN 'lebanon_confirmed' ELSE 'regional_includes_lebanon' END
    WHEN source = 'mawred' AND regexp_matches(origin, 'Arab country') THEN 'regional_includes_lebanon' ELSE 'unknown' END AS geography,
  '[' || CASE WHEN error IS NOT NULL THEN '' WHEN stated IS NOT NULL THEN CASE WHEN doc_id % 4 = 0 THEN item ELSE '' END WHEN source = 'ppa' THEN '{"label":"Publisher jurisdiction","text":"Lebanon Public Procurement Authority official portal","url":"p"}' WHEN source = 'ungm' AND regexp_matches(places, '(^|[,;\s])Lebanon($|[,;\s])') THEN item
    WHEN source = 'mawred' AND regexp_matches(origin, 'Arab country') THEN applicant || 'u"}' ELSE '' END || ']' AS evidence FROM j""",
    "country_codes": "SELECT doc_id AS id, (['LB', 'FR', '', 'FR,GB', ''])[doc_id % 5 + 1] AS codes, (['countries', 'countries', 'worldwide', 'countries', 'unknown'])[doc_id % 5 + 1] AS scope FROM documents",
    "notice_kinds": """WITH t AS (SELECT p_partkey, (['Request for quotation ', 'Invitation to bid: ', '', 'Expression of interest', 'A request for proposal '])[p_size % 5 + 1] || (['Grant support-call for proposal', 'invitation to tender', 'p'])[p_partkey % 3 + 1] || CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS t FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(t, '(?i)^Grant support-call for proposal$') THEN 'grant' WHEN regexp_matches(t, '(?i)^(?:Request for proposal|Request for quotation|Invitation to bid|Expression of interest|Request for information|Invitation for pre-qualification|Request for proposals|Invitation to tender)') THEN 'procurement' ELSE 'unknown' END AS kind FROM t""",
    "call_ends": "SELECT doc_id, doc_id % 3 = 0 AS closed, CASE WHEN doc_id % 3 = 1 THEN '7 May 2026' END AS deadline_text FROM documents",
    "selected_evidence": """WITH d AS (SELECT doc_id, text, doc_id % 4 <> 2 AS has_status FROM documents)
SELECT doc_id, CAST(2 + has_status::INT AS INTEGER) AS items, CASE WHEN has_status THEN 'Status' ELSE 'Description' END AS first_label, length(text) > 1600 AS incomplete,
  length(text) > 1600 OR strlen(to_json([{'label': 'Country', 'text': (['Lebanon', 'France', 'Worldwide', 'GB and FR', 'none'])[doc_id % 5 + 1]}, {'label': 'Status', 'text': (['Open', 'Closed', '', 'Awarded'])[doc_id % 4 + 1]}, {'label': 'Description', 'text': text}])) - CASE WHEN has_status THEN 0 ELSE 29 END > 1200 AS blocked FROM d""",
    "standing_alerts": "SELECT doc_id % 97 AS user_id, doc_id AS opportunity_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND doc_id % 10 <> 0 AND doc_id % 3 = (doc_id % 97) % 3",
    "enriched_board": """WITH m AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 AND TIMESTAMP '2024-01-01' + to_days(CAST(s_suppkey AS INTEGER)) > TIMESTAMP '2024-01-03')
SELECT doc_id % 97 AS user_id, doc_id AS opportunity_id, CASE WHEN ok THEN doc_id % 101 END AS fit, CASE WHEN ok THEN 1 END AS confidence FROM (SELECT doc_id, doc_id % 4 <> 0 AND doc_id % 97 IN (SELECT s_suppkey FROM m) AS ok FROM documents)""",
    "unsaved": """WITH g AS (SELECT doc_id, CASE WHEN length(text) % 5 <> 0 THEN md5(text) ELSE 'id:' || doc_id END AS k, doc_id % 5 AS u FROM documents)
SELECT a.u AS user_id, a.doc_id AS opportunity_id FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.doc_id % 7 = 0 AND b.k = a.k AND b.u = a.u)""",
    "reconciled_credits": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' OR (o_orderstatus = 'P' AND o_orderkey % 2 <> 0)",
    "paid_cycles": """WITH i AS (SELECT l_orderkey, any_value(l_shipdate) AS s FROM lineitem GROUP BY 1 HAVING count(*) = 1) SELECT o_custkey AS subscription_id, s AS cycle_start, min(o_orderkey) AS invoice_id, max(CAST(s AS DATE) + 30) AS cycle_end FROM orders JOIN i ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' GROUP BY 1, 2""",
    "gate_outcomes": "SELECT user_id AS proposal_id, o_orderkey, CAST(n AS INTEGER) AS n_findings FROM (SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1) JOIN orders ON o_custkey = user_id",
    "missing_headings": r"""WITH d AS (SELECT doc_id, '## 1. The ' || source || ': *aims*' || chr(10) || '# ' || array_to_string(list_slice(string_split(text, ' '), 1, 2), ' ') || chr(10) || text AS t FROM documents),
h AS (SELECT doc_id, list_transform(regexp_extract_all(t, '(?m)^#{1,6} +([^\n]+)$', 1), lambda x: trim(regexp_replace(regexp_replace(regexp_replace(lower(x), '[*_`]', '', 'g'), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'), ' ')) AS a,
  list_transform(regexp_extract_all(t, '(?m)^#{1,6} +([^\n]+)$', 1), lambda x: trim(regexp_replace(regexp_replace(regexp_replace(lower(x), '[*_`]', '', 'g'), '[\p{P}\p{S}]+', ' ', 'g'), '\s+', ' ', 'g'), ' ')) AS u FROM d),
q AS (SELECT doc_id, a, u, unnest(['SRC1 aims', 'the', 'Ölé ñ', '…', 'é!']) AS heading, unnest(['src1 aims', 'the', 'l', '', '']) AS na, unnest(['', '', '', '', 'é']) AS nu FROM h)
SELECT doc_id, heading, CASE WHEN na = '' AND nu = '' THEN 'unreadable' ELSE 'missing' END AS finding FROM q WHERE CASE WHEN na <> '' THEN len(list_filter(a, lambda x: contains(x, na))) = 0 WHEN nu <> '' THEN len(list_filter(u, lambda x: contains(x, nu))) = 0 ELSE true END""",
    "missing_requirements": "SELECT doc_id, ([NULL, 'Explain the need', NULL, 'must explain how the portal serves refugees by the deadline of year two'])[doc_id // 6 % 4 + 1] AS text FROM documents WHERE doc_id % 6 = 0 AND doc_id // 6 % 2 = 1",
    "identity_flags": r"""WITH d AS (SELECT doc_id, trim(substring(text, 1, 5), ' ') AS n FROM documents) SELECT doc_id, concat_ws(',', CASE WHEN length(n) < 3 THEN 'name_short' END, CASE WHEN regexp_matches(n, '(?i)^(test|n/?a|none|unknown|tbd|my (org|organi[sz]ation)|organi[sz]ation|company|xxx+)$') THEN 'name_placeholder' END,
  CASE WHEN regexp_matches(n, '(?i)@|https?://') THEN 'name_address' END, CASE WHEN doc_id % 4 <> 0 THEN 'number_missing' END) AS flags FROM d""",
    "sanitised": r"SELECT doc_id, md5(substring(trim(regexp_replace(' ' || chr(1) || text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), ' '), 1, 2000)) AS md5 FROM documents",
    "merged_ledger": """SELECT user_id AS owner_id, CAST(event_id AS VARCHAR) AS item_id, row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END, CAST(event_id AS VARCHAR)) = 1 AS preferred,
  min(event_type) OVER (PARTITION BY user_id, event_id % 5) <> max(event_type) OVER (PARTITION BY user_id, event_id % 5) AS conflict FROM events""",
    "distinct_referents": """WITH p AS (SELECT DISTINCT p_size AS owner, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' ' || p_type END AS name FROM part), t AS (SELECT *, list_sort(list_distinct(string_split(lower(name), ' '))) AS w FROM p)
SELECT owner, name FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE a.owner = b.owner AND a.name <> b.name AND list_has_all(b.w, a.w) AND (len(b.w) > len(a.w) OR b.name < a.name))""",
    "budget_totals": """WITH l AS (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT) * CAST(round(l_extendedprice) AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY 1), e AS (SELECT o_orderkey, CAST(round(o_totalprice * 20) AS BIGINT) AS envelope FROM orders)
SELECT l_orderkey, total, envelope, abs(total - envelope) <= envelope * CAST(0.02 AS DOUBLE) AS within FROM l JOIN e ON l_orderkey = o_orderkey""",
    "reserved_totals": "SELECT user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS reserved, 500000 - CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS \"left\" FROM events GROUP BY 1",
    "starved_documents": "SELECT page_id, page_id % 4 IN (1, 2) AND page_id % 6 < 3 AS starved FROM pages",
}
