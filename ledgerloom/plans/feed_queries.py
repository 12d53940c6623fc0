"""Queries of the feeds and of what their notices are checked for: publishers' rows as JSON text, identity, hashes, locations, claims and limits; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as T
from ..operators import catalogue, ledger, qualify, textaudit
from ..schemas import EVIDENCE, LOCALES, LOCATIONS
from ..sources import readers
from .bindings import AS_OF, pick, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("k", F.col("doc_id"))


def _day(start: str, form: str):
    return F.date_format(F.date_add(F.lit(start).cast("date"), (F.col("k") % 300).cast("int")), form)


def grants_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of a grants publisher; whole texts are their descriptions."""
    k = F.col("k")
    synopsis = F.struct(pick(k % 7, "Agency", "Bureau of Works").alias("agencyName"), F.col("text").alias("synopsisDesc"), F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("b"))).alias("applicantTypes"), (k * 100).cast("string").alias("awardFloor"), F.when(k % 2 == 0, _day("2024-03-01", "MMMM d, yyyy")).alias("responseDate"))
    row = F.struct(F.when(k % 41 != 0, k.cast("string")).alias("id"), F.concat(F.lit("n"), "k").alias("number"), F.md5("text").alias("title"), _day("2024-01-01", "MM/dd/yyyy").alias("openDate"), _day("2023-11-01", "MM/dd/yyyy").alias("closeDate"), pick(k, "posted", "closed", "archived", "forecasted").alias("oppStatus"), synopsis.alias("synopsis"))
    ok, refused = readers.normalise_grants(_docs(spark, sf_dir).select(F.to_json(row).alias("value")), AS_OF)
    found = ok.select("source_key", "title", "published_at", "deadline", "deadline_precision", "application_status", F.size("evidence").alias("evidence"), F.length("description").alias("described"), F.lit(None).cast("string").alias("reason"))
    return found.unionByName(refused.where("source_key is not null"), allowMissingColumns=True)


def procurement_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    place = F.when(k % 3 != 0, F.struct(F.struct(pick(k, "US", "USA", "").alias("code"), pick(k % 5, "United States", "").alias("name")).alias("country")))
    row = F.struct(
        F.concat(F.lit("p"), "k").alias("noticeId"), F.md5("text").alias("title"), pick(k, "Solicitation", "Award Notice", "Presolicitation", "Special Notice").alias("type"), pick(k % 7, "Solicitation", "Cancelled", None).alias("baseType"), pick(k % 11, "Yes", "No").alias("active"), _day("2024-01-01", "yyyy-MM-dd").alias("postedDate"),
        F.when(k % 4 != 1, _day("2023-11-01", "d MMMM yyyy")).alias("responseDeadLine"), F.substring("text", 1, 200).alias("description"), place.alias("placeOfPerformance"),
    )
    ok, _ = readers.normalise_procurement(_docs(spark, sf_dir).select(F.to_json(row).alias("value")), AS_OF)
    where = F.filter("evidence", lambda e: e["label"] == "Place of performance country")
    return ok.select("source_key", "title", "published_at", "deadline", "application_status", F.size("evidence").alias("evidence"), F.get(where, 0)["text"].alias("country"))


def bank_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notices of a bank, of which most are refused for one of its rules; whole texts are the notices'."""
    k = F.col("k")
    row = F.struct(
        F.concat(F.lit("OP"), F.lpad(k.cast("string"), 8, "0")).alias("id"), pick(k % 13, "Invitation for Bids", "Contract Award").alias("notice_type"), pick(k, "Published", "Draft", "Revised", "Revised").alias("notice_status"), pick(k % 11, "Lebanon", "Jordan").alias("project_ctry_name"), _day("2024-01-01", "dd-MMM-yyyy").alias("noticedate"),
        F.concat(_day("2024-03-01", "yyyy-MM-dd"), F.lit("T00:00:00Z")).alias("submission_deadline_date"), pick(k % 7, "10:30", None, "25:00").alias("submission_deadline_time"), F.when(k % 17 != 0, F.md5("text")).alias("bid_description"), F.concat(F.lit("<p>"), F.col("text"), F.lit("</p><br/>")).alias("notice_text"),
    )
    ok, refused = readers.normalise_bank(_docs(spark, sf_dir).select(F.to_json(row).alias("value")), AS_OF)
    scope = F.filter("evidence", lambda e: F.startswith(e["label"], F.lit("Publisher notice")))
    found = ok.select(F.split_part("source_key", F.lit(":"), F.lit(2)).alias("source_key"), "source_url", "published_at", "deadline", "deadline_local", "application_status", (F.size("evidence") - F.size(scope)).alias("fields"), F.aggregate(scope, F.lit(0), lambda n, e: n + F.length(F.regexp_replace(e["text"], r"\s", ""))).alias("signs"), F.lit(None).cast("string").alias("reason"))
    return found.unionByName(refused, allowMissingColumns=True)


LOCATION_TEXT = """CASE doc_id % 9 WHEN 0 THEN '{"countryCodes":["LB"],"scope":"countries","evidence":[1]}' WHEN 1 THEN '{"countryCodes":[],"scope":"worldwide","evidence":[{"label":"x"}]}' WHEN 2 THEN '{"countryCodes":[],"scope":"unknown","evidence":[]}' WHEN 3 THEN '{"countryCodes":[],"scope":"countries","evidence":[1]}'
  WHEN 4 THEN '{"countryCodes":"LB","scope":"countries","evidence":[1]}' WHEN 5 THEN '[1, 2]' WHEN 6 THEN concat('{"scope":"', source, '","countryCodes":[],"evidence":[]}') WHEN 7 THEN concat('{"countryCodes":["', lang, '"],"scope":"', CASE WHEN doc_id % 2 = 0 THEN 'countries' ELSE 'unknown' END, '","evidence":["', source, '"]}') ELSE concat('{"broken', source) END"""


def location_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(LOCATION_TEXT).alias("t"))
    v = F.try_parse_json("t")
    return d.select("doc_id", readers.location_shape(F.col("t")).alias("sound"), F.try_variant_get(v, "$.scope", "string").alias("scope"), F.size(F.try_variant_get(v, "$.countryCodes", "array<variant>")).alias("codes"))


def all_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, p = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "lang"), table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    return readers.union_feeds([d, p])


# Notices of documents, in SQL that both engines read: the publisher, its key and address, and a claim of identity with its proof and lot.
PUBLISHER = "CASE doc_id % 4 WHEN 0 THEN 'ppa' WHEN 1 THEN 'ungm' WHEN 2 THEN 'worldbank' ELSE 'eeas' END"
PUBLISHER_KEY = "concat(publisher, ':', CASE WHEN doc_id % 11 = 0 THEN 'x' ELSE '' END, doc_id)"
PUBLISHER_URL = "concat(CASE publisher WHEN 'ppa' THEN 'https://ppa.gov.lb/en/tenders/details/' WHEN 'ungm' THEN 'https://www.ungm.org/Public/Notice/' WHEN 'worldbank' THEN 'https://projects.worldbank.org/en/projects-operations/procurement-detail/OP' ELSE 'https://www.eeas.europa.eu/n/' END, doc_id)"
AUTHORITY = "CASE WHEN doc_id % 5 < 3 THEN CASE doc_id % 3 WHEN 0 THEN 'ppa.gov.lb' WHEN 1 THEN 'ungm.org' ELSE 'worldbank.org' END END"
PROOF = "concat(CASE WHEN doc_id % 13 = 0 THEN 'https://other.example/' ELSE CASE doc_id % 3 WHEN 0 THEN 'https://www.ppa.gov.lb/ar/tenders/details/' WHEN 1 THEN 'https://ungm.org/Public/Notice/' ELSE 'https://projects.worldbank.org/en/projects-operations/procurement-detail/OP' END END, doc_id, CASE WHEN doc_id % 17 = 0 THEN '?x=1' ELSE '' END)"
REFERENCE = "concat(CASE doc_id % 3 WHEN 2 THEN 'OP' ELSE '' END, doc_id)"
GRANULARITY, LOT = "CASE WHEN doc_id % 2 = 0 THEN 'lot' ELSE 'notice' END", "CASE WHEN doc_id % 7 < 4 THEN concat('L', doc_id % 10) END"
SHOWN, SHOWN_LOT = "CASE WHEN doc_id % 19 = 0 THEN 'nothing' ELSE concat('see (', proof, ').') END", "concat('L', doc_id % 10)"


def _as_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    for name, sql in (("publisher", PUBLISHER), ("key", PUBLISHER_KEY), ("url", PUBLISHER_URL), ("authority", AUTHORITY), ("proof", PROOF), ("reference", REFERENCE), ("granularity", GRANULARITY), ("lot", LOT), ("shown", SHOWN), ("shown_lot", SHOWN_LOT)):
        d = d.withColumn(name, F.expr(sql))
    claim = F.when(F.col("authority").isNotNull(), F.struct("authority", "reference", "granularity", F.col("lot").alias("lotId"), F.col("proof").alias("proofUrl")))
    item = lambda label, text: F.struct(F.lit(label).alias("label"), F.col(text).alias("text"), F.lit("u").alias("url"))
    return d.withColumn("claim", claim).withColumn("evidence", F.array(item("Link", "shown"), item("Lot number", "shown_lot")))


_AS_NOTICES = f"""n AS (SELECT *, {SHOWN} AS shown, {SHOWN_LOT} AS shown_lot FROM (SELECT *, {PUBLISHER_KEY} AS key, {PUBLISHER_URL} AS url FROM (SELECT doc_id, text, {PUBLISHER} AS publisher, {AUTHORITY} AS authority, {PROOF} AS proof, {REFERENCE} AS reference, {GRANULARITY} AS granularity, {LOT} AS lot FROM documents))),
claims AS (SELECT doc_id, url, shown, shown_lot, authority, proof, reference, granularity, coalesce(lot, '') AS lot FROM n WHERE authority IS NOT NULL
  UNION ALL SELECT doc_id, url, shown, shown_lot, publisher || CASE publisher WHEN 'ppa' THEN '.gov.lb' ELSE '.org' END, url, regexp_extract(key, '[0-9]+$'), 'notice', '' FROM n WHERE authority IS NULL AND regexp_matches(key, '^(ppa|ungm):[0-9]+$')),
judged AS (SELECT *, CASE WHEN CASE authority WHEN 'worldbank.org' THEN 'projects.worldbank.org' ELSE authority END <> regexp_replace(regexp_extract(proof, '^https://([^/?#]+)', 1), '^www\\.', '') THEN 'host_of_other_authority'
  WHEN regexp_extract(proof, CASE authority WHEN 'ppa.gov.lb' THEN '^https://[^/?#]+/(?:en|ar)/tenders/details/([0-9]+)$' WHEN 'ungm.org' THEN '^https://[^/?#]+/Public/Notice/([0-9]+)$' ELSE '^https://[^/?#]+/en/projects-operations/procurement-detail/(OP[0-9]+)$' END, 1) <> reference THEN 'reference_not_in_proof'
  WHEN proof <> url AND NOT list_contains(list_transform(regexp_extract_all(shown, 'https://[^\\s<>"'']+'), lambda u: regexp_replace(u, '[.,;)]+$', '')), proof) THEN 'proof_not_in_evidence' WHEN granularity = 'lot' AND lot = '' THEN 'lot_missing' WHEN granularity = 'lot' AND lot <> shown_lot THEN 'lot_not_in_evidence' WHEN granularity = 'notice' AND lot <> '' THEN 'lot_unexpected' END AS error FROM claims),
keyed AS (SELECT *, CASE WHEN error IS NULL THEN sha256('["' || authority || '","' || reference || '","' || granularity || '","' || lot || '"]') END AS identity_key FROM judged)"""


def profile_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    several = lambda n: F.array_repeat(F.lit("a"), (k % n).cast("int"))
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", F.expr("substring(repeat(c_name, 9), 1, cast(c_custkey % 200 as int))").alias("organizationName"), pick(k, "ngo", "company", "club").alias("organizationType"), several(15).alias("sectors"), F.repeat("c_mktsegment", (k % 300).cast("int")).alias("capabilities"),
        several(12).alias("locations"), (k % 9 != 0).alias("alertsEnabled"), F.repeat("c_name", (k % 130).cast("int")).alias("pastWork"), F.repeat("c_mktsegment", (k % 40).cast("int")).alias("teamCapacity"), several(14).alias("languages"), ((k % 7) - 1).alias("budgetMin"), F.when(k % 5 != 0, k % 6).alias("budgetMax"),
        several(23).alias("qualifications"), F.when(k % 2 == 0, several(22)).alias("interests"), several(21).alias("excludedWork"), F.slice(F.array(F.lit("grant"), pick(k, "tender", "procurement"), F.lit("grant")), 1, (k % 4).cast("int")).alias("opportunityTypes"),
    )
    return catalogue.validate(c, qualify.profile_rules()).select("c_custkey", F.array_join("reasons", ",").alias("broken"))


def qualified_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of notices: stated ones, a publisher's, and older claims with evidence of the project's country."""
    k = F.col("doc_id")
    item = F.struct(pick(k, "Project country", "Country", "beneficiary countries or territories").alias("label"), F.concat(pick(k % 7, "Leb", "Lebanon", "Jordan; "), F.when(k % 4 == 0, "anon").when(k % 4 == 1, " Lebanon").otherwise("")).alias("text"), F.lit("u").alias("url"))
    stated = F.when(k % 6 == 0, F.struct(F.array(F.lit("FR")).alias("countryCodes"), F.lit("countries").alias("scope"), F.array(item).alias("evidence")))
    claimed = F.when(k % 5 < 3, F.struct(pick(k % 5, "lebanon_confirmed", "regional_includes_lebanon", "unknown").alias("status"), F.array(item).alias("evidence")))
    d = _as_notices(spark, sf_dir).select("doc_id", qualify.locations(F.col("publisher"), stated, claimed, F.array(item), F.col("url")).alias("o"))
    return d.select("doc_id", F.array_join("o.countryCodes", ",").alias("codes"), "o.scope", F.array_join(F.transform("o.evidence", lambda e: F.concat_ws("|", e["label"], e["text"], e["url"])), ";").alias("evidence"))


def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    d = _as_notices(spark, sf_dir).withColumn("o", qualify.identity(c("publisher"), c("key"), c("url"), c("claim"), c("evidence")))
    return d.select("doc_id", "o.authority", "o.reference", "o.key", "o.error")


def notice_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notices, and what of their contract they break."""
    k = F.col("doc_id")
    d = _as_notices(spark, sf_dir)
    item = F.struct(F.lit("Text").alias("label"), F.coalesce("text", F.lit("")).alias("text"), F.col("url").alias("url"))
    rows = d.select(
        "doc_id", F.when(k % 29 == 0, "elsewhere").otherwise(F.col("publisher")).alias("source"), F.col("key").alias("sourceKey"), F.when(k % 23 == 0, F.replace("url", F.lit("https"), F.lit("http"))).otherwise(F.col("url")).alias("sourceUrl"), F.substring_index("text", "\n", 1).alias("title"),
        F.repeat(F.coalesce("text", F.lit("")), 20).alias("description"), pick(k, "grant", "procurement", "tender").alias("kind"), F.array_repeat(item, (k % 103).cast("int")).alias("evidence"), F.lit(None).cast(f"struct<status:string,evidence:{EVIDENCE}>").alias("geography"),
        F.struct(F.array_repeat(F.lit("LB"), (k % 3).cast("int")).alias("countryCodes"), pick(k % 5, "countries", "worldwide", "unknown").alias("scope"), F.when(k % 2 == 0, F.array(item)).otherwise(F.array().cast(EVIDENCE)).alias("evidence")).alias("locations"),
        F.col("claim").alias("identityClaim"), F.when(k % 31 != 0, F.lit(AS_OF).cast("timestamp")).alias("fetchedAt"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("contentHash"), pick(k, "not_fetched", "partial", "verified", "unavailable").alias("detailStatus"),
        pick(k, "needs_verification", "closed", "open").alias("applicationStatus"), F.array().cast(LOCALES).alias("locales"),
    )
    return catalogue.validate(rows, qualify.notice_rules()).select("doc_id", F.array_join("reasons", ",").alias("broken"))


def _locales():
    one = lambda locale: F.struct(F.lit(locale).alias("locale"), F.lit("u").alias("sourceUrl"), F.md5(F.coalesce("text", F.lit(""))).alias("title"), F.lit("d").alias("description"), F.lit("2024-01-01").cast("date").alias("deadline"), F.array().cast("array<string>").alias("evidence"), (F.col("k") % 3 == 0).alias("detailNeedsRefresh"))
    return F.array(one("fr"), one("en"))


def record_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).withColumn("locales", _locales())
    return d.select("doc_id", catalogue.record_hash(F.col("locales")).alias("hash"), catalogue.detail_status(F.col("locales"), F.lit("verified")).alias("detail_status"))


def qualified_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    d = _as_notices(spark, sf_dir)
    none = F.lit(None)
    place = qualify.geography(c("publisher"), none.cast(f"struct<status:string,evidence:{EVIDENCE}>"), c("evidence"), c("url"))
    where = qualify.locations(c("publisher"), none.cast(LOCATIONS), none.cast(f"struct<status:string,evidence:{EVIDENCE}>"), c("evidence"), c("url"))
    who = qualify.identity(c("publisher"), c("key"), c("url"), c("claim"), c("evidence"))
    return d.select("doc_id", qualify.qualified_hash(F.sha2(F.coalesce("text", F.lit("")), 256), place, where, who["key"]).alias("hash"))


def claim_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textaudit.normal_claims(_docs(spark, sf_dir).select("doc_id", pick(F.col("k"), "fact", "figure", "guess").alias("class")), ["fact", "figure"]).select("doc_id", "class", "raw_class")


# Documents as guidelines, requirements and evidence: some of their words are read as words of a donor's.
AS_GUIDE = {"erer": "answers", "attion": "must not exceed", "thing": "words", "thin": "budget", "thst": "attached", "thti": "excluded from", "thly": "word limit", "thor": "the word count excludes the", "thha": "annex"}
AS_ASKED, AS_TOLD = {"thea": "track record", "erin": "past performance", "thtion": "past perfection"}, {"thes": "delivered", "thed": "projected", "thnt": "programmes", "thble": "plans"}


def _read_as(text, words: dict[str, str]):
    for word, other in words.items():
        text = F.replace(text, F.lit(f" {word} "), F.lit(f" {other} "))
    return text


def _read_as_sql(words: dict[str, str]) -> str:
    text = "coalesce(text, '')"
    for word, other in words.items():
        text = f"replace({text}, ' {word} ', ' {other} ')"
    return text


def limit_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", textaudit.limit_scope(_read_as(F.coalesce("text", F.lit("")), AS_GUIDE)).alias("scope"))


def record_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return _docs(spark, sf_dir).select("doc_id", ledger.gap_detected(_read_as(text, AS_ASKED), F.split(_read_as(text, AS_TOLD), "\n")).alias("gap"))


def attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", ledger.attributable(F.col("text"), F.array(F.lit("the"), F.lit("la"))).alias("attributable"))


def deadline_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time of every event, written out, before a zone, or before none."""
    e = table(spark, sf_dir, "events")
    said = F.concat_ws(" ", F.lit("by"), F.date_format("ts", "h:mm a"), pick(F.col("user_id"), "GMT+1", "today", "CET", "UTC sharp"))
    return e.select("event_id", dates.deadline_time(said).alias("t")).select("event_id", "t.time", "t.zone")


def stated_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities before the word of their line's flag, of which two count as units."""
    i = table(spark, sf_dir, "lineitem")
    unit = F.when(F.col("l_returnflag") == "A", "People").when(F.col("l_returnflag") == "R", "participants").otherwise("boxes")
    said = F.concat_ws(" ", F.lit("For"), F.format_number(F.col("l_partkey") * 10, 0), unit, F.lit("and"), F.round("l_quantity").cast("long").cast("string"), unit, F.lit("in 2024"))
    found = T.numbers_of(said, "people|participants")
    return i.select("l_orderkey", "l_linenumber", F.array_join(found.cast("array<string>"), ",").alias("numbers"), T.significant_figures(F.col("l_partkey") * 10).alias("figures"))


QUERIES = {f.__name__: f for f in (
    grants_feed, procurement_feed, bank_feed, all_feeds, location_shapes, profile_checks, qualified_locations, identity_keys, notice_contract, record_hashes, qualified_hashes, claim_classes, limit_scopes, record_gaps, attributed, deadline_times, stated_numbers,
)}

_DAY = "DATE '{}' + CAST(doc_id % 300 AS INTEGER)".format
_TIDY = r"trim(regexp_replace(coalesce(text, ''), '[ \t\r\n\f\x0B]+', ' ', 'g'), ' ')"
_LOCALE = """{"locale":"%s","sourceUrl":"u","title":"' || md5(coalesce(text, '')) || '","description":"d","deadline":"2024-01-01","evidence":[]}"""

ORACLES = {
    "grants_feed": f"""WITH d AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN {_DAY('2024-03-01')} ELSE {_DAY('2023-11-01')} END AS closes, {_TIDY} AS told FROM documents WHERE doc_id % 41 <> 0)
SELECT CASE WHEN length(told) > 60000 THEN '' ELSE 'grants-gov:' END || doc_id AS source_key, CASE WHEN length(told) <= 60000 THEN md5(text) END AS title, CASE WHEN length(told) <= 60000 THEN {_DAY('2024-01-01')} END AS published_at, CASE WHEN length(told) <= 60000 THEN closes END AS deadline, CASE WHEN length(told) <= 60000 THEN 'date_only' END AS deadline_precision,
  CASE WHEN length(told) > 60000 THEN NULL WHEN doc_id % 4 = 0 AND closes < DATE '2024-01-03' THEN 'closed' ELSE 'needs_verification' END AS application_status,
  CASE WHEN length(told) <= 60000 THEN CAST(8 + ceil(length(told) / 10500.0) + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) END AS evidence, CASE WHEN length(told) <= 60000 THEN CAST(length(CASE WHEN told = '' THEN '' ELSE told END) AS INTEGER) END AS described, CASE WHEN length(told) > 60000 THEN 'text_exceeds_contract' END AS reason FROM d""",
    "procurement_feed": f"""WITH d AS (SELECT *, lower((['Solicitation', 'Award Notice', 'Presolicitation', 'Special Notice'])[doc_id % 4 + 1] || ' ' || coalesce((['Solicitation', 'Cancelled', NULL])[doc_id % 7 % 3 + 1], '')) AS kind, doc_id % 11 % 2 = 1 AS over, CASE WHEN doc_id % 4 <> 1 THEN {_DAY('2023-11-01')} END AS closes,
  CASE WHEN doc_id % 3 = 1 THEN CASE WHEN doc_id % 5 % 2 = 0 THEN 'United States' ELSE 'USA' END WHEN doc_id % 3 = 2 AND doc_id % 5 % 2 = 0 THEN 'United States' END AS country FROM documents)
SELECT 'sam-gov:p' || doc_id AS source_key, md5(text) AS title, {_DAY('2024-01-01')} AS published_at, closes AS deadline, CASE WHEN over OR regexp_matches(kind, 'award notice|cancelled|canceled|archived|closed') THEN 'closed' WHEN regexp_matches(kind, 'pre[- ]?solicitation|forecast') THEN 'needs_verification' WHEN closes < DATE '2024-01-03' THEN 'closed' ELSE 'needs_verification' END AS application_status,
  CAST(5 + CASE WHEN doc_id % 7 % 3 < 2 THEN 1 ELSE 0 END + CASE WHEN closes IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN trim(regexp_replace(substring(text, 1, 200), '\\s+', ' ', 'g')) <> '' THEN 1 ELSE 0 END + CASE WHEN country IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS evidence, country FROM d""",
    "bank_feed": f"""WITH d AS (SELECT *, 'OP' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS id, (['10:30', NULL, '25:00'])[doc_id % 7 % 3 + 1] AS time, {_TIDY} AS told FROM documents),
r AS (SELECT *, CASE WHEN doc_id % 11 % 2 = 1 THEN 'outside_scope' WHEN doc_id % 13 % 2 = 1 THEN 'type_changed' WHEN doc_id % 4 = 1 THEN 'not_published' WHEN doc_id % 17 = 0 OR text IS NULL THEN 'schema_changed' WHEN length(told) NOT BETWEEN 1 AND 12000 THEN 'text_exceeds_contract' WHEN time = '25:00' THEN 'deadline_time_invalid' END AS reason FROM d)
SELECT id AS source_key, CASE WHEN reason IS NULL THEN 'https://projects.worldbank.org/en/projects-operations/procurement-detail/' || id END AS source_url, CASE WHEN reason IS NULL THEN {_DAY('2024-01-01')} END AS published_at, CASE WHEN reason IS NULL THEN {_DAY('2024-03-01')} END AS deadline,
  CASE WHEN reason IS NULL AND time IS NOT NULL THEN strftime({_DAY('2024-03-01')}, '%Y-%m-%d') || 'T' || time END AS deadline_local, CASE WHEN reason IS NULL THEN 'needs_verification' END AS application_status, CASE WHEN reason IS NULL THEN CAST(5 + CASE WHEN time IS NULL THEN 0 ELSE 1 END AS INTEGER) END AS fields,
  CASE WHEN reason IS NULL THEN CAST(length(regexp_replace(told, '\\s', '', 'g')) AS INTEGER) END AS signs, reason FROM r""",
    "location_shapes": f"""WITH t AS (SELECT doc_id, {LOCATION_TEXT} AS t FROM documents), v AS (SELECT doc_id, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS j FROM t), x AS (SELECT doc_id, CASE WHEN json_type(j, '$.countryCodes') = 'ARRAY' THEN json_array_length(j, '$.countryCodes') END AS codes, CASE WHEN json_type(j, '$.evidence') = 'ARRAY' THEN json_array_length(j, '$.evidence') END AS shown, json_extract_string(j, '$.scope') AS scope FROM v)
SELECT doc_id, coalesce(CASE scope WHEN 'countries' THEN codes > 0 AND shown > 0 WHEN 'worldwide' THEN codes = 0 AND shown > 0 WHEN 'unknown' THEN codes = 0 AND shown = 0 ELSE false END, false) AS sound, scope, CAST(codes AS INTEGER) AS codes FROM x""",
    "all_feeds": "SELECT doc_id AS id, lang, NULL AS url FROM documents UNION ALL SELECT page_id, NULL, url FROM pages",
    "profile_checks": """SELECT c_custkey, concat_ws(',', CASE WHEN length(trim(substring(repeat(c_name, 9), 1, c_custkey % 200), ' ')) NOT BETWEEN 1 AND 160 THEN 'organizationName' END, CASE WHEN c_custkey % 3 = 2 THEN 'organizationType' END, CASE WHEN c_custkey % 15 NOT BETWEEN 1 AND 12 THEN 'sectors' END,
  CASE WHEN length(trim(repeat(c_mktsegment, c_custkey % 300), ' ')) > 4000 THEN 'capabilities' END, CASE WHEN c_custkey % 12 NOT BETWEEN 1 AND 10 THEN 'locations' END, CASE WHEN length(trim(repeat(c_name, c_custkey % 130), ' ')) > 2000 THEN 'pastWork' END, CASE WHEN length(trim(repeat(c_mktsegment, c_custkey % 40), ' ')) > 500 THEN 'teamCapacity' END,
  CASE WHEN c_custkey % 14 > 12 THEN 'languages' END, CASE WHEN c_custkey % 7 - 1 < 0 THEN 'budgetMin' END, CASE WHEN c_custkey % 23 > 20 THEN 'qualifications' END, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 22 > 20 THEN 'interests' END, CASE WHEN c_custkey % 21 > 20 THEN 'excludedWork' END,
  CASE WHEN c_custkey % 4 NOT BETWEEN 1 AND 2 OR (c_custkey % 4 = 2 AND c_custkey % 2 = 0) THEN 'opportunityTypes' END, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 6 < c_custkey % 7 - 1 THEN 'budget' END) AS broken FROM customer""",
    "qualified_locations": f"""WITH {_AS_NOTICES}, i AS (SELECT doc_id, publisher, url, (['Project country', 'Country', 'beneficiary countries or territories'])[doc_id % 3 + 1] AS label, (['Leb', 'Lebanon', 'Jordan; '])[doc_id % 7 % 3 + 1] || CASE doc_id % 4 WHEN 0 THEN 'anon' WHEN 1 THEN ' Lebanon' ELSE '' END AS t, doc_id % 6 = 0 AS stated, doc_id % 5 < 2 AS claimed FROM n),
j AS (SELECT *, claimed AND lower(label) IN ('project country', 'country of implementation', 'beneficiary countries or territories') AND (trim(t) = 'Lebanon' OR lower(label) LIKE 'beneficiary%' AND regexp_matches(t, '(?i)(^|[,;\\s])Lebanon($|[,;\\s])')) AS named FROM i)
SELECT doc_id, CASE WHEN stated THEN 'FR' WHEN publisher = 'ppa' OR named THEN 'LB' ELSE '' END AS codes, CASE WHEN stated OR publisher = 'ppa' OR named THEN 'countries' ELSE 'unknown' END AS scope,
  CASE WHEN stated OR publisher <> 'ppa' AND named THEN label || '|' || t || '|u' WHEN publisher = 'ppa' THEN 'Procurement jurisdiction|Lebanon Public Procurement Authority official portal|' || url ELSE '' END AS evidence FROM j""",
    "identity_keys": f"WITH {_AS_NOTICES} SELECT n.doc_id, k.authority, k.reference, k.identity_key AS key, k.error FROM n LEFT JOIN keyed k USING (doc_id)",
    "notice_contract": f"""WITH {_AS_NOTICES}, c AS (SELECT *, doc_id % 3 AS codes, (['countries', 'worldwide', 'unknown'])[doc_id % 5 % 3 + 1] AS scope, doc_id % 2 = 0 AS why, doc_id % 103 AS items, coalesce(text, '') AS t, doc_id % 29 <> 0 AS known FROM n)
SELECT doc_id, concat_ws(',', CASE WHEN NOT known THEN 'source' END, CASE WHEN NOT known OR doc_id % 23 = 0 THEN 'sourceUrl' END, CASE WHEN text IS NULL OR length(split_part(text, chr(10), 1)) NOT BETWEEN 1 AND 2000 THEN 'title' END, CASE WHEN length(t) * 20 > 60000 THEN 'description' END, CASE WHEN doc_id % 3 = 2 THEN 'kind' END,
  CASE WHEN items > 100 OR (items > 0 AND (length(t) > 12000 OR NOT known)) THEN 'evidence' END, CASE WHEN NOT CASE scope WHEN 'countries' THEN codes > 0 AND why WHEN 'worldwide' THEN codes = 0 AND why ELSE codes = 0 AND NOT why END OR codes > 1 OR (why AND items = 0) THEN 'locations' END,
  CASE WHEN doc_id % 31 = 0 THEN 'fetchedAt' END, CASE WHEN doc_id % 4 = 3 THEN 'detailStatus' END, CASE WHEN doc_id % 3 = 2 THEN 'applicationStatus' END) AS broken FROM c""",
    "record_hashes": f"SELECT doc_id, sha256('[{_LOCALE % 'en'},{_LOCALE % 'fr'}]') AS hash, CASE WHEN doc_id % 3 = 0 THEN 'partial' ELSE 'verified' END AS detail_status FROM documents",
    "qualified_hashes": f"""WITH {_AS_NOTICES} SELECT n.doc_id, sha256('["catalogue-qualification-v1","' || sha256(coalesce(text, '')) || '","' || CASE publisher WHEN 'ppa' THEN 'lebanon_confirmed",[{{"label":"Publisher jurisdiction","text":"Lebanon Public Procurement Authority official portal","url":"' || n.url || '"}}],{{"countryCodes":["LB"],"scope":"countries","evidence":[{{"label":"Procurement jurisdiction","text":"Lebanon Public Procurement Authority official portal","url":"' || n.url || '"}}]}}' ELSE 'unknown",[],{{"countryCodes":[],"scope":"unknown","evidence":[]}}' END
  || ',' || coalesce('"' || identity_key || '"', 'null') || ']') AS hash FROM n LEFT JOIN keyed k USING (doc_id)""",
    "claim_classes": "SELECT doc_id, (['fact', 'figure', 'unsupported'])[doc_id % 3 + 1] AS class, (['fact', 'figure', 'guess'])[doc_id % 3 + 1] AS raw_class FROM documents",
    "limit_scopes": rf"""WITH g AS (SELECT doc_id, lower({_read_as_sql(AS_GUIDE)}) AS g FROM documents)
SELECT doc_id, CASE WHEN ((regexp_matches(g, '\b(answers?|responses?|questions?)\b[^.]{{0,80}}\b(must not exceed|no more than|within|limited to|maximum of)\b') OR regexp_matches(g, '\b(must not exceed|no more than)\b[^.]{{0,40}}\bwords?\b[^.]{{0,60}}\b(answers?|responses?)\b'))
  AND (regexp_matches(g, '\b(budget table|budget)\b[^.]{{0,60}}\b(must be )?attach(ed)?\b') OR regexp_matches(g, '\battach\b[^.]{{0,40}}\bbudget\b')))
  OR regexp_matches(g, '\b(excluded from|does not count towards|not counted towards|outside)\b[^.]{{0,40}}\b(word )?(limit|count)\b') OR regexp_matches(g, '\b(word )?(count|limit)\b[^.]{{0,40}}\bexclud\w*\b[^.]{{0,60}}\b(budget|declaration|annex|appendix|table|attachment)\b') THEN 'answers' ELSE 'whole' END AS scope FROM g""",
    "record_gaps": f"""SELECT doc_id, regexp_matches({_read_as_sql(AS_ASKED)}, '(?i)experience|track record|past (?:project|performance)|previous (?:project|grant)') AND NOT regexp_matches({_read_as_sql(AS_TOLD)}, '(?i)project|programme|result|since|founded|deliver') AS gap FROM documents""",
    "attributed": "SELECT doc_id, list_has_any(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), ' '), ['the', 'la']) AS attributable FROM documents",
    "deadline_times": "SELECT event_id, strftime(ts, '%-I:%M %p') AS time, (['GMT+1', NULL, 'CET', 'UTC'])[user_id % 4 + 1] AS zone FROM events",
    "stated_numbers": "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag IN ('A', 'R') THEN l_partkey * 10 || ',' || CAST(round(l_quantity) AS BIGINT) ELSE '' END AS numbers, CAST(length(regexp_replace(CAST(l_partkey * 10 AS VARCHAR), '0+$', '')) AS INTEGER) AS figures FROM lineitem",
}
