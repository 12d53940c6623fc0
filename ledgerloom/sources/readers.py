"""Readers and writers: artifacts of crawlers, publishers' notices, narratives, logs and operational tables. Schemas are explicit."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import dates
from ..functions import text as T
from ..schemas import NOTICE, struct

BANK_NOTICE = "id string, notice_type string, noticedate string, notice_status string, submission_deadline_date string, submission_deadline_time string, project_ctry_name string, project_name string, bid_reference_no string, bid_description string, notice_text string"
SYNOPSIS = "struct<agencyName:string,agencyCode:string,synopsisDesc:string,applicantEligibilityDesc:string,applicantTypes:variant,awardFloor:string,awardCeiling:string,costSharing:string,fundingDescLinkUrl:string,fundingDescLinkDesc:string,fundingInstruments:variant,fundingActivityCategories:variant,openingDate:string,postingDate:string,closeDate:string,responseDate:string,responseDateStr:string>"
GRANT_NOTICE = f"id string, number string, title string, agencyName string, docType string, openDate string, closeDate string, oppStatus string, alnist variant, synopsis {SYNOPSIS}"
PROCUREMENT_NOTICE = "noticeId string, title string, solicitationNumber string, type string, baseType string, active string, postedDate string, responseDeadLine string, reponseDeadLine string, description string, fullParentPathName string, department string, subtier string, setAside string, naicsCode string, classificationCode string, placeOfPerformance struct<country:struct<code:string,name:string>>"
# Where publishers show a notice, and what bank notices must be.
BANK_ROOT, GRANT_ROOT, PROCUREMENT_ROOT = "https://projects.worldbank.org/en/projects-operations/procurement-detail/", "https://www.grants.gov/search-results-detail/", "https://sam.gov/opp/"
BANK_COUNTRY, BANK_KEPT, BANK_TYPES, BANK_ID = "Lebanon", ["Published", "Revised"], ["Invitation for Bids", "Invitation for Prequalification", "Request for Expression of Interest"], r"^OP\d{8}$"
# Types of procurement notices that are over.
ENDED = "award notice|cancelled|canceled|archived|closed"
EVIDENCE_PIECE, LONG_PIECE = 1500, 10_500
COVERAGE = "coverage variant"


def read_catalogue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, coverage, bad) of artifacts ``{records: [...], coverage: {...}}``: one row a record; what each file says of its coverage, as a variant; and the text of files that are no such artifact."""
    whole = spark.read.schema(f"records array<{struct(NOTICE).simpleString()}>, {COVERAGE}, _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = whole.withColumn("file", F.input_file_name())
    sound = rows.where(F.col("_bad").isNull() & F.col("records").isNotNull())
    bad = rows.where(F.col("_bad").isNotNull() | F.col("records").isNull()).select("file", F.when(F.col("_bad").isNotNull(), "not_read").otherwise("no_records").alias("reason"), F.col("_bad").alias("text"))
    return sound.select(F.explode("records").alias("r")).select("r.*"), sound.select("file", "coverage", F.size("records").alias("records")), bad


@F.udf(ArrayType(StringType()), useArrow=False)
def pieces(text: str | None) -> list[str]:
    """Pieces of at most ``EVIDENCE_PIECE`` characters, ended at the last space of their second half if there is one. Row by row: the texts of a whole Arrow batch would have to fit in a worker."""
    out, at = [], 0
    while text and at < len(text):
        end = min(at + EVIDENCE_PIECE, len(text))
        space = text.rfind(" ", 0, end + 1) if end < len(text) else -1
        end = space if space > at + EVIDENCE_PIECE / 2 else end
        out.append(text[at:end].strip())
        at = end
    return out


def _clean(text: Column) -> Column:
    return T.collapse(T.decode_named(F.coalesce(text, F.lit(""))))


def markup_text(html: Column) -> Column:
    """Text of a notice in markup: scripts and styles away, breaks and ends of blocks as spaces, white space runs as one."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)<(br|hr)\b[^>]*>|</(p|div|li|tr|td|th|h[1-6]|section)\s*>", " "), r"<[^>]+>", "")
    return T.collapse(T.decode_entities(text))


def _evidence(url: Column, *items) -> Column:
    """(label, text, url) of the items that say something: (label, text), or an array of such structs."""
    said = lambda own: F.filter(F.array(*[F.struct(F.lit(k).alias("label"), _clean(v).alias("text")) for k, v in own]), lambda e: e["text"] != "")  # noqa: E731  # each is cleaned once
    parts = [said(own) if fields else F.concat(*own) for fields, own in ((k, list(g)) for k, g in itertools.groupby(items, lambda i: isinstance(i, tuple)))]
    return F.transform(F.concat(*parts), lambda e: F.struct(e["label"].alias("label"), e["text"].alias("text"), url.alias("url")))


def _long(label: str, whole: Column) -> Column:
    """A clean text, which is a column of its own as each piece reads it, as items of ``LONG_PIECE`` characters, numbered if there are several."""
    n = F.ceil(F.length(whole) / LONG_PIECE).cast("int")
    name = lambda k: F.when(n > 1, F.concat(F.lit(f"{label} ("), k.cast("string"), F.lit("/"), n.cast("string"), F.lit(")"))).otherwise(label)
    found = F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(name(k).alias("label"), F.substring(whole, (k - 1) * LONG_PIECE + 1, F.lit(LONG_PIECE)).alias("text")))
    return F.when(F.length(whole) > 0, found).otherwise(F.array().cast("array<struct<label:string,text:string>>"))


def _notices(rows: DataFrame, source: str, kind: str, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(notices, refused) of rows with id, source_url, title, description, published_at, deadline, precision, evidence, status, and a reason for those that are refused."""
    locale = F.struct(F.lit("en").alias("locale"), "source_url", "title", "description", "published_at", "deadline", "evidence")
    ok = rows.where(F.col("reason").isNull()).select(
        F.lit(source).alias("source"), F.concat(F.lit(source + ":"), "id").alias("source_key"), "source_url", "title", "description", "published_at", "deadline", F.col("precision").alias("deadline_precision"), "deadline_local", F.lit(kind).alias("kind"), "evidence",
        F.col("status").alias("application_status"), F.lit("verified").alias("detail_status"), F.array(locale).alias("locales"), F.lit(as_of).cast("timestamp").alias("fetched_at"),
    )
    hashed = F.sha2(F.to_json(F.struct(*[c for c in ok.columns if c not in ("detail_status", "locales", "fetched_at")])), 256)
    return ok.withColumn("content_hash", hashed), rows.where(F.col("reason").isNotNull()).select(F.col("id").alias("source_key"), "reason")


def _over(deadline: Column, as_of: str) -> Column:
    return F.coalesce(deadline < F.lit(as_of).cast("timestamp").cast("date"), F.lit(False))


def normalise_grants(raw: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(notices, refused) of JSON text (column value) of a grants publisher: posted ones whose closing date is over are closed, all others need verification."""
    r = raw.select(F.from_json("value", GRANT_NOTICE).alias("r")).select("r.*")
    r = r.withColumns({"_said": _clean(F.col("synopsis.synopsisDesc")), "_who": _clean(F.col("synopsis.applicantEligibilityDesc"))})
    c, said = F.col, lambda name: F.when(F.col(name).isNotNull(), F.to_json(name))
    url = F.concat(F.lit(GRANT_ROOT), c("id"))
    closes = F.coalesce("synopsis.responseDateStr", "synopsis.responseDate", "synopsis.closeDate", "closeDate")
    items = _evidence(
        url, ("Grants.gov opportunity ID", c("id")), ("Funding opportunity number", c("number")), ("Opportunity status", F.coalesce("oppStatus", F.lit("posted"))), ("Opportunity title", c("title")), ("Offering agency", F.coalesce("synopsis.agencyName", "agencyName")),
        ("Agency code", c("synopsis.agencyCode")), _long("Opportunity description", c("_said")), _long("Applicant eligibility details", c("_who")), ("Applicant eligibility", said("synopsis.applicantTypes")),
        ("Award floor", c("synopsis.awardFloor")), ("Award ceiling", c("synopsis.awardCeiling")), ("Cost sharing required", c("synopsis.costSharing")), ("Funding description link", c("synopsis.fundingDescLinkUrl")), ("Funding description link label", c("synopsis.fundingDescLinkDesc")),
        ("Funding instruments", said("synopsis.fundingInstruments")), ("Funding activity categories", said("synopsis.fundingActivityCategories")), ("Assistance Listing numbers", said("alnist")), ("Opportunity opening date", F.coalesce("synopsis.openingDate", "openDate")),
        ("Opportunity closing date", F.coalesce("synopsis.closeDate", "synopsis.responseDate", "closeDate")),
    )
    deadline = dates.publisher_date(closes)
    described = F.coalesce(F.nullif(c("_said"), F.lit("")), F.concat_ws(" · ", "agencyName", "docType"))
    reason = F.when(c("id").isNull(), "detail_schema_changed").when((F.length(_clean(c("title"))) > 2000) | (F.length(_clean(c("number"))) > 300) | (F.length(described) > 60_000), "text_exceeds_contract")
    posted = F.lower(F.coalesce("oppStatus", F.lit("posted"))) == "posted"
    rows = r.select(
        "id", url.alias("source_url"), _clean(c("title")).alias("title"), described.alias("description"), dates.publisher_date(F.coalesce("synopsis.postingDate", "openDate")).alias("published_at"), deadline.alias("deadline"), F.when(deadline.isNotNull(), "date_only").otherwise("unknown").alias("precision"),
        F.lit(None).cast("string").alias("deadline_local"), items.alias("evidence"), F.when(posted & _over(deadline, as_of), "closed").otherwise("needs_verification").alias("status"), reason.alias("reason"),
    )
    return _notices(rows, "grants-gov", "grant", as_of)


def normalise_procurement(raw: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """The same of a procurement publisher: what is not active, awarded, cancelled or over is closed; forecasts and all others need verification."""
    r = raw.select(F.from_json("value", PROCUREMENT_NOTICE).alias("r")).select("r.*")
    c = F.col
    url = F.concat(F.lit(PROCUREMENT_ROOT), c("noticeId"), F.lit("/view"))
    closes = F.coalesce("reponseDeadLine", "responseDeadLine")
    country = F.coalesce(F.when(c("placeOfPerformance.country.code").rlike("^[A-Za-z]{2}$"), F.upper("placeOfPerformance.country.code")), F.nullif("placeOfPerformance.country.name", F.lit("")), "placeOfPerformance.country.code")
    items = _evidence(
        url, ("SAM.gov notice ID", c("noticeId")), ("Opportunity title", c("title")), ("Issuing organization", F.coalesce("fullParentPathName", "department", "subtier")), ("Solicitation number", c("solicitationNumber")), ("Opportunity type", c("type")), ("Original opportunity type", c("baseType")),
        ("Active status", c("active")), ("Posted date", c("postedDate")), ("Response deadline", closes), ("Set-aside", c("setAside")), ("NAICS code", c("naicsCode")), ("Classification code", c("classificationCode")), ("Opportunity description link", c("description")), ("Place of performance country", country),
    )
    deadline, active = dates.publisher_date(closes), F.lower(F.coalesce("active", F.lit("")))
    kind = F.lower(F.concat_ws(" ", F.coalesce("type", F.lit("")), F.coalesce("baseType", F.lit(""))))
    status = F.when((active == "no") | kind.rlike(ENDED), "closed").when(kind.rlike("pre[- ]?solicitation|forecast"), "needs_verification").when((active == "yes") & _over(deadline, as_of), "closed").otherwise("needs_verification")
    reason = F.when(c("noticeId").isNull(), "record_identity_mismatch").when((F.length(_clean(c("title"))) > 2000) | (F.length(_clean(c("description"))) > 12_000), "text_exceeds_contract")
    rows = r.select(
        c("noticeId").alias("id"), url.alias("source_url"), _clean(c("title")).alias("title"), _clean(c("description")).alias("description"), dates.publisher_date(c("postedDate")).alias("published_at"), deadline.alias("deadline"), F.when(deadline.isNotNull(), "date_only").otherwise("unknown").alias("precision"),
        F.lit(None).cast("string").alias("deadline_local"), items.alias("evidence"), status.alias("status"), reason.alias("reason"),
    )
    return _notices(rows, "sam-gov", "procurement", as_of)


def normalise_bank(raw: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """The same of a bank that publishes for one country: others, other types, states and shapes are refused; nothing is called open. Adds the geography and the claim of identity that its notices carry."""
    r = raw.select(F.from_json("value", BANK_NOTICE).alias("r")).select("r.*").withColumn("_text", markup_text(F.col("notice_text")))
    c = F.col
    url, day, time = F.concat(F.lit(BANK_ROOT), c("id")), F.substring("submission_deadline_date", 1, 10), c("submission_deadline_time")
    title, published = T.collapse(F.coalesce("bid_description", F.lit(""))), dates.publisher_date(c("noticedate"))
    deadline = F.when(day.rlike(r"^20\d\d-\d\d-\d\d$"), F.try_to_date(day, "yyyy-MM-dd"))
    scope = F.transform(pieces(c("_text")), lambda t, k: F.struct(F.concat(F.lit("Publisher notice scope and requirements "), (k + 1).cast("string")).alias("label"), t.alias("text")))
    items = _evidence(
        url, scope, ("World Bank notice ID", c("id")), ("Project country", c("project_ctry_name")), ("Notice type", c("notice_type")), ("Notice status", c("notice_status")), ("Submission deadline date", c("submission_deadline_date")),
        ("Submission deadline time (timezone unstated)", time), ("Project", c("project_name")), ("Bid reference", c("bid_reference_no")),
    )
    shape = deadline.isNull() | published.isNull() | ~F.length(title).between(1, 2000) | (F.coalesce("notice_text", F.lit("")) == "")
    reason = (
        F.when(~F.coalesce(c("id").rlike(BANK_ID), F.lit(False)), "id_changed").when(~F.coalesce(c("project_ctry_name") == BANK_COUNTRY, F.lit(False)), "outside_scope").when(~F.coalesce(c("notice_type").isin(BANK_TYPES), F.lit(False)), "type_changed")
        .when(~F.coalesce(c("notice_status").isin(BANK_KEPT), F.lit(False)), "not_published").when(shape, "schema_changed").when(~F.length("_text").between(1, 12_000), "text_exceeds_contract").when(time.isNotNull() & ~time.rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), "deadline_time_invalid")
    )
    rows = r.select(
        "id", url.alias("source_url"), title.alias("title"), F.concat_ws(". ", title, F.nullif("project_name", F.lit("")), F.nullif("notice_type", F.lit(""))).alias("description"), published.alias("published_at"), deadline.alias("deadline"), F.when(time.isNotNull(), "local_datetime").otherwise("date_only").alias("precision"),
        F.when(time.isNotNull(), F.concat(day, F.lit("T"), time)).alias("deadline_local"), items.alias("evidence"), F.lit("needs_verification").alias("status"), reason.alias("reason"),
    )
    ok, refused = _notices(rows, "worldbank", "procurement", as_of)
    place = F.struct(F.lit("lebanon_confirmed").alias("status"), F.array(F.struct(F.lit("Project country").alias("label"), F.lit(BANK_COUNTRY).alias("text"), F.col("source_url").alias("url"))).alias("evidence"))
    claim = F.struct(F.lit("worldbank.org").alias("authority"), F.split_part("source_key", F.lit(":"), F.lit(2)).alias("reference"), F.lit("notice").alias("granularity"), F.lit(None).cast("string").alias("lotId"), F.col("source_url").alias("proofUrl"))
    return ok.withColumn("geography", place).withColumn("identity_claim", claim), refused


# Scopes of locations.
LOCATION_SCOPES = ["countries", "worldwide", "unknown"]


def location_shape(text: Column) -> Column:
    """JSON text holds locations: an object of an array of countryCodes, a scope and an array of evidence, filled as the scope asks for. Read as a variant; false for null and for what is no JSON."""
    v = F.try_parse_json(text)
    at = lambda path, kind: F.try_variant_get(v, path, kind)
    codes, evidence, scope = at("$.countryCodes", "array<variant>"), at("$.evidence", "array<variant>"), at("$.scope", "string")
    full, empty = (lambda a: F.size(a) > 0), (lambda a: F.size(a) == 0)
    shape = F.when(scope == "countries", full(codes) & full(evidence)).when(scope == "worldwide", empty(codes) & full(evidence)).when(scope == "unknown", empty(codes) & empty(evidence)).otherwise(False)
    return F.coalesce(codes.isNotNull() & evidence.isNotNull() & scope.isin(LOCATION_SCOPES) & shape, F.lit(False))


def read_narratives(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole Markdown files, without a comment at their head."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.input_file_name().alias("path"), F.regexp_replace("value", r"(?s)^\s*<!--.*?-->\s*", "").alias("text"))


def append(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append to a log that is never updated."""
    writer = rows.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_source_run(runs: DataFrame, path: str) -> None:
    append(runs.select("source", "started_at", "finished_at", "status", "records", "expected_total"), path)


def append_events(events: DataFrame, path: str) -> None:
    append(events.select("actor", "action", "entity", "entity_id", "detail", "created_at").withColumn("day", F.to_date("created_at")), path, ["day"])


def jdbc_table(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, parts: int, properties: dict | None = None) -> DataFrame:
    """A table of a database, read in ranges of its key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper, numPartitions=parts, properties=properties or {})


def union_feeds(feeds: list[DataFrame]) -> DataFrame:
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
