"""What a notice may say of its state, kind, place and identity, and the contracts of notices and profiles. Nothing is claimed that its evidence does not carry.

Edge cases: missing evidence is none; a claim that breaks a rule gives an error in place of a value; white space at the ends and in runs does not tell texts apart where labels and states are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import LOCALES

# The hosts of each publisher.
SOURCE_HOSTS = {
    "cdr": ["cdr.gov.lb", "www.cdr.gov.lb"], "ppa": ["ppa.gov.lb", "www.ppa.gov.lb"], "japan-ggp": ["www.lb.emb-japan.go.jp"], "australia-dap": ["lebanon.embassy.gov.au"], "czech-ssp": ["mzv.gov.cz"], "canada-cfli": ["www.international.gc.ca"],
    "eeas": ["www.eeas.europa.eu"], "aics": ["trasparenzabeirut.aics.gov.it"], "undp": ["procurement-notices.undp.org"], "ungm": ["www.ungm.org"], "mawred": ["mawred.org"], "worldbank": ["projects.worldbank.org"], "grants-gov": ["grants.gov", "www.grants.gov"],
    "sam-gov": ["sam.gov", "www.sam.gov"],
}
# Authorities of identity, the host of their proofs, and where the reference stands in its path.
AUTHORITIES = {
    "ppa.gov.lb": ("ppa.gov.lb", r"/(?:en|ar)/tenders/details/(\d+)"),
    "ungm.org": ("ungm.org", r"/Public/Notice/(\d+)"),
    "worldbank.org": ("projects.worldbank.org", r"/en/projects-operations/procurement-detail/(OP\d+)"),
}
# Labels of method and status, states that close a notice, and methods without open competition.
STATE_LABEL = r"(?iu)^(?:Procurement method|Procuring Method|طريقة الشراء|طريقة التلزيم|طريقة التعاقد|Status|Tender status|Procurement status|حالة المناقصة|حالة التلزيم)\s*:?$"
CLOSED_STATES = ["awarded", "cancelled", "canceled", "closed", "ملغاة", "ملغي", "ألغيت", "ألغى", "منتهية", "تم التلزيم", "مرساة"]
DIRECT_METHODS = ["direct", "direct contracting", "direct award", "consensual", "بالتراضي", "تعاقد مباشر", "تلزيم مباشر"]
# Types of notice by kind.
GRANT_TYPE = r"(?i)^Grant support-call for proposal$"
PROCUREMENT_TYPE = r"(?i)^(?:Request for proposal|Request for quotation|Invitation to bid|Expression of interest|Request for information|Invitation for pre-qualification|Request for proposals|Invitation to tender)"
# States of geography, evidence labels of places, and the country that the catalogue is about.
COUNTRY, COUNTRY_CODE = "Lebanon", "LB"
CONFIRMED, REGIONAL, UNKNOWN, OUTSIDE = "lebanon_confirmed", "regional_includes_lebanon", "unknown", "outside_lebanon"
PORTAL = "Lebanon Public Procurement Authority official portal"
_NAMED, _BENEFICIARY = rf"(?i)(^|[,;\s]){COUNTRY}($|[,;\s])", "beneficiary countries or territories"
# Contents of the contracts.
SOURCE_KINDS, DETAIL_STATES, APPLICATION_STATES = ["procurement", "grant", "unknown"], ["not_fetched", "partial", "verified"], ["needs_verification", "not_open_competition", "closed"]
ORGANISATION_TYPES, OPPORTUNITY_TYPES, MOST_BUDGET = ["company", "ngo", "individual", "public_body"], ["procurement", "grant"], 2147483647


def _items(evidence: Column) -> Column:
    return F.coalesce(evidence, F.array().cast("array<struct<label:string,text:string,url:string>>"))


def application_status(evidence: Column) -> Column:
    """closed or not_open_competition as fields labelled as status or method say in one of their fixed words, else needs_verification; nothing is called open."""
    fields = F.filter(_items(evidence), lambda e: T.collapse(e["label"]).rlike(STATE_LABEL))
    says = lambda label, words: F.exists(fields, lambda e: e["label"].rlike(label) & F.lower(T.collapse(e["text"])).isin(words))
    return F.when(says("(?i)status|حالة", CLOSED_STATES), "closed").when(says("(?i)method|طريقة", DIRECT_METHODS), "not_open_competition").otherwise("needs_verification")


def notice_kind(kind_text: Column) -> Column:
    return F.when(kind_text.rlike(GRANT_TYPE), "grant").when(kind_text.rlike(PROCUREMENT_TYPE), "procurement").otherwise("unknown")


def _item(label: str, text: str, url: Column) -> Column:
    return F.array(F.struct(F.lit(label).alias("label"), F.lit(text).alias("text"), url.alias("url")))


def geography(source: Column, stated: Column, evidence: Column, source_url: Column) -> Column:
    """(status, evidence, error): what is stated, if its evidence is copied from the notice's; else what the publisher is known for, or names."""
    items = _items(evidence)
    own = _items(stated["evidence"])
    none = F.filter(items, lambda _: F.lit(False))
    answer = lambda status, why, error: F.struct(status.alias("status"), why.alias("evidence"), error.cast("string").alias("error"))
    copied = F.forall(own, lambda e: F.array_contains(items, e))
    error = F.when(~copied, "evidence_not_copied").when((stated["status"] != UNKNOWN) & (F.size(own) == 0), "no_evidence")
    field = F.filter(items, lambda e: e["label"].rlike(f"(?i){_BENEFICIARY}"))
    named = (source == "ungm") & (F.size(field) > 0) & F.coalesce(F.get(field, 0)["text"].rlike(_NAMED), F.lit(False))
    countries = F.filter(F.transform(F.split(F.get(field, 0)["text"], "[,;]"), lambda c: F.trim(c)), lambda c: c != "")
    origin = F.filter(items, lambda e: e["label"].rlike("(?i)Applicant origin") & e["text"].rlike("(?i)Arab country"))
    no = F.lit(None)
    return (
        F.when(stated.isNotNull() & error.isNotNull(), answer(F.lit(None).cast("string"), none, error)).when(stated.isNotNull(), answer(stated["status"], own, no))
        .when(source == "ppa", answer(F.lit(CONFIRMED), _item("Publisher jurisdiction", PORTAL, source_url), no))
        .when(named, answer(F.when(F.size(countries) == 1, CONFIRMED).otherwise(REGIONAL), F.slice(field, 1, 1), no))
        .when((source == "mawred") & (F.size(origin) > 0), answer(F.lit(REGIONAL), F.slice(origin, 1, 1), no))
        .otherwise(answer(F.lit(UNKNOWN), none, no))
    )


def locations(source: Column, stated: Column, stated_geography: Column, evidence: Column, source_url: Column) -> Column:
    """(countryCodes, scope, evidence): what is stated; else the publisher's jurisdiction; else an older claim whose evidence names the project's country."""
    items = _items(evidence)
    place = lambda label: F.lower(F.trim(label))
    explicit = F.filter(items, lambda e: (place(e["label"]).isin("project country", "country of implementation", _BENEFICIARY)) & ((F.trim(e["text"]) == COUNTRY) | ((place(e["label"]) == _BENEFICIARY) & e["text"].rlike(_NAMED))))
    claimed = F.coalesce(stated_geography["status"].isin(CONFIRMED, REGIONAL), F.lit(False)) & (F.size(explicit) > 0)
    answer = lambda codes, scope, why: F.struct(codes.alias("countryCodes"), F.lit(scope).alias("scope"), why.alias("evidence"))
    here, no_codes = F.array(F.lit(COUNTRY_CODE)), F.array().cast("array<string>")
    return (
        F.when(stated.isNotNull(), F.struct(stated["countryCodes"].alias("countryCodes"), stated["scope"].alias("scope"), stated["evidence"].alias("evidence")))
        .when(source == "ppa", answer(here, "countries", _item("Procurement jurisdiction", PORTAL, source_url)))
        .when(claimed, answer(here, "countries", F.slice(explicit, 1, 1))).otherwise(answer(no_codes, "unknown", F.filter(items, lambda _: F.lit(False))))
    )


def identity(source: Column, source_key: Column, source_url: Column, claim: Column, evidence: Column) -> Column:
    """(authority, reference, key, error): the digest of authority, reference, granularity and lot, or why there is none; nothing at all without a claim, own or by the publisher's key."""
    items = _items(evidence)
    numbered = source.isin("ppa", "ungm") & F.coalesce(source_key.rlike(r"^(ppa|ungm):\d+$") & F.startswith(source_key, F.concat(source, F.lit(":"))), F.lit(False))
    by_key = F.when(numbered, F.struct(F.when(source == "ppa", "ppa.gov.lb").otherwise("ungm.org").alias("authority"), F.split_part(source_key, F.lit(":"), F.lit(2)).alias("reference"), F.lit("notice").alias("granularity"), F.lit(None).cast("string").alias("lotId"), source_url.alias("proofUrl")))
    c = F.coalesce(F.when(claim.isNotNull(), F.struct(*[claim[f].alias(f) for f in ("authority", "reference", "granularity", "lotId", "proofUrl")])), by_key)
    pick = lambda of: reduce(lambda rest, a: F.when(c["authority"] == a, of(a)).otherwise(rest), AUTHORITIES, F.lit(None).cast("string"))
    official = pick(lambda a: F.lit(AUTHORITIES[a][0]))
    reference = pick(lambda a: F.regexp_extract(c["proofUrl"], rf"^https://[^/?#]+{AUTHORITIES[a][1]}$", 1))
    shown = F.exists(items, lambda e: F.exists(F.regexp_extract_all(e["text"], F.lit(r"https://[^\s<>\"']+"), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;)]+$", "") == c["proofUrl"]))
    lot = F.coalesce(c["lotId"], F.lit(""))
    lot_shown = F.exists(items, lambda e: F.lower(F.trim(e["label"])).isin("lot", "lot id", "lot number", "lot reference") & (F.trim(e["text"]) == lot))
    error = (
        F.when(c.isNull(), F.lit(None)).when(~F.coalesce(T.host(c["proofUrl"]) == official, F.lit(False)), "host_of_other_authority").when(~F.coalesce(reference == c["reference"], F.lit(False)), "reference_not_in_proof")
        .when((c["proofUrl"] != source_url) & ~F.coalesce(shown, F.lit(False)), "proof_not_in_evidence").when((c["granularity"] == "lot") & (lot == ""), "lot_missing")
        .when((c["granularity"] == "lot") & ~F.coalesce(lot_shown, F.lit(False)), "lot_not_in_evidence").when((c["granularity"] != "lot") & (lot != ""), "lot_unexpected")
    )
    key = F.sha2(F.to_json(F.array(c["authority"], c["reference"], c["granularity"], lot)), 256)
    return F.struct(c["authority"].alias("authority"), c["reference"].alias("reference"), F.when(c.isNotNull() & error.isNull(), key).alias("key"), error.alias("error"))


def qualified_hash(content_hash: Column, place: Column, where: Column, key: Column) -> Column:
    """Digest of all that a notice was qualified by, the evidence of its geography and locations included."""
    quoted = lambda c: F.coalesce(F.concat(F.lit('"'), c, F.lit('"')), F.lit("null"))
    parts = [F.lit('"catalogue-qualification-v1"'), quoted(content_hash), quoted(place["status"]), F.to_json(place["evidence"]), F.to_json(where), quoted(key)]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), 256)


def paired(source: Column, url: Column) -> Column:
    """The URL is https and on a host of its publisher."""
    host = F.lower(F.regexp_extract(url, r"^https://([^/?#@:]+)(?:[/?#]|$)", 1))
    return F.coalesce(reduce(lambda rest, s: F.when(source == s, host.isin(SOURCE_HOSTS[s])).otherwise(rest), SOURCE_HOSTS, F.lit(False)), F.lit(False)) & (F.length(url) <= 2000)


def notice_rules() -> dict[str, Column]:
    """The contract of a notice, over columns of the schema NOTICE."""
    c = F.col
    size = lambda name, most: F.size(_items(c(name))) <= most
    sound = lambda items, source: F.forall(_items(items), lambda e: (F.length(e["label"]) <= 200) & (F.length(e["text"]) <= 12000) & paired(source, e["url"]))
    codes, why = F.coalesce(c("locations.countryCodes"), F.array().cast("array<string>")), _items(c("locations.evidence"))
    shape = (
        F.when(c("locations").isNull(), ~c("source").isin("grants-gov", "sam-gov")).when(c("locations.scope") == "countries", (F.size(codes) > 0) & (F.size(why) > 0))
        .when(c("locations.scope") == "worldwide", (F.size(codes) == 0) & (F.size(why) > 0)).when(c("locations.scope") == "unknown", (F.size(codes) == 0) & (F.size(why) == 0)).otherwise(False)
    )
    locales = F.coalesce(c("locales"), F.array().cast(LOCALES))
    return {
        "source": c("source").isin(*SOURCE_HOSTS), "sourceKey": F.length("sourceKey").between(1, 250), "sourceUrl": paired(c("source"), c("sourceUrl")), "title": F.length("title").between(1, 2000), "description": F.length("description") <= 60000,
        "kind": c("kind").isin(SOURCE_KINDS), "evidence": size("evidence", 100) & sound(c("evidence"), c("source")), "geography": c("geography").isNull() | (c("geography.status").isin(CONFIRMED, REGIONAL, UNKNOWN, OUTSIDE) & (F.size(_items(c("geography.evidence"))) <= 20)),
        "locations": shape & (F.size(codes) == F.size(F.array_distinct(codes))) & F.forall(codes, lambda x: x.rlike("^[A-Z]{2}$")) & F.forall(why, lambda e: F.array_contains(_items(c("evidence")), e)),
        "identityClaim": c("identityClaim").isNull() | (c("identityClaim.authority").rlike("^[a-z0-9.-]{3,100}$") & c("identityClaim.reference").rlike("^[A-Za-z0-9][A-Za-z0-9._:/-]{0,119}$") & c("identityClaim.granularity").isin("notice", "lot") & (F.coalesce(F.length("identityClaim.lotId"), F.lit(1)).between(1, 120))),
        "fetchedAt": c("fetchedAt").isNotNull(), "contentHash": c("contentHash").rlike("^[a-f0-9]{64}$"), "detailStatus": F.coalesce("detailStatus", F.lit("not_fetched")).isin(DETAIL_STATES), "applicationStatus": F.coalesce("applicationStatus", F.lit("needs_verification")).isin(APPLICATION_STATES),
        "locales": (F.size(locales) <= 4) & F.forall(locales, lambda x: (F.length(x["locale"]) <= 10) & (F.length(x["title"]) <= 2000) & (F.length(x["description"]) <= 60000) & paired(c("source"), x["sourceUrl"]) & sound(x["evidence"], c("source"))),
    }


def profile_rules() -> dict[str, Column]:
    """The contract of a member's profile, over columns of the schema PROFILE; columns that may be left out are null."""
    c = F.col
    short = lambda name, least, most: F.size(c(name)).between(least, most) & F.forall(c(name), lambda x: F.length(F.trim(x)).between(1, 100))
    optional = lambda name, most: c(name).isNull() | short(name, 0, most)
    text = lambda name, least, most: F.length(F.trim(c(name))).between(least, most)
    budget = lambda name: c(name).isNull() | c(name).between(0, MOST_BUDGET)
    return {
        "organizationName": text("organizationName", 1, 160), "organizationType": c("organizationType").isin(ORGANISATION_TYPES), "sectors": short("sectors", 1, 12), "capabilities": text("capabilities", 0, 4000), "locations": short("locations", 1, 10),
        "alertsEnabled": c("alertsEnabled").isNotNull(), "pastWork": F.length(F.trim(F.coalesce("pastWork", F.lit("")))) <= 2000, "teamCapacity": F.length(F.trim(F.coalesce("teamCapacity", F.lit("")))) <= 500, "languages": optional("languages", 12),
        "budgetMin": budget("budgetMin"), "budgetMax": budget("budgetMax"), "qualifications": optional("qualifications", 20), "interests": optional("interests", 20), "excludedWork": optional("excludedWork", 20),
        "opportunityTypes": c("opportunityTypes").isNull() | (F.size("opportunityTypes").between(1, 2) & F.forall("opportunityTypes", lambda x: x.isin(OPPORTUNITY_TYPES))), "budget": c("budgetMin").isNull() | c("budgetMax").isNull() | (c("budgetMax") >= c("budgetMin")),
    }
