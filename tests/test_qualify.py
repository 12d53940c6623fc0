"""Golden cases of states, kinds, places, identities and contracts."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import catalogue, qualify
from ledgerloom.schemas import NOTICE, PROFILE

EVIDENCE = "array<struct<label:string,text:string,url:string>>"
URL = "https://www.ungm.org/Public/Notice/77"
BANK = "https://projects.worldbank.org/en/projects-operations/procurement-detail/OP00012345"


def state(spark, *items):
    df = spark.createDataFrame([([(label, text, "u") for label, text in items],)], f"e {EVIDENCE}")
    return df.select(qualify.application_status(F.col("e")).alias("s")).first().s


def test_states_come_from_labelled_fields(spark):
    assert state(spark, ("Procurement method", "Direct  contracting")) == state(spark, ("طريقة التعاقد", "تعاقد مباشر")) == "not_open_competition"
    assert state(spark, ("Tender status :", " Awarded ")) == state(spark, ("حالة التلزيم", "ملغاة")) == "closed"
    assert state(spark, ("Status", "Open")) == state(spark, ("Title", "closed")) == state(spark, ("Status", "closed soon")) == state(spark, ("Status", "direct")) == state(spark) == "needs_verification"
    assert state(spark, ("Status", "cancelled"), ("Procurement method", "direct")) == "closed"


def test_kinds(spark):
    for text, want in (("Grant support-call for proposal", "grant"), ("Request for quotation (RFQ)", "procurement"), ("invitation to tender", "procurement"), ("Grant", "unknown"), ("A request for proposal", "unknown"), ("", "unknown")):
        assert spark.range(1).select(qualify.notice_kind(F.lit(text)).alias("k")).first().k == want


def row(spark, source="ungm", key="ungm:77", url=URL, claim=None, evidence=(), geography=None, locations=None):
    schema = f"source string, key string, url string, claim struct<authority:string,reference:string,granularity:string,lotId:string,proofUrl:string>, evidence {EVIDENCE}, geography struct<status:string,evidence:{EVIDENCE}>, locations struct<countryCodes:array<string>,scope:string,evidence:{EVIDENCE}>"
    df = spark.createDataFrame([(source, key, url, claim, list(evidence), geography, locations)], schema)
    c = F.col
    place = qualify.geography(c("source"), c("geography"), c("evidence"), c("url"))
    where = qualify.locations(c("source"), c("locations"), c("geography"), c("evidence"), c("url"))
    who = qualify.identity(c("source"), c("key"), c("url"), c("claim"), c("evidence"))
    return df.select(place.alias("place"), where.alias("where"), who.alias("who")).first()


def test_identity(spark):
    own = row(spark).who
    assert own.error is None and len(own.key) == 64 and own.authority == "ungm.org"
    assert row(spark, key="ungm:x7").who == (None, None, None, None)
    bank = ("worldbank.org", "OP00012345", "notice", None, BANK)
    assert row(spark, claim=bank).who.error == "proof_not_in_evidence"
    shown = [("Link", f"see ({BANK}), please", "u")]
    assert row(spark, claim=bank, evidence=shown).who.key == row(spark, source="eeas", key="e", url=BANK, claim=bank).who.key
    error = lambda *claim, **k: row(spark, claim=claim, **k).who.error
    assert error("worldbank.org", "OP7", "notice", None, "https://ungm.org/any/thing/OP7?x=1") == "host_of_other_authority" and error("other.org", "1", "notice", None, "https://other.org/1") == "host_of_other_authority"
    assert error("ungm.org", "77", "notice", None, URL + "?x=1") == error("ungm.org", "7", "notice", None, URL) == "reference_not_in_proof"
    assert error("ungm.org", "77", "lot", None, URL) == "lot_missing" and error("ungm.org", "77", "lot", "L9", URL) == "lot_not_in_evidence" and error("ungm.org", "77", "notice", "L9", URL) == "lot_unexpected"
    lots = [row(spark, claim=("ungm.org", "77", "lot", lot, URL), evidence=[("Lot number", " L9 ", "u"), ("Lot", "L8", "u")]).who.key for lot in ("L8", "L9")]
    assert None not in lots and len({*lots, own.key}) == 3


def test_geography(spark):
    both = [("Beneficiary countries or territories", "Lebanon, Jordan", "u")]
    assert row(spark, evidence=both).place.status == "regional_includes_lebanon" and row(spark, evidence=both).place.evidence == [both[0]]
    assert row(spark, evidence=[("Beneficiary countries or territories", "Lebanon", "u")]).place.status == "lebanon_confirmed"
    assert row(spark, evidence=[("Beneficiary countries or territories", "Jordan", "u")]).place.status == "unknown" and row(spark, source="eeas", evidence=both).place.status == "unknown"
    assert row(spark, source="ppa").place.evidence[0].url == URL and row(spark, source="mawred", evidence=[("Applicant origin", "any Arab country", "u")]).place.status == "regional_includes_lebanon"
    stated = lambda status, *items: row(spark, geography=(status, list(items)), evidence=[("a", "b", "c")]).place
    assert stated("outside_lebanon", ("a", "b", "c")).status == "outside_lebanon" and stated("unknown").status == "unknown"
    assert stated("outside_lebanon").error == "no_evidence" and stated("unknown", ("a", "b", "d")).error == "evidence_not_copied"


def test_locations(spark):
    named = [("Project country", "Lebanon", "u"), ("Beneficiary countries or territories", "Syria; Lebanon", "u")]
    assert row(spark, evidence=named).where.scope == "unknown"
    claimed = ("lebanon_confirmed", [named[0]])
    assert row(spark, evidence=named, geography=claimed).where == (["LB"], "countries", [named[0]])
    assert row(spark, evidence=[("Country", "Lebanon", "u")], geography=("lebanon_confirmed", [("Country", "Lebanon", "u")])).where.scope == "unknown"
    assert row(spark, source="ppa").where.countryCodes == ["LB"] and row(spark, locations=([], "worldwide", [("a", "b", "c")])).where.scope == "worldwide"


def test_notice_contract(spark):
    item = ("Label", "Text", URL)
    base = dict(source="ungm", sourceKey="ungm:77", sourceUrl=URL, title="T", description="", kind="grant", evidence=[item], fetchedAt=datetime.datetime(2024, 1, 1), contentHash="a" * 64, detailStatus="not_fetched", applicationStatus=None, locales=[])
    fields = [f.name for f in spark.createDataFrame([], NOTICE).schema.fields]

    def broken(**changes):
        rows = spark.createDataFrame([tuple({**dict.fromkeys(fields), **base, **changes}[f] for f in fields)], NOTICE)
        return catalogue.validate(rows, qualify.notice_rules()).first().reasons

    assert broken() == [] and broken(title="x" * 2000, sourceKey="k" * 250) == []
    assert broken(detailStatus="unavailable", title="", kind="tender") == ["title", "kind", "detailStatus"] and broken(sourceUrl="https://ungm.org.evil.example/x") == ["sourceUrl"] and broken(sourceUrl="http://www.ungm.org/x") == ["sourceUrl"]
    assert broken(evidence=[("L" * 201, "t", URL)]) == broken(evidence=[("L", "t", "https://mawred.org/x")]) == ["evidence"] and broken(applicationStatus="open") == ["applicationStatus"] and broken(contentHash="A" * 64) == ["contentHash"]
    assert broken(locations=(["LB", "LB"], "countries", [item])) == broken(locations=([], "countries", [item])) == broken(locations=(["LB"], "countries", [("o", "t", URL)])) == broken(locations=(["LB"], "unknown", [])) == ["locations"]
    assert broken(locations=(["LB"], "countries", [item])) == broken(locations=([], "worldwide", [item])) == broken(locations=([], "unknown", [])) == []
    assert broken(source="sam-gov", sourceUrl="https://sam.gov/x", evidence=[]) == ["locations"] and broken(identityClaim=("UNGM", "77", "notice", None, URL)) == ["identityClaim"]


def test_profile_contract(spark):
    base = dict(organizationName="A", organizationType="ngo", sectors=["s"], capabilities="", locations=["l"], alertsEnabled=True)
    fields = [f.name for f in spark.createDataFrame([], PROFILE).schema.fields]

    def broken(**changes):
        rows = spark.createDataFrame([tuple({**dict.fromkeys(fields), **base, **changes}[f] for f in fields)], PROFILE)
        return catalogue.validate(rows, qualify.profile_rules()).first().reasons

    assert broken() == [] and broken(organizationName="x" * 160, sectors=["s"] * 12, budgetMin=3, budgetMax=3, opportunityTypes=["grant"]) == []
    assert broken(organizationName="x" * 161) == ["organizationName"] and broken(sectors=["s"] * 13) == broken(sectors=[" "]) == broken(sectors=[]) == ["sectors"] and broken(organizationType="club") == ["organizationType"]
    assert broken(budgetMin=4, budgetMax=3) == ["budget"] and broken(budgetMin=-1) == ["budgetMin"] and broken(opportunityTypes=["tender"]) == broken(opportunityTypes=[]) == ["opportunityTypes"] and broken(languages=["x"] * 13, alertsEnabled=None) == ["alertsEnabled", "languages"]
