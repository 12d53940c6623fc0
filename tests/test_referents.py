"""Referents: golden cases of the rules of alignment, role, contrast and zone."""

import pytest

from ledgerloom.operators import referents

NAMES = ["Ash al-Hollow", "Quarne", "Council of Norwick"]
LONG = """## 1. APPLICANT IDENTIFICATION

| Field | Detail |
|---|---|
| Legal name | Sparrow Community Circle |
| Address | Norwick, Estland; active in Ash al-Hollow and Quarne (door number to follow) |

## 2. PROBLEM STATEMENT

Nobody has a record of where water stands in Ash al-Hollow and Quarne, and nobody answers for it. We show no counts that we have not taken.

## 3. PROPOSED ACTIVITIES

| 5 | Sign written arrangement with the Council of Norwick for pumping | 1-4 | Lead |

At month 12 the pumps pass to the Council of Norwick and the named wardens. No later donor is assumed.

## 6. RISK

- **Council does not pump on time.** Written arrangement signed in months 1-4, and a monthly contact.
"""


def run(spark, text, names):
    docs = spark.createDataFrame([(1, text)], "doc long, text string")
    offered = spark.createDataFrame([(1, n, k) for k, n in enumerate(names)], "doc long, name string, position int")
    found = referents.mentions(docs, offered, "doc", "text")
    scored = referents.scores(found, offered, "doc")
    rows = {(r.referent, r.said[:12]): r for r in found.collect()}
    return rows, {r.referent: r for r in scored.collect()}, referents.document_weights(scored, "doc").collect()


@pytest.fixture(scope="module")
def long(spark):
    return run(spark, LONG, NAMES)


def test_identification_weighs_nothing(long):
    rows, scored, (total,) = long
    address = [rows["Ash al-Hollow", "Norwick, Est"], rows["Quarne", "Norwick, Est"]]
    assert all(r.zone == "identification" and r.weight == 0 and r.survives for r in address)
    assert ("Council of Norwick", "Norwick, Est") not in rows  # a part of a name without its first token
    assert (total.offered, total.present, total.weight, total.findings) == (3, 3, 6.875, ["decorative"])


def test_counterparties_and_partial_subjects(long):
    rows, scored, _ = long
    sign = rows["Council of Norwick", "Sign written"]
    assert (sign.role, sign.zone, sign.survives, sign.surface, sign.weight) == ("counterparty", "table", False, "Council of Norwick", 0.5)
    later = rows["Council of Norwick", "At month 12 "]
    assert (later.role, later.survives, later.number, later.date, later.weight) == ("counterparty", False, True, True, 2.6)
    risk = rows["Council of Norwick", "- Council do"]
    assert (risk.role, risk.survives, risk.surface) == ("subject", False, "Council")
    council = scored["Council of Norwick"]
    assert (council.verdict, council.load_bearing, council.mentions, council.sections) == ("load_bearing", 3, 3, 2)


def test_second_conjunct_inherits_its_preposition(long):
    rows, scored, _ = long
    for name in ("Ash al-Hollow", "Quarne"):
        r = rows[name, "Nobody has a"]
        assert (r.role, r.survives, r.contrastive) == ("adjunct", True, False)
        assert scored[name].load_bearing == 0 and scored[name].weight > 0


def test_possessive_and_opening_words(spark):
    text = "## 1. APPLICANT IDENTIFICATION\n\n- **Address:** Ash al-Hollow, Norwick\n\n## 2. PROBLEM\n\nIn Ash al-Hollow's narrow lanes, carts cannot turn. They wait.\n"
    rows, scored, (total,) = run(spark, text, NAMES)
    r = rows["Ash al-Hollow", "In Ash al-Ho"]
    assert (r.surface, r.role, r.survives, r.begin) == ("Ash al-Hollow", "genitive", True, 4)
    assert scored["Ash al-Hollow"].verdict == "decorative" and scored["Quarne"].verdict == "absent"
    assert (total.present, total.load_bearing_referents, total.weighted_mentions, total.findings) == (1, 0, 1, ["no_load_bearing", "decorative"])


def test_contrast_belongs_to_the_name(spark):
    rows, _, _ = run(spark, "## 3. PLAN\n\n* Run two rounds each week in Ash al-Hollow and Quarne.\n\nWe hold two meetings (one in Ash al-Hollow, one in Quarne) in Month 1.\n", NAMES)
    assert not rows["Quarne", "* Run two ro"].contrastive and rows["Quarne", "* Run two ro"].survives
    assert rows["Ash al-Hollow", "We hold two "].contrastive and not rows["Quarne", "We hold two "].survives


def test_a_label_is_no_field_before_a_paragraph(spark):
    rows, _, _ = run(spark, "## 4. REACH\n\nDirect: 12 people from Ash al-Hollow, paid for shifts. We keep six places for women.\nSite office: Quarne\n", NAMES)
    direct = rows["Ash al-Hollow", "Direct: 12 p"]
    assert (direct.zone, direct.number) == ("prose", True) and direct.weight == 1.3
    assert (rows["Quarne", "Site office:"].zone, rows["Quarne", "Site office:"].weight) == ("field", 0)


def test_adjectives_are_no_names(spark):
    rows, _, _ = run(spark, "## 2. PROBLEM\n\nThere is strain between Estlandic host families and new ones.\n", ["Estlandic Ministry of Works"])
    assert not rows


def test_cue_ends_at_a_comma_and_most_tokens_win(spark):
    text = "## Q2. What is the problem?\n\nIn March 2025, Barrow Youth Team referred nine people to us, including six living in Ferry Bank. Norwick is small.\n"
    rows, _, _ = run(spark, text, ["Barrow Youth Team", "Ferry Bank", "Norwick", "Council of Norwick", "norwick"])
    assert rows["Barrow Youth Team", "In March 202"].role == "subject"
    bank = rows["Ferry Bank", "In March 202"]
    assert (bank.role, bank.survives, bank.date) == ("adjunct", True, True)
    assert rows["Norwick", "Norwick is s"].role == "subject" and ("Council of Norwick", "Norwick is s") not in rows


def test_abbreviations_and_emptiness(spark):
    rows, scored, (total,) = run(spark, "We meet Dr. Quarne today. Quarne agreed.", ["Quarne", "QUARNE!", None, ""])
    assert {said for _, said in rows} == {"We meet Dr. ", "Quarne agree"} and total.offered == 1
    for text in (None, "", "\n\n| |\n"):
        rows, scored, (total,) = run(spark, text, NAMES)
        assert not rows and total.weight == 0 and total.findings == [] and {r.verdict for r in scored.values()} == {"absent"}
    assert run(spark, LONG, [])[1:] == ({}, [])


def test_texts_are_split_once(spark):
    """Units and runs are worked out once and kept, not again for each join that reads them."""
    docs = spark.createDataFrame([(1, LONG), (2, LONG), (3, None)], "doc long, text string")
    offered = spark.createDataFrame([(1, n, k) for k, n in enumerate(NAMES)], "doc long, name string, position int")
    found = referents.mentions(docs, offered, "doc", "text")
    assert "posexplode" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.doc for r in found.collect()} == {1}
