"""Audits of documents against a ledger: names, numbers, limits, contacts, layout, jargon."""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..functions.batches import slices

# Words that are capitalised for grammar or genre, not because they name anything.
NOT_NAMES = [
    "The", "This", "That", "These", "Those", "A", "An", "And", "But", "Or", "If", "When", "While", "Where", "We", "Our", "It", "Its", "They", "Their", "There", "In", "On", "At", "For", "To", "From", "By", "With", "As", "After", "Before",
    "During", "Over", "Under", "Between", "Each", "Every", "All", "Both", "Most", "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December", "Monday", "Tuesday", "Wednesday",
    "Thursday", "Friday", "Saturday", "Sunday", "Year", "Month", "Week", "Day", "Phase", "Output", "Outcome", "Goal", "Objective", "Activity", "Activities", "Indicator", "Indicators", "Target", "Targets", "Budget", "Risk", "Risks",
    "Mitigation", "Assumptions", "Level", "Statement", "Means", "Verification", "Milestone", "Total", "Subtotal", "Note", "Notes", "Project", "Programme", "Program", "Proposal", "Organisation", "Organization", "Foundation", "Fund", "Trust",
    "Grant", "Donor", "Beneficiaries", "Participants", "Staff", "Board", "Annex", "Appendix", "Introduction", "Background", "Summary", "Conclusion", "Sustainability", "Methodology", "Approach", "Recorded",
]
# Phrases that count as jargon when they repeat.
JARGON = [
    "transformative", "groundbreaking", "holistic(?:ally)?", "robust framework", r"catalys(?:e|t|ing|ze)\w* change", r"leverag\w+ synerg\w+", "empower(?:ing|s)? communities", "foster(?:ing)? collaboration",
    "sustainable ecosystem", "multifaceted approach", "paradigm shift", "cutting[- ]edge", "state[- ]of[- ]the[- ]art", r"synergist\w+",
]
# Wording of submission mechanics, which are not content; of lower-case text.
PROCESS = [
    r"\bsubmit(ted|ting|ssion)?\b.*\b(application|form|proposal|portal|online|by \d|deadline|before)\b",
    r"\bapplication\b.*\bdeadline\b|\bclosing date\b",
    r"\bapplication (must |should )?(be )?(submitted|received|in|complete)\b",
    r"(submit|received|due|apply|application).{0,30}\bby \d{1,2}(:\d{2})?\s*(am|pm)\b|(submit|received|due|apply|application).{0,40}\bby \d{1,2}(st|nd|rd|th)?\s+\w+\s+\d{4}\b",
    r"read (the |through )?(the )?guidance|guidance (document|notes)\b",
    r"\b(do not|don't|never) (rely on|use|depend on)\b.*\b(ai|artificial intelligence|chatgpt|language model)\b",
    r"\bcomplete (the|your) (online )?(form|application|portal)\b|\bapply (online|through the portal)\b",
    r"\bsign(ed)?\b.*\bdeclaration\b|\bdeclaration\b.*\bsign",
    r"\bcreate an account\b|\bregister (on|for) the portal\b|\blog ?in to\b",
    r"\bcontact (us|the team|the foundation)\b.*\bbefore\b",
]
# Signs of currencies, the first of equals first; dollars count as written only. A site's end adds two votes.
CURRENCIES = {"GBP": r"(?i)£|\bGBP\b|\bpounds?\b|\bsterling\b", "EUR": r"(?i)€|\bEUR\b|\beuros?\b", "USD": r"\bUSD\b|\bUS\$|\bdollars?\b"}
SITE_CURRENCY, SITE_END, SITE_VOTES = "GBP", r"(?i)\.uk\b", 2
# Bounds of a stated limit, readings that state none, and words that may stand before a grouped number.
LIMITS = {"max_words": (25, 100_000), "max_pages": (1, 200)}
STATES_NONE = ["n/a", "n.a.", "na", "none", "no limit", "no word limit", "no page limit", "not stated", "not specified", "not applicable", "unspecified", "unstated", "not given", "no maximum", "null", "nil", "-", "--", "—"]
BEFORE_GROUPS = [
    "max", "maximum", "maximal", "maximo", "máximo", "up", "to", "upto", "no", "more", "than", "not", "exceed", "exceeding", "limit", "limited", "of", "at", "most", "approx", "approximately", "about", "around", "circa", "roughly", "word",
    "words", "count", "total", "in", "under", "below", "within", "please", "keep", "answer", "answers", "must", "be", "hasta", "jusqu", "jusqua", "environ", "bis", "hoechstens", "höchstens", "etwa", "und", "the", "a", "an",
]
WORD_UNIT, PAGE_UNIT = r"\b(words?|wordcount|mots?|palabras?|w[oö]rter|worte|parole|palavras?|slov)\b", r"\b(pages?|sides?|sheets?|seiten|p[aá]ginas?|feuillets?|folios?)\b"
OTHER_UNIT = r"\b(characters?|chars?|signs?|bytes?|kb|mb|keystrokes?|lines?|paragraphs?|sentences?|slides?|minutes?|mins?|hours?|zeichen|caracteres?|caract[eè]res?)\b|%"
MONEY, AT_LEAST = r"[$£€¥₹]|\b(usd|eur|gbp|chf|aed|sar|cad|aud|jpy|dollars?|euros?|pounds?)\b", r"\b(at least|minimum|minimo|mínimo|no fewer than|no less than|not less than|not fewer than|at a minimum|lower limit|min)\b"
SHARED_OUT = r"\b(per|for each|for every) (section|question|answer|response|part|heading|item|criterion|criteria|page|chapter|box|field|attachment)\b|\b(each|every) (section|question|answer|response|part|heading|item)\b"
NUMERALS = r"\b(zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fourty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million)\b"
PAGE_SIZE = r"\b(a[3-6]|b[45]|letter|legal|foolscap|tabloid)\b"
# Section names that leave the count without being supplied; paragraph and section bounds in words.
ATTACHMENTS = ["budget", "budget table", "budget summary", "attached budget table", "declaration", "declarations", "annex", "annexes", "appendix", "appendices", "attachment", "attachments", "signature", "signatures", "signatory", "signatories", "supporting document", "supporting documents", "supporting information"]
PROSE_WORDS, SECTION_WORDS = 25, 250

# Fixed value: a run of capitalised words.
_NAME = re.compile(r"[A-Z][\w'’-]*(?:[ \t]+(?:(?:of|the|de|al|bin|van|von|du|la|le|el)[ \t]+[A-Z]|[a-z]{1,3}[-'’][A-Z]|[A-Z])[\w'’-]*)*")
_OPENS_LINE = re.compile(r"[\s>#*_+|-]*(?:\d+[.)][\s>#*_+|-]*)?")
_ENDS_SENTENCE = re.compile(r"[.!?:;][\"'”’)\]]*[\s*_]*$")


def _plain(markdown: str) -> str:
    """Markdown without its furniture; headings and cells end like sentences and stand on lines of their own."""
    lines = []
    for line in markdown.split("\n"):
        bare = line.strip(" \t")
        if bare.startswith("|") and bare.endswith("|") and len(bare) > 1:
            if set(bare) - set(" \t:|-"):
                lines += [f"{c.strip()}." for c in bare[1:-1].split("|") if c.strip()]
        elif m := re.fullmatch(r"#{1,6}[ \t]+(.*)", bare):
            lines.append(m[1] + ".")
        else:
            lines.append(line)
    return re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", re.sub(r"`[^`]*`", " ", "\n".join(lines)))


def name_runs(text: str | None) -> list[dict]:
    """Runs of capitalised words, and whether they opened a line, opened a sentence, or stood inside one."""
    text, found, skip = _plain(text or ""), {}, set(NOT_NAMES)
    for m in _NAME.finditer(text):
        begin = text.rfind("\n", 0, m.start()) + 1
        line = _OPENS_LINE.fullmatch(text, begin, m.start()) is not None
        sentence = not line and _ENDS_SENTENCE.search(text, max(begin, m.start() - 40), m.start()) is not None
        words = m[0].split()
        while words and words[0] in skip:
            words.pop(0)
        while words and words[-1] in skip:
            words.pop()
        phrase = " ".join(words)
        if len(phrase) >= 3:
            at = found.setdefault(phrase, {"phrase": phrase, "line_start": False, "sentence_start": False, "mid_sentence": False})
            at["line_start" if line else "sentence_start" if sentence else "mid_sentence"] = True
    return list(found.values())


RUN = "phrase string, line_start boolean, sentence_start boolean, mid_sentence boolean"


def proper_nouns(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, phrase, line_start, sentence_start, mid_sentence): one row for each different run of a document."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            rows = [(i, *r.values()) for i, t in zip(batch[id_col], batch[text_col], strict=True) for r in name_runs(t)]
            yield pd.DataFrame(rows, columns=[id_col, "phrase", "line_start", "sentence_start", "mid_sentence"])

    return documents.select(id_col, text_col).mapInPandas(work, f"`{id_col}` {documents.schema[id_col].dataType.simpleString()}, {RUN}")


def name_containment(runs: DataFrame, ledger: DataFrame, owner: str, run_id: str = "phrase") -> DataFrame:
    """(owner, phrase, name): ledger names that hold every token of a run.

    Names are looked for by the run's token that fewest of the owner's names have, and then compared; a run with a token that no name has is in none. So a frequent token makes no candidates unless a run has no other.

    runs: (owner, phrase); ledger: (owner, name).
    """
    of = lambda df, c: df.select(owner, c).distinct().withColumn("_tokens", T.name_tokens(F.col(c)))
    names = of(ledger, "name").select(owner, "name", F.col("_tokens").alias("_held"), F.explode("_tokens").alias("token"))
    counts = names.groupBy(owner, "token").agg(F.count("*").alias("_names"))
    asked = of(runs, run_id).select(owner, run_id, "_tokens", F.explode("_tokens").alias("token")).join(counts, [owner, "token"], "left")
    rare = asked.groupBy(owner, run_id, "_tokens").agg(F.min(F.struct("_names", "token")).alias("_r"), F.count_if(F.col("_names").isNull()).alias("_missing")).where("_missing = 0")
    found = rare.select(owner, run_id, "_tokens", F.col("_r.token").alias("token")).join(names, [owner, "token"])
    return found.where(F.size(F.array_except("_tokens", "_held")) == 0).select(owner, run_id, "name")


def audit_names(runs: DataFrame, ledger: DataFrame, own_names: DataFrame, owner: str) -> DataFrame:
    """Adds verdict to (owner, phrase, line_start, sentence_start, mid_sentence): used, ignored or unsourced.

    A run that opens a line or sentence is also tried without its first word. ledger, own_names: (owner, name).
    """
    rest = F.when(F.col("line_start") | F.col("sentence_start"), F.nullif(F.regexp_replace("phrase", r"^[^ ]+ ?", ""), F.lit("")))
    rows = runs.withColumn("_rest", rest)
    tried = rows.select(owner, "phrase").unionByName(rows.where("_rest is not null").select(owner, F.col("_rest").alias("phrase"))).distinct()
    shouted = lambda df: df.where(F.col("name") != F.upper("name"))
    sourced = name_containment(tried, shouted(ledger), owner).select(owner, F.col("phrase").alias("_p"), F.lit(True).alias("_ok")).distinct()
    own = name_containment(tried, own_names, owner).select(owner, F.col("phrase").alias("_p"), F.lit(True).alias("_ok")).distinct()

    def flag(df: DataFrame, hits: DataFrame, column: str, name: str) -> DataFrame:
        return df.join(hits.select(owner, F.col("_p").alias(column), F.col("_ok").alias(name)), [owner, column], "left")

    rows = flag(flag(flag(rows, own, "phrase", "_own"), sourced, "phrase", "_used"), sourced, "_rest", "_rest_used")
    verdict = (
        F.when(F.col("_own").isNotNull(), "ignored")
        .when(F.col("_used").isNotNull() | F.col("_rest_used").isNotNull(), "used")
        .when(~F.contains("phrase", F.lit(" ")) & ~F.col("mid_sentence"), "ignored")
        .when(F.col("phrase") == F.upper("phrase"), "ignored")
        .otherwise("unsourced")
    )
    return rows.withColumn("verdict", verdict).select(owner, "phrase", "line_start", "sentence_start", "mid_sentence", "verdict")


def ledger_referents(ledger: DataFrame, own_names: DataFrame, owner: str) -> DataFrame:
    """(owner, phrase) of names in a ledger's claims that are not the applicant's own. ledger: (owner, claim); own_names: (owner, name)."""
    runs = proper_nouns(ledger, owner, "claim").where(F.col("phrase") != F.upper("phrase")).select(owner, "phrase").distinct()
    own = name_containment(runs, own_names, owner).select(owner, "phrase").distinct()
    return runs.join(own, [owner, "phrase"], "left_anti")


def site_referents(pages: DataFrame, own_names: DataFrame, site: str, text: str) -> DataFrame:
    """(site, phrase) of names of up to six words, less the site's own, and less single words that the site also writes in lower case."""
    edge = r"^((of|the|and|for|de|la|le|du|el|al|van|von|bin) )+|( (of|the|and|for|de|la|le|du|el|al|van|von|bin))+$"
    runs = proper_nouns(pages, site, text).where(F.col("phrase") != F.upper("phrase")).select(site, F.regexp_replace("phrase", edge, "").alias("phrase")).distinct()
    runs = runs.where((F.size(F.split("phrase", " ")) <= 6) & (F.col("phrase") != ""))
    lower = pages.select(site, F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?<![\p{L}\p{N}])(\p{Ll}[\p{L}\p{N}'’-]*)"), F.lit(1))).alias("_w")).distinct()
    single = runs.where(~F.contains("phrase", F.lit(" "))).withColumn("_w", F.lower("phrase")).join(lower, [site, "_w"], "left_anti").select(site, "phrase")
    found = runs.where(F.contains("phrase", F.lit(" "))).unionByName(single)
    own = name_containment(found, own_names, site).select(site, "phrase").distinct()
    return found.join(own, [site, "phrase"], "left_anti")


def budget_totals(lines: DataFrame, key: str, envelope: DataFrame, slack: float = 0.02) -> DataFrame:
    """(key, total, envelope, within): sum of quantity times unit cost against the envelope. lines: (key, quantity, unit_cost)."""
    g = lines.groupBy(key).agg(F.sum(F.col("quantity") * F.col("unit_cost")).alias("total"))
    return g.join(envelope, key).select(key, "total", "envelope", (F.abs(F.col("total") - F.col("envelope")) <= F.col("envelope") * slack).alias("within"))


def admissible(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Adds refusal to register leaves (register_id, node_id, value, unit_kind, basis, source_ref): a cited item must carry the number, an estimate must not be too precise, money must be positive.

    evidence: (source_ref, number).
    """
    carried = nodes.join(evidence.select("source_ref", F.col("number").alias("value"), F.lit(True).alias("_carried")).distinct(), ["source_ref", "value"], "left")
    precise = (F.col("value") >= 100) & (T.significant_figures(F.col("value").cast("long")) > 2)
    rule = F.when((F.col("basis") == "evidence") & F.col("_carried").isNull(), "not_in_evidence").when((F.col("basis") == "estimate") & precise, "pseudo_precision").when((F.col("unit_kind") == "money") & (F.col("value") <= 0), "money_not_positive")
    return carried.withColumn("refusal", rule).drop("_carried")


def evidence_use(offered: DataFrame, used: DataFrame, owner: str, item: str) -> DataFrame:
    """(owner, offered, used, finding): at least 3 offered and less than half used."""
    n = offered.groupBy(owner).agg(F.count_distinct(item).alias("offered"))
    u = used.groupBy(owner).agg(F.count_distinct(item).alias("used"))
    joined = n.join(u, owner, "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return joined.withColumn("finding", (F.col("offered") >= 3) & (F.col("used") * 2 < F.col("offered")))


def jargon(documents: DataFrame, id_col: str, text_col: str, phrases: list[str] = JARGON) -> DataFrame:
    """(id, total, repeated, finding): a phrase twice or more, or five phrases in all. phrases are patterns."""
    pattern = r"(?i)\b((?:" + "|".join(phrases) + r"))\b"
    each = documents.select(id_col, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(1))).alias("p")).groupBy(id_col, F.lower("p").alias("p")).agg(F.count("*").alias("n"))
    return each.groupBy(id_col).agg(F.sum("n").alias("total"), F.count(F.when(F.col("n") >= 2, 1)).alias("repeated")).withColumn("finding", (F.col("repeated") > 0) | (F.col("total") >= 5))


def currency_vote(text: Column, site: Column) -> Column:
    """The currency with most signs in the text and the address of the site, whose end may add votes; USD where none has any."""
    told = F.concat_ws(" ", F.coalesce(text, F.lit("")), F.coalesce(site, F.lit("")))
    votes = {c: F.regexp_count(told, F.lit(signs)) for c, signs in CURRENCIES.items()}
    votes[SITE_CURRENCY] = votes[SITE_CURRENCY] + F.when(site.rlike(SITE_END), SITE_VOTES).otherwise(0)
    most = F.greatest(*votes.values())
    return F.when(most == 0, "USD").otherwise(F.coalesce(*[F.when(votes[c] == most, c) for c in votes]))


def numeric_consistency(claims: DataFrame, design: DataFrame, evidence: DataFrame, owner: str) -> DataFrame:
    """(owner, number, finding): claimed participants over the design's total by more than 1 %, or under it by more than that and still half of it at least, unless evidence has the number. Less than half is a part, not a total.

    claims: (owner, number); design: (owner, total); evidence: (owner, number). A design without a total, or with 0, says nothing.
    """
    told = claims.join(evidence.select(owner, "number").distinct(), [owner, "number"], "left_anti").join(design.where("total > 0"), owner)
    slack = F.col("total") * 0.01
    finding = F.when(F.col("number") > F.col("total") + slack, "above_total").when((F.col("number") >= F.col("total") * 0.5) & (F.col("number") < F.col("total") - slack), "understated")
    return told.withColumn("finding", finding).where("finding is not null").select(owner, "number", "finding").distinct()


#: Longer horizons in months are not read as the project's.
MOST_MONTHS = 60


def long_horizons(claims: DataFrame, design: DataFrame, evidence: DataFrame, owner: str) -> DataFrame:
    """(owner, number): months that a text looks ahead beyond the design's, up to ``MOST_MONTHS``, unless evidence has the number. claims: (owner, number); design: (owner, months)."""
    told = claims.join(evidence.select(owner, "number").distinct(), [owner, "number"], "left_anti").join(design.where("months > 0"), owner)
    return told.where((F.col("number") > F.col("months")) & (F.col("number") <= MOST_MONTHS)).select(owner, "number").distinct()


def process_requirement(text: Column) -> Column:
    """A requirement of the submission's mechanics, which no text of the proposal can meet."""
    return reduce(lambda a, b: a | b, [F.lower(text).rlike(p) for p in PROCESS])


def missing_mandatory(coverage: DataFrame) -> DataFrame:
    return coverage.where(F.col("mandatory") & (F.col("status") == "missing") & ~process_requirement(F.col("text")))


def normal_claims(claims: DataFrame, allowed: list[str]) -> DataFrame:
    return claims.withColumn("raw_class", F.col("class")).withColumn("class", F.when(F.col("class").isin(allowed), F.col("class")).otherwise("unsupported"))


def donor_limit(raw: Column, field: str) -> Column:
    """(outcome, value, reason) of a stated limit as text: limit, absent or refused; a refusal is never taken for an absence."""
    lo, hi = LIMITS[field]
    low = F.trim(F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), r"[ \t\r\n\f]+", " "))
    sized = low.rlike(PAGE_SIZE)
    body = F.regexp_replace(F.regexp_replace(low, PAGE_SIZE, " "), r"\b([0-9]{1,3}),([0-9]{3})\b", "$1$2")
    body = F.regexp_replace(body, r"\b([0-9]+),([0-9]{3})\b", "$1$2")
    # A dot or a space groups digits only where nothing but wording of limits stands before, and no digit.
    before = F.regexp_extract(body, r"^([^0-9]*)[0-9]", 1)
    known = F.forall(F.filter(F.split(before, r"[^a-zà-ÿ]+"), lambda w: w != ""), lambda w: w.isin(BEFORE_GROUPS))
    joined = F.regexp_replace(body, r"^([^0-9]*)([0-9]{1,3})[. \x{00A0}\x{202F}\x{2009}]([0-9]{3})(?![0-9])", "$1$2$3")
    body = F.when(known, joined).otherwise(body)
    found = F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1)), lambda x: x.cast("double")))
    value = F.floor(F.element_at(found, 1)).cast("long")
    wrong = {"max_words": (PAGE_UNIT, "unit_is_pages"), "max_pages": (WORD_UNIT, "unit_is_words")}[field]
    reason = (
        F.when(low.rlike(r"\bwhichever\b|\bwhatever is (shorter|smaller|less)\b"), "dual_limit")
        .when(low.rlike(AT_LEAST), "minimum_not_maximum")
        .when(low.rlike(OTHER_UNIT), "wrong_unit")
        .when(low.rlike(MONEY), "currency")
        .when(low.rlike(r"(^|[ (=:])[-−] *[0-9]"), "out_of_range")
        .when(low.rlike(SHARED_OUT), "distributive_limit")
        .when(low.rlike(WORD_UNIT) & low.rlike(PAGE_UNIT), "dual_limit")
        .when(low.rlike(wrong[0]), wrong[1])
        .when((F.size(found) == 0) & sized, "page_size_token")
        .when((F.size(found) == 0) & low.rlike(NUMERALS), "word_form_number")
        .when(F.size(found) == 0, "not_a_number")
        .when(F.size(found) > 1, "multiple_numbers")
        .when(~value.between(lo, hi), "out_of_range")
    )
    absent = (low == "") | low.isin(STATES_NONE)
    outcome = F.when(absent, "absent").when(reason.isNotNull(), "refused").otherwise("limit")
    return F.struct(outcome.alias("outcome"), F.when(outcome == "limit", value).alias("value"), F.when(outcome == "refused", reason).alias("reason"))


def decided_limit(raw: Column, guidelines: Column, field: str) -> Column:
    """``donor_limit``, but an absence that the guidelines contradict is refused."""
    out, low = donor_limit(raw, field), F.lower(F.coalesce(guidelines, F.lit("")))
    unit = "words?" if field == "max_words" else "pages?"
    stated = low.rlike(rf"\b[0-9]+(?:[,. ][0-9]+)*[ \t]{{0,3}}({unit})\b|\b{unit.rstrip('s?')} (limit|maximum)\b") & ~low.rlike(r"\bno (word|page)? ?(limit|maximum)\b|\bunlimited\b")
    contradicted = (out.outcome == "absent") & stated
    return F.when(contradicted, F.struct(F.lit("refused").alias("outcome"), F.lit(None).cast("long").alias("value"), F.lit("absence_contradicted").alias("reason"))).otherwise(out)


def limit_scope(guidelines: Column) -> Column:
    """answers where the wording limits answers and attaches the rest, or excludes sections from the count; else whole."""
    g = F.lower(F.coalesce(guidelines, F.lit("")))
    answers = g.rlike(r"\b(answers?|responses?|questions?)\b[^.]{0,80}\b(must not exceed|no more than|within|limited to|maximum of)\b|\b(must not exceed|no more than)\b[^.]{0,40}\bwords?\b[^.]{0,60}\b(answers?|responses?)\b")
    attached = g.rlike(r"\b(budget table|budget)\b[^.]{0,60}\b(must be )?attach(ed)?\b|\battach\b[^.]{0,40}\bbudget\b")
    excluded = g.rlike(r"\b(excluded from|does not count towards|not counted towards|outside)\b[^.]{0,40}\b(word )?(limit|count)\b|\b(word )?(count|limit)\b[^.]{0,40}\bexclud\w*\b[^.]{0,60}\b(budget|declaration|annex|appendix|table|attachment)\b")
    return F.when((answers & attached) | excluded, "answers").otherwise("whole")


def _heading(line: str) -> str | None:
    m = re.fullmatch(r"\s*(?:#{1,6}\s+(.+?)|\*\*([^*]+)\*\*:?)\s*", line)
    return None if m is None else (m[1] or m[2]).replace("*", "").strip()


def _heading_key(text: str) -> str:
    bare = re.sub(r"^(q|question|section|part)\s*\d+\s*[.):-]?\s*", "", re.sub(r"[*_`#]", "", text.lower()).strip())
    return " ".join(re.sub(r"[^a-z0-9 ]+", " ", bare).split())


def countable(text: str | None, scope: str, headings: list[str] | None) -> str:
    """What a limit covers: without supplied headings, and without attachments unless they turn out to be prose."""
    if scope != "answers":
        return text or ""
    text = re.sub(r"(?s)<!--.*?-->", "", text or "")
    supplied, out, held = {_heading_key(h) for h in headings if h} if headings is not None else set(), [], None
    for line in [*text.split("\n"), None]:
        title = None if line is None else _heading(line)
        if held is not None and (line is None or title is not None or not line.strip()):
            block = [x for x in held["block"] if x.strip()]
            words = sum(len(re.findall(r"\w+", x)) for x in block if not x.strip().startswith("|"))
            held["words"] += words
            if words > PROSE_WORDS or held["words"] > SECTION_WORDS:
                out += held["lines"]
                held = None
            elif line is None or title is not None:
                held = None
            else:
                held["block"] = []
        if line is None:
            break
        if title is not None and _heading_key(title) in ATTACHMENTS:
            held = {"lines": [line], "block": [], "words": 0}
        elif title is not None and _heading_key(title) in supplied:
            held = None
        elif held is not None:
            held["lines"].append(line)
            held["block"].append(line)
        else:
            out.append(line)
    return "\n".join(out)


@F.udf(StringType(), useArrow=False)
def countable_text(text: str | None, scope: str | None, headings: list[str] | None) -> str | None:
    """Row by row: the texts of a whole Arrow batch, before and after, would have to fit in a worker."""
    return countable(text, scope, headings)


def content_violations(text: Column, limit: Column | None = None) -> Column:
    """Names of what a finished document must not have."""
    t = F.coalesce(text, F.lit(""))
    rules = {
        "box_characters": t.rlike("[─-╿■-◿]"),
        "code_fence": t.rlike("(?m)^ {0,3}```"),
        "horizontal_rule": t.rlike(r"(?m)^ {0,3}(-{3,}|\*{3,}|_{3,}) *$"),
        "unbalanced_bold": F.regexp_count(t, F.lit(r"\*\*")) % 2 == 1,
        "placeholder": t.rlike(r"(?i)\[(insert|tbd|todo|name|date|amount)[^\]]*\]|\bTBD\b|\blorem ipsum\b|X{3,}"),
        "order_id": t.rlike(r"\b(ord|prop)_[a-z0-9]{8,}\b"),
        "emoji": t.rlike("[\\x{1F300}-\\x{1FAFF}]"),
        "empty_section": t.rlike(r"(?m)^#{1,6} [^\n]+\n\s*(#{1,6} |\z)"),
        "mid_sentence_end": (F.trim(t) != "") & ~F.trim(t).rlike(r"""[.!?:;)\]"'”’|*_]$"""),
    }
    if limit is not None:
        rules["over_limit"] = F.coalesce(T.count_words(t) > limit, F.lit(False))
    return F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in rules.items()]))


@F.pandas_udf(StringType())
def compatible_form(text: pd.Series) -> pd.Series:
    """Unicode's compatibility form, which the database has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def _heading_form(text: Column) -> Column:
    """Lower-case letters and digits of ASCII in single spaces."""
    return T.collapse(F.regexp_replace(F.regexp_replace(F.lower(text), "[*_`]", ""), "[^a-z0-9 ]+", " "))


def _any_heading_form(text: Column) -> Column:
    """The same of letters of any script."""
    return T.collapse(F.regexp_replace(F.regexp_replace(compatible_form(F.lower(text)), "[*_`]", ""), r"[\p{P}\p{S}]+", " "))


def missing_headings(documents: DataFrame, required: DataFrame, id_col: str) -> DataFrame:
    """(id, heading, finding) of required headings that no heading of the document holds, which may say more: missing, or unreadable if the required one has no letter or digit.

    Forms of ASCII are compared; a required heading without any is compared in forms of any script. Blank ones ask for nothing. required: (id, heading).
    """
    lines = F.regexp_extract_all(F.col("text"), F.lit(r"(?m)^#{1,6} +([^\n]+)$"), F.lit(1))
    each = documents.select(id_col, F.explode(lines).alias("_h")).select(id_col, _heading_form(F.col("_h")).alias("_a"), _any_heading_form(F.col("_h")).alias("_u"))
    found = each.groupBy(id_col).agg(F.collect_set("_a").alias("_a"), F.collect_set("_u").alias("_u"))  # of one document
    asked = required.where(F.trim("heading") != "").withColumn("_na", _heading_form(F.col("heading"))).withColumn("_nu", _any_heading_form(F.col("heading")))
    rows = asked.join(documents.select(id_col), id_col, "left_semi").join(found, id_col, "left")
    none = F.array().cast("array<string>")
    held = F.when(F.col("_na") != "", F.exists(F.coalesce("_a", none), lambda h: F.contains(h, F.col("_na")))).otherwise(F.exists(F.coalesce("_u", none), lambda h: F.contains(h, F.col("_nu"))))
    finding = F.when((F.col("_na") == "") & (F.col("_nu") == ""), "unreadable").when(~held, "missing")
    return rows.withColumn("finding", finding).where("finding is not null").select(id_col, "heading", "finding")


# Classes of contact details, with the signs that do not matter in each.
CONTACTS = [
    ("email", r"\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})\b", r"\s"),
    ("url", r"\b(https?://[^\s<>\"')]+|www\.[^\s<>\"')]+)", r"^https?://|^www\.|/$"),
    ("iban", r"\b([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?)\b", r"\s"),
    ("phone", r"(?<!\w)(?<![0-9]\.)(\+?\(?[0-9]{2,5}\)?(?:[ .-]?\(?[0-9]{2,5}\)?){2,4})(?!\w|\.[0-9])", r"[^0-9]"),
    ("phone", r"(?i)\b(?:telephone|phone|tel|mobile|fax)\b[\s*_.:]*(\+?\(?[0-9][0-9 ().-]{4,}[0-9])", r"[^0-9]"),
    ("account", r"(?i)\b(?:account|acct)\s*(?:no\.?|number|#)?[\s*_]*:[\s*_]*([A-Z0-9][A-Z0-9 -]*[0-9][A-Z0-9 -]{3,})", r"[^A-Za-z0-9]"),
    ("address", r"(?i)\baddress[\s*_]*:[ \t*_]*([^\n]*[0-9][^\n]*)", r"[^A-Za-z0-9]"),
    ("registration", r"(?i)\b(?:registration|registered|company|charity)\s+(?:charity\s+|company\s+)?(?:no\.?|number|#)\s*:?\s*([A-Z0-9/-]{4,})", r"[^A-Za-z0-9]"),
    ("postcode", r"\b([A-Z]{1,2}[0-9][0-9A-Z]? [0-9][A-Z]{2})\b", r"\s"),
    ("date", r"\b([0-9]{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) (?:19|20)[0-9]{2})\b", r"^0"),
]


def contacts(documents: DataFrame, owner: str, text_col: str) -> DataFrame:
    """(owner, class, literal) of contact details, without formatting."""
    parts = []
    for name, pattern, noise in CONTACTS:
        found = documents.select(owner, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(1))).alias("_x"))
        parts.append(found.select(owner, F.lit(name).alias("class"), F.lower(F.regexp_replace("_x", noise, "")).alias("literal")))
    return reduce(DataFrame.unionByName, parts).where("literal <> ''").distinct()


def unsupported_contacts(claimed: DataFrame, ledger: DataFrame, owner: str) -> DataFrame:
    """Claimed details without the same detail of the same class in the ledger."""
    return claimed.join(ledger, [owner, "class", "literal"], "left_anti")


def sums_close(totals: DataFrame, parts: DataFrame, key: str, places: int = 2) -> DataFrame:
    """(key, asserted, computed, verdict): totals against the sums of their parts; the plain form of a register."""
    summed = parts.groupBy(key).agg(F.round(F.sum("value"), places).alias("computed"), F.count("*").alias("parts"))
    joined = totals.join(summed, key, "left")
    return joined.select(key, F.round("asserted", places).alias("asserted"), "computed", "parts", F.when(F.col("computed").isNull(), "dangling").when(F.abs(F.col("computed") - F.round("asserted", places)) < 10**-places / 2, "closed").otherwise("does_not_close").alias("verdict"))


# Bounds of a register, and the places that values are snapped to.
MOST_NODES, NODE_ID, MONEY_PLACES, OTHER_PLACES = 200, re.compile(r"[A-Z]{1,2}[0-9]{1,3}"), 2, 6


# Words that may stand beside the name of a denominator, words that make it another quantity, and words that do not tell labels apart.
CONNECTIVES = ["of", "per", "the", "a", "an", "to", "as", "over", "by", "into", "from", "on", "for", "and", "or", "out", "with", "in", "at", "share", "proportion", "percentage", "fraction", "ratio", "rate", "versus", "vs", "each"]
SCOPES = ["whole", "total", "entire", "overall", "combined", "full", "gross", "aggregate", "all", "complete", "cumulative", "collective", "grand", "sum", "totality", "net"]
LABEL_STOPS = ["the", "a", "an", "of", "our", "its", "their", "this", "that"]


@lru_cache(maxsize=1 << 16)
def _plain_label(label: str | None) -> str:
    return " ".join((label or "").lower().split())


@lru_cache(maxsize=1 << 16)
def _label_tokens(label: str | None) -> frozenset[str]:
    return frozenset(w.removesuffix("s") for w in (label or "").lower().split() if w not in LABEL_STOPS)


@lru_cache(maxsize=1 << 16)
def names_part(label: str, part: str) -> bool:
    """The words of ``part`` stand in ``label`` as a run of their own: beside it are ends or connectives, and no scope word comes next behind these."""
    words, run = label.lower().split(), part.lower().split()

    def apart(side: list[str]) -> bool:
        rest = list(itertools.dropwhile(CONNECTIVES.__contains__, side))
        return not side or (len(rest) < len(side) and not (rest and rest[0] in SCOPES))

    places = [k for k in range(len(words) - len(run) + 1) if words[k : k + len(run)] == run] if run else []
    return any(apart(words[:k][::-1]) and apart(words[k + len(run) :]) for k in places)


def rate_faults(rows: dict, value: dict[str, float]) -> dict[str, str]:
    """What is wrong with the denominators of the rates that could be computed. The leaves below a node are a bit set, a bit for each leaf."""
    if not any(r.kind == "rate" and name in value for name, r in rows.items()):
        return {}
    bits = {name: 1 << k for k, name in enumerate(n for n, r in rows.items() if r.kind == "leaf")}
    below: dict[str, int] = {}
    for name in value:  # members come before what they make up
        below[name] = bits.get(name, 0) | reduce(int.__or__, (below[m] for m in (rows[name].members if rows[name].kind != "leaf" else ())), 0)
    tokens = {name: _label_tokens(rows[name].label) for name in value}
    found = {}
    for name, r in rows.items():
        if r.kind != "rate" or name not in value:
            continue
        num, den = r.members
        part, over = below[num], below[den]
        wholes = [s for s in value if rows[s].kind == "sum" and s not in (den, name) and rows[s].unit_kind == rows[den].unit_kind and rows[s].unit == rows[den].unit and part and part != below[s] and part & ~below[s] == 0]
        larger = [o for o in value if o != den and rows[o].unit_kind == rows[den].unit_kind and value[o] != value[den] and tokens[den] and tokens[den] < tokens[o]]
        if r.unit_kind not in ("ratio", "rate"):
            found[name] = "rate_unit_kind"
        elif not names_part(r.label or "", rows[den].label or ""):
            found[name] = "rate_denominator_label"
        elif any(value[s] != value[den] and (over & ~below[s] or over & part or not over) for s in wholes):
            found[name] = "rate_denominator_not_whole"
        elif larger:
            found[name] = "rate_denominator_ambiguous"
    return found


def evaluate_register(nodes: list) -> list[tuple[str, float | None, str | None]]:
    """Recompute one register bottom-up: (node_id, value, code of its fault). Nodes have the fields of the schema REGISTER but the id."""
    rows = {r.node_id: r for r in nodes}
    fault: dict[str, str] = {}
    plain = [_plain_label(r.label) for r in nodes]
    labels, ids = Counter(plain), Counter(r.node_id for r in nodes)
    for r, label in zip(nodes, plain, strict=True):
        members = [] if r.members is None else list(r.members)
        twice = labels[label] > 1 or ids[r.node_id] > 1
        leaf, has = r.kind == "leaf", r.value is not None
        if not NODE_ID.fullmatch(r.node_id or ""):
            code = "bad_id"
        elif len(label) < 3 or twice:
            code = "bad_label"
        elif leaf and (not has or not np.isfinite(r.value) or r.value < 0):
            code = "bad_value"
        elif leaf and members:
            code = "leaf_with_members"
        elif leaf and r.basis == "arithmetic":
            code = "bad_basis"
        elif leaf and r.unit_kind in ("count", "duration") and r.value != int(r.value):
            code = "not_whole"
        elif not leaf and has:
            code = "derived_with_value"
        elif not leaf and (len(members) < 2 or (r.kind in ("product", "rate") and len(members) != 2)):
            code = "bad_arity"
        elif not leaf and r.basis != "arithmetic":
            code = "bad_basis"
        elif not leaf and r.asserted is None:
            code = "not_asserted"
        elif any(m not in rows for m in members):
            code = "dangling"
        else:
            code = None
        if code:
            fault.setdefault(r.node_id, code)
    places = lambda r: MONEY_PLACES if r.unit_kind == "money" else OTHER_PLACES
    value = {name: round(float(r.value), places(r)) for name, r in rows.items() if r.kind == "leaf" and name not in fault}
    state: dict[str, int] = dict.fromkeys(value, 2)

    def visit(start: str) -> None:
        stack = [(start, False)]
        while stack:
            node, ready = stack.pop()
            if state.get(node) == 2 or node in fault:
                continue
            r = rows[node]
            members = [] if r.members is None else list(r.members)
            if not ready:
                if state.get(node) == 1:
                    continue
                state[node] = 1
                if any(state.get(m) == 1 for m in members):
                    fault[node] = "cycle"
                    continue
                stack += [(node, True), *[(m, False) for m in members]]
                continue
            state[node] = 2
            if any(m in fault or m not in value for m in members) and r.kind != "leaf":
                fault[node] = "faulty_member"
                continue
            v, own = [value[m] for m in members], [rows[m] for m in members]
            if r.kind == "sum":
                if any(o.unit != r.unit or o.unit_kind != r.unit_kind for o in own):
                    fault[node] = "mixed_units"
                    continue
                result = sum(v)
            elif r.kind == "product":
                same = [o.unit == r.unit for o in own]
                if sum(same) != 1 or own[same.index(False)].unit_kind not in ("count", "ratio"):
                    fault[node] = "bad_product"
                    continue
                result = v[0] * v[1]
            elif r.kind == "rate":
                if v[1] == 0 or (r.unit_kind == "ratio" and own[0].unit != own[1].unit):
                    fault[node] = "bad_denominator"
                    continue
                result = v[0] / v[1]
            else:
                fault[node] = "bad_kind"
                continue
            value[node] = round(result, places(r))
            if abs(value[node] - r.asserted) > 1e-9:
                fault[node] = "does_not_close"

    for name in rows:
        visit(name)
    for name, code in rate_faults(rows, value).items():
        fault[name] = code
    for name in list(value):  # what hangs on a faulty rate falls with it
        if rows[name].kind != "leaf" and name not in fault and any(fault.get(m, "").startswith("rate_") or m not in value for m in rows[name].members):
            fault[name] = "faulty_member"
            del value[name]
    return [(r.node_id, value.get(r.node_id), fault.get(r.node_id)) for r in nodes]


#: Registers that Python works on at once.
REGISTER_SLICE = 512


class RegisterNode(NamedTuple):
    node_id: str | None
    kind: str | None
    label: str | None
    unit: str | None
    unit_kind: str | None
    members: list[str] | None
    value: float | None
    asserted: float | None
    basis: str | None


def close_registers(nodes: DataFrame) -> DataFrame:
    """(register_id, node_id, computed, fault). Registers of too many nodes are told by a count; only the others are gathered."""
    sizes = nodes.groupBy("register_id").agg(F.count("*").alias("_n"))
    great = sizes.where(F.col("_n") > MOST_NODES).select("register_id")
    refused = nodes.join(great, "register_id", "left_semi").select("register_id", "node_id", F.lit(None).cast("double").alias("computed"), F.lit("too_many_nodes").alias("fault"))
    fields = RegisterNode._fields
    sound = nodes.join(great, "register_id", "left_anti").groupBy("register_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("nodes"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), REGISTER_SLICE):
                batch = whole.slice(k, REGISTER_SLICE)
                lists = batch.column("nodes")
                ends = np.cumsum([0, *pc.list_value_length(lists).to_pylist()])
                nodes = [RegisterNode(*n) for n in zip(*(c.to_pylist() for c in lists.flatten().flatten()), strict=True)]  # by columns: a row is never a dict
                found = [x for a, b in itertools.pairwise(ends) for x in evaluate_register(nodes[a:b])]
                owners = batch.column("register_id").take(pa.array(np.repeat(np.arange(len(batch)), np.diff(ends))))
                node_ids, computed, faults = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([owners.cast(pa.int64()), pa.array(node_ids, pa.string()), pa.array(computed, pa.float64()), pa.array(faults, pa.string())], ["register_id", "node_id", "computed", "fault"])

    return sound.mapInArrow(work, "register_id long, node_id string, computed double, fault string").unionByName(refused)
