"""How much of a document's argument hangs on the names that its evidence offers.

Texts become units (a sentence, a table's cell, a form's field) with a zone and a section. Capitalised runs of the units are aligned with the offered
names by an equi-join on document and name token: the name that shares most tokens wins, and the run shrinks to the span that still says all of it. The role of a mention
is read off what stands before and after it, over conjuncts back to the preposition that they inherit. All in built-in expressions.

Edge cases: null texts have no units; null, empty and repeated names (those that differ in case and signs only) are offered once, under the least of their positions; a document without names, or names without their document, give no rows; line ends are ``\\n``,
``\\r\\n`` or ``\\r``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lineage import cut

# Weights of zones and roles, what a checkable sentence, a contrast and further sections add, and the floor of the verdict.
ZONES = {"prose": 1.0, "list": 0.4, "table": 0.25, "field": 0.0, "identification": 0.0}
ROLES = {"subject": 2.0, "counterparty": 2.0, "genitive": 1.3, "adjunct": 1.0, "listing": 0.6}
LOADS, LOAD_CAP, CONTRASTED = {"number": 0.3, "date": 0.3, "causal": 0.2}, 0.6, 0.5
PER_SECTION, SPREAD_CAP, SUPPORTING = 0.25, 2.0, 2.0
# Sections of administration, longest field and heading, share of capitals of a shouted heading, characters before a name that are looked at.
IDENTIFICATION = r"(?i)\b(applicant\s+identification|identification|applicant\s+details|organisation\s+details|organization\s+details|contact\s+details|eligibility\s+declaration|declaration|signator|cover\s+sheet)\b"
FIELD_CHARS, HEADING_CHARS, SHOUTED, CUE_CHARS, CONTRAST_CHARS, CONJUNCTS = 140, 120, 0.6, 56, 26, 4
# Abbreviations that do not end a sentence.
ABBREVIATIONS = ["e\\.g", "i\\.e", "etc", "no", "vs", "approx", "dr", "mr", "mrs", "ms", "st", "fig", "cf", "al", "usd", "gbp", "eur"]
# A capitalised run; what stands before and after a name.
RUN = r"[A-Z][\w'’]*(?:[\s-]+(?:of|the|de|al|el|la|le|du|van|von|bin)[\s-]+[A-Z][\w'’]*|[\s-]+[a-z]{1,3}[-'’][A-Z][\w'’]*|-[A-Z][\w'’]*|\s+[A-Z][\w'’]*)*"
PREPOSITION = r"(?i)\b(in|at|on|from|of|with|to|for|across|along|around|near|throughout|between|within|into|onto|towards?|by|through|about|over|under|among|amongst|via|beyond|outside|inside|serving|covering|including)\b(?:\s+(?:the|our|its|their|these|those|both|all|two|three|four|a|an|each|every|other|adjacent|neighbouring))*\s*$"
CUE = r"(?i)\b(sign|signs|signed|signing|signature|signatory|agree|agrees|agreed|agreement|arrangement|arrangements|partner|partners|partnership|contract|contracted|memorandum|mou|refer|refers|referral|referrals|referred|hand|handed|handover|pass|passes|passed|transfer|transferred|host|hosted|hosting|provided|supplied|supply|funded|delivered|jointly|confirm|confirms|confirmed|commissioned|accredited|employed|seconded|subcontract|letter|endorsement|permission|licence|license|approval|approved|lease|leased|donated|collected|negotiat\w*|liaise\w*|coordinat\w* with|counterpart)\b"
FINITE = r"(?i)^\s*(?:is|are|was|were|has|have|had|does|do|did|will|would|shall|should|can|could|may|might|must|agrees?|agreed|provides?|provided|runs?|ran|operates?|operated|holds?|held|lifts?|lifted|collects?|collected|employs?|employed|hosts?|hosted|refers?|referred|funds?|funded|owns?|owned|manages?|managed|delivers?|delivered|supplies|supplied|maintains?|maintained|confirms?|confirmed|signs?|signed|takes?|took|gives?|gave|sits?|sat|carries|carried|contains?|contained|lacks?|lacked|serves?|served|receives?|received|continues?|continued|remains?|remained|becomes?|became|began|begins?|ends?|ended|accepts?|accepted|requires?|required|allows?|allowed|refuses?|refused|stopped|stops?)\b"
AUXILIARY = r"(?i)^\s*(?:is|are|was|were|has|have|had|does|do|did|will|would|shall|should|can|could|may|might|must)\b"
OPENS_CLAUSE = r"(?i)(?:^|[.;:!?—–]|[-*•]|\)|\bwhich\b|\bwho\b|\bthat\b|\bwhile\b|\bwhilst\b|\bbecause\b|\bif\b|\bwhen\b|\bwhere\b|\bso\b|\bbut\b|\bhowever\b)\s*(?:the\s+|our\s+|its\s+|their\s+|this\s+)?$"
CONJUNCT = r"(?i)(?:(?:,\s*)?\s\b(?:and|or)\s*|,\s*)$"
# What makes a sentence checkable, and what sets a name against another.
NUMBER = r"(?i)(?:\b\d[\d,]*(?:\.\d+)?\b|\b(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|twenty|thirty|forty|fifty|hundred|thousand)\b)"
DATE = r"(?i)(?:\b(?:19|20)\d{2}\b|\b(?:spring|summer|autumn|winter)\b|\bmonths?\s*\d|\bweeks?\s*\d|\bquarter\s*\d|\bq[1-4]\b|\byear\s*(?:one|two|three|1|2|3)\b|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b)"
CAUSAL = r"(?i)\b(?:because|so that|therefore|as a result|which means|hence|consequently|in order to|owing to|due to|thereby|which is why|so the|so we)\b"
CONTRAST = r"\b(?:[Oo]ne|[Ee]ither|[Rr]espectively|[Ww]hereas|[Ww]hile|[Ww]hilst|rather than|instead of|[Tt]he first|[Tt]he second|[Ss]eparately|apiece|[Tt]he other|another)\b[^A-Z]{0,12}$"

_SENTENCE_END = rf"(?<=[.!?][\"'’)\]]?)(?<!(?i:\b(?:{'|'.join(ABBREVIATIONS)})\.)[\"'’)\]]?)\s+(?=[A-Z\"'(\[£$€])"
_MARKED_HEADING, _NUMBERED = r"^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$", r"(?i)^(?:Q\s?)?\d{1,2}\s*[.):]\s+\S"
_FIELD = r"^\s{0,4}(?:[-*+]\s+|\d{1,2}[.)]\s+)?(?:\*\*)?[A-Z][A-Za-z][A-Za-z /&'-]{1,40}(?:\*\*)?\s*:\s*\S"
_LIST = r"^\s{0,4}(?:[-*+]|\d{1,2}[.)])\s+\S"


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _heading(line: Column) -> Column:
    """The title of a heading line, or null: marked as such, or numbered and no sentence, unless it is shouted."""
    raw = _trim(F.regexp_replace(_trim(line), r"^\*\*(.*)\*\*$", "$1"))
    letters, capitals = (F.length(F.regexp_replace(raw, f"[^{c}]", "")) for c in ("A-Za-z", "A-Z"))
    sentence = raw.rlike(r"[.]\s*$") & ~F.coalesce(capitals / F.nullif(letters, F.lit(0)) >= SHOUTED, F.lit(False))
    numbered = (F.length(raw) <= HEADING_CHARS) & raw.rlike(_NUMBERED) & ~sentence
    return F.when(line.rlike(_MARKED_HEADING), _trim(F.regexp_replace(F.regexp_extract(line, _MARKED_HEADING, 1), r"\*+", ""))).when(numbered, raw)


def units(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, unit, zone, section, said): what a document claims, sentence by sentence; headings are left out."""
    lines = documents.where(F.col(id_col).isNotNull()).select(id_col, F.posexplode(F.split(F.regexp_replace(text_col, r"\r\n?", "\n"), "\n")).alias("_n", "_line")).withColumn("_title", _heading(F.col("_line")))
    so_far = Window.partitionBy(id_col).orderBy("_n")  # the lines of one document
    lines = lines.withColumn("section", F.count("_title").over(so_far).cast("int")).withColumn("_of", F.last("_title", True).over(so_far))
    bare = _trim(F.col("_line"))
    field = F.col("_line").rlike(_FIELD) & (F.length(bare) <= FIELD_CHARS) & ~bare.rlike(r"[.!?][\"'’)\]]?\s+[A-Z]")
    table = F.col("_line").rlike(r"^\s{0,3}\|")
    zone = F.when(F.coalesce(F.col("_of").rlike(IDENTIFICATION), F.lit(False)), "identification").when(table, "table").when(field, "field").when(F.col("_line").rlike(_LIST), "list").otherwise("prose")
    cells = F.filter(F.transform(F.split(F.regexp_replace(F.regexp_replace("_line", r"^\s*\|", ""), r"\|\s*$", ""), r"\|"), _trim), lambda c: (c != "") & ~c.rlike("^:?-{2,}:?$"))
    blocks = lines.where(F.col("_title").isNull() & (bare != "")).withColumn("zone", zone).select(id_col, "_n", "section", "zone", F.posexplode(F.when(table, cells).otherwise(F.array(bare))).alias("_c", "_text"))
    said = F.transform(F.split(F.regexp_replace("_text", r"\*\*|`+", ""), _SENTENCE_END), _trim)
    parts = blocks.select(id_col, "_n", "_c", "section", "zone", F.posexplode(F.when(F.col("zone") == "field", F.array("_text")).otherwise(F.filter(said, lambda s: s != ""))).alias("_s", "said"))
    return parts.select(id_col, F.struct("_n", "_c", "_s").alias("unit"), "zone", "section", "said")


def _found(text: Column, pattern: str) -> Column:
    """(begin, word) of every match of a pattern in a text; begins count from 1."""
    words, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    length = lambda parts, k: F.aggregate(F.slice(parts, F.lit(1), k), F.lit(0), lambda n, x: n + F.length(x))
    return F.transform(words, lambda w, k: F.struct((1 + length(between, k + 1) + length(words, k)).alias("begin"), w.alias("word")))


def runs(said: DataFrame, id_col: str) -> DataFrame:
    """(id, unit, zone, section, said, run, words, tokens): capitalised runs, their words with their places, and what they mean as a name."""
    each = said.select(id_col, "unit", "zone", "section", "said", F.explode(_found(F.col("said"), RUN)).alias("run"))
    words = F.transform(_found(F.col("run.word"), r"[A-Za-z][\w'’-]*"), lambda w: F.struct((w["begin"] + F.col("run.begin") - 1).alias("begin"), w["word"].alias("word"), T.name_tokens(w["word"]).alias("tokens")))
    return each.withColumn("words", words).withColumn("tokens", T.name_tokens(F.col("run.word"))).where(F.size("tokens") > 0)


def offered(names: DataFrame, id_col: str) -> DataFrame:
    """(id, referent, key, lead): the different names of (id, name, position) by their normal form, their tokens and the first of these."""
    plain = names.select(id_col, "position", _trim(F.col("name")).alias("referent"), T.normal_title(F.col("name")).alias("_plain")).where((F.col("_plain") != "") & F.col(id_col).isNotNull())
    firsts = plain.groupBy(id_col, "_plain").agg(F.min(F.struct("position", "referent")).alias("_f"))
    lead = F.get(F.filter(F.split("_plain", " "), lambda w: ~w.isin(T.NAME_GLUE)), 0)
    return firsts.select(id_col, F.col("_f.referent").alias("referent"), F.col("_f.position").alias("position"), T.name_tokens(F.col("_plain")).alias("key"), F.coalesce(lead, F.lit("")).alias("lead"))


def aligned(found: DataFrame, names: DataFrame, id_col: str) -> DataFrame:
    """(id, unit, zone, section, said, referent, begin, surface): each run's best name, where one holds the other's tokens, and the span that says it."""
    held = names.groupBy(id_col).agg(F.array_distinct(F.flatten(F.collect_list("key"))).alias("_held"))  # of one document
    # a run without a token of its document's names has no pair; those that have one are read twice, so they are kept
    found = cut(found.join(held, id_col).where(F.arrays_overlap("tokens", "_held")).drop("_held"))
    tokens = names.select(id_col, "referent", "position", "lead", "key", F.explode("key").alias("token"))
    keyed = found.select(id_col, "unit", F.col("run.begin").alias("_at"), F.size("tokens").alias("_n"), F.explode("tokens").alias("token"))
    pairs = keyed.join(tokens, [id_col, "token"]).groupBy(id_col, "unit", "_at", "_n", "referent", "position", "lead", "key").agg(F.count("*").alias("_both"))
    held = pairs.where(F.col("_both") == F.least("_n", F.size("key")))
    best = held.groupBy(id_col, "unit", "_at").agg(F.min(F.struct(-F.col("_both"), F.size("key"), "position", "referent", "key", "lead")).alias("_b"))
    rows = found.withColumn("_at", F.col("run.begin")).join(best, [id_col, "unit", "_at"]).select("*", "_b.referent", "_b.key", "_b.lead")
    full = F.size(F.array_except("key", "tokens")) == 0
    last = F.size("words") - 1
    holds = lambda token: F.filter(F.sequence(F.lit(0), last), lambda k: F.array_contains(F.get("words", k)["tokens"], token))
    # the latest beginning that leaves all tokens behind it, and then the earliest end
    low = F.when(full, F.array_min(F.transform("key", lambda t: F.array_max(holds(t))))).otherwise(0)
    rows = rows.withColumn("_full", full).withColumn("_low", low)
    high = F.when(F.col("_full"), F.array_max(F.transform("key", lambda t: F.array_min(F.filter(holds(t), lambda k: k >= F.col("_low")))))).otherwise(last)
    first, end = F.get("words", F.col("_low"))["begin"], F.get("words", high)
    surface = F.col("said").substr(first, end["begin"] + F.length(end["word"]) - first)
    rows = rows.withColumn("begin", first).withColumn("surface", F.regexp_replace(surface, "['’]s$", "")).withColumn("_after", F.expr("substring(said, begin + length(surface))"))
    # a run that says a part of a name keeps its first token, and is no adjective before a noun
    partial = F.array_contains("tokens", F.col("lead")) & (~F.col("_after").rlike(r"^\s+[a-z]") | F.col("_after").rlike(AUXILIARY))
    return rows.where(F.col("_full") | partial).select(id_col, "unit", "zone", "section", "said", "referent", "begin", "surface", F.col("_after").alias("after"))


def roles(rows: DataFrame) -> DataFrame:
    """Adds role: genitive, subject, counterparty, adjunct or listing."""
    genitive, finite = F.col("after").rlike("^['’]s\\b"), F.col("after").rlike(FINITE)
    rows = rows.withColumn("_before0", F.regexp_replace(F.expr("substring(said, 1, begin - 1)"), r"\s+$", ""))
    for k in range(CONJUNCTS - 1):  # "in Elm and Oak": the second conjunct has the first one's preposition
        before = F.col(f"_before{k}")
        bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(before, CONJUNCT, ""), rf"(?:{RUN})\s*$", ""), r"\s+$", "")
        rows = rows.withColumn(f"_before{k + 1}", F.when(before.rlike(CONJUNCT), bare))
    governed = F.coalesce(*[F.when(F.col(f"_before{k}").rlike(PREPOSITION), F.col(f"_before{k}")) for k in range(CONJUNCTS)])
    window = F.regexp_replace(F.expr("right(_governed, %d)" % CUE_CHARS), r"^.*[,;()]", "")
    role = (
        F.when(genitive, "genitive").when(F.col("_before0").rlike(OPENS_CLAUSE) & finite, "subject")
        .when(F.col("_governed").isNotNull(), F.when(window.rlike(CUE), "counterparty").otherwise("adjunct"))
        .when(F.col("zone").isin("table", "list", "field"), "listing").when(finite, "subject").otherwise("adjunct")
    )
    return rows.withColumn("_governed", governed).withColumn("role", role).drop("_governed", *[f"_before{k}" for k in range(CONJUNCTS)])


def _chosen(column: str, values: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col(column))


def mentions(documents: DataFrame, names: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, unit, zone, section, said, referent, begin, surface, role, number, date, causal, contrastive, survives, weight) of (id, text) and (id, name, position).

    A mention survives if a placeholder could stand for its name without loss.
    """
    named = documents.join(names.select(id_col).distinct(), id_col, "left_semi")  # the others have no mention
    rows = roles(aligned(runs(units(named, id_col, text_col), id_col), offered(names, id_col), id_col))
    rows = rows.withColumn("_names", F.size(F.collect_set("referent").over(Window.partitionBy(id_col, "unit"))))  # of one sentence
    lead = F.expr(f"substring(said, greatest(1, begin - {CONTRAST_CHARS}), begin - greatest(1, begin - {CONTRAST_CHARS}))")
    rows = rows.withColumns({"number": F.col("said").rlike(NUMBER), "date": F.col("said").rlike(DATE), "causal": F.col("said").rlike(CAUSAL), "contrastive": (F.col("_names") > 1) & lead.rlike(CONTRAST)})
    base = _chosen("zone", ZONES)
    bonus = sum((F.col(c).cast("int") * v for c, v in LOADS.items()), F.lit(0.0))
    weight = F.when(base == 0, 0.0).otherwise(F.floor((base * _chosen("role", ROLES) + F.least(bonus, F.lit(LOAD_CAP)) + F.col("contrastive").cast("int") * CONTRASTED) * 1000 + 0.5) / 1000)
    carries = F.col("role").isin("subject", "counterparty") | F.col("contrastive") | ((F.col("role") == "genitive") & (F.col("number") | F.col("date")))
    return rows.withColumn("weight", weight).withColumn("survives", (base == 0) | ~carries).drop("_names", "after")


def scores(found: DataFrame, names: DataFrame, id_col: str) -> DataFrame:
    """(id, referent, mentions, weighted_mentions, sections, load_bearing, weight, verdict) of every offered name."""
    counts = _chosen("zone", ZONES) != 0
    when = lambda c: F.when(counts, c)
    mine = found.groupBy(id_col, "referent").agg(
        F.count("*").alias("mentions"), F.count_if(counts).alias("weighted_mentions"), F.count_distinct(when(F.col("section"))).alias("sections"),
        F.count_if(counts & ~F.col("survives")).alias("load_bearing"), F.sum(F.round(F.col("weight") * 1000).cast("long")).alias("_raw"),
    )
    every = offered(names, id_col).select(id_col, "referent").join(mine, [id_col, "referent"], "left").na.fill(0, ["mentions", "weighted_mentions", "sections", "load_bearing", "_raw"])
    spread = F.least(F.lit(SPREAD_CAP), 1 + PER_SECTION * F.greatest(F.col("sections") - 1, F.lit(0)))
    rows = every.withColumn("weight", F.floor(F.col("_raw") * spread + 0.5) / 1000)
    verdict = F.when(F.col("mentions") == 0, "absent").when(F.col("load_bearing") > 0, "load_bearing").when(F.col("weight") >= SUPPORTING, "supporting").otherwise("decorative")
    return rows.drop("_raw").withColumn("verdict", verdict)


def document_weights(scored: DataFrame, id_col: str) -> DataFrame:
    """(id, offered, present, load_bearing_referents, weighted_mentions, weight, weight_per_offered, findings) of the scores of documents."""
    rows = scored.groupBy(id_col).agg(
        F.count("*").alias("offered"), F.count_if(F.col("mentions") > 0).alias("present"), F.count_if(F.col("load_bearing") > 0).alias("load_bearing_referents"),
        F.sum("weighted_mentions").alias("weighted_mentions"), F.sum(F.round(F.col("weight") * 1000).cast("long")).alias("_w"), F.count_if(F.col("verdict") == "decorative").alias("_d"),
    )
    there = F.col("present") > 0
    findings = F.array_compact(F.array(
        F.when(there & (F.col("weighted_mentions") == 0), "identification_only"), F.when(there & (F.col("load_bearing_referents") == 0), "no_load_bearing"), F.when(F.col("_d") > 0, "decorative"),
    ))
    return rows.select(id_col, "offered", "present", "load_bearing_referents", "weighted_mentions", (F.col("_w") / 1000).alias("weight"), (F.floor(F.col("_w") / F.col("offered") + 0.5) / 1000).alias("weight_per_offered"), findings.alias("findings"))
