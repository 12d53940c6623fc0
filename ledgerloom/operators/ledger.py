"""Intake answers, evidence ledger, sufficiency, canonical fingerprints and compositions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lineage import cut

# Readings that state no fact.
NO_FACT = r"(?i)^(unverified|unknown|tbd|tba|n/?a|none|not (known|available|provided)|-+|0+)$"
# Readings that are no organisation's name.
NO_NAME = r"(?i)^(test|n/?a|none|unknown|tbd|my (org|organi[sz]ation)|organi[sz]ation|company|xxx+)$"
# Names that stand for none.
PLACEHOLDER = r"(?i)^(test|testing|asdf+|demo|sample|example|abc+|xyz+|xxx+|qwerty|none|null|n\/?a|foo|bar|placeholder|org|organisation|organization|company|tbd|todo)$"
READABLE_GRANT, REFERENTS_WANTED = 600, 3
VOCABULARY = 2_000
# Integer grids that every composition has besides its codes: name, seed, least value, number of values.
GRIDS = [("move_order", "mo", 0, 997), ("cadence_mu", "cad", 8, 20), ("weight_profile", "wp", 0, 997)]
PRECEDENCE = {"intake": 1, "upload": 2, "website": 3}


def fact_present(value: Column) -> Column:
    """A value that states something."""
    t = F.trim(F.coalesce(value, F.lit("")))
    repeated = F.regexp_replace(t, F.concat(F.lit("["), F.regexp_extract(t, "^([0-9])", 1), F.lit("]")), "") == ""
    return (t != "") & ~t.rlike(NO_FACT) & ~(t.rlike("^[0-9]{4,}$") & F.when(t.rlike("^[0-9]"), repeated).otherwise(False))


def identity_flags(name: Column, number: Column) -> Column:
    """Names of what is odd about an organisation's identity."""
    n = F.trim(F.coalesce(name, F.lit("")))
    rules = {"name_short": F.length(n) < 3, "name_placeholder": n.rlike(NO_NAME), "name_address": n.rlike(r"(?i)@|https?://|\b[0-9]{1,5} [a-z]+ (street|road|avenue|lane)\b"), "number_missing": ~fact_present(number)}
    return F.array_compact(F.array(*[F.when(hit, F.lit(k)) for k, hit in rules.items()]))


def name_blocker(name: Column) -> Column:
    """What keeps a text from being an organisation's registered name, or null: too short, a placeholder, one sign over and over, without a vowel, or an address."""
    n = T.collapse(F.regexp_replace(F.coalesce(name, F.lit("")), r"[\x00-\x1F\x7F]", " "))
    placeholder = n.rlike(PLACEHOLDER) | n.rlike(r"^(.)\1{3,}$") | ~n.rlike("(?iu)[aeiouyà-ÿ]")
    return F.when(F.length(n) < 4, "org_too_short").when(placeholder, "org_placeholder").when(n.rlike(r"(?i)^(https?://|www\.)") | F.contains(n, F.lit("@")), "org_looks_like_address")


def fulfilment_blockers(as_of: str) -> Column:
    """Of (org_name, grant_text, grant_ok, deadline, tier): what stands in the way of an order. A grant that was read (grant_ok) needs no pasted text; a deadline lasts to the end of its day."""
    unread = ~F.coalesce("grant_ok", F.lit(False)) & (F.length(F.trim(F.coalesce("grant_text", F.lit("")))) < READABLE_GRANT)
    rules = [(~F.coalesce(F.col("tier").isin("standard", "full"), F.lit(False)), "tier_unavailable"), (unread, "grant_unreadable"), (F.col("deadline") < F.lit(as_of).cast("timestamp").cast("date"), "deadline_passed")]
    found = [F.when(hit, F.lit(code)) for hit, code in rules]
    return F.array_compact(F.array(found[0], name_blocker(F.col("org_name")), *found[1:]))


def sanitise(text: Column, most: int) -> Column:
    """Without control characters, ends trimmed, capped."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")), 1, most)


def sanitise_links(links: Column, first: int = 8, most: int = 5) -> Column:
    """Different web addresses among the first ones, at most so many."""
    return F.slice(F.array_distinct(F.filter(F.transform(F.slice(links, 1, first), lambda x: F.trim(x)), lambda x: x.rlike("^https?://"))), 1, most)


def intake_items(answers: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """(owner_id, item_id, claim): one claim a filled field, numbered in the order of fields. fields: (column, lead)."""
    said = F.array(*[F.when(fact_present(F.col(c)), F.concat(F.lit(lead + ": "), F.trim(F.col(c).cast("string")))) for c, lead in fields])
    rows = answers.select("owner_id", F.posexplode(F.array_compact(said)).alias("_k", "claim"))
    return rows.select("owner_id", F.concat(F.lit("E-INTAKE-"), (F.col("_k") + 1).cast("string")).alias("item_id"), "claim")


def merge_ledgers(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of (owner_id, item_id, fact_key, claim) with the rank of its origin; conflicts stay, the best rank of a fact is marked."""
    rows = reduce(DataFrame.unionByName, [df.withColumn("origin", F.lit(k)).withColumn("rank", F.lit(PRECEDENCE[k])) for k, df in parts.items()])
    own = Window.partitionBy("owner_id", "fact_key")
    return rows.withColumn("preferred", F.row_number().over(own.orderBy("rank", "item_id")) == 1).withColumn("conflict", F.size(F.collect_set("claim").over(own)) > 1)


def distinct_referents(referents: DataFrame, owner: str) -> DataFrame:
    """(owner, name): referents that no longer one holds: every token of a name in another's, or the same tokens and a lesser name.

    An equi-join on owner and token and a count; no list of an owner's names is compared in one task.
    """
    rows = referents.select(owner, "name").distinct().withColumn("_t", T.name_tokens(F.col("name"))).where(F.size("_t") > 0)
    each = rows.select(owner, "name", F.size("_t").alias("_n"), F.explode("_t").alias("token"))
    a, b = each.alias("a"), each.alias("b")
    hits = a.join(b, (F.col(f"a.{owner}") == F.col(f"b.{owner}")) & (F.col("a.token") == F.col("b.token")) & (F.col("a.name") != F.col("b.name")))
    g = hits.groupBy(F.col(f"a.{owner}").alias(owner), F.col("a.name").alias("name"), F.col("b.name").alias("other"), F.col("a._n").alias("_n"), F.col("b._n").alias("_m")).agg(F.count("*").alias("_both"))
    held = g.where((F.col("_both") == F.col("_n")) & ((F.col("_m") > F.col("_n")) | (F.col("other") < F.col("name")))).select(owner, "name").distinct()
    return rows.join(held, [owner, "name"], "left_anti").select(owner, "name")


def specificity(rows: DataFrame, by: str) -> DataFrame:
    """Score by key of (dated, compound, activity, documented) rows: 1, and 0.75, 0.5, 0.5 and 1 more, at most 3 each."""
    one = F.least(F.lit(3.0), 1 + F.when(F.col("dated"), 0.75).otherwise(0) + F.when(F.col("compound"), 0.5).otherwise(0) + F.when(F.col("activity"), 0.5).otherwise(0) + F.when(F.col("documented"), 1).otherwise(0))
    return rows.groupBy(by).agg(F.sum(one).alias("score"), F.count("*").alias("referents"))


def slots(rows: DataFrame, by: str, slot: str, names: list[str]) -> DataFrame:
    return rows.groupBy(by).pivot(slot, names).count().fillna(0)


def sufficiency(intakes: DataFrame, scores: DataFrame, owner: str, required: list[str], bar: float) -> DataFrame:
    """(owner, gaps, score, cleared): unfilled slots that nothing excuses, and a score that reaches the bar. intakes: slot columns, ``escapes`` array of excused slots."""
    gaps = F.array_compact(F.array(*[F.when(~fact_present(F.col(s)) & ~F.coalesce(F.array_contains("escapes", s), F.lit(False)), F.lit(s)) for s in required]))
    joined = intakes.join(scores.select(owner, "score"), owner, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return joined.select(owner, gaps.alias("gaps"), "score", ((F.size(gaps) == 0) & (F.col("score") >= bar)).alias("cleared"))


def intake_fingerprint(columns: list[str]) -> Column:
    """Digest of what was scored: fields in the order of their names, trimmed, nulls as empty."""
    return F.sha2(F.to_json(F.struct(*[F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).alias(c) for c in sorted(columns)])), 256)


def consume_tokens(tokens: DataFrame, known: DataFrame, as_of: str, life: str = "6 hours") -> DataFrame:
    """Adds refusal, the first that holds, or consumed. tokens: (token, fingerprint); known: (token, cleared, fingerprint, used, issued_at)."""
    k = known.select("token", "cleared", F.col("fingerprint").alias("_f"), "used", "issued_at", F.lit(True).alias("_k"))
    rule = (
        F.when(F.col("token").isNull() | (F.length("token") < 32), "token_absent")
        .when(F.col("_k").isNull(), "token_unknown")
        .when(~F.coalesce("cleared", F.lit(False)), "not_cleared")
        .when(~F.col("fingerprint").eqNullSafe(F.col("_f")), "fingerprint_mismatch")
        .when(F.col("used"), "token_already_used")
        .when(F.col("issued_at").isNull() | (F.col("issued_at") < F.lit(as_of).cast("timestamp") - F.expr(f"interval {life}")), "token_expired")
        .otherwise("consumed")
    )
    return tokens.join(k, "token", "left").select(*[tokens[c] if c != "token" else F.col("token") for c in tokens.columns], rule.alias("outcome"))


def axes_fingerprint(axes: Column) -> Column:
    """Digest of a composition: a map of axis to code, in the order of axes."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.map_entries(axes)), lambda e: F.concat(e.key, F.lit("="), e.value)), ";"), 256)


def draw_compositions(applicants: DataFrame, axes: DataFrame, rounds: int = 50) -> DataFrame:
    """(grant_id, applicant_id, draw, fingerprint, outcome): a code for every axis and a value of every grid, drawn again for those whose fingerprint an earlier one of the grant has.

    Every applicant has a row: placed, or refused without a fingerprint after ``rounds`` draws. axes: (axis, code), a vocabulary of at most
    ``VOCABULARY`` rows, which is put into the plan as literals. The code of least seeded hash is drawn, the last of equals; one round settles
    all but collisions, and rounds end when nobody is waiting.
    """
    listed = sorted(tuple(r) for r in axes.select("axis", "code").distinct().limit(VOCABULARY + 1).collect())
    if len(listed) > VOCABULARY:
        raise ValueError(f"more than {VOCABULARY} codes")
    names = {g[0] for g in GRIDS}
    entries = [(a, c, f"{a}|{c}") for a, c in listed if a not in names] + [(a, None, seed) for a, seed, _, _ in GRIDS]
    choices = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(c).cast("string").alias("code"), F.lit(s).alias("seed")) for a, c, s in entries])
    value = F.coalesce("code", *[F.when(F.col("axis") == a, (F.lit(least) + F.col("_h") % many).cast("string")) for a, _, least, many in GRIDS])
    done, waiting = [], applicants.select("grant_id", "applicant_id").distinct()
    for draw in range(rounds):
        seeded = waiting.select("*", F.explode(choices).alias("c")).select("grant_id", "applicant_id", "c.*")
        seeded = seeded.withColumn("_h", T.fnv1a(F.concat_ws("|", F.col("applicant_id").cast("string"), F.lit(str(draw)), "seed")))
        best = seeded.groupBy("grant_id", "applicant_id", "axis").agg(F.max(F.struct((-F.col("_h")).alias("h"), value.alias("code"))).alias("_b"))
        drawn = best.groupBy("grant_id", "applicant_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("axis", "_b.code")))).alias("axes"))
        drawn = drawn.withColumn("draw", F.lit(draw)).withColumn("fingerprint", axes_fingerprint(F.col("axes"))).drop("axes")
        marked = drawn.withColumn("_n", F.row_number().over(Window.partitionBy("grant_id", "fingerprint").orderBy("applicant_id")))
        if done:
            taken = reduce(DataFrame.unionByName, done).select(F.col("grant_id").alias("_g"), F.col("fingerprint").alias("_f"))
            marked = marked.join(taken, F.col("grant_id").eqNullSafe(F.col("_g")) & (F.col("fingerprint") == F.col("_f")), "left")
            marked = marked.withColumn("_n", F.when(F.col("_f").isNull(), F.col("_n")).otherwise(0)).drop("_g", "_f")
        marked = cut(marked)
        done.append(marked.where("_n = 1").drop("_n").withColumn("outcome", F.lit("placed")))
        waiting = marked.where("_n <> 1").select("grant_id", "applicant_id")
        if waiting.isEmpty():
            break
    refused = waiting.select("*", F.lit(None).cast("int").alias("draw"), F.lit(None).cast("string").alias("fingerprint"), F.lit("refused").alias("outcome"))
    return reduce(DataFrame.unionByName, [*done, refused])


def gap_detected(wants: Column, evidence: Column) -> Column:
    """The donor wants a record and no evidence tells of delivery."""
    return wants.rlike("(?i)experience|track record|past (?:project|performance)|previous (?:project|grant)") & ~F.exists(evidence, lambda e: e.rlike("(?i)project|programme|result|since|founded|deliver"))


def attributable(text: Column, tokens: Column) -> Column:
    """Some distinctive token of the applicant stands in the text as a word."""
    return F.exists(tokens, lambda t: F.array_contains(F.split(T.normal_title(text), " "), t))
