"""Member to opportunity candidates, match answers, alerts, credits and spend."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.lineage import cut
from ..functions.scan import running

# Questions whose expectations make up the fit, with their weights, and the scale's end.
FIT_WEIGHTS, FIT_SCALE = {"sector": 0.4, "capability": 0.6}, 3


#: Members of one kind stand in blocks of about this many, a task makes about this many pairs, and there are no more tasks than these.
MEMBER_BLOCK, TASK_PAIRS, MOST_TASKS = 1024, 1 << 22, 20_000
#: Up to so many members, at 24 bytes each, their blocks are sent to all executors; more are joined by a shuffle. So are ids of opportunities.
FEW_MEMBERS = 1_000_000


def _wanted(members: DataFrame) -> DataFrame:
    return members.select("user_id", "revision", F.explode(F.array_distinct("opportunity_types")).alias("kind")).where("kind is not null")


def candidates(members: DataFrame, opportunities: DataFrame, blocked: DataFrame, spent: DataFrame, matched: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(user_id, opportunity_id, group_key, group_version, revision) that are usable, not blocked, not paid for, and new or of another version.

    members: (user_id, opportunity_types array, revision); opportunities: (opportunity_id, kind, group_key, group_version, usable), one
    winner a group; matched: one row a (user_id, opportunity_id). ``keep`` are further columns of opportunities.

    The pairs are as many as members times opportunities of a kind, so they are made last and go nowhere: members stand in blocks of a kind with their places, what rules a pair out becomes places
    of blocks beside each opportunity and each group, and a block's other members are its pairs. An opportunity is moved as one row, once to what rules it out, once to its group; it is
    dealt to its blocks where its pairs are made, so what is moved grows with the tables.
    """
    wanted = _wanted(members)
    usable = opportunities.where("usable")
    kinds = wanted.groupBy("kind").agg(F.count("*").alias("_members"), F.ceil(F.count("*") / MEMBER_BLOCK).cast("int").alias("_blocks"))
    dealt = wanted.join(kinds, "kind").withColumn("_block", F.pmod(F.xxhash64("user_id", "revision", F.lit(1)), "_blocks").cast("int"))
    ends = F.struct("user_id", "revision")
    blocks = cut(dealt.groupBy("kind", "_block").agg(F.sort_array(F.collect_list(ends)).alias("_users")))
    few = (blocks.agg(F.sum(F.size("_users"))).first()[0] or 0) <= FEW_MEMBERS
    places = blocks.select("kind", "_block", F.posexplode("_users").alias("_place", "_u")).select("kind", "_block", "_place", "_u.user_id", "_u.revision")
    if few:
        blocks, places = F.broadcast(blocks), F.broadcast(places)

    own = usable.select("opportunity_id", "kind", "group_version").distinct()
    known = matched.select("user_id", "opportunity_id", F.col("revision").alias("_revision"), F.col("group_version").alias("_version"))
    asked = known.join(own, "opportunity_id").join(places, ["user_id", "kind"])
    fresh = F.col("_revision").isNull() | (F.col("_revision") != F.col("revision")) | (F.col("_version") != F.col("group_version"))
    pair = ["kind", "opportunity_id", "group_version", "_block", "_place"]
    ruled = asked.where(~F.coalesce(fresh, F.lit(False))).select(*pair).unionByName(blocked.join(own, ["opportunity_id", "group_version"]).join(places, ["user_id", "revision", "kind"]).select(*pair))
    paid = spent.join(places, ["user_id", "revision"])

    def by_block(rows: DataFrame, name: str, *by: str) -> DataFrame:
        """Each key's places as a map from blocks."""
        each = rows.groupBy(*by, "_block").agg(F.collect_set("_place").alias("_places"))
        return each.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_block", "_places"))).alias(name))

    def beside(rows: DataFrame, more: DataFrame, *by: str) -> DataFrame:
        """Rows with what ``more`` has of their keys, null for null."""
        more = more.withColumnsRenamed({c: f"_r_{c}" for c in by})
        same = F.lit(True)
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        return rows.join(more, same, "left").drop(*[f"_r_{c}" for c in by])

    key = ["kind", "group_key", "group_version"]
    rows = usable.select("opportunity_id", *key, *keep).join(kinds, "kind")
    sizes = cut(rows.groupBy(*key).agg(F.sum("_members").alias("_n")))  # a group of many pairs is dealt to several tasks
    tasks = sizes.agg(F.ceil(F.sum("_n") / TASK_PAIRS)).first()[0] or 1
    sizes = sizes.select(*key, F.ceil(F.col("_n") / TASK_PAIRS).cast("int").alias("_deals")).where("_deals > 1")
    rows = beside(rows, sizes, *key).withColumn("_deal", F.pmod(F.xxhash64("opportunity_id"), F.coalesce("_deals", F.lit(1))).cast("int")).drop("_deals", "_members")
    paid = beside(by_block(paid, "_paid", *key).where("group_key is not null and group_version is not null"), sizes, *key).withColumn("_deal", F.explode(F.sequence(F.lit(0), F.coalesce("_deals", F.lit(1)) - 1))).drop("_deals")
    rows = beside(rows, by_block(ruled, "_ruled", "kind", "opportunity_id", "group_version").where("opportunity_id is not null"), "kind", "opportunity_id", "group_version")
    rows = rows.repartition(min(int(tasks), MOST_TASKS), *key, "_deal").join(paid, [*key, "_deal"], "left")
    none = F.array().cast("array<int>")
    places_of = lambda c, b: F.coalesce(F.try_element_at(c, b), none)
    deals = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda b: F.struct(b.alias("_block"), F.array_union(places_of(F.col("_paid"), b), places_of(F.col("_ruled"), b)).alias("_out")))
    rows = rows.select("opportunity_id", "group_key", "group_version", *keep, "kind", F.explode(deals).alias("_d")).select("opportunity_id", "group_key", "group_version", *keep, "kind", "_d._block", "_d._out")
    met = rows.join(blocks, ["kind", "_block"]).withColumn("_place", F.explode(F.array_except(F.sequence(F.lit(0), F.size("_users") - 1), F.col("_out")))).withColumn("_u", F.get("_users", F.col("_place")))
    return met.select("_u.user_id", "opportunity_id", "group_key", "group_version", "_u.revision", *keep)


def newest(found: DataFrame, n: int = 20) -> DataFrame:
    """The newest candidates: a top-k report of candidates with fetched_at, which each task cuts to ``n`` before any is moved."""
    return found.orderBy(F.col("fetched_at").desc(), F.col("opportunity_id").desc(), "user_id").limit(n)


def newest_candidates(members: DataFrame, opportunities: DataFrame, blocked: DataFrame, spent: DataFrame, matched: DataFrame, n: int = 20) -> DataFrame:
    """What ``newest`` makes of the candidates, opportunities having fetched_at too; but pairs are made of those opportunities only that can be among the first.

    An opportunity of more members than rows that can rule any out has a candidate for certain. Below the ``n``-th of these, in order, none is among the first ``n``. These ``n`` are looked for
    among the newest opportunities, then among more.
    """
    kinds = _wanted(members).groupBy("kind").agg(F.count("*").alias("_members"))
    order = [F.col("fetched_at").desc(), F.col("opportunity_id").desc()]
    usable = opportunities.where("usable").join(kinds, "kind").select("opportunity_id", "group_key", "group_version", "fetched_at", "_members")
    most = 8 * n
    while True:
        first = cut(usable.orderBy(*order).limit(most))
        there = first.count()
        few = (lambda df: F.broadcast(df)) if there <= FEW_MEMBERS else (lambda df: df)
        against = first.withColumn("_against", F.lit(0))
        for rows, by in ((blocked, ["opportunity_id"]), (matched, ["opportunity_id"]), (spent, ["group_key", "group_version"])):
            counts = rows.join(few(first.select(*by).distinct()), by, "left_semi").groupBy(*by).agg(F.count("*").alias("_c"))
            against = against.join(counts, by, "left").withColumn("_against", F.col("_against") + F.coalesce("_c", F.lit(0))).drop("_c")
        sure = against.where("_members > _against").orderBy(*order).limit(n).collect()
        if len(sure) == n or there < most:
            break
        most *= 32
    if len(sure) == n and None not in (last := (sure[-1].fetched_at, sure[-1].opportunity_id)):
        at, id_ = map(F.lit, last)
        opportunities = opportunities.where((F.col("fetched_at") > at) | ((F.col("fetched_at") == at) & (F.col("opportunity_id") >= id_)))
        ids = opportunities.select("opportunity_id", "group_key", "group_version").distinct()
        if (kept := cut(ids)).count() <= FEW_MEMBERS:
            asked = F.broadcast(kept.select("opportunity_id").distinct())
            blocked, matched = (rows.join(asked, "opportunity_id", "left_semi") for rows in (blocked, matched))
            spent = spent.join(F.broadcast(kept.select("group_key", "group_version").distinct()), ["group_key", "group_version"], "left_semi")
    return newest(candidates(members, opportunities, blocked, spent, matched, ("fetched_at",)), n)


def is_member(as_of: str) -> Column:
    return (F.col("state") == "active") & (F.col("paid_until") > F.lit(as_of).cast("timestamp"))


def reserved_total(rows: DataFrame, by: list[str], cap: float) -> DataFrame:
    """Reservations against a cap, by key."""
    return rows.groupBy(*by).agg(F.sum("reserved").alias("reserved")).withColumn("left", F.lit(cap) - F.col("reserved"))


def winners(aliases: DataFrame, order: list[Column]) -> DataFrame:
    """The best usable alias of each (allowed kinds, group): ranked per set of kinds, so that members of one set share a row.

    aliases: (group_key, kind, allowed_kinds array, ...).
    """
    fits = aliases.where(F.array_contains("allowed_kinds", F.col("kind"))).withColumn("kind_set", F.array_join(F.array_sort("allowed_kinds"), ","))
    return fits.withColumn("_n", F.row_number().over(Window.partitionBy("kind_set", "group_key").orderBy(*order))).where("_n = 1").drop("_n")


def select_evidence(evidence: Column, title: Column, material: str, administrative: str, cap: int = 1600) -> Column:
    """(items, incomplete): no administrative, blank or title-like items; material labels first, stable; text cut to ``cap``."""
    kept = F.filter(evidence, lambda e: ~F.lower(e.label).rlike(administrative) & (F.trim(e.text) != "") & (F.lower(F.trim(e.text)) != F.lower(F.trim(title))))
    ranked = F.array_sort(F.transform(kept, lambda e, k: F.struct(F.when(F.lower(e.label).rlike(material), 0).otherwise(1).alias("rank"), k.alias("place"), e.alias("e"))))
    items = F.transform(ranked, lambda r: F.struct(r.e.label.alias("label"), F.substring(r.e.text, 1, cap).alias("text")))
    return F.struct(items.alias("items"), F.exists(kept, lambda e: F.length(e.text) > cap).alias("incomplete"))


def bounded_payload(body: Column, incomplete: Column, most: int = 24_000) -> Column:
    """Why a payload is blocked, or null."""
    return F.when(incomplete, "incomplete_evidence").when(F.octet_length(body) > most, "payload_too_large")


@F.pandas_udf(ArrayType(StringType()))
def chunks_at_words(text: pd.Series, most: pd.Series) -> pd.Series:
    """Pieces of at most ``most`` characters, cut at white space where there is any."""

    def cut(t: str | None, n: int) -> list[str]:
        out, rest = [], (t or "").strip()
        while len(rest) > n:
            at = rest.rfind(" ", 1, n + 1)
            at = at if at > 0 else n
            out.append(rest[:at].rstrip())
            rest = rest[at:].lstrip()
        return [*out, rest] if rest else out

    return pd.Series([cut(t, int(n)) for t, n in zip(text, most, strict=True)])


def chunk_text(rows: DataFrame, text: str, most: int = 1500, mode: str = "words") -> DataFrame:
    """One row a piece, with part (from 1) and parts."""
    if mode == "fixed":
        n = F.ceil(F.length(text) / most).cast("int")
        pieces = F.transform(F.sequence(F.lit(1), n), lambda k: F.substring(F.col(text), (k - 1) * most + 1, F.lit(most)))
        pieces = F.when(F.length(text) > 0, pieces).otherwise(F.array().cast("array<string>"))
    else:
        pieces = chunks_at_words(F.col(text), F.lit(most))
    cut = rows.withColumn("_pieces", pieces)
    return cut.select(*rows.columns, F.size("_pieces").alias("parts"), F.posexplode("_pieces").alias("part", "piece")).withColumn("part", F.col("part") + 1)


def expectation(answer: Column) -> Column:
    """Mean of a distribution over choices that are numbers."""
    return F.aggregate(F.map_entries(answer.probabilities), F.lit(0.0), lambda a, e: a + e.key.cast("double") * e.value)


def sound_answer(answer: Column) -> Column:
    """The distribution sums to 1 within 0.02, the score is its mean within 0.03, and the choice is a likeliest one."""
    total = F.aggregate(F.map_values(answer.probabilities), F.lit(0.0), lambda a, v: a + v)
    likeliest = F.element_at(answer.probabilities, answer.choice) == F.array_max(F.map_values(answer.probabilities))
    return (F.abs(total - 1) <= 0.02) & (F.abs(answer.score - expectation(answer)) <= 0.03) & F.coalesce(likeliest, F.lit(False))


def score_matches(rows: DataFrame) -> DataFrame:
    """Rows of (sector, capability, eligibility, complete) with fit, confidence and verdict; unsound ones have a reason and no fit.

    fit is 100 times the weighted mean on the scale, rounded half up; confidence is the least; a row without complete evidence is unclear.
    """
    sound = F.coalesce(sound_answer(F.col("sector")) & sound_answer(F.col("capability")), F.lit(False))
    mean = sum(w * F.col(f"{q}.score") for q, w in FIT_WEIGHTS.items()) / FIT_SCALE
    fit = F.floor(mean * 100 + 0.5).cast("int")
    likely = lambda q: F.array_max(F.map_values(F.col(f"{q}.probabilities")))
    return rows.withColumns(
        {
            "fit": F.when(sound, fit),
            "confidence": F.when(sound, F.least(*[likely(q) for q in FIT_WEIGHTS])),
            "verdict": F.when(~sound, "rejected").when(~F.col("complete"), "unclear").otherwise(F.col("eligibility")),
        }
    )


def new_alerts(matches: DataFrame, sent: DataFrame, fit: int = 70, confidence: float = 0.65) -> DataFrame:
    keys = ["user_id", "opportunity_id", "content_hash", "group_version"]
    return matches.where((F.col("fit") >= fit) & (F.col("confidence") >= confidence) & (F.col("eligibility") == "possible") & F.col("alerts_on")).join(sent.select(*keys), keys, "left_anti")


def standing_alerts(alerts: DataFrame, opportunities: DataFrame, matches: DataFrame, profiles: DataFrame) -> DataFrame:
    """Alerts whose opportunity, match and profile are all of the alert's versions."""
    out = alerts.join(opportunities.select("opportunity_id", "content_hash", "group_version"), ["opportunity_id", "content_hash", "group_version"], "left_semi")
    out = out.join(matches.select("user_id", "opportunity_id", "content_hash", "group_version"), ["user_id", "opportunity_id", "content_hash", "group_version"], "left_semi")
    return out.join(profiles.select("user_id", "revision"), ["user_id", "revision"], "left_semi")


def latest_alerts(alerts: DataFrame, most: int = 30) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("opportunity_id").desc())
    return alerts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def enrich(board: DataFrame, matches: DataFrame, paid: DataFrame, as_of: str) -> DataFrame:
    """fit and confidence only for members in credit whose match has the board's version."""
    member = paid.where(is_member(as_of)).select("user_id", F.lit(True).alias("_paid")).distinct()
    joined = board.join(matches.select("user_id", "opportunity_id", "fit", "confidence", F.col("group_version").alias("_v")), ["user_id", "opportunity_id"], "left").join(member, "user_id", "left")
    shown = F.coalesce(F.col("_paid"), F.lit(False)) & (F.col("_v") == F.col("group_version"))
    return joined.withColumns({c: F.when(shown, F.col(c)) for c in ("fit", "confidence")}).drop("_paid", "_v")


def unsave(saved: DataFrame, groups: DataFrame, removed: DataFrame) -> DataFrame:
    """Saved rows without those of any alias of a removed (user_id, opportunity_id)."""
    group_of = groups.select("opportunity_id", "group_key")
    gone = removed.join(group_of, "opportunity_id").select("user_id", "group_key").join(group_of, "group_key").select("user_id", "opportunity_id").distinct()
    return saved.join(gone, ["user_id", "opportunity_id"], "left_anti")


def running_cap(rows: DataFrame, by: list[str], order: list[Column], amount: str, cap: float) -> DataFrame:
    """Adds running (spent before and with a row, in ascending order), and accepted: whether it stays in the cap. A key may hold any share of the rows."""
    return running(rows, by, order, {"running": F.col(amount)}).withColumn("accepted", F.col("running") <= cap)


def first_crossing(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.where("not accepted").groupBy(*by).agg(F.min("running").alias("crossed_at"))


def spend_by_status(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("calls"), F.sum("reserved").alias("reserved"), F.sum("actual").alias("actual"), F.count(F.when(F.col("actual").isNull(), 1)).alias("unsettled"))


def available_credits(credits: DataFrame, as_of: str, lead: str = "31 minutes") -> DataFrame:
    """The credit of each user that expires first among those valid now and for ``lead`` more."""
    at = F.lit(as_of).cast("timestamp")
    valid = credits.where((F.col("valid_from") <= at) & (F.col("expires_at") > at + F.expr(f"interval {lead}")) & (F.col("state") == "available"))
    return valid.withColumn("_n", F.row_number().over(Window.partitionBy("user_id").orderBy("expires_at", "credit_id"))).where("_n = 1").drop("_n")


def paid_cycles(invoices: DataFrame) -> DataFrame:
    """One credit a settled invoice of a single line, and one a (subscription, cycle)."""
    settled = invoices.where((F.size("lines") == 1) & (F.col("status") == "paid"))
    line = F.element_at("lines", 1)
    return settled.groupBy("subscription_id", line.period_start.alias("cycle_start")).agg(F.min("invoice_id").alias("invoice_id"), F.max(line.period_end).alias("cycle_end"))


def asof_latest(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, value: str, back: str | None = None) -> DataFrame:
    """Adds value and its time: the right side's latest at or before each left row, not older than ``back``.

    Both sides meet in one scan by key, as a union; no pairs are formed, and a key may hold any share of the rows. Rights of the same time come first.
    """
    both = left.withColumns({"_at": F.col(left_at), "_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)}).unionByName(
        right.select(key, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_v")), allowMissingColumns=True
    )
    last = F.when(F.col("_side") == 0, F.struct(F.col("_at").alias("at"), F.col("_v").alias("v")))
    out = running(both, [key], [F.col("_at"), F.col("_side"), F.col("_v")], lasts={"_last": last}).where("_side = 1")
    near = F.lit(True) if back is None else F.col("_last.at") >= F.col("_at") - F.expr(f"interval {back}")
    return out.select(*left.columns, F.when(near, F.col("_last.v")).alias(value), F.when(near, F.col("_last.at")).alias("matched_at"))


#: Slots lie between -2**DEPTH and 2**DEPTH; an interval without a begin or an end reaches there.
DEPTH = 42


def dyadic(begin: Column, end: Column) -> Column:
    """(level, node) of the fewest aligned pieces, of 2**level slots each, that make up the slots from begin to end: two a level at most."""
    low = lambda k: F.ceil(begin / F.lit(1 << k)).cast("long")
    high = lambda k: F.floor((end + 1) / F.lit(1 << k)).cast("long")
    piece = lambda k, n: F.struct(F.lit(k).alias("level"), n.alias("node"))
    odd = lambda n: F.pmod(n, F.lit(2)) == 1
    sides = [F.when((low(k) < high(k)) & odd(n), piece(k, node(k))) for k in range(DEPTH + 1) for n, node in ((low(k), low), (high(k), lambda k: high(k) - 1))]
    return F.array_distinct(F.array_compact(F.array(*sides)))


def interval_join(points: DataFrame, intervals: DataFrame, key: str, at: str, begin: str, end: str, slot_seconds: int) -> DataFrame:
    """Points in [begin, end) of intervals of the same key; a null begin or end is open.

    An interval is dealt to the aligned pieces of several sizes that make up its slots, a few dozen however long it is, and a point to the piece of each size in use that holds it, so
    it is an equi-join without a row for each slot.
    """
    slot = lambda c: F.floor(F.unix_timestamp(c) / slot_seconds)
    low, high = F.coalesce(slot(F.col(begin)), F.lit(-(1 << DEPTH))), F.coalesce(slot(F.col(end)), F.lit((1 << DEPTH) - 1))
    dealt = intervals.withColumn("_piece", F.explode(dyadic(low, high))).withColumn("_level", F.col("_piece.level")).withColumn("_node", F.col("_piece.node")).drop("_piece")
    levels = sorted(r[0] for r in dealt.select("_level").distinct().collect())  # one of DEPTH + 1 each
    pieces = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(slot(F.col(at)) / F.lit(1 << k)).alias("node")) for k in levels]) if levels else F.array().cast("array<struct<level:int,node:bigint>>")
    spread = points.withColumn("_piece", F.explode(pieces)).withColumn("_level", F.col("_piece.level")).withColumn("_node", F.col("_piece.node")).drop("_piece")
    inside = (F.col(begin).isNull() | (F.col(at) >= F.col(begin))) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    return spread.join(dealt, [key, "_level", "_node"]).where(inside).drop("_level", "_node")


def reconcile(reservations: DataFrame, customers: DataFrame) -> DataFrame:
    """Reserved ones, and revoked ones that nothing settled, with their customers, oldest first."""
    left = reservations.where((F.col("state") == "reserved") | ((F.col("state") == "revoked") & ~F.col("resolved")))
    return left.join(customers, "user_id").orderBy("created_at", "user_id")
