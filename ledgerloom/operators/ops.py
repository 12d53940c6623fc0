"""Stages, verdicts, locks, spend and alarms over logs and order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Parts of a cap that are used up, from which a level holds.
CAP_LEVELS = [("exhausted", 1.0), ("critical", 0.90), ("warn", 0.75)]
# Dimensions that need 4; every dimension needs 3.
HIGH_DIMENSIONS = ["1", "3", "6", "10"]


def stage_rollup(stages: DataFrame, parent: str) -> DataFrame:
    """Done everywhere: complete; any failed or held: attention; else processing."""
    flags = stages.groupBy(parent).agg(F.bool_and(F.col("status") == "done").alias("_done"), F.bool_or(F.col("status").isin("failed", "held")).alias("_bad"), F.count("*").alias("n"))
    return flags.select(parent, "n", F.when(F.col("_done"), "complete").when(F.col("_bad"), "attention").otherwise("processing").alias("state"))


def order_rollup(proposals: DataFrame) -> DataFrame:
    """The same rule one level up, from (order_id, state)."""
    return proposals.groupBy("order_id").agg(F.when(F.bool_and(F.col("state") == "complete"), "complete").when(F.bool_or(F.col("state") == "attention"), "attention").otherwise("processing").alias("state"))


def ready_stages(stages: DataFrame, as_of: str, stale: str = "3 minutes") -> DataFrame:
    """Queued stages without an unfinished one before them and without a live one beside them, from (proposal_id, seq, status, heartbeat)."""
    own = Window.partitionBy("proposal_id")
    live = F.max(F.when((F.col("status") == "running") & (F.col("heartbeat") > F.lit(as_of).cast("timestamp") - F.expr(f"interval {stale}")), 1).otherwise(0)).over(own)
    first = F.min(F.when(F.col("status") != "done", F.col("seq"))).over(own)
    return stages.withColumns({"_live": live, "_first": first}).where((F.col("status") == "queued") & (F.col("seq") == F.col("_first")) & (F.col("_live") == 0)).drop("_live", "_first")


def latest_per(rows: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def trailing_streak(rows: DataFrame, by: str, order: list[str], klass: str) -> DataFrame:
    """(by, class, streak): how many rows at the end have the class of the last one."""
    run = Window.partitionBy(by).orderBy(*order)
    change = F.when(F.lag(klass).over(run).eqNullSafe(F.col(klass)), 0).otherwise(1)
    islands = rows.withColumn("_c", change).withColumn("_island", F.sum("_c").over(run))
    counted = islands.groupBy(by, "_island", klass).agg(F.count("*").alias("streak"))
    return counted.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.col("_island").desc()))).where("_n = 1").select(by, klass, "streak")


def improvement(rows: DataFrame, by: str, order: list[str], score: str) -> DataFrame:
    """Adds previous (the last score before, skipping nulls) and improved."""
    before = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("previous", F.last(score, ignorenulls=True).over(before)).withColumn("improved", F.col(score) > F.col("previous"))


def loop_decision(attempts: DataFrame, cap: float, most_unmeasured: int = 4, most_infra: int = 3, most_quality: int = 2, least_change: float = 0.20) -> DataFrame:
    """Adds decision for each attempt of (proposal_id, attempt, verdict, hold_class, score, material, changed, spend, unmeasured).

    First rule that holds: pass; the cap, of which the share of one cycle of the allowed number is kept in reserve; unmeasured calls; infrastructure holds in a row; no material change; no better score; quality holds.
    """
    own = Window.partitionBy("proposal_id").orderBy("attempt")
    so_far, before = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    infra = F.col("hold_class") == "infra"
    rows = attempts.withColumn("_break", F.when(infra, 0).otherwise(1)).withColumn("_island", F.sum("_break").over(so_far))
    streak = F.sum(F.when(infra, 1).otherwise(0)).over(Window.partitionBy("proposal_id", "_island").orderBy("attempt").rowsBetween(Window.unboundedPreceding, 0))
    quality = (F.col("verdict") != "pass") & (F.col("hold_class") == "quality")
    regens = F.count(F.when(quality, 1)).over(before)
    previous = F.last(F.when(quality, F.col("score")), ignorenulls=True).over(before)
    spent, unmeasured = F.sum("spend").over(so_far), F.sum("unmeasured").over(so_far)
    rule = (
        F.when(F.col("verdict") == "pass", "deliver")
        .when(F.col("_spent") + cap / (most_quality + 1) > cap, "hold")
        .when(F.col("_unmeasured") > most_unmeasured, "hold")
        .when(infra, F.when(F.col("_streak") < most_infra, "retry").otherwise("hold"))
        .when((F.col("material") == F.lit(False)) | (F.col("changed") < least_change), "refund")
        .when(F.col("score") <= F.col("_previous"), "refund")
        .when(F.col("_regens") + 1 > most_quality, "refund")
        .otherwise("regenerate")
    )
    out = rows.withColumns({"_streak": streak, "_regens": regens, "_previous": previous, "_spent": spent, "_unmeasured": unmeasured})
    return out.withColumn("decision", rule).select(*attempts.columns, "decision")


def arbitrate(claims: DataFrame) -> DataFrame:
    """Adds outcome to (grant_id, claim_id, org_id, fingerprint, at, flagged): the first claim of an organisation and of a fingerprint on a grant is granted.

    A refused organisation or a malformed fingerprint takes no place; a claim whose organisation has one already takes none either.
    """
    sound = ~F.coalesce(F.col("flagged"), F.lit(False)) & (F.coalesce(F.length("fingerprint"), F.lit(0)) >= 16)
    order = [F.col("at"), F.col("claim_id")]
    first_org = F.row_number().over(Window.partitionBy("grant_id", "org_id", "_sound").orderBy(*order)) == 1
    rows = claims.withColumn("_sound", sound).withColumn("_org", F.col("_sound") & first_org)
    first_print = F.row_number().over(Window.partitionBy("grant_id", "fingerprint", "_org").orderBy(*order)) == 1
    rows = rows.withColumn("_print", F.col("_org") & first_print)
    outcome = (
        F.when(F.coalesce(F.col("flagged"), F.lit(False)), "sanctions_screening")
        .when(~F.col("_sound"), "malformed_fingerprint")
        .when(~F.col("_org"), "existing_claim_same_org")
        .when(~F.col("_print"), "fingerprint_taken")
        .otherwise("granted")
    )
    return rows.withColumn("outcome", outcome).select(*claims.columns, "outcome")


def sticky_verdicts(rows: DataFrame, by: list[str], order: list[str], decision: str, sticky: Column) -> DataFrame:
    """Adds stands (the first sticky decision of the document) and role: first, replayed or superseded."""
    run = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    first = F.first(F.when(sticky, F.struct(*[F.col(o).alias(f"o{k}") for k, o in enumerate(order)], F.col(decision).alias("d"))), ignorenulls=True).over(run)
    own = F.struct(*[F.col(o) for o in order])
    rows = rows.withColumn("_first", first)
    at = F.struct(*[F.col(f"_first.o{k}") for k in range(len(order))])
    role = F.when(F.col("_first").isNull(), "open").when(own == at, "first").when(F.col(decision) == F.col("_first.d"), "replayed").otherwise("superseded")
    return rows.withColumn("stands", F.col("_first.d")).withColumn("role", role).drop("_first")


def request_replay(requests: DataFrame, cap: int) -> DataFrame:
    """Adds outcome to (proposal_id, key, body, at, request_id): replayed, conflict, accepted or over the cap of a proposal."""
    run = Window.partitionBy("proposal_id", "key").orderBy("at", "request_id")
    rows = requests.withColumns({"_n": F.row_number().over(run), "_body": F.first("body").over(run)})
    number = F.sum(F.when(F.col("_n") == 1, 1).otherwise(0)).over(Window.partitionBy("proposal_id").orderBy("at", "request_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_number", number)
    outcome = F.when((F.col("_n") > 1) & ~F.col("body").eqNullSafe(F.col("_body")), "request_conflict").when(F.col("_n") > 1, "replayed").when(F.col("_number") > cap, "no_revisions_left").otherwise("accepted")
    return rows.withColumn("outcome", outcome).select(*requests.columns, "outcome")


def usage(rows: DataFrame, by: list[str]) -> DataFrame:
    """Calls, tokens and cost; calls without a price are counted, not priced at nothing."""
    return rows.groupBy(*by).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.sum("usd").alias("usd"), F.count(F.when(F.col("usd").isNull(), 1)).alias("unpriced_calls"))


def cap_level(used: Column, cap: Column) -> Column:
    level = F.when(used.isNull(), "unknown").when(cap.isNull(), "unmetered")
    for name, part in CAP_LEVELS:
        level = level.when(used >= cap * part, name)
    return level.otherwise("ok")


def shared_credentials(keys: DataFrame) -> DataFrame:
    return keys.groupBy("fingerprint").agg(F.count("*").alias("uses"), F.sort_array(F.collect_set("service")).alias("services")).where("uses > 1")


def gate_score(scores: Column, disqualifiers: Column) -> Column:
    """Sum of the scores less 10 for each disqualifier."""
    return F.aggregate(F.map_values(scores), F.lit(0), lambda a, v: a + v) - 10 * F.size(F.filter(F.map_values(disqualifiers), lambda v: v))


def bar_failures(scores: Column, disqualifiers: Column) -> Column:
    """Names of what keeps a judgement under the bar."""
    low = F.transform(F.filter(F.map_entries(scores), lambda e: (e.value < 3) | (e.key.isin(HIGH_DIMENSIONS) & (e.value < 4))), lambda e: F.concat(F.lit("score "), e.key))
    out = F.transform(F.filter(F.map_entries(disqualifiers), lambda e: e.value), lambda e: F.concat(F.lit("disqualifier "), e.key))
    return F.array_sort(F.concat(low, out))


def combine_critics(rows: DataFrame, by: str, least: int = 2) -> DataFrame:
    """Any fail: hold; a missing verdict or too few: unavailable; else pass."""
    g = rows.groupBy(by).agg(F.bool_or(F.coalesce(F.col("verdict") == "fail", F.lit(False))).alias("_fail"), F.count("verdict").alias("verdicts"), F.count("*").alias("critics"))
    return g.select(by, "critics", "verdicts", F.when(F.col("_fail"), "hold").when((F.col("verdicts") < F.col("critics")) | (F.col("verdicts") < least), "unavailable").otherwise("pass").alias("verdict"))


def judge_agreement(rows: DataFrame, by: str) -> DataFrame:
    """Against asserted verdicts, from (by, gate, asserted, own_family, disputed): rates over what counts, and the baseline that always holds."""
    counts = ~F.col("own_family") & ~F.col("disputed")
    there = counts & F.col("gate").isNotNull()
    n = F.count(F.when(there, 1))
    return rows.groupBy(by).agg(
        n.alias("judged"),
        F.count(F.when(counts & F.col("gate").isNull(), 1)).alias("missing"),
        F.count(F.when(there & (F.col("gate") == F.col("asserted")), 1)).alias("agree"),
        F.count(F.when(there & (F.col("gate") == "pass") & (F.col("asserted") == "hold"), 1)).alias("false_pass"),
        F.count(F.when(there & (F.col("gate") == "hold") & (F.col("asserted") == "pass"), 1)).alias("false_hold"),
        F.count(F.when(there & (F.col("asserted") == "hold"), 1)).alias("baseline"),
        F.when(n > 0, F.count(F.when(there & (F.col("gate") == F.col("asserted")), 1)) / n).alias("agree_rate"),
    )


def kendall_tau(rows: DataFrame, cell: str, x: str, y: str) -> DataFrame:
    """(cell, pairs, tau): tau-b of x and y over all pairs of rows of a cell; tau is null where one side is all ties. Rows without cell, x or y don't count.

    No pair is made: of two rows with different x, the places of x in the cell differ first at some bit, where the greater has a one. So rows
    are counted by (bit, bits before it, y), in n log n map-side-combined rows, and a running count over y tells how many agree in order.
    """
    at = [cell, "_bit", "_head"]
    own = rows.where(F.col(cell).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(cell, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("_n"))
    choose = lambda c: F.sum(c * (c - 1) / 2).cast("long")
    ties = lambda name: own.groupBy(cell, name).agg(F.sum("_n").alias("_n")).groupBy(cell).agg(F.sum("_n").alias(f"_all{name}"), choose(F.col("_n")).alias(f"_tied{name}"))
    values = own.groupBy(cell, "_x").agg(F.count("*").alias("_k"))
    places = values.select(cell, "_x", (F.row_number().over(Window.partitionBy(cell).orderBy("_x")) - 1).cast("long").alias("_p"))
    top = places.groupBy(cell).agg(F.length(F.bin(F.max("_p"))).alias("_bits"))
    placed = own.join(places, [cell, "_x"]).join(top, cell)
    bits = placed.withColumn("_bit", F.explode(F.sequence(F.lit(0), F.col("_bits") - 1)))
    one = F.expr("shiftright(_p, _bit) & 1")
    counted = bits.groupBy(cell, "_bit", F.expr("shiftright(_p, _bit + 1)").alias("_head"), "_y").agg(F.sum(F.when(one == 0, F.col("_n")).otherwise(0)).alias("_low"), F.sum(F.when(one == 1, F.col("_n")).otherwise(0)).alias("_high"))
    by_y, whole = Window.partitionBy(*at).orderBy("_y").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*at)
    ranked = counted.withColumn("_under", F.coalesce(F.sum("_low").over(by_y), F.lit(0))).withColumn("_total", F.sum("_low").over(whole))
    score = ranked.groupBy(cell).agg(F.sum(F.col("_high") * (2 * F.col("_under") + F.col("_low") - F.col("_total"))).alias("_s"))
    g = score.join(ties("_x"), cell).join(ties("_y"), cell).withColumn("pairs", (F.col("_all_x") * (F.col("_all_x") - 1) / 2).cast("long")).where("pairs > 0")
    apart = lambda name: (F.col("pairs") - F.col(f"_tied{name}")).cast("double")
    return g.select(cell, "pairs", F.when((apart("_x") > 0) & (apart("_y") > 0), F.col("_s") / F.sqrt(apart("_x") * apart("_y"))).alias("tau"))


def gate_progress(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("verdicts"), F.count(F.when(F.col("decision") == "hold", 1)).alias("holds"), F.bool_or(F.col("decision") == "pass").alias("passed"), F.count_distinct("doc_hash").alias("documents"))


def alarms(rows: DataFrame, by: str, hit: Column, rate: float) -> DataFrame:
    """Rate of hits by key, and whether it is over the alarm's."""
    share = F.count(F.when(hit, 1)) / F.count("*")
    return rows.groupBy(by).agg(F.count("*").alias("n"), share.alias("rate"), (share > rate).alias("alarm"))


def queue_ages(rows: DataFrame, by: str, at: str, as_of: str) -> DataFrame:
    """Oldest and mean age in seconds by key."""
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(at)
    return rows.groupBy(by).agg(F.count("*").alias("waiting"), F.max(age).alias("oldest_s"), F.avg(age).alias("mean_s"))


def stranded_claims(claims: DataFrame, owners: DataFrame, as_of: str, patience: str = "2 minutes") -> DataFrame:
    """Live claims whose owner is gone, or that have had none for longer than ``patience``."""
    joined = claims.join(owners.select(F.col("owner_id"), F.lit(True).alias("_there")), "owner_id", "left")
    old = F.col("claimed_at") < F.lit(as_of).cast("timestamp") - F.expr(f"interval {patience}")
    return joined.where((F.col("state") == "live") & ((F.col("owner_id").isNotNull() & F.col("_there").isNull()) | (F.col("owner_id").isNull() & old))).drop("_there")


def ungated_orders(orders: DataFrame, clearances: DataFrame, key: str) -> DataFrame:
    return orders.join(clearances.select(key).distinct(), key, "left_anti")


def gate_outcomes(verdicts: DataFrame, orders: DataFrame) -> DataFrame:
    return verdicts.join(orders, "proposal_id").withColumn("n_findings", F.size("findings"))


def resolve_organisations(requests: DataFrame, organisations: DataFrame) -> DataFrame:
    """Adds org_id: by registration number, else by e-mail; of several the least."""
    by_number = organisations.where("registration_no is not null").groupBy("registration_no").agg(F.min("org_id").alias("_by_number"))
    by_mail = organisations.where("email is not null").groupBy(F.lower("email").alias("_mail")).agg(F.min("org_id").alias("_by_mail"))
    joined = requests.join(by_number, "registration_no", "left").withColumn("_mail", F.lower("email")).join(by_mail, "_mail", "left")
    return joined.withColumn("org_id", F.coalesce("_by_number", "_by_mail")).drop("_by_number", "_by_mail", "_mail")


def resolve_grants(requests: DataFrame, grants: DataFrame, title: Column) -> DataFrame:
    """Adds grant_id by (funder, normal title), null for a new one."""
    return requests.withColumn("title_normalized", title).join(grants.select("funder", "title_normalized", "grant_id"), ["funder", "title_normalized"], "left")


def distinct_compositions(claims: DataFrame) -> DataFrame:
    return claims.where("state = 'live'").groupBy("grant_id").agg(F.count("*").alias("live"), F.count_distinct("fingerprint").alias("fingerprints"), (F.count("*") - F.count_distinct("fingerprint")).alias("collisions"))


def unnotified(stages: DataFrame, n: int = 10) -> DataFrame:
    return stages.where(F.col("status").isin("done", "failed", "held") & F.col("notified_at").isNull()).orderBy("finished_at", "stage_id").limit(n)
