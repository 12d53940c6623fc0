"""The catalogue of notices: contract, qualification, grouping by identity, board, paging, coverage.

Notices have the columns id, source, source_key, title, kind, application_status, detail_status, deadline_conflict, geography,
deadline (date), fetched_at, identity_key, content_hash. Every job takes ``as_of`` instead of a clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

FRESH = "interval 24 hours"


def ts(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def group_key() -> Column:
    return F.coalesce("identity_key", F.concat(F.lit("id:"), F.col("id").cast("string")))


def fresh(as_of: str) -> Column:
    return F.col("fetched_at") > ts(as_of) - F.expr(FRESH)


def is_usable(as_of: str) -> Column:
    """Three-valued: null where the deadline is null and all else holds."""
    return (F.col("geography") == "confirmed") & (F.col("detail_status") == "verified") & ~F.col("deadline_conflict") & (F.col("application_status") == "open") & fresh(as_of) & (F.col("deadline") > ts(as_of).cast("date"))


def representative(notices: DataFrame, as_of: str) -> DataFrame:
    """Adds group_key, rank (1: stands for its group) and aliases (ids of the group)."""
    today = ts(as_of).cast("date")
    standing = (F.col("geography") == "confirmed") & (F.col("application_status") == "open") & (F.col("deadline").isNull() | (F.col("deadline") >= today))
    order = [is_usable(as_of).desc_nulls_first(), standing.desc_nulls_first(), ((F.col("detail_status") == "verified") & fresh(as_of)).desc_nulls_first()]
    order += [F.col(c).desc() for c in ("fetched_at", "source", "source_key", "id")]
    keyed = notices.withColumn("group_key", group_key())
    group = Window.partitionBy("group_key")
    # Aliases are gathered by a grouping, not a window, so that an alias list stands on one row of its group.
    ranked = keyed.withColumns({"rank": F.row_number().over(group.orderBy(*order)), "n_aliases": F.count("*").over(group)})
    return ranked


def aliases(notices: DataFrame) -> DataFrame:
    """(group_key, aliases): the ids of each group, in order."""
    return notices.groupBy(group_key().alias("group_key")).agg(F.sort_array(F.collect_list("id")).alias("aliases"))


def group_version(notices: DataFrame) -> DataFrame:
    """(group_key, n, version): digest of the content hashes in the order of source and key; only hashes are gathered."""
    member = F.struct("source", "source_key", "content_hash")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(member)), lambda m: m.content_hash), "|")
    return notices.groupBy(group_key().alias("group_key")).agg(F.count("*").alias("n"), F.md5(listed).alias("version"))


def group_conflict(notices: DataFrame, as_of: str) -> DataFrame:
    """Adds conflict: another fresh verified notice of the group has another deadline, kind or state.

    Counts by group and by group and value tell how many others differ; no pairs are formed.
    """
    keyed = notices.withColumn("group_key", group_key())
    sound = F.when((F.col("detail_status") == "verified") & fresh(as_of), 1).otherwise(0)
    same = Window.partitionBy("group_key", "deadline", "kind", "application_status")
    differing = F.sum(sound).over(Window.partitionBy("group_key")) - F.sum(sound).over(same)
    return keyed.withColumn("conflict", differing > 0)


def board_status(as_of: str, conflict: Column | None = None) -> Column:
    today = ts(as_of).cast("date")
    conflict = F.lit(False) if conflict is None else conflict
    sound = (F.col("detail_status") == "verified") & ~F.col("deadline_conflict") & ~conflict & fresh(as_of) & (F.col("deadline") > today)
    return F.when(F.col("application_status").isin("closed", "not_open") | (F.col("deadline") < today), "closed").when(sound, "current").otherwise("needs_review")


def filter_catalogue(notices: DataFrame, text: str | None = None, kind: str | None = None, source: str | None = None, status: str | None = None, deadline_before: str | None = None) -> DataFrame:
    """Groups with any alias that meets each test, which one pass of flags per group decides."""
    tests = []
    if text:
        tests.append(F.contains(F.lower("title"), F.lit(text.lower())))
    if source:
        tests.append(F.col("source") == source)
    keyed = notices.withColumn("group_key", group_key())
    for k, test in enumerate(tests):
        keyed = keyed.withColumn(f"_any{k}", F.max(F.coalesce(test, F.lit(False))).over(Window.partitionBy("group_key"))).where(f"_any{k}").drop(f"_any{k}")
    if kind:
        keyed = keyed.where(F.col("kind") == kind)
    if status:
        keyed = keyed.where(F.col("application_status") == status)
    if deadline_before:
        keyed = keyed.where(F.col("deadline") < F.lit(deadline_before).cast("date"))
    return keyed


def keyset_page(rows: DataFrame, keys: list[str], cursor: tuple | None = None, size: int = 50, filters: str = "") -> DataFrame:
    """The next ``size`` + 1 rows in falling order of keys; the extra row tells that there are more. Adds the digest of the filters that a cursor is bound to."""
    if cursor is not None:
        after = F.struct(*[F.lit(v).cast(rows.schema[k].dataType).alias(k) for k, v in zip(keys, cursor, strict=True)])
        rows = rows.where(F.struct(*keys) < after)
    return rows.orderBy(*[F.col(k).desc() for k in keys]).limit(size + 1).withColumn("filter_hash", F.sha2(F.lit(filters), 256))


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One row a key: the newest, and of equally new ones the incoming one. Commutes with late deliveries."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(F.col(at).desc_nulls_last(), F.col("_new").desc(), *[F.col(c).desc() for c in existing.columns if c not in (*keys, at)])
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_new")


def call_statements(text: Column) -> Column:
    """(closed, deadline_text): what a call page says of its own end."""
    closed = text.rlike(r"(?i)\b(call|applications?|submissions?)\b[^.\n]{0,40}\b(is|are|now) closed\b|\bclosed for applications\b")
    return F.struct(closed.alias("closed"), F.nullif(F.regexp_extract(text, r"(?i)\b(?:deadline|closing date|apply by|no later than)\b[: ]+([^.\n]{4,60})", 1), F.lit("")).alias("deadline_text"))


def extract_countries(rows: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(id, country_codes, scope) from (id, evidence) and a gazetteer of (code, alpha3, name); sorted codes, or worldwide, or unknown if both.

    Words of the evidence meet codes, and its text names, by equi-joins on the first word.
    """
    placed = rows.select("id", F.explode("evidence").alias("e")).where(F.lower("e.label").rlike("country|location|place|region"))
    world = placed.groupBy("id").agg(F.max(F.col("e.text").rlike("(?i)worldwide|global|all countries")).alias("world"))
    words = placed.select("id", F.col("e.text").alias("text"), F.explode(F.array_distinct(F.split(F.col("e.text"), "[^\\p{L}]+"))).alias("word"))
    codes = gazetteer.select("code", F.explode(F.array("code", "alpha3")).alias("word"))
    names = gazetteer.select("code", "name", F.lower(F.split("name", " ")[0]).alias("first"))
    by_code = words.join(codes, "word").select("id", "code")
    by_name = words.join(names, F.lower("word") == F.col("first")).where(F.contains(F.lower("text"), F.lower("name"))).select("id", "code")
    found = by_code.unionByName(by_name).groupBy("id").agg(F.sort_array(F.collect_set("code")).alias("codes"))
    joined = rows.select("id").distinct().join(found, "id", "left").join(world, "id", "left")
    some, everywhere = F.col("codes").isNotNull(), F.coalesce("world", F.lit(False))
    return joined.select("id", F.when(some & ~everywhere, F.col("codes")).otherwise(F.array().cast("array<string>")).alias("country_codes"), F.when(everywhere & ~some, "worldwide").when(some & ~everywhere, "countries").otherwise("unknown").alias("scope"))


def record_hash(locales: Column) -> Column:
    """Digest over the locales in order of locale, without what fetching sets."""
    ordered = F.array_sort(F.transform(locales, lambda x: F.struct(x.locale, x.sourceUrl, x.title, x.description, x.deadline.cast("string").alias("deadline"), x.evidence)))
    return F.sha2(F.to_json(ordered), 256)


def detail_status(locales: Column, status: Column) -> Column:
    return F.when(F.exists(locales, lambda x: F.coalesce(x.detailNeedsRefresh, F.lit(False))), "partial").otherwise(status)


def merge_locales(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of (source_key, locale, title, deadline, verified): verified detail stays unless the new row has it; primary is en; unequal deadlines conflict and null the deadline."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, ["source_key", "locale"], "full_outer")
    keep_old = F.coalesce(F.col("o.verified"), F.lit(False)) & ~F.coalesce(F.col("n.verified"), F.lit(False))
    pick = lambda c: F.when(keep_old, F.col(f"o.{c}")).otherwise(F.coalesce(f"n.{c}", f"o.{c}")).alias(c)
    rows = both.select("source_key", "locale", pick("title"), pick("deadline"), pick("verified"), (keep_old & F.col("n.title").isNotNull()).alias("needs_refresh"))
    first = F.min(F.struct(F.when(F.col("locale") == "en", 0).otherwise(1).alias("rank"), "locale", "title"))
    conflict = F.count_distinct("deadline") > 1
    return rows.groupBy("source_key").agg(
        first["title"].alias("title"), F.when(~conflict, F.max("deadline")).alias("deadline"), conflict.alias("deadline_conflict"), F.sort_array(F.collect_list("locale")).alias("locales"), F.max("needs_refresh").alias("needs_refresh")
    )


def status_rollup(rows: DataFrame, by: list[str], at: str, cube: bool = False) -> DataFrame:
    grouped = (rows.cube if cube else rows.rollup)(*by)
    return grouped.agg(F.count("*").alias("n"), F.max(at).alias("latest"), F.grouping_id().cast("long").alias("level"))


def coverage(rows: DataFrame, by: list[str], key: str, expected: DataFrame) -> DataFrame:
    """Per stream: records, unique records and the expected total, and whether they reconcile."""
    found = rows.groupBy(*by).agg(F.count("*").alias("records"), F.count_distinct(key).alias("unique_records"))
    both = expected.join(found, by, "full_outer")
    n, u = F.coalesce("records", F.lit(0)), F.coalesce("unique_records", F.lit(0))
    verdict = F.when(F.col("expected_total").isNull(), "unexpected_stream").when(n != u, "duplicates").when(u < F.col("expected_total"), "incomplete").when(u > F.col("expected_total"), "surplus").otherwise("complete")
    return both.select(*by, n.alias("records"), u.alias("unique_records"), "expected_total", verdict.alias("verdict"))


def batch_scope(batch: DataFrame, allowed: DataFrame) -> DataFrame:
    """(source, missing, unexpected): sources of the allowed list without rows and rows of sources outside it."""
    seen = batch.groupBy("source").agg(F.count("*").alias("n"))
    return allowed.select("source", F.lit(True).alias("listed")).join(seen, "source", "full_outer").select("source", F.col("n").isNull().alias("missing"), F.col("listed").isNull().alias("unexpected"))


def facet(rows: DataFrame, codes: str, scope: str, everything: DataFrame) -> DataFrame:
    """(code): all codes if some row is worldwide, else those that occur."""
    found = rows.select(F.explode(codes).alias("code")).distinct()
    world = rows.where(F.col(scope) == "worldwide").select(F.lit(1).alias("_k")).limit(1)
    return found.unionByName(everything.select("code", F.lit(1).alias("_k")).join(world, "_k", "left_semi").select("code")).distinct()


def page_sequence_audit(rows: DataFrame, batch: str, place: str, key: str, total: str) -> DataFrame:
    """Per batch: the first fault of its numbered rows, in order: duplicate ids, a gap, another number of rows than stated, none.

    Places count from 1, and there is a gap if fewer different ones stand than the greatest says; so counts tell, no batch is sorted, and it may hold any share of the rows.
    """
    counted = rows.groupBy(batch).agg(
        F.count("*").alias("rows"), F.count(key).alias("_ids"), F.count_distinct(key).alias("_different"), F.max(total).alias("_total"),
        F.max(place).alias("_last"), F.count_distinct(F.when(F.col(place) >= 1, F.col(place))).alias("_places"),
    )
    twice = (F.col("_ids") > F.col("_different")) | (F.col("rows") - F.col("_ids") > 1)
    return counted.select(batch, "rows", F.when(twice, "duplicate_id").when(F.col("_places") < F.col("_last"), "gap").when(F.col("_total") != F.col("rows"), "total_mismatch").otherwise("ok").alias("fault"))


def fair_queue(rows: DataFrame, klass: str, order: list[Column]) -> DataFrame:
    """Adds turn: two classes take turns in their own order; when one is used up the other goes on.

    A class may hold most rows, so it isn't ranked in one task: rows are dealt to ranges of the order, ranked in their range, and moved on by what
    stands in the ranges before, of which there are as many as partitions. The ranges are kept, as drawing them again could give others.
    """
    own = [F.col(klass), *order]
    dealt = cut(rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *own).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy(klass, "_range").agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy(klass).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    offsets = sizes.select(F.col(klass).alias("_class"), F.col("_range").alias("_at"), F.coalesce(ahead, F.lit(0)).alias("_ahead"))
    placed = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(klass, "_range").orderBy(*order)))
    joined = placed.join(F.broadcast(offsets), F.col(klass).eqNullSafe(F.col("_class")) & (F.col("_range") == F.col("_at")))
    return joined.withColumn("turn", (F.col("_place") + F.col("_ahead")).cast("int")).drop("_range", "_place", "_class", "_at", "_ahead")


def due_ids(rows: DataFrame, tried: str, size: int) -> DataFrame:
    """Never tried ones first, then the oldest attempt."""
    return rows.orderBy(F.col(tried).isNotNull(), F.col(tried), "id").limit(size)


def snapshot_changes(snapshots: DataFrame, key: str, at: str, digest: str) -> DataFrame:
    """Adds changed: whether a snapshot differs from the one before; null for the first."""
    before = F.lag(digest).over(Window.partitionBy(key).orderBy(at))
    return snapshots.withColumn("changed", F.when(before.isNotNull(), before != F.col(digest)))


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): what only one side has."""
    only = lambda a, b, name: a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").withColumn("side", F.lit(name))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def backlog(rows: DataFrame, as_of: str) -> DataFrame:
    """Per source: notices in scope, verified, fresh, stale and pending."""
    ok = F.col("detail_status") == "verified"
    return rows.groupBy("source").agg(
        F.count("*").alias("scoped"), F.count(F.when(ok, 1)).alias("verified"), F.count(F.when(ok & fresh(as_of), 1)).alias("fresh"), F.count(F.when(ok & ~fresh(as_of), 1)).alias("stale"), F.count(F.when(~ok, 1)).alias("pending")
    )


def validate(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds reasons: the names of the rules that a row breaks, a null verdict included."""
    return rows.withColumn("reasons", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])))


def valid_source_pair(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds paired: whether the row's (source, host) is listed."""
    return rows.join(pairs.select("source", "host", F.lit(True).alias("_p")).distinct(), ["source", "host"], "left").withColumn("paired", F.col("_p").isNotNull()).drop("_p")
