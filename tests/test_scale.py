"""Joins and scans that no key should crowd: against plain loops, with one key that holds all rows."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.scan import running
from ledgerloom.operators import catalogue, dedupe, matching, webcurate


@pytest.mark.parametrize("keys", [1, 3, 40])
def test_scan_against_a_loop(spark, keys):
    rng = random.Random(keys)
    rows = [(None if keys > 1 and rng.random() < 0.1 else rng.randrange(keys), k, rng.choice([None, k % 7, 5]), rng.choice([None, None, f"v{k}"])) for k in range(1000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, at int, x int, v string").repartition(5)
    found = running(df, ["k"], [F.col("at")], {"so_far": F.col("x")}, {"last_v": F.col("v")})
    want, state = {}, {}
    for k, at, x, v in sorted(rows, key=lambda r: r[1]):
        s, last = state.get(k, (None, None))
        s, last = (s if x is None else (s or 0) + x), (v or last)
        state[k] = s, last
        want[at] = (k, x, v, s, last)
    assert {r.at: (r.k, r.x, r.v, r.so_far, r.last_v) for r in found.collect()} == want
    assert running(df.limit(0), ["k"], [F.col("at")], {"s": F.col("x")}).count() == 0


def test_no_task_holds_a_hot_key(spark):
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("at"), F.lit(2).alias("x"))
    found = running(df, ["k"], [F.col("at")], {"s": F.col("x")})
    sizes = found.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 20_000 and found.agg(F.max("s")).first()[0] == 40_000


def test_asof_and_cap_and_budget_on_one_key(spark):
    rng = random.Random(3)
    at = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=n)
    left, right = [(1, at(rng.randrange(5000)), k) for k in range(300)], sorted({at(rng.randrange(5000)) for _ in range(200)})
    df = matching.asof_latest(spark.createDataFrame(left, "u int, t timestamp, n int"), spark.createDataFrame([(1, t, k) for k, t in enumerate(right)], "u int, s timestamp, v int"), "u", "t", "s", "v", back="60 minutes")
    for r in df.collect():
        before = [k for k, t in enumerate(right) if r.t - datetime.timedelta(minutes=60) <= t <= r.t]
        assert r.v == (before[-1] if before else None)
    cap = matching.running_cap(spark.createDataFrame([(1, k, 10) for k in range(50)], "u int, k int, a int"), ["u"], [F.col("k")], "a", 200).collect()
    assert sorted((r.k, r.running, r.accepted) for r in cap) == [(k, 10 * k + 10, k < 20) for k in range(50)]
    kept = spark.createDataFrame([("s", k, 0, "x" * 100) for k in range(40)], "site string, page_id int, place int, paragraph string")
    assert sorted(r.page_id for r in webcurate.within_budget(kept, 1000).collect()) == list(range(10))


def test_page_audit(spark):
    rows = [("ok", 1, "a", 2), ("ok", 2, "b", 2), ("dup", 1, "a", 2), ("dup", 2, "a", 2), ("gap", 1, "a", 2), ("gap", 3, "b", 2), ("late", 2, "a", 1), ("few", 1, "a", 3), ("twin", 1, "a", 2), ("twin", 1, "b", 2)]
    got = {r.b: r.fault for r in catalogue.page_sequence_audit(spark.createDataFrame(rows, "b string, p int, k string, t int"), "b", "p", "k", "t").collect()}
    assert got == {"ok": "ok", "dup": "duplicate_id", "gap": "gap", "late": "gap", "few": "total_mismatch", "twin": "ok"}


def test_pieces_make_up_the_interval(spark):
    rng = random.Random(8)
    spans = [(a := rng.randrange(-300, 300), a + rng.randrange(0, 400)) for _ in range(60)] + [(5, 4)]
    for r in spark.createDataFrame(spans, "b long, e long").select("*", matching.dyadic(F.col("b"), F.col("e")).alias("p")).collect():
        slots = sorted(s for p in r.p for s in range(p.node << p.level, (p.node + 1) << p.level))
        assert slots == list(range(r.b, r.e + 1)) and len(r.p) <= 2 * 10


def test_open_and_long_intervals(spark):
    at = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    points = spark.createDataFrame([(1, 10, at(5)), (1, 11, at(9)), (2, 12, at(5)), (1, 13, None), (1, 14, datetime.datetime(1980, 1, 1))], "u int, p int, t timestamp")
    spans = [(1, "open", at(6), None), (1, "century", at(5), datetime.datetime(2124, 1, 1)), (1, "none", at(5), at(5)), (1, "always", None, None), (2, "until", None, at(5)), (2, "from", at(5), at(5, 1)), (1, "back", at(9), at(3))]
    found = matching.interval_join(points, spark.createDataFrame(spans, "u int, c string, b timestamp, e timestamp"), "u", "t", "b", "e", 3600)
    assert sorted((r.p, r.c) for r in found.collect()) == [(10, "always"), (10, "century"), (11, "always"), (11, "century"), (11, "open"), (12, "from"), (14, "always")]
    assert matching.interval_join(points, spark.createDataFrame([], "u int, c string, b timestamp, e timestamp"), "u", "t", "b", "e", 3600).count() == 0


def test_recall_of_bands(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 32))
    near = base + rng.standard_normal((300, 32)) * rng.uniform(0.1, 0.75, (300, 1))
    v = np.concatenate([base, near])
    days = rng.integers(0, 60, 600)
    rows = [(int(k), 1, x.tolist(), datetime.date(2024, 1, 1) + datetime.timedelta(days=int(d))) for k, (x, d) in enumerate(zip(v, days, strict=True))]
    rows += [(900, 1, [0.0] * 32, datetime.date(2024, 1, 1)), (901, 1, None, datetime.date(2024, 1, 1)), (902, 1, [], None), (903, None, v[0].tolist(), datetime.date(2024, 1, 1))]
    got = {(r.a, r.b): r.cosine for r in dedupe.merge_candidates(spark.createDataFrame(rows, "id long, version int, vector array<double>, deadline date")).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    all_pairs = unit @ unit.T
    want = {(a, b) for a in range(600) for b in range(a + 1, 600) if all_pairs[a, b] >= 0.85 and abs(days[a] - days[b]) <= 7}
    assert set(got) <= want and len(want) > 30 and len(got) >= 0.98 * len(want)
    assert all(abs(c - all_pairs[p]) < 1e-9 for p, c in got.items())


def test_candidates_make_pairs_last(spark):
    rng = random.Random(11)
    members = [(None if k == 7 else k, [rng.choice(["a", "b"]), "c"][: rng.randrange(3)], rng.choice([0, 1, None])) for k in range(40)]
    opportunities = [(None if k == 9 else k, rng.choice(["a", "b", "c", None]), rng.choice(["g1", "g2", None]), rng.choice(["v1", "v2", None]), rng.random() < 0.8) for k in range(60)]
    some = lambda *of: tuple(rng.choice(x) for x in of)
    users, ids, versions = [*range(40), None], [*range(60), None], ["v1", "v2", None]
    blocked = [some(users, ids, [0, 1, None], versions) for _ in range(1500)]
    spent = [some(users, ["g1", "g2", None], [0, 1, None], versions) for _ in range(60)]
    matched = [(u, o, *some([0, 1, None], versions)) for u, o in {some(users, ids) for _ in range(1500)}]
    unlike = lambda x, y: None if x is None or y is None else x != y
    want = []
    for u, kinds, revision in members:
        for o, kind, group, version, usable in opportunities:
            if not usable or kind is None or kind not in kinds:
                continue
            if None not in (u, o, revision, version) and (u, o, revision, version) in blocked or None not in (u, group, revision, version) and (u, group, revision, version) in spent:
                continue
            known = [(r, v) for x, y, r, v in matched if None not in (u, o) and (x, y) == (u, o)]
            if all(r is None or unlike(r, revision) or unlike(v, version) for r, v in known):
                want.append((u, o, group, version, revision))
    tables = [
        spark.createDataFrame(rows, fields)
        for rows, fields in (
            (members, "user_id long, opportunity_types array<string>, revision int"), (opportunities, "opportunity_id long, kind string, group_key string, group_version string, usable boolean"), (blocked, "user_id long, opportunity_id long, revision int, group_version string"),
            (spent, "user_id long, group_key string, revision int, group_version string"), (matched, "user_id long, opportunity_id long, revision int, group_version string"),
        )
    ]
    found = matching.candidates(*tables)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want)) and len(want) > 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange")  # nothing moves pairs
    assert matching.candidates(*[t.limit(0) for t in tables]).count() == 0


def test_lines_are_made_plain_once_and_batches_are_cut(spark):
    import pandas as pd

    asked = [f"asked for line number {k}" for k in range(40)]
    told = ["# *Asked* for  line number 7", "", "x", "own words", "we say asked for line number 3 twice", *asked]
    column = dedupe.without_lines(F.col("t"), F.col("d"))
    row = spark.createDataFrame([("\n".join(told), asked)], "t string, d array<string>").select(column.alias("x")).first()
    assert row.x == "\nx\nown words" or row.x == "\nown words"
    assert str(column).count("^#+") == 1
    sizes = [len(b) for b in dedupe.slices(iter([pd.DataFrame({"x": range(1000)}), pd.DataFrame({"x": []})]))]
    assert sum(sizes) == 1000 and max(sizes) <= 64


def test_no_close_grant_is_missed(spark):
    rng = np.random.default_rng(5)
    mids = rng.standard_normal((6, 16))
    rows = [(k, int(k % 2), [float(x) for x in mids[k % 6] + 0.55 * rng.standard_normal(16)], datetime.date(2024, 1, 1) + datetime.timedelta(days=int(k * 7 % 30))) for k in range(400)]
    rows += [(900, 0, [0.0] * 16, datetime.date(2024, 1, 1)), (901, 0, None, datetime.date(2024, 1, 1)), (902, 0, [1.0, 2.0], datetime.date(2024, 1, 1)), (903, 0, [2.0, 4.0], datetime.date(2024, 1, 8)), (904, 0, [2.0, 4.0], None)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = {
        (a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and None not in (*a, *b) and len(a[2]) == len(b[2]) and abs((a[3] - b[3]).days) <= 7
        and dot(a[2], a[2]) * dot(b[2], b[2]) > 0 and dot(a[2], b[2]) / (dot(a[2], a[2]) * dot(b[2], b[2])) ** 0.5 >= 0.85
    }
    old = dedupe.GRANT_BLOCK if hasattr(dedupe, "GRANT_BLOCK") else None
    try:
        dedupe.GRANT_BLOCK = 20
        df = spark.createDataFrame(rows, "id long, version int, vector array<double>, deadline date")
        found = [(r.a, r.b) for r in dedupe.merge_candidates(df).collect()]
    finally:
        dedupe.GRANT_BLOCK = old
    assert sorted(found) == sorted(want) and (902, 903) in want and len(want) > 200


def test_title_sql_decodes_as_the_query(duck):
    import html

    from ledgerloom.plans.text_queries import ORACLES

    titles = ["a&amp", "&ampx;b &notit; &notin; &#39;&#x27;&#X27 &#128;&#0;&#xD800;&#1114112;&#99999999999999999999;&#1;z", "&;& &nosuch; &lt;&LT&gt;", "it's &apos;&quot;", "", "&amp;amp; é&eacute&Eacute;", "&CounterClockwiseContourIntegral;&NotEqualTilde;"]
    c = duck.cursor()
    c.execute("create temp table pages (page_id bigint, html varchar)")
    c.executemany("insert into pages values (?, ?)", [(k, f"<title>{t}</title>") for k, t in enumerate(titles)])
    want = {k: html.unescape(t.split("<")[0]) for k, t in enumerate(titles)}
    assert dict(c.execute(ORACLES["decoded_titles"]).fetchall()) == want


def _pieced(seed, n):
    """Texts of groups, made of a few long pieces in any order, so that runs branch, overlap and repeat; some are copies."""
    rng = random.Random(seed)
    pieces = [[f"p{k}w{i}" for i in range(rng.randrange(5, 45))] for k in range(7)]
    texts = [[w for _ in range(rng.randrange(1, 6)) for w in (rng.choice(pieces) if rng.random() < 0.8 else [f"own{rng.getrandbits(60)}"])] for _ in range(n)]
    rows = [(k, rng.choice(["g", "h"]), " ".join(x)) for k, x in enumerate(texts)]
    return [*rows, *[(n + k, g, t) for k, (_, g, t) in enumerate(rows[:5])], (None, "g", rows[0][2]), (900, None, rows[0][2]), (901, "g", None), (902, "g", "")]


@pytest.mark.parametrize("seed", [1, 2])
def test_shared_runs_against_all_pairs(spark, seed):
    rows, least = _pieced(seed, 40), dedupe.RUN_CAP + 1
    words = {k: (g, t.split()) for k, g, t in rows if None not in (k, g, t)}

    def longest(x, y):
        best, last = 0, [0] * (len(y) + 1)
        for a in x:
            last = [0] + [last[j] + 1 if a == b else 0 for j, b in enumerate(y)]
            best = max(best, *last)
        return best

    windows = {k: {tuple(x[i : i + least]) for i in range(len(x) - least + 1)} for k, (_, x) in words.items()}
    runs, partners = {}, {}
    for k, (g, x) in words.items():
        others = [j for j, (other, _) in words.items() if other == g and j != k]
        n, worst = max((longest(x, words[j][1]), -j) for j in others)
        if n >= least:
            runs[k], partners[k] = (-worst, n, True), max(sum(w in windows[j] for j in others) for w in windows[k])
    df = spark.createDataFrame(rows, "id long, grp string, text string").repartition(3)
    assert {r.id: (r.worst_partner, r.longest_run, r.holds) for r in dedupe.longest_shared_run(df, "id", "grp", "text").collect()} == runs and len(runs) > 10
    assert {r.id: r.partners for r in dedupe.shared_run_flags(df, "id", "grp", "text").collect()} == partners


def _moved(spark):
    """Rows that stages have written to shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    doubles = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, doubles, None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


@pytest.mark.parametrize("query", ["longest_shared_run", "shared_run_flags"])
def test_only_windows_that_can_be_shared_are_moved(spark, query):
    own = lambda k: [f"d{k}w{i}" for i in range(300)]
    passage = [f"said{i}" for i in range(60)]
    rows = [(k, "g", " ".join(own(k) + (passage if k < 2 else []) + own(-k))) for k in range(100)]
    df, before = spark.createDataFrame(rows, "id long, grp string, text string"), _moved(spark)
    assert {r.id for r in getattr(dedupe, query)(df, "id", "grp", "text").collect()} == {0, 1}
    assert 0 < _moved(spark) - before < 0.3 * 100 * 575  # of 575 windows a text


def test_asked_lines_are_made_plain_once(spark):
    """Once a text, or once a form if they are a column: in no lambda over the text's lines."""
    plan = spark.createDataFrame([("a", ["b"])], "t string, d array<string>").select(dedupe.without_lines(F.col("t"), F.col("d")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(lambda" in plan and "exists(filter(" not in plan


def _market(spark, seed, users=40, n=60, rule=1500):
    """Random members, opportunities of the same and of no time, and what rules pairs out; the newest opportunity is blocked for all."""
    rng = random.Random(seed)
    some = lambda *of: tuple(rng.choice(x) for x in of)
    members = [(k, some("ab")[0], k % 2) for k in range(users)]
    opportunities = [(k, some("abc")[0], *some(["g1", "g2", None], ["v1", "v2", None]), rng.random() < 0.8, rng.choice([None, 1.0, 2.0, 3.0])) for k in range(n)] + [(n, "a", "g1", "v1", True, 9.0), (n, "a", None, "v1", True, 9.0)]
    blocked = [(u, n, r, "v1") for u, _, r in members] + [some(range(users), range(n), [0, 1], ["v1", "v2"]) for _ in range(rule)]
    spent = [some(range(users), ["g1", "g2", None], [0, 1, None], ["v1", "v2", None]) for _ in range(30)]
    matched = [(u, o, *some([0, 1, None], ["v1", "v2", None])) for u, o in {some(range(users), range(n)) for _ in range(rule)}]
    fields = ("user_id long, kind string, revision int", "opportunity_id long, kind string, group_key string, group_version string, usable boolean, fetched_at double", "user_id long, opportunity_id long, revision int, group_version string")
    tables = [spark.createDataFrame(rows, f) for rows, f in ((members, fields[0]), (opportunities, fields[1]), (blocked, fields[2]), (spent, "user_id long, group_key string, revision int, group_version string"), (matched, fields[2]))]
    tables[0] = tables[0].select("user_id", F.array("kind").alias("opportunity_types"), "revision")
    return tables


def test_what_candidates_move_does_not_grow_with_pairs(spark, monkeypatch):
    monkeypatch.setattr(matching, "MEMBER_BLOCK", 2)
    tables, before = _market(spark, 3, users=400, n=600), _moved(spark)
    found = matching.candidates(*tables).select(F.count("*"), F.countDistinct("user_id")).first()
    assert found[0] > 40_000 and found[1] == 400
    assert _moved(spark) - before < 30_000  # of 400 opportunities in 100 blocks of members each


@pytest.mark.parametrize("rule", [0, 1500, 40_000])
def test_newest_candidates_pair_only_what_can_be_first(spark, monkeypatch, rule):
    tables, seen, whole = _market(spark, rule, rule=rule), [], matching.candidates
    want = [tuple(r) for r in matching.newest(whole(*tables, ("fetched_at",)), 7).collect()]
    monkeypatch.setattr(matching, "candidates", lambda m, o, *more: seen.append(o.count()) or whole(m, o, *more))
    got = [tuple(r) for r in matching.newest_candidates(*tables, 7).collect()]
    key = lambda r: (r[5], r[1], r[0])
    assert list(map(key, got)) == list(map(key, want)) and len(seen) == 1
    assert rule or seen[0] < 25  # of 62
