"""Each training-data operator against brute force, an exact round trip, or what it has to separate; and its edge cases."""

import hashlib
import html
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerloom.llm import chat, decontam, langid, linededup, lmscore, media, mixing, nearjoin, queries, substrings, toxicity

from ..compare import rows_of, rows_of_sql
from ..conftest import SMALL

CLASH = ["id", "size", "n", "rank", "score", "predicted", "pos", "gone", "runs", "_key", "_n", "begin", "lang_pred", "kept"]
EDGES = [(1, None), (2, ""), (3, "One line of words that is long enough to count here."), (3, "One line of words that is long enough to count here."), (4, "x" * 5000), (5, "\n\n \n"), (6, "One line of words that is long enough to count here.\nother")]


def edge_rows(spark):
    df = spark.createDataFrame([(i, t, "s" if i % 2 else None, "en") for i, t in EDGES], "doc_id long, text string, source string, lang string")
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, duck, name):
    assert rows_of(queries.QUERIES[name](spark, SMALL)) == rows_of_sql(duck, queries.ORACLES[name])


EDGE_JOBS = {
    "mixing": lambda s, d: mixing.mixed_documents(d),
    "media": lambda s, d: media.document_media(d),
    "langid": lambda s, d: langid.identify(d, {"en": b"words of a line", "de": b"zeilen und worte"}, "doc_id"),
    "linededup": lambda s, d: linededup.strike(d)[0],
    "substrings": lambda s, d: substrings.without_repeats(d),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.train(["bad idiot", "good day"] * 20, [1, 0] * 20), "doc_id"),
    "decontam": lambda s, d: decontam.contamination(d, s.createDataFrame([(1, "of words that is"), (2, None), (2, "")], "item_id long, text string")),
    "nearjoin": lambda s, d: nearjoin.near_duplicates(d),
}


@pytest.mark.parametrize("name", sorted(EDGE_JOBS))
def test_edges_and_empty_tables(spark, name):
    rows = EDGE_JOBS[name](spark, edge_rows(spark)).collect()
    assert len(rows) == len(EDGES)
    assert EDGE_JOBS[name](spark, edge_rows(spark).limit(0)).count() == 0


def test_lm_edges(spark):
    d = edge_rows(spark)
    vocab = lmscore.vocabulary(d)
    got = {r.doc_id: r for r in lmscore.score(d, lmscore.train(d, vocab), vocab, "doc_id").collect()}
    assert got[1].n_tokens == got[2].n_tokens == 0 and got[1].mean_logprob is None and got[3].pseudo_loglik < 0
    empty = d.limit(0)
    vocab = lmscore.vocabulary(empty)
    assert lmscore.score(empty, lmscore.train(empty, vocab), vocab, "doc_id").count() == 0


def test_lm_learns_order(spark):
    rng = np.random.default_rng(1)
    say = lambda: " ".join(w for _ in range(60) for w in (f"a{k}" for k in (lambda s: (s, s + 1, s + 2))(rng.integers(0, 20) * 3)))
    train = spark.createDataFrame([(k, say()) for k in range(400)], "doc_id long, text string").repartition(2)
    vocab = lmscore.vocabulary(train)
    model = lmscore.train(train, vocab)
    text = say()
    shuffled = " ".join(rng.permutation(text.split()))
    n, score = lmscore.score_texts(model, vocab, [text, shuffled])
    assert score[0] / n[0] > score[1] / n[1] + 0.3


def test_lm_scores_against_plain_loops(spark):
    d = docs(spark).where("length(text) < 2000").limit(60)
    vocab = lmscore.vocabulary(d)
    model = lmscore.train(d, vocab)
    size = lmscore.INPUT_WORDS + lmscore.INPUT_TAIL + 1
    leaf = vocab.classes.astype(int) * lmscore.LEAVES + vocab.leaves
    assert np.bincount(leaf, np.exp(vocab.share))[np.unique(leaf)] == pytest.approx(1, rel=1e-4)  # shares of each leaf

    def plain(text):
        words, total = lmscore.TOKEN.findall((text or "").lower()), 0.0
        ids = [vocab.ids.get(w, lmscore.WORDS + zlib.crc32(w.encode()) % vocab.tail) for w in words]
        inputs = [(i if i < lmscore.INPUT_WORDS else lmscore.INPUT_WORDS + i % lmscore.INPUT_TAIL) + 1 for i in ids]
        for k, i in enumerate(ids):
            near = [k + j for j in (-2, -1, 1, 2)]
            h = np.tanh(sum(model["E"][n * size + (inputs[at] if 0 <= at < len(ids) else 0)].astype(float) for n, at in enumerate(near)) + model["b"])
            soft = lambda z: z - np.log(np.exp(z).sum())
            c = vocab.classes[i]
            total += soft(h @ model["W"] + model["c"])[c] + vocab.share[i]
            if c >= lmscore.OWN:
                total += soft(h @ model["L"][c - lmscore.OWN] + model["l"][c - lmscore.OWN])[vocab.leaves[i]]
        return len(ids), total

    rows = d.select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_tokens, r.pseudo_loglik) for r in lmscore.score(d, model, vocab, "doc_id").collect()}
    for r in rows[:25]:
        n, total = plain(r.text)
        assert got[r.doc_id] == (n, pytest.approx(total, rel=1e-3, abs=1e-3))


def test_language(spark):
    """On rows that were not learnt from."""
    told = {r.doc_id: r.lang for r in docs(spark).select("doc_id", "lang").collect()}
    got = [r for r in queries.op2_langid(spark, SMALL).collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got) and len(got) == len(told)
    held = [r for r in got if r.held_out and told[r.doc_id] and r.lang_pred != "und"]
    assert len(held) > 30 and np.mean([told[r.doc_id] == r.lang_pred for r in held]) > 0.95
    assert langid.classify("123 !!", (("en", b"abc"),)) == ("und", 0.0, False)


def test_no_language_is_left_out(spark):
    d = spark.range(200).select(F.concat(F.lit("l"), F.floor(F.sqrt("id")).cast("string")).alias("lang"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    assert {r.lang for r in langid.learning_sample(d).collect()} == {f"l{k}" for k in range(15)}


def test_language_sample_counts_copies_once(spark):
    many = spark.range(20000).select(F.lit("en").alias("lang"), F.lit("a copy").alias("text"))
    other = spark.range(50).select(F.lit("en").alias("lang"), F.concat(F.lit("text number "), F.col("id")).alias("text"))
    blank = spark.range(5000).select(F.lit("de").alias("lang"), F.col("id").cast("string").alias("text")).unionByName(spark.createDataFrame([("de", "ein Wort")], "lang string, text string"))
    d = many.unionByName(other).unionByName(blank)
    got = Counter(r.lang for r in langid.learning_sample(d).collect())
    assert got == {"en": 51, "de": 1}
    assert Counter(r.lang for r in langid.learning_sample(d, 3).collect()) == {"en": 3, "de": 1}


def test_mix_reaches_targets(spark):
    got = mixing.mixed_documents(docs(spark)).collect()
    by_source = {}
    sources = {r.doc_id: r.source for r in docs(spark).select("doc_id", "source").collect()}
    for r in got:
        s = by_source.setdefault(sources[r.doc_id], [0, r.target, r.source_size])
        s[0] += r.taken
        assert r.taken <= 3 * r["size"]
    for taken, target, size in by_source.values():
        assert abs(taken - target) <= 1 and target <= 3 * size + 1e-9


def test_schedule_segments_are_even(spark):
    _, goals, segments = mixing.mix(docs(spark), block=64)
    slots = segments.groupBy("source", "rank").agg(F.sum("n_words").alias("n"), F.count_distinct("slot").alias("slots")).where("n > 64 or slots > 1").count()
    assert slots == 0


def brute_fold(events):
    messages = {}
    for e in sorted(events, key=lambda e: (e.seq, chat.RANK[e.kind], e.text)):
        m = messages.setdefault(e.message_id, {"opened": e.seq, "role": e.role, "text": ""})
        if e.kind == "delta":
            m["text"] += e.text
        else:
            m["text"] = e.text
            if e.kind == "message":
                m["role"] = e.role
        if e.kind == "regenerate":
            for k in [k for k, x in messages.items() if x["opened"] > m["opened"]]:
                del messages[k]
    return [(m["role"], m["text"]) for m in sorted(messages.values(), key=lambda m: m["opened"])]


def test_events_fold(spark):
    log = [(1, 1, "message", 1, "user", "hi"), (1, 2, "message", 2, "assistant", ""), (1, 3, "delta", 2, "assistant", "a"), (1, 4, "delta", 2, "assistant", "b"), (1, 5, "message", 3, "user", "no"), (1, 6, "regenerate", 2, "assistant", ""),
           (1, 7, "delta", 2, "assistant", "c<|im_end|>"), (1, 8, "message", 4, "user", "thanks"), (1, 9, "edit", 4, "user", "thank you"), (2, 1, "message", 1, "user", None)]
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, message_id long, role string, text string")
    parsed = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold_events(df))).collect()}
    want = brute_fold([Row(seq=s, kind=k, message_id=m, role=r, text=t) for c, s, k, m, r, t in log if c == 1])
    assert [(t.role, t.text) for t in parsed[1].turns] == want == [("user", "hi"), ("assistant", "c<|im_end|>"), ("user", "thank you")]
    assert parsed[1].loss_text == "c<|im_end|>"
    assert [(t.role, t.text) for t in parsed[2].turns] == [("user", "")]


@pytest.mark.parametrize("text", ["<|im_end|>", "<\\|x", "<\\\\|<|", "a<", "|im_end|>", "\n<|im_start|>assistant\n", ""])
def test_escapes_round_trip(spark, text):
    rows = spark.createDataFrame([(1, 0, "assistant", text), (1, 1, "user\n%0A<|", text)], "conv_id long, turn long, role string, text string")
    r = chat.read_back(chat.format_conversations(rows)).first()
    assert [(t.role, t.text) for t in r.turns] == [("assistant", text), ("user\n%0A<|", text)] and r.loss_text == text


def test_payloads_round_trip(spark):
    for r in queries.op5_media(spark, SMALL).join(docs(spark).select("doc_id", "text"), "doc_id").collect():
        raw = (r.text or "").encode()
        padded = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        form = media.encode(raw)
        assert (r.media_bytes, r.media_sha256) == (len(form), hashlib.sha256(form).hexdigest()) and media.decode(form).tobytes() == padded


def test_payloads_of_null_and_repeated_ids(spark):
    rows = [(None, "a"), (None, "b"), (None, "a"), (1, "a"), (1, "a"), (1, None), (2, ""), (3, "é" * 5000)]
    got = Counter((r.doc_id, r.n_bytes, r.payload_sha256, r.position, r.caption) for r in media.document_media(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    raw = lambda t: (t or "").encode()
    assert got == Counter((i, len(raw(t)), hashlib.sha256(raw(t).ljust(max(1, -(-len(raw(t)) // 192)) * 192)).hexdigest(), 1, f"{len(raw(t))} bytes") for i, t in rows)


def test_pages_are_read_whole(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html")
    for r in media.parse_interleaved(pages, "page_id", "html").join(pages, "page_id").collect():
        assert [i.position for i in r["items"]] == list(range(len(r["items"])))
        seen = re.sub(r"(?is)<(script|style|template|noscript|head)\b.*?</\1>|<!--.*?-->", "", r.html)
        assert [i.ref for i in r["items"] if i.kind == "media"] == re.findall(r'(?i)<(?:img|audio|video|source|embed)\b[^>]*?\bsrc="([^"]+)"', seen)
        words = lambda t: re.findall(r"\w+", t)
        told = " ".join(i.text or i.caption or "" for i in r["items"])
        assert Counter(words(told)) == Counter(words(html.unescape(re.sub(r"(?s)<[^>]+>", " ", seen))))


def test_sequences_keep_places_and_captions(spark):
    page = '<p>one &amp; two<img src="sha256:x" alt="a"></p><figure><img src="b"><figcaption>cap</figcaption></figure><script>no</script>three'
    pages = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    seq = media.parse_interleaved(pages, "page_id", "html")
    store = spark.createDataFrame([("x", 3, b"abc")], "digest string, n_bytes long, media binary")
    got = {r.page_id: r["items"] for r in media.interleave(seq, media.resolve(seq, store, "page_id"), "page_id").collect()}
    assert [(i.kind, i.text or i.ref, i.caption, i.n_bytes) for i in got[1]] == [("text", "one & two", None, None), ("media", "sha256:x", None, 3), ("media", "b", "cap", None), ("text", "three", None, None)]


def brute_lines(rows, n=linededup.LINES, heavy=linededup.HEAVY):
    """By the statement alone: a line goes if some window that it lies in stands earlier, in the order of id, digest of the text, and line."""
    digest = lambda t: hashlib.md5((t or "").encode()).digest()
    seen, out = set(), {}
    for i, _, t in sorted({(linededup.NO_ID if i is None else i, digest(t), t) for i, t in rows}, key=lambda x: x[:2]):
        parts = (t or "").split("\n")
        full = [k for k, x in enumerate(parts) if x.strip()]
        own, gone, here = [parts[k].strip() for k in full], set(), []
        for p in range(len(own)):
            for size in (1, n):
                w = tuple(own[p : p + size])
                if len(w) == size and (size == n or len(w[0].split()) >= heavy):
                    if w in seen:
                        gone |= set(range(p, p + size))
                    seen.add(w)
        drop = {full[k] for k in gone}
        out[i, t] = (len(drop), t if not drop else "\n".join(x for k, x in enumerate(parts) if k not in drop))
    return out


def test_lines_against_brute_force(spark):
    heavy = "a heavy line of nine words that stands often"
    small = [(1000, "a\nb\n\nc d"), (1001, "x\na\nb\nc d\ny"), (1002, "b\nq"), (1003, "a\nb\na\nb"), (1004, "a\nb\n\nc d"), (1004, f"{heavy}\nz\n{heavy}\nz"), (1004, f"b\n{heavy}\n\n z \nq"), (1005, "b"), (1006, "b"), (1007, heavy), (1008, heavy),
             (None, "own\nlines"), (None, "own\nlines\nmore"), (1009, "own\nlines"), (1010, None), (1011, "\n \n"), (1012, "a\r\nb"), (1013, "s\n" * 300)]
    rows = [(r.doc_id, r.text) for r in docs(spark).select("doc_id", "text").collect()] + small + small[3:8]
    struck, _, removed, _ = linededup.strike(spark.createDataFrame(rows, "doc_id long, text string").withColumn("_gone", F.lit("clash")))
    got = [(r.doc_id, r[removed], r.text) for r in struck.collect()]
    want = brute_lines(rows)
    assert Counter(got) == Counter((i, *want[linededup.NO_ID if i is None else i, t]) for i, t in rows)


def test_lines_of_any_earlier_run_go(spark):
    h, g = "a header line of eight words or more", "another heavy line that has eight words too"
    lines = {1: [h, "x"], 2: [h, "s", "u"], 3: [h, "s", "v"], 4: ["v", h, "s", "u", g], 5: ["q", g, "s", g, "s"], 6: ["s", "u"], 7: ["u", "s", g, "x", h, "x"], 8: ["s"]}
    want, seen = {}, set()
    for i, own in sorted(lines.items()):
        gone = set()
        for p in range(len(own)):
            for size in (1, 2):
                run = tuple(own[p : p + size])
                if len(run) == size and (size == 2 or len(run[0].split()) >= linededup.HEAVY):
                    gone |= set(range(p, p + size)) if run in seen else set()
                    seen.add(run)
        want[i] = "\n".join(x for k, x in enumerate(own) if k not in gone)
    assert want[3] == "v"
    d = spark.createDataFrame([(i, "\n".join(x)) for i, x in lines.items()], "doc_id long, text string")
    assert {r.doc_id: r.text for r in linededup.strike(d)[0].collect()} == want


def brute_bytes(rows, length):
    count = Counter(b[k : k + length] for _, b in rows for k in range(len(b) - length + 1))
    out = {}
    for i, b in rows:
        hit = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                hit[k : k + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~hit])
        out[i] = (len(b), int(hit.sum()), int((hit & ~np.concatenate([[False], hit[:-1]])).sum()) if len(b) else 0, kept)
    return out


@pytest.mark.parametrize("most", [4096, 3, 1])
def test_bytes_against_brute_force(spark, most):
    rng = np.random.default_rng(3)
    shared = "".join(rng.choice(list("abcdeé "), 400))
    rows = [(r.doc_id, r.text) for r in docs(spark).where("length(text) < 3000").select("doc_id", "text").collect()]
    say = "".join(rng.choice(list("opqrst "), 30_000))  # a very long text that holds a passage twice, and one that holds a part of it
    rows += [(4000, say + shared[:250] + say[100:400]), (4001, "u" + say[20_000:20_300])]
    rows += [(2000 + k, "".join(rng.choice(list("xyz"), k)) + shared[k : k + 260] + "".join(rng.choice(list("xyz"), 50))) for k in range(30)] + [(3000, "ab" * 300), (3001, "q" * 450), (3002, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.without_repeats(df, most=most).collect()}
    assert got == brute_bytes([(i, (t or "").encode()) for i, t in rows], substrings.LENGTH)


def test_collisions_are_verified(monkeypatch):
    raw = np.frombuffer(b"abcdefgh" * 3 + b"abcdefgx", np.uint8)
    starts, segment = np.array([0, 8, 24]), np.zeros(3, int)
    assert substrings.repeated_windows(raw, starts, segment, 8).tolist() == [True, True, False]
    monkeypatch.setattr(substrings, "VALUES", np.ones((2, 256), np.uint64))  # every string of a length has one hash
    assert substrings.repeated_windows(raw, starts, segment, 8).tolist() == [True, True, False]


def test_toxic_texts_are_told(spark):
    """On rows that were not learnt from, of the larger table."""
    sf = SMALL.replace("0.001", "0.01")
    got = queries.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 50 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.85
    assert toxicity.train([], [])["constant"][0] == 0


def test_first_rows_by_label(spark):
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("toxic"))
    got = toxicity.first_rows(rows, F.xxhash64("id"), 50, 70).collect()
    key = {r.id: r.h for r in rows.select("id", F.xxhash64("id").alias("h")).collect()}
    for label, most in ((1, 50), (0, 70)):
        want = sorted((i for i in key if (i % 10 == 0) == bool(label)), key=key.get)[:most]
        assert sorted(r.id for r in got if r.toxic == label) == sorted(want)
    assert toxicity.first_rows(rows, F.lit(5).cast("long"), 50, 70).groupBy("toxic").count().orderBy("toxic").collect() == [Row(toxic=0, count=70), Row(toxic=1, count=50)]


def test_gradients():
    rng = np.random.default_rng(2)
    model = {k: v.astype(np.float64) for k, v in toxicity.fresh_model().items()}
    x, ids = rng.normal(size=(5, toxicity.INPUTS)), rng.integers(0, 6, (7, 4))
    y, w = np.array([0.0, 1, 1, 0]), np.array([1.0, 2, 1, 1])
    mask = ids < 5

    def loss():
        p = toxicity.sigmoid(toxicity.run(model, {d: g[ids] for d, g in toxicity.gates_of(model, x).items()}, mask).astype(float))
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum()

    g, _ = toxicity.gradients(model, x, ids, mask, y, w)
    for name in ("U_f", "W_b", "A", "v", "w"):
        at = tuple(rng.integers(0, s) for s in model[name].shape)
        old, step = model[name][at], 1e-2
        model[name][at] = old + step
        up = loss()
        model[name][at] = old - step
        down = loss()
        model[name][at] = old
        assert g[name][at] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-4)


def test_phrases_and_proximity(spark):
    d = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "beta x alpha"), (3, "Alpha, beta; alpha beta")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha beta"), (8, "no such words"), (9, "gamma")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, sorted(r["items"]), r.contaminated) for r in decontam.contamination(d, items).collect()}
    assert got == {1: (4, 3, [7, 9], True), 2: (3, 0, [], False), 3: (4, 4, [7], True)}
    index = decontam.index_of(d, spark.createDataFrame([("alpha",), ("beta",)], "term string"))
    near = decontam.proximity_matches(index, spark.createDataFrame([(1, ["alpha", "beta"])], "question_id long, terms array<string>"), 3)
    assert {r.doc_id for r in near.join(decontam.texts_of(index), ["_a", "_b"]).collect()} == {1, 2, 3}
    assert {r.doc_id: r.near_items for r in decontam.contamination(d, items).collect()} == {1: [7, 9], 2: [7], 3: [7]}


def brute_phrases(texts, items, window=decontam.WINDOW):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    asked = Counter()
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - window, 0) + 1 if w else 0):
            asked[i, tuple(w[k : k + window])] += 1
    out = []
    for i, t in texts:
        w, hit, named = words(t), set(), set()
        for item, p in asked:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    named |= {item} - {None}
        out.append((i, len(w), len(hit), tuple(sorted(named)), bool(hit)))
    return Counter(out)


def test_phrases_against_brute_force(spark):
    rng = np.random.default_rng(6)
    say = lambda n: " ".join(rng.choice(["a", "b", "c", "Dd"], n))
    texts = [(k % 25 or None, say(int(rng.integers(0, 60)))) for k in range(60)] + [(7, None), (8, ""), (9, "a b a b"), (9, "a b a b"), (30, "e " * 400)]
    items = [(1, "a b a"), (2, say(10)), (3, say(12)), (None, "dd"), (4, "a b a"), (5, ""), (6, None), (7, "zz a"), (8, "e " * 11), (9, "a a a a"), (10, "c c"), (10, "b dd b")]
    d = spark.createDataFrame(texts, "doc_id long, text string").withColumn("pos", F.lit("clash")).withColumn("term", F.lit("clash")).withColumn("window", F.lit(1))
    got = decontam.contamination(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"])), r.contaminated) for r in got) == brute_phrases(texts, items)


def test_shuffled_postings_agree(spark, monkeypatch):
    d, items = docs(spark), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = rows_of(decontam.contamination(d, items).drop("items", "near_items"))
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 1)
    assert rows_of(decontam.contamination(d, items).drop("items", "near_items")) == want


def brute_near(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root, links = {i: i for i in sets}, Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


@pytest.mark.parametrize("block", [512, 2])
def test_near_copies_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nearjoin, "PAIR_BLOCK", block)
    monkeypatch.setattr(nearjoin, "NODE_BLOCK", block)
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in rng.integers(0, 500, 120)]
    rows = [(r.doc_id, r.text) for r in docs(spark).select("doc_id", "text").collect()]
    for k in range(12):
        words = list(base)
        words[int(rng.integers(0, 120))] = f"new{k}"
        rows.append((5000 + k, " ".join(words)))
    got = {r.doc_id: (r.class_id, r.n_links) for r in nearjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_near(rows)


def test_near_copies_of_null_and_repeated_ids(spark):
    text = lambda a, n=40: " ".join(f"{a}{k}" for k in range(n))
    near = text("a") + " end"
    rows = [(None, text("a")), (3, text("a")), (4, near), (None, text("b")), (None, text("c", 60)), (7, text("d")), (7, near), (8, text("d")), (9, "e"), (9, text("f", 70)), (9, text("f", 70)), (None, None), (None, ""), (1 << 60 | 1, "g")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in nearjoin.near_duplicates(d).collect())
    assert got == Counter([(None, 3, 3, 2), (3, 3, 3, 2), (4, 3, 3, 2), (7, 3, 3, 2), (None, None, 0, 1), (None, None, 0, 1), (7, 7, 1, 2), (8, 7, 1, 2), (9, 9, 0, 1), (9, 9, 1, 2), (9, 9, 1, 2), (None, None, 0, 1), (None, None, 0, 1), (1 << 60 | 1, 1 << 60 | 1, 0, 1)])
    kept = Counter((r.doc_id, r.text) for r in nearjoin.one_of_each(d).collect())
    assert kept == Counter([(3, text("a")), (None, text("b")), (None, text("c", 60)), (7, text("d")), (9, "e"), (9, text("f", 70)), (None, None), (None, ""), (1 << 60 | 1, "g")])


def test_bytes_of_null_and_repeated_ids(spark):
    rng = np.random.default_rng(5)
    say = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    shared, own = say(300), [say(k) for k in (700, 250, 900, 40)]
    rows = [(None, own[0]), (None, shared + own[1]), (5, own[2]), (5, own[3] + shared), (5, "short")]
    got = Counter((r.doc_id, r.n_removed, bytes(r.kept).decode()) for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(None, 0, own[0]), (None, 300, own[1]), (5, 0, own[2]), (5, 300, own[3]), (5, 0, "short")])


def stage_rows(spark):
    h = "a heavy line that holds more than eight words of text"
    base = " ".join(f"w{k}" for k in range(80))
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first().text
    extra = [(None, base), (None, None), (9001, base + " end"), (9001, "other"), (9002, base), (9002, base), (9003, ""), (9004, f"x\n{h}\ny"), (9005, f"{h}\nz"), (9006, "q " * 30_000), (9007, "before " + item + " after")]
    rows = [(r.doc_id, r.text) for r in docs(spark).where("length(text) < 4000").limit(50).select("doc_id", "text").collect()] + extra
    frame = spark.createDataFrame([(i, t, None if (i or 0) % 7 == 0 else "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return rows, frame.withColumn("score", F.lit("clash")).withColumn("_n", F.lit("clash")).withColumn("_a", F.lit("clash"))


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as p

    rows, d = stage_rows(spark)
    kept = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    stages = dict(p.STAGES)
    lines = brute_lines(rows)
    told = [(i, lines[linededup.NO_ID if i is None else i, t]) for i, t in rows]
    full = lambda t: sum(bool(x.strip()) for x in (t or "").split("\n"))
    assert kept(stages["line_dedup"](spark, d, SMALL)) == Counter((i, text) for (i, (n, text)), (_, t) in zip(told, rows, strict=True) if not full(t) or n < full(t))
    names = {(i, t): k for k, (i, t) in enumerate(sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")))}
    groups = brute_near([(k, t) for (i, t), k in names.items()])
    got, by_group = kept(stages["near_duplicates"](spark, d, SMALL)), Counter()
    for row, n in got.items():
        by_group[groups[names[row]][0]] += n
    words = {k: bool(re.findall(r"\w+", t or "")) for (i, t), k in names.items()}
    assert by_group == Counter({groups[k][0]: 1 for k in groups if words[k]}) + Counter(names[r] for r in rows if not words[names[r]])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    clean = Counter((i, t) for i, t in rows if not any(k[4] for k in brute_phrases([(i, t)], items)))
    assert kept(stages["decontamination"](spark, d, SMALL)) == clean and sum(clean.values()) < len(rows)
    mixed = stages["mixing"](spark, d, SMALL).collect()
    assert Counter((r.doc_id, r["size"]) for r in mixed) == Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in rows)
    assert all(r.taken <= 3 * r["size"] for r in mixed)
    left = kept(stages["toxicity"](spark, d, SMALL))
    assert not left - Counter(rows) and left[None, None] == 1


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    d = docs(spark).limit(60).withColumn("score", F.lit("clash")).withColumn("_n", F.lit("clash"))
    kept = d
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, kept, SMALL)
        assert after.columns == d.columns
        assert after.select("doc_id").exceptAll(kept.select("doc_id")).count() == 0
        kept = after
    assert set(p.STAGES[-1][1](spark, kept, SMALL).columns) == {"doc_id", "size", "source_size", "target", "taken"}
    for name, stage in p.STAGES[1:]:
        assert stage(spark, d.limit(0), SMALL).count() == 0


def test_languages_by_groups_are_as_at_once(spark, monkeypatch):
    """More languages than go at a time, ties between twins included, and none left out."""
    rng = np.random.default_rng(6)
    tongues = {f"l{k:02}": ["".join(rng.choice(list("abcdefghijklmnop")[k % 5 : k % 5 + 8], 4)) for _ in range(40)] for k in range(7)}
    say = lambda k, n: " ".join(rng.choice(tongues[k], n))
    learn = [(k, say(k, 60)) for k in tongues for _ in range(8)]
    learn += [("l07", t) for k, t in learn if k == "l03"]  # a twin of l03
    texts = [(n, say(k, m)) for n, (k, m) in enumerate((k, m) for k in tongues for m in (1, 3, 40))] + [(90, None), (91, ""), (92, "123"), (None, say("l00", 30))]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    labelled = spark.createDataFrame(learn, "lang string, text string")
    told = lambda: sorted((tuple(r) for r in langid.identify(d, langid.fit(labelled), "doc_id").collect()), key=repr)
    whole = told()
    monkeypatch.setattr(langid, "GROUP", 3)
    assert told() == whole and len({r[1] for r in whole}) > 5
    monkeypatch.setattr(langid, "GROUP", 250)
    many = spark.createDataFrame([(f"t{k:04}", f"word{chr(97 + k % 26)}{chr(97 + k // 26 % 26)} {chr(97 + k % 26) * 9}") for k in range(1100)], "lang string, text string")
    groups = list(langid.fit(many))
    assert sum(map(len, groups)) == 1100 and max(map(len, groups)) == 250


def test_near_copies_are_told_by_the_texts_that_came_in(spark, tmp_path):
    """Line deduplication leaves nothing alike of two near copies; one of them goes nevertheless, and clean documents stay."""
    import corpus_pipeline as p

    shared = [f"this line of many words number {k} stands in both of the near copies here" for k in range(30)]
    lines = {1: [*shared, "the first one ends like this and says it"], 2: [*shared, "and the second one ends in another way"], 3: [f"something else {k} that no other document says at all" for k in range(9)]}
    came = spark.createDataFrame([(k, "\n".join(v), "en", "s", 1) for k, v in lines.items()] + [(4, "\n".join(lines[3]) + "\nmore", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    came.write.parquet(str(tmp_path / "documents.parquet"))
    docs = p.drop_lines(spark, came, str(tmp_path))
    assert {r.doc_id for r in docs.collect()} == {1, 2, 3, 4}
    assert {r.doc_id for r in p.drop_near_copies(spark, docs, str(tmp_path)).collect()} == {1, 3}
    other = spark.createDataFrame([(1, "unlike what came in under this id", "en", "s", 1), (2, "and this one is unlike it as well", "en", "s", 1), (None, "x", "en", "s", 1)], came.schema)
    assert {r.doc_id for r in p.drop_near_copies(spark, other, str(tmp_path)).collect()} == {1, 2, None}


def test_near_copies_choose_documents_without_moving_texts(spark, tmp_path, monkeypatch):
    """Documents are picked after they are signed, so that no join moves texts for it; and each step's leftovers are let go."""
    import corpus_pipeline as p

    plans, released = [], []
    cut, release = nearjoin.cut, nearjoin.release
    monkeypatch.setattr(nearjoin, "cut", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), cut(df))[1])
    monkeypatch.setattr(nearjoin, "release", lambda *a: (released.append(1), release(*a))[1])
    came = spark.createDataFrame([(k, f"{k} is said by this text of some words {k % 3}", "en", "s", 1) for k in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    came.write.parquet(str(tmp_path / "documents.parquet"))
    assert p.drop_near_copies(spark, came, str(tmp_path)).count() == 6
    signed = [x for x in plans if "sketch" in x and "MapInPandas" in x and "text" in x]
    assert len(signed) == 2 and all(x.index("Join Left") < x.index("MapInPandas") for x in signed)
    assert len(released) >= 2 * 4


def test_rounds_of_components_take_few_tasks(spark):
    """The driver keeps a record of every task, so a round reads its small table in few of them, however many partitions wrote it."""
    from ledgerloom.llm.components import components

    held = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, sc = {k: spark.conf.get(k) for k in held}, spark.sparkContext
    chain = spark.createDataFrame([(k, k + 1) for k in range(1, 20)] + [(100, 101), (None, 7), (5, 5)], "u long, v long")
    for k, v in held.items():
        spark.conf.set(k, v)
    sc.setJobGroup("rounds", "rounds")
    try:
        got = {r.node: r.component for r in components(chain).collect()}
        stages = {i for job in sc.statusTracker().getJobIdsForGroup("rounds") for i in sc.statusTracker().getJobInfo(job).stageIds}
        tasks = sum(x.numCompletedTasks for x in map(sc.statusTracker().getStageInfo, stages) if x)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {**dict.fromkeys(range(1, 21), 1), 100: 100, 101: 100}
    assert tasks < 1000


def test_rounds_of_components_let_go_what_they_leave(spark, monkeypatch):
    """The driver holds records, broadcasts and plans of a round until its garbage is collected; each round's go before the next."""
    from ledgerloom.llm import components as step

    order = []
    monkeypatch.setattr(step, "written", lambda df, path, f=step.written: order.append("written") or f(df, path))
    monkeypatch.setattr(step, "release", lambda *_: order.append("released"), raising=False)
    chain = spark.range(40).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = {r.node: r.component for r in step.components(chain).collect()}
    assert got == dict.fromkeys(range(41), 0)
    assert order[0] == "written" and order[1:] == ["written", "released"] * (len(order) // 2) and len(order) > 4
