"""What the operators that no SQL states come to: against brute force, and on rows that they have not learnt from."""

import random

import numpy as np
import zstandard
from pyspark.sql import functions as F

from ledgerloom.llm import chat, langid, nearjoin, queries

from .test_llm import CLASH


def test_toxic_rows_that_were_held_out(spark):
    """Recall and rank, as most rows are clean: calling all clean has an accuracy of 0.88."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    got = queries.op8_toxicity(spark, folder).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    assert len(toxic) > 60 and toxic.predicted.mean() > 0.6 and got[got.predicted == 1].toxic.mean() > 0.75
    above = (toxic.score.to_numpy()[:, None] > clean.score.to_numpy()[None, :]).mean()
    assert above > 0.9


def test_languages_against_plain_compression(spark):
    """Every choice by sizes that are counted here, one compression at a time, with a first look and, where it is close, a second."""
    rng = random.Random(3)
    tongues = {k: ["".join(rng.choices(s, k=rng.randrange(2, 7))) for _ in range(60)] for k, s in (("aa", "abcdeo"), ("bb", "abcdeu"), ("cc", "stuvwi"), ("dd", "abstuo"))}
    say = lambda k, n: " ".join(rng.choices(tongues[k], k=n))
    content = {k: langid.plain(" ".join(say(k, 400) for _ in range(3))) for k in tongues}
    texts = [say(k, n) for k in tongues for n in (1, 2, 5, 30, 900)] + [say("aa", 8) + " " + say("bb", 8), "o", "Zz-Top 7", "abc stu"]

    def size(raw, dictionary):
        d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=langid.LEVEL)
        coder = zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
        return sum(len(coder.compress(raw[k : k + langid.CHUNK])) for k in range(0, len(raw), langid.CHUNK))

    def brute(text):
        raw, sizes = langid.plain(text), {}
        first = {k: size(raw, c) for k, c in content.items()}
        a, b = sorted(first.values())[:2]
        if b - a >= max(langid.CLOSE_BYTES, langid.CLOSE_PART * a):
            return min(first, key=lambda k: (first[k], k))
        for k, c in content.items():
            step = -(-len(c) // langid.SHARDS)
            shards = [c[i : i + step] for i in range(0, len(c), step)]
            forms = [raw, raw[:-1] + raw, raw.strip()]
            sizes[k] = first[k] + sum(size(f, s) for f in forms for s in shards) / len(shards)
        return min(sizes, key=lambda k: (sizes[k], k))

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, content, "doc_id").collect()}
    assert [got[k] for k in range(len(texts))] == [brute(t) for t in texts]
    twins = langid.identify(df, {"b": content["aa"], "a": content["aa"]}, "doc_id").collect()
    assert {r.lang_pred for r in twins} == {"a"} and {r.score for r in twins} == {0.5} and not any(r.accepted for r in twins)


def test_links_of_just_enough_similarity_are_found(spark):
    """Pairs of similarities from 0.75 to 0.86, the least that links, which meet by the rarest of chances."""
    rng = random.Random(12)
    texts = []
    for k in range(600):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(120, 400))]
        other = list(words)
        for at in rng.sample(range(len(words)), max(1, round(len(words) * rng.uniform(0.015, 0.03)))):
            other[at] = f"x{rng.randrange(10**6)}"
        texts += [" ".join(words), " ".join(other)]
    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    alike = [len(a & b) / len(a | b) for a, b in zip(shingles[::2], shingles[1::2], strict=True)]
    near = {2 * k for k, s in enumerate(alike) if s >= 0.8}
    assert sum(0.8 <= s < 0.85 for s in alike) > 60 and sum(s < 0.8 for s in alike) > 60
    got = nearjoin.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    linked = {r.class_id for r in got if r.n_links}
    assert linked <= near and len(linked) >= 0.99 * len(near)


def test_chat_of_odd_logs(spark):
    """Null ids, roles and texts, an empty table, and columns of clashing names."""
    rows = [(None, 1, "user", None), (None, 2, None, "hi"), (1, 1, "assistant", "<|im_end|>\\<|"), (1, 1, "assistant", "<|im_end|>\\<|"), (2, 5, "user", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in CLASH:
        turns = turns.withColumn(c, F.lit("clash"))
    got = {r.conv_id: r for r in chat.digests(chat.read_back(chat.format_conversations(turns.select("conv_id", "turn", "role", "text")))).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {None: (2, 0), 1: (2, 2 * len("<|im_end|>\\<|")), 2: (1, 0)}
    assert chat.digests(chat.read_back(chat.format_conversations(turns.select("conv_id", "turn", "role", "text").limit(0)))).count() == 0
    assert np.isfinite([r.formatted_chars for r in got.values()]).all()
