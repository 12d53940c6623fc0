"""Words that an earlier document holds: recompression against all windows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import recompress

from .test_llm import edge_rows


def brute(rows, length):
    least = {}
    own = [(recompress.NO_ID if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in own:
        for k in range(len(w) - length + 1):
            least[tuple(w[k : k + length])] = min(i, least.get(tuple(w[k : k + length]), i))
    for (name, _), (i, w) in zip(rows, own, strict=True):
        gone = {p for k in range(len(w) - length + 1) if least[tuple(w[k : k + length])] < i for p in range(k, k + length)}
        yield name, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone)


def cases(rng, length):
    """Few different words, copies, passages in other surroundings, runs and periods, repeated and null ids."""
    words = [f"w{k}" for k in range(300)] + ["é", "ﬀ", "\xa0x", "a,b"]
    passages = [" ".join(rng.choices(words, k=length + rng.randrange(40))) for _ in range(8)]
    texts = [None, "", " \n\t", "x " * 400, "x " * 200 + "y", "a b " * 200, "b a b a " * 70 + "c", "a b c " * 90, " ".join(rng.choices("pq", k=600))]
    for _ in range(60):
        parts = [rng.choice([" ".join(rng.choices(words, k=rng.randrange(1, 60))), rng.choice(passages)]) for _ in range(rng.randrange(1, 6))]
        texts.append(rng.choice([" ", "\n", "  \x0b"]).join(parts))
    texts += rng.choices(texts, k=20)
    return [(rng.choice([None, *range(60)]), t) for t in texts]


@pytest.mark.parametrize("length", [50, 12])
def test_against_all_windows(spark, length):
    rows = cases(random.Random(length), length)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("name", F.lit("clash")).withColumn("first", F.lit(1)).repartition(3)
    got = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in recompress.without_repeats(df, length).collect()]
    want = list(brute(rows, length))
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(w[2] for w in want) > 1000


def test_equal_windows_have_equal_anchors():
    rng = random.Random(9)
    shared = [f"s{rng.randrange(40)}".encode() for _ in range(120)]
    texts = [b" ".join([f"{k}-{i}".encode() for i in range(rng.randrange(5, 90))] + shared + [f"{k}+{i}".encode() for i in range(rng.randrange(5, 90))]) for k in range(6)]
    words = recompress.Words(texts)
    first, count, name = recompress.anchored(words, 50)
    of = dict(zip(np.repeat(first, count) + np.concatenate([np.arange(c) for c in count]), np.repeat(name, count), strict=True))
    begins = [words.first[k] + next(i for i, x in enumerate(t.split()) if x.startswith(b"s")) for k, t in enumerate(texts)]
    for k in range(71):
        assert len({of[b + k] for b in begins}) == 1


def test_edges(spark):
    rows = recompress.without_repeats(edge_rows(spark)).collect()
    assert len(rows) == 7 and {(r.doc_id, r.n_removed) for r in rows} == {(k, 0) for k in range(1, 7)}
    assert recompress.without_repeats(edge_rows(spark).limit(0)).count() == 0
