"""The alignment of two tokenizers against whole-text encodings and plain loops."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import crosstoken

from .test_llm import CLASH, SMALL, edge_rows

HARD = [
    None, "", " ", "  a", "a  b\n c", "日本 語\n\n x é😀 ü", "a▁b", "<|endoftext|> <s> <unk> </s>", "\n", "a ", "a　 b  c", "x" * 3000, "foo\x00 bar\x1f baz", "́ é",
    "😀😀😀 " * 50, "<0x41> <0x0A>", "\xa0 a", "﻿ x", "naïve\r\n\r\nb  c   d    e", "​ a", "it's we'll 12 345 don't ''s", "a\x85 b",
]
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def known():
    return crosstoken.Chunks(crosstoken.FIRST, crosstoken.SECOND)


def whole(known, text):
    """Groups and links of a text from its encoding as a whole, or None."""
    a, b = known.a.encode(" " + (text or ""), add_special_tokens=False).ids, known.b.encode(text or "")
    ab, bb, raw = [known.a_bytes[i] for i in a], [known.b_bytes[i] for i in b], (" " + (text or "")).encode()
    if not text or b"".join(ab) != raw or b"".join(bb) != raw:
        return None
    ends_a, ends_b = np.cumsum([len(x) for x in ab]), np.cumsum([len(x) for x in bb])
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        m, n = np.searchsorted(ends_a, cut, "right"), np.searchsorted(ends_b, cut, "right")
        groups.append(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:n])))
        i, j = m, n
    links, k = Counter(), 0
    for i, x in enumerate(a):
        while k and ends_b[k - 1] > ends_a[i] - len(ab[i]):
            k -= 1
        while k < len(b) and ends_b[k] - len(bb[k]) < ends_a[i]:
            if ends_b[k] > ends_a[i] - len(ab[i]):
                links[x, b[k]] += 1
            k += 1
    return len(a), len(b), groups, links


def brute(known, rows):
    found = [(i, whole(known, t)) for i, t in rows]
    held = Counter(p for _, f in found if f for p in f[3])
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    for i, f in found:
        if f is None:
            yield i, 0, 0, 0, 0, 0, 0, ""
        else:
            a, b, groups, links = f
            is_best = sum(n for p, n in links.items() if held[p] == best[p[0]])
            yield i, a, b, len(groups), sum(links.values()), is_best, sum(n * held[p] for p, n in links.items()), hashlib.sha256(";".join(groups).encode()).hexdigest()


def test_against_whole_texts(spark, known):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").limit(80)  # plain loops on the other side
    df = docs.unionByName(spark.createDataFrame([(-k, t) for k, t in enumerate(HARD)], "doc_id long, text string")).repartition(3)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = sorted(brute(known, rows))
    for most in (crosstoken.BROADCAST_ROWS, 0):  # broadcast counts, and shuffled ones
        got = crosstoken.links(df, most=most).select("doc_id", *NAMES).collect()
        assert sorted(map(tuple, got)) == want


def test_forgotten_chunks_come_again(known, monkeypatch):
    texts = [f"word{k % 7} und{k % 50} x{k}" for k in range(400)]
    plain = crosstoken.align(known, list(range(400)), texts)
    monkeypatch.setattr(crosstoken, "KEPT", 20)
    other = crosstoken.Chunks(crosstoken.FIRST, crosstoken.SECOND)
    for k in range(0, 400, 16):
        part = crosstoken.align(other, list(range(k, k + 16)), texts[k : k + 16])
        assert part.astype(str).values.tolist() == plain.iloc[k : k + 16].astype(str).values.tolist()
    assert len(other.number) < 120


def test_edges(spark, known):
    d = edge_rows(spark).unionByName(edge_rows(spark).withColumn("doc_id", F.lit(None).cast("long")))
    rows = [(r.doc_id, r.text) for r in d.collect()]
    got = sorted(map(tuple, crosstoken.links(d).select("doc_id", *NAMES).collect()), key=repr)
    assert got == sorted(brute(known, rows), key=repr) and set(CLASH) <= set(d.columns)
    assert crosstoken.links(d.limit(0)).count() == 0
