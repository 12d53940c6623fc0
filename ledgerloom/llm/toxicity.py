"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Inputs are words and their characters: the hashed word, its character n-grams of 3 to 5 bytes and its beginnings of up to 9
bring a smoothed log-odds of the labels, the word and the n-grams a learnt embedding too. A text is read in overlapping windows of ``SPAN`` words, ``STEP`` apart; each
window's states are pooled by attention into one logit, and the text's score is that of its worst window, calibrated.

The network is fitted on a bounded sample: at most ``TOXIC`` and ``CLEAN`` labelled rows, first by a hash of their text,
of at most ``LEARN_CHARS`` characters (longer ones teach little about where the label comes from). It learns from the most
suspicious window of each toxic row, chosen anew after every round, and from random and worst windows of clean rows.
All windows of all texts are scored; the model is broadcast and of a fixed size.

Edge cases: null and empty texts, and texts without words, are one window of padding and get the score of nothing said; without labels of
both kinds every score is the share of toxic labels (0 with none); rows are scored one by one, so equal texts get equal
scores; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOXIC, CLEAN, LEARN_CHARS = 2_000, 4_000, 20_000
SPAN, STEP = 32, 24
HIDDEN, EMBED, ATTEND = 8, 4, 8
WORD_BITS, GRAM_BITS = 15, 16
ODDS = 4
INPUTS = ODDS + 2 * EMBED
SMOOTH = 5.0
BLOCK = 2048
WORD = re.compile(r"\w+")
GRAMS, BEGINNINGS = (3, 4, 5), (5, 6, 7, 8, 9, 10)
FACTORS = np.array([(0x9E3779B1 * (2 * j + 1) + 2 * j) & 0xFFFFFFFF | 1 for j in range(max(BEGINNINGS))], np.uint64)


def read_words(texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different words, the index of each word of all texts, and where each text begins (one more at the end)."""
    seen: dict[str, int] = {}
    at, ends = [], [0]
    for text in texts:
        at += [seen.setdefault(w, len(seen)) for w in WORD.findall((text or "").lower())]
        ends.append(len(at))
    return [w.encode() for w in seen], np.array(at, np.int64), np.array(ends)


def word_parts(words: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Bucket of each word; for each n, buckets and validity of the n-grams that begin at each byte; where each word's bytes begin; the same for beginnings."""
    ids = np.fromiter((zlib.crc32(w) & ((1 << WORD_BITS) - 1) for w in words), np.int64, len(words))
    marked = [b"^%b$" % w for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(marked) else np.zeros(0, np.int64)
    longest = max(BEGINNINGS)
    raw = np.frombuffer(b"".join(marked) + b"\0" * longest, np.uint8).astype(np.uint64)
    n_bytes = len(raw) - longest
    left = np.repeat(begins + lengths, lengths) - np.arange(n_bytes)  # bytes up to the word's end

    def buckets(at: np.ndarray | slice, n: int) -> np.ndarray:
        h = np.full(n_bytes if isinstance(at, slice) else len(at), n, np.uint64)
        for j in range(n):
            h = (h ^ (raw[j : j + n_bytes][at] + np.uint64(1))) * FACTORS[j]
            h ^= h >> np.uint64(15)
        return (h >> np.uint64(7) & np.uint64((1 << GRAM_BITS) - 1)).astype(np.int64)

    return ids, [(buckets(slice(None), n), left >= n) for n in GRAMS], begins, [(buckets(begins, n), lengths >= n) for n in BEGINNINGS]


def inputs_of(model: dict[str, np.ndarray], parts: tuple) -> np.ndarray:
    """Input vector of each different word: four log-odds and two embeddings."""
    ids, grams, begins, fronts = parts
    out = np.zeros((len(ids), INPUTS), np.float32)
    if not len(ids):
        return out
    most, total, count, embedded = None, 0.0, 0.0, 0.0
    for at, valid in grams:
        odds = np.where(valid, model["gram_odds"][at], 0).astype(np.float32)
        highest = np.maximum.reduceat(np.where(valid, odds, -9), begins)
        most = highest if most is None else np.maximum(most, highest)
        total = total + np.add.reduceat(odds, begins)
        count = count + np.add.reduceat(valid, begins, dtype=np.float32)
        embedded = embedded + np.add.reduceat(model["E_gram"][at] * valid[:, None], begins, axis=0)
    out[:, 0], out[:, 1], out[:, 2] = model["word_odds"][ids], most, total / count
    out[:, 3] = np.max([np.where(valid, model["gram_odds"][at], -9) for at, valid in [*fronts, (grams[0][0][begins], np.ones(len(ids), bool))]], 0)
    out[:, ODDS : ODDS + EMBED] = model["E_word"][ids]
    out[:, ODDS + EMBED :] = embedded / count[:, None]
    return out


def windows(ends: np.ndarray, span: int = SPAN, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Word places (-1: padding) of every window, and the text of each; the last window of a text ends with it."""
    sizes = np.diff(ends)
    counts = np.maximum(1, -(-np.maximum(sizes - span, 0) // step) + 1)
    text = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = np.minimum(nth * step, np.maximum(sizes - span, 0)[text])
    inside = begin[:, None] + np.arange(span)
    return np.where(inside < sizes[text][:, None], inside + ends[:-1][text][:, None], -1), text


def fresh_model(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    model = {"E_word": normal(1 << WORD_BITS, EMBED, scale=0.05), "E_gram": normal(1 << GRAM_BITS, EMBED, scale=0.05)}
    for d in "fb":
        model |= {f"W_{d}": normal(INPUTS, 3 * HIDDEN, scale=0.3), f"U_{d}": normal(HIDDEN, 3 * HIDDEN, scale=0.3), f"b_{d}": np.zeros(3 * HIDDEN, np.float32)}
    return model | {"A": normal(2 * HIDDEN, ATTEND, scale=0.3), "v": normal(ATTEND, scale=0.3), "w": normal(2 * HIDDEN, scale=0.3), "b": np.zeros(1, np.float32)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def run(model: dict[str, np.ndarray], gates: dict[str, np.ndarray], mask: np.ndarray, keep: bool = False):
    """Logits of windows, from gate inputs by direction (time, window, 3 * HIDDEN); with ``keep`` also what backward needs."""
    span, n = mask.shape
    states, kept = np.empty((span, n, 2 * HIDDEN), np.float32), {}
    for d, order in (("f", range(span)), ("b", range(span - 1, -1, -1))):
        h, side = np.zeros((n, HIDDEN), np.float32), slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
        u, trace = model[f"U_{d}"], []
        for t in order:
            x, hu = gates[d][t], h @ u
            zr = sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            if keep:
                trace.append((t, h, z, r, c, hu[:, 2 * HIDDEN :]))
            h = h + z * (c - h)
            states[t, :, side] = h
        kept[d] = trace
    seen = np.tanh(states @ model["A"])
    e = np.where(mask, seen @ model["v"], -1e9)
    a = np.exp(e - e.max(0)) * mask
    a /= np.maximum(a.sum(0), 1e-9)
    pooled = (a[:, :, None] * states).sum(0)
    logits = pooled @ model["w"] + model["b"]
    return (logits, states, seen, a, pooled, kept) if keep else logits


def gates_of(model: dict[str, np.ndarray], x: np.ndarray) -> dict[str, np.ndarray]:
    """Gate inputs of each different word and, last, of padding, whose update gate stays shut."""
    out = {}
    for d in "fb":
        g = x @ model[f"W_{d}"] + model[f"b_{d}"]
        pad = np.zeros((1, 3 * HIDDEN), np.float32)
        pad[:, :HIDDEN] = -40
        out[d] = np.concatenate([g, pad])
    return out


def logits_of(model: dict[str, np.ndarray], x: np.ndarray, at: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Logit of every window; x: inputs of the different words; at: word of each place."""
    gates, out = gates_of(model, x), []
    where = np.append(at, len(x))
    for k in range(0, len(places), BLOCK):
        part = places[k : k + BLOCK].T
        ids = where[part]
        out.append(run(model, {d: g[ids] for d, g in gates.items()}, part >= 0))
    return np.concatenate(out) if out else np.zeros(0, np.float32)


def gradients(model: dict[str, np.ndarray], x: np.ndarray, ids: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Of the weighted log loss; ids: (time, window) words, padding has the last row of the gates; also of the inputs."""
    gates = gates_of(model, x)
    logits, states, seen, a, pooled, kept = run(model, {d: g[ids] for d, g in gates.items()}, mask, keep=True)
    dlogit = ((sigmoid(logits) - y) * weight / weight.sum()).astype(np.float32)
    g = {"w": pooled.T @ dlogit, "b": dlogit.sum(keepdims=True)}
    dpooled = dlogit[:, None] * model["w"]
    da = (states * dpooled).sum(2)
    de = a * (da - (a * da).sum(0))
    dseen = de[:, :, None] * model["v"] * (1 - seen**2)
    g["v"] = np.einsum("tnk,tn->k", seen, de)
    g["A"] = np.einsum("tnh,tnk->hk", states, dseen)
    dstates = a[:, :, None] * dpooled + dseen @ model["A"].T
    dx = np.zeros((len(x), INPUTS), np.float32)
    for d in "fb":
        u, side = model[f"U_{d}"], slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
        dh, du, dgate = np.zeros((mask.shape[1], HIDDEN), np.float32), np.zeros_like(u), np.zeros((len(x) + 1, 3 * HIDDEN), np.float32)
        for t, h, z, r, c, hu in reversed(kept[d]):
            dh = dh + dstates[t, :, side]
            dc = dh * z * (1 - c**2)
            dz, dr = dh * (c - h) * z * (1 - z), dc * hu * r * (1 - r)
            back = np.concatenate([dz, dr, dc * r], 1)
            np.add.at(dgate, ids[t], np.concatenate([dz, dr, dc], 1))
            du += h.T @ back
            dh = dh * (1 - z) + back @ u.T
        g[f"U_{d}"], g[f"W_{d}"], g[f"b_{d}"] = du, x.T @ dgate[:-1], dgate[:-1].sum(0)
        dx += dgate[:-1] @ model[f"W_{d}"].T
    return g, dx


def log_odds(model: dict[str, np.ndarray], parts: tuple, at: np.ndarray, ends: np.ndarray, y: np.ndarray) -> None:
    """Smoothed log-odds of each word and n-gram bucket, by the rows that hold it."""
    ids, grams, begins, fronts = parts
    of_byte = np.repeat(np.arange(len(ids)), np.diff(np.append(begins, len(grams[0][0]))))
    words, share = [np.unique(at[b:e]) for b, e in zip(ends[:-1], ends[1:], strict=True)], y.mean()
    rows = np.repeat(np.arange(len(words)), [len(w) for w in words])
    flat = np.concatenate(words) if words else np.zeros(0, np.int64)

    def odds(bucket_of: np.ndarray, word_of: np.ndarray, bits: int) -> np.ndarray:
        order = np.argsort(word_of, kind="stable")
        bucket_of, first = bucket_of[order], np.searchsorted(word_of[order], np.arange(len(ids) + 1))
        counts = np.zeros((2, 1 << bits))
        for k in range(0, len(words), 256):  # the distinct pairs of row and bucket, for some rows at a time
            part = (rows >= k) & (rows < k + 256)
            n = first[flat[part] + 1] - first[flat[part]]
            take = np.repeat(first[flat[part]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            pair = np.unique((np.repeat(rows[part], n) << bits) | bucket_of[take])
            toxic = y[pair >> bits].astype(int)
            np.add.at(counts, (toxic, pair & ((1 << bits) - 1)), 1)
        return (np.log((counts[1] + SMOOTH * share) / (counts[0] + SMOOTH * (1 - share))) - np.log(share / (1 - share))).astype(np.float32)

    model["word_odds"] = odds(ids, np.arange(len(ids)), WORD_BITS)
    every = [(a[v], of_byte[v]) for a, v in grams] + [(a[v], np.flatnonzero(v)) for a, v in fronts]
    model["gram_odds"] = odds(np.concatenate([a for a, _ in every]), np.concatenate([w for _, w in every]), GRAM_BITS)


def train(texts: list[str], labels: list[int], rounds: int = 3, batch: int = 256, rate: float = 0.01, seed: int = 7) -> dict[str, np.ndarray]:
    """The model, with its calibration; a constant one where only one label is there."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return {"constant": np.array([y.mean() if len(y) else 0.0])}
    model, rng = fresh_model(seed), np.random.default_rng(seed)
    words, at, ends = read_words(texts)
    parts = word_parts(words)
    log_odds(model, parts, at, ends, y)
    places, text = windows(ends)
    first = np.searchsorted(text, np.arange(len(y) + 1))
    x = inputs_of(model, parts)
    suspicion = np.where(places >= 0, np.append(x[:, 0] + x[:, 1] + x[:, 3], 0)[np.append(at, len(x))[places]], -9).max(1)
    learnt = [k for k in model if k not in ("word_odds", "gram_odds")]
    moments, step = {k: (np.zeros_like(model[k]), np.zeros_like(model[k])) for k in learnt}, 0
    of_byte = np.repeat(np.arange(len(words)), np.diff(np.append(parts[2], len(parts[1][0][0]))))
    for _ in range(rounds):
        worst = np.array([first[k] + int(np.argmax(suspicion[first[k] : first[k + 1]])) for k in range(len(y))])
        toxic, clean = worst[y == 1], worst[y == 0]
        others = np.flatnonzero(y[text] == 0)
        chosen = np.concatenate([toxic, toxic[rng.integers(len(toxic), size=len(clean) // 2)], clean, rng.choice(others, min(len(others), len(clean)), replace=False)])
        goal = y[text[chosen]]
        weight = np.where(goal == 1, (goal == 0).sum() / max(1, (goal == 1).sum()), 1).astype(np.float32)
        for _ in range(2):
            order = rng.permutation(len(chosen))
            for k in range(0, len(order), batch):
                pick = order[k : k + batch]
                part = places[chosen[pick]].T
                local, ids = np.unique(np.append(at, len(words))[part], return_inverse=True)
                ids = ids.reshape(part.shape)
                if local[-1] != len(words):
                    local = np.append(local, len(words))
                own = local[:-1]
                spot = np.flatnonzero(np.isin(of_byte, own, kind="table")) if len(own) else np.zeros(0, int)
                mine = np.searchsorted(own, of_byte[spot])
                sub = (parts[0][own], [(a[spot], v[spot]) for a, v in parts[1]], np.searchsorted(mine, np.arange(len(own))), [(a[own], v[own]) for a, v in parts[3]])
                g, dx = gradients(model, inputs_of(model, sub), ids, part >= 0, goal[pick], weight[pick])
                g["E_word"] = np.zeros_like(model["E_word"])
                np.add.at(g["E_word"], sub[0], dx[:, ODDS : ODDS + EMBED])
                count = sum(np.add.reduceat(v, sub[2], dtype=np.float32) for _, v in sub[1]) if len(own) else np.ones(0, np.float32)
                g["E_gram"] = np.zeros_like(model["E_gram"])
                for a, v in sub[1]:
                    np.add.at(g["E_gram"], a[v], (dx[:, ODDS + EMBED :] / count[:, None])[mine[v]])
                step += 1
                for name in learnt:
                    m, s = moments[name]
                    m += 0.1 * (g[name] - m)
                    s += 0.01 * (g[name] ** 2 - s)
                    model[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
        x = inputs_of(model, parts)
        suspicion = logits_of(model, x, at, places)
    top = np.maximum.reduceat(suspicion, first[:-1])
    return model | {"calibration": calibrate(top, y)}


def calibrate(top: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and intercept of a ridge logistic fit of the label on the worst window's logit."""
    scale = max(float(top.std()), 1e-3)
    design, theta = np.stack([(top - top.mean()) / scale, np.ones_like(top)], 1).astype(float), np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p) + 1e-6)[:, None]) + 0.5 * np.eye(2)
        theta -= np.linalg.solve(hessian, design.T @ (p - y) + 0.5 * theta)
    return np.array([theta[0] / scale, theta[1] - theta[0] * top.mean() / scale])


def score_texts(model: dict[str, np.ndarray], texts: list[str | None]) -> np.ndarray:
    if "constant" in model:
        return np.full(len(texts), float(model["constant"][0]))
    words, at, ends = read_words(texts)
    places, text = windows(ends)
    logits = logits_of(model, inputs_of(model, word_parts(words)), at, places)
    top = np.maximum.reduceat(logits, np.searchsorted(text, np.arange(len(texts)))).astype(float)
    slope, intercept = model["calibration"]
    return 1 / (1 + np.exp(-np.clip(slope * top + intercept, -40, 40)))


def first_rows(labelled: DataFrame, order: Column, toxic: int = TOXIC, clean: int = CLEAN) -> DataFrame:
    """The rows of each label that come first by ``order``, a 64-bit hash, in at most these numbers.

    By the counts of the two labels, rows that can't be among the first but by a rare chance are left out before they are sorted, so that what a label sends to
    one task doesn't grow with the rows that it has; a label that this leaves with too few is not thinned.
    """
    rows = labelled.where(F.col("toxic").isin(0, 1)).withColumn("toxic", F.col("toxic").cast("int")).withColumn("_order_by", order)
    most = {1: toxic, 0: clean}
    counted = lambda df: {r["toxic"]: r["count"] for r in df.groupBy("toxic").count().collect()}
    counts = counted(rows)
    place = F.col("_order_by").cast("double") / 2.0**64 + 0.5
    share = lambda label: min(1.0, 2.0 * most[label] / max(1, counts.get(label, 0)))
    thin = lambda kinds: F.coalesce(*[F.when(F.col("toxic") == k, place <= share(k)) for k in kinds], F.lit(True))
    left = counted(rows.where(thin(most)))
    rows = rows.where(thin([k for k in most if left.get(k, 0) >= min(most[k], counts.get(k, 0))]))
    first = [rows.where(F.col("toxic") == k).orderBy("_order_by").limit(n) for k, n in most.items()]
    return first[0].unionByName(first[1]).drop("_order_by")


def learning_sample(labelled: DataFrame, chars: int = LEARN_CHARS) -> DataFrame:
    """(toxic, _order, text) of a bounded number of rows."""
    rows = labelled.where(F.col("text").isNotNull() & (F.length("text") <= chars)).select("toxic", F.xxhash64("text").alias("_order"), "text")
    return first_rows(rows, F.col("_order"))


def fit(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Train on (text, toxic): in one task, which the bounded sample fits in and which Spark repeats if it is lost."""

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame({"toxic": [], "_order": [], "text": []})]).sort_values(["toxic", "_order", "text"])
        yield pd.DataFrame({"model": [pickle.dumps(train(rows["text"].tolist(), rows["toxic"].astype(int).tolist()))]})

    found = learning_sample(labelled).repartition(1).mapInPandas(learn, "model binary").collect()
    return pickle.loads(found[0].model) if found else train([], [])


def slices(texts: list[str | None], chars: int = 1 << 20) -> Iterator[slice]:
    """Consecutive texts of about ``chars`` characters together, to bound a task's memory."""
    begin, total = 0, 0
    for k, t in enumerate(texts):
        total += len(t or "")
        if total >= chars:
            yield slice(begin, k + 1)
            begin, total = k + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def score(documents: DataFrame, model: dict[str, np.ndarray], *keep: Column | str, score: str = "score", verdict: str = "predicted") -> DataFrame:
    """``keep`` columns and the score and verdict, under the names given, for every row of (text)."""
    learnt = documents.sparkSession.sparkContext.broadcast(model)  # a few MB, of a fixed size

    rows = documents.select(F.struct(*keep).alias("kept"), F.col("text").alias("text"))
    names = [f"kept.`{f.name}`" for f in rows.schema["kept"].dataType.fields]

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = batch.tolist()
            yield pd.Series(np.concatenate([score_texts(learnt.value, texts[s]) for s in slices(texts)]) if texts else np.zeros(0))

    found = rows.withColumn("found", scores.asNondeterministic()("text"))  # so that a filter on it does not run it twice
    return found.select(*names, F.col("found").alias(score), (F.col("found") >= 0.5).cast("int").alias(verdict))
