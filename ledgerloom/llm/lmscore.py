"""Language-model scoring by masked pseudo-likelihood.

The score of a text is the sum, over its tokens, of the log-probability of the token given its neighbours on both sides. A window network
in numpy gives it: the ``AROUND`` tokens before and after each bring a vector of their own for their place, and the sum
goes through tanh into a hidden state. From it the token is told in two steps, as in a hierarchical softmax: a softmax over classes of tokens, then, with weights of the class's own,
a softmax over the leaves of the class. A frequent token is a class or a leaf by itself; rare ones share a leaf, and there each has its share by corpus counts.

Words are counted over all texts (each task counts its own, Spark adds them up). The ``WORDS`` most frequent ones
are tokens; the others share hashed tokens, of which there are as many as a quarter of the different words, up to a power of two, so that what is kept of rare words grows with the input; ``MOST_TAIL`` bounds
their table, about 30 MB, by the memory of a worker. The ``OWN`` most frequent tokens are classes by themselves, the others are
dealt to ``BINS`` classes of equal mass by falling count, and each of these to ``LEAVES`` leaves of equal mass. Training takes every text once, in ``ROUNDS`` rounds: each task starts
from the shared weights, follows the gradient over its texts, and the tasks' weights are averaged by the tokens seen,
in steps of at most ``FAN`` at a time and in the order of the tasks, so neither a task nor the driver holds more than that many sets of weights, and reruns on the same splits agree.

Edge cases: null and empty texts have no tokens, a pseudo-likelihood of 0 and a null mean; rows are scored one by one, so equal
texts get equal scores; a text of one token is scored without neighbours; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

WORDS, TAIL, MOST_TAIL = 24_576, 8_192, 1 << 22
INPUT_WORDS, INPUT_TAIL = 3_072, 1_023
OWN, BINS, LEAVES = 32, 32, 32
AROUND, HIDDEN = 2, 16
ROUNDS, FAN = 2, 32
BATCH, RATE = 2048, 0.15
LEAF_BATCH = 4096
PIECE = 4096
CHARS = 1 << 20
TOKEN = re.compile(r"\w+")


def slices(texts: list[str | None]) -> Iterator[slice]:
    begin, total = 0, 0
    for k, t in enumerate(texts):
        total += len(t or "")
        if total >= CHARS:
            yield slice(begin, k + 1)
            begin, total = k + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, n) over all texts of (text)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own: Counter[str] = Counter()
            for text in batch["text"]:
                if text:
                    own.update(TOKEN.findall(text.lower()))
            if own:
                yield pd.DataFrame({"word": list(own), "n": list(own.values())})

    return documents.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dealt(counts: np.ndarray, parts: int) -> np.ndarray:
    """Parts of about equal mass, in the order given."""
    mass = np.cumsum(counts)
    return np.minimum((mass - counts) * parts // max(mass[-1], 1) if len(mass) else mass, parts - 1).astype(np.int64)


class Vocabulary:
    """Token and input ids of words, and the class, the leaf in it and the share in that of each token."""

    def __init__(self, top: list[tuple[str, int]], buckets: np.ndarray, tail: np.ndarray, size: int = TAIL) -> None:
        """top: the most frequent words and their counts; tail: counts of the others by hashed token, of ``size`` ones."""
        self.ids, self.tail = {w: k for k, (w, _) in enumerate(top)}, size
        counts = np.ones(WORDS + size)  # one more than counted: a token not met is not impossible
        counts[: len(top)] += [n for _, n in top]
        counts[WORDS + buckets] += tail
        order = np.argsort(-counts, kind="stable")
        bins, classes, leaves = dealt(counts[order[OWN:]], BINS), np.empty(len(counts), np.int16), np.zeros(len(counts), np.int16)
        classes[order[:OWN]], classes[order[OWN:]] = np.arange(OWN), OWN + bins
        for k in range(BINS):
            own = order[OWN:][bins == k]
            leaves[own] = dealt(counts[own], LEAVES)
        self.classes, self.leaves = classes, leaves
        leaf = classes.astype(np.int64) * LEAVES + leaves
        self.share = np.log(counts / np.bincount(leaf, counts)[leaf]).astype(np.float32)
        self.prior = np.log(np.bincount(classes, counts, OWN + BINS) / counts.sum() + 1e-9).astype(np.float32)

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token ids, input ids, where texts begin and end); input id 0 stands for no word."""
        token, flat, ends = _Tokens(self.ids, self.tail).__getitem__, [], [0]
        for text in texts:
            flat += map(token, TOKEN.findall((text or "").lower()))
            ends.append(len(flat))
        tokens = np.array(flat, np.int64)
        inputs = np.where(tokens < INPUT_WORDS, tokens, INPUT_WORDS + tokens % INPUT_TAIL) + 1
        return tokens, inputs, np.array(ends)


class _Tokens(dict):
    """Ids of words; a word met for the first time is hashed to its tail token and kept."""

    def __init__(self, ids: dict[str, int], tail: int) -> None:
        super().__init__(ids)
        self.tail = tail

    def __missing__(self, word: str) -> int:
        self[word] = k = WORDS + zlib.crc32(word.encode()) % self.tail
        return k


def vocabulary(documents: DataFrame) -> Vocabulary:
    counts = cut(word_counts(documents))
    # The power of two from which on there are enough words: then only about as many are sorted and sent, whatever the number of partitions.
    sizes, enough, least = {r.power: r["count"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).count().collect()}, 0, 0
    for power in sorted(sizes, reverse=True):
        enough, least = enough + sizes[power], 2**power
        if enough >= WORDS:
            break
    size = min(MOST_TAIL, max(TAIL, 1 << (sum(sizes.values()) // 4).bit_length()))
    top = [(r.word, r.n) for r in counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(WORDS).collect()]
    named = counts.sparkSession.createDataFrame([(w,) for w, _ in top], "word string")
    rest = counts.join(named, "word", "left_anti").groupBy((F.crc32("word") % size).cast("int").alias("bucket")).agg(F.sum("n").alias("n")).toArrow()  # at most MOST_TAIL rows of two numbers
    return Vocabulary(top, rest["bucket"].to_numpy(), rest["n"].to_numpy(), size)


def fresh(vocab: Vocabulary, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {
        "E": rng.normal(0, 0.1, (2 * AROUND * (INPUT_WORDS + INPUT_TAIL + 1), HIDDEN)).astype(np.float32),
        "b": np.zeros(HIDDEN, np.float32),
        "W": rng.normal(0, 0.1, (HIDDEN, OWN + BINS)).astype(np.float32),
        "c": vocab.prior.copy(),
        "L": rng.normal(0, 0.1, (BINS, HIDDEN, LEAVES)).astype(np.float32),
        "l": np.zeros((BINS, LEAVES), np.float32),
    }


def contexts(inputs: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows of E for the neighbours of each token, a line for each place; those outside its text are the place's row of no word."""
    size, n = INPUT_WORDS + INPUT_TAIL + 1, len(inputs)
    out = np.empty((2 * AROUND, n), np.uint16)
    ids = inputs.astype(np.uint16)
    for k, d in enumerate([*range(-AROUND, 0), *range(1, AROUND + 1)]):
        own = out[k]
        own[:] = 0
        if d < 0:
            own[-d:] = ids[:d]
        else:
            own[: n - d] = ids[d:]
        for j in range(abs(d)):  # places at the edges of texts
            at = ends[:-1] + j if d < 0 else ends[1:] - 1 - j
            own[at[(at >= ends[:-1]) & (at < ends[1:])]] = 0
        own += np.uint16(k * size)
    return out


def forward(model: dict[str, np.ndarray], around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hidden states, scores of classes less their greatest, their exponentials and sums)."""
    total = model["E"].take(around, axis=0).sum(0)
    total += model["b"]
    hidden = np.tanh(total, out=total)
    z = hidden @ model["W"]
    z += model["c"]
    z -= z.max(1, keepdims=True)
    e = np.exp(z)
    return hidden, z, e, e.sum(1, keepdims=True)


def learn(model: dict[str, np.ndarray], squares: dict[str, np.ndarray], around: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """One step of Adagrad on the mean log loss of a batch's classes, in place; the hidden states before it."""
    hidden, _, d, total = forward(model, around)
    d /= total
    d[np.arange(len(goal)), goal] -= 1
    d *= np.float32(1 / len(goal))
    dh = (d @ model["W"].T) * (1 - hidden * hidden)
    for name, g in (("W", hidden.T @ d), ("c", d.sum(0)), ("b", dh.sum(0))):
        squares[name] += g * g
        model[name] -= RATE * g / (np.sqrt(squares[name]) + 1e-4)
    for own in around:
        order = np.argsort(own, kind="stable")  # of 16 bits: by radix
        sorted_ids = own[order]
        last = np.flatnonzero(np.append(sorted_ids[1:] != sorted_ids[:-1], True))
        rows = sorted_ids[last]
        g = np.diff(dh.take(order, axis=0).cumsum(0).take(last, axis=0), axis=0, prepend=np.float32(0))
        s = squares["E"].take(rows, axis=0) + g * g
        squares["E"][rows] = s
        model["E"][rows] -= RATE * g / (np.sqrt(s) + 1e-4)
    return hidden


def by_bin(classes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bin, places) of the tokens whose class has leaves, in batches."""
    order = np.argsort(classes, kind="stable")
    ends = np.searchsorted(classes[order], np.arange(OWN, OWN + BINS + 1))
    for k in range(BINS):
        for begin in range(ends[k], ends[k + 1], LEAF_BATCH):
            yield k, order[begin : min(begin + LEAF_BATCH, ends[k + 1])]


def leaf_scores(model: dict[str, np.ndarray], k: int, hidden: np.ndarray) -> np.ndarray:
    """Log-probabilities of the leaves of a bin."""
    z = hidden @ model["L"][k]
    z += model["l"][k]
    z -= z.max(1, keepdims=True)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    return z


def learn_leaves(model: dict[str, np.ndarray], squares: dict[str, np.ndarray], hidden: np.ndarray, classes: np.ndarray, leaves: np.ndarray) -> None:
    """Steps of Adagrad on the mean log loss of the leaves given the classes, in place; the hidden states are taken as they are."""
    for k, at in by_bin(classes):
        h = hidden.take(at, axis=0)
        d = np.exp(leaf_scores(model, k, h))
        d[np.arange(len(at)), leaves[at]] -= 1
        d *= np.float32(1 / len(at))
        for name, g in (("L", h.T @ d), ("l", d.sum(0))):
            squares[name][k] += g * g
            model[name][k] -= RATE * g / (np.sqrt(squares[name][k]) + 1e-4)


def train(documents: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    spark = documents.sparkSession
    model = fresh(vocab)
    names, shapes = list(model), {k: v.shape for k, v in model.items()}
    shared = spark.sparkContext.broadcast(vocab)  # bounded by WORDS and MOST_TAIL
    for turn in range(rounds):
        own = documents.select("text").where((F.pmod(F.xxhash64("text"), F.lit(rounds)) == turn) & (F.length("text") > 0))
        start = spark.sparkContext.broadcast(model)

        def follow(batches: Iterator[pd.DataFrame], start=start) -> Iterator[pd.DataFrame]:
            weights = {k: v.copy() for k, v in start.value.items()}
            squares, seen = {k: np.full(v.shape, 1e-6, np.float32) for k, v in weights.items()}, 0
            for batch in batches:
                texts = batch["text"].tolist()
                for part in slices(texts):
                    tokens, inputs, ends = shared.value.read(texts[part])
                    around, goal = contexts(inputs, ends), shared.value.classes[tokens]
                    hidden = [learn(weights, squares, around[:, k : k + BATCH], goal[k : k + BATCH]) for k in range(0, len(goal), BATCH)]
                    if hidden:
                        learn_leaves(weights, squares, np.concatenate(hidden), goal, shared.value.leaves[tokens])
                    seen += len(tokens)
            if seen:
                flat = np.concatenate([weights[k].ravel() for k in names])
                yield pd.DataFrame([(b // PIECE, float(seen), flat[b : b + PIECE]) for b in range(0, len(flat), PIECE)], columns=["piece", "seen", "weights"])

        def mean(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("part")
            seen = group["seen"].to_numpy()
            return pd.DataFrame({"piece": group["piece"].iloc[:1], "node": group["node"].iloc[:1], "seen": [seen.sum()], "weights": [np.average(np.stack(group["weights"]), axis=0, weights=seen).astype(np.float32)]})

        kind = "piece long, node long, seen double, weights array<float>"
        nodes = own.mapInPandas(follow, "piece long, seen double, weights array<float>").withColumn("node", F.spark_partition_id().cast("long"))
        tasks = own.rdd.getNumPartitions()
        while True:
            tasks = -(-tasks // FAN)
            nodes = nodes.withColumn("part", F.col("node")).withColumn("node", F.floor(F.col("node") / FAN)).groupBy("piece", "node").applyInPandas(mean, kind)
            if tasks <= 1:
                break
        pieces = sorted((r.piece, r.weights) for r in nodes.select("piece", "weights").collect())
        if pieces:
            flat, at = np.concatenate([np.array(w, np.float32) for _, w in pieces]), 0
            for k in names:
                size = int(np.prod(shapes[k]))
                model[k] = flat[at : at + size].reshape(shapes[k])
                at += size
    return model


def score_texts(model: dict[str, np.ndarray], vocab: Vocabulary, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, pseudo-log-likelihood) of each text."""
    tokens, inputs, ends = vocab.read(texts)
    around, goal, each, hidden = contexts(inputs, ends), vocab.classes[tokens], np.zeros(len(tokens)), np.empty((len(tokens), HIDDEN), np.float32)
    for k in range(0, len(goal), BATCH):
        hidden[k : k + BATCH], z, _, total = forward(model, around[:, k : k + BATCH])
        each[k : k + BATCH] = z[np.arange(len(z)), goal[k : k + BATCH]] - np.log(total[:, 0])
    leaves = vocab.leaves[tokens]
    for k, at in by_bin(goal):
        each[at] += leaf_scores(model, k, hidden.take(at, axis=0))[np.arange(len(at)), leaves[at]]
    sums = np.concatenate([[0.0], np.cumsum(each + vocab.share[tokens])])
    return np.diff(ends), sums[ends[1:]] - sums[ends[:-1]]


def score(documents: DataFrame, model: dict[str, np.ndarray], vocab: Vocabulary, *keep: Column | str) -> DataFrame:
    """``keep`` columns, n_tokens, pseudo_loglik and mean_logprob for every row of (text)."""
    learnt = documents.sparkSession.sparkContext.broadcast((model, vocab))  # bounded by WORDS and MOST_TAIL

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.pop("_scored").tolist()
            found = [score_texts(*learnt.value, texts[s]) for s in slices(texts)]
            n = np.concatenate([f[0] for f in found]) if found else np.zeros(0, int)
            total = np.concatenate([f[1] for f in found]) if found else np.zeros(0)
            yield batch.assign(n_tokens=n, pseudo_loglik=total)

    rows = documents.select(*keep, F.col("text").alias("_scored"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_scored")
    scored = rows.mapInPandas(work, f"{fields}, n_tokens long, pseudo_loglik double")
    return scored.withColumn("mean_logprob", F.when(F.col("n_tokens") > 0, F.col("pseudo_loglik") / F.col("n_tokens")))
