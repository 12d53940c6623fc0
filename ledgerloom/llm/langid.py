"""Language identification by compression.

Each language has a dictionary of raw content for zstandard, cut from a bounded sample of labelled texts.
A text is encoded in pieces with every language's dictionary, and the language of the smallest sum is chosen. Short texts
give equal sizes easily, so where the best two are close the text is encoded again with smaller dictionaries, shards of the
same content, and the sums are added up. A choice whose margin stays narrow is marked as rejected.

Bound: ``DOCS`` different labelled texts a language give at most ``PIECE`` characters each. All languages are learnt, and the dictionaries of ``GROUP`` of them at a time are the only
thing that goes through the driver. All texts are classified whole.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; equal sums go to the first language by name;
rows are handled one by one, so repeated rows get equal results; without learnt languages every text is ``und``;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stored

DOCS, PIECE = 400, 400
GROUP = 250
DICTIONARY, SHARDS = 112 * 1024, 4
CHUNK = 4096
LEVEL = 6
#: The second look: best and second differ by fewer bytes, or by a smaller part of the text.
CLOSE_BYTES, CLOSE_PART = 24, 0.02
#: Relative margin, in smoothed form, under which a choice counts as rejected.
REJECT = 0.01
LETTER = regex.compile(r"\p{L}")
OTHER = re.compile(r"[\W\d_]+")


def learning_sample(labelled: DataFrame, docs: int = DOCS, piece: int = PIECE) -> DataFrame:
    """(lang, text): for each language the ``docs`` different texts with letters that come first by their hash, a piece of each.

    Copies count once. Pieces are cut first, so that no whole text is shuffled. By the languages' counts of different texts, those that can't be
    among the first but by a rare chance are left out before, so that what a language sends to its task doesn't grow with the rows that it has;
    a language that this leaves with too few is not thinned.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("_hash"))
    place = F.col("_hash").cast("double") / 2.0**64 + 0.5
    different = cut(known.select("lang", "_hash").distinct())
    counts = different.groupBy("lang").count().collect()  # one a language
    shares = {r["lang"]: 4.0 * docs / r["count"] for r in counts if r["count"] > 4 * docs}

    def thin() -> Column:
        if not shares:
            return F.lit(True)
        table = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
        return place <= F.coalesce(F.element_at(table, F.col("lang")), F.lit(1.0))

    left = {r["lang"]: r["count"] for r in different.where(thin()).groupBy("lang").count().collect()}
    shares = {lang: share for lang, share in shares.items() if left.get(lang, 0) >= docs}
    rows = known.where(thin())
    at = F.pmod(F.shiftrightunsigned("_hash", 7), F.greatest(F.length("text") - piece, F.lit(1)))
    pieces = rows.select("lang", "_hash", F.substring(F.col("text"), at.cast("int") + 1, F.lit(piece)).alias("text")).groupBy("lang", "_hash").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("_hash")
    return pieces.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= docs).drop("_n")


def plain(text: str) -> bytes:
    """Lower-case letters with single spaces: capitals and signs cost the same in any language."""
    return f" {OTHER.sub(' ', text.lower()).strip()} ".encode()


def fit(labelled: DataFrame) -> Iterator[dict[str, bytes]]:
    """Raw content by language, of ``GROUP`` languages at a time, in the order of their names; the pieces are interleaved, so that every shard has some of all."""
    sample = stored(learning_sample(labelled), "pieces", "zstd")
    names = sorted(r[0] for r in sample.select("lang").distinct().collect())  # one a language
    for k in range(0, len(names), GROUP):
        pieces: dict[str, list[tuple[int, str]]] = {}
        for lang, key, text in sample.where((F.col("lang") >= names[k]) & (F.col("lang") <= names[k : k + GROUP][-1])).collect():
            pieces.setdefault(lang, []).append((key, text))
        yield {lang: b"".join(dict.fromkeys(plain(t) for _, t in sorted(rows)))[-DICTIONARY:] for lang, rows in sorted(pieces.items())}


@functools.lru_cache(maxsize=2)
def _compressors(content: tuple[tuple[str, bytes], ...]) -> tuple[list[str], list, list[list]]:
    def coder(raw: bytes) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)

    step = lambda raw: max(1, -(-len(raw) // SHARDS))
    shards = [[coder(raw[k : k + step(raw)]) for k in range(0, len(raw), step(raw))] for _, raw in content]
    return [lang for lang, _ in content], [coder(raw) for _, raw in content], shards


def first_look(raw: bytes, whole: list) -> np.ndarray:
    """The size of a text with each language's dictionary."""
    pieces = [raw[k : k + CHUNK] for k in range(0, len(raw), CHUNK)]
    return np.array([sum(len(c.compress(p)) for p in pieces) for c in whole], float)


def second_look(raw: bytes, sizes: np.ndarray, shards: list[list]) -> np.ndarray:
    """Mean sizes with smaller dictionaries and other forms of the text added: more sums, so fewer equal ones."""
    forms, sizes = [raw, raw[:-1] + raw, raw.strip()], sizes.copy()
    for form in forms:
        for k in range(0, len(form), CHUNK):
            sizes += [sum(len(c.compress(form[k : k + CHUNK])) for c in group) / len(group) for group in shards]
    return sizes / (1 + len(forms))


def are_close(best: float, second: float) -> bool:
    return second - best < max(CLOSE_BYTES, CLOSE_PART * best)


def verdict(best: float, second: float) -> tuple[float, bool]:
    """(score, accepted)."""
    margin = (second - best) / (best + 8.0)
    return float(1 / (1 + np.exp(-40 * margin))), bool(margin >= REJECT)


def says_something(text: str | None) -> bool:
    return bool(text) and LETTER.search(text) is not None


def classify(text: str | None, content: tuple[tuple[str, bytes], ...]) -> tuple[str, float, bool]:
    """(language, score, accepted)."""
    if not content or not says_something(text):
        return "und", 0.0, False
    names, whole, shards = _compressors(content)
    raw = plain(text)
    sizes = first_look(raw, whole)
    if len(names) == 1:
        return names[0], 1.0, True
    if are_close(*np.sort(sizes)[:2]):
        sizes = second_look(raw, sizes, shards)
    return names[int(np.argmin(sizes))], *verdict(*np.sort(sizes)[:2])


def _leading(old: tuple[float, float, str], sizes: np.ndarray, names: list[str]) -> tuple[float, float, str]:
    """(best, second, name of the best) with the sizes of more languages, later by name."""
    best = int(np.argmin(sizes))
    (a, b), name = np.sort([*old[:2], *sizes])[:2], old[2] if old[0] <= sizes[best] else names[best]
    return float(a), float(b), name


def identify(documents: DataFrame, content: dict[str, bytes] | Iterable[dict[str, bytes]], *keep: Column | str) -> DataFrame:
    """``keep`` columns and lang_pred, score, accepted for every row of (text). content: by language, or such tables by groups of languages in the order of their names.

    One group is one pass over the texts. Of more, each goes over a written table of the texts once for the first look and once for the choice, so workers hold the dictionaries of one group.
    """
    spark = documents.sparkSession
    groups = iter([content] if isinstance(content, dict) else content)
    first, more = next(groups, {}), next(groups, None)
    rows = documents.select(*keep, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    send = lambda group: spark.sparkContext.broadcast(tuple(sorted(group.items())))  # noqa: E731 - at most GROUP dictionaries
    if more is None:
        learnt = send(first)

        def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [classify(t, learnt.value) for t in batch.pop("text")]
                yield batch.assign(lang_pred=[f[0] for f in found], score=[f[1] for f in found], accepted=[f[2] for f in found])

        return rows.mapInPandas(predict, f"{fields}, lang_pred string, score double, accepted boolean")
    none = (float("inf"), float("inf"), "und")
    state = rows.withColumns({"_best": F.lit(none[0]), "_second": F.lit(none[1]), "_name": F.lit(none[2]), "_close": F.lit(False)})
    every = [send(g) for g in (first, more, *groups)]
    for last in (False, True):
        for learnt in every:

            def look(batches: Iterator[pd.DataFrame], learnt=learnt, last: bool = last) -> Iterator[pd.DataFrame]:
                names, whole, shards = _compressors(learnt.value)
                for batch in batches:
                    out = []
                    for text, *old, close in batch[["text", "_best", "_second", "_name", "_close"]].itertuples(index=False):
                        if says_something(text):
                            raw = plain(text)
                            sizes = first_look(raw, whole)
                            old = _leading(tuple(old), second_look(raw, sizes, shards) if last and close else sizes, names)
                        out.append(tuple(old))
                    yield batch.assign(_best=[o[0] for o in out], _second=[o[1] for o in out], _name=[o[2] for o in out])

            kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema.fields)
            state = stored(state.mapInPandas(look, kinds), "looked", "zstd")
            learnt.unpersist()
        if not last:  # where the best two are close, all sizes are taken again with the second look
            close = F.col("_second") - F.col("_best") < F.greatest(F.lit(float(CLOSE_BYTES)), CLOSE_PART * F.col("_best"))
            state = state.withColumns({"_close": close, "_best": F.lit(none[0]), "_second": F.lit(none[1]), "_name": F.lit(none[2])})

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [verdict(a, b) if name != "und" else (0.0, False) for a, b, name in zip(batch["_best"], batch["_second"], batch["_name"], strict=True)]
            yield batch.drop(columns=["text", "_best", "_second", "_close"]).rename(columns={"_name": "lang_pred"}).assign(score=[f[0] for f in found], accepted=[f[1] for f in found])

    return state.mapInPandas(choose, f"{fields}, lang_pred string, score double, accepted boolean")
