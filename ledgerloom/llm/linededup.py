"""Line deduplication by winnowing over line hashes.

The lines of a text that are not blank are hashed, trimmed, to 128 bits. Windows are all spans of ``LINES`` lines, and all lines
of at least ``HEAVY`` words, which are windows by themselves. Winnowing selects the least hash of each window as its fingerprint, so a run that repeats over a whole window shares a
fingerprint for certain. Only selected lines are counted over all texts; a window whose fingerprint is selected nowhere else goes no further, and that ends most of them.

What is left is joined by fingerprint, and by the lines around it in the window, to the place where the window comes first, in the order of document id, text and line. A match
is extended both ways window by window: the next window of a repeated run stands earlier too, and so has a match of its own, so matches that touch or overlap
are one run. The lines of later runs are deleted. So all lines of every later run of the threshold go, whichever text holds the run first, and no text's lines are carried to another text.
Equal lines mean equal hashes of 128 bits; two differing lines share one by a chance of 10^-14 among 10^12 lines.

Copies of a whole text are one text here, that of the least id; the other copies lose all lines if the text reaches the threshold anywhere. A line in a third of all
texts gives a row for each text, not pairs, and its counts are combined before the shuffle.

Edge cases: null texts and texts without lines that reach the threshold lose nothing; line ends are ``\\n``; blank lines stay; repeated
rows of an id and a text get equal results; differing texts of an id are ordered by their digest; a null id is an id of its own and comes first; an empty table gives no
rows; other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

LINES, HEAVY = 2, 8
NO_ID = -(1 << 63)
LOW = (1 << 64) - 1


def text_digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def line_table(texts: DataFrame) -> DataFrame:
    """(t, id, at, hashes, checks, words) of each different text of (t, id, text), t being its digest: its least id, and place, hash (two halves) and words of its lines that are not blank, in order."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = [[(k, x) for k, x in enumerate(map(str.strip, (text or "").split("\n"))) if x] for text in batch["text"]]
            whole = [[xxhash.xxh3_128_intdigest(x) for _, x in own] for own in lines]
            yield pd.DataFrame(
                {
                    "t": batch["t"],
                    "id": batch["id"],
                    "at": [np.array([k for k, _ in own], np.int32) for own in lines],
                    "hashes": [np.array([h & LOW for h in own], np.uint64).view(np.int64) for own in whole],
                    "checks": [np.array([h >> 64 for h in own], np.uint64).view(np.int64) for own in whole],
                    "words": [np.array([len(x.split()) for _, x in own], np.int32) for own in lines],
                }
            )

    found = texts.mapInPandas(work, "t binary, id long, at array<int>, hashes array<long>, checks array<long>, words array<int>")
    return found.groupBy("t").agg(F.min("id").alias("id"), F.any_value(F.struct("at", "hashes", "checks", "words")).alias("l")).select("t", "id", "l.*")


def windows_of(lines: DataFrame, n: int, heavy: int) -> DataFrame:
    """(t, id, hashes, checks, windows): the windows as (pos, length) of every text that has any; positions count from 0."""
    places = F.sequence(F.lit(0), F.size("hashes") - 1)
    spans_of = lambda length, starts: F.transform(starts, lambda i: F.struct(i.alias("pos"), F.lit(length).alias("length")))
    heavies = spans_of(1, F.filter(places, lambda i: F.get("words", i) >= heavy))
    windows = F.array_distinct(F.concat(heavies, spans_of(n, F.filter(places, lambda i: i + n <= F.size("hashes")))))
    return lines.where(F.size("hashes") > 0).select("t", "id", "hashes", "checks", windows.alias("windows"))


def selected(windowed: DataFrame) -> DataFrame:
    """(fingerprint) for every selected line: the least of some window, once however many windows select it."""
    part = lambda w: F.slice("hashes", w["pos"] + 1, w["length"])
    minima = F.transform("windows", lambda w: F.struct((w["pos"] + F.array_position(part(w), F.array_min(part(w)))).alias("place"), F.array_min(part(w)).alias("fingerprint")))
    return windowed.select(F.explode(F.array_distinct(minima)).alias("m")).select("m.fingerprint")


def fingerprints(windowed: DataFrame) -> DataFrame:
    """(t, id, pos, length, fingerprint, one, two) of every window; one and two are hashes of its lines in their order."""
    spans = windowed.select("t", "id", "hashes", "checks", F.explode("windows").alias("w"))
    hashes, checks = (F.slice(c, F.col("w.pos") + 1, F.col("w.length")) for c in ("hashes", "checks"))
    return spans.select("t", "id", "w.pos", "w.length", F.array_min(hashes).alias("fingerprint"), F.xxhash64(hashes, F.lit(1)).alias("one"), F.xxhash64(checks, F.lit(2)).alias("two"))


def extended(matches: DataFrame) -> DataFrame:
    """(t, gone, runs): the lines of the matches (t, pos, length) of each text, and how many runs they make up once matches that touch are extended into each other."""
    lines = F.array_sort(F.array_distinct(F.flatten(F.transform("_spans", lambda s: F.sequence(s["pos"], s["pos"] + s["length"] - 1)))))
    own = matches.groupBy("t").agg(F.collect_set(F.struct("pos", "length")).alias("_spans")).select("t", lines.alias("gone"))  # at most two a line
    begins = F.filter("gone", lambda p, k: (k == 0) | (F.get("gone", k - 1) != p - 1))
    return own.select("t", "gone", F.size(begins).cast("long").alias("runs"))


def repeated_lines(texts: DataFrame, n: int = LINES, heavy: int = HEAVY) -> DataFrame:
    """(t, id, at, whole, gone, runs) for every different text of (t, id, text): places of its lines that are not blank, if copies lose them all, places of the lines to delete in its first copy, and their runs."""
    lines = cut(line_table(texts))
    windowed = windows_of(lines, n, heavy)
    repeated = cut(selected(windowed).groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint"))  # apart, so that Spark can split the join's hot keys
    marks = cut(fingerprints(windowed).join(repeated, "fingerprint", "left_semi"))
    key = ["fingerprint", "one", "two"]
    firsts = cut(marks.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("id", "t", "pos")).alias("first")).where("n > 1").drop("n"))
    matches = marks.join(firsts, key).where((F.col("t") != F.col("first.t")) | (F.col("pos") != F.col("first.pos"))).select("t", "pos", "length")
    whole = (F.size("hashes") >= n) | F.exists("words", lambda w: w >= heavy)
    found = lines.select("t", "id", "at", whole.alias("whole")).join(extended(matches), "t", "left")
    return found.select("t", "id", "at", "whole", F.coalesce(F.transform("gone", lambda p: F.get("at", p)), F.array().cast("array<int>")).alias("gone"), F.coalesce("runs", F.lit(0)).alias("runs"))


def free(name: str, taken: list[str]) -> str:
    """A column name that is not taken, whatever the case."""
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name


def strike(documents: DataFrame, n: int = LINES, heavy: int = HEAVY) -> tuple[DataFrame, str, str, str]:
    """All columns, with text replaced, and three more: lines, lines removed, and runs that they make up; with the names of these."""
    t, own, first, at, whole, gone, runs_of, parts, count, removed, runs = (free(x, documents.columns) for x in ("_t", "_own_id", "_first_id", "_at", "_whole", "_gone", "_runs_of", "_parts", "_lines", "_removed", "_runs"))
    rows = documents.withColumn(t, text_digest(F.col("text"))).withColumn(own, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    marks = repeated_lines(rows.select(F.col(t).alias("t"), F.col(own).alias("id"), "text"), n, heavy)
    joined = rows.join(marks.select(F.col("t").alias(t), F.col("id").alias(first), F.col("at").alias(at), F.col("whole").alias(whole), F.col("gone").alias(gone), F.col("runs").alias(runs_of)), t)
    copy = F.col(own) != F.col(first)
    joined = joined.withColumn(runs, F.when(~copy, F.col(runs_of)).otherwise(F.col(whole).cast("long"))).withColumn(gone, F.when(~copy, F.col(gone)).when(F.col(whole), F.col(at)).otherwise(F.array().cast("array<int>")))
    joined = joined.withColumns({count: F.size(at).cast("long"), removed: F.size(gone).cast("long"), parts: F.split("text", "\n")})
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone)), lambda k: F.get(F.col(parts), k))
    struck = joined.withColumn("text", F.when(F.col(removed) > 0, F.array_join(left, "\n")).otherwise(F.col("text")))
    return struck.drop(t, own, first, at, whole, gone, runs_of, parts), count, removed, runs


def without_repeated_lines(documents: DataFrame, n: int = LINES, heavy: int = HEAVY) -> DataFrame:
    """The documents with later repeated runs deleted; those of which no line is left, though there were some, go."""
    struck, count, removed, _ = strike(documents, n, heavy)
    struck = struck.where((F.col(count) == 0) | (F.col(removed) < F.col(count)))
    if "n_chars" in documents.columns:
        struck = struck.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(documents.schema["n_chars"].dataType))
    return struck.select(*[f"`{c}`" for c in documents.columns])
