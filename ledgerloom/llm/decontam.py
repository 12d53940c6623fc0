"""Benchmark decontamination with a distributed positional inverted index, in built-in expressions only.

Test items are cut into windows of ``window`` consecutive words (an item of fewer words is one window). The index is a written table of
postings: for every term that the items hold, a row for each of its places in the training texts, and for every text one row that tells its number of words. The
texts are cut into words once. A window's terms are ordered by their counts in the index, and their lists, shifted by the terms' offsets,
are intersected from the rarest on: the rarest list gives the candidate places, the second list cuts them, and what is left is intersected with all the other
lists. So a match is read off the index alone. A window with a term that no text holds is dropped before. Proximity matches are read off the same index.

Tables of the asked terms and windows are broadcast while a count shows that they have at most ``BROADCAST_ROWS`` short rows; beyond it they are
joined by shuffles. No list is gathered in one task: postings are rows.

Edge cases: a null text has no words and no hits; items without words have no windows; repeated items or equal
windows of several items each count for their items; an item without an id makes hits but has no name among the items; rows are told apart by document id and text, equal rows get
equal results; empty tables give no rows (documents) or no hits (items); other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stored

WINDOW = 10
BROADCAST_ROWS = 200_000
#: Terms and width of the proximity question that an item asks.
NEAR_TERMS, NEAR_WIDTH = 3, 10
#: No word is empty, so this term marks the rows that stand for whole texts.
TEXT = ""
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window, words, items): the different windows by a digest, and the items that hold them."""
    words = items.select("item_id", words_of(F.col("text")).alias("_words")).where(F.size("_words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - window + 1, F.lit(1)))
    pieces = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("_words", i, F.lit(window)))).alias("words"))
    return pieces.groupBy("words").agg(F.collect_set("item_id").alias("items")).select(F.md5(F.array_join("words", " ")).alias("window"), "words", "items")


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a table of short rows where a count shows that it is small; else leave the join to shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def index_of(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc_id, _a, _b, pos, n_words): the postings of ``terms`` (term), and a row of the term ``TEXT`` for every text; positions count from 0.

    A text is named by two hashes of its id and itself, which are never null.
    """
    whole = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("_a"), F.xxhash64("text", "doc_id", F.lit(1)).alias("_b"), words_of(F.col("text")).alias("_words"))
    tokens = whole.select("doc_id", "_a", "_b", F.size("_words").alias("n_words"), F.posexplode(F.concat(F.array(F.lit(TEXT)), "_words")).alias("pos", "term"))
    asked = terms.select("term").union(documents.sparkSession.range(1).select(F.lit(TEXT)))
    return stored(tokens.join(few(asked), "term", "left_semi").select("term", "doc_id", "_a", "_b", (F.col("pos") - 1).alias("pos"), "n_words"), "postings")


def texts_of(index: DataFrame) -> DataFrame:
    """(doc_id, _a, _b, n_words) of every row of the documents."""
    return index.where(F.col("term") == TEXT).select("doc_id", "_a", "_b", "n_words")


def term_counts(index: DataFrame) -> DataFrame:
    return index.where(F.col("term") != TEXT).groupBy("term").agg(F.count("*").alias("n"))


def ordered_windows(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(window, items, lists): windows all of whose terms occur; lists are their (n, term, offset) from the rarest on."""
    terms = windows.select("window", F.posexplode("words").alias("offset", "term")).join(few(counts), "term", "left")
    lists = terms.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("n", "term", "offset"))).alias("lists"), F.max(F.col("n").isNull()).alias("_missing")).where(~F.col("_missing"))
    return windows.select("window", "items", F.size("words").alias("length")).join(lists.drop("_missing"), "window")


def shifted(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(window, _a, _b, start): the lists of (window, term, offset), shifted to where the window would start."""
    lists = index.join(few(asked), "term")
    return lists.select("window", "_a", "_b", (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0")


def phrase_matches(index: DataFrame, windows: DataFrame) -> DataFrame:
    """(_a, _b, start, length, items) for every place of every window (window, words, items): the intersection of its shifted lists."""
    place = ["window", "_a", "_b", "start"]
    asked = cut(ordered_windows(windows, cut(term_counts(index))))
    nth = lambda k: asked.where(F.size("lists") > k).select("window", F.get("lists", F.lit(k)).alias("l")).select("window", "l.term", "l.offset")
    rarest = shifted(index, nth(0)).join(few(asked.select("window", F.size("lists").alias("_lists"))), "window").distinct()
    second = rarest.where("_lists > 1").join(shifted(index, nth(1)), place, "left_semi")
    left = cut(rarest.where("_lists = 1").unionByName(second))
    rest = asked.select("window", F.explode(F.slice("lists", 3, F.greatest(F.size("lists") - 2, F.lit(0)))).alias("l")).select("window", "l.term", "l.offset")
    others = left.where("_lists > 2").join(few(rest), "window").select(*place, "_lists", "term", (F.col("start") + F.col("offset")).alias("pos"))
    texts = few(left.where("_lists > 2").select("_a", "_b").distinct())
    there = others.join(index.select("term", "_a", "_b", "pos").join(texts, ["_a", "_b"], "left_semi").distinct(), ["term", "_a", "_b", "pos"], "left_semi")
    whole = there.groupBy(*place, "_lists").agg(F.count("*").alias("_met")).where("_met = _lists - 2").select(*place)
    found = whole.unionByName(left.where("_lists <= 2").select(*place))
    return found.join(few(asked.select("window", "length", "items")), "window").select("_a", "_b", "start", "length", "items")


def proximity_questions(items: DataFrame, counts: DataFrame, terms: int = NEAR_TERMS) -> DataFrame:
    """(question_id, terms): for every item with words and an id its rarest different terms, by count and then by name."""
    words = items.where(F.col("item_id").isNotNull()).select("item_id", F.explode(F.array_distinct(words_of(F.col("text")))).alias("term")).distinct()
    counted = words.join(few(counts), "term", "left")
    return counted.groupBy(F.col("item_id").alias("question_id")).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term"))), 1, terms), lambda t: t["term"]).alias("terms"))


def proximity_matches(index: DataFrame, questions: DataFrame, within: int = NEAR_WIDTH) -> DataFrame:
    """(question_id, _a, _b, pos, last) where ``within`` consecutive words from ``pos`` hold all terms of (question_id, terms), in any order."""
    asked = questions.select("question_id", F.array_distinct("terms").alias("terms"))
    terms = asked.select("question_id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    found = index.select("term", "_a", "_b", "pos").join(few(terms), "term")
    ahead = Window.partitionBy("question_id", "_a", "_b").orderBy("pos").rangeBetween(0, within - 1)
    return found.withColumns({"_near": F.size(F.collect_set("term").over(ahead)), "last": F.max("pos").over(ahead)}).where("_near = n").select("question_id", "_a", "_b", "pos", "last")


def item_index(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The windows of the items, and the index of their terms."""
    windows = cut(windows_of(items, window))
    return windows, index_of(documents, windows.select(F.explode("words").alias("term")).distinct())


def contamination(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items, near_items, contaminated) for every row of (doc_id, text); near_items: items whose rarest terms stand close together in it."""
    windows, index = item_index(documents, items, window)
    matches = phrase_matches(index, windows)
    spans = matches.groupBy("_a", "_b").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("_spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("_items"),
    )
    hit = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda a, s: F.struct((a.n + F.greatest(s.end - F.greatest(s.start, a.to), F.lit(0))).alias("n"), F.greatest(a.to, s.end).alias("to")),
        lambda a: a.n,
    )
    spans = spans.select("_a", "_b", hit.alias("_hit"), "_items")
    near = proximity_matches(index, proximity_questions(items, term_counts(index))).groupBy("_a", "_b").agg(F.collect_set("question_id").alias("_near"))
    hits = F.coalesce("_hit", F.lit(0)).cast("long")
    none = F.array().cast(f"array<{items.schema['item_id'].dataType.simpleString()}>")
    joined = texts_of(index).join(spans, ["_a", "_b"], "left").join(near, ["_a", "_b"], "left")
    return joined.select("doc_id", F.col("n_words").cast("long").alias("n_words"), hits.alias("n_hit"), F.coalesce("_items", none).alias("items"), F.coalesce("_near", none).alias("near_items"), (hits > 0).alias("contaminated"))


def clean_documents(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a window of any item."""
    windows, index = item_index(documents, items, window)
    found = phrase_matches(index, windows).select(F.col("_a").alias("_hit_a"), F.col("_b").alias("_hit_b")).distinct()
    a, b = F.xxhash64(documents["doc_id"], documents["text"]), F.xxhash64(documents["text"], documents["doc_id"], F.lit(1))
    return documents.join(few(found), (a == found["_hit_a"]) & (b == found["_hit_b"]), "left_anti")
