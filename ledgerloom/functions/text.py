"""Scalar text functions over columns: markup, entities, names, words, hashes."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

# Named character references that are decoded; the ampersand comes last.
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&rdquo;", "”"), ("&ldquo;", "“"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&copy;", "©"), ("&middot;", "·")]
# Connectives that never make two names differ.
NAME_GLUE = ["of", "the", "de", "la", "le", "du", "el", "al"]
# Second-level labels under which names are registered.
PUBLIC_SECOND = ["co", "org", "com", "net", "ac", "gov", "edu", "ngo", "or", "ne"]


def collapse(text: Column) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f\x0B]+", " "))


def strip_tags(html: Column, cap: int | None = None) -> Column:
    """Text of HTML: scripts, styles and navigation away, block ends as line ends, other tags as spaces."""
    steps = [
        (r"(?is)<script[^>]*>.*?</script>", " "),
        (r"(?is)<style[^>]*>.*?</style>", " "),
        (r"(?is)<noscript[^>]*>.*?</noscript>", " "),
        (r"(?is)<(nav|footer|header|aside)[^>]*>.*?</(nav|footer|header|aside)>", " "),
        (r"(?is)<!--.*?-->", " "),
        (r"(?i)</?(p|div|section|article|h[1-6]|li|ul|ol|tr|table|br|blockquote)[^>]*>", "\n"),
        (r"<[^>]+>", " "),
    ]
    text = reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, F.coalesce(html, F.lit("")))
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f]+", " "), r" ?\n[ \n]*", "\n")
    text = F.trim(text)
    return F.substring(text, 1, cap) if cap else text


def decode_named(text: Column) -> Column:
    out = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)
    return F.replace(F.regexp_replace(out, "&#39;", "'"), F.lit("&amp;"), F.lit("&"))


@F.udf(StringType(), useArrow=False)
def decode_entities(text: str | None) -> str | None:
    """All character references, numeric ones too; row by row, as the texts of a whole Arrow batch would have to fit in a worker."""
    import html

    return None if text is None else html.unescape(text)


def normal_title(title: Column) -> Column:
    """Comparable form of a name or heading: lower case, other signs than letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", " "))


def grant_title(title: Column) -> Column:
    """Identity form of a grant's title: lower case, other signs than letters, digits and spaces deleted."""
    return F.trim(F.regexp_replace(F.lower(title), r"[^a-z0-9 ]", ""))


def name_tokens(name: Column) -> Column:
    """Order-insensitive key of a name: its different words without glue."""
    words = F.split(normal_title(name), " ")
    return F.sort_array(F.array_except(F.array_distinct(F.filter(words, lambda w: w != "")), F.array(*map(F.lit, NAME_GLUE))))


def contained(smaller: Column, larger: Column) -> Column:
    """Every token of the smaller set is in the larger; empty sets contain nothing and are in nothing."""
    return (F.size(smaller) > 0) & (F.size(larger) > 0) & (F.size(F.array_except(smaller, larger)) == 0)


def host(url: Column) -> Column:
    """Lower-case host without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"(?i)^[a-z]+://([^/:?#]+)", 1)), r"^www\.", "")


def main_label(host_name: Column) -> Column:
    """The label that was registered: the one before the public suffix of one or two labels."""
    labels = F.split(host_name, r"\.")
    second = F.element_at(labels, -2).isin(PUBLIC_SECOND) & (F.length(F.element_at(labels, -1)) == 2)
    return F.when(F.size(labels) < 2, F.element_at(labels, 1)).when(second & (F.size(labels) > 2), F.get(labels, F.size(labels) - 3)).otherwise(F.get(labels, F.size(labels) - 2))


def count_words(text: Column) -> Column:
    """Words of any script: zero-width signs away, pipes as spaces, each CJK character as a word."""
    cleaned = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[​‌‍﻿]", ""), r"\|", " ")
    spaced = F.regexp_replace(cleaned, "([぀-ヿ㐀-䶿一-鿿])", " $1 ")
    return F.regexp_count(spaced, F.lit(r"[^ \t\r\n\f]+")).cast("long")


def document_hash(text: Column, version: str = "v1") -> Column:
    """Versioned digest of a document, insensitive to line ends, trailing blanks and blank runs."""
    lines = F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), r"[ \t]+\n", "\n")
    return F.concat(F.lit(version + ":"), F.sha2(F.trim(F.regexp_replace(lines, r"\n{3,}", "\n\n")), 256))


def numbers(text: Column) -> Column:
    """Numbers of a text; a per cent sign makes a fraction; commas group digits."""
    found = F.regexp_extract_all(text, F.lit(r"([0-9][0-9,]*(?:\.[0-9]+)?%?)"), F.lit(1))
    value = lambda x: F.regexp_replace(x, "[,%]", "").cast("double")
    return F.transform(found, lambda x: F.when(x.endswith("%"), value(x) / 100).otherwise(value(x)))


def numbers_of(text: Column, unit: str) -> Column:
    """Numbers that stand before a unit, such as participants."""
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"([0-9][0-9,]*) +(?:{unit})"), F.lit(1))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).cast("long"))


def significant_figures(value: Column) -> Column:
    """Of a whole number: digits without the zeros at its end."""
    return F.length(F.regexp_replace(F.abs(value).cast("string"), "0+$", "")).cast("int")


def links(html: Column) -> Column:
    """Targets of links, without query and fragment, as written."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?i)href *= *["\']([^"\'#?]+)'), F.lit(1)))


@F.pandas_udf(ArrayType(StringType()))
def absolute_links(found: pd.Series, base: pd.Series) -> pd.Series:
    """Links resolved against the page's address; http only, no slash at the end."""
    from urllib.parse import urljoin

    def resolve(own, url):
        whole = (urljoin(url or "", x) for x in (own if own is not None else []))
        return list(dict.fromkeys(u.rstrip("/") for u in whole if u.startswith(("http://", "https://"))))

    return pd.Series([resolve(o, u) for o, u in zip(found, base, strict=True)])


@F.pandas_udf(LongType())
def fnv1a(text: pd.Series) -> pd.Series:
    """32-bit FNV-1a of the UTF-8 bytes."""

    def one(t: str | None) -> int | None:
        if t is None:
            return None
        h = 0x811C9DC5
        for b in t.encode():
            h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
        return h

    return text.map(one).astype("Int64")


def has_date(text: Column) -> Column:
    """A year, a month's name or a season."""
    return text.rlike(r"(?i)\b(19|20)[0-9][0-9]\b|\b(january|february|march|april|may|june|july|august|september|october|november|december|spring|summer|autumn|winter)\b")
