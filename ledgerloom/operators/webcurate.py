"""Curation of crawled pages: admission, text, prose, paragraphs, site outcome, names of sites."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scan import running

# Weights of addresses by what they name.
PAGE_VALUES = [
    ("about|who-we-are|mission|vision|history", 10),
    ("program|project|our-work|what-we-do|service|impact|result|achiev", 9),
    ("annual-report|report|publication|case-stud", 7),
    ("team|leadership|staff|board|partner", 6),
    ("news|stories|blog", 3),
    (r"privacy|terms|cookie|contact|donate|login|signup|careers|tag/|page/|\?", -10),
]
# Statuses that refuse by themselves; thresholds of prose, shells and paragraphs.
REFUSING, SERVED = [401, 403, 429], [200, 202, 503]
CHALLENGE = r"(?i)(h|re)?captcha|are you a robot|verify you are human|just a moment\.\.\.|checking your browser"
CHALLENGE_CHARS, SHELL_CHARS, SHELL_RATIO, SHELL_LEAST = 3000, 600, 0.4, 500
PARAGRAPH_CHARS, PAGE_CHARS, SITE_CHARS, SITE_PAGES, KEY_CHARS = 40, 120, 60_000, 10, 120
MOUNT = r"""(?i)<div[^>]+id=["'](root|app|__next|__nuxt|___gatsby)["']"""
BOOTSTRAP = r"(?i)data-reactroot|window\.__NUXT__|window\.__NEXT_DATA__|ng-version=|window\.__INITIAL_STATE__|you need to enable javascript to run this app|<noscript>[^<]{0,200}javascript"
SKIPPED_ENDS = r"(?i)\.(pdf|jpe?g|png|gif|svg|webp|zip|docx?|xlsx?|pptx?|mp3|mp4|xml|rss|json|css|js|ico)$|/(feed|rss)/?$"


def page_value(url: Column) -> Column:
    """Weight of an address: 1, what it names, less its depth beyond two slashes."""
    depth = F.regexp_count(F.regexp_replace(url, "(?i)^https?://", ""), F.lit("/"))
    return F.lit(1) + sum(F.when(url.rlike(f"(?i){p}"), w).otherwise(0) for p, w in PAGE_VALUES) - F.greatest(depth - 2, F.lit(0))


def admitted(url: Column, site: Column) -> Column:
    """Same host, and neither a file nor a feed."""
    return (T.host(url) == site) & ~F.regexp_replace(url, r"[?#].*$", "").rlike(SKIPPED_ENDS)


def top_pages(pages: DataFrame, most: int = SITE_PAGES) -> DataFrame:
    """Adds site, value and rank: the pages of a site by value, then address."""
    rows = pages.withColumn("site", T.host(F.col("url"))).withColumn("value", page_value(F.col("url")))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy(F.col("value").desc(), "url", "page_id"))).where(F.col("rank") <= most)


def script_chars(html: Column) -> Column:
    blocks = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)(<script.*?</script>)"), F.lit(1))
    return F.aggregate(blocks, F.lit(0), lambda a, b: a + F.length(b))


def js_shell(html: Column, text_chars: Column) -> Column:
    """(shell, marker, ratio): a page that draws its text with scripts: hardly any text, and a marker or mostly script."""
    scripts, size = script_chars(html), F.length(html)
    ratio = F.when(size > 0, scripts / size).otherwise(0.0)
    marker = F.when(html.rlike(MOUNT) & (scripts > 0), "mount").when(html.rlike(BOOTSTRAP), "bootstrap").when((ratio > SHELL_RATIO) & (size > SHELL_LEAST), "mostly_script")
    marker = F.when(text_chars < SHELL_CHARS, marker)
    return F.struct(marker.isNotNull().alias("shell"), marker.alias("marker"), ratio.alias("ratio"))


def bot_challenge(status: Column, body: Column, text_chars: Column) -> Column:
    """A refusal: by status alone, or a served page with a challenge and little text."""
    strong = F.coalesce(F.substring(body, 1, 20_000).rlike(CHALLENGE), F.lit(False))
    return F.coalesce(status.isin(REFUSING), F.lit(False)) | (strong & (text_chars < CHALLENGE_CHARS) & F.coalesce(status.isin(SERVED), F.lit(False)))


def prose_signals(text: Column) -> Column:
    """(words, letter_ratio, replacement_ratio, word_length, is_prose)."""
    t = F.coalesce(text, F.lit(""))
    size = F.length(t)
    words = F.regexp_count(t, F.lit(r"[^ \t\r\n\f]+"))
    solid = F.length(F.regexp_replace(t, r"[ \t\r\n\f]+", ""))
    odd = F.length(F.regexp_replace(t, r"""[\p{L}\p{N} \t\r\n\f.,;:!?'"()/&%$£€–—-]+""", ""))
    replaced = F.length(F.regexp_replace(t, "[^�]+", ""))
    enough = (size > 0) & (words >= 20)
    of = lambda c: F.when(enough, c).otherwise(0.0)
    letters, lost, mean = of((size - odd) / size), of(replaced / size), of(solid / words)
    return F.struct(words.alias("words"), letters.alias("letter_ratio"), lost.alias("replacement_ratio"), mean.alias("word_length"), (enough & (letters >= 0.9) & (lost < 0.02) & mean.between(2, 14)).alias("is_prose"))


def furniture(paragraph: Column) -> Column:
    """No sentence end, and three fifths of the words begin with a capital or a digit."""
    words = F.filter(F.split(paragraph, r"[ \t\r\n\f]+"), lambda w: w != "")
    high = F.size(F.filter(words, lambda w: w.rlike("^[A-Z0-9]")))
    return ~paragraph.rlike("[.!?]") & (high >= F.size(words) * 0.6)


def paragraphs(pages: DataFrame, text: str) -> DataFrame:
    """(site, page_id, place, paragraph): kept paragraphs, each once a site, where it is first in the order of pages; only keys are sorted."""
    pieces = pages.select("site", "page_id", F.posexplode(F.split(F.col(text), r"\n+")).alias("place", "paragraph")).withColumn("paragraph", F.trim("paragraph"))
    kept = pieces.where((F.length("paragraph") > PARAGRAPH_CHARS) & ~furniture(F.col("paragraph"))).withColumn("_key", F.md5(F.substring(F.lower("paragraph"), 1, KEY_CHARS)))
    first = F.row_number().over(Window.partitionBy("site", "_key").orderBy("page_id", "place"))
    return kept.withColumn("_n", first).where("_n = 1").drop("_n", "_key")


def within_budget(kept: DataFrame, most: int = SITE_CHARS) -> DataFrame:
    """Paragraphs of a site until their characters reach the budget; a site may hold any share of them."""
    counted = running(kept, ["site"], [F.col("page_id"), F.col("place")], {"_with": F.length("paragraph")})
    return counted.where(F.col("_with") - F.length("paragraph") < most).drop("_with")


def site_summary(observations: DataFrame) -> DataFrame:
    """Per site of (site, role, status, text_chars, kept_chars, challenged, shell, prose, referents, identity)."""
    parsed = F.col("kept_chars") > PAGE_CHARS
    home = F.col("role") == "home"
    good = F.col("status").between(200, 299)
    return observations.groupBy("site").agg(
        F.count("*").alias("pages"),
        F.count(F.when(good, 1)).alias("fetched"),
        F.count(F.when(parsed, 1)).alias("parsed"),
        F.count(F.when(parsed & F.col("prose"), 1)).alias("prose"),
        F.count(F.when(F.col("status").isin(REFUSING), 1)).alias("refused"),
        F.sum("text_chars").alias("chars"),
        F.max(F.when(home, F.col("status"))).alias("home_status"),
        F.coalesce(F.bool_or(F.when(home, F.col("challenged"))), F.lit(False)).alias("home_challenged"),
        F.coalesce(F.bool_or(F.col("shell")), F.lit(False)).alias("shell"),
        F.sum("referents").alias("referents"),
    )


def crawl_outcome(summary: DataFrame, robots_disallow: Column, cleared: Column) -> DataFrame:
    """Adds outcome, the first rule that holds, and surviving referents: none unless it succeeded."""
    rule = (
        F.when(F.col("site").isNull() | (F.col("site") == ""), "fetch_failed")
        .when(robots_disallow, "blocked_robots")
        .when(F.col("home_status").isNull(), "fetch_failed")
        .when(F.col("home_challenged"), "blocked_bot")
        .when(~F.col("home_status").between(200, 299), "fetch_failed")
        .when((F.col("parsed") == 0) & F.col("shell"), "js_only")
        .when((F.col("parsed") == 0) & (F.col("fetched") == 0), "fetch_failed")
        .when(F.col("parsed") == 0, "extraction_failed")
        .when(F.col("prose") == 0, "extraction_failed")
        .when(~cleared, "identity_mismatch")
        .when(F.coalesce("referents", F.lit(0)) == 0, "nothing_relevant")
        .otherwise("succeeded")
    )
    return summary.withColumn("outcome", rule).withColumn("surviving", F.when(F.col("outcome") == "succeeded", F.col("referents")).otherwise(0))


def starved(report: Column, referents: Column, floor: int) -> Column:
    """Little evidence for a reason of the crawl's."""
    return report.isin("fetch_failed", "blocked_robots", "blocked_bot", "js_only", "extraction_failed") & (F.coalesce(referents, F.lit(0)) < floor)


def site_names(html: Column) -> Column:
    """What a page says its site is called: properties, then the parts of its title."""
    meta = F.regexp_extract_all(html, F.lit(r"""(?i)<meta[^>]+(?:property|name)=["'](?:og:site_name|application-name)["'][^>]+content=["']([^"']+)"""), F.lit(1))
    linked = F.regexp_extract_all(html, F.lit(r'(?i)"@type" *: *"(?:Organization|NGO)"[^}]*?"name" *: *"([^"]+)"'), F.lit(1))
    title = F.split(F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)", 1), r" [|–—-] ")
    return F.filter(F.array_distinct(F.transform(F.concat(meta, linked, title), lambda x: F.trim(x))), lambda x: x != "")


def distinctive_tokens(name: Column, generic: list[str]) -> Column:
    """Words of an organisation's name of more than two letters that others do not share."""
    return F.array_except(F.filter(T.name_tokens(name), lambda w: F.length(w) > 2), F.array(*map(F.lit, generic)))


def spelt_by(label: Column, tokens: Column) -> Column:
    """The label is all the different tokens written together, in some order: tokens are matched along it, and what is left of label and tokens is kept for every way so far."""
    start = F.array(F.struct(label.alias("rest"), tokens.alias("left")))
    grown = lambda s: F.transform(F.filter(s["left"], lambda t: F.startswith(s["rest"], t)), lambda t: F.struct(F.substr(s["rest"], F.length(t) + 1).alias("rest"), F.array_remove(s["left"], t).alias("left")))
    ways = F.aggregate(tokens, start, lambda ways, _: F.array_distinct(F.flatten(F.transform(ways, grown))))
    return F.exists(ways, lambda s: (s["rest"] == "") & (F.size(s["left"]) == 0))


def organisation_matches_site(org: Column, stated: Column, label: Column) -> Column:
    """org, stated: distinctive tokens, stated null where the site names none; label: the host's registered label, which may be the tokens written together in any order."""
    smaller = F.when(F.size(org) <= F.size(stated), org).otherwise(stated)
    larger = F.when(F.size(org) <= F.size(stated), stated).otherwise(org)
    both = F.coalesce((F.size(smaller) >= 2) & T.contained(smaller, larger), F.lit(False))
    single = (F.size(org) == 1) & (F.length(F.element_at(org, 1)) > 3) & (F.element_at(org, 1) == label)
    plain, joined = F.regexp_replace(label, "[^a-z0-9]", ""), F.array_join(org, "")
    whole = (F.size(org) > 1) & stated.isNull() & (F.length(joined) > 3) & (F.length(joined) == F.length(plain)) & F.coalesce(spelt_by(plain, org), F.lit(False))
    return F.when(F.size(org) == 0, False).otherwise(both | F.coalesce(single, F.lit(False)) | F.coalesce(whole, F.lit(False)))


def robots_rules(files: DataFrame) -> DataFrame:
    """(host, agent, allow, path) from (host, body); an agent line after rules begins a new group."""

    def read(body: str | None) -> list[tuple[str, bool, str]]:
        out, agents, ruled = [], [], False
        for raw in (body or "").splitlines():
            field, sep, value = raw.split("#", 1)[0].partition(":")
            field, value = field.strip().lower(), value.strip()
            if not sep:
                continue
            if field == "user-agent":
                agents = [] if ruled else agents
                ruled = False
                if value:
                    agents.append(value.lower())
            elif field in ("allow", "disallow"):
                ruled = True
                out += [(a, field == "allow", value) for a in agents]
        return out

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(h, *r) for h, b in zip(batch["host"], batch["body"], strict=True) for r in read(b)]
            yield pd.DataFrame(rows, columns=["host", "agent", "allow", "path"])

    return files.select("host", "body").mapInPandas(work, "host string, agent string, allow boolean, path string")


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """Adds allowed to (url, host, path): the longest matching rule of the most specific group decides, allow before disallow; none allows."""
    named = rules.where((F.col("agent") == "*") | F.contains(F.lit(agent.lower()), F.col("agent"))).withColumn("_own", F.when(F.col("agent") == "*", 0).otherwise(F.length("agent")))
    best = named.groupBy("host").agg(F.max("_own").alias("_own"))
    group = named.join(best, ["host", "_own"]).where("path <> ''")
    quoted = F.regexp_replace(F.col("rule_path"), r"([.+?^(){}|\[\]\\])", r"\\$1")
    pattern = F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*", ".*"))
    hits = urls.join(group.select("host", "allow", F.col("path").alias("rule_path")), "host").where(F.regexp_like(F.col("path"), pattern))
    order = Window.partitionBy("url").orderBy(F.length("rule_path").desc(), F.col("allow").desc())
    decided = hits.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("url", F.col("allow").alias("_allow"))
    return urls.join(decided, "url", "left").withColumn("allowed", F.coalesce("_allow", F.lit(True))).drop("_allow")


def watch_snapshot(html: Column) -> Column:
    """(title, text, content_hash, closed) of a watched page."""
    text = T.collapse(T.decode_named(T.strip_tags(html)))
    title = T.collapse(T.decode_named(F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)", 1)))
    return F.struct(title.alias("title"), text.alias("text"), F.sha2(text, 256).alias("content_hash"), text.rlike(r"(?i)\b(call|applications?) (is|are) (now )?closed\b").alias("closed"))


def table_rows(pages: DataFrame, id_col: str, html_col: str, cells: int) -> DataFrame:
    """(id, row, cells, sound): rows of listing tables; sound if a row has as many cells as expected."""
    row_re, cell_re, tag_re = re.compile(r"<tr[^>]*>(.*?)</tr>", re.I | re.S), re.compile(r"<td[^>]*>(.*?)</td>", re.I | re.S), re.compile(r"<[^>]+>")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, html in zip(batch[id_col], batch[html_col], strict=True):
                for k, row in enumerate(row_re.findall(html or "")):
                    found = [" ".join(tag_re.sub(" ", c).split()) for c in cell_re.findall(row)]
                    if found:
                        out.append((page, k, found, len(found) == cells))
            yield pd.DataFrame(out, columns=[id_col, "row", "cells", "sound"])

    return pages.select(id_col, html_col).mapInPandas(work, f"{id_col} {pages.schema[id_col].dataType.simpleString()}, row int, cells array<string>, sound boolean")


def labelled_fields(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, evidence): label and text of definition lists and of neighbouring cells; a label ends where its own element does."""
    within = lambda tag: rf"((?:(?!</{tag}>).)*)</{tag}>"
    pair_re = re.compile(rf"<dt[^>]*>{within('dt')}\s*<dd[^>]*>{within('dd')}|<t[hd][^>]*>{within('t[hd]')}\s*<td[^>]*>{within('td')}", re.I | re.S)
    tag_re = re.compile(r"<[^>]+>")
    clean = lambda x: " ".join(tag_re.sub(" ", x).split()).rstrip(":")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [[{"label": clean(a or c), "text": clean(b or d), "url": u} for a, b, c, d in pair_re.findall(h or "")] for u, h in zip(batch[url_col], batch[html_col], strict=True)]
            yield pd.DataFrame({id_col: batch[id_col], "evidence": found})

    return pages.select(id_col, url_col, html_col).mapInPandas(work, f"{id_col} {pages.schema[id_col].dataType.simpleString()}, evidence array<struct<label:string,text:string,url:string>>")
