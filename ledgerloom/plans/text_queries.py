"""Queries of page curation, text audits and shared wording over the driver's tables, with their SQL."""

from __future__ import annotations

import html
import html.entities

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as T
from ..functions.lineage import cut
from ..operators import dedupe, referents, textaudit, webcurate
from .bindings import pick, table, texts


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "pages")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents")


def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.decode_named(T.strip_tags(F.col("html")))
    return _pages(spark, sf_dir).select("page_id", F.length(text).alias("chars"), F.md5(text).alias("text_md5"))


def decoded_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", T.decode_entities(F.regexp_extract("html", r"(?is)<title[^>]*>([^<]*)", 1)).alias("title"))


def page_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", webcurate.watch_snapshot(F.col("html")).alias("s")).select("page_id", "s.title", "s.content_hash", "s.closed")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", F.array_join(F.array_sort(T.links(F.col("html"))), "|").alias("links"))


def absolute_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _pages(spark, sf_dir).select("page_id", "url", T.absolute_links(T.links(F.col("html")), F.col("url")).alias("links"))
    return found.select("page_id", F.explode("links").alias("link"), T.host(F.col("url")).alias("site")).withColumn("admitted", webcurate.admitted(F.col("link"), F.col("site")))


def page_title_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", F.array_join(webcurate.site_names(F.col("html")), "|").alias("names"))


def top_pages_per_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webcurate.top_pages(_pages(spark, sf_dir), 3).select("page_id", "site", "value", "rank")


def js_shell(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir).select("page_id", webcurate.js_shell(F.col("html"), F.length(T.strip_tags(F.col("html")))).alias("s"))
    return p.select("page_id", "s.shell", "s.marker", F.round("s.ratio", 9).alias("ratio"))


def bot_challenge(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = pick(F.col("page_id"), 200, 403, 200, 503, 404, 429)
    return _pages(spark, sf_dir).select("page_id", webcurate.bot_challenge(status, F.col("html"), F.length(T.strip_tags(F.col("html")))).alias("blocked"))


def prose_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _docs(spark, sf_dir).select("doc_id", webcurate.prose_signals(F.col("text")).alias("s"))
    return s.select("doc_id", F.col("s.words").cast("long").alias("words"), *[F.round(f"s.{c}", 9).alias(c) for c in ("letter_ratio", "replacement_ratio", "word_length")], "s.is_prose")


def paragraph_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select(F.col("source").alias("site"), F.col("doc_id").alias("page_id"), "text")
    return webcurate.paragraphs(d, "text").select("site", "page_id", "place", F.md5("paragraph").alias("paragraph_md5"))


def site_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select(F.col("source").alias("site"), F.col("doc_id").alias("page_id"), "text")
    return webcurate.within_budget(webcurate.paragraphs(d, "text")).groupBy("site").agg(F.count("*").alias("paragraphs"), F.sum(F.length("paragraph")).alias("chars"))


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.strip_tags(F.col("html"))
    p = _pages(spark, sf_dir).withColumn("site", F.regexp_extract("url", r"([a-z]+\.[a-z]+)(?:[:/?#]|$)", 1)).withColumn("text", text).withColumn("status", pick(F.col("page_id"), 200, 200, 404, 200, 403))
    size = F.length("text")
    return p.select(
        "site", F.when(F.col("page_id") % 7 == 0, "home").otherwise("inner").alias("role"), "status", size.alias("text_chars"), size.alias("kept_chars"), webcurate.bot_challenge(F.col("status"), F.col("html"), size).alias("challenged"),
        webcurate.js_shell(F.col("html"), size).shell.alias("shell"), (size > 2000).alias("prose"), F.regexp_count("text", F.lit(r"\b[A-Z][a-z]+ [A-Z][a-z]+")).alias("referents"),
    )


def site_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = webcurate.crawl_outcome(webcurate.site_summary(_observations(spark, sf_dir)), F.col("site").startswith("a"), ~F.col("site").endswith(".net"))
    return s.select("site", "pages", "fetched", "parsed", "refused", "outcome", "surviving")


def org_site_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the name that its own title begins with, and its host."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>([^<]*)", 1)
    org = webcurate.distinctive_tokens(F.substring_index(title, " ", 2), ["the", "and"])
    stated = webcurate.distinctive_tokens(title, ["the", "and"])
    label = T.main_label(T.host(F.col("url")))
    return _pages(spark, sf_dir).select("page_id", label.alias("label"), webcurate.organisation_matches_site(org, stated, label).alias("matches"))


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of every customer: a listing with a heading, a whole row and a short one, and a list of definitions."""
    c = F.col
    html = F.concat(
        F.lit("<p>Card</p><table><tr><th>Name</th></tr>\n<tr class='r'><td> <b>"), c("c_name"), F.lit("</b></td>\n<td>"), c("c_mktsegment"), F.lit("</td></tr><TR><td>short"), c("c_nationkey").cast("string"),
        F.lit("</td></TR></table><dl><dt>Nation:</dt>\n<dd>n <i>"), c("c_nationkey").cast("string"), F.lit("</i></dd></dl><table><tr><th>Segment</th><td>"), c("c_mktsegment"), F.lit("</td></tr></table>"),
    )
    return table(spark, sf_dir, "customer").select(c("c_custkey").alias("page_id"), F.lit("https://cards.example.org").alias("url"), html.alias("html"))


def labelled_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webcurate.table_rows(_cards(spark, sf_dir), "page_id", "html", 2).select("page_id", "row", F.array_join("cells", "|").alias("cells"), "sound")


def labelled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = webcurate.labelled_fields(_cards(spark, sf_dir), "page_id", "url", "html").select("page_id", F.explode("evidence").alias("e"))
    return found.select("page_id", "e.label", "e.text", "e.url")


def robots_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of each host, made of the addresses of its pages, and what they allow."""
    p = _pages(spark, sf_dir).select("url", T.host(F.col("url")).alias("host"), F.concat(F.lit("/"), F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1)).alias("path"))
    body = F.concat(F.lit("User-agent: *\nDisallow: "), F.min(F.regexp_extract("path", r"^(/[^/]*/?)", 1)), F.lit("\nAllow: "), F.min("path"), F.lit("\nDisallow: /*9$\n"))
    return webcurate.robots_allowed(p, webcurate.robots_rules(p.groupBy("host").agg(body.alias("body"))), "auditbot").select("url", "allowed")


def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.count_words(F.col("text")).alias("words"))


def document_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.document_hash(F.col("text")).alias("hash"))


def document_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _docs(spark, sf_dir).select("doc_id", F.explode(T.numbers(F.col("text"))).alias("x")).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("x").alias("largest"))
    return n


def document_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written out from each order, read again."""
    o = table(spark, sf_dir, "orders").withColumn("day", F.date_add("o_orderdate", 9500))
    of = lambda form: F.date_format("day", form)
    later = F.date_format(F.date_add("day", 99), "d MMMM yyyy")
    named = F.concat(F.lit("5:00pm on the "), of("d"), F.lit("th of "), of("MMMM"), F.lit(" "), of("yyyy"), F.lit(" (informed by "), later, F.lit(")"))
    american, plain = F.concat(F.lit("by "), of("MMMM d, yyyy"), F.lit(" or "), later), F.concat(F.lit("by "), of("MM/dd/yyyy"))
    return o.select("o_orderkey", *[dates.free_deadline(c).alias(n) for n, c in (("named", named), ("american", american), ("plain", plain))])


def normal_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.normal_title(F.substring_index("text", "\n", 1)).alias("title"), T.grant_title(F.substring_index("text", "\n", 1)).alias("grant_title"), T.has_date(F.col("text")).alias("dated"))


def proper_nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textaudit.proper_nouns(_docs(spark, sf_dir), "doc_id", "text")


def proper_noun_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the first of each source's documents are the source's ledger; the others are audited against it."""
    d = _docs(spark, sf_dir)
    firsts = d.groupBy("source").agg(F.min("doc_id").alias("doc_id"))
    named = textaudit.proper_nouns(d, "doc_id", "text").join(d.select("doc_id", "source"), "doc_id")
    runs = named.join(firsts.select("doc_id"), "doc_id", "left_anti").groupBy("source", "phrase").agg(*[F.bool_or(c).alias(c) for c in ("line_start", "sentence_start", "mid_sentence")])
    ledger = named.join(firsts.select("doc_id"), "doc_id", "left_semi").select("source", F.col("phrase").alias("name"))
    own = d.select("source", F.col("source").alias("name")).distinct()
    return textaudit.audit_names(runs, ledger, own, "source").groupBy("source", "verdict").agg(F.count("*").alias("names"))


def referent_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight in each document of the names that it uses inside sentences, which its evidence is taken to offer."""
    d = _docs(spark, sf_dir).select("doc_id", "text")
    names = cut(textaudit.proper_nouns(d, "doc_id", "text").where("mid_sentence").select("doc_id", F.col("phrase").alias("name"), F.length("phrase").alias("position")))  # read several times
    return referents.scores(referents.mentions(d, names, "doc_id", "text"), names, "doc_id")


def contact_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("source", "lang", "text")
    return textaudit.unsupported_contacts(textaudit.contacts(d.where("lang = 'en'"), "source", "text"), textaudit.contacts(d.where("lang <> 'en'"), "source", "text"), "source")


def email_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("source", "text")
    return textaudit.contacts(d, "source", "text").where("class = 'email'").select("source", "literal")


def numeric_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem")
    claims = i.select("l_orderkey", F.round("l_quantity").cast("long").alias("number"))
    design = i.groupBy("l_orderkey").agg(F.floor(F.avg("l_quantity")).cast("long").alias("total"))
    evidence = i.where("l_returnflag = 'R'").select("l_orderkey", F.round("l_quantity").cast("long").alias("number"))
    return textaudit.numeric_consistency(claims, design, evidence, "l_orderkey")


def month_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities as months that an order's lines look ahead, against its number of lines as the design's months times six."""
    i = table(spark, sf_dir, "lineitem")
    claims = i.select("l_orderkey", F.round("l_quantity").cast("long").alias("number"))
    design = i.groupBy("l_orderkey").agg((F.count("*") * 6).alias("months"))
    return textaudit.long_horizons(claims, design, i.where("l_returnflag = 'R'").select("l_orderkey", F.round("l_quantity").cast("long").alias("number")), "l_orderkey")


def register_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.round("l_extendedprice").alias("value"))
    return textaudit.sums_close(table(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice").alias("asserted")), parts, "o_orderkey", 0)


def register_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A register for each order, of one line or of many: its lines as leaves, and their sum as the order asserts it."""
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("register_id"), "l_partkey", "l_suppkey", F.round("l_extendedprice", 2).alias("v"))
    place = F.row_number().over(Window.partitionBy("register_id").orderBy("l_partkey", "l_suppkey", "v")) - 1
    no_names, no_value = F.array().cast("array<string>"), F.lit(None).cast("double")
    node = lambda name, kind, label, members, value, asserted, basis: [
        F.col("register_id"), name.alias("node_id"), F.lit(kind).alias("kind"), label.alias("label"), F.lit("USD").alias("unit"), F.lit("money").alias("unit_kind"), members.alias("members"), value.cast("double").alias("value"), asserted.cast("double").alias("asserted"), F.lit(basis).alias("basis")
    ]
    k = F.col("k").cast("string")
    leaves = i.withColumn("k", place).select(*node(F.concat(F.lit("L"), k), "leaf", F.concat(F.lit("line number "), k), no_names, F.col("v"), no_value, "order"))
    totals = i.groupBy("register_id").agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"))
    # too many nodes are told by their count, so their names are not needed
    members = F.when(F.col("n") <= textaudit.MOST_NODES, F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda x: F.concat(F.lit("L"), x.cast("string")))).otherwise(no_names)
    sums = totals.select(*node(F.lit("S1"), "sum", F.lit("sum of lines"), members, no_value, F.when(F.col("register_id") % 10 == 0, F.col("total") + 1).otherwise(F.col("total")), "arithmetic"))
    return textaudit.close_registers(leaves.unionByName(sums))


TOKENS = f"list_transform(list_filter(string_split({{}}, ' '), lambda w: w NOT IN {tuple(textaudit.LABEL_STOPS)}), lambda w: regexp_replace(w, 's$', ''))"
#: The label of an order's budget and the kind that its rates claim, by status and customer; sums and products are labelled alike for all.
BUDGET_LABEL = "CASE o_orderstatus WHEN 'F' THEN 'grant' WHEN 'O' THEN 'cost' ELSE 'line cost budget' END"
RATE_LABEL = "concat(CASE WHEN o_orderkey % 3 = 0 THEN 'share of the whole ' WHEN o_orderkey % 3 = 1 THEN 'share of the ' ELSE 'part of award ' END, budget_label)"


def register_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A register for each order: its lines, their sum, a budget, a product of the first line, and shares of the sum and of the budget."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_partkey", "l_suppkey", F.round("l_extendedprice", 2).alias("v"), F.round("l_quantity").alias("q")).alias("l"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("budget"), F.expr(BUDGET_LABEL).alias("budget_label")).withColumn("rate_label", F.expr(RATE_LABEL))
    o = lines.groupBy("o_orderkey").agg(F.sort_array(F.collect_list("l")).alias("l")).where(F.size("l") > 1).join(orders, "o_orderkey")  # the lines of an order
    o = o.withColumn("total", F.round(F.aggregate("l", F.lit(0.0), lambda s, x: s + x["v"]), 2)).withColumn("first", F.col("l")[0]["v"]).withColumn("q", F.col("l")[0]["q"])
    kind = F.when(F.col("o_custkey") % 7 == 0, "money").otherwise("ratio")
    text, number = (lambda v: v if not isinstance(v, str) else F.lit(v)), (lambda v: F.lit(None).cast("double") if v is None else v.cast("double"))

    def node(name, kind, label, unit, unit_kind, members=(), value=None, asserted=None):
        own = F.array(*map(F.lit, members)).cast("array<string>") if isinstance(members, tuple) else members
        return F.struct(
            text(name).alias("node_id"), F.lit(kind).alias("kind"), text(label).alias("label"), text(unit).alias("unit"), text(unit_kind).alias("unit_kind"), own.alias("members"),
            number(value).alias("value"), number(asserted).alias("asserted"), F.lit("order" if kind == "leaf" else "arithmetic").alias("basis"),
        )

    name = lambda k: F.concat(F.lit("L"), k.cast("string"))
    leaves = F.transform("l", lambda x, k: node(name(k), "leaf", F.concat(F.lit("line number "), k.cast("string")), "USD", "money", value=x["v"]))
    money = F.round(F.col("q") * F.col("first"), 2)
    unit = F.when(kind == "money", "USD").otherwise("share")
    rounded = lambda a, b: F.when(kind == "money", F.round(a / b, 2)).otherwise(F.round(a / b, 6))
    others = F.array(
        node("S1", "sum", "total line cost", "USD", "money", F.transform("l", lambda x, k: name(k)), asserted=F.col("total")), node("G1", "leaf", F.col("budget_label"), "USD", "money", value=F.col("budget")),
        node("Q1", "leaf", "units of the first line", "units", "count", value=F.col("q")), node("X1", "product", "value of the first line", "USD", "money", ("Q1", "L0"), asserted=money + F.when(F.col("o_orderkey") % 10 == 0, 1).otherwise(0)),
        node("R1", "rate", "share of total line cost for the first line", "share", "ratio", ("L0", "S1"), asserted=F.round(F.col("first") / F.col("total"), 6)),
        node("R2", "rate", F.col("rate_label"), unit, kind, ("X1", "G1"), asserted=rounded(money, F.col("budget"))),
        node("R3", "rate", F.concat(F.lit("lines "), F.col("rate_label")), "share", "ratio", ("L0", "G1"), asserted=F.round(F.col("first") / F.col("budget"), 6)),
    )
    nodes = o.select(F.col("o_orderkey").alias("register_id"), F.explode(F.concat(leaves, others)).alias("n")).select("register_id", "n.*")
    return textaudit.close_registers(nodes)


def donor_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    raw = F.concat_ws(" ", pick(n, "max", "up to", "at least", "no more than", "whichever is shorter:"), (F.col("n_chars") % 3000).cast("string"), pick(n + 1, "words", "pages", "characters", "words per section", "", "EUR"))
    out = _docs(spark, sf_dir).select("doc_id", textaudit.donor_limit(raw, "max_words").alias("l"))
    return out.select("doc_id", "l.outcome", "l.value", "l.reason")


def countable_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with headings put before their lines, counted under a limit on answers."""
    text = F.concat(F.lit("## Need\n"), F.col("text"), F.lit("\n## Budget table\n| item | cost |\n"), F.substring_index("text", "\n", 1))
    d = _docs(spark, sf_dir).select("doc_id", textaudit.countable_text(text, F.lit("answers"), F.array(F.lit("Need"))).alias("t"))
    return d.select("doc_id", T.count_words(F.col("t")).alias("words"))


def content_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.array_join(textaudit.content_violations(F.col("text"), F.lit(1000)), ",").alias("violations"))


JARGON_SAID = ["Transformative and transformative", "groundbreaking, holistically", "State-of-the-art catalysing change, leveraging synergies, empowering communities, a paradigm shift and cutting edge", "no such phrase", "fostering collaboration synergistic Synergistic"]
PROCESS_SAID = [
    "Submit the form online", "The closing date is May", "Explain the need", "Application must be received", "Read the guidance", "Never use ChatGPT", "Apply online", "A signed declaration", "Log in to begin", "Contact us before applying", "Due by 5 pm",
    "must explain how the portal serves refugees by the deadline of year two",
]
CURRENCY_SAID = ["costs £5", "10 euros and 5 EUR", "US$ 5, or Dollars", "5 Sterling, 5 euro", "free", "3 dollars"]


def _said(spark: SparkSession, sf_dir: str, said: list[str]) -> DataFrame:
    """Whole documents, each followed by one of the phrases."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), pick(F.col("doc_id"), *said)).alias("text"))


def jargon_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textaudit.jargon(_said(spark, sf_dir, JARGON_SAID), "doc_id", "text")


def currency_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir, CURRENCY_SAID).select("doc_id", textaudit.currency_vote(F.col("text"), pick(F.col("doc_id"), "https://a.org.uk/x", "https://a.de", "https://a.com/uk")).alias("currency"))


def process_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir, PROCESS_SAID).select("doc_id", textaudit.process_requirement(F.col("text")).alias("process"))


def evidence_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem")
    return textaudit.evidence_use(i, i.where("l_returnflag = 'A'"), "l_orderkey", "l_partkey")


#: Forms of up to so many characters in all are sent to all executors.
FEW_CHARS = 16_000_000


def _unasked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that their source's donor asks for: those of the source's first document, which is the form."""
    d = _docs(spark, sf_dir)
    first = table(spark, sf_dir, "documents").groupBy("source").agg(F.min(F.struct("doc_id", "text")).alias("_f"))
    forms = cut(first.select("source", dedupe.asked_lines(F.split("_f.text", "\n")).alias("_asked")))
    few = (forms.agg(F.sum(F.length(F.array_join("_asked", "")))).first()[0] or 0) <= FEW_CHARS  # else texts are moved to their forms
    return d.join(F.broadcast(forms) if few else forms, "source").select("doc_id", "source", dedupe.without_asked(F.col("text"), F.col("_asked")).alias("text"))


def shared_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.shared_run_flags(_unasked(spark, sf_dir), "doc_id", "source", "text")


def longest_shared_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.longest_shared_run(_unasked(spark, sf_dir), "doc_id", "source", "text")


def material_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against itself without its first line."""
    d = _docs(spark, sf_dir).select("doc_id", F.col("text").alias("old"), F.regexp_replace("text", r"^[^\n]*\n?", "").alias("new"))
    out = dedupe.material_change(d, "doc_id", "old", "new")
    return out.select("doc_id", F.round("changed", 9).alias("changed"), F.round("retention", 9).alias("retention"), "identical", "material")


def jaccard_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("block_id"), "text")
    found = dedupe.best_match(b, _docs(spark, sf_dir).select(F.col("doc_id").alias("source_id"), "text"))
    return found.select("block_id", "source_id", "how", F.round("score", 9).alias("score"))


def multiset_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return dedupe.multiset_overlap(b, _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), 8)


def own_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.own_figures(_docs(spark, sf_dir), "doc_id", "source", "text")


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return dedupe.close_pairs(v, "vec_id", "label", "embedding", 0.3).withColumn("cosine", F.round("cosine", 6))


def merge_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants, and each again as another portal has it: its vector bent towards its own rotation, its deadline some days off."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("version"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    bent = F.transform("vector", lambda x, k: x + (F.col("id") % 3 + 1) * 0.2 * F.get("vector", (k + 1) % F.size("vector")))
    other = v.withColumn("deadline", day(F.col("id") % 20 + F.col("id") % 11)).withColumn("vector", bent).withColumn("id", F.col("id") + 1_000_000)
    return dedupe.merge_candidates(v.withColumn("deadline", day(F.col("id") % 20)).unionByName(other)).withColumn("cosine", F.round("cosine", 6))


def drift_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedupe.drift_sample(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return d.select("label", "dim", F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"), "n")


QUERIES = {f.__name__: f for f in (
    strip_html, decoded_titles, page_snapshots, page_links, absolute_links, page_title_candidates, top_pages_per_site, js_shell, bot_challenge, prose_signals, paragraph_first_seen, site_budget, site_outcome, org_site_match, labelled_tables, labelled_fields, robots_access,
    word_count, document_hash, document_numbers, document_dates, normal_titles, proper_nouns, proper_noun_audit, referent_weight, contact_claims, email_claims, numeric_consistency, month_horizons, register_sums, register_closure, register_rates, donor_limit, countable_words, content_violations,
    jargon_repeats, currency_votes, process_requirements, evidence_use, shared_runs, longest_shared_run, material_change, jaccard_best_match, multiset_overlap, own_figures, cosine_pairs, merge_band, drift_sample,
)}


_UNASKED = r"""forms AS (SELECT source, list_filter(list_transform(string_split(arg_min(text, doc_id), chr(10)), lambda d: trim(regexp_replace(lower(d), '\s+', ' ', 'g'), ' ')), lambda d: length(d) > 12) AS lines FROM documents GROUP BY source),
plain AS (SELECT doc_id, d.source, lines, list_transform(string_split(text, chr(10)), lambda x: {'x': x, 'p': trim(regexp_replace(replace(regexp_replace(lower(x), '^#+\s*', ''), '*', ''), '\s+', ' ', 'g'), ' ')}) AS own FROM documents d JOIN forms f ON d.source = f.source),
unasked AS (SELECT doc_id, source, array_to_string(list_transform(list_filter(own, lambda y: y.p = '' OR len(list_filter(lines, lambda d: contains(y.p, d) OR contains(d, y.p))) = 0), lambda y: y.x), chr(10)) AS text FROM plain)"""


def _nest(name: str, steps: list[tuple[str, str]], inner: str) -> str:
    out = inner
    for pattern, to in steps:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return out


_STRIP = _nest("strip", [
    ("(?is)<script[^>]*>.*?</script>", " "), ("(?is)<style[^>]*>.*?</style>", " "), ("(?is)<noscript[^>]*>.*?</noscript>", " "), ("(?is)<(nav|footer|header|aside)[^>]*>.*?</(nav|footer|header|aside)>", " "), ("(?is)<!--.*?-->", " "),
    ("(?i)</?(p|div|section|article|h[1-6]|li|ul|ol|tr|table|br|blockquote)[^>]*>", "' || chr(10) || '"), ("<[^>]+>", " "), (r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "' || chr(10) || '"),
], "coalesce(html, '''')".replace("''''", "''"))
_STRIP = f"trim({_STRIP}, ' ')"


def _decode(inner: str) -> str:
    for a, b in T.ENTITIES:
        inner = f"replace({inner}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return f"replace(replace({inner}, '&#39;', ''''), '&amp;', '&')"


_HOST = r"regexp_replace(lower(regexp_extract(url, '(?i)^[a-z]+://([^/:?#]+)', 1)), '^www\.', '')"
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_SHINGLED = "list_transform(generate_series(1, len(w) - {n} + 1), lambda i: array_to_string(list_slice(w, i, i + {n} - 1), ' '))"
_VALUE = "1 + " + " + ".join(f"CASE WHEN regexp_matches(url, '(?i){p}') THEN {w} ELSE 0 END" for p, w in webcurate.PAGE_VALUES) + r" - greatest(len(regexp_extract_all(regexp_replace(url, '(?i)^https?://', ''), '/')) - 2, 0)"
_SCRIPTS = "coalesce(list_sum(list_transform(regexp_extract_all(html, '(?is)<script.*?</script>'), lambda x: length(x))), 0)"


#: The standard's character references, those without a semicolon too, as decoded titles have them: names, numbers that mean another character, and numbers that mean none.
HTML5 = dict(html.entities.html5)
CHARREFS, NO_CHARS = dict(html._invalid_charrefs), sorted(html._invalid_codepoints)
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def _listed(values) -> str:
    text = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) and v.isprintable() and v.isascii() else "concat(" + ", ".join(f"chr({ord(c)})" for c in v) + ")" if isinstance(v, str) else str(v)
    return "[" + ", ".join(map(text, values)) + "]"


_TITLE = "regexp_extract(html, '(?is)<title[^>]*>([^<]*)', 1)"


def _collapse(inner: str) -> str:
    return rf"trim(regexp_replace({inner}, '[ \t\r\n\f\x0B]+', ' ', 'g'), ' ')"


def _tokens(name: str) -> str:
    return rf"list_filter(list_distinct(string_split(regexp_replace(lower({name}), '[^a-z0-9]+', ' ', 'g'), ' ')), lambda x: length(x) > 2 AND x NOT IN ('the', 'and'))"


_KEPT = r"""p AS (SELECT source AS site, doc_id AS page_id, k - 1 AS place, trim(a[k], ' ') AS paragraph FROM (SELECT *, unnest(generate_series(1, len(a))) AS k FROM (SELECT source, doc_id, regexp_split_to_array(text, '\n+') AS a FROM documents))),
f AS (SELECT *, list_filter(regexp_split_to_array(paragraph, '[ \t\r\n\f]+'), lambda w: w <> '') AS w FROM p WHERE length(paragraph) > 40),
g AS (SELECT *, row_number() OVER (PARTITION BY site, md5(substring(lower(paragraph), 1, 120)) ORDER BY page_id, place) AS n FROM f WHERE regexp_matches(paragraph, '[.!?]') OR len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z0-9]'))) < len(w) * 0.6)"""


def _picked(said: list[str]) -> str:
    return "([" + ", ".join(f"'{x}'" for x in said) + f"])[doc_id % {len(said)} + 1]"


ORACLES = {
    "strip_html": f"WITH t AS (SELECT page_id, {_decode(_STRIP)} AS x FROM pages) SELECT page_id, CAST(length(x) AS INTEGER) AS chars, md5(x) AS text_md5 FROM t",
    "page_links": r"""SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '(?i)href *= *["'']([^"''#?]+)', 1))), '|') AS links FROM pages""",
    "top_pages_per_site": f"SELECT page_id, site, CAST(value AS INTEGER) AS value, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY value DESC, url, page_id) AS n FROM (SELECT page_id, url, {_HOST} AS site, {_VALUE} AS value FROM pages)) WHERE n <= 3",
    "js_shell": f"""WITH t AS (SELECT page_id, html, {_SCRIPTS} AS s, length(html) AS n, length({_STRIP}) AS c FROM pages), m AS (SELECT *, CASE WHEN c < 600 THEN CASE WHEN regexp_matches(html, '(?i)<div[^>]+id=["''](root|app|__next|__nuxt|___gatsby)["'']') AND s > 0 THEN 'mount'
  WHEN regexp_matches(html, '{webcurate.BOOTSTRAP}') THEN 'bootstrap' WHEN s / n > 0.4 AND n > 500 THEN 'mostly_script' END END AS marker FROM t) SELECT page_id, marker IS NOT NULL AS shell, marker, round(CASE WHEN n > 0 THEN s / n ELSE 0 END, 9) AS ratio FROM m""",
    "bot_challenge": f"""WITH t AS (SELECT page_id, html, (([200, 403, 200, 503, 404, 429])[page_id % 6 + 1]) AS status, length({_STRIP}) AS c FROM pages)
SELECT page_id, status IN (401, 403, 429) OR (regexp_matches(substring(html, 1, 20000), '{webcurate.CHALLENGE}') AND c < 3000 AND status IN (200, 202, 503)) AS blocked FROM t""",
    "prose_signals": r"""WITH t AS (SELECT doc_id, text, length(text) AS n, len(regexp_extract_all(text, '[^ \t\r\n\f]+')) AS words, length(regexp_replace(text, '[ \t\r\n\f]+', '', 'g')) AS solid, length(regexp_replace(text, '[\p{L}\p{N} \t\r\n\f.,;:!?''"()/&%$£€–—-]+', '', 'g')) AS odd, length(regexp_replace(text, '[^�]+', '', 'g')) AS lost FROM documents),
r AS (SELECT doc_id, words, CASE WHEN words >= 20 THEN (n - odd) / n ELSE 0 END AS l, CASE WHEN words >= 20 THEN lost / n ELSE 0 END AS x, CASE WHEN words >= 20 THEN solid / words ELSE 0 END AS m FROM t)
SELECT doc_id, words, round(l, 9) AS letter_ratio, round(x, 9) AS replacement_ratio, round(m, 9) AS word_length, words >= 20 AND l >= 0.9 AND x < 0.02 AND m BETWEEN 2 AND 14 AS is_prose FROM r""",
    "paragraph_first_seen": f"WITH {_KEPT} SELECT site, page_id, CAST(place AS INTEGER) AS place, md5(paragraph) AS paragraph_md5 FROM g WHERE n = 1",
    "site_budget": f"""WITH {_KEPT}, b AS (SELECT site, length(paragraph) AS c, coalesce(sum(length(paragraph)) OVER (PARTITION BY site ORDER BY page_id, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g WHERE n = 1)
SELECT site, count(*) AS paragraphs, CAST(sum(c) AS BIGINT) AS chars FROM b WHERE before < 60000 GROUP BY 1""",
    "site_outcome": rf"""WITH t AS (SELECT page_id, html, regexp_extract(url, '([a-z]+\.[a-z]+)(?:[:/?#]|$)', 1) AS site, ([200, 200, 404, 200, 403])[page_id % 5 + 1] AS status, {_STRIP} AS x, {_SCRIPTS} AS s FROM pages),
o AS (SELECT *, page_id % 7 = 0 AS home, length(x) AS c, status IN (401, 403, 429) OR (regexp_matches(substring(html, 1, 20000), '(?i)(h|re)?captcha|are you a robot|verify you are human|just a moment\.\.\.|checking your browser') AND length(x) < 3000 AND status IN (200, 202, 503)) AS challenged,
  length(x) < 600 AND ((regexp_matches(html, '(?i)<div[^>]+id=["''](root|app|__next|__nuxt|___gatsby)["'']') AND s > 0) OR regexp_matches(html, '{webcurate.BOOTSTRAP}') OR (s / length(html) > 0.4 AND length(html) > 500)) AS shell, len(regexp_extract_all(x, '\b[A-Z][a-z]+ [A-Z][a-z]+')) AS referents FROM t),
a AS (SELECT site, count(*) AS pages, count(*) FILTER (status BETWEEN 200 AND 299) AS fetched, count(*) FILTER (c > 120) AS parsed, count(*) FILTER (c > 2000) AS prose, count(*) FILTER (status IN (401, 403, 429)) AS refused, max(status) FILTER (home) AS h, coalesce(bool_or(challenged) FILTER (home), false) AS hc, bool_or(shell) AS shell, sum(referents) AS r FROM o GROUP BY 1),
d AS (SELECT *, CASE WHEN site = '' THEN 'fetch_failed' WHEN site LIKE 'a%' THEN 'blocked_robots' WHEN h IS NULL THEN 'fetch_failed' WHEN hc THEN 'blocked_bot' WHEN h NOT BETWEEN 200 AND 299 THEN 'fetch_failed' WHEN parsed = 0 AND shell THEN 'js_only' WHEN parsed = 0 AND fetched = 0 THEN 'fetch_failed'
  WHEN parsed = 0 OR prose = 0 THEN 'extraction_failed' WHEN site LIKE '%.net' THEN 'identity_mismatch' WHEN r = 0 THEN 'nothing_relevant' ELSE 'succeeded' END AS outcome FROM a)
SELECT site, pages, fetched, parsed, refused, outcome, CAST(CASE WHEN outcome = 'succeeded' THEN r ELSE 0 END AS BIGINT) AS surviving FROM d""",
    "org_site_match": rf"""WITH t AS (SELECT page_id, string_split({_HOST}, '.') AS l, {_tokens(f"array_to_string(list_slice(string_split({_TITLE}, ' '), 1, 2), ' ')")} AS org, {_tokens(_TITLE)} AS stated FROM pages),
g AS (SELECT page_id, list_filter(org, lambda x: x NOT IN ('of', 'the', 'de', 'la', 'le', 'du', 'el', 'al')) AS org, list_filter(stated, lambda x: x NOT IN ('of', 'the', 'de', 'la', 'le', 'du', 'el', 'al')) AS stated,
  CASE WHEN len(l) < 2 THEN l[1] WHEN len(l) > 2 AND l[-2] IN ('co', 'org', 'com', 'net', 'ac', 'gov', 'edu', 'ngo', 'or', 'ne') AND length(l[-1]) = 2 THEN l[-3] ELSE l[-2] END AS label FROM t)
SELECT page_id, label, CASE WHEN len(org) = 0 THEN false WHEN len(org) <= len(stated) AND len(org) >= 2 AND list_has_all(stated, org) THEN true WHEN len(org) > len(stated) AND len(stated) >= 2 AND list_has_all(org, stated) THEN true ELSE len(org) = 1 AND length(org[1]) > 3 AND org[1] = label END AS matches FROM g""",
    "decoded_titles": rf"""WITH refs AS (SELECT {_listed(HTML5)} AS names, {_listed(HTML5.values())} AS chars, {_listed(CHARREFS)} AS odd, {_listed(CHARREFS.values())} AS meant, {_listed(NO_CHARS)} AS gone),
t AS (SELECT page_id, {_TITLE} AS t FROM pages), p AS (SELECT page_id, string_split_regex(t, '{_REFERENCE}') AS parts, list_transform(regexp_extract_all(t, '{_REFERENCE}'), lambda x: x[2:]) AS said FROM t),
r AS (SELECT page_id, parts, names, chars, odd, meant, gone, list_transform(said, lambda s: {{'s': s, 'n': CASE WHEN s[1:2] IN ('#x', '#X') THEN coalesce(TRY_CAST('0x' || rtrim(s[3:], ';') AS BIGINT), 1114112) WHEN s[1] = '#' THEN coalesce(TRY_CAST(rtrim(s[2:], ';') AS BIGINT), 1114112) END,
  'k': coalesce(list_filter(range(length(s), 1, -1), lambda k: list_contains(names, s[:k]))[1], 0)}}) AS said FROM p, refs),
d AS (SELECT page_id, parts, list_transform(said, lambda y: CASE WHEN y.n IS NULL THEN CASE WHEN y.k = 0 THEN '&' || y.s ELSE chars[list_position(names, y.s[:y.k])] || y.s[y.k + 1:] END
  WHEN list_contains(odd, y.n) THEN meant[list_position(odd, y.n)] WHEN y.n BETWEEN 55296 AND 57343 OR y.n > 1114111 THEN chr(65533) WHEN list_contains(gone, y.n) THEN '' ELSE chr(CAST(y.n AS INTEGER)) END) AS said FROM r)
SELECT page_id, array_to_string(list_transform(parts, lambda x, i: x || coalesce(said[i], '')), '') AS title FROM d""",
    "page_snapshots": rf"""WITH t AS (SELECT page_id, {_collapse(_decode(_TITLE))} AS title, {_collapse(_decode(_STRIP))} AS x FROM pages) SELECT page_id, title, sha256(x) AS content_hash, regexp_matches(x, '(?i)\b(call|applications?) (is|are) (now )?closed\b') AS closed FROM t""",
    "page_title_candidates": rf"""WITH t AS (SELECT page_id, list_transform(list_concat(list_concat(regexp_extract_all(html, '(?i)<meta[^>]+(?:property|name)=["''](?:og:site_name|application-name)["''][^>]+content=["'']([^"'']+)', 1),
  regexp_extract_all(html, '(?i)"@type" *: *"(?:Organization|NGO)"[^}}]*?"name" *: *"([^"]+)"', 1)), regexp_split_to_array({_TITLE}, ' [|–—-] ')), lambda x: trim(x, ' ')) AS l FROM pages) SELECT page_id, array_to_string(list_filter(l, lambda x, i: x <> '' AND list_position(l, x) = i), '|') AS names FROM t""",
    "absolute_links": rf"""WITH t AS (SELECT DISTINCT page_id, {_HOST} AS site, rtrim(regexp_extract(url, '^[a-z]+://[^/?#]+') || unnest(regexp_extract_all(html, '(?i)href *= *["''](/[^"''#?]*)', 1)), '/') AS link FROM pages)
SELECT page_id, link, site, regexp_replace(lower(regexp_extract(link, '(?i)^[a-z]+://([^/:?#]+)', 1)), '^www\.', '') = site AND NOT regexp_matches(link, '(?i)\.(pdf|jpe?g|png|gif|svg|webp|zip|docx?|xlsx?|pptx?|mp3|mp4|xml|rss|json|css|js|ico)$|/(feed|rss)/?$') AS admitted FROM t""",
    "labelled_tables": "SELECT c_custkey AS page_id, 1 AS row, c_name || '|' || c_mktsegment AS cells, true AS sound FROM customer UNION ALL SELECT c_custkey, 2, 'short' || c_nationkey, false FROM customer UNION ALL SELECT c_custkey, 3, c_mktsegment, false FROM customer",
    "labelled_fields": "SELECT c_custkey AS page_id, 'Nation' AS label, 'n ' || c_nationkey AS text, 'https://cards.example.org' AS url FROM customer UNION ALL SELECT c_custkey, 'Segment', c_mktsegment, 'https://cards.example.org' FROM customer UNION ALL SELECT c_custkey, c_name, c_mktsegment, 'https://cards.example.org' FROM customer",
    "robots_access": rf"""WITH p AS (SELECT url, {_HOST} AS host, '/' || regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS path FROM pages), b AS (SELECT host, min(regexp_extract(path, '^(/[^/]*/?)', 1)) AS d, min(path) AS a FROM p GROUP BY 1),
l AS (SELECT url, CASE WHEN starts_with(path, d) THEN length(d) ELSE 0 END AS ld, CASE WHEN starts_with(path, a) THEN length(a) ELSE 0 END AS la, CASE WHEN regexp_matches(path, '^/.*9$') THEN 4 ELSE 0 END AS l9 FROM p JOIN b USING (host)) SELECT url, la >= greatest(ld, l9) AS allowed FROM l""",
    "longest_shared_run": f"""WITH {_UNASKED}, d AS (SELECT doc_id, source, {_WORDS} AS w FROM unasked), s AS (SELECT doc_id, source, unnest({_SHINGLED.format(n=26)}) AS s, unnest(generate_series(1, len(w) - 25)) AS i FROM d WHERE len(w) >= 26),
m AS (SELECT a.doc_id AS id, b.doc_id AS other, a.i, a.i - b.i AS shift FROM s a JOIN s b ON a.source = b.source AND a.s = b.s AND a.doc_id <> b.doc_id), r AS (SELECT *, i - row_number() OVER (PARTITION BY id, other, shift ORDER BY i) AS island FROM m),
n AS (SELECT id, other, count(*) + 25 AS run FROM r GROUP BY id, other, shift, island), k AS (SELECT *, max(run) OVER (PARTITION BY id) AS longest FROM n)
SELECT id AS doc_id, min(other) AS worst_partner, CAST(any_value(longest) AS INTEGER) AS longest_run, true AS holds FROM k WHERE run = longest GROUP BY 1""",
    "word_count": r"SELECT doc_id, CAST(len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(text, '[​‌‍﻿]', '', 'g'), '\|', ' ', 'g'), '([぀-ヿ㐀-䶿一-鿿])', ' \1 ', 'g'), '[^ \t\r\n\f]+')) AS BIGINT) AS words FROM documents",
    "document_hash": r"SELECT doc_id, 'v1:' || sha256(trim(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ')) AS hash FROM documents",
    "document_numbers": r"""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9][0-9,]*(?:\.[0-9]+)?%?')) AS s FROM documents), v AS (SELECT doc_id, CAST(regexp_replace(s, '[,%]', '', 'g') AS DOUBLE) / CASE WHEN s LIKE '%\%' ESCAPE '\' THEN 100 ELSE 1 END AS x FROM x) SELECT doc_id, count(*) AS n, max(x) AS largest FROM v GROUP BY 1""",
    "document_dates": "SELECT o_orderkey, d AS named, d + 99 AS american, CAST(try_strptime(strftime(d, '%m/%d/%Y'), '%d/%m/%Y') AS DATE) AS plain FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) + 9500 AS d FROM orders)",
    "normal_titles": r"SELECT doc_id, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+', ' ', 'g'), ' ') AS title, trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9 ]', '', 'g'), ' ') AS grant_title, regexp_matches(text, '(?i)\b(19|20)[0-9][0-9]\b|\b(january|february|march|april|may|june|july|august|september|october|november|december|spring|summer|autumn|winter)\b') AS dated FROM documents",
    "email_claims": r"SELECT DISTINCT source, lower(unnest(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b'))) AS literal FROM documents",
    "numeric_consistency": """WITH d AS (SELECT l_orderkey, floor(avg(l_quantity)) AS total FROM lineitem GROUP BY 1), c AS (SELECT DISTINCT l_orderkey, CAST(round(l_quantity) AS BIGINT) AS number FROM lineitem), e AS (SELECT DISTINCT l_orderkey, CAST(round(l_quantity) AS BIGINT) AS number FROM lineitem WHERE l_returnflag = 'R')
SELECT * FROM (SELECT c.l_orderkey, c.number, CASE WHEN c.number > d.total + d.total * 0.01::DOUBLE THEN 'above_total' WHEN c.number >= d.total * 0.5 AND c.number < d.total - d.total * 0.01::DOUBLE THEN 'understated' END AS finding FROM c JOIN d USING (l_orderkey) WHERE d.total > 0 AND (c.l_orderkey, c.number) NOT IN (SELECT (l_orderkey, number) FROM e)) WHERE finding IS NOT NULL""",
    "month_horizons": """WITH d AS (SELECT l_orderkey, count(*) * 6 AS months FROM lineitem GROUP BY 1), c AS (SELECT DISTINCT l_orderkey, CAST(round(l_quantity) AS BIGINT) AS number FROM lineitem), e AS (SELECT l_orderkey, CAST(round(l_quantity) AS BIGINT) AS number FROM lineitem WHERE l_returnflag = 'R')
SELECT l_orderkey, number FROM c JOIN d USING (l_orderkey) WHERE number > months AND number <= 60 AND (l_orderkey, number) NOT IN (SELECT (l_orderkey, number) FROM e)""",
    "register_sums": """WITH p AS (SELECT l_orderkey, sum(round(l_extendedprice)) AS computed, count(*) AS parts FROM lineitem GROUP BY 1) SELECT o_orderkey, round(o_totalprice) AS asserted, round(computed) AS computed, parts, CASE WHEN computed IS NULL THEN 'dangling' WHEN abs(computed - round(o_totalprice)) < 0.5 THEN 'closed' ELSE 'does_not_close' END AS verdict FROM orders LEFT JOIN p ON o_orderkey = l_orderkey""",
    "register_closure": """WITH l AS (SELECT l_orderkey AS r, round(l_extendedprice, 2) AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, round(l_extendedprice, 2)) - 1 AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT r AS register_id, 'L' || k AS node_id, CASE WHEN n < 200 THEN v END AS computed, CASE WHEN n >= 200 THEN 'too_many_nodes' END AS fault FROM l
UNION ALL SELECT r, 'S1', CASE WHEN count(*) BETWEEN 2 AND 199 THEN sum(v) END, CASE WHEN count(*) >= 200 THEN 'too_many_nodes' WHEN count(*) < 2 THEN 'bad_arity' WHEN r % 10 = 0 THEN 'does_not_close' END FROM l GROUP BY r""",
    "register_rates": f"""WITH RECURSIVE l AS (SELECT l_orderkey AS r, round(l_extendedprice, 2) AS v, round(l_quantity) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, round(l_extendedprice, 2), round(l_quantity)) - 1 AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
o AS (SELECT o_orderkey AS r, o_orderkey, o_custkey, round(o_totalprice, 2) AS budget, {BUDGET_LABEL} AS budget_label FROM orders),
a AS (SELECT o.*, {RATE_LABEL} AS rate_label, CASE WHEN o_custkey % 7 = 0 THEN 'money' ELSE 'ratio' END AS rate_kind, CASE WHEN o_custkey % 7 = 0 THEN 2 ELSE 6 END AS places,
  f.v AS first, f.q, (SELECT round(sum(v), 2) FROM l WHERE l.r = o.r) AS total, round(f.q * f.v, 2) AS product FROM o JOIN l f ON f.r = o.r AND f.k = 0 AND f.n > 1),
nodes AS (SELECT r, 'L' || k AS id, 'leaf' AS kind, 'line number ' || k AS label, 'USD' AS unit, 'money' AS unit_kind, v AS value, NULL::DOUBLE AS asserted FROM l WHERE n > 1
  UNION ALL SELECT r, 'S1', 'sum', 'total line cost', 'USD', 'money', total, total FROM a UNION ALL SELECT r, 'G1', 'leaf', budget_label, 'USD', 'money', budget, NULL FROM a
  UNION ALL SELECT r, 'Q1', 'leaf', 'units of the first line', 'units', 'count', q, NULL FROM a
  UNION ALL SELECT r, 'X1', 'product', 'value of the first line', 'USD', 'money', product, product + CASE WHEN r % 10 = 0 THEN 1 ELSE 0 END FROM a
  UNION ALL SELECT r, 'R1', 'rate', 'share of total line cost for the first line', 'share', 'ratio', round(first / total, 6), NULL FROM a
  UNION ALL SELECT r, 'R2', 'rate', rate_label, CASE rate_kind WHEN 'money' THEN 'USD' ELSE 'share' END, rate_kind, CASE WHEN places = 2 THEN round(product / budget, 2) ELSE round(product / budget, 6) END, NULL FROM a
  UNION ALL SELECT r, 'R3', 'rate', 'lines ' || rate_label, 'share', 'ratio', round(first / budget, 6), NULL FROM a),
edges AS (SELECT r, 'S1' AS id, 'L' || k AS member, k AS nth FROM l WHERE n > 1 UNION ALL SELECT r, unnest(['X1', 'X1', 'R1', 'R1', 'R2', 'R2', 'R3', 'R3']), unnest(['Q1', 'L0', 'L0', 'S1', 'X1', 'G1', 'L0', 'G1']), unnest([0, 1, 0, 1, 0, 1, 0, 1]) FROM a),
c AS (SELECT r, id AS top, id AS node FROM nodes UNION SELECT c.r, c.top, edges.member FROM c JOIN edges ON edges.r = c.r AND edges.id = c.node),
leaves AS (SELECT c.r, c.top, list_sort(list(node)) AS below FROM c JOIN nodes n ON n.r = c.r AND n.id = c.node AND n.kind = 'leaf' GROUP BY 1, 2),
rates AS (SELECT m.r, m.id, m.unit_kind, ' ' || m.label || ' ' AS said, d.id AS den, d.label AS den_label, d.value AS den_value, d.unit_kind AS den_kind, d.unit AS den_unit, x.below AS part, y.below AS over
  FROM nodes m JOIN edges e ON e.r = m.r AND e.id = m.id AND e.nth = 0 JOIN edges g ON g.r = m.r AND g.id = m.id AND g.nth = 1 JOIN nodes d ON d.r = m.r AND d.id = g.member JOIN leaves x ON x.r = m.r AND x.top = e.member JOIN leaves y ON y.r = m.r AND y.top = g.member WHERE m.kind = 'rate'),
judged AS (SELECT r, id, CASE WHEN unit_kind NOT IN ('ratio', 'rate') THEN 'rate_unit_kind'
  WHEN NOT regexp_matches(said, '^(.* ({"|".join(textaudit.CONNECTIVES)}))? ' || den_label || '( ({"|".join(textaudit.CONNECTIVES)}) .*| )$') OR regexp_matches(said, ' ({"|".join(textaudit.SCOPES)})( ({"|".join(textaudit.CONNECTIVES)}))+ ' || den_label || ' ') OR regexp_matches(said, ' ' || den_label || ' (({"|".join(textaudit.CONNECTIVES)}) )+({"|".join(textaudit.SCOPES)}) ') THEN 'rate_denominator_label'
  WHEN EXISTS (SELECT 1 FROM nodes s JOIN leaves t ON t.r = s.r AND t.top = s.id WHERE s.r = rates.r AND s.kind = 'sum' AND s.id NOT IN (rates.den, rates.id) AND s.unit = den_unit AND s.unit_kind = den_kind AND len(t.below) > len(part) AND list_has_all(t.below, part) AND s.value <> den_value AND NOT (list_has_all(t.below, over) AND NOT list_has_any(part, over))) THEN 'rate_denominator_not_whole'
  WHEN EXISTS (SELECT 1 FROM nodes t WHERE t.r = rates.r AND t.id <> den AND t.unit_kind = den_kind AND t.value <> den_value AND t.kind <> 'rate' AND list_has_all(tokens(t.label), tokens(den_label)) AND len(tokens(t.label)) > len(tokens(den_label))) THEN 'rate_denominator_ambiguous' END AS fault FROM rates)
SELECT n.r AS register_id, n.id AS node_id, CASE WHEN n.id = 'R2' AND r % 10 = 0 THEN NULL ELSE n.value END AS computed,
  CASE WHEN n.id = 'R2' AND r % 10 = 0 THEN 'faulty_member' WHEN n.id = 'X1' AND r % 10 = 0 THEN 'does_not_close' ELSE j.fault END AS fault FROM nodes n LEFT JOIN judged j USING (r, id)""".replace("tokens(t.label)", TOKENS.format("t.label")).replace("tokens(den_label)", TOKENS.format("den_label")),
    "donor_limit": """WITH r AS (SELECT doc_id, n_chars % 3000 AS v, doc_id % 5 AS a, (doc_id + 1) % 6 AS u FROM documents), x AS (SELECT *, CASE WHEN a = 4 THEN 'dual_limit' WHEN a = 2 THEN 'minimum_not_maximum' WHEN u = 2 THEN 'wrong_unit' WHEN u = 5 THEN 'currency' WHEN u = 3 THEN 'distributive_limit' WHEN u = 1 THEN 'unit_is_pages' WHEN v NOT BETWEEN 25 AND 100000 THEN 'out_of_range' END AS reason FROM r)
SELECT doc_id, CASE WHEN reason IS NULL THEN 'limit' ELSE 'refused' END AS outcome, CASE WHEN reason IS NULL THEN v END AS value, reason FROM x""",
    "content_violations": r"""SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '[─-╿■-◿]') THEN 'box_characters' END, CASE WHEN regexp_matches(text, '(?m)^ {0,3}```') THEN 'code_fence' END, CASE WHEN regexp_matches(text, '(?m)^ {0,3}(-{3,}|\*{3,}|_{3,}) *$') THEN 'horizontal_rule' END,
  CASE WHEN len(regexp_extract_all(text, '\*\*')) % 2 = 1 THEN 'unbalanced_bold' END, CASE WHEN regexp_matches(text, '(?i)\[(insert|tbd|todo|name|date|amount)[^\]]*\]|\bTBD\b|\blorem ipsum\b|X{3,}') THEN 'placeholder' END, CASE WHEN regexp_matches(text, '\b(ord|prop)_[a-z0-9]{8,}\b') THEN 'order_id' END,
  CASE WHEN regexp_matches(text, '[\x{1F300}-\x{1FAFF}]') THEN 'emoji' END, CASE WHEN regexp_matches(text, '(?m)^#{1,6} [^\n]+\n\s*(#{1,6} |\z)') THEN 'empty_section' END, CASE WHEN trim(text, ' ') <> '' AND NOT regexp_matches(trim(text, ' '), '[.!?:;)\]"''”’|*_]$') THEN 'mid_sentence_end' END,
  CASE WHEN len(regexp_extract_all(replace(text, '|', ' '), '[^ \t\r\n\f]+')) > 1000 THEN 'over_limit' END) AS violations FROM documents""",
    "jargon_repeats": r"""WITH p AS (SELECT doc_id, lower(unnest(regexp_extract_all(coalesce(text, '') || ' ' || SAID, '(?i)\b(?:transformative|groundbreaking|holistic(?:ally)?|robust framework|catalys(?:e|t|ing|ze)\w* change|leverag\w+ synerg\w+|empower(?:ing|s)? communities|foster(?:ing)? collaboration|sustainable ecosystem|multifaceted approach|paradigm shift|cutting[- ]edge|state[- ]of[- ]the[- ]art|synergist\w+)\b'))) AS p FROM documents), e AS (SELECT doc_id, p, count(*) AS n FROM p GROUP BY 1, 2)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (n >= 2) AS repeated, count(*) FILTER (n >= 2) > 0 OR sum(n) >= 5 AS finding FROM e GROUP BY 1""".replace("SAID", _picked(JARGON_SAID)),
    "currency_votes": r"""WITH t AS (SELECT doc_id, coalesce(text, '') || ' ' || SAID || ' ' || (['https://a.org.uk/x', 'https://a.de', 'https://a.com/uk'])[doc_id % 3 + 1] AS x FROM documents), v AS (SELECT doc_id, len(regexp_extract_all(x, '(?i)£|\bGBP\b|\bpounds?\b|\bsterling\b')) + CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS g, len(regexp_extract_all(x, '(?i)€|\bEUR\b|\beuros?\b')) AS e, len(regexp_extract_all(x, '\bUSD\b|\bUS\$|\bdollars?\b')) AS u FROM t)
SELECT doc_id, CASE WHEN greatest(g, e, u) = 0 THEN 'USD' WHEN g = greatest(g, e, u) THEN 'GBP' WHEN e = greatest(g, e, u) THEN 'EUR' ELSE 'USD' END AS currency FROM v""".replace("SAID", _picked(CURRENCY_SAID)),
    "process_requirements": r"""SELECT doc_id, regexp_matches(lower(coalesce(text, '') || ' ' || SAID), '\bsubmit(ted|ting|ssion)?\b.*\b(application|form|proposal|portal|online|by \d|deadline|before)\b|\bapplication\b.*\bdeadline\b|\bclosing date\b|\bapplication (must |should )?(be )?(submitted|received|in|complete)\b|(submit|received|due|apply|application).{0,30}\bby \d{1,2}(:\d{2})?\s*(am|pm)\b|(submit|received|due|apply|application).{0,40}\bby \d{1,2}(st|nd|rd|th)?\s+\w+\s+\d{4}\b|read (the |through )?(the )?guidance|guidance (document|notes)\b|\b(do not|don''t|never) (rely on|use|depend on)\b.*\b(ai|artificial intelligence|chatgpt|language model)\b|\bcomplete (the|your) (online )?(form|application|portal)\b|\bapply (online|through the portal)\b|\bsign(ed)?\b.*\bdeclaration\b|\bdeclaration\b.*\bsign|\bcreate an account\b|\bregister (on|for) the portal\b|\blog ?in to\b|\bcontact (us|the team|the foundation)\b.*\bbefore\b') AS process FROM documents""".replace("SAID", _picked(PROCESS_SAID)),
    "evidence_use": "WITH o AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS offered, count(DISTINCT l_partkey) FILTER (l_returnflag = 'A') AS used FROM lineitem GROUP BY 1) SELECT l_orderkey, offered, used, offered >= 3 AND used * 2 < offered AS finding FROM o",
    "shared_runs": f"""WITH {_UNASKED}, d AS (SELECT doc_id, source, {_WORDS} AS w FROM unasked), s AS (SELECT DISTINCT doc_id, source, unnest({_SHINGLED.format(n=26)}) AS s FROM d WHERE len(w) >= 26), c AS (SELECT source, s, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) > 1)
SELECT doc_id, max(n) - 1 AS partners FROM s JOIN c USING (source, s) GROUP BY 1""",
    "material_change": rf"""WITH d AS (SELECT doc_id, text, regexp_replace(text, '^[^\n]*\n?', '') AS new FROM documents), v AS (SELECT doc_id, 'o' AS side, {_WORDS} AS w FROM d UNION ALL SELECT doc_id, 'n', regexp_extract_all(lower(new), '[\p{{L}}\p{{N}}]+') FROM d),
s AS (SELECT doc_id, side, 5 AS k, unnest({_SHINGLED.format(n=5)}) AS s FROM v WHERE len(w) >= 5 UNION ALL SELECT doc_id, side, 1, unnest(w) FROM v), c AS (SELECT doc_id, k, s, count(*) FILTER (side = 'o') AS o, count(*) FILTER (side = 'n') AS n FROM s GROUP BY 1, 2, 3),
t AS (SELECT doc_id, sum(o) FILTER (k = 5) AS o5, sum(n) FILTER (k = 5) AS n5, sum(least(o, n)) FILTER (k = 5) AS b5, sum(o) FILTER (k = 1) AS o1, sum(least(o, n)) FILTER (k = 1) AS b1 FROM c GROUP BY 1),
r AS (SELECT d.doc_id, d.text = d.new AS identical, greatest(CASE WHEN coalesce(o5, 0) > 0 THEN 1 - coalesce(b5, 0) / o5 ELSE 0 END, CASE WHEN coalesce(n5, 0) > 0 THEN 1 - coalesce(b5, 0) / n5 ELSE 0 END) AS changed, CASE WHEN coalesce(o1, 0) > 0 THEN coalesce(b1, 0) / o1 ELSE 1 END AS retention FROM d LEFT JOIN t ON d.doc_id = t.doc_id)
SELECT doc_id, round(changed, 9) AS changed, round(retention, 9) AS retention, identical, NOT identical AND changed >= 0.20 AND retention <= 0.85 AS material FROM r""",
    "multiset_overlap": f"""WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark), d AS (SELECT doc_id, {_WORDS} AS w FROM documents), bs AS (SELECT item_id, s, count(*) AS n FROM (SELECT item_id, unnest({_SHINGLED.format(n=8)}) AS s FROM b WHERE len(w) >= 8) GROUP BY 1, 2),
ds AS (SELECT doc_id, s, count(*) AS n FROM (SELECT doc_id, unnest({_SHINGLED.format(n=8)}) AS s FROM d WHERE len(w) >= 8) GROUP BY 1, 2) SELECT item_id AS left_id, doc_id AS right_id, CAST(sum(least(bs.n, ds.n)) AS BIGINT) AS shared FROM bs JOIN ds USING (s) GROUP BY 1, 2""",
    "jaccard_best_match": f"""WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark), d AS (SELECT doc_id, {_WORDS} AS w FROM documents), bs AS (SELECT DISTINCT item_id, unnest({_SHINGLED.format(n=12)}) AS s FROM b WHERE len(w) >= 12), ds AS (SELECT DISTINCT doc_id, unnest({_SHINGLED.format(n=12)}) AS s FROM d WHERE len(w) >= 12),
nb AS (SELECT item_id, count(*) AS nb FROM bs GROUP BY 1), nd AS (SELECT doc_id, count(*) AS nd FROM ds GROUP BY 1), m AS (SELECT item_id, doc_id, count(*) AS k FROM bs JOIN ds USING (s) GROUP BY 1, 2),
r AS (SELECT item_id, doc_id, CASE WHEN k = nb AND nb = nd THEN 3 WHEN k = nb THEN 2 ELSE 1 END AS rank, k / (nb + nd - k) AS score FROM m JOIN nb USING (item_id) JOIN nd USING (doc_id) UNION ALL SELECT b.item_id, d.doc_id, 3, 1.0 FROM b JOIN d ON b.w = d.w WHERE len(b.w) BETWEEN 1 AND 11)
SELECT item_id AS block_id, doc_id AS source_id, CASE rank WHEN 3 THEN 'exact' WHEN 2 THEN 'contained' ELSE 'jaccard' END AS how, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rank DESC, score DESC, doc_id) AS n FROM r) WHERE n = 1""",
    "own_figures": r"WITH f AS (SELECT DISTINCT doc_id, source, unnest(regexp_extract_all(text, '\b([0-9]{3,})\b', 1)) AS figure FROM documents) SELECT min(doc_id) AS doc_id, figure FROM f GROUP BY source, figure HAVING count(*) = 1",
    "cosine_pairs": "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.3",
    "merge_band": """WITH o AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), e AS (SELECT vec_id, label, v, vec_id % 20 AS d FROM o
UNION ALL SELECT vec_id + 1000000, label, list_transform(v, lambda x, i: x + (vec_id % 3 + 1) * 0.2 * v[i % len(v) + 1]), vec_id % 20 + vec_id % 11 FROM o),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id AND abs(a.d - b.d) <= 7) SELECT a, b, round(c, 6) AS cosine, CASE WHEN c > 0.93 THEN 'same' ELSE 'review' END AS band FROM p WHERE c >= 0.85""",
    "drift_sample": "WITH f AS (SELECT label, k - 1 AS dim, CAST(embedding[k] AS DOUBLE) AS x FROM (SELECT label, embedding, unnest(generate_series(1, len(embedding))) AS k FROM embeddings)) SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS spread, count(*) AS n FROM f GROUP BY 1, 2",
}
