"""Interleaved document sequences with media columns.

``parse_interleaved`` turns HTML into an ordered array of items: text runs and media references, each
reference with its alternative text and its caption. ``store_payloads`` keeps bytes as binary
greyscale bitmaps (8-bit samples, 192 wide), one row per digest. ``resolve`` explodes references with their positions, joins them to the store by digest and
gathers the sequences again, so positions and captions stay aligned with their payloads.

Edge cases: a null HTML or text counts as empty and gives an empty sequence; unknown digests keep their
place with a null payload; repeated references share one stored payload; unclosed tags close at the end;
empty tables give empty results; other columns of the inputs are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

WIDTH = 192
ITEM = "position int, kind string, text string, ref string, alt string, caption string"
STORED = "digest string, n_bytes long, media binary"
FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
BLOCK_TAGS = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "th", "br", "nav", "footer", "header", "figure", "blockquote", "pre", "main", "aside"}
SILENT_TAGS = {"script", "style", "template", "noscript", "head"}


class _Sequence(HTMLParser):
    """Collects text runs and references in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.silent = 0
        self.figure: list[int] = []
        self.caption: list[str] | None = None

    def flush(self) -> None:
        if text := " ".join("".join(self.run).split()):
            self.add("text", text=text)
        self.run = []

    def add(self, kind: str, **values: str | None) -> None:
        self.items.append({"position": len(self.items), "kind": kind, "text": None, "ref": None, "alt": None, "caption": None} | values)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SILENT_TAGS:
            self.silent += 1
        elif tag in ("img", "audio", "video", "source", "embed") and not self.silent:
            values = dict(attrs)
            if values.get("src"):
                self.flush()
                self.add("media", ref=values["src"], alt=values.get("alt"))
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in BLOCK_TAGS:
            self.flush()
            if tag == "figure":
                self.figure.append(len(self.items))

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT_TAGS:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption":
            self.close_caption()
        elif tag in BLOCK_TAGS:
            self.flush()
            if tag == "figure" and self.figure:
                self.figure.pop()

    def close_caption(self) -> None:
        if self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            for item in self.items[self.figure[-1] if self.figure else 0 :]:
                if item["kind"] == "media" and item["caption"] is None:
                    item["caption"] = text

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.run if self.caption is None else self.caption).append(data)


def sequence_of(html: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.close_caption()
    parser.flush()
    return parser.items


def parse_interleaved(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, items): the ordered sequence of text and media items of every page."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({id_col: batch[id_col], "items": [sequence_of(h) for h in batch[html_col]]})

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInPandas(parse, f"`{id_col}` {kind}, items array<struct<{', '.join(':'.join(x.split()) for x in ITEM.split(', '))}>>")


def encode(payload: bytes) -> bytes:
    """Pad with spaces to a positive multiple of WIDTH and write a binary greyscale bitmap."""
    rows = max(1, -(-len(payload) // WIDTH))
    return b"P5\n%d %d\n255\n" % (WIDTH, rows) + payload.ljust(rows * WIDTH, b" ")


def decode(media: bytes) -> np.ndarray:
    """Samples of a stored bitmap, rows by columns."""
    magic, size, depth, samples = media.split(b"\n", 3)
    width, rows = map(int, size.split())
    if magic != b"P5" or depth != b"255" or len(samples) != width * rows:
        raise ValueError("not a stored payload")
    return np.frombuffer(samples, np.uint8).reshape(rows, width)


def feature_of(samples: np.ndarray) -> str:
    """Size, sum, extremes, and an 8 by 8 hash of which blocks are brighter than the mean; integers only."""
    rows, width = samples.shape
    columns = np.add.reduceat(samples, np.arange(0, width, width // 8), axis=1, dtype=np.int64)
    cells = np.add.reduceat(columns, np.unique(np.arange(8) * rows // 8), axis=0)
    lines = np.diff([*np.unique(np.arange(8) * rows // 8), rows])
    total = int(cells.sum())
    bits = (cells * (rows * 8) > total * lines[:, None]).ravel()
    return f"{width}x{rows};sum={total};min={samples.min()};max={samples.max()};hash={int(''.join('01'[int(b)] for b in bits), 2):x}"


def store_payloads(payloads: DataFrame, text_col: str) -> DataFrame:
    """The media store: one bitmap for each different text, keyed by the digest of its bytes. Lazy: ``common.stored`` writes it and reads it back."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [(t or "").encode() for t in batch[text_col]]
            yield pd.DataFrame({"digest": [hashlib.sha256(r).hexdigest() for r in raw], "n_bytes": [len(r) for r in raw], "media": [encode(r) for r in raw]})

    return payloads.select(text_col).mapInPandas(pack, STORED)


def read_features(store: DataFrame) -> DataFrame:
    """Read the stored bytes back: digests of the payload and of the stored form, checksum of the tail, feature."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for digest, n_bytes, media in batch[["digest", "n_bytes", "media"]].itertuples(index=False):
                samples = decode(media)
                payload = samples.tobytes()
                if hashlib.sha256(payload[:n_bytes]).hexdigest() != digest:
                    raise ValueError("stored bytes differ from their digest")
                rows.append((digest, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(samples)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in FEATURES.split(", ")])

    return store.mapInPandas(read, FEATURES)


def resolve(sequences: DataFrame, store: DataFrame, id_col: str, prefix: str = "sha256:") -> DataFrame:
    """(id, position, ref, alt, caption) with the columns of the store for every media item; unknown digests get nulls.

    The store's rows of one digest are equal and are reduced to one before the join, with map-side
    combining, so that neither copies of a payload nor references to it multiply.
    """
    refs = sequences.select(id_col, F.explode("items").alias("item")).where("item.kind = 'media'")
    refs = refs.select(id_col, "item.position", "item.ref", "item.alt", "item.caption", F.when(F.col("item.ref").startswith(prefix), F.substring("item.ref", len(prefix) + 1, 64)).alias("digest"))
    columns = [c for c in store.columns if c != "digest"]
    once = store.groupBy("digest").agg(F.min(F.struct(*columns)).alias("_media"))
    return refs.join(once, "digest", "left").select(id_col, "position", "ref", "alt", "caption", "digest", *[F.col(f"_media.{c}").alias(c) for c in columns])


def interleave(sequences: DataFrame, resolved: DataFrame, id_col: str) -> DataFrame:
    """Gather sequences again, with the resolved columns beside each media item, in their order."""
    columns = [c for c in resolved.columns if c not in (id_col, "position", "ref", "alt", "caption")]
    items = sequences.select(id_col, F.explode("items").alias("item")).select(id_col, "item.*")
    joined = items.join(resolved.select(id_col, "position", *columns).dropDuplicates([id_col, "position"]), [id_col, "position"], "left")
    return joined.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("position", "kind", "text", "ref", "alt", "caption", *columns))).alias("items"))


def document_pages(documents: DataFrame) -> DataFrame:
    """(page, doc_id, rows, html): every different document as a page of text around one figure, whose reference names the digest of its text, and how many rows it stands for."""
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    each = documents.select("doc_id", F.sha2(raw, 256).alias("digest"), F.octet_length(raw).cast("string").alias("size"))
    once = each.groupBy("doc_id", "digest", "size").agg(F.count("*").alias("rows"))
    html = F.concat(F.lit('<p>Text of a document:</p><figure><img src="sha256:'), F.col("digest"), F.lit('" alt="text"><figcaption>'), F.col("size"), F.lit(" bytes</figcaption></figure><p>End of it.</p>"))
    return once.select(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "digest").alias("page"), "doc_id", "rows", html.alias("html"))


def document_media(documents: DataFrame) -> DataFrame:
    """(doc_id, position, caption, the columns of ``FEATURES``) for every row of (doc_id, text): the text is stored as media, and read back off its place in its page.

    The store is a written table. It is read back into digests and features before the join, so that no payload is shuffled.
    """
    features = read_features(stored(store_payloads(documents, "text"), "media", compression="zstd"))
    pages = document_pages(documents)
    sequences = parse_interleaved(pages, "page", "html")
    whole = interleave(sequences, resolve(sequences, features, "page"), "page")
    item = whole.select("page", F.filter("items", lambda i: i["kind"] == "media")[0].alias("i")).select("page", "i.*")
    found = pages.select("page", "doc_id", "rows").join(item, "page")
    return found.select(F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("_row"), "*").select("doc_id", "position", "caption", *[x.split()[0] for x in FEATURES.split(", ")])
