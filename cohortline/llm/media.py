"""Media columns: ordered text and media items of HTML, a payload store, and a join by digest that keeps positions."""

from __future__ import annotations

import hashlib
import re
import zlib
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cohortline.llm.common import row_function, utf8
from cohortline.session import scratch_path

#: Samples in a row of a stored payload
ROW = 576
PREFIX = "media/"
TAGS = {"img": "image", "audio": "audio", "video": "video", "source": "media"}
ITEMS = T.ArrayType(T.StructType([
    T.StructField("position", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("ref", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("caption", T.StringType())]))


class _Items(HTMLParser):
    """Collects text runs and media in document order; a caption goes to the media of its own figure."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.text: list[str] = []
        self.silent = 0
        self.figure: int | None = None
        self.caption: list[str] | None = None

    def flush(self):
        run = " ".join("".join(self.text).split())
        self.text = []
        if run:
            self.items.append(["text", run, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript", "template"):
            self.silent += 1
        elif tag in TAGS:
            known = dict(attrs)
            if known.get("src"):
                self.flush()
                self.items.append([TAGS[tag], None, known["src"], known.get("alt") or known.get("title")])
        elif tag == "figure":
            self.flush()
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in ("br", "p", "div", "li", "td", "th", "tr", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript", "template"):
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption":
            self.end_caption()
        elif tag == "figure":
            self.end_caption()
            self.flush()
            self.figure = None
        elif tag in ("p", "div", "li", "td", "th", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "table", "ul", "ol"):
            self.text.append(" ")

    def end_caption(self):
        if self.caption is None:
            return
        said, self.caption = " ".join("".join(self.caption).split()), None
        media = [x for x in self.items[self.figure if self.figure is not None else len(self.items):] if x[2]]
        for x in media:
            x[3] = said or x[3]
        if said and not media:
            self.items.append(["text", said, None, None])

    def handle_data(self, data):
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def digest_of(ref: str | None) -> str | None:
    """The SHA-256 that a reference names as its last part, `media/<64 hex digits>`; others name none."""
    found = re.search(rf"(?:^|/){PREFIX}([0-9a-f]{{64}})(?:$|[?#.])", ref or "")
    return found[1] if found else None


def parse(html: str | None) -> list[tuple]:
    """The items of one page in order: (position, kind, text, ref, digest, caption). Null and empty pages have none."""
    reader = _Items()
    reader.feed(html or "")
    reader.close()
    reader.end_caption()
    reader.flush()
    return [(k, kind, text, ref, digest_of(ref), caption) for k, (kind, text, ref, caption) in enumerate(reader.items)]


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, items (ordered structs of text or media reference). Other columns are not read."""
    items = row_function(lambda: parse, ITEMS)
    return pages.select(F.col(id_col).alias("page_id"), items(F.col(html_col).cast("string")).alias("items"))


def payload(text: str | Column) -> Column:
    """The UTF-8 bytes of a text, filled with bytes 255 up to a positive multiple of a row; null is empty."""
    raw = utf8(text)
    size = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / F.lit(ROW))).cast("int") * ROW
    return F.rpad(raw, size, F.unhex(F.lit("FF")))


def stored_form(raw: Column) -> Column:
    """A binary grey map: 8-bit samples in rows, behind the format's header."""
    rows = (F.octet_length(raw) / F.lit(ROW)).cast("int").cast("string")
    return F.concat(F.concat(F.lit(f"P5\n{ROW} "), rows, F.lit("\n255\n")).cast("binary"), raw)


def samples(media: bytes) -> bytes:
    """The samples of a stored form, after its three header lines."""
    kind, shape, most, raw = media.split(b"\n", 3)
    wide, high = map(int, shape.split())
    if kind != b"P5" or most != b"255" or wide * high != len(raw):
        raise ValueError("not a whole 8-bit grey map")
    return raw


FEATURES = T.StructType([
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())])


def describe(media: bytes) -> tuple:
    """What is known of one stored form: sizes, digests, and a feature of whole numbers (shape, mean, spread, histogram)."""
    raw = samples(media)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, level = len(raw), np.arange(256)
    mean = int(counts @ level * 1000 // n)
    spread = int(counts @ (level * level) * 1000 // n)
    parts = counts.reshape(16, 16).sum(axis=1) * 1000 // n
    feature = f"{ROW}x{n // ROW};{mean};{spread};" + ",".join(map(str, parts.tolist()))
    return n, hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature


def write_store(rows: DataFrame, name: str = "media") -> DataFrame:
    """Write a table of payload digests and stored forms to the shared folder and open it again."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def catalogue(store: DataFrame) -> DataFrame:
    """One row per digest: digest and what the stored bytes, read back, say. Equal payloads meet before the shuffle."""
    described = store.select("digest", row_function(lambda: describe, FEATURES)(F.col("media")).alias("about"))
    names = FEATURES.fieldNames()
    return described.groupBy("digest").agg(*(F.max(f"about.{n}").alias(n) for n in names))


def resolve(found: DataFrame, known: DataFrame) -> DataFrame:
    """One row per item, in place: page_id, position, kind, text, ref, digest, caption and the payload's columns.

    A reference without a known payload keeps its row with nulls. The join is on the digest; the payload side has one
    row per digest, so a payload that a third of the pages show is split on the other side only.
    """
    items = found.select("page_id", F.explode("items").alias("item")).select("page_id", "item.*")
    return items.join(known, "digest", "left")


def documents_as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every document as media, refer to it from a page of its own, and resolve the pages' items.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, caption.
    Null texts are empty ones; null ids and repeated rows stay (an item carries its id and size in its page, not by a join
    on ids). Equal texts have equal values. The stored table holds one form per row.
    """
    raw = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(utf8(text_col)).cast("long").alias("n_bytes"), payload(text_col).alias("_raw"))
    store = write_store(raw.select("doc_id", "n_bytes", F.sha2("_raw", 256).alias("digest"), stored_form(F.col("_raw")).alias("media")))
    page = F.concat(F.lit(f'<figure><img src="{PREFIX}'), F.col("digest"), F.lit('"><figcaption>'), F.col("n_bytes").cast("string"), F.lit(" bytes</figcaption></figure>"))
    pages = store.select(F.struct("doc_id", "n_bytes").alias("page"), page.alias("html"))
    items = resolve(sequences(pages, "page", "html"), catalogue(store))
    return items.select("page_id.doc_id", "page_id.n_bytes", *FEATURES.fieldNames(), "caption")


def media_sequences(pages: DataFrame, store: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The interleaved form: page_id and its items in order, references resolved against a store (digest, media)."""
    rows = resolve(sequences(pages, id_col, html_col), catalogue(store))
    item = F.struct("position", "kind", "text", "ref", "digest", "caption", "media_bytes", "media_sha256", "feature")
    return rows.groupBy("page_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
