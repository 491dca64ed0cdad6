"""Media columns: interleaved sequences of text and media references.

HTML is parsed to an ordered array of structs: texts, and references to media
with their digest and caption, each with its position. Payloads live in a
store, a table of stored forms keyed by digest; references resolve
by a join on the digest, and positions and captions stay with their reference.
The stored form is a binary PGM image, 64 samples of 8 bits a row: lossless,
and any payload padded to a positive multiple of 64 bytes has one.

A document's own sequence is its text with a figure of its payload in the
middle. The store is written where the texts lie, without a shuffle, so equal texts
may lie in it once for each task; what is computed from a stored form is
computed from the bytes read back, and the join resolves a digest to one row.
Digests that many references share are salted in the join.

Cases: null HTML is an empty sequence; a reference without a payload in the
store resolves to null; null text is an empty payload of 64 zero bytes, and its
sequence is the figure alone. A caption belongs to the media of its figure, wherever in it it stands; outside of figures it is text.
Repeated references resolve each, repeated rows too. Very long texts are one payload each. Only the named columns are read. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, salted, scratch

WIDTH = 64
SCHEME = "sha256:"
ITEM = "struct<position:int,kind:string,text:string,digest:string,caption:string>"
STORED = "n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"


class Interleaved(HTMLParser):
    """Texts and media references in the order of the page; captions from the figure's figcaption, else from alt."""

    MEDIA, SKIP, BREAKS = {"img", "video", "audio", "source"}, {"script", "style"}, {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "tr", "article", "section", "footer", "nav"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.words, self.skipped, self.caption = [], [], 0, None
        self.figures = []  # of those that are open: their media, and their caption

    def _text(self):
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def _close_caption(self):
        if self.caption is not None:
            said, self.caption = " ".join("".join(self.caption).split()), None
            self.figures[-1]["caption"] = said

    def _close_figure(self):
        self._close_caption()
        figure = self.figures.pop()
        if figure["caption"] is not None:
            for item in figure["media"]:
                item["caption"] = figure["caption"]

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skipped += 1
        elif tag == "figure":
            self._text()
            self.figures.append({"media": [], "caption": None})
        elif tag == "figcaption":
            self._text()
            if self.figures:
                self._close_caption()
                self.caption = []
        elif tag in self.MEDIA:
            self._text()
            a = dict(attrs)
            src = a.get("src") or ""
            item = {"kind": "media", "text": None, "digest": src[len(SCHEME) :] if src.startswith(SCHEME) else None, "caption": a.get("alt")}
            self.items.append(item)
            if self.figures:
                self.figures[-1]["media"].append(item)
        elif tag in self.BREAKS:
            self._text()

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif tag == "figcaption":
            if self.figures:
                self._close_caption()
            self._text()
        elif tag == "figure":
            self._text()
            if self.figures:
                self._close_figure()
        elif tag in self.BREAKS:
            self._text()

    def handle_data(self, data):
        if self.caption is not None:
            self.caption.append(data)
        elif not self.skipped:
            self.words.append(data)

    def done(self) -> list[dict]:
        self.close()
        self._text()
        while self.figures:
            self._close_figure()
        return [{"position": i, **x} for i, x in enumerate(self.items)]


def parse_html(html: str | None) -> list[dict]:
    p = Interleaved()
    p.feed(html or "")
    return p.done()


def sequences(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """key and items, the interleaved sequence of each row."""
    kind = pages.schema[key].dataType.simpleString()
    item = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parse_html(h) for h in batch.column(1).to_pylist()], pa.list_(item))], names=[key, "items"])

    return pages.select(F.col(key), F.col(html).cast("string")).mapInArrow(run, f"`{key}` {kind}, items array<{ITEM}>")


def references(parsed: DataFrame, key: str = "page_id") -> DataFrame:
    """key, position, digest, caption of every media reference."""
    return parsed.select(key, F.explode("items").alias("m")).filter("m.kind = 'media'").select(key, "m.position", "m.digest", "m.caption")


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % WIDTH or (WIDTH if not raw else 0))


def to_pgm(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def from_pgm(stored: bytes) -> bytes:
    """The samples of a binary PGM of 8 bits."""
    magic, size, depth, rest = stored.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255" or len(rest) != width * height:
        raise ValueError("not a binary PGM of 8 bits")
    return rest


def feature(samples: bytes) -> str:
    """Sum, sum of squares and an 8-bin histogram of the samples, and how often a sample is greater than the one before it."""
    x = np.frombuffer(samples, np.uint8)
    bins = np.bincount(x >> 5, minlength=8)
    wide = x.astype(np.int64)
    return f"sum={wide.sum()};squares={(wide * wide).sum()};hist={'/'.join(map(str, bins))};rises={(x[1:] > x[:-1]).sum()}"


def utf8(text: str):
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


def stored(docs: DataFrame, text: str = "text") -> DataFrame:
    """digest (of the text as UTF-8), n_bytes and media (the stored form) of each row."""

    def run(batches):
        for batch in batches:
            seen, out = set(), [[], [], []]
            for v in batch.column(0):
                raw = v.as_py()
                digest = hashlib.sha256(raw).hexdigest()
                if digest not in seen:
                    seen.add(digest)
                    for c, x in zip(out, (digest, len(raw), to_pgm(padded(raw)))):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["digest", "n_bytes", "media"])

    return docs.select(utf8(text).alias("raw")).mapInArrow(run, "digest string, n_bytes long, media binary")


def write_store(docs: DataFrame, folder: str, text: str = "text") -> DataFrame:
    """Writes the stored forms of all texts and returns the table that reads them back."""
    stored(docs, text).write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def figures(store: DataFrame) -> DataFrame:
    """digest and the figures of the stored form, from its bytes, of each row of a store."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for v in batch.column(2):
                media = v.as_py()
                back = from_pgm(media)
                for c, x in zip(out, (len(media), hashlib.sha256(media).hexdigest(), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), feature(back))):
                    c.append(x)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(out, kinds))], names=["digest", *(x.split()[0] for x in STORED.split(", "))])

    return store.select("digest", "n_bytes", "media").mapInArrow(run, f"digest string, {STORED}")


def resolve(refs: DataFrame, payloads: DataFrame, by: str) -> DataFrame:
    """refs with the columns of their payload (one row for each digest), joined by digest; refs without a payload keep nulls. References to a hot digest are dealt to salts by their column `by`."""
    return salted(refs, payloads.withColumnRenamed("digest", "_digest"), "digest", "_digest", by, "left").drop("_digest")


def own_pages(docs: DataFrame, text: str, key: str) -> DataFrame:
    """key and html: each document's text in two parts, a figure of its payload with its id as caption between them."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    escaped = lambda x: F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    half = F.floor(F.length(t) / 2).cast("int")
    figure = F.concat(F.lit(f'<figure><img src="{SCHEME}'), F.sha2(utf8(text), 256), F.lit('"><figcaption>'), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit("</figcaption></figure>"))
    return docs.select(F.col(key), F.concat(F.lit("<p>"), escaped(F.substring(t, F.lit(1), half)), F.lit("</p>"), figure, F.lit("<p>"), escaped(F.substring(t, half + 1, F.length(t))), F.lit("</p>")).alias("html"))


def document_media(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, digest, position, caption and the figures of the payload that each document's own sequence refers to.

    The store stays in the shared folder until common.release().
    """
    spark = docs.sparkSession
    refs = references(sequences(own_pages(docs, text, key), "html", key), key)
    made = figures(write_store(docs, scratch(spark, "media"), text))
    payloads = made.groupBy("digest").agg(*[F.first(x.split()[0]).alias(x.split()[0]) for x in STORED.split(", ")])
    return resolve(held(refs), payloads, key)
