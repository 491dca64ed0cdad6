import hashlib
import zlib

from basaltiq.llm import media as M
from pyspark.sql import functions as F


def test_parse():
    html = '<html><head><style>p{}</style><script>var t="</p>";</script></head><p>One <b>two</b>&amp; <img src="sha256:ab" alt="first"> three</p><figure><img src="sha256:cd" alt="x"><figcaption>a  caption</figcaption></figure><video src="http://e/x.mp4"></video>end'
    assert [(i["kind"], i["text"] or i["digest"], i["caption"]) for i in M.parse_html(html)] == [("text", "One two&", None), ("media", "ab", "first"), ("text", "three", None), ("media", "cd", "a caption"), ("media", None, None), ("text", "end", None)]
    assert [i["position"] for i in M.parse_html(html)] == list(range(6))
    assert M.parse_html(None) == [] == M.parse_html("")


def test_captions():
    said = lambda html: [(i["kind"], i["text"] or i["digest"], i["caption"]) for i in M.parse_html(html)]
    assert said('<figure><figcaption>c</figcaption><img src="sha256:a"></figure>') == [("media", "a", "c")]
    assert said('<figure><img src="sha256:a"></figure><img src="sha256:b"><figcaption>stray</figcaption>') == [("media", "a", None), ("media", "b", None), ("text", "stray", None)]
    assert said('<figure><img src="sha256:a"><figure><img src="sha256:b" alt="z"></figure><figcaption>o') == [("media", "a", "o"), ("media", "b", "z")]
    assert said("<figcaption>x</figcaption>y</figure>") == [("text", "x", None), ("text", "y", None)]


def test_pages_resolve(spark, small):
    payload = spark.createDataFrame([("ab", 1)], "digest string, n_bytes long")
    pages = spark.createDataFrame([(1, '<p>t<img src="sha256:ab" alt="c">u<img src="sha256:zz">'), (2, None), (3, "plain")], "page_id long, html string")
    got = M.resolve(M.references(M.sequences(pages)), payload, "page_id").orderBy("position").collect()
    assert [(r.page_id, r.position, r.caption, r.n_bytes) for r in got] == [(1, 1, "c", 1), (1, 3, None, None)]
    real = spark.read.parquet(f"{small}/pages.parquet")
    items = M.sequences(real).collect()
    assert len(items) == real.count() and all([x.position for x in r["items"]] == list(range(len(r["items"]))) and r["items"] for r in items)


def plain(raw):
    """All figures of a payload, from the text's bytes, in plain code."""
    size = max(64, -(-len(raw) // 64) * 64)
    x = raw + b"\0" * (size - len(raw))
    media = b"P5\n64 " + str(size // 64).encode() + b"\n255\n" + x
    hist = [sum(v // 32 == k for v in x) for k in range(8)]
    feature = f"sum={sum(x)};squares={sum(v * v for v in x)};hist={'/'.join(map(str, hist))};rises={sum(b > a for a, b in zip(x, x[1:]))}"
    return len(raw), size, hashlib.sha256(x).hexdigest(), zlib.crc32(x[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


def test_round_trip(documents, spark):
    rows = [(1, None), (2, ""), (3, "x" * 64), (4, "é" * 33), (5, "line\n\0\xff" * 9000), (5, "same"), (6, "same"), (7, "<p>a & b</p> " * 9), (None, "P5\n64 1\n255\n")]
    rows += [(100 + i, "a hot payload") for i in range(600)]
    docs = documents(rows)
    got = M.document_media(docs).collect()
    assert len(got) == len(rows)
    want = [(i, *plain((t or "").encode()), str(i) if i is not None else "null") for i, t in rows]
    mine = [(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature, r.caption) for r in got]
    assert sorted(mine, key=str) == sorted(want, key=str)
    assert M.document_media(documents([])).count() == 0


def test_stored_bytes_are_those_read(documents, spark, tmp_path):
    docs = documents([(1, "abc"), (2, "abc"), (3, None)])
    store = M.write_store(docs, f"file://{tmp_path}/store")
    kept = {r.digest: bytes(r.media) for r in store.collect()}
    assert kept == {hashlib.sha256(t).hexdigest(): M.to_pgm(M.padded(t)) for t in (b"abc", b"")}
    # figures follow the stored bytes, not the texts
    other = spark.createDataFrame([("d", 3, bytearray(M.to_pgm(b"\x01" * 64)))], "digest string, n_bytes long, media binary")
    assert M.figures(other).first().feature == plain(b"\x01" * 64)[-1]


def test_own_sequences_keep_text_around_the_figure(documents):
    docs = documents([(1, "one two <b> three & four"), (2, None)])
    items = {r.doc_id: [(x.kind, x.text, x.caption) for x in r["items"]] for r in M.sequences(M.own_pages(docs, "text", "doc_id"), "html", "doc_id").collect()}
    assert items == {1: [("text", "one two <b>", None), ("media", None, "1"), ("text", "three & four", None)], 2: [("media", None, "2")]}


def test_pages_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>")], "page_id long, url string, html string")
    for extra in ("items", "digest", "position", "m", "caption"):
        pages = pages.withColumn(extra, F.lit("clash"))
    assert [x.text for x in M.sequences(pages).first()["items"]] == ["a"]
