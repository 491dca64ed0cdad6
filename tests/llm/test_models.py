import math
import zlib

import numpy as np
from basaltiq.llm import langid, queries, toxicity
from hypothesis import given, settings
from hypothesis import strategies as st


def slow_cost(train: dict, text: bytes, lang: str, order: int) -> float:
    """Code length by explicit trees, byte after byte."""
    tree: dict[bytes, dict[int, int]] = {}
    for t in train[lang]:
        for i, b in enumerate(t):
            for k in range(min(order, i) + 1):
                tree.setdefault(t[i - k : i], {}).setdefault(b, 0)
                tree[t[i - k : i]][b] += 1
    bits = 0.0
    for i, b in enumerate(text):
        for k in range(min(order, i), -1, -1):
            node = tree.get(text[i - k : i])
            if node is None:
                continue
            room = sum(node.values()) + len(node)
            if b in node:
                bits -= math.log2(node[b] / room)
                break
            bits -= math.log2(len(node) / room)
        else:
            bits += 8
    return bits


TRAIN = {"x": [b"abracadabra abra", b"banana"], "y": [b"cadenza", "ñandú".encode(), b"zzz"], "z": [b"q"]}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcdnrzqñ !", max_size=40), st.integers(0, 4))
def test_exact_code_lengths(text, order):
    model = langid.PPM(TRAIN, order)
    raw = text.encode()
    got = model.code_lengths([b"ab", raw, b""])[1]
    want = [slow_cost(TRAIN, raw, lang, order) for lang in model.langs]
    assert np.allclose(got, want, rtol=1e-4, atol=1e-3)


def test_long_texts_are_cut_without_loss(monkeypatch):
    model = langid.PPM(TRAIN, 3)
    text = b"abra cadabra ban" * 40
    whole = model.code_lengths([text])
    monkeypatch.setattr(langid, "BLOCK", 37)
    assert np.allclose(model.code_lengths([b"x", text, text])[1:], whole)


def test_language_cases(documents):
    docs = documents([(1, None), (2, ""), (3, "123 !!"), (4, "der die das und", "de"), (5, "the of and to", "en"), (5, "the of and to", "en"), (6, "the and", None), (None, "the of")])
    got = langid.predict(docs, langid.fit(docs)).collect()
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"}
    assert {r.lang_pred for r in got if r.doc_id in (5, 6)} == {"en"} and len(got) == 8
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.predict(docs, langid.fit(docs.filter("false"))).filter("lang_pred != 'und'").count() == 0
    assert langid.predict(docs.filter("false"), langid.fit(docs)).count() == 0


def test_held_out_language(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in queries.op1_language_id(spark, sf).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def plain_osa(a, b):
    d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


TERMS = ["abc", "abcd", "bcdabc", "aabbccddaa", "ddddcccc", "cab", "abcab"]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="abcd", max_size=12))
def test_automaton_matches(word):
    near = [(plain_osa(word, t), t) for t in TERMS if plain_osa(word, t) <= toxicity.edits_allowed(t)]
    got = toxicity.FuzzyTrie(TERMS).match(word)
    assert got == ((min(near)[1], min(near)[0]) if near else None)


def test_quotation():
    text = 'they said "you idiot there" and left. you idiot!\n"'
    at = [i for i in range(len(text)) if text.startswith("idiot", i)]
    assert [toxicity.quoted(text, i, i + 5, 80) for i in at] == [True, False]


def test_toxicity_cases(documents, spark):
    docs = documents([(i, f"word{i} some text here " + ("you scumbag loser" if i % 4 == 0 else "fine day")) for i in range(60)] + [(100, None), (101, ""), (102, "you scumbga losr now"), (102, "again")])
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(60)] + [(1, 0, None), (None, 0, 1), (999, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect() if r.doc_id != 102}
    assert len(got) == 62
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(60)) and got[100] == got[101] < 0.5
    none = toxicity.fit(docs, labels.filter("false"))
    assert toxicity.score(docs, none).filter("score != 0").count() == 0


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in queries.op5_toxicity(spark, sf).collect() if r.held_out and r.doc_id in truth]
    assert len(held) > 500
    right = [r.predicted == truth[r.doc_id] for r in held]
    toxic = [r.predicted for r in held if truth[r.doc_id]]
    assert np.mean(right) > 0.97 and np.mean(toxic) > 0.9


def test_sorted_steps_are_the_table(monkeypatch):
    import random

    from basaltiq.llm import langid

    rng = random.Random(5)
    texts = {g: ["".join(rng.choice(g) for _ in range(300)).encode() for _ in range(4)] for g in ("abcd", "bcde", "cdéf")}
    asked = [b"abcdbcd", "éfcd".encode(), b"zzzz", b""]
    table = langid.PPM(texts).code_lengths(asked)
    monkeypatch.setattr(langid, "DENSE", 10)
    assert np.array_equal(langid.PPM(texts).code_lengths(asked), table)


def test_toxicity_of_one_class_only(spark, documents):
    from basaltiq.llm import toxicity

    docs = documents([(1, "some words"), (2, None), (3, "word " * 40_000)])
    for label in (0, 1):
        labels = spark.createDataFrame([(1, label)], "doc_id long, toxic int")
        assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()} == {float(label)}
    empty = documents([])
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0
