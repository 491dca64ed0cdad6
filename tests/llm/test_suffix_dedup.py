import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from basaltiq.llm import suffix_dedup as S
from hypothesis import given, settings
from hypothesis import strategies as st


def brute(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    counts = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def expected(rows):
    return sorted(((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows]))), key=str)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(n))


def cases():
    rng = random.Random(3)
    passage, line = words(rng, 80), words(rng, 20)
    rows = [(i, words(rng, rng.randint(5, 200))) for i in range(30)]
    rows += [(30 + i, words(rng, 20) + passage[: 205 + i] + words(rng, 20)) for i in range(20)]
    rows += [(60 + i, words(rng, 40) + line + words(rng, 40)) for i in range(10)]
    rows += [(80, "ab" * 300), (81, "x" * 201), (82, "x" * 200), (83, "x" * 199), (84, ""), (85, None), (86, "abc" * 100 + "q" + "abc" * 100)]
    rows += [(90, rows[0][1] + passage), (91, rows[0][1] + passage), (91, rows[0][1] + passage), (92, rows[40][1] * 2), (None, passage + "z")]
    return rows


def test_brute_force(documents):
    rows = cases()
    assert got(S.remove(documents(rows))) == expected(rows)


def test_hot_anchors(documents, monkeypatch):
    rows = cases() + [(200 + i, cases()[35][1] + words(random.Random(i), 30)) for i in range(40)]
    whole = S.frequent_anchors
    monkeypatch.setattr(S, "frequent_anchors", lambda d, n, total: whole(d, n, total, sample=1000, share=0.02))
    df = documents(rows)
    assert S.frequent_anchors(df.selectExpr("doc_id id", "doc_id th", "text t").drop("x"), 200, len(rows))
    assert got(S.remove(df)) == expected(rows)
    hot = S.compared_hot
    monkeypatch.setattr(S, "compared_hot", lambda c, p, n, most: hot(c, p, n, most=3))
    assert got(S.remove(df)) == expected(rows)


def test_groups_that_the_sample_missed(documents, monkeypatch):
    whole = S.repeated
    monkeypatch.setattr(S, "repeated", lambda d, n: whole(d, n, most=2))
    assert got(S.remove(documents(cases()))) == expected(cases())


def test_a_text_of_several_slices(documents, monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(S, "SLICE", 700)
    texts = [words(rng, 400), words(rng, 300)]
    rows = [(1, texts[0] + texts[1]), (2, texts[1]), (3, words(rng, 50) + texts[0][300:1300])]
    marks = [m for i, t in rows for at, p in S.slices(t.encode(), 200) for m in [(i, at, S.runs_of(p, 200))]]
    assert {i: sum(int(m[3].sum()) for j, _, m in marks if j == i) for i, _ in rows} == {i: len(t.encode()) - 199 for i, t in rows}
    monkeypatch.undo()
    assert got(S.remove(documents(rows))) == expected(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2), st.booleans()), min_size=1, max_size=40), st.integers(1, 7))
def test_sift_in_batches(keys, step):
    """Whatever the batches, the verdicts are those of whole groups."""
    rows = pd.DataFrame([(h, c, i, 0, 0, 1, m) for i, (h, c, m) in enumerate(sorted(keys, key=lambda k: k[:2]))], columns=["h", "c", "id", "th", "s", "n", "multi"])

    class Sorted:
        def mapInPandas(self, run, _):
            return pd.concat(run(iter([rows.iloc[i : i + step] for i in range(0, len(rows), step)])))

    class Hot:
        value = [3]

    got_rows = sorted(S.sift(Sorted(), Hot(), batch=1)[["kind", "id", "k"]].itertuples(index=False, name=None))
    size, contexts = Counter((r.h, r.c) for r in rows.itertuples()), {h: len({c for x, c, _ in keys if x == h}) for h in range(4)}
    want, seen = [], set()
    for r in rows.itertuples():
        if size[r.h, r.c] > 1:
            want.append((0, r.id, 0))
        if (r.h, r.c) not in seen:
            seen.add((r.h, r.c))
            if r.h == 3:
                want.append((2, r.id, min(2, size[r.h, r.c])))
            elif contexts[r.h] > 1 or r.multi:
                want.append((1, r.id, min(2, size[r.h, r.c])))
    assert got_rows == sorted(want)


def test_slices(documents, monkeypatch):
    monkeypatch.setattr(S, "SLICE", 700)
    rows = cases()
    rows.append((300, rows[10][1] * 3 + rows[5][1]))
    raw = rows[-1][1].encode()
    marks = [S.runs_of(p, 200) for _, p in S.slices(raw, 200)]
    assert sum(int(m[3].sum()) for m in marks) == len(raw) - 199


def test_empty_and_small_table(spark, documents, small):
    assert S.remove(documents([]).limit(0)).count() == 0
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(S.remove(docs)) == expected(rows)


def test_names_and_keys():
    rng = np.random.default_rng(0)
    base = rng.integers(97, 101, 900, dtype=np.uint8).tobytes()
    contexts = [base[0:260], base[7:300], base[100:400], base[400:700] + base[0:230]]
    count = np.array([len(c) - 199 for c in contexts])
    first = np.array([0, 11, 5, 2])
    hit = S.repeated_starts(contexts, first, count, np.zeros(4, np.int64), 200)
    seen = Counter(c[i : i + 200] for c in contexts for i in range(len(c) - 199))
    assert hit.tolist() == [seen[c[i : i + 200]] > 1 for c in contexts for i in range(len(c) - 199)]


def test_other_lengths_are_refused(documents):
    with pytest.raises(ValueError):
        S.remove(documents([(1, "a")]), length=100)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 3), st.integers(1, 5))
def test_starts_are_sorted_by_their_windows(seed, letters, n):
    """The difference cover's order is that of the windows' bytes."""
    rng = np.random.default_rng(seed)
    base = rng.integers(97, 97 + letters, 500, dtype=np.uint8).tobytes()
    contexts = [base[a : a + int(rng.integers(200, 260))] for a in rng.integers(0, 240, n).tolist()]
    count = np.array([len(c) - 199 for c in contexts])
    raw, place, order = S.sorted_starts(contexts, rng.integers(0, 9, n), count, 200)
    windows = [raw[p : p + 200].tobytes() for p in place[order]]
    assert windows == sorted(windows) and sorted(order.tolist()) == list(range(int(count.sum())))
