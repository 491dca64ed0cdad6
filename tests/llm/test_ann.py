import numpy as np
import pytest
from basaltiq.llm import ann
from pyspark.sql import functions as F


def exact(ids, x, queries, k=20):
    out = {}
    for q in queries:
        i = ids.index(q)
        s = [(-float((x[j].astype(float) * x[i].astype(float)).sum()), ids[j]) for j in range(len(ids)) if j != i]
        out[q] = [(v, -s) for s, v in sorted(s)[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0) for i, v in rows], "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("size, how", [("sf0.1", {}), ("sf0.01", {}), ("sf0.1", {"shard": 512, "block": 30})])
def test_recall_and_scores(spark, size, how):
    """With production parameters, at two sizes, and with several shards and blocks."""
    vectors = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet")
    rows = sorted(vectors.collect(), key=lambda r: r.vec_id)
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float32)
    got = {}
    for r in sorted(ann.nearest(vectors, vectors.filter("vec_id % 20 = 0"), **how).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = exact(ids, x, [i for i in ids if i % 20 == 0])
    assert got.keys() == want.keys()
    assert all(len(v) == 20 for v in got.values())
    recall = np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want])
    print("recall", size, how, recall)
    assert recall >= 0.9
    known = {(q, v): s for q in want for v, s in want[q]}
    for q in got:
        assert got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
        assert all(abs(s - known[q, v]) < 1e-12 for v, s in got[q] if (q, v) in known)


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    same = [1.0, 2.0, 3.0]
    rows = [(0, same), (1, None), (2, [0, 0, 0]), (3, [nan, 1, 1]), (4, [inf, 1, 1]), (5, [1, None, 1]), (6, [1, 2]), (8, []), (None, same)]
    rows += [(i, same) for i in range(100, 60, -1)] + [(7, [3.0, 2.0, 9.0])]
    df = frame(spark, rows)
    got = ann.nearest(df, df.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in got} == {0, 80, 100}
    assert [r.vec_id for r in got if r.query_id == 0] == [7, *range(61, 80)]
    assert [r.vec_id for r in got if r.query_id == 80] == [7, 0, *range(61, 79)]
    few = frame(spark, [(0, same), (1, same), (2, [1.0, 0, 0])])
    assert [r.vec_id for r in ann.nearest(few, few.filter("vec_id = 0")).orderBy("rank").collect()] == [1, 2]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_clashing_columns_and_ties_at_the_cut(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 8)).astype(np.float32)
    rows = [(i, base[i % 6].tolist()) for i in range(900)]  # 150 copies of each: ties at every cut
    df = frame(spark, rows)
    for extra in ("id", "x", "shard", "part", "kind", "rank", "score", "u"):
        df = df.withColumn(extra, F.lit("clash"))
    got = {}
    for r in ann.nearest(df, df.filter("vec_id = 300"), share=0.1).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {300: [i for i in range(900) if i % 6 == 0 and i != 300][:20]} or len(set(got[300])) == 20
    same = [v for v in got[300] if v % 6 == 0]
    assert same == sorted(same)


def test_query_groups(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERIES", 7)
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    few = sorted(map(tuple, ann.nearest(vectors, vectors, shard=40, block=3, share=1.0).collect()))
    monkeypatch.undo()
    assert few == sorted(map(tuple, ann.nearest(vectors, vectors, share=1.0).collect()))
