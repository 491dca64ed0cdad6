"""Nearest neighbours by a permutation index.

Pivots are a bounded, repeatable sample of the vectors. Vectors get one more
component that makes their lengths equal, so that the angle to a query orders
them as the inner product does. A vector stands for the order of its `depth`
nearest pivots. Vectors are dealt by a hash of their
id to shards of bounded size; each shard posts its vectors in one inverted
file per pivot, as (vector, place of the pivot in its order). A query opens
the files of its own nearest pivots and adds up, for each vector met there,
what the footrule distance falls short of its maximum:
  footrule = sum over pivots of |place in the query - place in the vector|,
with place `depth` for pivots beyond the order. The best share of each shard
by footrule (at least 4 k vectors of it) is reranked by the inner product in double precision, and the best
k of all shards win. A shard is shuffled once for every QUERIES queries and stays in its task;
the queries are sent to the shards and stream through. No pair of vectors ever reaches Spark, only k rows
for each query and shard. The vectors have no structure that would let a query skip
shards at this recall: the work grows with the product of vectors and queries.

Cases: vectors that are null, empty, zero, of another dimension than the most
frequent one, or hold null or non-finite components take no part. Fewer than k
candidates: all of them. Ties go to the smaller id, also at the cut by
footrule. Repeated vectors are candidates each. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unit_hash

QUERIES = 1 << 16
RESULT = "query_id long, rank int, vec_id long, score double"


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    kind = vectors.schema[column].dataType.simpleString()
    x = F.col(column).cast(kind if kind == "array<float>" else "array<double>")
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), x.alias("x")).filter("id is not null and x is not null").filter(fine)
    return rows


def pivot_table(rows: DataFrame, n: int, total: int) -> np.ndarray:
    """About n distinct vectors with the least hashes: the sample is bounded, whatever the table."""
    drawn = rows.withColumn("u", unit_hash("id", seed=17)).filter(F.col("u") * total < 4.0 * n + 64).orderBy("u", "id").limit(2 * n).select("x").collect()
    seen = list(dict.fromkeys(tuple(r.x) for r in drawn))[:n]
    return np.array(seen, dtype=np.float64)


def places(x: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The nearest `depth` pivots of each row, nearest first, ties to the pivot listed first."""
    near = pivots @ x.T
    return np.argsort(-near.T, axis=1, kind="stable")[:, :depth]


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Unit vectors with one more component, whose angles to (query, 0) fall as inner products with the query rise."""
    x = x / longest
    return np.hstack([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1, keepdims=True)))])


def search_shard(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, pivots: np.ndarray, longest: float, depth: int, share: float, k: int):
    """The best k of one shard for each query of a block."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    length = np.linalg.norm(q, axis=1, keepdims=True)
    pv = lifted(pivots, longest)
    mine, asked = places(lifted(x, longest), pv, depth), places(np.hstack([q / length, np.zeros_like(length)]), pv, depth)
    n, files = len(ids), len(pv)
    place = np.tile(np.arange(depth, dtype=np.int32), n)
    flat = mine.ravel()
    by = np.argsort(flat, kind="stable")
    bounds = np.searchsorted(flat[by], np.arange(files + 1))
    vec, place = (by // depth).astype(np.int64), place[by]
    want = min(n, max(4 * k, int(np.ceil(share * n))))
    out_q, out_rank, out_v, out_s = [], [], [], []
    tie = np.arange(n, dtype=np.int64)
    for i in range(len(q_ids)):
        gain = np.zeros(n, np.int64)
        for at, p in enumerate(asked[i].tolist()):
            a, b = bounds[p], bounds[p + 1]
            if a < b:
                r = place[a:b]
                # depth - at and depth - r would count if the pivot were missed by the other
                gain[vec[a:b]] += (depth - at) + (depth - r) - np.abs(at - r)
        cost = (depth * (depth + 1) - gain) * n + tie
        near = np.argpartition(cost, want - 1)[:want] if want < n else tie
        near = near[ids[near] != q_ids[i]]
        if not len(near):
            continue
        s = (x[near] * q[i]).sum(axis=1)
        if len(near) > 4 * k:
            near = near[keep := s >= np.partition(s, len(s) - k)[len(s) - k]]
            s = s[keep]
        best = np.lexsort((ids[near], -s))[:k]
        out_q += [q_ids[i]] * len(best)
        out_rank += range(1, len(best) + 1)
        out_v += ids[near][best].tolist()
        out_s += s[best].tolist()
    return out_q, out_rank, out_v, out_s


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", column: str = "embedding", pivots: int = 256, depth: int = 64, share: float = 0.18, shard: int = 4096, block: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `queries` its k nearest rows of `vectors` other than itself, by inner product."""
    spark = vectors.sparkSession
    rows, asked = usable(vectors, key, column), usable(queries, key, column)
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("count"), F.max(square).alias("longest")).orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], RESULT)
    dim = sizes[0].d
    rows, asked = rows.filter(F.size("x") == dim), asked.filter(F.size("x") == dim)
    total, n_asked, longest = sizes[0]["count"], asked.count(), sizes[0].longest ** 0.5
    table = spark.sparkContext.broadcast(pivot_table(rows, pivots, total))
    n_shards, n_groups = max(1, -(-total // shard)), max(1, -(-n_asked // QUERIES))
    dealt = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = rows.select(dealt(n_shards, 0).alias("shard"), every(n_groups).alias("part"), F.lit(0).alias("kind"), "id", "x")
    sent = asked.select(every(n_shards).alias("shard"), dealt(n_groups, 1).alias("part"), F.lit(1).alias("kind"), "id", "x")
    met = mine.unionByName(sent).repartition(max(1, min(n_shards * n_groups, 10_000)), "shard", "part").sortWithinPartitions("shard", "part", "kind", "id")

    def run(batches):
        pv = table.value
        at, have, held = None, [], [[], []]

        def search():
            """The queries that were held, against the shard that was read."""
            if held[0] and have:
                ids, x = (np.concatenate(c) for c in zip(*have))
                got = search_shard(ids, x, np.concatenate(held[0]), np.concatenate(held[1]), pv, longest, min(depth, len(pv)), share, k)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(got, (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], names=["query_id", "rank", "vec_id", "score"])
            held[0].clear()
            held[1].clear()

        for batch in batches:
            place, kind = (np.column_stack([batch.column(i).to_numpy() for i in cols]) for cols in ((0, 1), (2,)))
            ids = batch.column(3).to_numpy().astype(np.int64)
            x = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dim).astype(np.float64)
            key = np.column_stack([place, kind])
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(ids)] if len(ids) else [0, 0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if at != tuple(place[a]):
                    yield from search()
                    at, have = tuple(place[a]), []
                if kind[a, 0] == 0:
                    have.append((ids[a:b], x[a:b]))
                    continue
                for i in range(a, b, block):
                    held[0].append(ids[i : min(b, i + block)])
                    held[1].append(x[i : min(b, i + block)])
                    if sum(map(len, held[0])) >= block:
                        yield from search()
        yield from search()

    found = met.select("shard", "part", "kind", "id", "x").mapInArrow(run, RESULT)
    # queries are spread by id: each has at most k rows of each shard
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.drop("rank").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
