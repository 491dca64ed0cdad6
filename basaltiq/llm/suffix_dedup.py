"""Removal of long repeated byte strings by a distributed difference-cover algorithm.

Every byte covered by a string of `length` (200) bytes that also starts
elsewhere, in the same or another text, is removed. Starts are compared by
their first 200 bytes only, so suffixes are sorted to that depth:

1. Two exact filters leave few starts to compare. The hash of a 100-byte gram
   that is least among the grams of a start's window is its anchor; equal
   windows have equal anchors. Neighbouring starts with one anchor form a run,
   whose context is all the bytes of its windows. A run whose anchor occurs in
   no other run has no repeated start; a run whose whole context occurs again
   has only repeated starts. Only one run for each further context goes on.
2. Difference cover: positions i with i mod 3 in {1, 2} are the sample. The
   triples of bytes at sampled positions are sorted and named by their rank; the
   recursion sorts and ranks triples of names, 3, 9 and 27 apart, and last three
   names 60 and 57 apart: names of 3, 9, 27, 81 and 198 bytes, whose order is that of the bytes.
   Equal windows have one anchor and so meet in one task, where the ranks are made.
3. Merge: the remaining suffixes, those of residue 0, are sorted by their byte and
   the rank of the next position, and merged with the sample: any two starts reach sampled
   positions after the same 0, 1 or 2 bytes. The prefixes of neighbours in the
   merged order are compared byte by byte; equal ones are repeated starts.

What the filters settle, by fingerprints of 128 bits (anchor and context), is on check_s 37.4 of
the 47 million starts that lie in runs with a repeated anchor; each start left over goes through the sort.

Runs are shuffled by anchor and streamed in order, never gathered. Anchors that
a bounded sample shows to be frequent are salted; their contexts are counted
with map-side combination, cut to finer runs by anchors of longer grams, and
groups that are still too large for one task are compared in a shuffle by key, where
names are 64-bit fingerprints of triples of triples, as ranks would need all of a group in one place.

Cases: null text is empty: nothing removed. Texts shorter than 200 bytes keep
all. Repeated rows are texts each, so copies of 200 bytes or more are removed
wholly. Very long texts are cut into slices that overlap by 199 bytes; matches
never cross texts. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held, unit_hash

GRAM, FINE_GRAM, WORD = 100, 160, 22
SLICE = 1 << 20
#: fixed values: odd multipliers
M1, M2, M3, M4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
BASE = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M3
    x = (x ^ (x >> np.uint64(27))) * M4
    return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * M1 + (b ^ (b >> np.uint64(29))) * M2)


class Grams:
    """Fingerprints of all windows of a length, by doubling; what is made for one length serves the next."""

    def __init__(self, raw: np.ndarray):
        self.raw, self.parts = raw, {1: (raw.astype(np.uint64) + np.uint64(1)) * M1}

    def double(self, n: int) -> np.ndarray:
        if n not in self.parts:
            p = self.double(n // 2)
            h = n // 2
            a, b = p[:-h], p[h:]
            q = a * M2
            q ^= b + (b >> np.uint64(29))
            q *= M1
            self.parts[n] = q
        return self.parts[n]

    def of(self, n: int) -> np.ndarray:
        """One value for each window of n bytes; n at most the size of the bytes."""
        out, at, count = None, 0, len(self.raw) - n + 1
        for k in reversed(range(n.bit_length())):
            if n >> k & 1:
                piece = self.double(1 << k)[at : at + count]
                out = piece if out is None else out * M4 ^ (piece + (piece >> np.uint64(31)))
                at += 1 << k
        out = out * M1
        out ^= out >> np.uint64(32)
        return out


def least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` neighbours."""
    n, p = 1, x
    while n * 2 <= width:
        p = np.minimum(p[:-n], p[n:])
        n *= 2
    r = width - n
    return np.minimum(p[: len(p) - r], p[r:]) if r else p


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for b in (BASE, inverse):
        p = np.ones(1, np.uint64)
        step = b
        while len(p) < n:
            p = np.concatenate([p, p * np.uint64(step)])
            step = step * step % (1 << 64)
        out.append(p[:n])
    return out[0], out[1]


_table: list = []


def runs_of(raw: bytes, length: int, gram_size: int = GRAM):
    """anchor, context, first start, number of starts, whether two starts of the run may be equal: of each run of one slice."""
    if not _table:
        _table.append(_powers(SLICE + 4096))
    up, down = _table[0]
    g = Grams(np.frombuffer(raw, np.uint8))
    gram = g.of(gram_size)
    anchor = least(gram, length - gram_size + 1)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    after = np.append(first[1:], len(anchor))
    leaf = g.double(8)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(leaf * up[: len(leaf)], dtype=np.uint64)))
    last = after + length - 1 - 7  # leaves of a context end here
    context = mix((total[last] - total[first]) * down[first] + (after - first).astype(np.uint64))
    h = anchor[first]
    # two starts of a run can be equal only if the anchor occurs before its last start
    early = np.concatenate(([0], np.cumsum(gram[: len(anchor)] == anchor)))
    return h, context, first, after - first, early[after - 1] > early[first]


def slices(raw: bytes, length: int):
    """(offset, bytes) with each start in one slice."""
    for at in range(0, max(1, len(raw) - length + 1), SLICE):
        yield at, raw[at : at + SLICE + length - 1]


RUN = "h long, c long, id long, th long, s long, n int, multi boolean"


def runs(docs: DataFrame, length: int) -> DataFrame:
    names = [x.split()[0] for x in RUN.split(", ")]

    def run(batches):
        for batch in batches:
            cols = [[] for _ in names]
            held = 0
            for i, th, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = t.as_buffer()
                if raw is None or raw.size < length:
                    continue
                raw = raw.to_pybytes()
                for at, piece in slices(raw, length):
                    h, c, s, n, multi = runs_of(piece, length)
                    k = len(h)
                    for col, x in zip(cols, (h.view(np.int64), c.view(np.int64), (i, k), (th, k), s + at, n.astype(np.int32), multi)):
                        col.append(x)
                    held += k
                if held > 200_000:
                    yield packed(cols)
                    cols, held = [[] for _ in names], 0
            if held:
                yield packed(cols)

    def packed(cols):
        out = []
        for name, col in zip(names, cols):
            if name in ("id", "th"):
                values = np.repeat(np.array([v or 0 for v, _ in col], np.int64), [k for _, k in col])
                gone = np.repeat([v is None for v, _ in col], [k for _, k in col])
                out.append(pa.array(values, mask=gone))
            else:
                out.append(pa.array(np.concatenate(col)))
        return pa.RecordBatch.from_arrays(out, names=names)

    return docs.select("id", "th", F.col("t").cast("binary")).mapInArrow(run, RUN)


def sift(sorted_runs: DataFrame, hot, batch: int = 50_000) -> DataFrame:
    """From runs in the order (h, c) within partitions: kind 0, wholly repeated; kind 1, to be compared; kind 2, summaries of hot anchors.

    A run's verdict needs its neighbours alone: it is repeated if one of them has its context, and has company if the context before or after has its anchor. So only the
    first and last run of the context that a batch ends in are carried over. k is 2 for any context that occurs more than once.
    """
    schema = "kind int, h long, c long, id long, th long, s long, n int, k long"

    def run(batches):
        import pandas as pd

        frequent = np.array(sorted(hot.value), np.int64)

        def decided(df, company, final):
            """What is known of the runs of df; those of its last context are left over, unless it is the final one."""
            h, c = df["h"].to_numpy(), df["c"].to_numpy()
            at = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (c[1:] != c[:-1]))))
            size = np.diff(np.append(at, len(df)))
            same = h[at][1:] == h[at][:-1]
            company = np.concatenate(([company], same))
            several = company | np.append(same, False)
            done = len(at) if final else len(at) - 1
            upto = len(df) if final else int(at[-1])
            left = df.iloc[upto:]
            again = np.repeat(size > 1, size)
            again[upto:] = False
            if len(left) > 2:  # what lies between is repeated, whatever follows
                again[upto + 1 : len(df) - 1] = True
                left = left.iloc[[0, -1]]
            out = [df[again].assign(kind=0, k=0)]
            heads = df.iloc[at[:done]].assign(k=np.minimum(size[:done], 2))
            is_hot = np.isin(h[at[:done]], frequent)
            out.append(heads[~is_hot & (several[:done] | heads["multi"].to_numpy(bool))].assign(kind=1))
            out.append(heads[is_hot].assign(kind=2))
            both = pd.concat(out)[["kind", "h", "c", "id", "th", "s", "n", "k"]]
            both["kind"] = both["kind"].astype("int32")
            return both, left, bool(company[-1])

        def gathered():
            some, size = [], 0
            for df in batches:
                some.append(df)
                size += len(df)
                if size >= batch:
                    yield some
                    some, size = [], 0
            if some:
                yield some

        carried, company = None, False
        for some in gathered():
            out, carried, company = decided(pd.concat(some if carried is None else [carried, *some], ignore_index=True), company, False)
            yield out
        if carried is not None and len(carried):
            yield decided(carried, company, True)[0]

    return sorted_runs.mapInPandas(run, schema)


def names(raw: np.ndarray) -> np.ndarray:
    """The level-2 name of each position with 198 bytes after it: names of triples of words, then of triples of names."""
    w = Grams(raw).of(WORD)
    span = 3 * WORD
    n1 = len(raw) - span + 1
    one = pair(pair(w[:n1], w[WORD : WORD + n1]), w[2 * WORD : 2 * WORD + n1])
    n2 = len(raw) - 3 * span + 1
    return pair(pair(one[:n2], one[span : span + n2]), one[2 * span : 2 * span + n2])


def keys_of(contexts: list[bytes], first: np.ndarray, count: np.ndarray, anchor: np.ndarray, length: int):
    """Two arrays of keys, one value for each start of the contexts; `first` is a start's place in its text, mod 3 its residue."""
    raw = np.frombuffer(b"".join(contexts) + b"\0\0", np.uint8)
    begin = np.concatenate(([0], np.cumsum(count + length - 1)[:-1]))
    inside = np.arange(int(count.sum())) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count)
    at = np.repeat(begin, count) + inside
    residue = (np.repeat(first, count) + inside) % 3
    name = names(raw)
    edge = lambda k: raw[at + k].astype(np.uint64) + np.uint64(1)
    forms = [pair(name[at], edge(length - 2) << np.uint64(9) | edge(length - 1)), pair(name[at + 1], edge(0) << np.uint64(9) | edge(length - 1)), pair(name[at + 2], edge(0) << np.uint64(9) | edge(1))]
    h = np.repeat(anchor.astype(np.int64).view(np.uint64), count)
    marked = [pair(f ^ np.uint64(0x1234567 * (k + 1)), h) for k, f in enumerate(forms)]
    # after d bytes the position is sampled: d = 0 for residues 1, 2; 1 for 0, 1; 2 for 0, 2
    a = np.where(residue == 0, marked[1], marked[0])
    z = np.where(residue == 1, marked[1], marked[2])
    return a, z


def ranked(high: np.ndarray, low: np.ndarray, span: int) -> np.ndarray:
    """The rank of each pair (high, low) in their sorted order, equal pairs alike; low < span, from 1 on."""
    key = high * np.int64(span) + low
    order = np.argsort(key)
    key = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.concatenate(([True], key[1:] != key[:-1])))
    return out


def sample_ranks(raw: np.ndarray, sampled: np.ndarray, room: np.ndarray) -> np.ndarray:
    """At each of the sampled positions (ascending) that has room for 198 bytes, the rank of these among all such; 0 elsewhere.

    room: bytes from each position to the end of its context.
    """
    wide = np.concatenate((raw, np.zeros(3, np.uint8))).astype(np.int64)
    name = np.zeros(len(raw), np.int64)
    at = sampled[room[sampled] >= 3]
    name[at] = (wide[at] << 16 | wide[at + 1] << 8 | wide[at + 2]) + 1  # sorted as numbers, triples of bytes are their own names
    span = (1 << 24) + 1
    for size, one, two in ((9, 3, 6), (27, 9, 18), (81, 27, 54), (198, 60, 117)):
        at = at[room[at] >= size]
        if not len(at):
            return np.zeros(len(raw), np.int64)
        pair_name = ranked(name[at], name[at + one], span)
        rank = ranked(pair_name, name[at + two], span)
        name = np.zeros(len(raw), np.int64)
        name[at] = rank
        span = int(rank.max()) + 1
    return name


def sorted_starts(contexts: list[bytes], first: np.ndarray, count: np.ndarray, length: int):
    """The bytes of the contexts, the place of every start in them, and the starts in the order of their windows."""
    raw = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = count + length - 1
    begin = np.cumsum(sizes) - sizes
    inside = np.arange(len(raw)) - np.repeat(begin, sizes)
    residue = (np.repeat(first, sizes) + inside) % 3
    room = np.repeat(sizes, sizes) - inside
    rank = sample_ranks(raw, np.flatnonzero(residue > 0), room)
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    place = np.repeat(begin, count) + nth
    kind = residue[place]
    byte = lambda p, k: raw[p + k].astype(np.int64)
    sample, rest = np.flatnonzero(kind > 0), np.flatnonzero(kind == 0)
    p = place[sample]
    sample = sample[np.lexsort((byte(p, length - 2) << 8 | byte(p, length - 1), rank[p]))]
    p = place[rest]
    after_one = lambda q: ((byte(q, 0) << 40 | rank[q + 1]) << 8) | byte(q, length - 1)  # noqa: E731  a byte, a name of 198 bytes, a byte
    after_two = lambda q: (byte(q, 0) << 48 | byte(q, 1) << 40 | rank[q + 2])  # noqa: E731  two bytes, a name of 198 bytes
    key_one, key_two = after_one(p), after_two(p)
    order = np.argsort(key_one, kind="stable")
    rest, key_one, key_two = rest[order], key_one[order], key_two[order]
    # merge: how many of the sample come before each of the rest, by the form that the two residues share
    before = np.zeros(len(rest), np.int64)
    for residue_of, key_of, mine in ((1, after_one, key_one), (2, after_two, key_two)):
        theirs = sample[kind[sample] == residue_of]
        before += np.searchsorted(key_of(place[theirs]), mine)
    merged = np.empty(len(place), np.int64)
    spot = before + np.arange(len(rest))
    taken = np.zeros(len(place), bool)
    taken[spot] = True
    merged[spot], merged[~taken] = rest, sample
    return raw, place, merged


def repeated_starts(contexts, first, count, anchor, length) -> np.ndarray:
    """Whether each start of the contexts has an equal one among them: starts sorted by difference cover, neighbours compared byte by byte."""
    raw, place, order = sorted_starts(contexts, first, count, length)
    hit = np.zeros(len(place), bool)
    for at in range(0, max(0, len(order) - 1), 1 << 14):
        a, b = order[at : at + (1 << 14)][: len(order) - 1 - at], order[at + 1 : at + 1 + (1 << 14)]
        # most neighbours differ; the last bytes of a window and some before tell most of these apart
        same = np.flatnonzero((raw[place[a] + length - 1] == raw[place[b] + length - 1]) & (raw[place[a] + length // 2] == raw[place[b] + length // 2]) & (raw[place[a]] == raw[place[b]]))
        a, b = a[same], b[same]
        window = np.lib.stride_tricks.sliding_window_view(raw, length)
        equal = (window[place[a]] == window[place[b]]).all(axis=1)
        hit[a[equal]] = True
        hit[b[equal]] = True
    return hit


def with_contexts(docs: DataFrame, todo: DataFrame, length: int) -> DataFrame:
    """h, id, th, s, n, k and the context bytes of each run to be compared."""
    per = todo.groupBy("id", "th").agg(F.collect_list(F.struct("h", "s", "n", "k")).alias("runs")).withColumnsRenamed({"id": "i", "th": "x"})
    if todo.count() < 1_000_000:  # 40 bytes a run: at most 40 MB
        per = F.broadcast(per)
    both = docs.select("id", "th", F.col("t").cast("binary").alias("t")).dropna(subset=["t"]).join(per, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("x")))
    # repeated rows have one context each; one is enough
    cut = F.transform("runs", lambda r: F.struct(r.h.alias("h"), r.s.alias("s"), r.n.alias("n"), r.k.alias("k"), F.substring(F.col("t"), r.s.cast("int") + 1, r.n + (length - 1)).alias("b")))
    return both.select("id", "th", F.explode(cut).alias("r")).select("r.h", "id", "th", "r.s", "r.n", "r.k", "r.b")


MARK = "id long, th long, s long, n int"


def spans(hit: np.ndarray):
    """(first, count) of the maximal runs of True."""
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    first = np.flatnonzero(edge == 1)
    return first, np.flatnonzero(edge == -1) - first


def compared(contexts: DataFrame, partitions: int, length: int, chunk: int = 1 << 20) -> DataFrame:
    """Repeated starts of contexts, within whole groups of one anchor."""

    def run(batches):
        rows, held, last = [], 0, None

        def done(rows):
            rows = list({(r[0], r[1], r[2], r[3]): r for r in rows}.values())
            count = np.array([r[4] for r in rows], np.int64)
            first = np.array([r[3] for r in rows], np.int64)
            hit = repeated_starts([r[6] for r in rows], first, count, np.array([r[0] for r in rows], np.int64), length)
            out = [[], [], [], []]
            at = 0
            for r, k in zip(rows, count.tolist()):
                if r[5] <= 1:
                    for s, n in zip(*(x.tolist() for x in spans(hit[at : at + k]))):
                        for col, v in zip(out, (r[1], r[2], r[3] + s, n)):
                            col.append(v)
                at += k
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["id", "th", "s", "n"])

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(7)]
            for r in zip(*cols):
                if held > chunk and r[0] != last:
                    yield done(rows)
                    rows, held = [], 0
                rows.append(r)
                held += len(r[6])
                last = r[0]
        if rows:
            yield done(rows)

    return contexts.repartition(partitions, "h").sortWithinPartitions("h").mapInArrow(run, MARK)


def compared_by_key(contexts: DataFrame, length: int) -> DataFrame:
    """The same for hot anchors: a row for each key of each start, counted with map-side combination."""

    def run(batches):
        for batch in (b.slice(at, 2000) for b in batches for at in range(0, b.num_rows, 2000)):
            cols = [batch.column(i).to_pylist() for i in range(7)]
            count = np.array(cols[4], np.int64)
            first = np.array(cols[3], np.int64)
            pairs = keys_of(cols[6], first, count, np.array(cols[0], np.int64), length)
            starts = np.repeat(first, count) + np.arange(int(count.sum())) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count)
            rep = lambda col: pa.array([v for v, k in zip(col, cols[4]) for _ in range(k)], pa.int64())
            for keys in pairs:
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), rep(cols[1]), rep(cols[2]), pa.array(starts), rep(cols[5])], names=["key", "id", "th", "s", "k"])

    rows = contexts.mapInArrow(run, "key long, id long, th long, s long, k long")
    again = rows.select("key", "id", "th", "s").distinct().groupBy("key").count().filter("count > 1").select("key")
    return rows.filter("k <= 1").join(again, "key").select("id", "th", "s", F.lit(1).alias("n")).distinct()


def finer(contexts: DataFrame, length: int) -> DataFrame:
    """The runs within contexts by anchors of longer grams: h, c, id, th, s, n, k, multi and the bytes of each run's own context."""

    def run(batches):
        for batch in (b.slice(at, 2000) for b in batches for at in range(0, b.num_rows, 2000)):
            out = [[] for _ in range(9)]
            for _, i, th, s, n, k, raw in zip(*(batch.column(j).to_pylist() for j in range(7))):
                for h, c, first, size, multi in zip(*(x.tolist() for x in runs_of(raw, length, FINE_GRAM))):
                    for col, v in zip(out, (h, c, i, th, s + first, size, k, multi, raw[first : first + size + length - 1])):
                        col.append(v)
            wide = lambda col: pa.array(np.array(col, np.uint64).view(np.int64))
            plain = zip(out[2:], (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()))
            yield pa.RecordBatch.from_arrays([wide(out[0]), wide(out[1]), *(pa.array(c, t) for c, t in plain)], names=["h", "c", "id", "th", "s", "n", "k", "multi", "b"])

    return contexts.mapInArrow(run, "h long, c long, id long, th long, s long, n int, k long, multi boolean, b binary")


def compared_hot(contexts: DataFrame, partitions: int, length: int, most: int = 20_000) -> DataFrame:
    """Repeated starts of the contexts of hot anchors, which may be far too many for one task.

    The filters of step 1 again, with longer grams and counts with map-side
    combination; groups of up to `most` contexts that are left are compared in
    one task, larger ones in a shuffle by key.
    """
    rows = held(finer(contexts, length))
    whole = rows.groupBy("h", "c").agg(F.count(F.lit(1)).alias("times"), F.max("multi").alias("multi"), F.min(F.struct("id", "th", "s", "n", "k")).alias("r"))
    again = whole.filter("times > 1").select("h", "c")
    marks = rows.filter("k <= 1").select("h", "c", "id", "th", "s", "n").join(again, ["h", "c"]).select("id", "th", "s", "n")
    groups = whole.groupBy("h").agg(F.count(F.lit(1)).alias("contexts"), F.max("multi").alias("several")).filter("contexts > 1 or several")
    chosen = whole.join(groups, "h").select(F.col("h"), F.col("c"), F.col("r.id").alias("i"), F.col("r.th").alias("x"), F.col("r.s").alias("s"), F.when(F.col("times") > 1, 2).otherwise(F.col("r.k")).alias("k2"), "contexts")
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("x"))
    left = rows.drop("k", "multi").join(chosen, ["h", "c", "s"]).filter(same).select("h", "id", "th", "s", "n", F.col("k2").cast("long").alias("k"), "b", "contexts")
    small, large = (left.filter(f"contexts {op} {most}").drop("contexts") for op in ("<=", ">"))
    return marks.unionByName(compared(small, partitions, length)).unionByName(compared_by_key(large, length))


def frequent_anchors(docs: DataFrame, length: int, total: int, sample: int = 4000, share: float = 0.004, most: int = 20_000) -> dict[int, int]:
    """Anchors in at least `share` of the texts of a bounded sample, and how many runs each has by that sample."""
    drawn = docs.filter(unit_hash("id", "th", seed=5) * total < sample).filter(F.octet_length("t") <= SLICE)
    n = min(total, sample)
    counts = runs(drawn, length).groupBy("h").count().filter(F.col("count") >= max(8, int(share * n)))
    return {r.h: int(r["count"] * max(1.0, total / max(1, n))) for r in counts.orderBy(F.desc("count"), "h").limit(most).collect()}


def repeated(docs: DataFrame, length: int = 200, salt_rows: int = 4000, most: int = 20_000) -> DataFrame:
    """id, th, s, n: runs of n repeated starts from s, of rows of docs (id, th, t).

    A frequent anchor has a salt for about every `salt_rows` runs; groups of more than `most` contexts to be compared go the way of frequent anchors, whether or not the sample showed them.
    """
    if length != 9 * WORD + 2:
        raise ValueError("names are 9 words long, and a window 2 bytes longer")
    spark = docs.sparkSession
    total = docs.count()
    found = frequent_anchors(docs, length, total)
    hot = spark.sparkContext.broadcast(list(found))
    listed = runs(docs, length)
    if found:
        table = spark.createDataFrame([(h, max(2, -(-n // salt_rows))) for h, n in found.items()], "hh long, salts long")  # bounded by `most`
        listed = listed.join(F.broadcast(table), F.col("h") == F.col("hh"), "left")
        listed = listed.withColumn("salt", F.when(F.col("hh").isNotNull(), F.pmod(F.xxhash64("id", "th"), F.col("salts"))).otherwise(0)).drop("hh", "salts")
    else:
        listed = listed.withColumn("salt", F.lit(0).cast("long"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    kinds = held(sift(listed.repartition(parts, "h", "salt").sortWithinPartitions("salt", "h", "c", "id", "th", "s"), hot))
    marks = kinds.filter("kind = 0").select("id", "th", "s", "n")
    todo = kinds.filter("kind = 1").select("h", "id", "th", "s", "n", "k")
    large = held(todo.groupBy(F.col("h").alias("lh")).count().filter(F.col("count") > most).select("lh"))
    left = []
    if not large.isEmpty():
        left.append(todo.join(large, F.col("h") == F.col("lh")).drop("lh"))
        todo = todo.join(large, F.col("h") == F.col("lh"), "left_anti")
    marks = marks.unionByName(compared(with_contexts(docs, todo, length), parts, length))
    if found:
        summed = kinds.filter("kind = 2")
        whole = summed.groupBy("h", "c").agg(F.sum("k").alias("k"), F.min(F.struct("id", "th", "s", "n")).alias("r"))
        single = summed.filter("k = 1").select("h", "c", "id", "th", "s", "n").join(whole.filter("k > 1").select("h", "c"), ["h", "c"]).select("id", "th", "s", "n")
        marks = marks.unionByName(single)
        left.append(whole.select("h", "r.id", "r.th", "r.s", "r.n", "k"))
    for rest in left:
        marks = marks.unionByName(compared_hot(with_contexts(docs, rest, length), parts, length, most))
    return marks


def covered(starts, length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by windows of `length` bytes at the given (first, count) runs of starts."""
    out: list[list[int]] = []
    for s, n in sorted(starts):
        e = s + n - 1 + length
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def remove(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = 200, with_kept: bool = True) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 and, unless told otherwise, kept (the remaining bytes) of each row."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(t, F.length(t)).alias("th"), t.alias("t"))
    marks = repeated(rows, length)
    # neighbouring runs of a text are joined before they are gathered
    order = Window.partitionBy("id", "th").orderBy("s", "n")
    reach = F.max(F.col("s") + F.col("n") + (length - 1)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    joined = marks.withColumn("new", F.when(F.col("s") <= reach, 0).otherwise(1)).withColumn("g", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = joined.groupBy("id", "th", "g").agg(F.min("s").alias("b"), F.max(F.col("s") + F.col("n") + (length - 1)).alias("e"))
    per = held(ranges.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("b", "e"))).alias("ranges")).withColumnsRenamed({"id": "i", "th": "x"}))
    if (per.select(F.sum(F.size("ranges") * 16 + 32)).first()[0] or 0) < 48 << 20:
        per = F.broadcast(per)  # of checked size
    both = rows.join(per, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("x")), "left")

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(5)]
            for t, ranges in zip(batch.column(1), batch.column(2).to_pylist()):
                raw = t.as_py()
                kept, at = [], 0
                for r in ranges or []:
                    kept.append(raw[at : r["b"]])
                    at = r["e"]
                kept = b"".join([*kept, raw[at:]])
                for col, v in zip(out, (len(raw), len(raw) - len(kept), len(ranges or []), hashlib.sha256(kept).hexdigest(), kept if with_kept else None)):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = both.select("id", F.col("t").cast("binary"), "ranges").mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return (done if with_kept else done.drop("kept")).withColumnRenamed("id", key)
