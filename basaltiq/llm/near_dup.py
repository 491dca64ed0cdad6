"""Near-duplicates by Order MinHash, verified by bounded alignment.

A text's k-mers are its windows of `k` (5) words; each is labelled with its
occurrence number, so repeats count. For each of `sketches` hash functions the
two least labelled k-mers are kept in the order in which they stand in the
text: a key that is sensitive to edits and not just to the set of k-mers. The
least k-mer alone is a second key, of these `sketches` functions and `singles`
more, which finds links near the bound.
Texts that share a key are candidates. A bucket of candidates is a star, each
member against one leader, so links grow with the rows of a bucket and not
with their square: the least text of a bucket leads, and in the finer buckets of
two keys together a hashed leader. Each text is first held against the leader
with which it shares the most keys; the other candidates are verified only if
the classes of those links don't join them already. Candidates are verified by word-level edit distance
up to a bound: linked if 1 - distance / length of the longer text is at least 0.8.
Classes are the components of the links, by min-label propagation with pointer
jumping over distributed tables; joins on a vertex with many links are salted.

What is linked is a distinct text, not an id: each has a vertex number, its
least id, or a hash where several texts have that id in common. A leader's text is shipped once for every CHUNK of its members.

Cases: equal texts are one class before any sketch; null texts link to
nothing, each is its own class; empty texts are equal texts. Texts of fewer
than k words have one k-mer, all their words; texts of any length are taken whole,
their k-mers in blocks. Words are runs of word
characters in lower case. Rows with null key have class null. An id with
several texts has a row of its own, and a class, for each of them. Ties go to the
smaller id. Columns other than text and key are never read. An empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, cut, held, salted

WORD = re.compile(r"\w+")
#: fixed values: odd multipliers
M1, M2, M3, M4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
BROADCAST_ROWS = 400_000  # of 24 bytes each


def mix(x):
    x = (x ^ (x >> np.uint64(30))) * M3
    x = (x ^ (x >> np.uint64(27))) * M4
    return x ^ (x >> np.uint64(31))


#: bytes of ASCII word characters, and all bytes of others, which only words hold when their hashes are made
WORD_BYTE = np.array([chr(c).isalnum() or c == 95 or c > 127 for c in range(256)])
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(M1), -1, 1 << 64))
        _powers[:] = [np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size, x)))) for x in (M1, inverse)]
    return _powers[0][:n], _powers[1][:n]


def plain(text: str | None) -> bytes:
    """The words of a text in bytes, with anything but word bytes between them."""
    t = (text or "").lower()
    return t.encode() if t.isascii() else " ".join(WORD.findall(t)).encode("utf-8", "surrogatepass")


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the bytes, and where it begins."""
    inside = np.concatenate(([False], WORD_BYTE[raw], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, after = edge[::2], edge[1::2]
    up, down = powers(len(raw))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)))
    return mix((sums[after] - sums[first]) * (down[first] if len(first) else first.astype(np.uint64)) + (after - first).astype(np.uint64) * M2), first


def hashed(text: str) -> np.ndarray:
    """The hashed words of a text."""
    raw = plain(text)
    step = 1 << 20
    if len(raw) <= step:
        return word_hashes(np.frombuffer(raw, np.uint8))[0]
    # a very long text goes in pieces that end between words
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + step)
        while end < len(raw) and WORD_BYTE[raw[end]] and WORD_BYTE[raw[end - 1]]:
            end += 1
        out.append(word_hashes(np.frombuffer(raw[at:end], np.uint8))[0])
        at = end
    return np.concatenate(out)


def labelled(words: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-mers of texts laid end to end, of `sizes` words each, every k-mer with its occurrence number in its text, and how many each text has."""
    count = np.where(sizes > 0, np.maximum(1, sizes - k + 1), 0)
    begin = np.cumsum(sizes) - sizes
    at = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    span = np.repeat(np.minimum(sizes, k), count)  # of a short text, all its words are one k-mer
    g = np.zeros(len(at), np.uint64)
    padded = np.concatenate((words, np.zeros(k, np.uint64)))
    short = bool((sizes[sizes > 0] < k).any())
    for j in range(k):
        step = g * M1 + padded[at + j]
        g = np.where(j < span, step, g) if short else step
    g = mix(g)
    # equal k-mers of one text are neighbours in this order
    key = g ^ mix(np.repeat(np.arange(len(sizes), dtype=np.uint64), count))
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    if not new.all():
        place = np.arange(len(key))
        times = place - np.maximum.accumulate(np.where(new, place, 0))
        again = times > 0
        g[order[again]] = mix(g[order[again]] + times[again].astype(np.uint64) * M2)  # first occurrences keep their hash, whether or not a text has repeats
    return g, count


def seeds_of(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * M2)


def order_min_hash(g: np.ndarray, count: np.ndarray, seeds: np.ndarray, ordered: int) -> np.ndarray:
    """A row of keys for each text with k-mers: the least k-mer under each seed, and after these, for the first `ordered` seeds, the two least k-mers in text order."""
    count = count[count > 0]
    begin = np.cumsum(count) - count
    out = np.empty((len(count), len(seeds) + ordered), np.uint64)
    several = count > 1
    top = np.uint64(0xFFFFFFFFFFFFFFFF)

    def places(v, least):
        """Where each text has its least value."""
        hit = np.flatnonzero(v == np.repeat(least, count))
        return hit[np.searchsorted(hit, begin)]

    for j, seed in enumerate(seeds):
        v = g * (seed | np.uint64(1))  # an odd multiplier permutes the hashes
        one = np.minimum.reduceat(v, begin)
        out[:, j] = mix(mix(one) ^ seed)
        if j < ordered:
            p = places(v, one)
            v[p] = top
            two = np.minimum.reduceat(v, begin)
            q = places(v, two)
            a, b = np.where(p < q, one, two), np.where(p < q, two, one)
            key = mix(mix(np.where(several, a, one)) * M1 + np.where(several, b, np.uint64(0)))
            out[:, len(seeds) + j] = mix(key ^ seed)
    return out.view(np.int64)


def sketch(docs: DataFrame, k: int, sketches: int, singles: int) -> DataFrame:
    """id, th, n (words) and keys of each row of docs (id, t, th)."""
    seeds = seeds_of(sketches + singles)

    def run(batches):
        for batch in batches:
            n, keys = [], []

            def done(held):
                sizes = np.array([len(w) for w in held], np.int64)
                g, count = labelled(np.concatenate(held), sizes, k)
                made = iter(order_min_hash(g, count, seeds, sketches).tolist() if len(g) else [])
                n.extend(sizes.tolist())
                keys.extend(next(made) if c else [] for c in count.tolist())

            held, words = [], 0
            for t in batch.column(1):
                held.append(hashed(t.as_py() or ""))
                words += len(held[-1])
                if words > 1 << 15:
                    done(held)
                    held, words = [], 0
            if held:
                done(held)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "th", "n", "keys"])

    return docs.select("id", "t", "th").mapInArrow(run, "id long, th binary, n long, keys array<long>")


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of two sequences if it is at most `most`, else most + 1.

    Equal ends are cut off; the rest goes by columns of bits (Myers, Hyyro),
    until the distance can't come down to `most` any more.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    p = int(np.argmin(np.append(a[: min(n, m)] == b[: min(n, m)], False)))
    a, b = a[p:], b[p:]
    n, m = n - p, m - p
    c = min(n, m)
    if c:
        s = int(np.argmin(np.append(a[n - c :][::-1] == b[m - c :][::-1], False)))
        a, b, n, m = a[: n - s], b[: m - s], n - s, m - s
    if n == 0 or m == 0:
        return max(n, m)
    # bit-parallel: column j of the table as vertical differences, one bit for each word of a
    at: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << i
    mask, top, d = (1 << n) - 1, 1 << (n - 1), n
    up, down = mask, 0
    for j, y in enumerate(b.tolist()):
        eq = at.get(y, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | (mask & ~(xh | up)), up & xh
        if ph & top:
            d += 1
        elif mh & top:
            d -= 1
        if d - (m - 1 - j) > most:  # each word left takes off one at most
            return most + 1
        ph = ph << 1 | 1
        up, down = (mh << 1 | ~(xv | ph)) & mask, ph & xv & mask
    return min(d, most + 1)


def chained(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray) -> int:
    """An upper bound of the edit distance of x and y: the cost of an alignment through pairs of places (px, py) with equal words."""
    order = np.argsort(px)
    px, py = px[order], py[order]
    rising = py > np.concatenate(([-1], np.maximum.accumulate(py)[:-1])) if len(py) else np.zeros(0, bool)
    px, py = np.concatenate(([-1], px[rising], [len(x)])), np.concatenate(([-1], py[rising], [len(y)]))
    a, b = np.diff(px) - 1, np.diff(py) - 1
    even = a == b
    at = np.repeat(np.flatnonzero(even), a[even])  # words between two pairs of places on one diagonal are compared in turn
    i = np.arange(len(at)) - np.repeat(np.cumsum(a[even]) - a[even], a[even]) + 1
    return int(np.maximum(a, b)[~even].sum() + (x[px[at] + i] != y[py[at] + i]).sum())


def similar(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether the edit similarity of two arrays of hashed words is at least `least`: bounds from both sides come first, the band decides what they leave open."""
    if not len(x) or not len(y):
        return len(x) == len(y)
    most = int((1 - least) * max(len(x), len(y)) + 1e-9)
    if abs(len(x) - len(y)) > most:
        return False
    # words of one that the other lacks bound the distance from below
    u, at = np.unique(np.concatenate((x, y)), return_inverse=True)
    cx, cy = np.bincount(at[: len(x)], minlength=len(u)), np.bincount(at[len(x) :], minlength=len(u))
    bag = cx - cy
    if max(bag[bag > 0].sum(), -bag[bag < 0].sum()) > most:
        return False
    # words that each has once bound it from above
    once = (cx == 1) & (cy == 1)
    px, py = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
    px[at[: len(x)]], py[at[len(x) :]] = np.arange(len(x)), np.arange(len(y))
    return chained(x, y, px[once], py[once]) <= most or banded_distance(x, y, most) <= most


def verified(edges: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The edges (a, b), a the leader, whose texts are similar; texts (u, id, th, t) with one row for each vertex u.

    A chunk is a leader's text and, after it, up to about CHUNK members, so that a hot leader is many tasks' work.
    """
    hot = edges.groupBy(F.col("a").alias("hot")).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")).filter("chunks > 1")
    member = edges.join(hot, F.col("a") == F.col("hot"), "left").select(F.col("b").alias("v"), F.col("a").alias("lead"), F.coalesce(F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int"), F.lit(0)).alias("chunk"), F.lit(1).alias("kind"))
    member = cut(member)
    roles = member.unionByName(member.select("lead", "chunk").distinct().select(F.col("lead").alias("v"), "lead", "chunk", F.lit(0).alias("kind")))
    if 2 * member.count() <= BROADCAST_ROWS:
        roles = F.broadcast(roles)  # of checked size
    parted = texts.select("u", "t").join(roles, F.col("u") == F.col("v")).select("lead", "chunk", "kind", "v", "t")

    def run(batches):
        at = first = None
        for batch in batches:
            out_a, out_b = [], []
            for lead, chunk, kind, v, t in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if kind == 0:
                    at, first = (lead, chunk), hashed(t)
                elif at == (lead, chunk) and similar(first, hashed(t), least):
                    out_a.append(lead)
                    out_b.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return parted.repartition("lead", "chunk").sortWithinPartitions("lead", "chunk", "kind").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """v, c: the least vertex of the component of each vertex of the edges (a, b)."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = cut(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("c")))
    while True:
        near = salted(both, label, "b", "v", "a").groupBy("a").agg(F.min("c").alias("m"))
        step = cut(label.join(near, F.col("v") == F.col("a"), "left").select("v", F.col("c").alias("old"), F.least("c", F.coalesce("m", "c")).alias("c")))
        up = step.select(F.col("v").alias("u"), F.col("c").alias("d"))
        new = cut(salted(step, up, "c", "u", "v", "left").select("v", "old", F.least("c", F.coalesce("d", "c")).alias("c")))
        label = new.select("v", "c")
        if new.filter("c < old").isEmpty():
            return label


def stars(buckets: DataFrame, leader) -> DataFrame:
    """Edges from the leader a of each bucket of key to its members b (u, n), where lengths allow similarity."""
    lead = buckets.groupBy("key").agg(leader.alias("lead"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("key", F.col("lead.u").alias("a"), F.col("lead.n").alias("m"))
    return buckets.join(lead, "key").filter("u != a").select("a", F.col("u").alias("b"), F.least("n", "m").alias("short"), F.greatest("n", "m").alias("long"))


def grouped(docs: DataFrame, text: str, key: str, k: int, sketches: int, singles: int, least: float):
    """The rows as (id, th: digest of the text, null for null texts), and of each distinct text with an id: th, id (least), u (vertex), c (least vertex of its class), links; and whether some id has several texts."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t")).withColumn("th", F.unhex(F.md5(F.col("t").cast("binary"))))
    first = held(sketch(rows, k, sketches, singles))
    reps = first.filter("th is not null and id is not null").groupBy("th").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    reps = held(reps)
    several = held(reps.groupBy(F.col("id").alias("several")).count().filter("count > 1").select("several"))
    clash = not several.isEmpty()
    reps = reps.withColumn("u", F.col("id")) if not clash else reps.join(several, F.col("id") == F.col("several"), "left").withColumn("u", F.when(F.col("several").isNull(), F.col("id")).otherwise(F.xxhash64("th", "id"))).drop("several")
    slim = reps.filter(F.size("keys") > 0).select("u", "n", "keys")
    near = F.col("short") >= F.col("long") * least - 1e-9
    texts = rows.filter("t is not null and id is not null")
    if clash:
        names = reps.select(F.col("th").alias("x"), F.col("id").alias("i"), "u")
        texts = texts.join(names, (F.col("th") == F.col("x")) & (F.col("id") == F.col("i"))).select("u", "t")
    else:
        texts = texts.withColumn("u", F.col("id"))

    each = slim.select("u", "n", F.posexplode("keys").alias("p", "x")).select("u", "n", F.xxhash64("p", "x").alias("key"))
    one = cut(stars(each, F.min(F.struct("u", "n"))).filter(near).groupBy("a", "b").agg(F.count(F.lit(1)).alias("keys")))
    # each member against the leader with which it shares the most keys; its other leaders only if they are of other classes
    best = cut(one.groupBy("b").agg(F.min_by("a", F.struct(-F.col("keys"), "a")).alias("a")).select("a", "b"))
    links = cut(verified(best, texts, least).distinct())
    label = components(links)

    n = sketches + singles
    pairs = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda p: F.xxhash64(p, F.get("keys", p), F.get("keys", (p + 1) % n)))
    fine = slim.select("u", "n", F.explode(pairs).alias("key"))
    led = stars(fine, F.min_by(F.struct("u", "n"), F.xxhash64("key", "u"))).filter(near).select("a", "b").union(one.select("a", "b"))
    led = led.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.max(F.struct("a", "b")).alias("e")).select("e.a", "e.b")
    for end in ("a", "b"):
        named = label.select(F.col("v").alias(f"v{end}"), F.col("c").alias(f"c{end}"))
        led = led.join(named, F.col(end) == F.col(f"v{end}"), "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    two = cut(led.filter("ca != cb").select("a", "b").join(best, ["a", "b"], "left_anti"))
    more = cut(verified(two, texts, least).distinct())
    if not more.isEmpty():
        links = cut(links.union(more))
        # the further links join classes: their components are those of the graph of classes
        known = label.unionByName(more.select(F.explode(F.array("a", "b")).alias("v")).distinct().join(label.select("v"), "v", "left_anti").withColumn("c", F.col("v")))
        joins = more
        for end in ("a", "b"):
            joins = joins.join(known.select(F.col("v").alias(f"v{end}"), F.col("c").alias(f"c{end}")), F.col(end) == F.col(f"v{end}"))
        joined = components(joins.select(F.col("ca").alias("a"), F.col("cb").alias("b")).filter("a != b")).select(F.col("v").alias("w"), F.col("c").alias("d"))
        label = cut(salted(known, joined, "c", "w", "v", "left").select("v", F.coalesce("d", "c").alias("c")))
    degree = links.select(F.explode(F.array("a", "b")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("links"))
    of = label.join(degree, F.col("v") == F.col("w"))
    texts_of = reps.select("th", "id", "u").join(of, F.col("u") == F.col("v"), "left").select("th", "id", "u", F.coalesce("c", "u").alias("c"), F.coalesce("links", F.lit(0)).alias("links"))
    return first.select("id", "th"), texts_of, clash


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 5, sketches: int = 12, singles: int = 12, least: float = 0.8) -> DataFrame:
    """key, class_id (the least key of its class) and n_links (links of its text to other texts that were verified) of each row."""
    rows, texts, clash = grouped(docs, text, key, k, sketches, singles, least)
    if clash:  # a vertex number may be a hash: the least id of each class is looked up
        least_id = texts.groupBy(F.col("c").alias("cc")).agg(F.min("id").alias("class_id"))
        texts = texts.join(least_id, F.col("c") == F.col("cc"))
    else:
        texts = texts.withColumn("class_id", F.col("c"))
    texts = texts.select(F.col("th").alias("x"), "class_id", "links")
    # rows with equal texts may be many: the join on the digest is salted
    out = salted(rows.filter("th is not null"), texts, "th", "x", "id", "left").select("id", "class_id", "links")
    out = out.unionByName(rows.filter("th is null").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("links")))
    return out.select(F.col("id").alias(key), F.when(F.col("id").isNull(), None).otherwise(F.coalesce("class_id", "id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 5, sketches: int = 12, singles: int = 12, least: float = 0.8) -> DataFrame:
    """docs with one row of each class, that of its least vertex; rows with null key, and with null text, stay.

    A row goes by its id and the digest of its text together, so an id with several texts loses only those that are copies.
    """
    rows, texts, _ = grouped(docs, text, key, k, sketches, singles, least)
    rows = rows.filter("th is not null and id is not null")
    about = texts.select(F.col("th").alias("x"), F.col("id").alias("kept"), (F.col("u") != F.col("c")).alias("copy"))
    mine = salted(rows, about, "th", "x", "id")
    gone = cut(mine.filter("copy or id != kept").select(F.col("id").alias("_gi"), F.col("th").alias("_gt")).distinct())
    twice = cut(rows.groupBy(F.col("id").alias("_gi"), F.col("th").alias("_gt")).count().filter("count > 1").select("_gi", "_gt"))
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)  # of checked size
    digest = F.unhex(F.md5(docs[text].cast("string").cast("binary")))
    this = lambda other: (docs[key].cast("long") == other["_gi"]) & (digest == other["_gt"])
    left = docs.join(gone, this(gone), "left_anti")
    if twice.isEmpty():
        return left
    return left.join(twice, this(twice), "left_anti").unionByName(left.join(twice, this(twice), "left_semi").dropDuplicates([key, text]))
