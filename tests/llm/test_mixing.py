import re
from collections import defaultdict

from basaltiq.llm import mixing as M
from pyspark.sql import functions as F


def word_count(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def fill(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
        free -= set(over)
    return target


def rows():
    out = []
    for i in range(400):
        source = [None, "a", "b", "ü", "z", "B"][i % 6] if i % 3 else "b"
        out.append((i, "w x \x0b" * (i * 7 % 90), "en", source))
    return out + [(400, None, "en", "empty"), (401, "", "en", "a"), (402, "word " * 30_000, "en", "z"), (5, "again " * 40, "en", "a"), (5, "again " * 40, "en", "a"), (None, "no id", "en", None), (403, "tiny", "en", "small")]


def test_targets_and_taken(documents):
    data = rows()
    got = M.mix(documents(data)).collect()
    assert len(got) == len(data)
    assert sorted(((r.doc_id, r.size) for r in got), key=str) == sorted(((i, word_count(t)) for i, t, *_ in data), key=str)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, _, s in data:
        sizes[s] += word_count(t)
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
    want = fill(sizes)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 64, (s, taken[s], want[s])


def test_reruns_agree(documents):
    once, twice = (sorted(map(str, M.mix(documents(d)).collect())) for d in (rows(), rows()[::-1]))
    assert once == twice


def test_permutation(spark):
    for n in (1, 2, 3, 17, 256, 1000):
        out = spark.range(n).select(M.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(7), F.lit(1)).alias("p")).collect()
        assert sorted(r.p for r in out) == list(range(n))


def test_slots(documents):
    plan = M.targets(M.sizes(documents(rows())))
    slots = M.slots(plan, shard_slots=50, chunk=100).collect()
    quota = {r.sid: (r.slots, r.blocks) for r in plan.collect()}
    for sid, (n, blocks) in quota.items():
        mine = [s for s in slots if s.sid == sid]
        assert len(mine) == n and len({(s.epoch, s.block) for s in mine}) == n
        assert all(0 <= s.block < blocks and s.epoch < 3 for s in mine)
    drawn = {(r.shard, r.sid): r.n for r in M.draws(plan, shard_slots=50, chunk=100).collect()}
    found = defaultdict(int)
    for s in slots:
        found[s.shard, s.sid] += 1
        assert s.epoch == s.slot // quota[s.sid][1]
    assert found == drawn
    sizes = defaultdict(int)
    for (shard, _), n in drawn.items():
        sizes[shard] += n
    total = sum(n for n, _ in quota.values())
    assert sorted(sizes.values()) == sorted([50] * (total // 50) + [total % 50] * (total % 50 > 0))
    # slots of a source are numbered through its shards
    for sid in quota:
        mine = sorted((s.slot, s.shard) for s in slots if s.sid == sid)
        assert [x for x, _ in mine] == list(range(len(mine))) and [y for _, y in mine] == sorted(y for _, y in mine)


def test_counts_of_shards_are_multinomial(spark):
    plan = spark.createDataFrame([(0, 4000, 4000), (1, 12000, 12000), (2, 4000, 4000)], "sid int, blocks long, slots long")
    counts = defaultdict(list)
    for r in M.draws(plan, shard_slots=100).collect():
        counts[r.sid].append(r.n)
    for sid, p in ((0, 0.2), (1, 0.6), (2, 0.2)):
        n, v = counts[sid], 100 * p * (1 - p)
        assert sum(n) == 20000 * p and len(n) == 200
        spread = sum((x - 100 * p) ** 2 for x in n) / len(n)
        assert 0.7 * v < spread < 1.4 * v  # of 200 shards: a standard error of a tenth


def test_remix(documents):
    data = rows()
    docs = documents(data)
    out = M.remix(docs)
    assert out.columns == docs.columns
    emitted, taken, texts = defaultdict(int), defaultdict(int), defaultdict(set)
    for i, t, *_ in data:
        texts[i].add(t)
    for r in out.collect():
        emitted[r.doc_id, r.source] += word_count(r.text)
        whole = [t for t in texts[r.doc_id] if t and set(r.text.split()) <= set(t.split())]
        assert whole and min(map(len, whole)) <= max(map(len, whole)) and len(r.text) <= max(map(len, whole))
    for r in M.mix(docs).collect():
        taken[r.doc_id, r.source] += r.taken
    assert dict(emitted) == {k: v for k, v in taken.items() if v}


def test_remix_takes_words_of_blocks(documents):
    data = [(i, "  " + " \n".join(f"w{i}_{j}" for j in range(300)) + " ", "en", "ab"[i % 2]) for i in range(40)]
    out = defaultdict(list)
    for r in M.remix(documents(data), weights=(5, 1)).collect():
        out[r.doc_id].append(r.text)
    at = {}
    for i, t, *_ in data:
        for text in out[i]:
            if text != t:
                numbers = [int(w.split("_")[1]) for w in text.split()]
                assert numbers == sorted(set(numbers)) and all(w.startswith(f"w{i}_") for w in text.split())
                assert all(f"w{i}_{n} \n" in t or n == 299 for n in numbers)
                at[i] = numbers
    assert at


def test_remix_meets_targets_with_long_texts(documents):
    data = [(i, "word " * (640 + i % 7 * 100), "en", "abc"[i % 3]) for i in range(2400)]
    sizes, out = defaultdict(int), defaultdict(int)
    for _, t, _, s in data:
        sizes[s] += word_count(t)
    for r in M.remix(documents(data)).select("source", "text").collect():
        out[r.source] += word_count(r.text)
    want = fill(sizes)
    assert min(want[s] / sizes[s] for s in sizes) < 0.4
    for s in sizes:
        assert abs(out[s] - want[s]) <= 64, (s, out[s], want[s])


def test_empty(documents):
    assert M.mix(documents([])).count() == 0
    got = M.mix(documents([(1, None), (2, " ")])).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
