import random
from collections import defaultdict

import numpy as np
from basaltiq.llm import near_dup as N
from hypothesis import given, settings
from hypothesis import strategies as st


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=25), st.integers(0, 25))
def test_banded_distance(a, b, most):
    assert N.banded_distance(np.array(a), np.array(b), most) == min(plain_distance(a, b), most + 1)


def edit(rng, words, rate):
    out = []
    for w in words:
        x = rng.random()
        if x < rate / 3:
            continue
        out.append(f"new{rng.randint(0, 999)}" if x < 2 * rate / 3 else w)
        if 2 * rate / 3 <= x < rate:
            out.append(f"add{rng.randint(0, 999)}")
    return out


def data():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    rows, groups = [], {}
    passage = [word() for _ in range(60)]
    for g in range(40):
        base = [word() for _ in range(rng.randint(60, 400))]
        for c in range(rng.choice([1, 1, 2, 5])):
            i = len(rows)
            rows.append((i, " ".join(edit(rng, base, 0.03) if c else base)))
            groups[i] = g
    for _ in range(30):  # share a passage, nothing else
        i = len(rows)
        rows.append((i, " ".join([word() for _ in range(80)] + passage + [word() for _ in range(80)])))
        groups[i] = f"alone{i}"
    return rows, groups


def kmers(words):
    w = N.hashed(" ".join(words))
    return N.labelled(w, np.array([len(w)]), 5)[0]


def keys(words, seeds, ordered=12):
    g = kmers(words)
    return N.order_min_hash(g, np.array([len(g)]), seeds, ordered)[0].tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aBé_1 .\n-’漢ß", max_size=12), min_size=1, max_size=6))
def test_words_are_those_of_the_pattern(texts):
    """Hashed words are equal where the words are, whatever else the texts hold, and texts sketched together as apart."""
    words = [N.WORD.findall(t.lower()) for t in texts]
    got = [N.hashed(t) for t in texts]
    named = {}
    for w, h in zip(words, got):
        assert len(w) == len(h)
        for x, y in zip(w, h.tolist()):
            assert named.setdefault(x, y) == y
    assert len(set(named.values())) == len(named)
    seeds = N.seeds_of(3)
    g, count = N.labelled(np.concatenate(got), np.array([len(h) for h in got]), 5)
    rows = iter(N.order_min_hash(g, count, seeds, 2).tolist() if len(g) else [])
    for h in got:
        if len(h):
            alone, n = N.labelled(h, np.array([len(h)]), 5)
            assert next(rows) == N.order_min_hash(alone, n, seeds, 2)[0].tolist()


def test_long_texts_hash_as_their_words():
    words = [f"w{i % 1000}" for i in range(400_000)]
    h = N.hashed(" ".join(words))
    assert len(h) == len(words) and len(set(h.tolist())) == 1000 and h[:1000].tolist() == h[399_000:].tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=40), st.lists(st.tuples(st.integers(0, 40), st.integers(0, 2), st.integers(0, 60)), max_size=10), st.sampled_from([0.5, 0.8, 0.9]))
def test_similar_is_the_distance(a, edits, least):
    b = list(a)
    for at, what, word in edits:
        at = min(at, len(b))
        b[at : at + (what != 1)] = [word] if what < 2 else []
    want = (1 - plain_distance(a, b) / max(len(a), len(b))) >= least - 1e-9 if b else not a
    assert N.similar(np.array(a, np.uint64), np.array(b, np.uint64), least) == want


def test_repeats_label_only_later_occurrences():
    words = [f"w{i}" for i in range(300)]
    one, two = (kmers(w) for w in (words, words + words[:20]))
    assert two[: len(one)].tolist() == one.tolist() and len(set(two.tolist())) == len(two)


def test_keys_find_pairs_near_the_bound():
    rng = random.Random(3)
    seeds = N.seeds_of(24)
    found = {}
    for off in (50, 38, 25):
        found[off] = 0
        for _ in range(300):
            one = [f"w{rng.randint(0, 10**9)}" for _ in range(250)]
            two = one.copy()
            for i in rng.sample(range(250), off):
                two[i] = f"v{rng.randint(0, 10**9)}"
            assert N.similar(N.hashed(" ".join(one)), N.hashed(" ".join(two)), 1 - off / 250)
            x, y = keys(one, seeds), keys(two, seeds)
            found[off] += any(p == q for p, q in zip(x, y)) / 300
    print("share of pairs with a common key, by words replaced of 250:", found)
    assert found[50] >= 0.97 and found[38] >= 0.99 and found[25] >= 0.99


def test_classes(documents):
    rows, groups = data()
    extra = [(900, None), (901, None), (902, ""), (903, ""), (904, "one two"), (905, "One, two!"), (906, "!!!"), (907, rows[0][1]), (907, rows[0][1]), (None, rows[0][1])]
    got = defaultdict(list)
    for r in N.classes(documents(rows + extra)).collect():
        got[r.doc_id].append(r.class_id)
    assert all(len(set(v)) == 1 for v in got.values()) and len(got[907]) == 2
    cls = {i: v[0] for i, v in got.items()}
    first = {}
    for i, g in groups.items():
        first.setdefault(g, i)
        assert cls[i] == first[g], (i, g)
    assert cls[900] == 900 and cls[901] == 901 and cls[902] == cls[903] == 902
    assert cls[904] == cls[905] == 904 and cls[906] == 906 and cls[907] == cls[0] and cls[None] is None


def test_links_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: N.hashed(r.text) for r in docs.collect()}
    parent = {i: i for i in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(rows)
    for i in ids:
        for j in ids:
            if i < j and N.similar(rows[i], rows[j], 0.8):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert {r.doc_id: r.class_id for r in N.classes(docs).collect()} == {i: find(i) for i in ids}


def test_keep_one(documents):
    rows, groups = data()
    docs = documents(rows + [(0, rows[0][1]), (None, rows[0][1]), (900, None)])
    out = N.keep_one(docs)
    assert out.columns == docs.columns
    first = {}
    for i, g in groups.items():
        first.setdefault(g, i)
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([*first.values(), None, 900], key=str)


def test_one_id_with_several_texts(documents):
    rng = random.Random(4)
    a, b, c = (" ".join(f"w{rng.randint(0, 10**9)}" for _ in range(80)) for _ in range(3))
    rows = [(5, a), (5, b), (6, c), (4, a), (7, b), (7, b), (8, c + " more")]
    out = sorted((r.doc_id, r.text) for r in N.keep_one(documents(rows)).collect())
    assert out == sorted([(4, a), (5, b), (6, c)])
    got = sorted((r.doc_id, r.class_id) for r in N.classes(documents(rows)).collect())
    assert got == [(4, 4), (5, 4), (5, 5), (6, 6), (7, 5), (7, 5), (8, 6)]


def test_one_large_star(documents):
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 10**9)}" for _ in range(60)]
    rows = [(i, " ".join(base + [f"x{i}"])) for i in range(700)]
    got = N.classes(documents(rows)).collect()
    assert {r.class_id for r in got} == {0} and len(got) == 700


def test_keys_against_plain_code():
    rng = np.random.default_rng(1)
    seeds = N.seeds_of(4)
    count = np.array([5000, 0, 1, 2, 300])
    g = rng.integers(0, 2**63, int(count.sum())).astype(np.uint64)
    rows = N.order_min_hash(g, count, seeds, 2).tolist()
    at = 0
    with np.errstate(over="ignore"):
        for n, row in zip(count[count > 0], rows):
            mine, at = g[at : at + n], at + n
            for j, s in enumerate(seeds):
                v = mine * (s | np.uint64(1))
                assert np.uint64(row[j] % 2**64) == N.mix(N.mix(v.min()) ^ s)
                if j < 2:
                    two = np.sort(np.argsort(v)[:2])
                    key = N.mix(N.mix(v[two[0]]) * N.M1 + (v[two[1]] if n > 1 else np.uint64(0)))
                    assert np.uint64(row[4 + j] % 2**64) == N.mix(key ^ s)


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20, 60)] + [(5, 7), (6, 7)], "a long, b long")
    got = {r.v: r.c for r in N.components(edges).collect()}
    assert got == {5: 5, 6: 5, 7: 5} | {i: 20 for i in range(20, 61)}


def test_empty(documents):
    assert N.classes(documents([])).count() == 0
