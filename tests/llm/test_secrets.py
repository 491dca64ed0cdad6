import hashlib
import importlib.util
import math
import pkgutil
import random
import re
import sys
import time

from basaltiq.llm import secrets as S
from basaltiq.llm.queries import op8_secrets
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def texts():
    rng = random.Random(5)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    b64 = lambda n: "".join(rng.choice(S.ENCODINGS[64][0]) for _ in range(n))
    out = [None, "", "nothing here", f'token = "{hexa(40)}"', "é🙂 PassWord: 'hunter22' ß", "password=abc token=abcdefg", "secret=token:abcdefgh", "token=a=secret=api_key=xyzxyz", "API_KEY = x", "apikey:" + " " * 9 + "123456", "AKIA" + "A" * 15, "AKIA" + "B" * 16 + "AKIA" + "9" * 30, "xAKIAAKIA" + "Z" * 16, hexa(23), hexa(24) + "z" + hexa(30), hexa(24) + "Z" + hexa(64), f"🙂 {hexa(32)} 🙂 {hexa(32)}", "deadbeef" * 4000]
    out += [f"see {b64(40)} and {b64(64)}= end" for _ in range(20)]
    out += ["erberbeeinheitkeiterundweiterimmer", "THISISAVERYLONGWORDINUPPERCASELETTERS", "some_long_identifier_name_of_a_function", "a" * 50, "ab" * 40, "=" * 40]
    return out


def test_base_spans_and_counts(spark, documents, monkeypatch):
    rows = [*enumerate(texts()), (3, texts()[3]), (None, "token: abcdefgh")]
    docs = documents(rows)
    monkeypatch.setattr("basaltiq.llm.queries.table", lambda *_: docs)
    got = op8_secrets(spark, "").collect()
    assert len(got) == len(rows)
    want = sorted(((i, *(sum(s[1] == k for s in base(t)) for k in range(3)), hashlib.sha256(",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in base(t)).encode()).hexdigest()) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got), key=str) == want


def test_random_runs(documents):
    rows = list(enumerate(texts()))
    spans = {r.doc_id: r.spans for r in S.scan(documents(rows)).collect()}
    plain = [i for i, t in rows if t and t[0] in "etTsaA=" and "see" not in t]
    with_random = [i for i, t in rows if t and t.startswith("see ")]
    flagged = sum(sum(s.kind == 3 for s in spans[i]) for i in with_random)
    assert flagged >= 0.9 * 2 * len(with_random)
    for i in plain:
        assert not any(s.kind == 3 for s in spans[i]), rows[i]
    for i, t in rows:  # base spans stay
        assert [(s.start, s.kind, s.end) for s in spans[i] if s.kind < 3] == base(t)


def test_long_random_runs_are_found_among_words(documents):
    rng = random.Random(11)
    words = [("".join(rng.choice(["ein", "heit", "lich", "ung", "keit", "der", "ver", "gang"]) for _ in range(9)))[: rng.randint(20, 23)] for _ in range(1500)]
    long = ["".join(rng.choices(S.ENCODINGS[64][0], k=n)) for n in (400, 1000, 3200, 10_000) for _ in range(4)]
    rows = [*enumerate(words + long), (-1, "ein" * 1000)]
    spans = {r.doc_id: r.spans for r in S.scan(documents(rows)).collect()}
    for at in range(0, len(long), 4):
        assert sum(any(s.kind == 3 for s in spans[len(words) + at + i]) for i in range(4)) == 4, len(long[at])
    assert not any(s.kind == 3 for s in spans[-1])
    assert sum(any(s.kind == 3 for s in spans[i]) for i in range(len(words))) < 0.01 * len(words)


def plain_evidence(run):
    """The same ratio, from the run itself."""
    v = run.replace("=", "")
    size = 16 if re.fullmatch("[0-9a-f-]+|[0-9A-F-]+", v) else 32 if re.fullmatch("[A-Z2-7]+|[a-z2-7]+", v) and re.search("[0-9]", v) else 36 if re.fullmatch("[A-Z0-9]+|[a-z0-9]+", v) and re.search("[0-9]", v) else 64
    bare = v.replace("-", "") if size == 16 else v
    kind = ["l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "s" for c in bare]
    out = 0.0
    for x, y in zip(kind, kind[1:]):
        q, t = S.ENCODINGS[size][2:]
        out += math.log10(q / t if x != y else (1 - q) / (1 - t))
    if size != 16:
        for c in bare.lower():
            if c.isalpha():
                u, t = len(S.COMMON) / 26, S.COMMON_TEXT
                out += math.log10(u / t if c in S.COMMON else (1 - u) / (1 - t))
    return size, bare, out


def plain_p(codes, size, bounds):
    """The battery with exact tails: of the normal by erfc, of chi-squared by its series."""

    def chi(x, dof):
        a, h = dof / 2, x / 2
        if h <= 0:
            return 1.0
        term = total = 1 / a
        k = a
        while term > total * 1e-15:
            k += 1
            term *= h / k
            total += term
        return max(0.0, 1 - total * math.exp(-h + a * math.log(h) - math.lgamma(a)))

    normal = lambda z: math.erfc(abs(z) / math.sqrt(2))
    n = len(codes)
    stat = sum((codes.count(c) - n / size) ** 2 / (n / size) for c in range(size))
    cells = [(sum(lo <= c < hi for c in codes), n * (hi - lo) / size) for lo, hi in zip(bounds, bounds[1:])]
    high = sum(c >= size / 2 for c in codes)
    runs = 1 + sum((x >= size / 2) != (y >= size / 2) for x, y in zip(codes, codes[1:]))
    want = 2 * high * (n - high) / n + 1
    spread = (want - 1) * (want - 2) / (n - 1)
    p_runs = normal((runs - want) / math.sqrt(spread)) if 0 < high < n else 2.0 ** (1 - n)
    mean = sum(codes) / n
    r = sum((x - mean) * (y - mean) for x, y in zip(codes, codes[1:])) / sum((x - mean) ** 2 for x in codes)
    return min(1.0, 4 * min(chi(stat, size - 1), chi(sum((o - e) ** 2 / e for o, e in cells), len(cells) - 1), p_runs, normal(r * math.sqrt(n) + 1 / math.sqrt(n))))


def batteries(spark, runs):
    rows = spark.createDataFrame(list(enumerate(runs)), "i long, v string")
    return {r.i: (r.b.p, r.b.e) for r in rows.select("i", S.battery(F.col("v")).alias("b")).collect()}


def test_statistics_against_plain_code(spark):
    rng = random.Random(3)
    runs = ["".join(rng.choices(S.ENCODINGS[k][0], k=n)) for k in S.ENCODINGS for n in (20, 33, 64, 200) for _ in range(10)]
    runs += ["some_long_identifier_name", "applySchemaToPythonRDD", "0d4c3db6-03a3-462f-a0e6-08924c41b5d4", "abcdefghij0123456789klm", "abc" * 9 + "=="]
    got = batteries(spark, runs)
    for i, run in enumerate(runs):
        size, bare, e = plain_evidence(run)
        assert abs(got[i][1] - e) < 1e-9, run
        bare = bare.lower() if size == 16 else bare.replace("-", "+").replace("_", "/") if size == 64 else bare.upper()
        want = plain_p([S.ENCODINGS[size][0].index(c) for c in bare], size, S.ENCODINGS[size][1])
        assert abs(got[i][0] - want) < 0.02 + 0.1 * want, (run, got[i], want)  # the tails are approximations


def test_uniform_runs_are_seldom_dismissed(spark):
    rng = random.Random(8)
    for size in S.ENCODINGS:
        runs = ["".join(rng.choices(S.ENCODINGS[size][0], k=n)) for n in (24, 64, 400) for _ in range(400)]
        runs = [r if size != 32 and size != 36 or re.search("[0-9]", r) else r + "7" for r in runs]
        p = [v[0] for v in batteries(spark, runs).values()]
        assert sum(x < 0.001 for x in p) <= 6, size  # 1,200 runs; about one expected, for a battery of four


def identifiers():
    """Names of 20 or more characters from Python's own standard library."""
    out = set()
    for name in sorted(m.name for m in pkgutil.iter_modules() if m.name in sys.stdlib_module_names and not m.name.startswith("_")):
        origin = getattr(importlib.util.find_spec(name), "origin", None) or ""
        source = open(origin, errors="ignore").read() if origin.endswith(".py") else ""
        out.update(re.findall(r"(?<![A-Za-z0-9+/_=-])[A-Za-z_]{20,}(?![A-Za-z0-9+/_=-])", source))
    return sorted(out)[:3000]


def test_false_alarms_among_identifiers(documents):
    rng = random.Random(21)
    names = identifiers()
    assert len(names) > 600
    planted = ["".join(rng.choices(S.ENCODINGS[k][0], k=n)) for k, n in ((64, 40), (64, 32), (64, 64), (36, 40), (32, 52)) for _ in range(60)]
    rows = list(enumerate(names + planted))
    hit = {r.doc_id for r in S.scan(documents(rows)).collect() if any(s.kind == 3 for s in r.spans)}
    alarms, found = sum(i < len(names) for i in hit), sum(i >= len(names) for i in hit)
    print("identifiers", len(names), "flagged", alarms, "planted", len(planted), "found", found)
    assert alarms <= 0.01 * len(hit) + 2 and found >= 0.85 * len(planted)


def test_threshold_is_benjamini_hochberg(spark):
    rng = random.Random(2)
    for share in (0.0, 0.1, 0.6):
        runs = [(rng.random() if rng.random() < 0.7 else 1e-5, rng.gauss(8, 2) if rng.random() < share else rng.gauss(-3, 1)) for _ in range(400)]
        least = S.threshold(spark.createDataFrame(runs, "p double, e double"), steps=1000, bins=30_000).first().least
        ranked = sorted((10.0 ** -max(e, 0) if p >= 0.001 else 1.0 for p, e in runs))
        k = max([i + 1 for i, q in enumerate(ranked) if q <= 0.01 * (i + 1) / len(runs)], default=0)
        assert abs(sum(p >= 0.001 and e >= least for p, e in runs) - k) <= 1


def test_time_of_many_matches(documents):
    def seconds(n):
        docs = documents([(1, " ".join("%032x" % random.Random(i).getrandbits(128) for i in range(n)))])
        began = time.time()
        assert len(S.scan(docs).first().spans) == n
        return time.time() - began

    seconds(10)
    few, many = seconds(2000), seconds(16_000)
    assert many < few + 8, (few, many)


def test_redact(documents):
    rows = [*enumerate(texts()), (3, texts()[3])]
    docs = documents(rows)
    out = S.redact(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id, r.text) for r in out.collect() if r.text is not None)
    want = []
    spans = {r.doc_id: r.spans for r in S.scan(docs).collect()}
    for i, t in rows:
        if t is None:
            continue
        text, at = "", 0
        for s in spans[i]:
            if s.start >= at:
                text += t[at : s.start] + "[SECRET]"
            at = max(at, s.end)
        want.append((i, text + t[at:]))
    assert got == sorted(want)


def test_empty(documents):
    assert S.scan(documents([])).count() == 0
