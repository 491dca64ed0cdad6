"""Secret scans with DataFrame operations only.

Base kinds are regular expressions (assign, access, hex). A randomness test
battery adds the kind random: runs of 20 or more token characters, outside the
base spans, are taken as hex (dashes aside), base32, base36 or base64 by their
characters. Two hypotheses are tested of each run:

* uniform in its encoding: chi-squared over the alphabet, chi-squared over
  character classes, the runs test about the middle of the alphabet, and lag-1
  serial correlation of the codes. The least p-value times the number of tests
  dismisses a run as text below `uniform` (0.001), whatever its length: one truly random run in a
  thousand is lost so.
* ordinary text: changes of character class at a rate of at most that of
  identifiers, and common letters at a share of at least that of words. The
  likelihood ratio of uniform to that bound, from the run's number of class
  changes and its split of letters, has mean at most 1 over ordinary text, so
  its inverse is a p-value, and long runs have more evidence for or against.

Runs that pass the first and for which the second is rejected by Benjamini-Hochberg over all runs of
all documents are random: of these, at most a share of `level` are expected to be ordinary text. The threshold comes from a
histogram of the ratios, whose size doesn't depend on the data; each run's tests are made in its own row.

Cases: null text is empty and has no spans; positions are code points, end
exclusive. Base spans of one kind do not overlap; matches that fail their
length still consume their text. Very long texts are scanned whole, in time that grows with their length. Repeated rows are scanned each; rows with
equal id and text have equal spans. Columns other than text and key are never read. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, held

#: fixed values: the base kinds, in order, as pattern, group and least length of that group
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}+", 0, 24),
}
RUN = r"[A-Za-z0-9+/_=-]{20,}+"
#: a text without a match of its kind has no span of it
MAY = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}""",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
}
KINDS = [*BASE, "random"]
UPPER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: size of each encoding: its alphabet, the bounds of its character classes, the chance that two neighbours of a uniform run differ in class, and the rate at which they do in ordinary text
ENCODINGS = {
    16: (DIGITS + "abcdef", (0, 10, 16), 0.469, 0.2),
    32: (UPPER + "234567", (0, 26, 32), 0.305, 0.15),
    36: (UPPER + DIGITS, (0, 26, 36), 0.401, 0.2),
    64: (UPPER + UPPER.lower() + DIGITS + "+/", (0, 26, 52, 62, 64), 0.645, 0.25),
}
#: fixed values: letters that are common in words of Latin script, and the share of these in ordinary text
COMMON, COMMON_TEXT = "etaoinsrhl", 0.65
SPAN = "array<struct<start:int,end:int,value:string>>"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def found(text: Column, pattern: str, group: int, least: int) -> Column:
    """start, end, value of the leftmost non-overlapping matches: their places follow from the lengths of the pieces between them."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else None
    between = F.split(text, pattern, -1)

    def zipped(m):
        both = F.transform(m, lambda x: F.struct(x.alias("m"), x.alias("v"))) if values is None else F.zip_with(m, values, lambda x, v: F.struct(x.alias("m"), v.alias("v")))
        return F.zip_with(both, F.slice(between, 1, F.size(m)), lambda x, y: F.struct(x.m.alias("m"), x.v.alias("v"), F.length(y).alias("b")))

    # spans are appended to short arrays, of 64 matches each, and these put together: copies stay few in texts of many matches
    def step(acc, x):
        start = acc.at + x.b
        end = start + F.length(x.m)
        span = F.struct(start.alias("start"), end.alias("end"), x.v.alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(x.v) >= least, F.concat(acc.got, F.array(span))).otherwise(acc.got).alias("got"))

    def chunk_step(acc, chunk):
        inner = F.aggregate(chunk, F.struct(acc.at.alias("at"), F.array().cast(SPAN).alias("got")), step)
        return let(inner, lambda r: F.struct(r.at.alias("at"), F.concat(acc.got, F.array(r.got)).alias("got")))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("got"))
    return let(let(matches, zipped), lambda whole: F.aggregate(F.when(F.size(whole) > 0, F.transform(F.sequence(F.lit(0), F.size(whole) - 1, F.lit(64)), lambda i: F.slice(whole, i + 1, 64))).otherwise(F.slice(F.array(whole), 1, 0)), zero, chunk_step, lambda acc: F.flatten(acc.got)))


def tail(x: Column) -> Column:
    """Two-sided p-value of a standard normal |x| (a rational approximation of erfc)."""
    z = F.abs(x) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.3275911 * z)
    p = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-z * z)
    return F.least(F.lit(1.0), F.greatest(F.lit(1e-300), p))


def chi_tail(x: Column, dof: Column) -> Column:
    """Upper tail of chi-squared by the Wilson-Hilferty cube root."""
    z = (F.pow(F.greatest(x, F.lit(0.0)) / dof, F.lit(1 / 3)) - (1 - 2 / (9 * dof))) / F.sqrt(2 / (9 * dof))
    return F.when(z > 0, tail(z) / 2).otherwise(1 - tail(z) / 2)


def encoding(value: Column) -> Column:
    """bare (a run without padding, with plain base64 signs, in the case of its alphabet) and a, the size of the alphabet inferred from it."""

    def inferred(x):
        hexes, digit = x.rlike("^([0-9a-f-]+|[0-9A-F-]+)$"), x.rlike("[0-9]")
        size = F.when(hexes, 16).when(x.rlike("^([A-Z2-7]+|[a-z2-7]+)$") & digit, 32).when(x.rlike("^([A-Z0-9]+|[a-z0-9]+)$") & digit, 36).otherwise(64)
        return let(size, lambda a: F.struct(F.when(a == 16, F.lower(F.replace(x, F.lit("-"), F.lit("")))).when(a == 64, F.translate(x, "-_", "+/")).otherwise(F.upper(x)).alias("bare"), a.alias("a")))

    return let(F.translate(value, "=", ""), inferred)


def by_size(a: Column, pick) -> Column:
    """pick(size) for the size that a holds."""
    out = None
    for size in ENCODINGS:
        out = F.when(a == size, pick(size)) if out is None else out.when(a == size, pick(size))
    return out


def uniformity(codes: Column, a: Column) -> Column:
    """The p-value of the battery: of codes, uniform over 0 .. a - 1."""
    total = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda s, x: s + f(x))
    count = lambda f: F.size(F.filter(codes, f)).cast("double")
    size, n = a.cast("double"), F.size(codes).cast("double")
    chi = total(F.array_distinct(codes), lambda c: F.pow(count(lambda x: x == c), 2)) * size / n - n
    share = by_size(a, lambda k: F.array(*[F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"), F.lit((hi - lo) / k).alias("p")) for lo, hi in zip(ENCODINGS[k][1], ENCODINGS[k][1][1:])]))
    classes = total(share, lambda c: F.pow(count(lambda x: (x >= c.lo) & (x < c.hi)) - n * c.p, 2) / (n * c.p))
    mean = total(codes, lambda x: x) / n
    steps = F.zip_with(F.slice(codes, 2, F.size(codes)), F.slice(codes, 1, F.size(codes) - 1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))

    def tests(s):
        low = n - s.high
        want = 2 * s.high * low / n + 1
        spread = (want - 1) * (want - 2) / (n - 1)
        p_runs = F.when((s.high == 0) | (low == 0), F.pow(F.lit(2.0), 1 - n)).when(spread > 0, tail((s.runs - want) / F.sqrt(spread))).otherwise(1.0)
        p_serial = F.when(s.own > 0, tail(s.lag / s.own * F.sqrt(n) + 1 / F.sqrt(n))).otherwise(F.pow(F.lit(2.0), 1 - n))
        dof = by_size(a, lambda k: F.lit(len(ENCODINGS[k][1]) - 2.0))
        return F.least(F.lit(1.0), 4 * F.least(chi_tail(s.chi, size - 1), chi_tail(s.classes, dof), p_runs, p_serial))

    def sums(m):
        high = count(lambda x: x >= size / 2)
        runs = F.size(F.filter(steps, lambda t: (t.x >= size / 2) != (t.y >= size / 2))) + 1.0
        lag = total(steps, lambda t: (t.x - m) * (t.y - m))
        own = total(codes, lambda x: F.pow(x - m, 2))
        return let(F.struct(chi.alias("chi"), classes.alias("classes"), high.alias("high"), runs.alias("runs"), lag.alias("lag"), own.alias("own")), tests)

    return let(mean, sums)


def evidence(bare: Column, a: Column) -> Column:
    """log10 of the likelihood ratio of a uniform run to ordinary text, at the bounds of ordinary text."""
    classed = F.translate(bare, UPPER.lower() + UPPER + DIGITS + "+/", "a" * 26 + "A" * 26 + "0" * 10 + "++")
    changes = F.length(F.regexp_replace(classed, r"(.)\1*", ".")) - 1
    letters = F.regexp_replace(F.lower(bare), "[^a-z]", "")
    common = F.length(F.regexp_replace(letters, f"[^{COMMON}]", ""))
    log = lambda x, y: math.log10(x / y)
    uniform = len(COMMON) / 26
    kept = F.length(bare) - 1 - changes
    turns = by_size(a, lambda k: changes * log(*ENCODINGS[k][2:]) + kept * log(*(1 - x for x in ENCODINGS[k][2:])))
    split = common * log(uniform, COMMON_TEXT) + (F.length(letters) - common) * log(1 - uniform, 1 - COMMON_TEXT)
    return turns + F.when(a == 16, 0.0).otherwise(split)  # of the letters a to f no split is known


def battery(value: Column) -> Column:
    """p (of uniformity) and e (log10 of the evidence against ordinary text) of a run."""

    def tested(b):
        table = by_size(b.a, lambda k: F.lit(ENCODINGS[k][0]))
        codes = F.transform(F.filter(F.split(b.bare, ""), lambda c: c != ""), lambda c: (F.call_function("instr", table, c) - 1).cast("double"))
        p = let(codes, lambda x: uniformity(x, b.a))
        return F.when(F.length(b.bare) >= 2, F.struct(p.alias("p"), evidence(b.bare, b.a).alias("e"))).otherwise(F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("e")))

    return let(encoding(value), tested)


def threshold(runs: DataFrame, level: float = 0.01, uniform: float = 0.001, steps: int = 20, bins: int = 6000) -> DataFrame:
    """One row, least: the evidence from which Benjamini-Hochberg at `level` rejects ordinary text, over all runs (columns p, e); infinity if nowhere.

    Evidence falls into bins, `steps` to a factor of ten, each taken at its lower end.
    """
    at = F.greatest(F.lit(0), F.least(F.lit(bins), F.floor(F.col("e") * steps))).cast("int")
    counts = runs.groupBy(F.when(F.col("p") >= uniform, at).otherwise(-1).alias("bin")).agg(F.count(F.lit(1)).alias("k"))
    above = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)  # over at most bins + 2 rows
    counts = counts.withColumn("above", F.sum("k").over(above)).withColumn("m", F.sum("k").over(Window.partitionBy()))
    holds = (F.col("bin") >= 0) & (F.pow(F.lit(10.0), -F.col("bin") / steps) * F.col("m") <= level * F.col("above"))
    return counts.filter(holds).agg(F.coalesce(F.min("bin") / steps, F.lit(float("inf"))).alias("least"))


def spans_of(docs: DataFrame, text: str) -> DataFrame:
    """docs with _found: base (array of start, kind, end) and runs (array of start, end, p, e) of each row, all made in the row."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    empty = F.array().cast(SPAN)
    # the keywords are looked for before any pattern is: most texts have none
    words = F.lower(t)
    may = F.contains(words, F.lit("password")) | F.contains(words, F.lit("passwd")) | F.contains(words, F.lit("secret")) | F.contains(words, F.lit("token")) | F.contains(words, F.lit("api"))
    hit = {kind: t.rlike(MAY[kind]) for kind in BASE}
    hit["assign"] = may & hit["assign"]
    hit["access"] = F.contains(t, F.lit("AKIA")) & hit["access"]
    named = lambda kind, spans: F.transform(spans, lambda s: F.struct(s.start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s.end.alias("end")))
    kinds = [named(kind, F.when(hit[kind], found(t, *BASE[kind])).otherwise(empty)) for kind in BASE]
    runs = F.when(t.rlike(r"[A-Za-z0-9+/_=-]{20}"), found(t, RUN, 0, 20)).otherwise(empty)

    # everything is bound once by let: columns that name each other would be put into one another, and computed again for each span
    def judged(base):
        # base spans in groups of 64 with their bounds, so that a run meets few of them one by one
        group = lambda g: F.struct(g[0].start.alias("lo"), F.array_max(F.transform(g, lambda s: s.end)).alias("hi"), g.alias("g"))
        groups = let(F.array_sort(base), lambda o: F.transform(F.sequence(F.lit(1), F.greatest(F.size(o), F.lit(1)), F.lit(64)), lambda i: let(F.slice(o, i, 64), group)))
        clear = lambda r, gs: ~F.exists(gs, lambda g: (g.lo < r.end) & (r.start < g.hi) & F.exists(g.g, lambda s: (s.start < r.end) & (r.start < s.end)))
        outside = F.when(F.size(base) == 0, runs).otherwise(let(groups, lambda gs: F.filter(runs, lambda r: clear(r, gs))))
        made = F.transform(outside, lambda r: let(battery(r.value), lambda v: F.struct(r.start.alias("start"), r.end.alias("end"), v.p.alias("p"), v.e.alias("e"))))
        return F.struct(base.alias("base"), made.alias("runs"))

    return docs.withColumn("_found", let(F.concat(*kinds), judged))


def with_random(least: Column, uniform: float) -> Column:
    """Base spans and random runs of a row, in order."""
    random = F.filter("_found.runs", lambda r: (r.p >= uniform) & (r.e >= least))
    return F.array_sort(F.concat("_found.base", F.transform(random, lambda r: F.struct(r.start.alias("start"), F.lit(len(BASE)).alias("kind"), r.end.alias("end")))))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", level: float = 0.01, uniform: float = 0.001) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind as its place in KINDS, end) of each row."""
    rows = held(spans_of(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text")), "_text").drop("_text"))
    bound = threshold(rows.select(F.explode("_found.runs").alias("r")).select("r.p", "r.e"), level, uniform)
    both = rows.crossJoin(F.broadcast(bound))  # one row
    return both.select("doc_id", F.col("_found.base").alias("base"), with_random(F.col("least"), uniform).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas, by start and then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", level: float = 0.01, uniform: float = 0.001) -> DataFrame:
    """docs with every span replaced by `mark`, overlapping spans by one; rows without spans are unchanged.

    The texts are read twice, once for the threshold of all runs, and never shuffled. The threshold is cut off from its plan, which would stand a second time in that of the result.
    """
    runs = spans_of(docs.select(F.col(text).alias("_text")), "_text").select(F.explode_outer("_found.runs").alias("r")).filter("r is not null").select("r.p", "r.e")  # of explode, Spark infers filters that find the runs once more
    bound = cut(threshold(runs, level, uniform))
    rows = spans_of(docs, text).crossJoin(F.broadcast(bound)).withColumn("_spans", with_random(F.col("least"), uniform))  # one row
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    source = F.col(text).cast("string")

    def step(acc, s):
        fresh = s.start >= acc.at
        out = F.when(fresh, F.concat(acc.out, F.array(F.substring(source, acc.at + 1, s.start - acc.at), F.lit(mark)))).otherwise(acc.out)
        return F.struct(F.greatest(acc.at, s.end).alias("at"), out.alias("out"))

    clean = F.aggregate("_spans", zero, step, lambda acc: F.concat(F.array_join(acc.out, ""), F.substring(source, acc.at + 1, F.length(source))))
    return rows.select(*[F.when(F.size("_spans") > 0, clean).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in docs.columns])
