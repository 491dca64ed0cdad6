"""Toxicity: Levenshtein automata intersected with a lexicon trie, then context windows.

The lexicon is learned from labelled texts by greedy cover: the term that adds
most to the toxic texts not yet covered twice, among terms far likelier there
than in clean texts. Its terms form a trie. For every word the product of that
trie with the Levenshtein automaton (0 edits for terms of up to 3 letters, 1
for up to 7, 2 beyond, adjacent swaps as one edit) is run; the product is
determinised lazily and its states are kept, so a word costs one dictionary
step a letter until it dies. Besides words the lexicon holds stems, which
match without edits all words that begin with them. Each hit is weighed by its context window: hits
between quotation marks count apart from the others. A logistic regression
over a few counts gives the score.

Cases: null and empty texts have no hits and get the score of a text without
hits. No labels at all: score 0 for every text. Repeated label rows of one
document: the largest label holds. Ties in learning go to the term that sorts first.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sampled

WORD = re.compile(r"\w+")
#: fixed values: quotation marks that open or close a quotation
QUOTES = '"“”„«»‹›‟'
FEATURES = 7
#: ends a lexicon entry that stands for all words that begin with it
STEM = "*"
STEM_SIZES = range(3, 9)


def edits_allowed(term: str) -> int:
    return 0 if len(term) <= 3 else 1 if len(term) <= 7 else 2


class FuzzyTrie:
    """A lexicon trie whose product with Levenshtein automata is determinised lazily."""

    def __init__(self, terms):
        self.child: list[dict[str, int]] = [{}]
        self.ends: dict[int, str] = {}
        self.most: list[int] = [0]  # the most edits that any term below a node allows
        self.stems: dict[int, int] = {}  # nodes where a stem ends, and the stem's place in names
        self.names: list[str] = []
        for t in sorted(set(terms)):
            stem = t.endswith(STEM)
            name, t = t, t.removesuffix(STEM)
            node, e = 0, 0 if stem else edits_allowed(t)
            self.most[0] = max(self.most[0], e)
            for c in t:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.most.append(0)
                node = self.child[node][c]
                self.most[node] = max(self.most[node], e)
            if stem:
                self.stems[node] = len(self.names)
                self.names.append(name)
            else:
                self.ends[node] = name
        self._restart()

    def _restart(self):
        self.ids: dict[frozenset, int] = {frozenset(): 0}
        self.sets: list[frozenset] = [frozenset()]
        self.moves: list[dict[str, int]] = [{}]
        self.start = self._id(self._close({(0, 0, ""): None}))

    def _id(self, state: frozenset) -> int:
        if state not in self.ids:
            self.ids[state] = len(self.sets)
            self.sets.append(state)
            self.moves.append({})
        return self.ids[state]

    def _close(self, found) -> frozenset:
        """With terms' letters left out, and without states that a cheaper one covers."""
        best: dict[tuple[int, str], int] = {}
        todo = [(n, e, w) for n, e, w in found]
        while todo:
            n, e, w = todo.pop()
            if n < 0:  # a stem has been read; what follows is free
                best[n, w] = 0
                continue
            if n in self.stems and not e and not w:
                todo.append((-1 - self.stems[n], 0, ""))
            if e > self.most[n] or best.get((n, w), 9) <= e:
                continue
            best[n, w] = e
            if not w:
                todo += [(m, e + 1, "") for m in self.child[n].values()]
        return frozenset((n, e, w) for (n, w), e in best.items())

    def _move(self, at: int, c: str) -> int:
        out = []
        for n, e, w in self.sets[at]:
            if n < 0:
                out.append((n, e, w))
                continue
            if w:  # the second letter of a swap is due
                if c == w[0]:
                    out.append((int(w[1:]), e, ""))
                continue
            for x, m in self.child[n].items():
                out.append((m, e if x == c else e + 1, ""))
                if x != c and c in self.child[m]:
                    out.append((n, e + 1, x + str(self.child[m][c])))
            out.append((n, e + 1, ""))
        return self._id(self._close(out))

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its edits; ties to the term that sorts first."""
        at = self.start
        for c in word:
            step = self.moves[at]
            if c not in step:
                step[c] = self._move(at, c)
            at = step[c]
            if not at:
                return None
        hits = [(e, self.ends[n]) for n, e, w in self.sets[at] if not w and n in self.ends and e <= edits_allowed(self.ends[n])]
        hits += [(0, self.names[-1 - n]) for n, e, w in self.sets[at] if n < 0]
        if len(self.sets) > 200_000:
            self._restart()
        return (min(hits)[1], min(hits)[0]) if hits else None


class Seen(dict):
    """What each word matches, kept while it fits."""

    def __init__(self, trie: FuzzyTrie, most: int = 400_000):
        self.trie, self.most = trie, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        hit = self[word] = self.trie.match(word)
        return hit


def quoted(text: str, start: int, end: int, window: int) -> bool:
    """Between quotation marks that open within the window before and close within it after, on its own line."""
    before = text[max(0, start - window) : start].rpartition("\n")[2]
    after = text[end : end + window].partition("\n")[0]
    marks = sum(before.count(q) for q in QUOTES)
    return marks % 2 == 1 and any(q in after for q in QUOTES)


def features(text: str | None, seen: Seen, weight: dict[str, float], window: int) -> list[float]:
    out = [0.0] * FEATURES
    if not text:
        return out
    low = text.lower()
    words = WORD.findall(low)
    hit = {w: m for w in set(words) if (m := seen[w])}
    if not hit:
        return out
    exact = fuzzy = cited = cited_fuzzy = 0.0
    for m in WORD.finditer(low):
        if m.group() in hit:
            term, edits = hit[m.group()]
            in_quotes = quoted(low, m.start(), m.end(), window)
            w = weight[term]
            if edits:
                cited_fuzzy, fuzzy = (cited_fuzzy + w, fuzzy) if in_quotes else (cited_fuzzy, fuzzy + w)
            else:
                cited, exact = (cited + w, exact) if in_quotes else (cited, exact + w)
    terms = {t for t, e in hit.values() if e == 0}
    return [math.log1p(exact), math.log1p(fuzzy), math.log1p(cited), math.log1p(cited_fuzzy), float(exact > 0), math.log1p(len(terms)), math.log1p(100.0 * exact / max(20, len(words)))]


def entries(words: set[str]) -> set[str]:
    """The words of a text, and the stems that two or more of them share."""
    from collections import Counter

    stems = Counter(w[:n] for w in words for n in STEM_SIZES if n < len(w))
    return words | {s + STEM for s, n in stems.items() if n > 1}


def learn_lexicon(toxic: list[set[str]], clean: list[set[str]], most: int = 256) -> dict[str, float]:
    """Terms and stems with their log odds, chosen by greedy cover; a shorter entry wins a tie."""
    from collections import Counter

    t, c = Counter(), Counter()
    for s in toxic:
        t.update(entries(s))
    for s in clean:
        c.update(e for e in entries(s) if e in t)
    toxic = [{e for e in entries(s) if t[e] > 1} for s in toxic]
    floor = max(2, math.ceil(0.004 * len(toxic)))
    odds = {w: math.log((n + 0.5) / (len(toxic) + 1)) - math.log((c[w] + 0.5) / (len(clean) + 1)) for w, n in t.items() if n >= floor and len(w) > 1}
    odds = {w: o for w, o in odds.items() if o >= 2.0}
    where: dict[str, list[int]] = {w: [] for w in odds}
    for i, s in enumerate(toxic):
        for w in s & odds.keys():
            where[w].append(i)
    need, chosen = [2] * len(toxic), {}
    while odds and len(chosen) < most:
        gain, _, word = min((-(odds[w] * sum(need[i] > 0 for i in where[w])), len(w), w) for w in odds)
        if sum(need[i] > 0 for i in where[word]) < floor:
            break
        chosen[word] = odds.pop(word)
        for i in where[word]:
            need[i] = max(0, need[i] - 1)
    return chosen


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method with a ridge; the first coefficient is the constant."""
    a = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(a.shape[1])
    keep = np.eye(a.shape[1]) * ridge
    keep[0, 0] = 1e-3
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ b, -30, 30)))
        grad = a.T @ (weight * (p - y)) + keep @ b
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + keep
        step = np.linalg.solve(hess, grad)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


class Model:
    def __init__(self, lexicon: dict[str, float], beta, window: int = 80, only: float = 0.0):
        self.lexicon, self.beta, self.window, self.only = lexicon, beta, window, only

    def scores(self, texts, seen: Seen) -> np.ndarray:
        if self.beta is None or not len(texts):
            return np.full(len(texts), self.only)  # labels of one class, or none, tell no texts apart
        x = np.array([features(t, seen, self.lexicon, self.window) for t in texts])
        z = self.beta[0] + x @ self.beta[1:]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", rows_per_class: int = 2000, longest: int = 1 << 16, window: int = 80) -> Model:
    """From at most `rows_per_class` labelled texts of each class, each of at most `longest` bytes."""
    named = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).filter("k is not null and y in (0, 1)").groupBy("k").agg(F.max("y").alias("y"))
    ids = sampled(named, "y", "k", rows_per_class)  # bounded, so it may be broadcast
    counts = {r.y: r["count"] for r in named.groupBy("y").count().collect()}
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.octet_length("t") <= longest).join(F.broadcast(ids), "k").groupBy("k", "y").agg(F.max("t").alias("t"))
    got = sorted(rows.collect(), key=lambda r: str(r.k))
    y = np.array([r.y for r in got], float)
    if len(set(y)) < 2:
        return Model({}, None, window, float(y[0]) if len(y) else 0.0)
    sets = [set(WORD.findall(r.t.lower())) for r in got]
    lexicon = learn_lexicon([s for s, v in zip(sets, y) if v], [s for s, v in zip(sets, y) if not v])
    seen = Seen(FuzzyTrie(lexicon))
    x = np.array([features(r.t, seen, lexicon, window) for r in got])
    share = {v: counts[v] / (y == v).sum() for v in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    return Model(lexicon, logistic(x, y, weight * len(y) / weight.sum()), window)


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, score of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon, model.beta, model.window, model.only))
    kind = docs.schema[key].dataType.simpleString()

    def scored(batches):
        m = Model(*shared.value)
        seen = Seen(FuzzyTrie(m.lexicon))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.scores(batch.column(1).to_pylist(), seen), pa.float64())], names=[key, "score"])

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(scored, f"`{key}` {kind}, score double")
