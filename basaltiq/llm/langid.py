"""Language ID by prediction by partial matching (PPM).

For each language a variable-order byte context tree is counted on labelled
texts. A byte after a context costs -log2(count / (total + distinct)) bits, or
the escape -log2(distinct / (total + distinct)) plus its cost after the next
shorter context (escape method C; after the empty context, 8 bits). Statistics
are frozen before scoring, so the cost of a byte depends on the `order` bytes
before it and itself alone; the code length of a whole text is the sum, and
the language with the shortest code wins.

With frozen statistics all trees are folded into one: each byte string of up
to order + 1 bytes that any language has seen gets an id and, for each
language, its exact cost with all escapes. Ids are found level by level
(id of a string, next byte -> id of the longer string), which numpy does for
all positions of a block at once.

Cases: null text, and text without a letter, is `und` with score 0. Ties go to
the language that sorts first. No labelled row at all: every text is `und`.
Very long texts are scored whole, block by block; for learning they are cut to
their first `longest` bytes. Repeated rows are scored each. Only the named
columns are read, whatever the others are called. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sampled

UND = "und"
BLOCK = 1 << 19
DENSE = 1 << 26  # steps of a level kept as a table; beyond, as sorted keys


def steps(found: np.ndarray, size: int) -> np.ndarray | tuple[np.ndarray]:
    """The ids 1, 2, ... of the sorted keys found, all below size."""
    if size > DENSE:
        return (found,)
    table = np.zeros(size, np.int32)
    table[found] = np.arange(1, len(found) + 1)
    return table


def stepped(step, key: np.ndarray) -> np.ndarray:
    """The id of each key, 0 for those not found."""
    if not isinstance(step, tuple):
        return step[key]
    at = np.searchsorted(step[0], key)
    return np.where(np.append(step[0], -1)[at] == key, at + 1, 0).astype(np.int32)


def placed(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys, and the place of each key among them: np.unique's inverse, in pieces, without its arrays of the whole length."""
    found = np.unique(key)
    inverse = np.empty(len(key), np.int32)
    for at in range(0, len(key), BLOCK):
        inverse[at : at + BLOCK] = np.searchsorted(found, key[at : at + BLOCK])
    return found, inverse


class PPM:
    """Frozen context trees of several languages, folded together."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = 3):
        self.langs, self.order = sorted(texts), order
        n_lang = max(1, len(self.langs))
        parts, owner = [], []
        for i, lang in enumerate(self.langs):
            for t in texts[lang]:
                parts.append(t)
                owner.append(np.full(len(t) + 1, i, np.int32))
        raw = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8) if parts else np.zeros(0, np.uint8)
        owner = np.concatenate(owner) if owner else np.zeros(0, np.int32)
        seen = np.unique(raw)
        seen = seen[seen != 255]
        # 0 separates texts, 1 is any byte never seen in training
        self.symbols = np.ones(256, np.int32)
        self.symbols[seen] = np.arange(2, len(seen) + 2)
        self.symbols[255] = 0
        self.width = len(seen) + 2
        sym = self.symbols[raw]
        #: step[k]: id of a string of k bytes, times width, plus the next symbol -> id of k + 1 bytes; 0: not seen
        self.step, self.cost, self.escape = [], [], []
        below_cost = np.full((1, n_lang), 8.0)
        ids = None  # of the string of k bytes that ends at each position; the empty one is 1
        size, suffix_of_prefix = 2, None
        for k in range(order + 1):
            prev = np.ones(len(sym), np.int32) if k == 0 else np.concatenate((np.zeros(min(1, len(sym)), np.int32), ids[:-1]))
            ok = (prev > 0) & (sym > 1)
            key = (prev.astype(np.int64) * self.width + sym)[ok]
            found, inverse = placed(key)
            step = steps(found, size * self.width)
            np.multiply(inverse, n_lang, out=key, dtype=np.int64)
            key += owner[ok]
            count = np.bincount(key, minlength=len(found) * n_lang).reshape(-1, n_lang)[: len(found)].astype(float)
            context = found // self.width
            total, distinct = np.zeros((size, n_lang)), np.zeros((size, n_lang))
            np.add.at(total, context, count)
            np.add.at(distinct, context, count > 0)
            room = np.where(total > 0, total + distinct, 1.0)
            escape = np.where(total > 0, -np.log2(np.where(total > 0, distinct, 1.0) / room), 0.0)
            escape[0] = 0.0
            # the same string without its first byte, one level down
            new = np.zeros(len(sym), np.int32)
            new[ok] = inverse + 1
            del inverse, key
            shorter = np.zeros(len(found) + 1, np.int64)
            if k:
                shorter[new[ok]] = suffix_of_prefix[ok]
            fallback = escape[context] + below_cost[shorter[1:] if k else np.zeros(len(found), np.int64)]
            with np.errstate(divide="ignore"):
                direct = -np.log2(count / room[context])
            cost = np.vstack([np.zeros((1, n_lang)), np.where(count > 0, direct, fallback)])
            self.step.append(step)
            self.escape.append(escape.astype(np.float32))
            self.cost.append(cost.astype(np.float32))
            below_cost, suffix_of_prefix, ids, size = cost, new, new, len(found) + 1

    def _bits(self, raw: np.ndarray) -> np.ndarray:
        """Costs of each byte of a block (rows) in each language (columns); separators cost nothing."""
        sym = self.symbols[raw]
        ids = [np.where(sym > 0, 1, 0).astype(np.int32)]
        before = np.ones(len(sym), np.int32)
        chain = []
        for k in range(self.order + 1):
            now = stepped(self.step[k], before.astype(np.int64) * self.width + sym)
            chain.append((before, now))
            before = np.empty_like(now)
            before[:1], before[1:] = 0, now[:-1]
        out = self.cost[self.order][chain[self.order][1]]
        rest = np.flatnonzero((chain[self.order][1] == 0) & (ids[0] > 0))
        if len(rest):
            bits = self.escape[self.order][chain[self.order][0][rest]].astype(np.float32)
            for k in range(self.order - 1, -1, -1):
                hit = chain[k][1][rest] > 0
                out[rest[hit]] = bits[hit] + self.cost[k][chain[k][1][rest[hit]]]
                rest, bits = rest[~hit], bits[~hit]
                bits = bits + self.escape[k][chain[k][0][rest]]
            out[rest] = bits + np.float32(8.0)
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each whole text in each language."""
        total = np.zeros((len(texts), max(1, len(self.langs))))
        parts: list[bytes] = []
        marks: list[tuple[int, int, int]] = []
        held = 0

        def flush():
            nonlocal parts, marks, held
            if parts:
                bits = self._bits(np.frombuffer(b"".join(parts), np.uint8))
                starts = np.array([m[1] for m in marks])
                ends = np.array([m[2] for m in marks])
                cuts = np.column_stack([starts, np.minimum(ends, len(bits) - 1)]).ravel()
                sums = np.add.reduceat(bits, cuts, axis=0, dtype=np.float64)[::2]
                np.add.at(total, np.array([m[0] for m in marks]), sums)
            parts, marks, held = [], [], 0

        for i, t in enumerate(texts):
            for at in range(0, len(t), BLOCK):
                warm = t[max(0, at - self.order) : at]
                piece = t[at : at + BLOCK]
                marks.append((i, held + 1 + len(warm), held + 1 + len(warm) + len(piece)))
                parts += [b"\xff", warm, piece, b"\xff"]
                held += len(warm) + len(piece) + 2
                if held >= BLOCK:
                    flush()
        flush()
        return total

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float], list[float]]:
        """Language, its posterior at equal priors, and bits a byte."""
        bits = self.code_lengths(texts)
        if not self.langs:
            return [UND] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(texts)), best]
        score = 1.0 / np.exp2(-np.minimum(bits - least[:, None], 1000.0)).sum(axis=1)
        size = np.array([max(1, len(t)) for t in texts])
        return [self.langs[b] for b in best], score.tolist(), (least / size).tolist()


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", order: int = 3, docs_per_lang: int = 200, longest: int = 1 << 15, most_langs: int = 200) -> PPM:
    """Trees of a bounded sample: up to `docs_per_lang` labelled texts of at most `longest` bytes in each of the `most_langs` most frequent languages."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("g")).filter("t is not null and g is not null").filter(F.octet_length("t").between(1, longest))
    kept = rows.groupBy("g").count().orderBy(F.desc("count"), "g").limit(most_langs).select("g")
    drawn = sampled(rows.select("k", "g", F.col("t")).join(F.broadcast(kept), "g"), "g", "k", docs_per_lang)
    texts: dict[str, list[bytes]] = {}
    for r in sorted(drawn.select("g", "k", "t").collect(), key=lambda r: (r.g, str(r.k), r.t)):
        texts.setdefault(r.g, []).append(r.t.encode("utf-8", "surrogatepass"))
    return PPM(texts, order)


def labelled(model: PPM, texts: pa.Array) -> tuple[list[str], list[float], list[float]]:
    """Language, score and bits a byte of each text; `und`, 0 and 0 for texts without a letter."""
    letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_pylist()
    lang, score, rate = model.predict([t if ok else b"" for t, ok in zip(texts.cast(pa.binary()).to_pylist(), letters)])
    return [g if ok else UND for g, ok in zip(lang, letters)], [x if ok else 0.0 for x, ok in zip(score, letters)], rate


def predict(docs: DataFrame, model: PPM, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score and bits_per_byte of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def scored(batches):
        m = shared.value
        for batch in batches:
            lang, score, rate = labelled(m, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], names=[key, "lang_pred", "score", "bits_per_byte"])

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(scored, f"`{key}` {kind}, lang_pred string, score double, bits_per_byte double")
