"""Byte-level BPE encoding and decoding with a segment tree per piece.

A text is split by a pattern into pieces. A piece that is a token is that
token, as the tiktoken library has it; otherwise its bytes are merged, lowest
rank first, leftmost first among equal ranks. The leaves of a segment tree
hold the rank of the pair that starts at each byte position (none: infinity);
an inner node holds the least rank below it, so the leftmost least pair is
found by going down from the root. A merge changes the pairs of the merged
symbol, of its left neighbour and of the one swallowed: three point updates
of logarithmic cost; live neighbours are kept in a doubly linked list.

Pieces repeat, so what a piece encodes to is kept in a bounded table.

Cases: null text is taken as empty, which has no tokens and decodes to no
bytes. Lone surrogates cannot occur in a Spark string. Very long pieces cost
n log n. Repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n == 0:
        return []
    leaves = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * leaves)
    right = list(range(1, n + 1))  # start of the next live symbol; n: none
    left = list(range(-1, n - 1))
    get = ranks.get
    for i in range(n - 1):
        tree[leaves + i] = get(piece[i : i + 2], NONE)
    for k in range(leaves - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b

    def put(i: int, rank: int) -> None:
        k = leaves + i
        tree[k] = rank
        while k > 1:
            k >>= 1
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a <= b else b
            if tree[k] == least:
                break
            tree[k] = least

    while tree[1] < NONE:
        k, least = 1, tree[1]
        while k < leaves:
            k *= 2
            if tree[k] != least:
                k += 1
        i = k - leaves
        gone = right[i]
        after = right[gone]
        right[i] = after
        put(gone, NONE)
        if after < n:
            left[after] = i
            put(i, get(piece[i : right[after]], NONE))
        else:
            put(i, NONE)
        if left[i] >= 0:
            put(left[i], get(piece[left[i] : after], NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : right[i]]])
        i = right[i]
    return out


class Pieces(dict):
    """The ids of each piece (a string), kept while they fit."""

    def __init__(self, ranks: dict[bytes, int], most: int = 600_000, longest: int = 256):
        self.ranks, self.most, self.longest = ranks, most, longest

    def __missing__(self, piece: str):
        ids = merge_piece(piece.encode("utf-8"), self.ranks)
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.split = regex.compile(pattern).findall
        self.pieces = Pieces(self.ranks)
        self.bytes_of = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.text_of = [str(i) for i in range(len(self.bytes_of))]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def joined(self, ids) -> str:
        return ",".join(map(self.text_of.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each worker process, with what it has kept of pieces."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of every row: encoded, then decoded from the ids."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        c = codec(path, pattern)
        sha = hashlib.sha256
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column(1).to_pylist():
                ids = c.encode(t) if t else []
                n.append(len(ids))
                a.append(sha(c.joined(ids).encode()).hexdigest())
                b.append(sha(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and ids (array of int) of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            ids = [c.encode(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """key and the bytes that each row's ids stand for; null ids stand for none."""
    kind = tokens.schema[key].dataType.simpleString()

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            out = [c.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[key, "decoded"])

    return tokens.select(F.col(key), F.col(ids).cast("array<int>")).mapInArrow(run, f"`{key}` {kind}, decoded binary")
