import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from basaltiq.llm import bpe, token_counts
from basaltiq.llm.queries import tokenizer
from hypothesis import given, settings
from hypothesis import strategies as st

PATH, PATTERN = tokenizer()
RANKS = bpe.read_ranks(PATH)
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OURS = bpe.codec(PATH, PATTERN)
TEXTS = ["", None, "Hello  world!\n\n  don't 12345 ñandú 日本語 🙂", "x" * 5000, " " * 3000 + "a", "ab" * 4000, "<|endoftext|>", "é" * 999, "\x00\t \r\n", "ĀĀĀ", "aaaaaaab" * 50]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"])))
def test_encodes_as_the_library(text):
    ids = OURS.encode(text)
    assert ids == THEIRS.encode_ordinary(text)
    assert OURS.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abeinrst ", min_size=1, max_size=400))
def test_segment_tree_on_one_piece(text):
    piece = text.encode()
    if piece not in RANKS:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            ranked = [(RANKS[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in RANKS]
            if not ranked:
                break
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert bpe.merge_piece(piece, RANKS) == [RANKS[p] for p in parts]


def test_digests(documents):
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (None, "tie")]
    got = sorted(map(str, bpe.digests(documents(rows), PATH, PATTERN).collect()))
    want = []
    for i, t in rows:
        ids = THEIRS.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(f"Row(doc_id={a}, n_tokens={b}, ids_sha256='{c}', decoded_sha256='{d}')" for a, b, c, d in want)
    assert bpe.digests(documents([]), PATH, PATTERN).count() == 0


def test_round_trip(documents):
    rows = list(enumerate(TEXTS))
    back = bpe.decode(bpe.encode(documents(rows), PATH, PATTERN), PATH, PATTERN).collect()
    assert {r.doc_id: bytes(r.decoded) for r in back} == {i: (t or "").encode() for i, t in rows}


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_token_counts(documents, block):
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (-5, "minus"), (2**62 + 50304, "large id"), (None, "no id")]
    got = sorted(((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(documents(rows).repartition(3), PATH, PATTERN, block=block).collect()), key=str)
    assert got == sorted(((i, len(THEIRS.encode_ordinary(t or ""))) for i, t in rows), key=str)


def test_token_counts_of_nothing(documents):
    assert token_counts.count_tokens(documents([]), PATH, PATTERN).count() == 0
