import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tradewind.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    with open(RANKS, "rb") as f:
        return bpe.Encoder(f.read())


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_random_texts_equal_the_library(coder, library):
    rng = random.Random(1)
    letters = "aé's tre'vml  \n\t 　1٣!?'d_-日本' \x00\U0001F600S\x1c\x85"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(4000)] + [""]
    assert [ids(x) for x in coder.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_every_code_point_has_its_class(coder, library):
    points = [c for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000] + list(bpe.WHITE_SPACE)
    texts = ["a" + chr(c) + "b1 " + chr(c) + "!" + chr(c) for c in points]
    assert [ids(x) for x in coder.encode(texts)] == [library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("text", ["a" * 30_000, " " * 3000 + "x", "ab " * 20_000, "'" * 999 + "s", "x's" * 900, "\n \n" * 500])
def test_long_runs_and_segments(coder, library, text):
    parts = bpe.segments(text, 5000)
    assert "".join(parts) == text
    assert ids(b"".join(coder.encode(parts))) == library.encode_ordinary(text)


def test_scan_equals_stepping_through_the_automaton():
    move, starts = bpe._automaton()
    rng = np.random.default_rng(2)
    points = np.array([ord(c) for c in rng.choice(list("ab1 '\n!stle"), 20_000)], np.uint32)
    breaks = np.unique(np.r_[0, rng.integers(0, 20_000, 50)])
    got = {lane: bpe.pre_token_starts(points, breaks, lane).tolist() for lane in (2, 16, 256)}
    assert got[2] == got[16] == got[256]  # lanes of two nest the scan several times


def test_whole_operator(edge_docs, edge_rows, no_docs, library):
    back = bpe.decode(bpe.encode(edge_docs, RANKS), RANKS).collect()
    want = sorted((str(i), tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t, _ in edge_rows)
    assert sorted((str(r.doc_id), tuple(ids(r.ids)), bytes(r.decoded)) for r in back) == want
    assert bpe.decode(bpe.encode(no_docs, RANKS), RANKS).count() == 0


def test_offsets_cut_any_range(coder):
    text = "naïve 日本 don't stop".encode()
    data = coder.encode([text.decode()])[0]
    offsets = ids(coder.offsets(data))
    for a in range(len(offsets)):
        for z in range(a, len(offsets)):
            assert coder.decode(data, coder.offsets(data), a, z) == text[offsets[a]:offsets[z]]
