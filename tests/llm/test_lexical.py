import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tradewind.llm import lexical as X

from .conftest import docs_of

PATTERN = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_terms(text):
    return PATTERN.findall((text or "").translate(LOWER))


def brute_force(rows, items, k):
    docs = [(i, Counter(plain_terms(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, length = len(docs), sum(n for _, _, n in docs)
    out = []
    for item, text in items:
        scores = Counter()
        for t in set(plain_terms(text)):
            df = sum(t in c for _, c, _ in docs)
            w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
            for at, (_, c, n) in enumerate(docs):
                if t in c:
                    m = 50 + 50 * n * n_docs // length
                    scores[at] += w * (10**9 * c[t] // (1000 * c[t] + 20 * m))
        order = sorted((-s, docs[at][0] is None, docs[at][0] or 0) for at, s in scores.items() if s > 0)[:k]
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(order, 1)]
    return sorted(out, key=str)


def found(rows):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows.collect()), key=str)


def test_terms_are_those_of_the_pattern():
    rng = random.Random(5)
    signs = [chr(c) for c in range(128)] + list("éÀß日  \U0001F600")
    for _ in range(200):
        text = "".join(rng.choice(signs) for _ in range(60))
        assert [t.decode() for t in X.terms_of(text)] == plain_terms(text)
    assert X.terms_of(None) == X.terms_of("") == X.terms_of(" -- ") == []


@pytest.mark.parametrize("k", [1, 3, 50])
def test_edges_equal_brute_force(spark, edge_docs, edge_rows, k):
    items = [(1, "the quick FOX"), (2, None), (3, ""), (4, "absent words"), (5, "the the 日本 river42 don't"), (5, "quick"),
             (None, "lazy dog é'll"), (6, " ".join(f"fox{i}" for i in range(9000)))]
    queries = spark.createDataFrame(items, "item_id int, text string").selectExpr("*", "0L AS rank", "'x' AS doc_id", "1 AS score")
    got = X.search(X.build(edge_docs), queries, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.schema["item_id"].dataType.simpleString() == "int"
    assert found(got) == brute_force([(i, t) for i, t, _ in edge_rows], items, k)


def test_many_copies_and_ties_equal_brute_force(spark):
    """A third of the rows are one text; small blocks of queries, small batches, thresholds from a sample."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, "w1 w2 w3 w1" if i % 3 == 0 else " ".join(rng.choices(words, k=rng.randrange(0, 40)))) for i in range(1500)]
    items = [(i, " ".join(rng.choices(words, k=8))) for i in range(12)]
    docs = docs_of(spark, [(i, t, "en") for i, t in rows]).repartition(7)
    queries = spark.createDataFrame(items, "item_id bigint, text string")
    old = X.BLOCK_TERMS, X.SEED_DOCS
    X.BLOCK_TERMS, X.SEED_DOCS = 30, 60
    try:
        assert found(X.search(X.build(docs), queries, 20)) == brute_force(rows, items, 20)
    finally:
        X.BLOCK_TERMS, X.SEED_DOCS = old


def test_empty_tables(spark, no_docs, edge_docs):
    queries = spark.createDataFrame([(1, "the")], "item_id bigint, text string")
    assert X.search(X.build(no_docs), queries).count() == 0
    none = X.search(X.build(edge_docs), queries.limit(0))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_hold_and_prune():
    """No bound is below its score, also where a sketch overflows or a count passes its byte; few absent terms pass."""
    rng = random.Random(2)
    texts = [" ".join(f"t{rng.randrange(3000)}" for _ in range(rng.randrange(1, 400))) for _ in range(300)] + ["many " * 700 + "few"]
    tallies = [Counter(X.terms_of(t)) for t in texts]
    vocabulary = sorted({t for c in tallies for t in c})
    counts = [np.array(list(c.values()), np.int64) for c in tallies]

    def batch(sketches):
        b = pa.RecordBatch.from_arrays(
            [pa.array(range(len(texts))), pa.array([int(c.sum()) for c in counts]), pa.array([b" ".join(c) + b" " for c in tallies]),
             pa.array([c.astype(np.int32).tobytes() for c in counts]), pa.array(sketches, pa.binary())], names=list("abcde"))
        block = X._Block([], vocabulary, n_docs=len(texts), n_terms=sum(int(c.sum()) for c in counts))
        return X._Batch(b, block, X._with_blank(vocabulary), lambda width: list(X._places(hashes, width)))

    hashes = X._hashes(vocabulary)
    full = batch([X.sketch(list(c), n) for c, n in zip(tallies, counts)])
    old, X.WIDEST = X.WIDEST, 128
    try:
        narrow = batch([X.sketch(list(c), n) for c, n in zip(tallies, counts)])
    finally:
        X.WIDEST = old
    passed = held = 0
    for _ in range(30):
        terms = np.array(sorted(rng.sample(range(len(vocabulary)), 12) + [vocabulary.index(b"many")]))
        weights = np.array([rng.randrange(0, 9000) for _ in terms])
        exact = full.scores(np.arange(len(texts)), terms, weights)
        for b in (full, narrow):
            assert (b.bounds(terms, weights.astype(float)) >= exact).all()
        passed += int((full.bounds(terms, weights.astype(float)) > 0).sum())
        held += int((exact > 0).sum())
    assert passed < 1.6 * held + 300
