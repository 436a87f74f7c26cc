import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tradewind.llm import spelling as S

from .conftest import docs_of

LOWER = {c: c + 32 for c in range(65, 91)}


def plain_words(rows):
    tally = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if h % 199 == 0:
                low = low[:h % len(low)] + low[h % len(low) + 1:]
            tally[low] += 1
    return {w: n for w, n in tally.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute_force(words):
    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def found(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in df.collect())


def vocabulary(seed, size):
    """Words with many near ones, repeated letters, shared endings and counts that chain."""
    rng = random.Random(seed)
    letters = "abenrtßéÿ"
    words = {}
    while len(words) < size:
        if words and rng.random() < 0.6:
            w = list(rng.choice(list(words)))
            at = rng.randrange(len(w) + 1)
            kind = rng.randrange(3)
            if kind == 0:
                w.insert(at, rng.choice(letters))
            elif at < len(w):
                w[at:at + 1] = [rng.choice(letters)] if kind == 1 else []
            w = "".join(w)
        else:
            w = "".join(rng.choice(letters) for _ in range(rng.randrange(4, 12))) + rng.choice(["", "ation", "erer", "aaaa"])
        if len(w) >= 6:
            words.setdefault(w, rng.choice([5, 6, 25, 30, 125, 700, 5000]))
    words["a" * 300], words["a" * 301], words["b" + "a" * 300] = 5, 30, 150
    return words


@pytest.mark.parametrize("seed, dictionary, hot", [(1, 65_536, 4_096), (2, 300, 7), (3, 40, 25), (4, 1, 3)])
def test_groups_equal_brute_force(spark, monkeypatch, seed, dictionary, hot):
    """Few or many frequent grams, lists in blocks or not."""
    monkeypatch.setattr(S, "DICTIONARY", dictionary)
    words = vocabulary(seed, 700)
    table = spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(5)
    assert found(S.group(table, hot_list=hot)) == brute_force(words)


def test_near_pairs_share_grams_and_prefixes():
    """The bounds: kept grams of near words are at least grams - bound, and their first bound + 1 grams meet."""
    rng = random.Random(9)
    words = list(vocabulary(5, 600))
    grams = Counter(w[i:i + n].ljust(n) for w in words for i in range(len(w)) for n in (2, 3))
    code = lambda g: sum(b << 24 - 8 * i for i, b in enumerate(g.encode("latin-1")))
    for limit in (0, 3, 20):
        dictionary = np.array(sorted(code(g) for g, n in grams.items() if n > limit), np.uint32)
        made = S.Words(words, dictionary)
        own = [Counter(made.gram[s:s + n].tolist()) for s, n in zip(made.start, made.size)]
        df = Counter(g for c in own for g in c.elements())
        known = np.array(sorted(g for g, n in df.items() if n > limit), np.uint32)
        first = {}
        for w, g, e in zip(*made.prefixes((known, np.array([df[int(g)] for g in known])))):
            first.setdefault(int(w), set()).add((int(g), int(e)))
        assert all(len(first[i]) == made.bound[i] + 1 for i in range(len(words)))
        pairs = 0
        for i, j in ((i, j) for i in range(len(words)) for j in range(i) if abs(len(words[i]) - len(words[j])) < 2):
            if one_edit(words[i], words[j]):
                pairs += 1
                assert (own[i] & own[j]).total() >= max(made.size[i] - made.bound[i], made.size[j] - made.bound[j]) >= 2
                assert first[i] & first[j]
        assert pairs > 100


def test_documents_equal_brute_force(spark, edge_docs, edge_rows):
    assert found(S.variants(edge_docs)) == brute_force(plain_words([(i, t) for i, t, _ in edge_rows]))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = plain_words([(r.doc_id, r.text) for r in docs.collect()])
    assert found(S.variants(docs)) == brute_force(words) and any(r[1] for r in brute_force(words))


def test_counts_equal_plain_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = plain_words([(r.doc_id, r.text) for r in docs.collect()])
    assert {r["word"]: r["n"] for r in S.count_words(docs).collect()} == want


def test_hot_word_and_empty_table(spark, no_docs):
    rows = [(i, "Wordless WORDLESS wordlexs ×÷÷÷÷÷" if i % 3 else "wordlesss", "en") for i in range(90)]
    want = brute_force(plain_words([(i, t) for i, t, _ in rows]))
    assert found(S.variants(docs_of(spark, rows))) == want and len(want) >= 3
    assert S.variants(no_docs).count() == 0
