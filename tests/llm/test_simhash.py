import random

import numpy as np
import xxhash

from tradewind.llm import simhash as S

from .conftest import WORDS, docs_of


def plain_fingerprint(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_classes(fps, bits=4):
    """Smallest id reachable, by comparing all pairs."""
    up = list(range(len(fps)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= bits:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    best = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            best[root(i)] = min(d, best.get(root(i), d))
    return [(d, best.get(root(i))) for i, (d, _) in enumerate(fps)]


def test_fingerprints_match_plain_bits(documents, edge_rows):
    for text in [t for _, t, _ in edge_rows if len(t or "") < 1000] + [r.text for r in documents.limit(20).collect()]:
        assert S.fingerprint(text) == plain_fingerprint(text)
        assert S.fingerprint(text, 2) == plain_fingerprint(text, 2)


def test_classes_match_all_pairs(documents, edge_docs, edge_rows):
    for docs, rows in ((documents, [(r.doc_id, r.text) for r in documents.collect()]), (edge_docs, [(i, t) for i, t, _ in edge_rows])):
        want = plain_classes([(i, S.fingerprint(t)) for i, t in rows])
        got = [(r.doc_id, r.component_id) for r in S.near_dedup(docs).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def _close_fingerprints(n, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(4)]
    out = set(base)
    while len(out) < n:
        x = rng.choice(sorted(out)) if rng.random() < 0.7 else rng.choice(base)
        for _ in range(rng.randrange(1, 7)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def test_long_lists_lose_no_link(spark):
    fps = _close_fingerprints(300, 1)
    reps = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp bigint").repartition(3)
    want = plain_classes(list(enumerate(fps)))
    for hot_list in (2, 5, S.HOT_LIST):  # every list is passed on, some are, none is
        edges = S.links(reps, hot_list=hot_list)
        assert edges.where("bit_count(a ^ b) > 4").isEmpty()
        roots = {r.node: r.root for r in S.connected(edges).collect()}
        groups = {}
        for (i, c), f in zip(want, fps):
            s = int(np.uint64(f).astype(np.int64))
            groups.setdefault(c, set()).add(roots.get(s, s))
        assert all(len(g) == 1 for g in groups.values())
        assert len(set.union(*groups.values())) == len(groups)


def test_a_large_group_of_near_copies_emits_a_forest(spark):
    base = 0x0123456789ABCDEF
    fps = {base} | {base ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)}
    reps = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in sorted(fps)], "fp bigint")
    edges = S.links(reps).count()
    assert edges < 20 * len(fps)  # 2017 fingerprints have over 2 million links


def test_empty_table_and_links_beyond_four_bits(spark, no_docs):
    assert S.near_dedup(no_docs).count() == 0 and S.keep_first(no_docs).count() == 0
    import pytest
    with pytest.raises(ValueError):
        S.links(spark.createDataFrame([(1,)], "fp bigint"), max_bits=5)


def test_keep_first_keeps_one_whole_row_of_each_class(spark, edge_docs):
    kept = S.keep_first(edge_docs)
    assert kept.columns == edge_docs.columns
    rows = kept.collect()
    classes = {(r.class_fp) for r in S.near_dedup(edge_docs).collect()}
    assert len(rows) == len(classes)
    ids = [r.doc_id for r in rows]
    assert ids.count(7) == 1 and 8 not in ids and ids.count(None) == 1
    assert all(r.score == 9.5 and r.component_id == "c" for r in rows)
    many = docs_of(spark, [(i % 3, " ".join(WORDS), "en") for i in range(60)])
    assert [r.doc_id for r in S.keep_first(many).collect()] == [0]


def test_keep_first_keeps_classes_that_share_an_id(spark):
    x, y, *others = (" ".join(f"{w}{n}" for w in WORDS) for n in range(8))
    kept = S.keep_first(docs_of(spark, [(3, x, "en"), (5, x, "en"), (5, y, "en")]))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, x), (5, y)]
    rows = [(7, t, lang) for t in others for lang in ("fr", "en")] + [(9, y, "en"), (None, x, "en"), (None, x, "de")]
    kept = S.keep_first(docs_of(spark, rows))
    assert sorted(((r.doc_id, r.text, r.lang) for r in kept.collect()), key=str) == \
        sorted([(7, t, "en") for t in others] + [(9, y, "en"), (None, x, "de")], key=str)
