import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewind.llm import kdtree, kmeans_tree

SCHEMA = "vec_id bigint, embedding array<float>, page string, v string, asks string, leaf string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "p", "v", "a", "l") for i, v in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 8)) * 0.3
    out = [(i, (base[i % 6] + 0.02 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(400)]
    out += [(i, [0.25] * 8) for i in range(400, 560)]  # one vector holds many rows
    out += [(1000, None), (1001, [0.1, None] * 4), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8), (None, [0.1] * 8), (1005, [0.0] * 8),
            (1020, [0.5, 0.5]), (20, out[20][1]), (20, out[20][1]), (20, [0.5] * 8), (40, [-0.5] * 8), (7, [0.75] * 8), (7, [0.75] * 8)]
    out += [(60, [0.3] * 8)] * 9  # one row many times, more often than hits are asked for
    return out


def usable(rows, nonzero=False):
    """Rows that take part, each for itself."""
    return [(i, v) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (not nonzero or any(v))]


def plain_top(rows, k, every):
    vecs = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in usable(rows)]
    out = []
    for n, (q, a) in enumerate(vecs):
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(vecs) if m != n)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [40, 100_000])
def test_exact_top_k(spark, rows, shard_rows):
    got = kdtree.top_k(table(spark, rows), F.col("vec_id") % 20 == 0, k=5, shard_rows=shard_rows)
    assert sorted(map(tuple, got.collect())) == plain_top(rows, 5, 20)


def test_sql_of_the_exact_search_with_repeated_ids(spark, rows, tmp_path):
    """The operator and its SQL agree where one id stands on many rows with different vectors."""
    import duckdb

    from tradewind.llm.queries import ORACLE, QUERIES
    rng = random.Random(4)
    full = [(i, v) for i, v in rows if v is None or len(v) == 8]
    full += [(50, [rng.random() for _ in range(8)]) for _ in range(200)] + [(0, [0.5] * 8)] * 3
    table(spark, full).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    rel = con.sql(ORACLE["op1_exact_top_k"])
    got = QUERIES["op1_exact_top_k"](spark, str(tmp_path)).select(*rel.columns).collect()
    assert sorted(map(tuple, got)) == sorted(rel.fetchall()) and len(got) > 1000


def test_few_and_no_rows(spark):
    assert kdtree.top_k(table(spark, []), F.col("vec_id") % 2 == 0).count() == 0
    assert kmeans_tree.search(table(spark, []), F.col("vec_id") % 2 == 0).count() == 0
    few = [(0, [1.0, 2.0]), (1, [1.0, -2.0]), (2, [0.5, 0.5])]
    assert sorted(map(tuple, kdtree.top_k(table(spark, few), F.col("vec_id") == 0).collect())) == plain_top(few, 5, 100)
    assert [(r.vec_id, r["rank"]) for r in kmeans_tree.search(table(spark, few), F.col("vec_id") == 0).orderBy("rank").collect()] == [(2, 1), (1, 2)]


@pytest.mark.parametrize("scale", [1, 1 << 30, 1 << 55])
def test_search_is_exact_at_every_magnitude(scale):
    rng = random.Random(2)
    points = np.array([[rng.randint(-9, 9) * scale for _ in range(4)] for _ in range(300)], dtype=np.int64)
    ids = np.arange(300)
    tree = kdtree.build(points, 8)
    order = tree["order"]
    big = points.astype(object)
    for i, hits in kdtree.search(tree, ids[order], points[order], points[:10], ids[:10], 7):
        want = sorted((-int(s), int(v)) for v, s in enumerate(big @ big[i]) if v != i)[:7]
        assert sorted((-s, v) for s, v in hits) == want


def test_tree_boxes_are_tight_and_halves_even():
    rng = np.random.default_rng(3)
    points = rng.integers(-50, 50, (1000, 5))
    t = kdtree.build(points, 16)
    for n in range(len(t["start"])):
        own = points[t["order"][t["start"][n]:t["end"][n]]]
        assert (own.min(0) == t["low"][n]).all() and (own.max(0) == t["high"][n]).all()
        if t["left"][n] >= 0:
            a, b = (t["end"][c] - t["start"][c] for c in (t["left"][n], t["left"][n] + 1))
            assert abs(a - b) <= 1


def test_approximate_neighbours_with_hot_leaf(spark, rows):
    """Rows that repeat an id are candidates and queries each; recall against brute force over all rows."""
    got = kmeans_tree.search(table(spark, rows), F.col("vec_id") % 20 == 0, k=20, leaf_rows=40, page_rows=50, block_queries=7).collect()
    vecs = [(i, np.pad(np.array(v, np.float32).astype(float), (0, 8 - len(v)))) for i, v in usable(rows, nonzero=True)]
    ids, x = np.array([i for i, _ in vecs]), np.stack([v for _, v in vecs])
    found = total = 0
    for q in sorted({i for i, _ in vecs if i % 20 == 0}):
        asking = [n for n, i in enumerate(ids) if i == q]
        mine = [r for r in got if r.query_id == q]
        assert sorted(r["rank"] for r in mine) == sorted(list(range(1, 21)) * len(asking))
        for rank in range(1, 21):
            assert len([r for r in mine if r["rank"] == rank]) == len(asking)
        want, have = [], sorted((-r.score, r.vec_id) for r in mine)
        for n in asking:
            s = x @ x[n]
            s[n] = -np.inf
            want += sorted(zip(-s, ids))[:20]
        for score, vec in have:
            assert any(abs(float(x[m] @ x[n]) + score) < 1e-12 for m in np.flatnonzero(ids == vec) for n in asking)
        least = sorted(round(w[0], 9) for w in want)
        mine_ = sorted(round(h[0], 9) for h in have)
        found += sum(min(least.count(v), mine_.count(v)) for v in set(least))
        total += 20 * len(asking)
    assert found >= 0.9 * total


def test_equal_vectors_have_equal_scores(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(5, 33))
    rows = [(i, base[i % 5].astype(np.float32).tolist()) for i in range(500)]
    got = kmeans_tree.search(table(spark, rows), F.col("vec_id") % 50 == 0, k=20, leaf_rows=16, page_rows=37, block_queries=3).collect()
    for q in range(0, 500, 50):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert len({r.score for r in mine}) == 1 and [r.vec_id for r in mine] == [i for i in range(q % 5, 500, 5) if i != q][:20]


def test_recall_on_the_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = kmeans_tree.search(e, F.col("vec_id") % 20 == 0, k=20, leaf_rows=64).collect()
    p = e.toPandas()
    x = np.stack(p.embedding).astype(float)
    at = {v: i for i, v in enumerate(p.vec_id)}
    found = total = 0
    for q in {r.query_id for r in got}:
        s = x @ x[at[q]]
        s[at[q]] = -np.inf
        best = set(p.vec_id.to_numpy()[np.argsort(-s)[:20]].tolist())
        found += len(best & {r.vec_id for r in got if r.query_id == q})
        total += 20
    assert total == 2000 and found >= 0.9 * total
