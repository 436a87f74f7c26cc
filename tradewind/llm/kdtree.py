"""Exact top-k by inner product with a KD-tree per shard.

Vectors become integers (``floor(scale * x)``) and are dealt to shards by row.  Each shard is a KD-tree:
median splits on the widest side, and at every node the tight box of its points.  A query's best
possible inner product with a box bounds what lies in it.  The traversal takes the node of the highest
bound first and ends when that bound is below the query's kth score so far.

A query first searches the shard it lives in; its kth score there goes with it to the other shards,
where only better or equal points can still count.  Bounds and scores are integer sums, so nothing is
lost to rounding.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors
from .storage import map_batches, ship_package, store

SHARD_ROWS = 16_384
LEAF_ROWS = 128
HITS = "query bigint, vec_id bigint, score bigint"


def _exact(a: np.ndarray, b: np.ndarray) -> type:
    """A number type in which every inner product of rows of ``a`` and ``b`` is exact."""
    most = int(np.abs(a.astype(object)).max(initial=0)) * int(np.abs(b.astype(object)).max(initial=0)) * max(1, a.shape[-1])
    return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object


def build(points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> dict[str, np.ndarray]:
    """KD-tree over integer rows: the order of rows, and for each node its range, children (-1: leaf) and box."""
    order = np.arange(len(points))
    start, end, left, low, high = [], [], [], [], []

    def add(a: int, z: int) -> int:
        box = points[order[a:z]]
        start.append(a)
        end.append(z)
        left.append(-1)
        low.append(box.min(0))
        high.append(box.max(0))
        return len(start) - 1

    todo = [add(0, len(points))] if len(points) else []
    while todo:
        node = todo.pop()
        a, z = start[node], end[node]
        spread = high[node] - low[node]
        if z - a <= leaf_rows or not len(spread) or not spread.max():
            continue
        axis, middle = int(spread.argmax()), (z - a) // 2
        own = order[a:z]
        order[a:z] = own[np.argpartition(points[own, axis], middle)]
        left[node] = add(a, a + middle)  # its right sibling follows it
        todo += [left[node], add(a + middle, z)]
    width = points.shape[1]
    return {"order": order, "start": np.array(start, np.int64), "end": np.array(end, np.int64), "left": np.array(left, np.int64),
            "low": np.array(low, points.dtype).reshape(-1, width), "high": np.array(high, points.dtype).reshape(-1, width)}


def search(tree: dict[str, np.ndarray], ids: np.ndarray, points: np.ndarray, queries: np.ndarray, query_rows: np.ndarray,
           k: int, kth: list | None = None, rows: np.ndarray | None = None) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(position of the query, [(score, vec_id)]): its best k points of this tree whose score reaches ``kth``.

    ``points``, ``ids`` and ``rows`` (row numbers; the ids, if not given) are in the tree's order.  A query's own
    row never counts.
    """
    if not len(points) or not len(queries):
        return
    queries = vectors.fit_width(queries, points.shape[1])
    kind = _exact(queries, points)
    q, x = queries.astype(kind), points.astype(kind)
    zero = kind(0) if kind is not object else 0
    bound = np.maximum(q, zero) @ tree["high"].astype(kind).T + np.minimum(q, zero) @ tree["low"].astype(kind).T
    start, end, left = (tree[n].tolist() for n in ("start", "end", "left"))
    rows = ids if rows is None else rows
    for i in range(len(q)):
        least = kth[i] if kth is not None and kth[i] is not None else -float("inf")
        best: list[tuple[int, int]] = []  # the k best as (score, -id), worst first
        b = bound[i].tolist()
        heap = [(-b[0], 0)]
        own = int(query_rows[i])
        while heap:
            top, node = heapq.heappop(heap)
            if -top < least:  # an equal bound may hold an equal score with a smaller id
                break
            if left[node] >= 0:
                for child in (left[node], left[node] + 1):
                    if b[child] >= least:
                        heapq.heappush(heap, (-b[child], child))
                continue
            a = start[node]
            scores = x[a:end[node]] @ q[i]
            for at in np.flatnonzero(scores >= least):
                if rows[a + at] == own:
                    continue
                hit = (int(scores[at]), -int(ids[a + at]))
                if len(best) < k:
                    heapq.heappush(best, hit)
                else:
                    heapq.heappushpop(best, hit)
                if len(best) == k:
                    least = max(least, best[0][0])
        yield i, [(s, -v) for s, v in best]


def _rows(found: Iterator, query_rows: np.ndarray) -> tuple[list, list, list]:
    q, v, s = [], [], []
    for i, hits in found:
        for score, vec in hits:
            q.append(int(query_rows[i]))
            v.append(vec)
            s.append(score)
    return q, v, s


def _smallest(points: np.ndarray) -> np.ndarray:
    for kind in (np.int16, np.int32):
        if not points.size or (points.min() >= np.iinfo(kind).min and points.max() <= np.iinfo(kind).max):
            return points.astype(kind)
    return points


def _build_shard(table: pa.Table) -> pa.Table:
    points = _smallest(vectors.matrix(table["v"], np.int64))
    tree = build(points)
    order = tree.pop("order")
    data = vectors.dump(ids=table["vec_id"].to_numpy()[order], rows=table["row"].to_numpy()[order], points=points[order],
                        asks=table["asks"].to_numpy(zero_copy_only=False)[order], **tree)
    return pa.table({"page": pa.array([table["page"][0].as_py()], pa.int64()), "data": pa.array([data], pa.binary())})


def _search_home(k: int):
    """Each shard's own queries: hits in the shard, and the block (ids, vectors, kth scores) that goes on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for page, data in zip(b.column(0).to_pylist(), b.column(1)):
                t = vectors.load(data.as_py())
                ids, rows, points, asks = t["ids"], t["rows"], t["points"], t["asks"]
                if not asks.any():
                    continue
                found = list(search(t, ids, points, points[asks], rows[asks], k, rows=rows))
                kth = np.array([min(h)[0] if len(h) == k else np.iinfo(np.int64).min for _, h in found], np.int64)
                block = vectors.dump(rows=rows[asks], points=points[asks], kth=kth)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([page], pa.int64()), pa.array([block], pa.binary()), *[pa.array([c], pa.list_(pa.int64())) for c in _rows(iter(found), rows[asks])]],
                    names=["block", "data", "query", "vec_id", "score"])
    return run


def _search_other(k: int):
    def run(key: tuple, pages: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        rows: tuple[list, list, list] = ([], [], [])
        for data in pages["data"]:
            t = vectors.load(data)
            for block in blocks["data"]:
                b = vectors.load(block)
                kth = [None if x == np.iinfo(np.int64).min else int(x) for x in b["kth"]]
                for own, new in zip(rows, _rows(search(t, t["ids"], t["points"], b["points"], b["rows"], k, kth, t["rows"]), b["rows"])):
                    own += new
        return pd.DataFrame(dict(zip(("query", "vec_id", "score"), rows)), dtype=np.int64)
    return run


def top_k(rows: DataFrame, queries: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id",
          vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``queries`` (over ``vec_id``) holds, its k best others.

    Every row is a candidate for every other row: rows that repeat an id, with the same vector or another,
    count each and ask each for themselves.  Rows with a null id, a null vector or a null or non-finite
    component take no part.  Shorter vectors end in zeros.  Scaled components are limited to
    the range of a long; a score beyond a long is an error.  An empty table gives no rows.
    """
    ship_package(rows.sparkSession)
    points = vectors.numbered(rows, id_col, vector_col, queries, k, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    n = points.count()
    shards = max(1, -(-n // shard_rows))
    dealt = points.withColumn("page", F.pmod(F.xxhash64("row"), F.lit(shards)))
    trees = store(dealt.drop("copies").groupBy("page").applyInArrow(_build_shard, "page bigint, data binary"))
    home = store(map_batches(trees, _search_home(k), "block bigint, data binary, query array<bigint>, vec_id array<bigint>, score array<bigint>"))
    hits = home.select(F.explode(F.arrays_zip("query", "vec_id", "score")).alias("h")).select("h.*")
    if shards > 1:
        others = F.array_remove(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint")), F.col("block"))
        away = home.select("block", "data", F.explode(others).alias("page"))
        hits = hits.unionAll(vectors.meet(trees, away, shards, _search_other(k), HITS))
    return vectors.results(hits, points, k)
