"""Approximate nearest neighbours by inner product: a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample: every node splits its sample rows by k-means into ``branches``
children until a leaf holds about ``leaf_rows`` rows of the table (``max_leaves`` at most).  All rows are
then indexed: each goes down the tree to its leaf.  Leaves are stored together in pages of bounded size;
a leaf that is larger than a page is dealt over several pages, all of which a visit reads.

A query takes the nodes of the tree from a priority queue, highest inner product with the node's centre
first, and visits the leaves in the order in which they come up.  How many leaves are visited is
calibrated on the table: for a sample of queries the exact neighbours are computed over all rows, and
the visits are widened until ``target_recall`` of them lie in visited leaves.  Scores are inner products
of the original vectors in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors
from .storage import map_batches, ship_package, store, type_of

SAMPLE_ROWS = 16_384
BRANCHES = 8
LEAF_ROWS = 256
MAX_LEAVES = 1024
PAGE_ROWS = 8192
BLOCK_QUERIES = 1024
CALIBRATION_QUERIES = 128
TARGET_RECALL = 0.97
HITS = "query bigint, vec_id bigint, score double"


@dataclass
class Tree:
    """``centres[node]``, ``first_child[node]`` and ``children[node]`` (0: leaf), ``leaf[node]`` (-1: inner)."""

    centres: np.ndarray
    first_child: np.ndarray
    children: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max(initial=-1)) + 1

    def assign(self, points: np.ndarray) -> np.ndarray:
        """Leaf of every row: the nearest child at every level."""
        points = vectors.fit_width(points, self.centres.shape[1])
        node = np.zeros(len(points), np.int64)
        todo = [0]
        while todo:
            n = todo.pop()
            if not self.children[n]:
                continue
            own = np.flatnonzero(node == n)
            kids = np.arange(self.first_child[n], self.first_child[n] + self.children[n])
            todo += kids.tolist()
            if len(own):
                node[own] = kids[_nearest(points[own], self.centres[kids])]
        return self.leaf[node]

    def visits(self, queries: np.ndarray, most: int) -> list[list[int]]:
        """The first ``most`` leaves of each query by best-bin-first traversal."""
        near = (vectors.fit_width(queries, self.centres.shape[1]) @ self.centres.T).tolist()
        first, count, leaf = self.first_child.tolist(), self.children.tolist(), self.leaf.tolist()
        out = []
        for row in near:
            heap, found = [(0.0, 0)], []
            while heap and len(found) < most:
                _, n = heapq.heappop(heap)
                if leaf[n] >= 0:
                    found.append(leaf[n])
                for c in range(first[n], first[n] + count[n]):
                    heapq.heappush(heap, (-row[c], c))
            out.append(found)
        return out


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres ** 2).sum(1) - 2 * (points @ centres.T)).argmin(1)


def _kmeans(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(rounds):
        own = _nearest(points, centres)
        for c in range(k):
            mine = points[own == c]
            if len(mine):
                centres[c] = mine.mean(0)
    own = _nearest(points, centres)
    used = np.unique(own)
    return centres[used], np.searchsorted(used, own)


def fit(sample: np.ndarray, leaves: int, branches: int = BRANCHES, seed: int = 1) -> Tree:
    """Tree of about ``leaves`` leaves over the rows of ``sample``."""
    rng = np.random.default_rng(seed)
    small = max(2, len(sample) // max(1, leaves))
    centres, first, count = [sample.mean(0)], [0], [0]
    todo = [(0, np.arange(len(sample)))]
    while todo:
        node, rows = todo.pop(0)
        if len(rows) <= 1.5 * small or not np.ptp(sample[rows], axis=0).any():
            continue
        c, own = _kmeans(sample[rows].copy(), min(branches, max(2, len(rows) // small)), rng)
        if len(c) < 2:
            continue
        first[node], count[node] = len(centres), len(c)
        for i in range(len(c)):
            todo.append((len(centres), rows[own == i]))
            centres.append(c[i])
            first.append(0)
            count.append(0)
    count_ = np.array(count)
    leaf = np.where(count_ == 0, np.cumsum(count_ == 0) - 1, -1)
    return Tree(np.array(centres), np.array(first), count_, leaf)


def _as_matrix(rows: list) -> np.ndarray:
    return vectors.matrix(pa.array([r["v"] for r in rows], pa.list_(pa.float64())), np.float64)


def _indexed(points: DataFrame, tree: Tree) -> DataFrame:
    """(row, vec_id, v, leaf) of every row."""
    sent = points.sparkSession.sparkContext.broadcast(tree)  # bounded by the fitted sample and max_leaves

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = sent.value.assign(vectors.matrix(b.column(2), np.float64)) if b.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int64())], names=["row", "vec_id", "v", "leaf"])
    return map_batches(points.select("row", "vec_id", "v"), run, f"row bigint, vec_id bigint, v {type_of(points, 'v')}, leaf bigint")


def _page(table: pa.Table) -> pa.Table:
    """One stored page: its rows by leaf."""
    leaf = table["leaf"].to_numpy()
    order = np.lexsort((table["vec_id"].to_numpy(), leaf))
    kind = np.float32 if pa.types.is_float32(table["v"].type.value_type) else np.float64
    data = vectors.dump(ids=table["vec_id"].to_numpy()[order], rows=table["row"].to_numpy()[order], leaf=leaf[order], points=vectors.matrix(table["v"], kind)[order])
    return pa.table({"page": pa.array([table["page"][0].as_py()], pa.int64()), "data": pa.array([data], pa.binary())})


def _best(ids: np.ndarray, points: np.ndarray, query: np.ndarray, k: int, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the k highest inner products, ties to the smaller id.

    A matrix product adds in an order of its own, so it only leaves out rows that are surely too low
    (``longest`` is the greatest length of a row); scores add up in the same order for every row.
    """
    at = np.arange(len(ids))
    if len(ids) > k:
        rough = points @ query
        slack = 1e-14 * points.shape[1] * longest * float(np.sqrt(query @ query)) + 1e-300
        at = np.flatnonzero(rough >= np.partition(rough, len(ids) - k)[len(ids) - k] - slack)
    scores = (points[at] * query).sum(1)
    order = np.lexsort((ids[at], -scores))[:k]
    return at[order], scores[order]


def _longest(points: np.ndarray) -> float:
    return float(np.sqrt((points ** 2).sum(1).max(initial=0.0)))


def _search_page(k: int):
    """Each query's k best rows among the leaves of a page that it visits."""
    def run(key: tuple, pages: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = [[], [], []]
        for data in pages["data"]:
            p = vectors.load(data)
            points, ids, rows = p["points"].astype(np.float64), p["ids"], p["rows"]
            longest = _longest(points)
            leaves, start = np.unique(p["leaf"], return_index=True)
            end = np.r_[start[1:], len(ids)]
            for block in blocks["data"]:
                b = vectors.load(block)
                queries = vectors.fit_width(b["points"], points.shape[1])
                for i, query in enumerate(b["rows"].tolist()):
                    seen = np.flatnonzero(np.isin(leaves, b["leaf"][b["at"][i]:b["at"][i + 1]]))
                    if not len(seen):
                        continue
                    own = np.concatenate([np.arange(start[s], end[s]) for s in seen])
                    own = own[rows[own] != query]
                    at, scores = _best(ids[own], points[own], queries[i], k, longest)
                    out[0] += [query] * len(at)
                    out[1] += ids[own[at]].tolist()
                    out[2] += scores.tolist()
        return pd.DataFrame({"query": np.array(out[0], np.int64), "vec_id": np.array(out[1], np.int64), "score": np.array(out[2], np.float64)})
    return run


def _blocks(asking: DataFrame, n_blocks: int, tree: Tree, most: int, pages_of: dict[int, list[int]]) -> DataFrame:
    """(page, block, data): the queries of a block with the leaves that each visits on the page."""
    sent = asking.sparkSession.sparkContext.broadcast((tree, pages_of))

    def run(table: pa.Table) -> pa.Table:
        tree, pages_of = sent.value
        rows, points = table["row"].to_numpy(), vectors.matrix(table["v"], np.float64)
        by_page: dict[int, list[tuple[int, int]]] = {}
        for i, visited in enumerate(tree.visits(points, most)):
            for leaf in visited:
                for page in pages_of.get(leaf, ()):
                    by_page.setdefault(page, []).append((i, leaf))
        data = []
        for pairs in by_page.values():
            place, leaf = np.array(pairs).T
            own, at = np.unique(place, return_index=True)
            data.append(vectors.dump(rows=rows[own], points=points[own], leaf=leaf, at=np.r_[at, len(leaf)]))
        return pa.table({"page": pa.array(list(by_page), pa.int64()), "block": pa.array([table["block"][0].as_py()] * len(data), pa.int64()),
                         "data": pa.array(data, pa.binary())})
    dealt = asking.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("bigint"))
    return dealt.groupBy("block").applyInArrow(run, "page bigint, block bigint, data binary")


def _exact_leaves(index: DataFrame, rows: list, k: int) -> dict[int, list[int]]:
    """Leaves of the exact k nearest rows of each calibration query (by its row number), over all rows."""
    sent = index.sparkSession.sparkContext.broadcast((np.array([r["row"] for r in rows]), _as_matrix(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking, queries = sent.value
        best: list[list[tuple[float, int, int]]] = [[] for _ in asking]
        for b in batches:
            row, vec, points, leaf = b.column(0).to_numpy(), b.column(1).to_numpy(), vectors.matrix(b.column(2), np.float64), b.column(3).to_numpy()
            if not len(vec):
                continue
            longest, wide = _longest(points), vectors.fit_width(queries, points.shape[1])
            for i, query in enumerate(asking):
                keep = np.flatnonzero(row != query)
                at, scores = _best(vec[keep], points[keep], wide[i], k, longest)
                best[i] = sorted(best[i] + list(zip((-scores).tolist(), vec[keep[at]].tolist(), leaf[keep[at]].tolist())))[:k]
        out = [(int(q), v, -s, l) for q, hits in zip(asking, best) for s, v, l in hits]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64()))],
                                         names=["query", "vec_id", "score", "leaf"])
    exact = vectors.best_rows(map_batches(index.select("row", "vec_id", "v", "leaf"), run, f"{HITS}, leaf bigint"), k)
    out: dict[int, list[int]] = {}
    for r in exact.collect():  # at most CALIBRATION_QUERIES * k rows
        out.setdefault(r["query"], []).append(r["leaf"])
    return out


def calibrate(index: DataFrame, tree: Tree, rows: list, k: int, target_recall: float) -> tuple[int, float]:
    """(leaves to visit, recall of the calibration queries): widened until the recall is reached."""
    truth = _exact_leaves(index, rows, k)
    order = tree.visits(_as_matrix(rows), tree.leaves)
    reached = np.zeros(tree.leaves + 1)
    total = 0
    for r, visited in zip(rows, order):
        place = {leaf: n for n, leaf in enumerate(visited, 1)}
        for leaf in truth.get(r["row"], ()):
            reached[place[leaf]] += 1
            total += 1
    recall = np.cumsum(reached) / max(1, total)
    most = int(np.argmax(recall >= min(target_recall, recall[-1])))
    return max(1, most), float(recall[max(1, most)])


def search(rows: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           target_recall: float = TARGET_RECALL, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS,
           max_leaves: int = MAX_LEAVES, page_rows: int = PAGE_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``queries`` (over ``vec_id``) holds, its k nearest found.

    Every row is a candidate for every other row: rows that repeat an id, with the same vector or another,
    count each and ask each for themselves.  Rows with a null id, a null or zero vector, or a null or
    non-finite component take no part.  Shorter vectors end in zeros.  Visits go on past the
    calibrated number until the visited leaves hold k other rows.  An empty table gives no rows.
    """
    spark = rows.sparkSession
    ship_package(spark)
    points = vectors.numbered(rows, id_col, vector_col, queries, k, nonzero=True)
    n, asking = points.agg(F.count("*"), F.sum(F.col("asks").cast("bigint"))).first()
    if not asking:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    by_hash = points.withColumn("h", F.xxhash64(F.lit(7), "vec_id", "v"))
    sample = _as_matrix(by_hash.orderBy("h", "row").limit(sample_rows).collect())
    tree = fit(sample, min(max_leaves, max(1, n // leaf_rows)))
    index = store(_indexed(points, tree))

    held = {r["leaf"]: r["n"] for r in index.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # max_leaves at most
    first_page, parts, pages_of, page, filled = {}, {}, {}, -1, page_rows
    for leaf in sorted(held):
        if held[leaf] > page_rows:  # a hot leaf takes pages of its own
            first_page[leaf], parts[leaf] = page + 1, -(-held[leaf] // page_rows)
            page, filled = page + parts[leaf], page_rows
        else:
            if filled + held[leaf] > page_rows:
                page, filled = page + 1, 0
            first_page[leaf], parts[leaf], filled = page, 1, filled + held[leaf]
        pages_of[leaf] = list(range(first_page[leaf], first_page[leaf] + parts[leaf]))

    def of_leaf(values: dict[int, int]) -> Column:
        return F.element_at(F.array([F.lit(values.get(i, 0)).cast("bigint") for i in range(tree.leaves)]), (F.col("leaf") + 1).cast("int"))

    placed = index.withColumn("page", of_leaf(first_page) + F.pmod(F.xxhash64("row"), of_leaf(parts)))
    pages = store(placed.select("page", "row", "vec_id", "v", "leaf").groupBy("page").applyInArrow(_page, "page bigint, data binary"))

    some = by_hash.where("asks").orderBy("h", "row").limit(CALIBRATION_QUERIES).collect()
    most, _ = calibrate(index, tree, some, k, target_recall)
    fewest = sorted(held.values())
    while most < len(fewest) and sum(fewest[:most]) <= k:  # any choice of so many leaves holds k other rows
        most += 1
    n_blocks = max(1, -(-asking // block_queries))
    blocks = store(_blocks(points.where("asks").select("row", "v"), n_blocks, tree, most + tree.leaves - len(held), pages_of))
    return vectors.results(vectors.meet(pages, blocks, n_blocks, _search_page(k), HITS), points, k)
