"""Vector tables: valid rows, packing of row groups into one value, blocks of queries, and top-k rows."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import ship_package, store

#: blocks of queries that meet a page of rows in one group
BLOCKS_TOGETHER = 16


def numbered(rows: DataFrame, id_col: str, vector_col: str, queries: Column, k: int, element=None, nonzero: bool = False) -> DataFrame:
    """The stored (row, vec_id, v, asks, copies): rows with an id whose vector is not null and has finite components only.

    ``element`` maps each component.  Rows that repeat an id with another vector are rows of their own.
    Equal rows are counted before the shuffle, so that they are one row per task; no more than ``k + 1`` of
    them can matter as candidates, and each of these has its own ``row`` number.  The first of them asks, if
    ``queries`` (over ``vec_id``) holds, for all ``copies``.
    """
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    keep = F.col(id_col).isNotNull() & v.isNotNull() & ~bad
    if nonzero:
        keep = keep & F.exists(v, lambda x: x != 0)
    out = rows.where(keep).select(F.col(id_col).cast("bigint").alias("vec_id"), (F.transform(v, element) if element else v).alias("v"))
    out = out.groupBy("vec_id", "v").agg(F.count("*").alias("copies"))
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.col("copies"), F.lit(k + 1).cast("bigint"))))
    out = out.withColumn("asks", F.coalesce(queries, F.lit(False))).select("vec_id", "v", "asks", "copies", each.alias("copy"))
    out = out.select("vec_id", "v", (F.col("asks") & (F.col("copy") == 1)).alias("asks"), "copies")
    return store(out.withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "v", "asks", "copies"))


def matrix(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """Rows of a list column; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    width = int(sizes.max(initial=0))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def fit_width(a: np.ndarray, width: int) -> np.ndarray:
    """The first ``width`` columns, zeros where there are fewer."""
    if a.shape[1] >= width:
        return a[:, :width]
    return np.pad(a, ((0, 0), (0, width - a.shape[1])))


def dump(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def load(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}


def meet(pages: DataFrame, blocks: DataFrame, n_blocks: int, run, schema: str) -> DataFrame:
    """Every block of queries with the pages that it names: ``pages`` (page, data), ``blocks`` (page, block, data).

    One group holds a page and at most ``BLOCKS_TOGETHER`` blocks, whatever the table's size.
    """
    ship_package(pages.sparkSession)
    parts = max(1, -(-n_blocks // BLOCKS_TOGETHER))
    left = pages.select("page", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "data")
    right = blocks.select("page", F.expr(f"cast(block div {BLOCKS_TOGETHER} as int)").alias("part"), "data")
    return left.groupBy("page", "part").cogroup(right.groupBy("page", "part")).applyInPandas(run, schema)


def best_rows(hits: DataFrame, k: int) -> DataFrame:
    """``hits`` (query, vec_id, score and others) with their rank: the k highest scores of each query, ties to
    the smaller vec_id."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def results(hits: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of ``numbered`` points: the k best hits of every row that asks."""
    asking = points.where("asks").select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "copies")
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    found = best_rows(hits, k).join(asking, "query")
    return found.select("query_id", "rank", "vec_id", "score", each.alias("copy")).drop("copy")
