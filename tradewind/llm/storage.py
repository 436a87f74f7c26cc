"""Intermediate tables in the shared folder, and small column helpers used by the operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which every executor can reach.

    Only a local session that names none gets a folder of its own; on a cluster a missing setting is
    an error, since a machine-local folder is lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("name a shared folder in spark.checkpoint.dir")
    path = tempfile.mkdtemp(prefix="llm-tables-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path below the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the work after this point only, and several readers do
    not compute ``df`` again.
    """
    spark = df.sparkSession
    path = new_folder(spark, "tables")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def named(column: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + column.replace("`", "``") + "`")


def free_name(columns: list[str], stem: str) -> str:
    """``stem``, with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


_HELD: dict[tuple, object] = {}


def held(key: tuple, make: Callable):
    """A helper with a large cache, kept in this Python worker from task to task.

    A worker holds one at a time: the next operator's helper takes the place of the last one's.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors once per application (as ``--py-files`` would)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(top)
    target = os.path.join(tempfile.mkdtemp(prefix="llm-source-"), f"{name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in sorted(os.walk(top)):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, top)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` whose function may refer to this package's modules."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def map_texts(docs: DataFrame, kept: list[str], text_col: str, make: Callable[[], Callable], result: str, kind: pa.DataType,
              rows_at_once: int = 512) -> DataFrame:
    """(k0, k1, ..., result): the ``kept`` columns by position, and a value made from each row's text.

    ``make()`` gives, once per task, the function from a text (or None) to the value, whose Spark type is
    ``result`` and Arrow type ``kind``.  Columns go by position, so no name can clash with the result's.
    """
    at = kept.index(text_col) if text_col in kept and type_of(docs, text_col) == "string" else len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for b in batches:
            for lo in range(0, b.num_rows, rows_at_once):
                part = b.slice(lo, rows_at_once)
                values = pa.array([one(t.as_py()) for t in part.column(at)], kind)
                yield pa.RecordBatch.from_arrays([*part.columns[:len(kept)], values], names=[f"k{i}" for i in range(len(kept))] + ["result"])
    columns = [named(c).alias(f"k{i}") for i, c in enumerate(kept)]
    if at == len(kept):
        columns.append(named(text_col).cast("string").alias("text"))
    fields = [f"k{i} {type_of(docs, c)}" for i, c in enumerate(kept)]
    return map_batches(docs.select(*columns), run, ", ".join([*fields, f"result {result}"]))


def kept_as(kept: list[str]) -> list[Column]:
    """The columns of ``map_texts`` under their own names."""
    return [F.col(f"k{i}").alias(c) for i, c in enumerate(kept)]
