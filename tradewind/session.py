"""Spark session and stored-table helpers."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Sequence

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.host": "127.0.0.1",
    "spark.driver.bindAddress": "127.0.0.1",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tradewind",
                  extra: dict | None = None) -> SparkSession:
    """A local session for tests and benchmarks (clusters configure their own session)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(LOCAL_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which every executor can reach; an error if there is none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise RuntimeError("name a shared folder in spark.checkpoint.dir")
    return named.rstrip("/")


class TableStore:
    """Intermediate tables below a folder that the caller names.

    ``keep(df)`` writes ``df`` once as Parquet and reads it back: readers do not compute it again, and a
    lost executor costs the work after it only.  ``keep_all`` writes several at once.  ``close`` deletes
    the tables.  On a cluster the folder needs the scheme of a shared file system: a bare path or ``file:``
    would be a folder of each machine, unless the caller says that it is ``mounted`` on all of them.
    """

    def __init__(self, spark: SparkSession, folder: str, mounted: bool = False):
        local = "://" not in folder or folder.startswith("file:")
        if local and not mounted and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{folder!r} is a machine-local path; name a shared folder with its scheme, or say that it is mounted")
        self.spark = spark
        self.base = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
        self._count = itertools.count()

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{next(self._count)}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_all(self, dfs: Sequence[DataFrame]) -> list[DataFrame]:
        dfs = list(dfs)
        out: list[DataFrame | None] = [None] * len(dfs)
        errors: list[BaseException] = []

        def run(i: int) -> None:
            try:
                out[i] = self.keep(dfs[i])
            except BaseException as e:  # raised again below, in the caller's thread
                errors.append(e)
        threads = [InheritableThread(target=run, args=(i,)) for i in range(len(dfs))]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        if errors:
            raise errors[0]
        return out

    def delete_on_exit(self) -> "TableStore":
        """For tables that a lazy result still reads: they go when the driver's JVM ends."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
        return self

    def close(self) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def __enter__(self) -> "TableStore":
        return self

    def __exit__(self, *_) -> None:
        self.close()


def cluster_conf(input_bytes: int, executors: int, cores_per_executor: int,
                 target_partition_bytes: int = 256 << 20, shuffle_fraction: float = 0.25) -> dict[str, str]:
    """Settings for running the reports on a cluster over ``input_bytes`` of Parquet input.

    The largest shuffle is the projected fact-to-order join of the role views, estimated as
    ``shuffle_fraction`` of the input (the reports read a few columns of wide tables; every later
    shuffle moves partial aggregates).  The initial shuffle-partition count makes its partitions about
    ``target_partition_bytes``; AQE then coalesces small partitions and splits skewed
    ones at run time.  Scan splits match the same size.  The broadcast threshold stays a run-time
    measured bound (AQE uses actual shuffle sizes), so a side is broadcast only when it is proven small.
    """
    slots = executors * cores_per_executor
    parts = max(slots * 2, -(-int(input_bytes * shuffle_fraction) // target_partition_bytes))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.session.timeZone": "UTC",
    }
