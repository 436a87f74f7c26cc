"""Forecast states that grow file by file.

The forecast history gains a file now and then.  What the reports need of all files is a small state in
which a new file is merged without reading the older ones: the latest file date of every forecast value.
:func:`advance` reads the lines of the new file dates alone, merges them and switches to the new version
of the state; a run that is lost leaves the old one.
"""

from __future__ import annotations

import datetime as _dt
import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.forecast import merge_states
from .versions import current, new_version, switch


def read_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The current state below ``path``; None before the first file."""
    told = current(spark, path)
    return None if told is None else spark.read.schema(T.StructType.fromJson(json.loads(told["schema"]))).parquet(told["version"])


def files_of(spark: SparkSession, path: str) -> list[_dt.date]:
    """The file dates that the state holds."""
    told = current(spark, path)
    return [] if told is None else [_dt.date.fromisoformat(d) for d in told["files"]]


def advance(wh, path: str, file_dates: Iterable[_dt.date], state_of: Callable[[DataFrame], DataFrame], latest: str) -> list[_dt.date]:
    """Merge the files of ``file_dates`` into the state below ``path``; gives those that it did not hold yet.

    ``state_of`` makes the state of some forecast rows (``snapshot_dedup``, ``current_state``); ``latest`` is
    its date column.  Only the new files are read, each by its own date.
    """
    held = files_of(wh.spark, path)
    new = sorted(set(file_dates) - set(held))
    if not new:
        return []
    states = [state_of(wh.between("forecast", "file_date", d, d)) for d in new]
    before = read_state(wh.spark, path)
    merged = merge_states(states + ([] if before is None else [before]), latest)
    version = new_version(path)
    merged.write.parquet(version)
    switch(wh.spark, path, version, schema=merged.schema.json(), files=[d.isoformat() for d in sorted([*held, *new])])
    return new
