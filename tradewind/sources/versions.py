"""Versioned folders: write beside, then switch one pointer.

``<target>/v-<id>`` holds a version, and the small file ``<target>/_current`` names the one that counts,
with what its reader needs to know.  A writer that is lost at any moment leaves the old version as the
current one.  The pointer is written under another name and renamed over the old one, which file systems
do in one step.  The version before the current one stays for readers that have begun; older ones, and
versions that never became current, are deleted after the switch.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

POINTER = "_current"


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def new_version(target: str) -> str:
    """A fresh folder for a version of ``target``."""
    return f"{target.rstrip('/')}/v-{uuid.uuid4().hex}"


def current(spark: SparkSession, target: str) -> dict | None:
    """What the pointer says: ``version`` (a folder) and the facts given to :func:`switch`; None without one."""
    path, fs = _path(spark, f"{target.rstrip('/')}/{POINTER}")
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    told = json.loads(text)
    return told | {"version": f"{target.rstrip('/')}/{told['version']}"}


def switch(spark: SparkSession, target: str, version: str, **facts) -> None:
    """Make ``version`` the current one, then delete those before the last."""
    target = target.rstrip("/")
    before = current(spark, target)
    fresh, fs = _path(spark, f"{target}/_{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.write(bytearray(json.dumps({"version": version.rsplit("/", 1)[1], **facts}).encode("utf-8")))
    out.close()
    jvm = spark._jvm
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    pointer, _ = _path(spark, f"{target}/{POINTER}")
    fresh, pointer = fs.makeQualified(fresh), fs.makeQualified(pointer)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), spark._jsc.hadoopConfiguration()).rename(fresh, pointer, over)
    keep = {version.rsplit("/", 1)[1], before["version"].rsplit("/", 1)[1] if before else None}
    folder, fs = _path(spark, target)
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in keep:
            fs.delete(status.getPath(), True)
