"""WARC archives: a deterministic sharded writer, and a reader.

Records are range-sorted by page id into shards, whose bounds follow from a histogram of the bytes at every
id, so they depend on the rows alone.  A shard writes one gzip member per record and rolls to
the next file when the compressed size passes ``roll_bytes``.  Headers, record ids and digests are made
from the row alone (dates are a parameter), so an attempt that is run again writes the same bytes.  A
file is written under a temporary name and renamed when whole; the manifest, a Parquet table that Spark
commits when every shard has ended, names the files that count.  The reader goes by the manifest.

Of records with the same payload of at least ``min_revisit_bytes``, the one with the largest page id is
the response; the others are revisits that refer to it and hold no payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import map_batches, named, new_folder, store, type_of

MIN_REVISIT_BYTES = 1000
ROLL_BYTES = 64 << 20
SHARD_BYTES = 32 << 20
MOST_SHARDS = 4096
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records bigint, bytes bigint, sha1 string"
_UNSAFE = re.compile(rb"[\x00-\x20\x7f-\xff]")


def _open(folder: str):
    """(file system, path) of a folder that all executors reach (local or mounted, s3, gs, hdfs)."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder)


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page: str, sha1: str, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{sha1}:{copy}')}>"


def record(page: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str, copy: int = 0) -> bytes:
    """One WARC record with regenerated headers and digests; ``page`` and ``refers_to`` are ids as text."""
    sha1 = hashlib.sha1(payload).hexdigest()
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    target = _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], (url or "about:blank").encode("utf-8", "surrogatepass")).decode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: {_record_id(page or '', sha1, copy)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}",
             "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {_digest(payload)}",
             f"WARC-Block-Digest: {_digest(block)}", f"Content-Length: {len(block)}", f"Page-Payload-Length: {len(payload)}"]
    if page is not None:
        lines.append(f"Page-Id: {page}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_record_id(refers_to, sha1)}", f"WARC-Profile: {PROFILE}", f"Page-Refers-To: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Headers and payload of one record; raises ValueError where lengths or digests don't hold."""
    end = data.index(b"\r\n\r\n")
    first, *lines = data[:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a WARC record: {first[:40]}")
    head = dict(line.split(": ", 1) for line in lines)
    block = data[end + 4:end + 4 + int(head["Content-Length"])]
    if data[end + 4 + len(block):] != b"\r\n\r\n" or _digest(block) != head["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {head['WARC-Record-ID']}")
    payload = None
    if head["WARC-Type"] == "response":
        payload = block[block.index(b"\r\n\r\n") + 4:]
        if _digest(payload) != head["WARC-Payload-Digest"] or len(payload) != int(head["Page-Payload-Length"]):
            raise ValueError(f"damaged payload in {head['WARC-Record-ID']}")
    return {"page_id": head.get("Page-Id"), "url": head["WARC-Target-URI"], "record_type": head["WARC-Type"],
            "refers_to": head.get("Page-Refers-To"), "payload": payload, "payload_bytes": int(head["Page-Payload-Length"]),
            "payload_digest": base64.b32decode(head["WARC-Payload-Digest"][5:]).hex()}


class _Shard:
    """The files of one shard: members go to a temporary name, which is renamed when the file rolls."""

    def __init__(self, folder: str, shard: int, attempt: int, roll_bytes: int, level: int):
        self.files, self.path = _open(folder)
        self.shard, self.attempt, self.roll_bytes, self.level = shard, attempt, roll_bytes, level
        self.number, self.out = 0, None
        self.files.create_dir(self.path, recursive=True)

    def add(self, data: bytes) -> tuple | None:
        """Write a record; the manifest row of the file if it is full now."""
        if self.out is None:
            self.name = f"part-{self.shard:05d}-{self.number:05d}.warc.gz"
            self.temp = f"{self.path}/_{self.name}.{self.attempt}.tmp"
            self.out = self.files.open_output_stream(self.temp, compression=None)
            self.records = self.size = 0
            self.sha1 = hashlib.sha1()
        z = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        member = z.compress(data) + z.flush()
        self.out.write(member)
        self.sha1.update(member)
        self.records += 1
        self.size += len(member)
        return self.finish() if self.size >= self.roll_bytes else None

    def finish(self) -> tuple | None:
        if self.out is None:
            return None
        from pyarrow import fs
        self.out.close()
        self.out = None
        target = f"{self.path}/{self.name}"
        if self.files.get_file_info(target).type != fs.FileType.NotFound:  # of an attempt whose result was lost: the same bytes
            self.files.delete_file(target)
        self.files.move(self.temp, target)
        self.number += 1
        return self.name, self.records, self.size, self.sha1.hexdigest()

    def discard(self) -> None:
        """Remove the file that is open, if any."""
        if self.out is not None:
            self.out.close()
            self.out = None
            self.files.delete_file(self.temp)


# ---- shards ----------------------------------------------------------------------------------------

@dataclass
class Cut:
    """Shards over the range of places.  Cell i begins at ``edges[i]`` and lies in shard ``shard[i]``; a single
    place that holds more than a shard is dealt over ``parts[i]`` shards from there on."""

    edges: np.ndarray
    shard: np.ndarray
    parts: np.ndarray
    shards: int

    def cells(self, place: np.ndarray) -> np.ndarray:
        return np.maximum(np.searchsorted(self.edges, place, side="right") - 1, 0)

    def of(self, place: np.ndarray, deal: np.ndarray) -> np.ndarray:
        cell = self.cells(place)
        return self.shard[cell] + np.mod(deal, self.parts[cell])


def _place(pages: DataFrame, id_col: str) -> Column:
    """The id as a number in the same order, null before all: whole numbers are their own place; of texts, the
    seven bytes after what all of them begin with.  Ids that share a place are dealt by hash if they are too many."""
    whole = type_of(pages, id_col) in ("tinyint", "smallint", "int", "bigint")
    value = named(id_col).cast("bigint") if whole else named(id_col).cast("string").cast("binary")
    low, high = pages.agg(F.min(value), F.max(value)).first()
    if whole:
        return F.coalesce(value, F.lit(max(-(1 << 63), (low or 0) - 1)).cast("bigint"))
    low, high = bytes(low or b""), bytes(high or b"")
    same = next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
    seven = F.rpad(F.substring(value, same + 1, 7), 7, F.lit(b"\x00"))
    return F.coalesce(F.conv(F.hex(seven), 16, 10).cast("bigint"), F.lit(-1).cast("bigint"))


def _bytes_of_cells(facts: DataFrame, edges: list[int]) -> dict[int, int]:
    sent = facts.sparkSession.sparkContext.broadcast(np.array(edges, np.int64))  # see cut()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, at = np.unique(np.searchsorted(sent.value, b.column(0).to_numpy(), side="right") - 1, return_inverse=True)
            size = np.zeros(len(cells), np.int64)
            np.add.at(size, at, b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int64)), pa.array(size)], names=["cell", "n"])
    rows = map_batches(facts.select("place", F.col("n").cast("bigint")), run, "cell bigint, n bigint")
    return {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.sum("n").alias("n")).collect()}


def cut(facts: DataFrame, shard_bytes: int) -> Cut:
    """Shards of about ``shard_bytes`` over ``facts`` (place, n), from the bytes at every place alone.

    A histogram of the places is refined where a cell holds more than an eighth of a shard, until that is a
    single place, and light neighbours become one cell; so there are at most some 16 cells a shard.  At most
    ``MOST_SHARDS`` shards are cut; larger ones roll over more files.
    """
    low, high, total = facts.agg(F.min("place"), F.max("place"), F.sum("n")).first()
    if low is None:
        low = high = total = 0
    shard_bytes = max(1, shard_bytes, -(-total // MOST_SHARDS))
    light = shard_bytes // 8
    cells = [(low, high + 1, total)]  # first place, one past the last, bytes
    while any(n > light and z - a > 1 for a, z, n in cells):
        marks, sizes = [], []
        for a, z, n in cells:
            pieces = min(16, z - a) if n > light else 1
            marks += [a + (z - a) * i // pieces for i in range(pieces)]
            sizes += [n if pieces == 1 else None] * pieces
        known = _bytes_of_cells(facts, marks)
        merged: list[tuple[int, int, int]] = []
        for i, (a, z) in enumerate(zip(marks, [*marks[1:], high + 1])):
            n = known.get(i, 0) if sizes[i] is None else sizes[i]
            if merged and merged[-1][2] + n <= light:
                merged[-1] = (merged[-1][0], z, merged[-1][2] + n)
            else:
                merged.append((a, z, n))
        cells = merged
    shard, parts, at, filled = [], [], 0, 0
    for _, _, n in cells:
        if filled and filled + n > shard_bytes:
            at, filled = at + 1, 0
        shard.append(at)
        parts.append(max(1, -(-n // shard_bytes)))
        at, filled = at + parts[-1] - 1, filled + n if parts[-1] == 1 else shard_bytes
    return Cut(np.array([a for a, _, _ in cells], np.int64), np.array(shard, np.int64), np.array(parts, np.int64), at + 1)


def _in_shards(rows: DataFrame, cut_: Cut, every_part: bool = False) -> DataFrame:
    """``rows`` (place, deal, ...) with their shard, or once for each shard that their place is dealt over."""
    sent = rows.sparkSession.sparkContext.broadcast(cut_)  # see cut()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = b.column(0).to_numpy()
            if every_part:
                parts = sent.value.parts[sent.value.cells(place)]
                row = np.repeat(np.arange(len(place)), parts)
                b, place = b.take(pa.array(row)), place[row]
                deal = np.arange(len(row)) - np.r_[0, np.cumsum(parts)][:-1][row]
            else:
                deal = b.column(1).to_numpy()
            shard = sent.value.of(place, deal)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), *b.columns], names=["shard", *b.schema.names])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return map_batches(rows, run, f"shard int, {fields}")


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          min_revisit_bytes: int = MIN_REVISIT_BYTES, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES,
          date: str = DATE, level: int = 6) -> DataFrame:
    """Write one record per row below ``folder``; gives the committed manifest (file, records, bytes, sha1).

    The same rows give the same files, however they are partitioned; only rows that are alike in every column
    and fill more than a shard are dealt by their place in the input.  Null html is an empty payload.  Repeated
    rows get a record each; rows that share the largest page id of equal payloads are all responses.  A null
    page id is written without an id and is referred to by none.  An empty table gives an empty manifest.
    Other columns are not read.
    """
    spark = pages.sparkSession
    html = F.coalesce(named(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(_place(pages, id_col).alias("place"), F.xxhash64(named(url_col).cast("string"), html, F.monotonically_increasing_id()).alias("deal"),
                        named(id_col).alias("page_id"), named(url_col).cast("string").alias("url"), html.alias("payload"))
    size = F.octet_length("payload")
    facts = store(rows.select("place", "page_id", size.alias("n"), F.when(size >= min_revisit_bytes, F.sha2("payload", 256)).alias("key")))
    keyed = facts.where("key IS NOT NULL")
    shared = (keyed.groupBy("key").agg(F.max("page_id").alias("target"), F.count("*").alias("copies"))
                   .where("copies > 1 AND target IS NOT NULL").select("key", "target"))
    # which pages refer to another one; these marks meet the pages in their shard, so payloads are shuffled once
    marks = keyed.join(shared, "key").where(~F.col("page_id").eqNullSafe(F.col("target")))
    marks = marks.select("place", F.lit(0).cast("bigint").alias("deal"), "page_id", "key", F.col("target").cast("string").alias("target")).distinct()
    shards = cut(facts, shard_bytes)
    none = F.lit(None)
    both = _in_shards(rows, shards).select("shard", "page_id", F.lit(1).alias("kind"), "url", "payload", none.cast("string").alias("target")).unionAll(
        _in_shards(marks, shards, every_part=True).select("shard", "page_id", F.lit(0).alias("kind"), F.col("key").alias("url"), none.cast("binary").alias("payload"), "target"))
    ordered = both.repartitionById(shards.shards, "shard").sortWithinPartitions("shard", "page_id", "kind", "url", "payload")
    ordered = ordered.withColumn("page_id", F.col("page_id").cast("string"))

    # a page that is dealt over several shards numbers its equal records apart in each of them
    first = np.concatenate([np.arange(p) for s, p in sorted(dict(zip(shards.shard.tolist(), shards.parts.tolist())).items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        shard, page, targets, seen, done = None, None, {}, {}, []
        try:
            for b in batches:
                for number, page_id, kind, url, payload, target in zip(*(c.to_pylist() for c in b.columns)):
                    if shard is None or number != shard.shard:
                        done.append(shard and shard.finish())
                        shard, page = _Shard(folder, number, attempt, roll_bytes, level), None
                    if (page_id,) != page:
                        page, targets, seen = (page_id,), {}, {}
                    if kind == 0:
                        targets[url] = target
                        continue
                    key = hashlib.sha256(payload).hexdigest()
                    seen[key] = copy = seen.get(key, (int(first[number]) << 32) - 1) + 1
                    done.append(shard.add(record(page_id, url, payload, targets.get(key), date, copy)))
            done.append(shard and shard.finish())
        finally:
            if shard:
                shard.discard()
        done = [d for d in done if d]
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                         names=["file", "records", "bytes", "sha1"])
    manifest = store(map_batches(ordered, run, MANIFEST))
    _sweep(folder)
    return manifest


def _sweep(folder: str) -> None:
    """Delete what attempts that were lost left behind; the manifest is committed."""
    from pyarrow import fs
    files, path = _open(folder)
    for info in files.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if info.base_name.startswith("_part-") and info.base_name.endswith(".tmp"):
            files.delete_file(info.path)


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    data, z, out = b"", None, []
    while True:
        if not data:
            data = stream.read(1 << 18)
            if not data:
                if z is not None:
                    raise ValueError("the file ends within a record")
                return
        z = z or zlib.decompressobj(31)
        out.append(z.decompress(data))
        data = z.unused_data if z.eof else b""
        if z.eof:
            yield b"".join(out)
            z, out = None, []


def read(spark: SparkSession, manifest: DataFrame, folder: str, id_type: str = "bigint", with_payload: bool = True) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest[, payload]) of the manifest's files.

    Every digest and length is verified.  ``payload`` is null for revisits.
    """
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * with_payload
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open(folder)
        for b in batches:
            for name, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows, size, seen = [], 0, 0
                with files.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for member in _members(stream):
                        rows.append(parse(member))
                        size += len(member) if with_payload else 256
                        seen += 1
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)
                            rows, size = [], 0
                if seen != records:
                    raise ValueError(f"{name} holds {seen} records, its manifest says {records}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)
    schema = "page_id string, url string, record_type string, refers_to string, payload_bytes bigint, payload_digest string"
    # a task reads the files of one shard
    shard = F.regexp_extract("file", r"^part-(\d+)-", 1).cast("int")
    shards = (manifest.agg(F.max(shard)).first()[0] or 0) + 1
    files = manifest.select("file", "records", shard.alias("shard")).repartitionById(shards, "shard").select("file", "records")
    out = map_batches(files, run, schema + (", payload binary" if with_payload else ""))
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def round_trip(pages: DataFrame, id_col: str = "page_id", folder: str | None = None, **options) -> DataFrame:
    """Write ``pages`` to archives and read them back without payloads."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    return read(spark, write(pages, folder, id_col, **options), folder, type_of(pages, id_col), with_payload=False)
