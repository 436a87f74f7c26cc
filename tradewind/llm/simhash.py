"""SimHash near-dedup: fingerprints, a byte-position inverted index with count filtering, and classes.

Two 64-bit fingerprints that differ in at most ``max_bits`` <= 4 bits differ in at most four of their
eight bytes, so they share at least four positional bytes.  The index posts every distinct fingerprint
under each of its 70 sets of four positional bytes; a pair that meets in a list has therefore reached
the guaranteed minimum of four matches.  The shared bytes of a pair are tallied, the pair is taken in
the one list that belongs to its first four shared positions, and its bit distance is verified.

Copies never meet in the index: it holds distinct fingerprints, and documents join their class at the
end.  A list emits a spanning forest of its verified links, never all of its pairs.  A list longer than
``HOT_LIST`` is dealt again on four of the eight half-bytes of its free bits, which bounds a list by
2**16 fingerprints; no list is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import free_name, map_batches, map_texts, named, store, type_of

SEED = 42
COMBOS = tuple(combinations(range(8), 4))
HOT_LIST = 8192
SMALL_LIST = 48
SLICE = 1 << 16

#: first four set bits of an 8-bit mask of equal bytes -> index in COMBOS (-1: fewer than four)
_FIRST_FOUR = np.array([COMBOS.index(tuple(p for p in range(8) if m >> p & 1)[:4]) if m.bit_count() >= 4 else -1
                        for m in range(256)])


def fingerprint(text: str | None, shingle_words: int = 4) -> int:
    """Unsigned 64-bit SimHash of one text.

    Words are runs other than space and \\x09-\\x0D, A-Z in lower case; shingles of ``shingle_words``
    words joined by one space, repeats included (fewer words: the whole sequence; none: 0).  A bit is
    set if it is set in over half of the shingles' XXH64 hashes.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, SLICE):
        end = min(n, at + SLICE)
        columns = [words[at + k:end + k] for k in range(min(shingle_words, len(words)))]
        joined = map(b" ".join, zip(*columns)) if n > 1 else [b" ".join(words)]
        h = np.fromiter((digest(s, SEED) for s in joined), np.uint64, end - at)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (ones * 2 > n).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4) -> DataFrame:
    """(id, fp): one row per input row; fp holds the 64 bits as a signed long.  Null text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                fp = np.array([fingerprint(t.as_py(), shingle_words) for t in part.column(1)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], names=["id", "fp"])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, f"id {type_of(docs, id_col)}, fp bigint")


def _equal_bytes(x: np.ndarray) -> np.ndarray:
    """8-bit mask of the zero bytes of each xor."""
    return np.packbits(x.view(np.uint8).reshape(-1, 8) == 0, axis=1, bitorder="little")[:, 0]


class _Forest:
    """Drops links between fingerprints that this task has already connected (forgets when it grows large)."""

    def __init__(self, limit: int = 1 << 20):
        self.up: dict[int, int] = {}
        self.limit = limit

    def _root(self, a: int) -> int:
        up = self.up
        r = a
        while up.get(r, r) != r:
            r = up[r]
        while up.get(a, a) != r:
            up[a], a = r, up[a]
        return r

    def new(self, a: int, b: int) -> bool:
        ra, rb = self._root(a), self._root(b)
        if ra == rb:
            return False
        if len(self.up) > self.limit:
            self.up.clear()
            ra, rb = a, b
        self.up[max(ra, rb)] = min(ra, rb)
        self.up.setdefault(min(ra, rb), min(ra, rb))
        return True


def _close(x: np.ndarray, combo, max_bits: int, first_list_only: bool) -> np.ndarray:
    """Which xors are links; with ``first_list_only`` only where ``combo`` is the pair's first four shared positions."""
    ok = np.bitwise_count(x) <= max_bits
    if first_list_only and ok.any():
        at = np.flatnonzero(ok)
        shared = _FIRST_FOUR[_equal_bytes(x[at])]
        ok[at] = shared == (combo[at] if isinstance(combo, np.ndarray) else combo)
    return ok


def _list_links(fp: np.ndarray, combo: int, max_bits: int, first_list_only: bool) -> Iterator[tuple[int, int]]:
    """Spanning forest of the links within one list: each fingerprint is reached once."""
    left = fp
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            near = _close(left ^ u, combo, max_bits, first_list_only)
            if near.any():
                found = left[near]
                left = left[~near]
                queue.extend(found)
                for v in found:
                    yield int(u), int(v)


def _link_lists(max_bits: int, hot_list: int | None, first_list_only: bool):
    """Reads (key, fp) sorted by key; gives links (a, b) and, for lists over ``hot_list``, members (a, key)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()

        def out(links, hot_fp=(), hot_key=None):
            links = [(a, b) for a, b in links if forest.new(a, b)]
            a = np.array([x for x, _ in links], np.uint64).view(np.int64)
            b = np.array([x for _, x in links], np.uint64).view(np.int64)
            h = np.asarray(hot_fp, np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([a, h])),
                 pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(h), pa.int64())]),
                 pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array([hot_key] * len(h), pa.int64())])],
                names=["a", "b", "key"])

        def finished(key: np.ndarray, fp: np.ndarray):
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            links = []
            for s, n in zip(starts[sizes > SMALL_LIST], sizes[sizes > SMALL_LIST]):
                links.extend(_list_links(fp[s:s + n], int(key[s]) >> 32, max_bits, first_list_only))
            small = np.repeat((sizes > 1) & (sizes <= SMALL_LIST), sizes)
            key, fp = key[small], fp[small]
            for d in range(1, SMALL_LIST):
                same = np.flatnonzero(key[d:] == key[:-d]) if len(key) > d else ()
                if not len(same):
                    break
                x = fp[same + d] ^ fp[same]
                ok = same[_close(x, (key[same] >> 32), max_bits, first_list_only)]
                links.extend(zip(fp[ok].tolist(), fp[ok + d].tolist()))
            return out(links)

        key, fp, hot = np.empty(0, np.int64), np.empty(0, np.uint64), None
        for b in batches:
            key = np.concatenate([key, b.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(key):
                continue
            if hot is not None:  # the list that is being passed on goes on, or has ended
                n = int(np.searchsorted(key, hot, side="right"))
                yield out((), fp[:n], hot)
                key, fp, hot = key[n:], fp[n:], hot if n == len(key) else None
                if not len(key):
                    continue
            last = int(np.searchsorted(key, key[-1], side="left"))
            if last:
                yield from _cut(key[:last], fp[:last], hot_list, finished, out)
            key, fp = key[last:], fp[last:]
            if hot_list and len(key) > hot_list:
                hot = int(key[0])
                yield out((), fp, hot)
                key, fp = key[:0], fp[:0]
        if len(key):
            yield from _cut(key, fp, hot_list, finished, out)
    return run


def _cut(key, fp, hot_list, finished, out):
    """Whole lists: the ones over ``hot_list`` are passed on, the rest are linked."""
    if hot_list:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        for s, n in zip(starts[sizes > hot_list], sizes[sizes > hot_list]):
            yield out((), fp[s:s + n], int(key[s]))
        keep = np.repeat(sizes <= hot_list, sizes)
        key, fp = key[keep], fp[keep]
    if len(key):
        yield finished(key, fp)


def _lists(df: DataFrame, parts: list[int], bits: int, name: str) -> DataFrame:
    """Post each fp under its 70 sets of four of the eight ``bits``-wide parts that start at bit ``parts[i]``."""
    mask = (1 << bits) - 1
    part = [F.expr(f"shiftrightunsigned({name}, {p}) & {mask}L") for p in parts]
    keys = []
    for c, combo in enumerate(COMBOS):
        k = F.lit(c << 4 * bits if bits == 8 else c).cast("bigint")
        for p in combo:
            k = (k if bits == 8 else F.shiftleft(k, bits)).bitwiseOR(
                F.shiftleft(part[p], bits * combo.index(p)) if bits == 8 else part[p])
        keys.append(k)
    return F.explode(F.array(*keys))


def links(reps: DataFrame, max_bits: int = 4, hot_list: int = HOT_LIST) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints (column ``fp``, distinct) within ``max_bits`` of each other."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the guaranteed count of four shared bytes holds for at most 4 differing bits")
    schema = "a bigint, b bigint, key bigint"
    index = reps.select(_lists(reps, [8 * p for p in range(8)], 8, "fp").alias("key"), "fp")
    lists = index.repartition("key").sortWithinPartitions("key", "fp")
    found = store(map_batches(lists, _link_lists(max_bits, hot_list, True), schema))
    hot = found.where("key IS NOT NULL").select("key", F.col("a").alias("fp"))
    if hot.isEmpty():
        return found.select("a", "b")
    free = [[8 * p for p in range(8) if p not in combo] for combo in COMBOS]  # bit positions of a list's free bytes
    combo = "cast(shiftright(key, 32) AS int) + 1"
    at = [f"element_at(array({', '.join(str(f[j]) for f in free)}), {combo})" for j in range(4)]
    rest = " | ".join(f"shiftleft(shiftrightunsigned(fp, {x}) & 255L, {8 * j})" for j, x in enumerate(at))
    loose = hot.select("key", "fp", F.expr(rest).alias("free"))
    again = loose.select("key", "fp", _lists(loose, [4 * i for i in range(8)], 4, "free").alias("sub"))
    # one number per (list, half-bytes); a clash of numbers only adds fingerprints to compare
    again = again.select(F.xxhash64("key", "sub").alias("key"), "fp")
    lists = again.repartition("key").sortWithinPartitions("key", "fp")
    more = store(map_batches(lists, _link_lists(max_bits, None, False), schema))
    return found.where("b IS NOT NULL").select("a", "b").unionAll(more.select("a", "b"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches.

    Alternating large-star and small-star rounds; every round is stored, so lineage stays short, and
    hot nodes meet only their own one-row minimum.
    """
    e = store(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = store(large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                              F.col("m").alias("v")).distinct())
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4,
               max_bits: int = 4, hot_list: int = HOT_LIST) -> DataFrame:
    """(id_col, fp, component_id, class_fp): one row per input row.

    ``component_id`` is the smallest id reachable over links (ids that are null are never it, unless
    the class has no other); ``class_fp`` names the class.  Null and empty texts have fingerprint zero
    and link like any other; repeated rows keep a row each; an empty table gives no rows.  Other
    columns of ``docs`` are not read, whatever their names.
    """
    fps = store(fingerprints(docs, id_col, text_col, shingle_words))
    reps = store(fps.groupBy("fp").agg(F.min("id").alias("first_id")))
    roots = connected(links(reps.select("fp"), max_bits, hot_list)).withColumnRenamed("node", "fp")
    classes = reps.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("class_fp"))
    first = classes.groupBy("class_fp").agg(F.min("first_id").alias("component_id"))
    named = classes.join(first, "class_fp").select("fp", "class_fp", "component_id")
    return fps.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id", "class_fp")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stand first in their class: one per class, all columns.

    That is the class's row with the smallest id.  Of a class's rows that repeat that id, and of classes
    without any id, the smallest row by all columns stays.  Classes may share their smallest id, where it
    stands on rows with different texts; each keeps its own row.
    """
    columns = docs.columns
    key, row = free_name(columns, "kept_id"), free_name(columns, "kept_row")
    found = store(near_dedup(docs, id_col, text_col, **options).withColumnRenamed(id_col, "id"))
    first = found.where("component_id IS NOT NULL").select(F.col("component_id").alias(key)).distinct()
    repeated = store(found.where("id IS NOT NULL").groupBy(F.col("id").alias(key)).count().where("count > 1").select(key))
    orphans = store(found.where("component_id IS NULL").select("fp", "class_fp").distinct())
    words = options.get("shingle_words", 4)

    def smallest(rows: DataFrame, heads: DataFrame, on: list[str]) -> DataFrame:
        """The smallest of ``rows`` in each class of ``heads`` (columns ``on`` and class_fp)."""
        def make():
            return lambda text: int(np.uint64(fingerprint(text, words)).view(np.int64))
        rows = map_texts(rows, columns, text_col, make, "bigint", pa.int64())
        whole = F.struct(*[F.col(f"k{i}") for i in range(len(columns))])
        # copies become one row before they meet the classes
        rows = rows.groupBy(F.col(f"k{columns.index(id_col)}").alias("id"), F.col("result").alias("fp")).agg(F.min(whole).alias(row))
        rows = rows.join(heads, on).groupBy("class_fp").agg(F.min(row).alias(row))
        return rows.select(f"{row}.*").toDF(*columns)

    if repeated.isEmpty():
        kept = docs.join(first, named(id_col) == F.col(key), "left_semi")
    else:
        kept = docs.join(first.join(repeated, key, "left_anti"), named(id_col) == F.col(key), "left_semi")
        heads = found.where("id = component_id").select("id", "fp", "class_fp").distinct()
        many = docs.join(first.join(repeated, key, "left_semi"), named(id_col) == F.col(key), "left_semi")
        kept = kept.unionAll(smallest(many, heads, ["id", "fp"]))
    if not orphans.isEmpty():
        kept = kept.unionAll(smallest(docs.where(named(id_col).isNull()), orphans, ["fp"]))
    return kept
