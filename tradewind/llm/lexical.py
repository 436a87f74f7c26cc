"""Ranked lexical search: hashed max-sketches, upper bounds for batches of queries, exact rescoring.

The index holds a row per document: its terms with their counts and a sketch.  A term's impact in a
document rises with its count there, and everything else in it is the same for all terms of the
document.  So the coordinatewise maximum of impacts is the impact of the greatest count, and the sketch
folds counts: each term stands at three hashed coordinates, and a coordinate keeps the greatest count that
falls on it.  Impacts are read off the counts when the corpus figures (documents, terms, lengths) are
known, and an index stays right when documents join it.

A search goes through the index once for every block of queries.  For each query the least of a term's
coordinates bounds its impact; the weighted sum bounds the score.  Documents are rescored exactly, by
their terms, in descending order of the bound until the bound falls below the k-th score found so far.
That threshold goes on from batch to batch within a task, and starts from the k-th score of a sample.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import map_batches, named, store

#: coordinates of a sketch for each distinct term, at least (rounded up to a power of two), and where each term stands
SKETCH_LOAD = 8
TERM_PLACES = 3
#: the widest sketch; texts with more terms than it has room for get looser bounds, not other results
WIDEST = 1 << 27
#: terms of the queries of one block, as counted over all of them (one query is never divided)
BLOCK_TERMS = 16_384
#: documents whose scores give the first thresholds
SEED_DOCS = 4_096
ROWS_AT_ONCE = 1_024
RESCORED_AT_ONCE = 64
TERMS_AT_ONCE = 1_024
#: a coordinate is half a byte: the least of these counts that is not below its own (the last stands for any count)
LEVELS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 13, 18, 28, 60, 200, 1 << 62])
TOP_IMPACT = 1_000_000

#: fixed values of the term pattern [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+, as bytes: A-Z in lower case, the rest of ASCII parts terms
_TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text in order, in UTF-8; only A-Z are lower-cased.  Null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def _hashes(terms: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms))


def _places(hashes: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The coordinates of each term in a sketch of ``width`` (a power of two)."""
    step = hashes >> np.uint64(32) | np.uint64(1)
    for i in range(TERM_PLACES):
        yield (hashes + np.uint64(i) * step & np.uint64(width - 1)).astype(np.int64)


def sketch(terms: list[bytes], counts: np.ndarray) -> bytes:
    """Coordinatewise maxima of the counts; coordinate i of a sketch of w stands in byte i mod w/2."""
    width = min(WIDEST, 1 << max(6, (SKETCH_LOAD * len(terms) - 1).bit_length()))
    out = np.zeros(width, np.uint8)
    level = np.searchsorted(LEVELS, counts).astype(np.uint8)
    for at in _places(_hashes(terms), width):
        np.maximum.at(out, at, level)
    return (out[:width // 2] | out[width // 2:] << 4).tobytes()


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index, a row for each document that has a term: (doc_id, n, terms, tf, sketch).

    ``terms`` holds the distinct terms, each with a blank after it, ``tf`` their counts as 32-bit integers.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                keep, lengths, words, tfs, sketches = [], [], [], [], []
                for i, text in enumerate(part.column(1)):
                    found = terms_of(text.as_py())
                    if found:
                        tally = Counter(found)
                        terms, tf = list(tally), np.fromiter(tally.values(), np.int32, len(tally))
                        keep.append(i)
                        lengths.append(len(found))
                        words.append(b" ".join(terms) + b" ")
                        tfs.append(tf.tobytes())
                        sketches.append(sketch(terms, tf))
                if keep:
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(keep)), pa.array(lengths, pa.int64()), pa.array(words, pa.binary()),
                         pa.array(tfs, pa.binary()), pa.array(sketches, pa.binary())], names=["doc_id", "n", "terms", "tf", "sketch"])
    rows = docs.select(named(id_col).cast("bigint").alias("id"), named(text_col).cast("string").alias("text"))
    return store(map_batches(rows, run, "doc_id bigint, n bigint, terms binary, tf binary, sketch binary"))


@dataclass
class _Block:
    """A block of queries: term ids into ``vocabulary``; ``weights`` once the document frequencies are known."""

    queries: list[np.ndarray]
    vocabulary: list[bytes]
    weights: np.ndarray | None = None
    n_docs: int = 0
    n_terms: int = 0
    start: list[int] | None = None


def _with_blank(vocabulary: list[bytes]) -> pa.Array:
    return pa.array([t + b" " for t in vocabulary], pa.large_binary())


def _known(terms: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of the documents of a batch that are in the vocabulary: their row, vocabulary id and place among all terms."""
    rows = terms.to_pylist()
    flat = np.frombuffer(b"".join(rows), np.uint8)
    ends = np.flatnonzero(flat == 32) + 1
    every = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(flat)])
    ids = pc.index_in(every, value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(ids >= 0)
    row_ends = np.cumsum([len(r) for r in rows])
    return np.searchsorted(row_ends, ends[at], side="left"), ids[at].astype(np.int64), at


def _document_frequencies(index: DataFrame, vocabulary: list[bytes]) -> np.ndarray:
    """In how many documents each term of the vocabulary occurs (all documents)."""
    sent = index.sparkSession.sparkContext.broadcast(vocabulary)  # at most a block's terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _with_blank(sent.value)
        total = np.zeros(len(known), np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, ROWS_AT_ONCE):
                total += np.bincount(_known(b.column(0).slice(lo, ROWS_AT_ONCE), known)[1], minlength=len(known))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], names=["term", "df"])
    out = np.zeros(len(vocabulary), np.int64)
    for r in map_batches(index.select("terms"), run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


class _Batch:
    """Documents of the index: bounds by their sketches, exact scores by their terms."""

    def __init__(self, b: pa.RecordBatch, block: _Block, vocabulary: pa.Array, places):
        self.ids, self.terms, self.tf, self.vocabulary = b.column(0), b.column(2), b.column(3), vocabulary
        self.size, self.places = len(vocabulary), places
        # Python integers: the product may pass 64 bits where a corpus is large
        self.m = np.array([50 + 50 * n * block.n_docs // block.n_terms for n in b.column(1).to_pylist()], np.int64)
        self.m20 = 20.0 * self.m
        sketches = b.column(4).to_pylist()
        widths = np.array([len(s) for s in sketches], np.int64)
        self.groups = []
        for width in np.unique(widths):
            rows = np.flatnonzero(widths == width)
            half = np.frombuffer(b"".join(sketches[i] for i in rows), np.uint8).reshape(len(rows), width).T
            self.groups.append((2 * int(width), rows, np.concatenate([half & 15, half >> 4])))
        self._exact = None

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """At least the score of each document for a query's terms."""
        out = np.zeros(len(self.m))
        for width, rows, grid in self.groups:
            first, *more = self.places(width)
            for lo in range(0, len(terms), TERMS_AT_ONCE):
                some = terms[lo:lo + TERMS_AT_ONCE]
                level = grid[first[some]]
                for at in more:
                    np.minimum(level, grid[at[some]], out=level)
                term, doc = np.nonzero(level)
                tf = LEVELS[level[term, doc]].astype(np.float64)
                impact = np.minimum(TOP_IMPACT, 1e9 * tf / (1000.0 * tf + self.m20[rows[doc]]))
                out[rows] += np.bincount(doc, weights[lo:lo + TERMS_AT_ONCE][term] * impact, len(rows))
        return np.where(out > 0, out + 1, 0)  # 1 for rounding in doubles

    def scores(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of some documents for a query's terms."""
        if self._exact is None:
            row, term, at = _known(self.terms, self.vocabulary)
            tf = np.frombuffer(b"".join(self.tf.to_pylist()), np.int32)[at]
            key = row * self.size + term
            order = np.argsort(key)
            self._exact = np.r_[key[order], np.iinfo(np.int64).max], np.r_[tf[order], 0].astype(np.int64)
        keys, tfs = self._exact
        out = np.zeros(len(rows), np.int64)
        for lo in range(0, len(terms), TERMS_AT_ONCE):
            want = rows[:, None] * self.size + terms[None, lo:lo + TERMS_AT_ONCE]
            at = np.searchsorted(keys, want)
            tf = np.where(keys[at] == want, tfs[at], 0)
            out += (1_000_000_000 * tf // (1000 * tf + 20 * self.m[rows][:, None])) @ weights[lo:lo + TERMS_AT_ONCE]
        return out


class _Best:
    """The k best documents of one query so far: highest score, then smallest id, null ids last."""

    def __init__(self, k: int, start: int):
        self.k, self.start = k, start
        self.score = self.id = self.null = np.empty(0, np.int64)

    @property
    def threshold(self) -> int:
        """No document below it can be among the k best."""
        return max(self.start, int(self.score[-1]) if len(self.score) == self.k else 1)

    def add(self, score: np.ndarray, ids: pa.Array) -> None:
        keep = score >= self.threshold
        if keep.any():
            null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            value = ids.fill_null(0).to_numpy(zero_copy_only=False)
            score, value, null = (np.concatenate([old, new[keep]]) for old, new in
                                  ((self.score, score), (self.id, value), (self.null, null)))
            order = np.lexsort((value, null, -score))[:self.k]
            self.score, self.id, self.null = score[order], value[order], null[order]


def _search_block(index: DataFrame, block: _Block, k: int) -> DataFrame:
    """(query, doc_id, score): the best k documents that each task found for each query of the block."""
    sent = index.sparkSession.sparkContext.broadcast(block)  # at most a block's terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        vocabulary, hashes = _with_blank(block.vocabulary), _hashes(block.vocabulary)
        places = cache(lambda width: list(_places(hashes, width)))  # of the block's vocabulary, once a width
        best = [_Best(k, s) for s in block.start or [1] * len(block.queries)]
        for b in batches:
            for lo in range(0, b.num_rows, ROWS_AT_ONCE):
                batch = _Batch(b.slice(lo, ROWS_AT_ONCE), block, vocabulary, places)
                for terms, top in zip(block.queries, best):
                    weights = block.weights[terms]
                    bound = batch.bounds(terms, weights.astype(np.float64))
                    rows = np.flatnonzero(bound >= top.threshold)
                    rows = rows[np.argsort(-bound[rows], kind="stable")]
                    for at in range(0, len(rows), RESCORED_AT_ONCE):
                        if bound[rows[at]] < top.threshold:
                            break
                        some = rows[at:at + RESCORED_AT_ONCE]
                        top.add(batch.scores(some, terms, weights), batch.ids.take(pa.array(some)))
        for q, top in enumerate(best):
            if len(top.score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(top.score), q, np.int64)), pa.array(top.id, mask=top.null.astype(bool)), pa.array(top.score)],
                    names=["query", "doc_id", "score"])
    return map_batches(index, run, "query bigint, doc_id bigint, score bigint")


def _best_rows(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _query_blocks(queries: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list[list[bytes]]]]:
    """(ids, distinct terms) of the queries that have terms, block by block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [sorted(set(terms_of(t.as_py()))) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(terms, pa.list_(pa.binary()))], names=["id", "terms"])
    kind = queries.select(named(id_col).alias("id")).schema["id"].dataType.simpleString()
    rows = queries.select(named(id_col).alias("id"), named(text_col).cast("string").alias("text"))
    rows = store(map_batches(rows, run, f"id {kind}, terms array<binary>").where(F.size("terms") > 0)
                 .withColumn("at", F.monotonically_increasing_id()))
    total = rows.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-total // BLOCK_TERMS)
    for i in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("at"), F.lit(blocks)) == i).orderBy("at").collect()
        if block:
            yield [r["id"] for r in block], [[bytes(t) for t in r["terms"]] for r in block]


def search(index: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id_col, rank, doc_id, score): the ``k`` highest-scoring documents of the index for each query row.

    Scores are exact 64-bit integers; documents that hold no term of positive weight are not ranked; equal
    scores go to the smaller doc_id, null ids last.  A query without terms gives no rows; query rows that
    repeat an id are ranked each for itself, and a null id is kept.  Documents that repeat an id or a text
    are ranked each for itself.  An empty table on either side gives no rows.
    """
    spark = index.sparkSession
    figures = index.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    kind = queries.select(named(id_col).alias("id")).schema["id"]
    columns = [F.col("id").alias(id_col), "rank", "doc_id", "score"]
    out = None
    for ids, terms in _query_blocks(queries, id_col, text_col) if figures["docs"] else ():
        vocabulary = sorted({t for ts in terms for t in ts})
        place = {t: i for i, t in enumerate(vocabulary)}
        block = _Block([np.array([place[t] for t in ts], np.int64) for ts in terms], vocabulary,
                       n_docs=figures["docs"], n_terms=figures["terms"])
        df = _document_frequencies(index, vocabulary)
        n2 = 2 * block.n_docs + 2
        block.weights = np.array([math.floor(1000 * math.log(n2 / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)
        if block.n_docs > 16 * SEED_DOCS:
            some = _best_rows(_search_block(index.sample(SEED_DOCS / block.n_docs, seed=1), block, k), k)
            block.start = [1] * len(ids)
            for r in some.where(F.col("rank") == k).collect():
                block.start[r["query"]] = r["score"]
        names = spark.createDataFrame([(q, i) for q, i in enumerate(ids)], "query bigint, id " + kind.dataType.simpleString())
        found = _best_rows(_search_block(index, block, k), k).join(names, "query").select(*columns)
        out = found if out is None else out.unionAll(found)
    if out is None:
        out = spark.createDataFrame([], f"id {kind.dataType.simpleString()}, rank int, doc_id bigint, score bigint").select(*columns)
    return out
