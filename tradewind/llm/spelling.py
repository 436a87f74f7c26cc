"""Spelling variant grouping: words one edit apart, found by an index of variable-length grams.

The gram dictionary is pruned by frequency.  A gram begins with ``SHORTEST`` letters and is lengthened
while it is one of the frequent grams, up to ``LONGEST``; so the dictionary holds the frequent grams
only, of which there are at most ``LONGEST`` times ``DICTIONARY``.  A word is decomposed into the grams
that begin at its letters (blanks stand after its end).  Which gram begins at a letter depends on the
gram's own letters alone.

One edit affects the grams that reach over its place.  Their greatest number over all places is a word's
affected-gram bound: at least the other grams stay, so two near words share at least the larger of
(grams - bound).  Hence they also share one of the first ``bound + 1`` grams of each, in the order from
rare to frequent, and only those are posted.  A list holds the words that have a gram, the same number of
times, with m letters or m + 1.  The shared grams of two words of a list are tallied, at places that one
edit allows, against both bounds; pairs that reach them are verified letter by letter.

A list of more than ``HOT_LIST`` words is cut into blocks, and each pair of blocks is a list of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import map_batches, named, store

#: lengths of grams; a word of SHORTEST + LONGEST letters keeps a gram over any edit
SHORTEST, LONGEST = 2, 4
MIN_LETTERS = SHORTEST + LONGEST
#: a gram is frequent if it stands at more than one of this many places
DICTIONARY = 65_536
MIN_COUNT = 5
#: a form is at least this many times as frequent as its variant
TIMES = 5
HOT_LIST = 4_096
SMALL_LIST = 32
LETTERS_AT_ONCE = 1 << 22

RUNS = "[A-Za-z\u00C0-\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLIP = 199


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS,
                min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of at least ``min_letters`` letters and ``min_count`` occurrences in all texts.

    Words are runs of Latin letters, A-Z in lower case.  Where the checksum of ``<id>:<word>`` is divisible
    by ``SLIP``, the letter it points at is left out, as a slip of the pen would (a null id counts as empty).
    """
    low = F.translate("run", UPPER, LOWER)
    runs = docs.select(F.coalesce(named(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(named(text_col).cast("string"), F.lit(RUNS), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= min_letters).select("id", low.alias("low"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "low").cast("binary")))
    at = (F.col("h") % F.length("low")).cast("int")
    slip = F.concat(F.substring("low", F.lit(1), at), F.substring("low", at + 2, F.length("low")))
    words = runs.select(F.when(F.col("h") % SLIP == 0, slip).otherwise(F.col("low")).alias("word"))
    return words.where(F.length("word") >= min_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


# ---- grams -----------------------------------------------------------------------------------------
# A gram is a number: its Latin-1 letters from the highest byte down, zeros after them.

def _is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class Words:
    """Words of a batch: letters, grams and affected-gram bounds as flat arrays; word i begins at ``start[i]``."""

    def __init__(self, words: list[str], dictionary: np.ndarray):
        raw = [w.encode("latin-1") for w in words]
        self.size = np.array([len(r) for r in raw], np.int64)
        self.start = np.r_[0, np.cumsum(self.size + LONGEST - 1)][:-1].astype(np.int64)
        self.letter = np.frombuffer((b" " * (LONGEST - 1)).join(raw) + b" " * (2 * LONGEST - 2), np.uint8)
        places = len(self.letter) - LONGEST + 1
        self.gram = np.zeros(places, np.uint32)
        length = np.zeros(places, np.int8)
        more = np.ones(places, bool)
        for i in range(LONGEST):
            self.gram[more] |= self.letter[i:places + i][more].astype(np.uint32) << np.uint32(24 - 8 * i)
            length[more] += 1
            if i + 1 >= SHORTEST:
                more = more & _is_in(self.gram, dictionary)
        blank = self.letter[:places] == 32
        length[blank] = 0
        over = np.zeros(places, np.int64)  # grams that reach over a letter
        for back in range(LONGEST):
            over[back:] += length[:places - back] > back
        over[blank] = 0
        self.bound = np.maximum.reduceat(over, self.start) if len(words) else np.zeros(0, np.int64)

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Word and flat place of every gram."""
        word = np.repeat(np.arange(len(self.size)), self.size)
        return word, self.start[word] + np.arange(len(word)) - np.r_[0, np.cumsum(self.size)][:-1][word]

    def prefixes(self, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, gram, which of its equals) of the first ``bound + 1`` grams of each word, rare before frequent."""
        word, at = self.places()
        gram, (known, df) = self.gram[at], frequent
        often = np.where(_is_in(gram, known), df[np.minimum(np.searchsorted(known, gram), len(df) - 1)], 0) if len(known) else np.zeros(len(gram), np.int64)
        order = np.lexsort((at, gram, often, word))
        word, gram = word[order], gram[order]
        spot = np.arange(len(word))
        new = np.r_[True, (word[1:] != word[:-1]) | (gram[1:] != gram[:-1])]
        equal = spot - np.maximum.accumulate(np.where(new, spot, 0))
        rank = spot - np.r_[0, np.cumsum(self.size)][:-1][word]
        keep = rank <= self.bound[word]
        return word[keep], gram[keep], equal[keep]

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs are one edit apart; b has as many letters as a, or one more."""
        out = np.zeros(len(a), bool)
        for size, longer in {(int(s), int(t)) for s, t in zip(self.size[a], self.size[b])}:
            pairs = np.flatnonzero((self.size[a] == size) & (self.size[b] == longer))
            step = max(1, LETTERS_AT_ONCE // longer)
            for lo in range(0, len(pairs), step):
                some = pairs[lo:lo + step]
                i, j = a[some], b[some]
                left, right = self.start[i][:, None] + np.arange(size), self.start[j][:, None] + np.arange(longer)
                ours, theirs = self.gram[left], self.gram[right]
                shared = (ours == theirs[:, :size]).sum(1)
                if longer > size:
                    shared += (ours == theirs[:, 1:]).sum(1)
                enough = shared >= np.maximum(size - self.bound[i], longer - self.bound[j])
                some, left, right = some[enough], left[enough], right[enough]
                ours, theirs = self.letter[left], self.letter[right]
                if longer == size:
                    out[some] = (ours != theirs).sum(1) == 1
                else:
                    head = np.logical_and.accumulate(ours == theirs[:, :size], axis=1).sum(1)
                    tail = np.logical_and.accumulate((ours == theirs[:, 1:])[:, ::-1], axis=1).sum(1)
                    out[some] = head + tail >= size
        return out


def _mixed(gram: np.ndarray, equal: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Number of a list; equal numbers of different lists would only add pairs to look at."""
    low = (letters.astype(np.uint64) * np.uint64(0x9E3779B1) + equal.astype(np.uint64) * np.uint64(0x85EBCA6B)) & np.uint64(0xFFFFFFFF)
    return (gram.astype(np.uint64) << np.uint64(32) | low).view(np.int64)


def _collect_grams(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams at more than ``limit`` places, sorted, and their counts (bounded: places / limit)."""
    rows = counts.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > limit).collect()
    gram, n = np.array([r["gram"] for r in rows], np.uint32), np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(gram)
    return gram[order], n[order]


def _gram_counts(words: DataFrame, dictionary: np.ndarray | None) -> DataFrame:
    """(gram, n): grams of the decomposition, or (without a dictionary) all that may be lengthened."""
    sent = words.sparkSession.sparkContext.broadcast(dictionary)  # at most LONGEST * DICTIONARY numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_pylist()
            if sent.value is not None:
                made = Words(names, sent.value)
                gram = made.gram[made.places()[1]]
            else:
                made = Words(names, np.empty(0, np.uint32))
                at, gram = made.places()[1], []
                for size in range(SHORTEST, LONGEST):
                    gram.append(sum(made.letter[at + i].astype(np.uint32) << np.uint32(24 - 8 * i) for i in range(size)))
                gram = np.concatenate(gram)
            gram, n = np.unique(gram, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])
    return map_batches(words.select("word"), run, "gram bigint, n bigint")


# ---- lists -----------------------------------------------------------------------------------------
# own: 2 compares with 2 and 0, 1 compares with 0 only, 0 is compared with

def _postings(words: DataFrame, dictionary: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    sent = words.sparkSession.sparkContext.broadcast((dictionary, frequent))  # see _collect_grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, frequent = sent.value
        for b in batches:
            made = Words(b.column(0).to_pylist(), dictionary)
            word, gram, equal = made.prefixes(frequent)
            for own, shorter in ((2, 0), (0, 1)):
                take = pa.array(word)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_mixed(gram, equal, made.size[word] - shorter)), pa.array(np.full(len(word), own, np.int32)),
                     b.column(0).take(take), b.column(1).take(take)], names=["key", "own", "word", "n"])
    return map_batches(words.select("word", "n"), run, "key bigint, own int, word string, n bigint")


def _deal_hot(postings: DataFrame, hot_list: int) -> DataFrame:
    """Lists over ``hot_list`` as a list for every pair of their blocks."""
    hot = postings.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > hot_list)
    hot = store(hot.select("key", F.ceil(F.col("size") / hot_list).cast("int").alias("blocks")))
    if hot.isEmpty():
        return postings
    rows = postings.join(hot, "key", "left")
    block = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    as_left = F.transform(every, lambda j: F.struct(block.alias("i"), j.alias("j"), F.when(j == block, 2).otherwise(1).alias("own")))
    as_right = F.transform(every, lambda i: F.struct(i.alias("i"), block.alias("j"), F.lit(0).alias("own")))
    first = F.filter(as_right, lambda p: p["i"] < block)
    dealt = F.when(F.col("own") == 2, F.concat(as_left, first)).otherwise(as_right)
    cut = rows.where("blocks IS NOT NULL").select("key", "word", "n", F.explode(dealt).alias("p"))
    cut = cut.select(F.xxhash64("key", "p.i", "p.j").alias("key"), "p.own", "word", "n")
    return rows.where("blocks IS NULL").select("key", "own", "word", "n").unionByName(cut)


def _pairs(lists: DataFrame, dictionary: np.ndarray) -> DataFrame:
    """(a, a_n, b, b_n): near words of the lists, which are sorted by key, then own from 2 down."""
    sent = lists.sparkSession.sparkContext.broadcast(dictionary)

    def whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Tables in which no list goes on in the next one; a list is bounded by the dealing."""
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            key = t.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if last:
                yield t.slice(0, last)
            rest = t.slice(last).combine_chunks()
        if rest is not None and rest.num_rows:
            yield rest

    def candidates(key: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        small = np.repeat(sizes <= SMALL_LIST, sizes)
        for d in range(1, SMALL_LIST):
            i = np.flatnonzero(small[:-d] & (key[d:] == key[:-d]) & (own[:-d] > 0)) if len(key) > d else ()
            if not len(i):
                break
            yield i, i + d
        for s, n in zip(starts[sizes > SMALL_LIST], sizes[sizes > SMALL_LIST]):
            for i in range(s, s + n - 1):
                if own[i] == 0:
                    break
                j = np.arange(i + 1, s + n)
                yield np.full(len(j), i), j

    def together(pairs: Iterator[tuple[np.ndarray, np.ndarray]], at_once: int = 1 << 18):
        left, right, n = [], [], 0
        for i, j in pairs:
            left.append(i)
            right.append(j)
            n += len(i)
            if n >= at_once:
                yield np.concatenate(left), np.concatenate(right)
                left, right, n = [], [], 0
        if n:
            yield np.concatenate(left), np.concatenate(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_lists(batches):
            key, own = t.column("key").to_numpy(), t.column("own").to_numpy()
            words = t.column("word").combine_chunks()
            made = Words(words.to_pylist(), sent.value)
            n = t.column("n").combine_chunks()
            for i, j in together(candidates(key, own)):
                gap = made.size[j] - made.size[i]
                ok = ((own[j] == 0) | ((own[i] == 2) & (own[j] == 2))) & ((gap == 0) | (gap == 1))
                i, j = i[ok], j[ok]
                near = made.near(i, j)
                i, j = pa.array(i[near]), pa.array(j[near])
                if len(i):
                    yield pa.RecordBatch.from_arrays([words.take(i), n.take(i), words.take(j), n.take(j)], names=["a", "a_n", "b", "b_n"])
    return map_batches(lists, run, "a string, a_n bigint, b string, b_n bigint")


def near_words(words: DataFrame, hot_list: int = HOT_LIST) -> DataFrame:
    """(a, a_n, b, b_n): each pair of ``words`` (word, n; distinct, of at least ``MIN_LETTERS`` Latin letters)
    that differ by one inserted, deleted or replaced letter, once."""
    places = words.agg(F.sum(F.length("word"))).first()[0] or 0
    limit = places // DICTIONARY
    dictionary = _collect_grams(_gram_counts(words, None), limit)[0]
    frequent = _collect_grams(_gram_counts(words, dictionary), limit)
    lists = _deal_hot(store(_postings(words, dictionary, frequent)), hot_list)
    lists = lists.repartition("key").sortWithinPartitions("key", F.desc("own"))
    one, other = F.struct(F.col("a").alias("word"), F.col("a_n").alias("n")), F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"))
    found = _pairs(lists, dictionary).select(F.least(one, other).alias("x"), F.greatest(one, other).alias("y")).distinct()
    return found.select(F.col("x.word").alias("a"), F.col("x.n").alias("a_n"), F.col("y.word").alias("b"), F.col("y.n").alias("b_n"))


def group(words: DataFrame, times: int = TIMES, hot_list: int = HOT_LIST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of ``words`` (word, n).

    ``form`` is the near word of largest n (ties: the first in code-point order) if that is at least
    ``times`` the word's own, else null; ``root`` is where the forms lead to, the word itself without any.
    """
    pairs = store(near_words(words, hot_list))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionAll(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    has = -F.col("best.minus") >= times * F.col("n")
    rows = store(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(has, F.col("best.near")).alias("form"),
        F.when(has, -F.col("best.minus")).alias("form_n")))
    # forms grow at least ``times`` in n, so chains are short; each round doubles the steps taken
    step = rows.where("form IS NOT NULL").select("word", F.col("form").alias("to"))
    while True:
        onward = step.select(F.col("word").alias("to"), F.col("to").alias("next"))
        longer = store(step.join(onward, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        step = longer.select("word", "to")
        if longer.where("moved").isEmpty():
            break
    return rows.join(step, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_list: int = HOT_LIST) -> DataFrame:
    """``group`` of the words of all texts.

    Null and empty texts have no words; repeated rows count each; an empty table gives no rows.  A text may
    be of any length, and so may a word.  Columns other than the id and the text are not read.
    """
    return group(store(count_words(docs, id_col, text_col)), hot_list=hot_list)
