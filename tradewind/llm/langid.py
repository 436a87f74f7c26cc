"""Language identification by word-first backoff.

The model holds, for each language, log relative frequencies of words and of character n-grams.  A word
that the model knows adds its log frequencies.  An unseen word falls back to the longest
n-grams: from its start, the longest known n-gram (``MAX_GRAM`` down to one character) is scored and
passed over; every step down in length costs the same for all languages and so needs no discount.

Counting runs on Spark over a bounded sample of the labelled rows (``sample_rows``).  The model keeps every
word and n-gram of the sample that occurs at least ``min_count`` times there: one that occurred once says
little, and falls back to its n-grams.  The sample bounds what is broadcast.  Prediction reads whole texts.
"""

from __future__ import annotations

import math
import re
import uuid
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import held, kept_as, map_texts, store

UNKNOWN = "und"
SAMPLE_ROWS = 6_000
MIN_COUNT = 2
MAX_GRAM = 4
SMOOTHING = 0.5
CACHE_ENTRIES = 200_000
CACHED_CHARS = 40
WORD = re.compile(r"[^\W\d_]+")


class _Scores(dict):
    """Word -> log frequencies: the model's words, and unseen words as they come (forgotten when many)."""

    def __init__(self, model: "Model"):
        super().__init__(model.words)
        self.model = model

    def __missing__(self, word: str) -> tuple[float, ...]:
        if len(self) > len(self.model.words) + CACHE_ENTRIES:
            self.clear()
            self.update(self.model.words)
        out = self.model.back_off(word)
        if len(word) <= CACHED_CHARS:
            self[word] = out
        return out


@dataclass
class Model:
    """``words`` and ``grams[n]``: entry -> log frequencies in the order of ``langs``."""

    langs: list[str]
    words: dict[str, tuple[float, ...]]
    grams: list[dict[str, tuple[float, ...]]]
    prior: tuple[float, ...]
    name: str = field(default_factory=lambda: uuid.uuid4().hex, compare=False)

    @property
    def scores(self) -> _Scores:
        return held(("langid", self.name), lambda: _Scores(self))

    def back_off(self, word: str) -> tuple[float, ...]:
        """Sum over the longest known n-grams that cover an unseen word from its start."""
        marked = f" {word} "
        rows, i, n = [], 0, len(marked)
        while i < n:
            for size in range(min(MAX_GRAM, n - i), 0, -1):
                row = self.grams[size].get(marked[i:i + size])
                if row is not None:
                    rows.append(row)
                    i += size
                    break
            else:  # a character that no language has shown says nothing
                i += 1
        return tuple(map(sum, zip(*rows))) if rows else (0.0,) * len(self.langs)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, posterior from 0 to 1); und and 0 where the text has no letter."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        scores = self.scores
        rows = [scores[w] for w in WORD.findall(text.lower())]
        total = [p + sum(column) for p, column in zip(self.prior, zip(*rows))]
        best = max(range(len(total)), key=lambda i: (total[i], -i))
        top = total[best]
        return self.langs[best], 1.0 / sum(math.exp(max(-700.0, x - top)) for x in total)


def _words(text_col: str):
    """Words of a text as the prediction finds them (letters only, lower case)."""
    return F.expr(rf"regexp_extract_all(lower({text_col}), '\\p{{L}}+', 0)")


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS,
        min_count: int = MIN_COUNT) -> Model:
    """Learn from about ``sample_rows`` of the ``rows`` whose language is not null (all, if fewer).

    The share is drawn by a seeded Bernoulli sample, so it does not favour any key, source or copy.
    The driver receives the sample's words and n-grams that occur ``min_count`` times.  No labelled rows: a
    model that answers ``und``.
    """
    labelled = rows.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL")
    n = labelled.count()
    sample = labelled if n <= sample_rows else labelled.sample(sample_rows / n, seed=1)
    counts = store(sample.select("lang", F.explode(_words("text")).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")))
    sizes = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], {}, [{} for _ in range(MAX_GRAM + 1)], ())

    def table(entries: DataFrame) -> dict[str, list[int]]:
        wide = (entries.groupBy("entry").agg(F.sum("n").alias("total"),
                                             *[F.sum(F.when(F.col("lang") == l, F.col("n")).otherwise(0)).alias(f"n{i}")
                                               for i, l in enumerate(langs)])
                       .where(F.col("total") >= min_count))
        return {r["entry"]: [r[f"n{i}"] for i in range(len(langs))] for r in wide.collect()}

    def logs(found: dict[str, list[int]], totals: list[float]) -> dict[str, tuple[float, ...]]:
        v = len(found) + 1
        return {e: tuple(math.log((n + SMOOTHING) / (t + SMOOTHING * v)) for n, t in zip(ns, totals)) for e, ns in found.items()}

    words = logs(table(counts.select("lang", F.col("word").alias("entry"), "n")), [sizes[l] for l in langs])
    marked = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    each = [F.when(F.length(marked) >= s,
                   F.transform(F.sequence(F.lit(1), F.length(marked) - s + 1), lambda i, s=s: F.substring(marked, i, F.lit(s))))
            .otherwise(F.array().cast("array<string>")) for s in range(1, MAX_GRAM + 1)]
    grams = table(counts.select("lang", "n", F.explode(F.concat(*each)).alias("entry")))
    by_size: list[dict[str, tuple[float, ...]]] = [{}]
    for s in range(1, MAX_GRAM + 1):
        own = {g: n for g, n in grams.items() if len(g) == s}
        by_size.append(logs(own, [sum(n[i] for n in own.values()) for i in range(len(langs))]))
    share = [math.log(sizes[l] / sum(sizes.values())) for l in langs]
    return Model(langs, words, by_size, tuple(share))


def predictions(docs: DataFrame, model: Model, kept: list[str], text_col: str = "text") -> DataFrame:
    """``map_texts`` of ``kept`` with result struct<lang_pred, score>, from the text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the fitted sample

    def make():
        predict_one = sent.value.predict
        return lambda text: dict(zip(("lang_pred", "score"), predict_one(text)))
    return map_texts(docs, kept, text_col, make, "struct<lang_pred:string,score:double>",
                     pa.struct([("lang_pred", pa.string()), ("score", pa.float64())]))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score): one row per input row.

    Null and empty texts, and texts without a letter, are ``und`` with score 0.  Equal scores go to the
    alphabetically first language.  Repeated rows keep a row each; an empty table gives none.  Other
    columns are not read.
    """
    return predictions(docs, model, [id_col], text_col).select(*kept_as([id_col]), "result.lang_pred", "result.score")


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text modulo 3 (null for a null id)."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **limits) -> DataFrame:
    """(id_col, held_out, lang_pred, score).  Learns from labelled rows outside the held-out third; rows
    whose id is null are neither held out nor learned from."""
    model = fit(docs.where(fold(id_col) != 1), text_col, lang_col, **limits)
    return predict(docs, model, id_col, text_col).select(
        id_col, F.coalesce(fold(id_col) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
