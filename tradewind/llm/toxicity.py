"""Toxicity by a weighted finite-state pattern grammar over clauses.

Four small transducers are composed into one machine: negation, reported speech, quotation and target.
They read a clause as word classes (insult, threat, target, negation, report) and write matched events,
such as an insult aimed at someone, a denied one, or one that is only reported.  The word classes come
from a lexical transducer over letters: its stems and their weights are learned from labelled texts, and
an unseen word takes the weight of the longest stem that begins it.  A clause is scored by the weights of
its events, a text by its clauses, and a logistic model turns that into a probability.

Learning uses a bounded sample of the labelled rows (``SAMPLE_ROWS``), in which near copies count once.
Stems must pass a significance test against the share of toxic texts; nothing else limits their number.
The logistic model is fitted on scores by stems that were learned on the other half of the sample, so that
it knows how far stems can be trusted on texts not seen before.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import held, kept_as, map_batches, map_texts, named, store

#: labelled rows that the model is fitted on (all, if fewer), drawn by a seeded Bernoulli sample
SAMPLE_ROWS = 20_000
#: a text is taken as toxic from this score on
THRESHOLD = 0.3
SHORTEST_STEM, LONGEST_STEM = 3, 12
#: log likelihood ratio of a stem against the share of toxic texts, and of a longer stem against a shorter one
STEM_EVIDENCE, EXCEPTION_EVIDENCE = 14.0, 8.0
#: what must be left of a stem's evidence without its most frequent next letter, else the longer stem takes its place
SPREAD_EVIDENCE = 6.0
NEGATION_REACH = 3
CACHED_WORDS = 200_000
CACHED_CHARS = 40

# Function words of four languages that steer the grammar, and words that threaten.
TARGETS = frozenset("you your yours yourself u ur he him his she her they them their these those du dich dir dein deine ihr euch sie "
                    "tu toi te vous ton ta votre vos ils elles tú ti usted ustedes tus vosotros ellos ellas".split())
NEGATIONS = frozenset("not no never neither nor cannot without nobody isnt arent nicht kein keine keinen nie niemals ohne "
                      "pas jamais aucun aucune sans nunca jamás ningún ninguna sin tampoco".split())
REPORTS = frozenset("said says say saying called calls call told wrote writes quoted quote claimed claims reported reportedly "
                    "alleged allegedly sagte sagt nannte schrieb behauptet angeblich dit disait appelle écrit prétend "
                    "dijo dice llamó escribió afirma".split())
THREATS = frozenset("kill killing murder strangle stab shoot destroy hurt beat punch smash burn hang crush "
                    "töten umbringen erschießen verprügeln tuer frapper étrangler détruire matar golpear destruir".split())

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CLAUSE = re.compile(r"[^.!?;:,\n]+")
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[\"“”«»]")

#: word classes, and the events that the grammar writes
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = "oitynrq"
EVENTS = ("plain", "aimed", "denied", "reported", "threat")
#: logistic weights before any label is seen: intercept, the five events, the strongest clause, density
PRIOR = np.array([-3.0, 0.6, 0.8, 0.1, 0.2, 0.6, 0.6, 0.3])


# ---- transducers -----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Transducer:
    """Deterministic: (state, symbol) -> (state, symbol written).  State 0 begins; unlisted pairs keep both."""

    moves: dict[tuple[int, str], tuple[int, str]]

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.moves.get((state, symbol), (state, symbol))


def compose(first: Transducer, second: Transducer, symbols: str) -> Transducer:
    """The transducer that sends what ``first`` writes through ``second``."""
    number, queue, moves = {(0, 0): 0}, [(0, 0)], {}
    while queue:
        pair = queue.pop()
        for s in symbols:
            a, middle = first.step(pair[0], s)
            b, out = second.step(pair[1], middle)
            if (a, b) not in number:
                number[a, b] = len(number)
                queue.append((a, b))
            moves[number[pair], s] = number[a, b], out
    return Transducer(moves)


def _negation() -> Transducer:
    """Insults and threats within ``NEGATION_REACH`` words of a negation become denied (D)."""
    moves = {}
    for left, s in product(range(NEGATION_REACH + 1), "oityrq"):
        moves[left, s] = max(0, left - 1), "D" if left and s in "it" else s
    return Transducer(moves | {(left, NEGATION): (NEGATION_REACH, OTHER) for left in range(NEGATION_REACH + 1)})


def _reported() -> Transducer:
    """After a word of speech, to the end of the clause, insults and threats become reported (R)."""
    return Transducer({(0, REPORT): (1, OTHER), (1, REPORT): (1, OTHER), (1, INSULT): (1, "R"), (1, THREAT): (1, "R")})


def _quoted() -> Transducer:
    """Between quotation marks too."""
    return Transducer({(0, QUOTE): (1, OTHER), (1, QUOTE): (0, OTHER), (1, INSULT): (1, "R"), (1, THREAT): (1, "R")})


def _target() -> Transducer:
    """Insults near a target are aimed (A), others plain (P); a threat counts (T) once it has a target."""
    moves = {(0, INSULT): (0, "P"), (1, INSULT): (1, "A"), (0, TARGET): (1, OTHER), (1, TARGET): (1, OTHER),
             (0, THREAT): (2, OTHER), (1, THREAT): (1, "T"), (2, TARGET): (1, "T"), (2, INSULT): (2, "P"), (2, THREAT): (2, OTHER)}
    return Transducer(moves)


def grammar() -> Transducer:
    """Word classes of a clause -> events P, A, D, R, T (and o)."""
    symbols = "oityq" + NEGATION + REPORT
    out = compose(_negation(), _reported(), symbols)
    out = compose(out, _quoted(), symbols)
    return compose(out, _target(), symbols)


_EVENT = {"P": 0, "A": 1, "D": 2, "R": 3, "T": 4}


# ---- lexical transducer ----------------------------------------------------------------------------

def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def _evidence(k, n, share: float):
    """Log likelihood ratio of ``k`` toxic texts in ``n`` against ``share`` (columns or numbers)."""
    p = (k + share) / (n + 1.0)
    log = math.log if isinstance(p, float) else F.log
    return k * log(p / share) + (n - k) * log((1 - p) / (1 - share))


@dataclass
class Lexicon:
    """Stem -> weight; a stem that ends in ``$`` is a whole word.  Weights up to zero mark exceptions."""

    stems: dict[str, float]

    def weight(self, word: str) -> float:
        """The weight of the longest stem that begins the word."""
        marked, stems = word + "$", self.stems
        for size in range(min(len(marked), LONGEST_STEM), SHORTEST_STEM - 1, -1):
            w = stems.get(marked[:size])
            if w is not None:
                return w
        return 0.0

    def read(self, word: str) -> tuple[str, float]:
        """Class and weight of a word in lower case."""
        w = self.weight(word)
        if w > 0:
            return INSULT, w
        if word in TARGETS:
            return TARGET, 0.0
        if word in NEGATIONS or word.endswith(("n't", "n’t")):
            return NEGATION, 0.0
        if word in REPORTS:
            return REPORT, 0.0
        return (THREAT, 3.0) if word in THREATS else (OTHER, 0.0)


class _Read(dict):
    """Word -> (class, weight), filled as words come (forgotten when many)."""

    def __init__(self, lexicon: Lexicon):
        super().__init__({'"': (QUOTE, 0.0), "“": (QUOTE, 0.0), "”": (QUOTE, 0.0), "«": (QUOTE, 0.0), "»": (QUOTE, 0.0)})
        self.lexicon = lexicon

    def __missing__(self, word: str) -> tuple[str, float]:
        out = self.lexicon.read(word)
        if len(word) <= CACHED_CHARS and len(self) < CACHED_WORDS:
            self[word] = out
        return out


def _stems(text: str) -> set[str]:
    out = set()
    for word in set(WORD.findall(text)):
        marked = word + "$"
        out.update(marked[:n] for n in range(SHORTEST_STEM, min(len(marked), LONGEST_STEM) + 1))
    return out


def _near_copy_key(words: list[str]) -> int:
    """Least hash of the runs of three words; near copies mostly share it."""
    runs = {" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))}
    return min(xxhash.xxh3_64_intdigest(r.encode("utf-8", "surrogatepass")) for r in runs)


# ---- scoring ---------------------------------------------------------------------------------------

@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex, compare=False)

    @property
    def reader(self) -> "Scorer":
        return held(("toxicity", self.name), lambda: Scorer(self.lexicon))

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(features @ self.weights))))))


class Scorer:
    """Runs the composed grammar over the clauses of texts."""

    def __init__(self, lexicon: Lexicon):
        self.read, self.machine = _Read(lexicon), grammar()

    def clauses(self, text: str) -> list[tuple[int, int, list[float]]]:
        """(start, end, weight of each event) of the clauses that match, in code points."""
        out, low = [], text.lower()
        if len(low) != len(text):  # a few capitals grow in lower case; keep the places of the text
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        for clause in CLAUSE.finditer(low):
            found = [self.read[t] for t in TOKEN.findall(clause[0])]
            if not any(kind in "it" for kind, _ in found):
                continue
            state, events, waiting = 0, [0.0] * 5, 0.0
            for kind, weight in found:
                state, wrote = self.machine.step(state, kind)
                if kind == THREAT:
                    waiting = weight
                if wrote in _EVENT:
                    events[_EVENT[wrote]] += weight or waiting
            if any(events):
                out.append((clause.start(), clause.end(), events))
        return out

    def features(self, clauses, n_words: int) -> np.ndarray:
        events = np.array([e for _, _, e in clauses]) if clauses else np.zeros((1, 5))
        total = events.sum(0)
        live = events[:, [0, 1, 4]].sum(1)
        return np.r_[1.0, np.log1p(total), min(8.0, live.max()), live.sum() / math.sqrt(n_words + 10.0)]

    def run(self, text: str | None) -> tuple[list[tuple[int, int, list[float]]], np.ndarray]:
        words = WORD.findall((text or "").lower())
        read = self.read
        hit = any(read[w][0] in "it" for w in set(words))
        clauses = self.clauses(text) if hit else []
        return clauses, self.features(clauses, len(words))


# ---- learning --------------------------------------------------------------------------------------

def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression around ``PRIOR`` by Newton steps."""
    beta, pull = PRIOR.copy(), np.r_[0.05, np.full(len(PRIOR) - 1, 0.5)]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (y - p) - pull * (beta - PRIOR)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        move = np.linalg.solve(curve, slope)
        beta = beta + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return beta


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample_rows: int) -> DataFrame:
    """(key, toxic, text): about ``sample_rows`` labelled texts, near copies of one label once."""
    known = labels.select(named(id_col).alias("id"), named(label_col).cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IN (0, 1)").distinct()
    n = known.count()
    known = known if n <= sample_rows else known.sample(sample_rows / n, seed=1)
    # the ids are as many as the sample at most; a repeated id may still stand on many rows
    rows = docs.select(named(id_col).alias("id"), named(text_col).cast("string").alias("text")).join(F.broadcast(known), "id")
    n = rows.select("id").count()
    rows = rows if n <= 2 * sample_rows else rows.sample(2 * sample_rows / n, seed=2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [_near_copy_key(WORD.findall((t.as_py() or "").lower())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), b.column(0), b.column(1)],
                                             names=["key", "toxic", "text"])
    rows = map_batches(rows.select("toxic", "text"), run, "key bigint, toxic int, text string")
    return store(rows.groupBy("key", "toxic").agg(F.min("text").alias("text")))


def _stem_counts(sample: DataFrame) -> DataFrame:
    """(stem, n0, k0, n1, k1): texts and toxic texts of each half of the sample that hold a stem."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tally = [Counter() for _ in range(4)]
            for key, toxic, text in zip(*(c.to_pylist() for c in b.columns)):
                found = _stems((text or "").lower())
                tally[2 * (key & 1)].update(found)
                if toxic:
                    tally[2 * (key & 1) + 1].update(found)
            stems = sorted(tally[0] | tally[2])
            yield pa.RecordBatch.from_arrays([pa.array(stems), *(pa.array([t[s] for s in stems], pa.int64()) for t in tally)],
                                             names=["stem", "n0", "k0", "n1", "k1"])
    counts = map_batches(sample, run, "stem string, n0 bigint, k0 bigint, n1 bigint, k1 bigint")
    return store(counts.groupBy("stem").agg(*[F.sum(c).alias(c) for c in ("n0", "k0", "n1", "k1")]))


def _spread(found: dict[str, tuple[float, float]], share: float) -> dict[str, tuple[float, float]]:
    """The shortest stems whose evidence comes from several continuations, so that one word does not
    colour all words that begin like it."""
    below: dict[str, list[str]] = {}
    for stem in found:
        below.setdefault(stem[:-1], []).append(stem)
    kept, queue = {}, [s for s in found if s[:-1] not in found]
    while queue:
        stem = queue.pop()
        (k, n), longer = found[stem], below.get(stem, [])
        if longer:
            most, of = max(found[s] for s in longer)
            if _evidence(k - most, max(n - of, k - most), share) < SPREAD_EVIDENCE:
                queue.extend(longer)
                continue
        kept[stem] = (k, n)
    return kept


def _lexicon(counts: DataFrame, halves: tuple[int, ...], share: float) -> Lexicon:
    """Stems with significant weights, and longer stems that differ significantly from a shorter one."""
    n = sum((F.col(f"n{h}") for h in halves), F.lit(0))
    k = sum((F.col(f"k{h}") for h in halves), F.lit(0))
    own = counts.select("stem", n.cast("double").alias("n"), k.cast("double").alias("k")).where("n > 0")
    toxic = own.where((F.col("k") > F.col("n") / 2) & (_evidence(F.col("k"), F.col("n"), share) >= STEM_EVIDENCE))
    found = _spread({r["stem"]: (r["k"], r["n"]) for r in toxic.collect()}, share)  # bounded by the sample's words
    if not found:
        return Lexicon({})
    spark = counts.sparkSession
    shorter = spark.createDataFrame([(s,) for s in found], "above string")
    starts = F.explode(F.transform(F.sequence(F.lit(SHORTEST_STEM), F.length("stem") - 1), lambda i: F.substring("stem", F.lit(1), i)))
    longer = own.where(f"length(stem) > {SHORTEST_STEM} AND n >= 3").withColumn("above", starts)
    longer = longer.join(F.broadcast(shorter), "above").select("stem", "n", "k").distinct()
    known = found | {r["stem"]: (r["k"], r["n"]) for r in longer.collect()}
    rate: dict[str, float] = {}
    for stem in sorted(known, key=lambda s: (len(s), s)):
        k, n = known[stem]
        above = next((rate[stem[:i]] for i in range(len(stem) - 1, SHORTEST_STEM - 1, -1) if stem[:i] in rate), None)
        if above is None:
            if stem in found:
                rate[stem] = (k + 2 * share) / (n + 2)
        elif _evidence(float(k), n, above) >= EXCEPTION_EVIDENCE:
            rate[stem] = (k + 10 * above) / (n + 10)
    return Lexicon({s: _logit(p) - _logit(share) if p >= 0.5 else 0.0 for s, p in rate.items()})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the rows of ``labels`` (0 or 1) and their texts.  Without both labels: the prior model, no stems."""
    sample = _sample(docs, labels, id_col, text_col, label_col, sample_rows)
    n, k = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < k < n:
        return Model(Lexicon({}), PRIOR)
    share = k / n
    counts = _stem_counts(sample)
    lexicon, first, second = (_lexicon(counts, halves, share) for halves in ((0, 1), (0,), (1,)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = Scorer(second), Scorer(first)  # each half is read with the stems of the other
        for b in batches:
            rows = [scorers[key & 1].run(text)[1] for key, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], names=["toxic", "x"])
    # one short row per text of the sample
    rows = sorted(map_batches(sample, run, "toxic int, x array<double>").collect())
    x, y = np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float)
    return Model(lexicon, _logistic(x, y))


def scores(docs: DataFrame, model: Model, kept: list[str], text_col: str = "text") -> DataFrame:
    """``map_texts`` of ``kept`` with result struct<score, clauses>; a clause is (start, end, kind, weight) in
    code points, its kind that of its heaviest event."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def make():
        model = sent.value
        scorer = model.reader

        def one(text):
            clauses, features = scorer.run(text)
            found = [{"start": s, "end": e, "kind": EVENTS[int(np.argmax(w))], "weight": float(sum(w))} for s, e, w in clauses]
            return {"score": model.score(features), "clauses": found}
        return one
    clause = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("weight", pa.float64())])
    return map_texts(docs, kept, text_col, make,
                     "struct<score:double,clauses:array<struct<start:bigint,end:bigint,kind:string,weight:double>>>",
                     pa.struct([("score", pa.float64()), ("clauses", pa.list_(clause))]))


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text modulo 4 (null for a null id)."""
    return F.pmod(F.crc32(named(id_col).cast("string").cast("binary")), F.lit(4))


def rate(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
         sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id_col, held_out, score, predicted, clauses): one row per row of ``docs``, scored by its text alone.

    Labels are learned outside the held-out quarter only.  Null, empty and wordless texts have the score of
    a text without a match.  Rows with a null id are neither held out nor learned from; labels that are
    null or other than 0 and 1, or whose id has no text, teach nothing; an id with both labels teaches
    both.  Repeated rows keep a row each; an empty table gives none.  Other columns are not read.
    """
    model = fit(docs, labels.where(fold(id_col) != 2), id_col, text_col, label_col, sample_rows)
    out = scores(docs, model, [id_col], text_col)
    return out.select(*kept_as([id_col]), "result").select(
        named(id_col), F.coalesce(fold(id_col) == 2, F.lit(False)).alias("held_out"), "result.score",
        (F.col("result.score") >= THRESHOLD).cast("int").alias("predicted"), "result.clauses")
