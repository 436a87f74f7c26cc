import random

import pytest
from pyspark.sql import functions as F

from tradewind.llm import toxicity as T

from .conftest import docs_of

CLEAN = "the river runs past old houses and people walk by slowly every morning while birds sing near quiet water".split()


def labelled(seed=1, n=600):
    """Documents where 'blorg' is an insult as a word and 'zwk' begins many; labels for all."""
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        words = [rng.choice(CLEAN) + rng.choice(["", "s", "er"]) for _ in range(rng.randrange(8, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                bad = "blorg" if rng.random() < 0.5 else "zwk" + rng.choice(["a", "ento", "ip", "ur", "osch", "elli", "im"])
                words.insert(rng.randrange(len(words)), bad)
        rows.append((i, " ".join(words) + ".", "en"))
        marks.append((i, 1, int(toxic)))
    return rows, marks


@pytest.fixture(scope="module")
def tables(spark):
    rows, marks = labelled()
    return docs_of(spark, rows).repartition(3), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def model(tables):
    return T.fit(*tables)


def apply(machine, word):
    state, out = 0, ""
    for symbol in word:
        state, wrote = machine.step(state, symbol)
        out += wrote
    return out


def test_composition_equals_one_after_the_other():
    parts = [T._negation(), T._reported(), T._quoted(), T._target()]
    rng = random.Random(4)
    for _ in range(2000):
        word = "".join(rng.choice("oityqnr") for _ in range(rng.randrange(1, 14)))
        want = word
        for p in parts:
            want = apply(p, want)
        assert apply(T.grammar(), word) == want


def test_events_of_clauses():
    scorer = T.Scorer(T.Lexicon({"blorg$": 4.0, "zwk": 5.0, "zwkok": 0.0}))

    def events(text):
        return [{T.EVENTS[i]: w for i, w in enumerate(e) if w} for _, _, e in scorer.clauses(text)]
    assert events("what a blorg") == [{"plain": 4.0}]
    assert events("you are a blorg") == [{"aimed": 4.0}]
    assert events("you are not a blorg") == [{"denied": 4.0}]
    assert events("you aren't a blorg") == [{"denied": 4.0}]
    assert events("not that it would matter here you blorg") == [{"aimed": 4.0}]  # the negation does not reach so far
    assert events("they said blorg, you zwkum") == [{"reported": 4.0}, {"aimed": 5.0}]  # the report ends with its clause
    assert events('a “blorg” and a blorg') == [{"plain": 4.0, "reported": 4.0}]
    assert events("kill the lights") == [] and events("I will kill you") == [{"threat": 3.0}]
    assert events("you said kill") == [{"reported": 3.0}]
    assert events("zwkok zwkoka") == [] and events("zwkan") == [{"plain": 5.0}]  # an exception, a word never seen
    assert scorer.clauses("Fine. A blorg!")[0][:2] == (5, 13)
    assert events("") == events("....") == []


def test_stems_are_learned_and_generalise(model):
    assert model.lexicon.weight("blorg") > 2 and model.lexicon.weight("blorgia") == 0
    assert model.lexicon.weight("zwknever") > 2
    assert all(model.lexicon.weight(w) <= 0 for w in CLEAN)
    scorer = T.Scorer(model.lexicon)
    score = lambda t: model.score(scorer.run(t)[1])
    clean = "the river runs past old houses"
    assert score(clean) < T.THRESHOLD < score(clean + ", you zwkummer blorg") and score(None) == score("") < T.THRESHOLD
    assert score(clean + ", you blorg zwka") > score(clean + ", nobody calls it blorg zwka")


def test_held_out_quality(tables):
    docs, labels = tables
    out = T.rate(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(out) > 100 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert sum(r.predicted == r.toxic for r in out) >= 0.97 * len(out)


def test_held_out_quality_on_the_given_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = T.rate(docs, labels).join(labels, "doc_id").where("held_out").collect()
    caught = sum(r.predicted and r.toxic for r in out)
    assert caught >= 0.8 * sum(r.toxic for r in out) and caught >= 0.9 * sum(r.predicted for r in out)


def test_only_text_and_the_learned_fold_count(tables):
    docs, labels = tables
    told = {r.doc_id: (r.score, r.predicted) for r in T.rate(docs, labels).collect()}
    lied = labels.withColumn("toxic", F.when(T.fold() == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("?"))
    assert {r.doc_id: (r.score, r.predicted) for r in T.rate(other, lied).collect()} == told


def test_copies_count_once(spark):
    """A toxic text that stands on a third of the rows does not colour its clean words."""
    rows, marks = labelled(3, 400)
    rows += [(1000 + i, "quagga wallaby tapir blorg blorg okapi.", "en") for i in range(200)]
    marks += [(1000 + i, 1, 1) for i in range(200)]
    docs, labels = docs_of(spark, rows), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    model = T.fit(docs, labels)
    assert model.lexicon.weight("blorg") > 2 and all(model.lexicon.weight(w) <= 0 for w in ("quagga", "wallaby", "tapir", "okapi"))


def test_edges(spark, edge_docs, edge_rows, no_docs, tables):
    marks = [(7, 1), (8, 0), (None, 1), (9, None), (4, 7), (99, 1), (5, 0), (5, 1), (1, 0)]
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    rows = T.rate(edge_docs, labels).collect()
    assert len(rows) == len(edge_rows) and not [r for r in rows if r.doc_id is None and r.held_out]
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3, 9)}) == 1
    assert T.rate(no_docs, labels).count() == 0
    none = T.rate(edge_docs, labels.limit(0)).collect()
    assert len(none) == len(edge_rows) and all(r.score < T.THRESHOLD and r.predicted == 0 for r in none)


def test_bounded_sample(tables):
    docs, labels = tables
    assert T._sample(docs, labels, "doc_id", "text", "toxic", 100).count() < 160
    hot = docs.withColumn("doc_id", F.lit(5).cast("bigint"))  # one id on all rows
    assert T._sample(hot, labels, "doc_id", "text", "toxic", 100).count() < 300
