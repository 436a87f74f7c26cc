from pyspark.sql import functions as F

from tradewind.llm import langid as L

from .conftest import docs_of


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 250
    assert sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in out)


def test_held_out_rows_and_other_columns_teach_nothing(spark, documents):
    told = L.identify(documents).collect()
    lied = documents.withColumn("lang", F.when(L.fold() == 1, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("?"))
    assert sorted(L.identify(lied).collect()) == sorted(told)


def test_edges(edge_docs, edge_rows, no_docs, documents):
    rows = L.identify(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    by_id = {r.doc_id: r for r in rows}
    for i in (1, 2, 3, 9):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert by_id[7].lang_pred != "und" and not by_id[None].held_out
    assert L.identify(no_docs).count() == 0


def test_no_labels_give_und(spark):
    docs = docs_of(spark, [(i, "some words here", None) for i in range(5)])
    assert {(r.lang_pred, r.score) for r in L.identify(docs).collect()} == {("und", 0.0)}


def test_words_first_then_longest_grams():
    model = L.Model(["a", "b"], {"known": (0.0, -5.0)}, [{}, {"x": (-9.0, -1.0)}, {}, {"unk": (-1.0, -2.0)}, {" unk": (-1.5, -9.0)}], (0.0, 0.0))
    assert model.scores["known"] == (0.0, -5.0)
    assert model.back_off("unk") == (-1.5, -9.0)  # four characters before three
    assert model.back_off("xunk") == (-10.0, -3.0)
    assert model.back_off("zzz") == (0.0, 0.0)
    assert model.predict("known xx")[0] == "b" and model.predict("known")[0] == "a"
    assert model.predict("zzz") == ("a", 0.5)  # a tie goes to the first language


def test_every_word_of_the_sample_that_recurs_is_kept(spark):
    rows = [(1, "once twice twice thrice thrice thrice", "a"), (2, "solo twice", "b"), (3, "unlabelled unlabelled", None)]
    docs = docs_of(spark, rows)
    model = L.fit(docs)
    assert set(model.words) == {"twice", "thrice"} and model.words["twice"][0] != model.words["twice"][1]
    assert set(L.fit(docs, min_count=1).words) == {"once", "twice", "thrice", "solo"}
    assert "ice " in model.grams[4] and not any("olo" in g for g in model.grams[3])


def test_bounded_sample(documents):
    few = L.fit(documents, sample_rows=20)
    assert 0 < len(few.words) < len(L.fit(documents).words)
