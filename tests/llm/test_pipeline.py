import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from tradewind.llm import langid, secret_scan, simhash

from .conftest import WORDS, docs_of


def test_stages_by_brute_force(spark, documents, tmp_path):
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    docs, rows = documents, {r.doc_id: r for r in documents.collect()}
    assert [n for n, _ in P.STAGES] == ["language_id", "simhash_near_dedup", "secret_scans", "best_fit_packing"]

    docs = P.language_id(spark, docs, str(tmp_path))
    model = langid.fit(documents.where(langid.fold() != 1))
    left = {i for i, r in rows.items() if model.predict(r.text)[0] != "und" and model.predict(r.text)[1] >= 0.5}
    assert {r.doc_id for r in docs.collect()} == left and docs.columns == documents.columns

    before = docs
    docs = P.simhash_near_dedup(spark, docs, str(tmp_path))
    fps = {i: simhash.fingerprint(rows[i].text) for i in left}
    first = set()
    todo = set(left)
    while todo:
        group, edge = set(), [min(todo)]
        while edge:
            i = edge.pop()
            group.add(i)
            edge += [j for j in todo - group if (fps[i] ^ fps[j]).bit_count() <= 4]
        first.add(min(group))
        todo -= group
    assert {r.doc_id for r in docs.collect()} == first and docs.columns == before.columns

    ranks = secret_scan.word_ranks(secret_scan.corpus_words(docs))
    docs = P.secret_scans(spark, docs, str(tmp_path))
    for r in docs.collect():
        source = rows[r.doc_id].text
        spans = secret_scan.find_spans(source, ranks)
        assert r.text == secret_scan.redact_text(source, spans) and r.n_chars == len(r.text)
        assert (r.text == source) == (not spans) and not re.search("[0-9a-f]{24}", r.text)

    texts = {r.doc_id: r.text for r in docs.collect()}
    packed = P.best_fit_packing(spark, docs, str(tmp_path)).collect()
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, text in texts.items():
        assert sum(p.length for p in packed if p.doc_id == i) == len(coder.encode(text, add_special_tokens=False).ids) + 1
    assert sorted(map(str, P.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect())) == \
        sorted(str(r) for r in P.best_fit_packing(spark, docs, str(tmp_path)).drop("sequence_id", "offset").collect())


def test_edge_rows_go_through(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns
            docs = out
        P.STAGES[-1][1](spark, docs, "").collect()


def test_without_labels_no_document_goes(spark):
    docs = docs_of(spark, [(i, " ".join(WORDS), None) for i in range(4)] + [(9, "123", None)])
    assert P.language_id(spark, docs, "").count() == 5
