import random
import re
import time

import pytest

from tradewind.llm import license_scan as S
from tradewind.llm.queries import op3_license_scan

from .conftest import docs_of


def plain(text):
    low = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for phrase, label in S.BASE.items() for i in range(len(words))
            if words[i:i + len(phrase.split())] == phrase.decode().split()]
    return len(words), sorted(hits)


@pytest.mark.parametrize("text, labels", [
    ("This work is licensed under the GNU General Public License, version 3.", ["gpl-3"]),
    ("Licensed under CC BY-NC 4.0.", ["cc-by-nc-4.0"]), ("SPDX-License-Identifier: GPL-2.0-or-later", ["gpl-2.0"]),
    ("the 3-Clause BSD License; MIT License. GNU LGPL v2.1", ["bsd-3-clause", "mit", "lgpl-2.1"]),
    ("Apache License, Version 2.0", ["apache-2.0"]), ("creative commons attribution share-alike 3.0", ["cc-by-sa-3.0"]),
    ("All Rights Reserved", ["reserved"]), ("mit dem Auto, by the apache tribe", []), ("", [])])
def test_labels(text, labels):
    assert [r.label for r, _, _ in S.detections(S.word_form(text)[0])] == labels


def written(pattern, rng):
    """A random text that the pattern matches."""
    def one(node):
        kind, what = str(node[0]), node[1]
        if kind == "LITERAL":
            return chr(what)
        if kind in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = what
            return "".join(many(inner) for _ in range(rng.randint(low, min(int(high), low + 3))))
        if kind == "SUBPATTERN":
            return many(what[-1])
        if kind == "BRANCH":
            return many(rng.choice(what[1]))
        if kind == "IN":
            return rng.choice([c for c in "abcz0159" if re.match(in_class(what), c)])
        if kind == "ANY":
            return rng.choice("abz ")
        assert kind in ("ASSERT", "ASSERT_NOT"), kind
        return ""

    def in_class(items):
        out = ""
        for k, v in items:
            out += re.escape(chr(v)) if str(k) == "LITERAL" else f"{chr(v[0])}-{chr(v[1])}" if str(k) == "RANGE" else {"CATEGORY_DIGIT": "0-9", "CATEGORY_WORD": "a-z0-9", "CATEGORY_NOT_SPACE": "a-z"}[str(v)]
        return f"[{out}]"

    def many(nodes):
        return "".join(one(n) for n in nodes)
    return many(re._parser.parse(pattern))


def test_rules_are_ordered_and_gates_lose_nothing(documents):
    """A text that a rule matches holds the rule's gate: by texts written from the patterns, and by all rules on documents."""
    rules, rng = S.rules(), random.Random(3)
    assert len(rules) >= 450 and [r.priority for r in rules] == list(range(len(rules)))
    assert [r.tier for r in rules] == sorted(r.tier for r in rules)
    for r in rules:
        matched = 0
        for _ in range(40):
            text = " " + " ".join(written(r.pattern.pattern.decode(), rng).split()) + " "
            m = r.pattern.search(text.encode())
            if m:
                matched += 1
                assert r.gate in b" " + m[0] + b" ", (r, m[0])
        assert matched, r
    for text in [r.text for r in documents.limit(60).collect()] + ["GNU Lesser General Public License v2.1 or later, CC0 1.0, two-clause BSD"]:
        form, _ = S.word_form(text)
        for r in rules:
            if r.gate not in form:
                assert r.pattern.search(form) is None, r


def plain_detections(form):
    """All rules without gates, intervals compared one by one."""
    found = []
    for r in S.rules():
        for m in r.pattern.finditer(form):
            first = form.count(b" ", 0, m.start()) - 1
            found.append((r, first, first + m[0].count(b" ") + 1))
    kept = [(r, a, z) for r, a, z in found if not any(o.priority < r.priority and x <= a and z <= y for o, x, y in found)]
    return sorted(kept, key=lambda d: (d[1], d[0].priority))


def test_suppression_equals_brute_force():
    """Random sequences of pieces of license texts, so that intervals nest, overlap and repeat."""
    rng, rules = random.Random(11), S.rules()
    pieces = "the gnu general public license version 2 or any later cc by nc 4 0 all rights reserved copyright c 2020 mit under bsd clause".split()
    for _ in range(60):
        words = []
        while len(words) < 120:
            words += written(rng.choice(rules).pattern.pattern.decode(), rng).split() if rng.random() < 0.3 else [rng.choice(pieces)]
        form, _ = S.word_form(" ".join(words))
        assert S.detections(form) == plain_detections(form)


def test_a_million_places_in_one_text():
    start = time.perf_counter()
    form, n = S.word_form("all rights reserved. " * 1_000_000)
    assert len(S.base_places(form)) == 1_000_000 == len(S.detections(form)) and n == 3_000_000
    assert time.perf_counter() - start < 60


def test_no_kept_interval_lies_in_one_of_higher_priority():
    form, _ = S.word_form("licensed under the GNU General Public License version 2 or any later version, see the general public license")
    kept = S.detections(form)
    assert len(kept) >= 2
    for r, a, z in kept:
        assert not any(o.priority < r.priority and x <= a and z <= y for o, x, y in kept)


def test_query(spark, tmp_path, edge_rows):
    rows = edge_rows + [(50, "cc by cc by CC-BY general public license\nall rights reserved", "en"), (51, "accc by", "en"), (52, "cc by cc by", "en")]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = op3_license_scan(spark, str(tmp_path)).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in out)
    want = []
    for i, t, _ in rows:
        n, hits = plain(t)
        starts = [h[0] for h in hits]
        want.append((str(i), n, len(hits), str(min(starts, default=None)), str(max(starts, default=None)), ",".join(sorted({h[1] for h in hits}))))
    assert got == sorted(want)
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in out)
    assert S.scan(docs_of(spark, [])).count() == 0
