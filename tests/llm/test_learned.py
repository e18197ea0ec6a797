"""Operators 6, 7 and 10 on held-out rows and odd ones."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cardweir.llm import language_id, quality_classifier, quality_rules
from cardweir.sources.tables import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, SF, "labels")


def test_quality_on_held_out_rows(documents, labels):
    rows = quality_classifier.quality_scores(documents, labels).join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    bad = [r for r in rows if not r.quality]
    good = [r for r in rows if r.quality]
    assert sum(r.predicted for r in good) >= 0.98 * len(good)
    assert sum(r.predicted for r in bad) <= 0.1 * len(bad)


def test_quality_of_odd_rows(spark, frame, documents, labels):
    model = quality_classifier.fit(documents, labels)
    rows = [(1, None), (2, ""), (None, "Ok."), (4, "### $$$ " * 5000), (4, "### $$$ " * 5000), (5, "A good plain line of words, as people write them. " * 30)]
    got = quality_classifier.classify(frame(rows), model)
    assert set(frame(rows).columns) <= set(got.columns)
    by = {r.doc_id: (r.score, r.predicted) for r in got.collect()}
    assert by[4][1] == 0 and by[5][1] == 1 and all(0 <= s <= 1 for s, _ in by.values())
    assert got.count() == 6 and quality_classifier.classify(frame(rows).limit(0), model).count() == 0


def test_quality_without_labels(frame, labels):
    model = quality_classifier.fit(frame([(1, "a b")]), labels.limit(0))
    assert model.means is None
    assert model.score(np.zeros((1, len(quality_classifier.FEATURES))))[0] == pytest.approx(0.5)


def test_language_on_held_out_rows(documents):
    rows = language_id.languages(documents).join(documents.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)


def test_language_word_by_word(documents):
    model = language_id.fit(documents)
    one = {lang: next(r.text for r in documents.filter((F.col("lang") == lang) & (F.length("text").between(300, 3000))).limit(1).collect())[:120] for lang in ("de", "fr")}
    words, p = model.words(pa.array([one["de"] + " " + one["fr"]]))
    named = [model.languages[k] for k in p.argmax(1)]
    assert named[:5] == ["de"] * 5 and named[-5:] == ["fr"] * 5


def test_forward_backward_against_enumeration():
    import itertools

    rng = np.random.default_rng(3)
    lengths, e, t = np.array([3, 0, 4, 1]), rng.normal(size=(8, 3)), rng.normal(size=(3, 3))
    got, expected = language_id._Chain(lengths).posteriors(e, t)
    at, want, counts = 0, [], np.zeros((3, 3))
    for n in lengths:
        p, total, own = np.zeros((n, 3)), 0.0, np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = np.exp(sum(e[at + i, k] for i, k in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])))
            total += w
            for i, k in enumerate(path):
                p[i, k] += w
            for a, b in zip(path, path[1:]):
                own[a, b] += w
        want.append(p / total)
        counts += own / total
        at += n
    assert np.allclose(got, np.concatenate(want), atol=1e-5) and np.allclose(expected, counts, atol=1e-5)


def test_language_of_odd_rows(frame, documents):
    model = language_id.fit(documents, sample=200)
    rows = [(1, None), (2, ""), (3, "12 !! —"), (None, "the thing " * 9), (4, "of the " * 40_000), (4, "of the " * 40_000)]
    got = language_id.predict(frame(rows), model).collect()
    assert [r.lang_pred for r in got if r.doc_id in (1, 2, 3)] == ["und"] * 3
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert language_id.predict(frame(rows).limit(0), model).count() == 0
    nothing = language_id.train([], [])
    assert nothing.predict(pa.array(["some words"]))[0] == ["und"]


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, covered, lines, again = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def test_rule_statistics_against_brute_force(spark, frame, documents):
    rows = [(-1, None), (-2, ""), (-3, "a a a a a"), (-4, "x\nx\n \n \nx\r\nx\r"), (-5, "é#é <é> é#é <é> é#é"), (-6, "a b"), (-6, "a b"), (None, "p q r p q r"), (-7, "k\x0bk\x0ck " * 5000)]
    rows += [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = quality_rules.text_statistics(frame(rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(d, *brute_statistics(t)) for d, t in rows], key=str)


def test_rules_on_held_out_rows(documents, labels):
    rows = quality_rules.judge(documents, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    good = [r for r in held if r.quality and not r.base_failed]
    bad = [r for r in held if not r.quality]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert sum(r.kept for r in bad) <= 0.2 * len(bad)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
    assert all(r.kept == (not r.base_failed and r.rule is None) for r in rows)


def test_rules_without_labels(frame, labels):
    rows = quality_rules.judge(frame([(1, "a b " * 60), (2, " ".join(map(str, range(80))))]), labels.limit(0)).collect()
    assert {r.doc_id: (r.base_failed, r.kept) for r in rows} == {1: (True, False), 2: (False, True)}
    assert quality_rules.judge(frame([]).limit(0), labels).count() == 0
