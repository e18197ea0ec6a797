"""Operator 12 against brute force."""

import math
import re
from collections import Counter

from cardweir.llm import lexical_scan

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(rows, items, k):
    docs = [(d, terms(t)) for d, t in rows]
    docs = [(d, w, Counter(w)) for d, w in docs if w]
    n, total = len(docs), sum(len(w) for _, w, _ in docs)
    df = Counter(t for _, _, c in docs for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, words in asked.items():
        scores = []
        for d, w, c in docs:
            m = 75 + 25 * len(w) * n // total
            s = sum(x * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, x in words.items() if t in c)
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def odd(prose):
    rows = [(i, prose(i, 5 + i % 60, 60)) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " .,- "), (None, "w1 w2 w3"), (5, prose(5, 10, 60)), (203, "W1-w2,w3\tÉté été ÀB w1" * 3), (204, prose(7, 40_000, 60)), (205, "w11 w1 xw1 w1x"), (206, "w1\x00w2\x7fw3")]
    rows += [(300 + i, rows[3][1]) for i in range(30)]
    items = [(1, "w1 W2 w2 unknown"), (2, "w11, w12; w13"), (3, None), (4, "..."), (None, "été w5"), (1, "w30"), (6, "Été"), (7, rows[3][1])]
    return rows, items


def test_search_against_brute_force(spark, frame, prose):
    rows, items = odd(prose)
    asked = spark.createDataFrame([(i, t, 1, 2.0) for i, t in items], "item_id long, text string, rank int, score double")
    for k, size in ((20, 1_000_000), (4, 20)):
        assert rows_of(lexical_scan.search_items(frame(rows), asked, k, size)) == brute(rows, items, k)


def test_search_of_nothing(spark, frame):
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert rows_of(lexical_scan.search_items(frame([(1, "a")]).limit(0), asked)) == []
    assert rows_of(lexical_scan.search_items(frame([(1, "c")]), asked)) == []
    assert rows_of(lexical_scan.search_items(frame([(1, "a")]), asked.limit(0))) == []


def test_a_task_keeps_the_best_over_many_blocks(spark, frame, prose, monkeypatch):
    monkeypatch.setattr(lexical_scan, "_CELLS", 9)
    rows, items = odd(prose)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(lexical_scan.search_items(frame(rows).coalesce(1), asked, 3)) == brute(rows, items, 3)
