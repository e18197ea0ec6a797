"""Operators 1 and 4 against brute force, with odd rows."""

import hashlib
import random
import re

from cardweir.llm import jaccard_join, substring_dedup
from cardweir.llm.components import components
from cardweir.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_repeats(rows):
    first = {}
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        for i in range(len(words) - 12):
            key = tuple(words[i : i + 13])
            first[key] = min(first.get(key, 1 << 62), 1 << 62 if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - 12):
            if first[tuple(words[i : i + 13])] < (1 << 62 if doc_id is None else doc_id):
                gone.update(range(i, i + 13))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def odd_rows(prose):
    passage = prose(99, 60)
    rows = [(i, prose(i, 30 + i % 50) + (f" {passage} " if i % 3 == 0 else " ") + prose(500 + i, 20)) for i in range(60)]
    rows += [(100 + i, prose(i % 5, 80)) for i in range(10)]
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, rows[6][1]), (200, None), (201, ""), (202, " \n\t "), (203, "one two"), (204, "été " * 40), (205, "ÉTÉ x y " * 20)]
    rows += [(206, prose(1, 40)[:-1] + "\x0b" + prose(1, 30)), (207, prose(31, 30_000)), (208, prose(31, 29_000))]
    return rows


def test_repeats_against_brute_force(spark, frame, prose):
    rows = odd_rows(prose)
    got = substring_dedup.remove_repeats(frame(rows)).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == brute_repeats(rows)
    assert all(sum(s["last"] - s["first"] + 1 for s in r.spans) == r.n_removed for r in got)


def test_repeats_with_small_groups_and_hot_nodes(spark, frame, prose, monkeypatch):
    rows = odd_rows(prose)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 20_000)
    got = substring_dedup.remove_repeats(frame(rows), group_suffixes=500, hot_suffixes=10).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == brute_repeats(rows)


def test_repeats_of_nothing(spark, frame):
    assert substring_dedup.remove_repeats(frame([]).limit(0)).count() == 0
    assert [r.n_words for r in substring_dedup.remove_repeats(frame([(1, None)])).collect()] == [0]


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if x and y and 100 * both >= 80 * (len(x) + len(y) - both):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return sorted((d, len(s), root(d)) for d, s in sets)


def near_copies(prose, seed, base, n, changes):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randrange(changes + 1)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def near_rows(prose):
    texts = [prose(i, 20 + 3 * i) for i in range(30)]
    for i in range(4):
        texts += near_copies(prose, i, prose(100 + i, 120 + 40 * i), 20, 8)
    texts += [texts[3], texts[3].upper(), "a b", "A  b", "a b c d", None, "", " ", "x " * 400, "x " * 9]
    order = list(range(len(texts)))
    random.Random(5).shuffle(order)
    return [(k, texts[i]) for k, i in enumerate(order)]


def test_near_components_against_brute_force(spark, frame, prose):
    rows = near_rows(prose)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_components(frame(rows)).collect())
    assert got == brute_components(rows)


def test_near_components_with_hot_and_split_shingles(spark, frame, prose, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_ROWS", 4)
    monkeypatch.setattr(jaccard_join, "HOT_BLOCK", 5)
    monkeypatch.setattr(jaccard_join, "PART_ROWS", 3)
    rows = near_rows(prose)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_components(frame(rows)).collect())
    assert got == brute_components(rows)


def test_one_of_each_group_stays(spark, frame, prose):
    rows = [(5, prose(1, 50)), (3, prose(1, 50)), (3, prose(1, 50)), (9, prose(2, 50)), (None, "free"), (11, None)]
    left = jaccard_join.keep_one(frame(rows))
    assert left.columns == frame(rows).columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["11", "3", "9", "None"]
    assert jaccard_join.keep_one(frame(rows).limit(0)).count() == 0


def test_components_of_a_chain_a_star_and_loops(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 301), (300, 301)]
    df = spark.createDataFrame(links, "a long, b long")
    got = dict(components(df, Scratch(spark, "test")).collect())
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 130)}, 300: 300, 301: 300}
    assert components(df.limit(0), Scratch(spark, "test")).count() == 0


def test_rows_without_id_and_ids_on_several_texts(frame, prose):
    one, two, three, four = (prose(i, 50) for i in (1, 2, 3, 4))
    rows = [(3, one), (5, one + " end"), (5, two), (9, two + " end"), (5, ""), (None, three), (None, three + " end"), (None, three)]
    rows += [(12, four), (None, four), (None, ""), (None, None), (13, None), (-7, "apart"), (None, "two words")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_components(frame(rows)).collect()), key=str)
    component = [3, 3, 3, 3, 3, None, None, None, 12, 12, None, None, 13, -7, None]
    assert got == sorted(((d, len(shingles(t)), c) for (d, t), c in zip(rows, component, strict=True)), key=str)
    left = sorted(((r.doc_id, r.text) for r in jaccard_join.keep_one(frame(rows)).collect()), key=str)
    chosen = [x for x in left if x[1] and x[1].startswith(three)]
    assert len(chosen) == 1 and chosen[0][0] is None
    want = [(3, one), (12, four), (None, ""), (None, None), (13, None), (-7, "apart"), (None, "two words"), *chosen]
    assert left == sorted(want, key=str)


def test_templates_of_one_group_are_compared_in_blocks(spark, frame, prose, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT_ROWS", 4)
    monkeypatch.setattr(jaccard_join, "HOT_BLOCK", 5)
    head = " ".join(f"head{i}" for i in range(25))
    tails = [" ".join(f"tail{k}x{i}" for i in range(7)) for k in range(16)]
    # the rarest shingles of each template are the head's: tails stand in many other texts, with the words before them
    rows = [(k, f"{head} {t}") for k, t in enumerate(tails)] + [(20, f"{head} {tails[3]} more")]
    rows += [(100 + 70 * k + j, f"{' '.join(head.split()[-4:])} {t} {prose(70 * k + j, 40)}") for k, t in enumerate(tails) for j in range(70)]
    seen, plain = [], jaccard_join._Join._pairs_in_groups

    def pairs(grouped):
        out = plain(grouped)
        seen.append((grouped.count(), out.count()))
        return out

    opened, whole = [], jaccard_join._Join._open_groups
    monkeypatch.setattr(jaccard_join._Join, "_pairs_in_groups", staticmethod(pairs))
    monkeypatch.setattr(jaccard_join._Join, "_open_groups", staticmethod(lambda named: opened.append(whole(named).count()) or whole(named)))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_components(frame(rows)).collect())
    assert got == brute_components(rows) and dict((d, c) for d, _, c in got)[20] == 3
    assert opened[-1] >= 16 and seen[-1] == (0, 0)
