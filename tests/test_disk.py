"""What a step leaves on disk goes before the next one begins."""

from __future__ import annotations

import os

import pytest
from fixtures import brute_force, frame, random_rows
from pyspark.sql import functions as F

from cardweir import session
from cardweir.operators import analysis
from cardweir.operators.features import feature_vector
from cardweir.operators.rolling import Slicing
from cardweir.plans import scalar_queries, source_queries
from cardweir.session import FREE_SHUFFLES, materialise, passing_tables, shared_dir

EVERY_HOT = Slicing(share=0.0, minimum_rows=0, sample_modulus=1, slice_ms=1_000)


def _tables(spark) -> set[str]:
    folder = f"{shared_dir(spark)}/cardweir"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def _left(spark, before: set[str]) -> list[str]:
    return sorted(name.rsplit("-", 1)[0] for name in _tables(spark) - before)


def _exchanges(df) -> int:
    return sum(line.lstrip(" :+-*()0123456789").startswith("Exchange") for line in df._jdf.queryExecution().executedPlan().toString().splitlines())


def test_pairs_and_gaps_are_over_before_the_windows_begin(spark):
    out = feature_vector(frame(spark, random_rows(60, 2)), None)
    assert _exchanges(out) <= 3  # attempts dealt, entities, back to attempts; pairs, gaps and their join came before
    assert out.count() == 60


def test_a_written_table_frees_the_shuffles_behind_it(spark, monkeypatch):
    seen = []
    write = type(spark.range(1).write).parquet
    monkeypatch.setattr(type(spark.range(1).write), "parquet", lambda self, path, *a, **b: seen.append(spark.conf.get(FREE_SHUFFLES, "false")) or write(self, path, *a, **b))
    assert materialise(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "freed").count() == 7
    assert seen == ["true"] and spark.conf.get(FREE_SHUFFLES, "false") == "false"


def test_passing_tables_go_and_kept_ones_stay(spark):
    before = _tables(spark)
    with passing_tables() as keep:
        materialise(spark.range(3), "gone")
        kept = keep(materialise(spark.range(5), "kept"))
    assert kept.count() == 5 and _left(spark, before) == ["kept"]
    with pytest.raises(ValueError), passing_tables():
        materialise(spark.range(3), "gone")
        raise ValueError
    assert _left(spark, before) == ["kept"] and session._WRITTEN[-1][1].endswith(kept._written_at.rsplit("/", 1)[1])


def test_blindspot_measures_one_outcome_after_the_other(spark):
    before = _tables(spark)
    attempts = frame(spark, random_rows(80, 4))
    labels = attempts.selectExpr("event_id", "outcome = 'failed' as is_attack")
    out = analysis.blindspot(attempts, labels, lambda f: f.withColumn("p", F.expr("least(1D, device_prior_failure_count_3600s / 10D)")), 0.1)
    assert _left(spark, before) == ["blindspot", "blindspot"] and _exchanges(out) == 0
    rows = {r.outcomes: r for r in out.collect()}
    assert set(rows) == {"true", "assumed_authorized"} and rows["assumed_authorized"].true_positive == 0


@pytest.mark.parametrize("query, left", [
    (lambda spark, sf: scalar_queries.join_labels(spark, sf), ["vectors"]),
    (lambda spark, sf: scalar_queries.compare_features(spark, sf), ["expected-features"]),
    (lambda spark, sf: source_queries.read_features(spark, sf), ["feature-lines"]),
], ids=["J1", "J8", "S3"])
def test_only_the_table_that_is_read_stays(spark, sf, query, left):
    before = _tables(spark)
    out = query(spark, sf)
    assert _left(spark, before) == left and out.count() > 0


@pytest.mark.parametrize("slicing", [None, EVERY_HOT], ids=["plain", "sliced"])
@pytest.mark.parametrize("odd_ids", [False, True], ids=["token-ids", "odd-ids"])
def test_texts_of_any_shape_are_told_apart(spark, slicing, odd_ids):
    """Tokens travel as bytes. Texts that are no tokens, of 15, 16 and 17 bytes too, or that name the same bytes, are others than they."""
    rows = random_rows(150, 11)
    odd = ["dev_" + "0" * 31 + "A", "dev_" + "0" * 31 + "a", "dev_" + "0" * 32, "0" * 15, "0" * 16, "0" * 15 + "\x01", "", "\u00e9" * 18, "dev_\u00e9"]
    rows = [(*r[:5], odd[i % len(odd)] if i % 3 else r[5], *r[6:]) for i, r in enumerate(rows)]
    if odd_ids:
        rows = [((r[0][:36 - i % 3] if i % 2 else r[0].upper()) + ("" if i % 5 else f"-{i}"), *r[1:]) for i, r in enumerate(rows)]
        rows = list({r[0]: r for r in rows}.values())
    want = brute_force(rows)
    got = {r.event_id: r.asDict() for r in feature_vector(frame(spark, rows), slicing).collect()}
    assert set(got) == set(want)
    assert all(got[e][k] == v for e, values in want.items() for k, v in values.items())
