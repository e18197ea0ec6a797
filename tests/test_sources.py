import hashlib
import json

import pytest
from fixtures import frame, random_rows

from cardweir.sources import files as S
from cardweir.session import new_table_path


def test_strict_attempts(spark):
    df = frame(spark, random_rows(1, 2))
    good = json.loads(S.attempt_lines(df).first().value)
    cases = {
        json.dumps(good): None, "": "blank", "{": "malformed", json.dumps({**good, "x": 1}): "keys",
        json.dumps({k: v for k, v in good.items() if k != "device_token"}): "keys",
        json.dumps({**good, "amount_subunits": 0}): "amount_range", json.dumps({**good, "occurred_at": "2026-01-01T00:00:00.0001Z"}): "occurred_at_shape",
        json.dumps({**good, "occurred_at": "2026-01-01T00:00:00+05:30"}): "occurred_at_shape",
        json.dumps({**good, "device_token": "dev_zz"}): "device_token_shape", json.dumps({**good, "channel": "fax"}): "channel_unknown",
        json.dumps({**good, "outcome": "failed", "failure_category": None}): "outcome_pair",
    }
    got = {r.value: r.reject_reason for r in S.parse_attempts(spark.createDataFrame([(k,) for k in cases], "value string")).collect()}
    assert got == cases


def test_identity_ignores_order_not_content(spark):
    df = frame(spark, random_rows(50, 3))
    one = S.dataset_identity(df, ["event_id", "amount_subunits"], "v1").first().dataset_id
    assert S.dataset_identity(df.orderBy("amount_subunits").repartition(3), ["event_id", "amount_subunits"], "v1").first().dataset_id == one
    assert S.dataset_identity(df, ["event_id", "amount_subunits"], "v2").first().dataset_id != one
    assert S.dataset_identity(df.selectExpr("event_id", "amount_subunits + 1 as amount_subunits"), ["event_id", "amount_subunits"], "v1").first().dataset_id != one


def test_manifest(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    row = S.file_manifest(spark, f"{sf}/events.parquet", S.rows_per_file(events)).first()
    raw = open(f"{sf}/events.parquet", "rb").read()
    assert (row.byte_size, row.sha256, row.row_count) == (len(raw), hashlib.sha256(raw).hexdigest(), events.count())


def test_contradicting_reference_is_an_error(spark):
    held = spark.sql("select 10L row_count, 2L attack_count, 0.5D recall, 0.5D precision, 0.1D false_positive_rate, 3L cost_units")
    bad = spark.sql("select 10L row_count, 2L attack_count, 8L legitimate_count, 1L true_positive, 1L false_negative, 1L false_positive, 0.2D false_positive_rate, 3L cost_units")
    with pytest.raises(Exception, match="contradict"):
        S.reference_rows(held, bad).collect()
    fine = bad.selectExpr("* except (false_positive_rate)", "0.125D as false_positive_rate")
    assert S.reference_rows(held, fine).count() == 2


def test_reports_are_published_once_read_back(spark):
    out = S.publish_report(spark.sql("select 1L as b, 'x' as a"), new_table_path(spark, "test-report")).first()
    assert out.report_id == hashlib.sha256(b'{"a":"x","b":1}').hexdigest()


def test_strict_feature_lines(spark):
    from cardweir.operators.features import FEATURE_NAMES, feature_vector

    path = new_table_path(spark, "test-features")
    good = json.loads(S.feature_lines(feature_vector(frame(spark, random_rows(1, 2))), list(FEATURE_NAMES)).first().value)
    f = good["features"]
    cases = {
        json.dumps(good): None,
        json.dumps({**good, "more": 1}): "keys",
        json.dumps({**good, "features": {**f, "more": 1}}): "feature_keys",
        json.dumps({**good, "features": {k: v for k, v in f.items() if k != "utc_hour"}}): "feature_missing",
        json.dumps({**good, "features": {**f, "channel_mobile_web": 1}}): "feature_invariant",
        json.dumps({**good, "features": {**f, "merchant_prior_failure_count_60s": 9}}): "feature_invariant",
        json.dumps({**good, "event_id": "evt_1"}): "event_id_shape",
    }
    spark.createDataFrame([(k,) for k in cases], "value string").write.text(path)
    accepted, rejected = S.read_features(spark, path)
    assert {r.value: r.reject_reason for r in rejected.collect()} == {k: v for k, v in cases.items() if v}
    assert accepted.count() == 1 and set(FEATURE_NAMES) <= set(accepted.columns)


def test_clustered_ledgers_prune_by_day_and_time(spark, sf):
    from cardweir.operators import ledger as L
    from cardweir.sources import ledger as G
    from cardweir.sources import tables as T

    plain = T.ledger(spark, sf)
    spread = plain.union(plain.selectExpr(*[f"{c} - {5 * G.DAY_MS} as {c}" if c in ("occurred_at_ms", "created_at_ms") else c for c in plain.columns]))
    path = new_table_path(spark, "test-ledger")
    G.write_clustered(spread, path)
    stored = G.read_clustered(spark, path)
    since = T.START_MS + 3_600_000
    kept = L.ledger_filter(stored, since_ms=since)
    assert sorted(r.id for r in kept.collect()) == sorted(r.id for r in L.ledger_filter(spread, since_ms=since).collect())
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "GreaterThanOrEqual(anchor_ms" in plan
    assert stored.count() == spread.count()
    page = [r.decision_id for r in L.ledger_page(stored, 30, 10).collect()]
    assert page == [r.decision_id for r in L.ledger_page(spread, 30, 10).collect()]


def test_score_tables_of_parts_add_up(spark, sf):
    from cardweir.operators import metrics as M
    from cardweir.operators import policy as P
    from cardweir.sources import tables as T

    rows = T.scored(spark, sf)
    both = P.score_table(rows.filter("split = 'train'"), "scenario_type").unionByName(P.score_table(rows.filter("split <> 'train'"), "scenario_type"))
    for measure in (lambda d: M.threshold_metrics(d, 0.6), M.ranking_metrics, M.calibration_losses, lambda d: P.evaluate_band(d, 0.4, 0.7), P.select_band, M.reliability, lambda d: M.hard_negative_slices(d, 0.6)):
        for a, b in zip(measure(rows).collect(), measure(both).collect(), strict=True):
            assert [pytest.approx(v, rel=1e-12) if isinstance(v, float) else v for v in a] == list(b)


def test_written_lines_take_little_room_and_read_back(spark):
    from pathlib import Path

    from cardweir.plans.source_queries import _written

    lines = spark.range(20).selectExpr("concat(id, repeat(' ', 1100000)) as value")
    path = _written(lines, "padded-lines")
    assert sum(f.stat().st_size for f in Path(path).glob("part-*")) < 1_000_000
    assert spark.read.text(path).filter("length(value) > 1100000").count() == 20


def test_vectors_meet_their_numbers_before_they_become_lines(spark, sf, monkeypatch):
    from cardweir.plans import source_queries as Q

    seen = []
    monkeypatch.setattr(Q, "_written", lambda lines, label: seen.append(lines) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        Q.read_features(spark, sf)
    plan = seen[0]._jdf.queryExecution().analyzed().toString()
    assert plan.index("to_json") < plan.index("Join")


def test_rows_are_dealt_by_their_number(spark):
    from cardweir.sources.tables import spread_rows

    rows = spark.range(1000).coalesce(1)
    dealt = spread_rows(rows, 50, "id")
    assert dealt.rdd.getNumPartitions() == 20
    assert max(dealt.rdd.glom().map(len).collect()) < 200 and dealt.count() == 1000
