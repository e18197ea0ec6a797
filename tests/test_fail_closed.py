"""Missing values and empty inputs never pass a rule, and no shared data lands on one machine's disk."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from cardweir import session
from cardweir.operators import drift as D
from cardweir.operators import evidence as E
from cardweir.operators import metrics as M
from cardweir.operators import policy as P
from cardweir.operators import quality as Q
from cardweir.operators.rolling import DEVICE, RollingSpec, rolling_features
from cardweir.sources import files as S


def test_no_temporary_folder_off_a_local_master():
    def stub(master, conf):
        get = lambda key, default=None: conf.get(key, default)
        context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=get))
        return SimpleNamespace(conf=SimpleNamespace(get=get), sparkContext=context)

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_dir(stub(master, {}))
    assert session.shared_dir(stub("yarn", {"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"


def test_written_tables_can_be_discarded(spark):
    table = session.materialise(spark.range(3), "test")
    assert session.path_exists(spark, table._written_at)
    session.discard(table)
    assert not session.path_exists(spark, table._written_at)


def test_no_score_no_allowance(spark):
    df = spark.sql("select explode(array(null, double('NaN'), 0.1D, 0.9D)) as p")
    assert [r[0] for r in df.select(P.classify("p", 0.5)).collect()] == [None, None, "allow", "deny"]
    assert [r[0] for r in df.select(P.band_route("p", 0.3, 0.5)).collect()] == ["review", "review", "allow", "deny"]


def test_all_candidates_without_a_grid(spark):
    df = spark.range(2000).selectExpr("id / 2000D as p", "cast(id > 900 as int) as y")
    assert P.sweep_candidates(df).count() == 2001
    assert P.sweep_candidates(df, 50).count() <= 51


def test_malformed_drafts(spark):
    good = "A plain summary that is long enough."
    rows = [(good, "", ["device_reuse"]), (good, None, ["device_reuse"]), (None, "", ["device_reuse"]), (good, "", None), (good, "", ["made_up"]), (good, "", [None])]
    df = spark.createDataFrame(rows, "summary string, caveat string, factors array<string>")
    assert [r[0] for r in df.select(E.malformed("summary", "caveat", "factors")).collect()] == [False, False, True, True, True, True]


def test_psi_of_nothing_is_an_error(spark):
    bins = spark.range(2).selectExpr("id as bin", "10L as bin_count")
    for observed in ("0L", "if(bin = 0, 5L, null)"):
        with pytest.raises(Exception, match="no observed rows|do not match"):
            D.psi(bins.selectExpr("*", f"{observed} as observed_count")).collect()
    with pytest.raises(Exception, match="reference has no rows"):
        D.psi(bins.selectExpr("bin", "0L as bin_count", "4L as observed_count")).collect()


def test_ranking_of_one_class_is_null(spark):
    one = spark.sql("select 0.5D as p, 1 as y union all select 0.7D, 1")
    assert M.ranking_metrics(one).first().roc_auc is None


def test_rotation_without_test_attacks_is_not_shifted(spark):
    df = spark.sql("select 'train' as split, true as is_attack, 'dev_1' as device_token, 'ses_1' as session_token")
    assert [(r.kind, r.test_attacks, r.shifted) for r in Q.entity_rotation_shift(df).orderBy("kind").collect()] == [("device", 0, False), ("session", 0, False)]


def test_attempts_without_an_entity_keep_their_row(spark):
    rows = [("evt_1", 1000, None, "a", "failed"), ("evt_2", 2000, "d", "b", "authorized"), ("evt_3", 2500, "d", "c", "failed")]
    df = spark.createDataFrame(rows, "event_id string, occurred_at_ms long, device_token string, note string, outcome string")
    df = df.withColumns({c: F.lit("x") for c in ("session_token", "payment_instrument_token", "customer_token", "network_token", "merchant_id", "checkout_id")})
    got = {r.event_id: r for r in rolling_features(df, RollingSpec((DEVICE,), carry=("note",))).collect()}
    assert {k: r.note for k, r in got.items()} == {"evt_1": "a", "evt_2": "b", "evt_3": "c"}
    assert got["evt_1"].device_prior_attempt_count_300s == 0 and got["evt_3"].device_prior_attempt_count_300s == 1


def test_feature_lines_are_refused_with_a_reason(spark, tmp_path):
    event = "evt_" + "0" * 32
    sound = f'{{"event_id":"{event}","features":{{"a":1,"b":2}},"occurred_at":"2026-01-01T00:00:00.000Z"}}'
    lines = [sound, sound[:40], sound.replace('"b":2', '"b":null'), sound.replace("Z", ""), "", sound + " " * 70_000]
    path = f"file://{tmp_path}/lines"
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    accepted, rejected = S.read_features(spark, path, ("a", "b"))
    assert [tuple(r) for r in accepted.collect()] == [(event, 1_767_225_600_000, 1, 2)]
    assert sorted(r.reject_reason for r in rejected.collect()) == ["blank", "feature_missing", "malformed", "occurred_at_shape", "oversized"]
