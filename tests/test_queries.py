"""A cross-section of the registered queries against their SQL twins; check_queries.py runs them all."""

import duckdb
import pytest

import __spark_entry__
from check_queries import TABLES, rows_of

QUICK = (
    "R9_checkout_history R8_prior_failure_rate_bp P1_current_features P7_audit_decimal P9_ledger_summary_view F3_fixed_decimal_ratio"
    " F10_canonical_json F12_hmac_sha256 J2_join_anomalies J5_assign_bin W1_ledger_page W2_latest_explanation W3_order_budget"
    " A5_threshold_curve A15_hard_negative_slices A24_boundary_diagnostics A33_psi A36_ledger_summary A43_value_counts"
    " A47_attack_entity_reuse V5_retry_chains V7_campaign_placement V9_entity_rotation_shift V16_ledger_constraints"
    " K1_screen_requests K5_sanitise_payload K7_observations E6_forbidden_content G4_hub_shared_kinds G7_clusters S6_dataset_identity"
).split()


def test_registry_is_whole():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries)
    wanted = {f"S{i}" for i in range(1, 17)} | {f"P{i}" for i in range(1, 16)} | {f"J{i}" for i in range(1, 11)}
    wanted |= {f"R{i}" for i in range(1, 12)} | {f"A{i}" for i in range(1, 48)} | {f"W{i}" for i in range(1, 10)}
    wanted |= {f"X{i}" for i in range(1, 6)} | {f"F{i}" for i in range(1, 19)} | {f"T{i}" for i in range(1, 11)}
    wanted |= {f"K{i}" for i in range(1, 9)} | {f"M{i}" for i in range(1, 9)} | {f"V{i}" for i in range(1, 17)}
    wanted |= {f"G{i}" for i in range(1, 8)} | {f"E{i}" for i in range(1, 12)}
    found = {name.split("_")[0] for name in queries}
    assert wanted <= found
    assert all(x == "pipeline" or x.startswith("op") for x in found - wanted)


@pytest.fixture(scope="module")
def connection(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, sf, connection, name):
    df = __spark_entry__.queries()[name](spark, sf)
    cursor = connection.execute(__spark_entry__.oracle_sql()[name])
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
