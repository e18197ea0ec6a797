"""Validators on the derived views, with their faults found. A41-A47: the dataset report."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardweir.operators import quality as Q
from cardweir.operators import reports as R
from cardweir.plans.registry import query
from cardweir.plans.scalar_queries import KEY_SQL, ratio_sql
from cardweir.sources import files as S
from cardweir.sources import tables as T

RULE_UNION = " UNION ALL "


def rules_sql(source: str, rules: dict[str, str], keep: str) -> str:
    return RULE_UNION.join(f"SELECT {keep}, '{n}' AS rule FROM {source} WHERE {e}" for n, e in rules.items())


@query(
    "V1_duplicate_event_id",
    "SELECT event_id, count(*) AS n FROM (SELECT event_id FROM attempts UNION ALL SELECT event_id FROM attempts WHERE amount_subunits % 7 = 0) a"
    " GROUP BY event_id HAVING count(*) > 1",
)
def duplicate_ids(spark, sf):
    a = T.attempts(spark, sf).select("event_id", "amount_subunits")
    return Q.duplicate_ids(a.union(a.filter("amount_subunits % 7 = 0")))


@query(
    "V2_outside_split",
    f"""SELECT event_id, split, CASE WHEN occurred_at_ms < {T.START_MS} + 14400000 THEN 'train'
  WHEN occurred_at_ms < {T.CALIBRATION_END_MS} THEN 'calibration' END AS expected_split FROM labels_v
WHERE split IS DISTINCT FROM CASE WHEN occurred_at_ms < {T.START_MS} + 14400000 THEN 'train'
  WHEN occurred_at_ms < {T.CALIBRATION_END_MS} THEN 'calibration' END""",
)
def outside_split(spark, sf):
    moved = T.START_MS + 14_400_000
    return Q.outside_split(
        T.labels(spark, sf), [("train", T.START_MS, moved), ("calibration", moved, T.CALIBRATION_END_MS)]
    )


@query("V3_outcome_pair", "SELECT event_id FROM attempts WHERE (outcome = 'failed' AND failure_category = 'unknown') OR (outcome = 'authorized' AND channel = 'web')")
def outcome_pair(spark, sf):
    broken = T.attempts(spark, sf).withColumn(
        "failure_category",
        F.expr("case when failure_category = 'unknown' then null when outcome = 'authorized' and channel = 'web' then 'unknown' else failure_category end"),
    )
    return Q.outcome_pair(broken)


QUOTA = "(SELECT split, scenario_type, CAST(CASE WHEN scenario_type = 'normal' THEN n + 1 ELSE n END AS BIGINT) AS expected FROM (SELECT split, scenario_type, count(*) AS n FROM labels_v GROUP BY 1, 2) q WHERE scenario_type <> 'flash_sale')"


@query(
    "V4_scenario_quota",
    f"""SELECT coalesce(a.split, e.split) AS split, coalesce(a.scenario_type, e.scenario_type) AS scenario_type, actual, expected
FROM (SELECT split, scenario_type, count(*) AS actual FROM labels_v GROUP BY 1, 2) a FULL JOIN {QUOTA} e
  ON a.split = e.split AND a.scenario_type = e.scenario_type WHERE coalesce(actual, 0) <> coalesce(expected, 0)""",
)
def scenario_quota(spark, sf):
    labels = T.labels(spark, sf)
    expected = (
        labels.groupBy("split", "scenario_type").agg(F.count(F.lit(1)).alias("n"))
        .filter("scenario_type <> 'flash_sale'")
        .selectExpr("split", "scenario_type", "if(scenario_type = 'normal', n + 1, n) as expected")
    )
    return Q.scenario_quota(labels, expected)


CHANGED = " OR ".join(f"min(coalesce({c}, '')) <> max(coalesce({c}, ''))" for c in Q.IDENTITY_FIELDS)


@query(
    "V5_retry_chains",
    f"""WITH r AS (SELECT *, occurred_at_ms - lag(occurred_at_ms) OVER (PARTITION BY scenario_instance_id ORDER BY occurred_at_ms, event_id) AS gap,
  row_number() OVER (PARTITION BY scenario_instance_id ORDER BY occurred_at_ms, event_id) AS rn FROM labelled WHERE scenario_type = 'legitimate_retry'),
c AS (SELECT scenario_instance_id AS chain, count(*) AS n, max(outcome) FILTER (WHERE rn = 1) AS first_outcome,
  max(checkout_id) FILTER (WHERE rn = 1) AS first_checkout, {CHANGED} AS changed, bool_or(gap NOT BETWEEN 1000 AND 600000) AS bad FROM r GROUP BY 1)
SELECT chain, 'chain_size_invalid' AS rule FROM c WHERE n NOT BETWEEN 2 AND 4
UNION ALL SELECT chain, 'must_start_failed' FROM c WHERE first_outcome <> 'failed'
UNION ALL SELECT chain, 'identity_changed' FROM c WHERE changed
UNION ALL SELECT chain, 'gap_out_of_bounds' FROM c WHERE bad
UNION ALL SELECT first_checkout, 'checkout_reused_across_chains' FROM c GROUP BY 1 HAVING count(*) > 1""",
)
def retry_chains(spark, sf):
    return Q.retry_chain_violations(T.labelled_attempts(spark, sf))


@query(
    "V6_campaign_integrity",
    """WITH c AS (SELECT split, CASE WHEN amount_subunits % 11 = 0 THEN NULL ELSE campaign_id END AS campaign_id, merchant_id,
  scenario_instance_id, campaign_profile FROM labelled WHERE is_attack),
g AS (SELECT split, campaign_id, count(*) AS n, min(merchant_id) <> max(merchant_id) AS spans,
  count(*) FILTER (WHERE scenario_instance_id IS NULL) > 0 OR min(scenario_instance_id) <> max(scenario_instance_id) AS mixed,
  bool_or(campaign_profile <> 'baseline_reuse') AS profile FROM c GROUP BY ALL)
SELECT split, campaign_id, 'campaign_id_missing' AS rule FROM g WHERE campaign_id IS NULL
UNION ALL SELECT split, campaign_id, 'campaign_profile_mismatch' FROM g WHERE profile
UNION ALL SELECT split, campaign_id, 'merchant_span_invalid' FROM g WHERE n >= 2 AND NOT spans
UNION ALL SELECT split, campaign_id, 'scenario_identity_mismatch' FROM g WHERE mixed
UNION ALL SELECT split, NULL, unnest(list_filter([CASE WHEN coalesce(have, 0) <> campaigns THEN 'campaign_count_mismatch' END,
  CASE WHEN coalesce(r, 0) <> attacks THEN 'campaign_event_quota_mismatch' END], lambda x: x IS NOT NULL))
FROM (VALUES ('train', 10, 300), ('calibration', 10, 34), ('holdout', 3, 60)) q(split, campaigns, attacks)
LEFT JOIN (SELECT split, count(campaign_id) AS have, sum(n) AS r FROM g GROUP BY 1) h USING (split)""",
)
def campaign_integrity(spark, sf):
    broken = T.labelled_attempts(spark, sf).withColumn(
        "campaign_id", F.expr("if(amount_subunits % 11 = 0, null, campaign_id)")
    )
    quotas = {"train": (10, 300), "calibration": (10, 34), "holdout": (3, 60)}
    return Q.campaign_integrity(broken, {s: "baseline_reuse" for s in T.SPLITS}, quotas)


@query(
    "V7_campaign_placement",
    f"""WITH e AS (SELECT campaign_id, count(*) AS n, min(occurred_at_ms) AS f, max(occurred_at_ms) AS l FROM labelled
  WHERE is_attack AND split = 'train' GROUP BY 1),
g AS (SELECT *, f - lag(l) OVER (ORDER BY f, l, campaign_id) AS gap, (SELECT 300 // count(*) FROM e) AS x,
  {T.START_MS + 28_800_000 * 6000 // 10_000} AS b FROM e)
SELECT campaign_id, 'quota_not_equal' AS rule FROM g WHERE n <> x
UNION ALL SELECT campaign_id, 'crosses_protected_boundary' FROM g WHERE f < b AND l >= b
UNION ALL SELECT campaign_id, 'gap_invalid' FROM g WHERE gap < 60000
UNION ALL SELECT NULL, 'missing_before_boundary' FROM g HAVING count(*) FILTER (WHERE l < b) < 1
UNION ALL SELECT NULL, 'missing_after_boundary' FROM g HAVING count(*) FILTER (WHERE f >= b) < 1
UNION ALL SELECT NULL, 'not_irregular' FROM g HAVING count(gap) > 1 AND min(gap) = max(gap)""",
)
def campaign_placement(spark, sf):
    return Q.campaign_placement(T.labelled_attempts(spark, sf), "train", T.START_MS, T.TRAIN_END_MS, attacks=300)


BOUNDARY = T.TRAIN_END_MS + (T.CALIBRATION_END_MS - T.TRAIN_END_MS) * 6000 // 10_000


@query(
    "V8_calibration_campaigns",
    f"""SELECT count(*) = 10 AS campaign_count_ok, coalesce(bool_and(n = 34), false) AS attacks_per_campaign_ok,
  count(*) FILTER (WHERE early = n) = 5 AND count(*) FILTER (WHERE early = 0) = 5 AS sides_ok,
  count(*) FILTER (WHERE early > 0 AND early < n) AS on_both_sides
FROM (SELECT campaign_id, count(*) AS n, count(*) FILTER (WHERE occurred_at_ms < {BOUNDARY}) AS early FROM labelled
  WHERE split = 'calibration' AND is_attack GROUP BY 1) c""",
)
def calibration_campaigns(spark, sf):
    return Q.calibration_campaigns(T.labelled_attempts(spark, sf), BOUNDARY)


@query(
    "V9_entity_rotation_shift",
    """WITH u AS (SELECT split, 'device' AS kind, count(DISTINCT device_token) AS u, count(*) AS n FROM labelled WHERE is_attack GROUP BY 1
UNION ALL SELECT split, 'session', count(DISTINCT session_token), count(*) FROM labelled WHERE is_attack GROUP BY 1)
SELECT b.kind, b.split AS baseline, b.u AS baseline_unique, b.n AS baseline_attacks, t.u AS test_unique, t.n AS test_attacks,
  b.u > 0 AND t.u > 0 AND t.u * b.n >= 2 * b.u * t.n AS shifted
FROM u b JOIN u t ON t.kind = b.kind AND t.split = 'test' WHERE b.split <> 'test'""",
)
def entity_rotation(spark, sf):
    return Q.entity_rotation_shift(T.labelled_attempts(spark, sf))


@query(
    "V10_network_coordination",
    """SELECT split, count(*) AS attacks, count(DISTINCT network_token) AS unique_networks, count(network_token) AS present,
  count(DISTINCT network_token) * 10000 > 5000 * count(*) AS too_sparse, count(network_token) * 10000 < 9000 * count(*) AS presence_too_low
FROM labelled WHERE is_attack GROUP BY split""",
)
def network_coordination(spark, sf):
    return Q.network_coordination(T.labelled_attempts(spark, sf))


@query(
    "V11_single_feature_separation",
    "SELECT DISTINCT 'amount_subunits' AS field FROM (SELECT amount_subunits FROM labelled WHERE is_attack EXCEPT SELECT amount_subunits FROM labelled WHERE NOT is_attack) a"
    " UNION SELECT DISTINCT 'outcome' FROM (SELECT outcome FROM labelled WHERE is_attack EXCEPT SELECT outcome FROM labelled WHERE NOT is_attack) a"
    " UNION SELECT DISTINCT 'failure_category' FROM (SELECT failure_category FROM labelled WHERE is_attack EXCEPT SELECT failure_category FROM labelled WHERE NOT is_attack) a"
    " UNION SELECT DISTINCT 'channel' FROM (SELECT channel FROM labelled WHERE is_attack EXCEPT SELECT channel FROM labelled WHERE NOT is_attack) a",
)
def single_feature(spark, sf):
    return Q.single_feature_separation(T.labelled_attempts(spark, sf))


NORMALISED = KEY_SQL.format(k="key")


@query(
    "V12_prohibited_keys",
    f"""SELECT call_no, key, {NORMALISED} AS normalised FROM (SELECT call_no, unnest(['entity', 'event', 'account_id', 'contains', 'created_at', 'extra',
  'payload', 'payment', 'entity', 'id', 'entity', 'amount', 'amount_refunded', 'currency', 'status', 'order_id', 'method', 'captured', 'email', 'card',
  'last4', 'error_code', 'created_at', 'ipAddress', 'billing-address']) AS key FROM webhook_bodies) k
WHERE {NORMALISED} IN ({', '.join(f"'{k}'" for k in Q.PROHIBITED_KEYS)})""",
)
def prohibited_keys(spark, sf):
    bodies = T.webhooks(spark, sf).select(
        "call_no", F.concat(F.lit('{"ipAddress":"x\\"cvv\\":","billing-address":[{"a":1}],"b":'), "body", F.lit("}")).alias("body")
    )
    bodies = bodies.withColumn("body", F.regexp_replace("body", '\\[\\{"a":1\\}\\],"b":', '["pan"],"entity":'))
    return Q.prohibited_keys(bodies, "body", "call_no")


SENSITIVE_SQL = r"""CASE WHEN regexp_matches({v}, '^[^@\s]+@[^@\s]+$') THEN 'contact_shaped'
  WHEN regexp_matches({v}, '^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){{3}}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$') THEN 'network_address'
  WHEN regexp_matches({v}, '^[0-9]{{13,19}}$') THEN 'pan_shaped' WHEN regexp_matches({v}, '^[0-9]{{3,4}}$') THEN 'cvv_shaped' END"""


@query(
    "V13_sensitive_values",
    "SELECT kind, count(*) AS n FROM (SELECT " + SENSITIVE_SQL.format(v="word")
    + r" AS kind FROM (SELECT unnest(regexp_split_to_array(text, '[ \n\t\r]+')) AS word FROM documents) w) k WHERE kind IS NOT NULL GROUP BY kind",
)
def sensitive_values(spark, sf):
    words = T.spread(T.table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select(
        F.explode(F.split("text", "[ \n\t\r]+")).alias("word")
    )
    return words.select(Q.sensitive_value("word").alias("kind")).filter("kind is not null").groupBy("kind").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "V14_ground_truth_leak",
    "SELECT 'is_attack' AS leaked, count(*) AS rows FROM attempts WHERE event_no % 97 = 1 HAVING count(*) > 0"
    " UNION ALL SELECT 'scenario_type', count(*) FROM attempts WHERE event_no % 101 = 2 AND event_no % 97 <> 1 HAVING count(*) > 0",
)
def ground_truth_leak(spark, sf):
    """Event lines as a model sees them, with a key planted at the top of some and in a nested object of others."""
    lines = S.attempt_lines(T.attempts(spark, sf), "event_no").selectExpr(
        "case when event_no % 97 = 1 then replace(value, '{', '{\"is_attack\":true,') when event_no % 101 = 2"
        " then replace(value, '{', '{\"note\":{\"scenario_type\" : \"split\"},') else value end as value",
        "event_no",
    )
    return Q.ground_truth_leak(lines, "value")


@query("V15_both_classes", "SELECT scenario_type FROM scored GROUP BY scenario_type HAVING min(y) = max(y)")
def both_classes(spark, sf):
    return Q.one_class_partitions(T.scored(spark, sf), "scenario_type")


PLANTED_LEDGER = """(SELECT id, status, currency, channel, calibrated_probability, risk_decision,
  CASE WHEN event_no % 10 = 3 THEN 'maybe' ELSE action END AS action, CASE WHEN event_no % 10 = 7 THEN 0 ELSE amount_subunits END AS amount_subunits FROM ledger) l"""


@query(
    "V16_ledger_constraints",
    rules_sql(PLANTED_LEDGER, {n: e.replace("not currency rlike '^[A-Z]{3}$'", "NOT regexp_matches(currency, '^[A-Z]{3}$')") for n, e in Q.LEDGER_RULES.items()}, "id")
    + RULE_UNION + rules_sql("(SELECT risk_decision_id || '#' || attempt_number AS id, attempt_number, summary, failure_reason, CASE WHEN status = 'pending' THEN 'ready' ELSE status END AS status FROM explanations) e", Q.EXPLANATION_RULES, "id"),
)
def ledger_constraints(spark, sf):
    planted = T.ledger(spark, sf).withColumns({
        "action": F.expr("if(event_no % 10 = 3, 'maybe', action)"),
        "amount_subunits": F.expr("if(event_no % 10 = 7, 0L, amount_subunits)"),
    })
    broken = T.explanations(spark, sf).withColumns({
        "status": F.expr("if(status = 'pending', 'ready', status)"),
        "id": F.concat_ws("#", "risk_decision_id", "attempt_number"),
    })
    return Q.constraint_violations(planted, Q.LEDGER_RULES, "id").unionByName(
        Q.constraint_violations(broken, Q.EXPLANATION_RULES, "id")
    )


def ranks(v: str, *percents: int) -> str:
    return ", ".join(f"list_sort(list({v}))[greatest(1, ({p} * count(*) + 99) // 100)] AS p{p}" for p in percents)


@query(
    "A41_amounts",
    f"SELECT count(*) AS count, min(amount_subunits) AS min, max(amount_subunits) AS max, {ranks('amount_subunits', 50, 95, 99)}, CAST(sum(amount_subunits) AS BIGINT) AS sum FROM attempts",
)
def amounts(spark, sf):
    return R.amounts(T.attempts(spark, sf))


@query(
    "A42_attack_prevalence",
    f"SELECT coalesce(split, 'all') AS split, count(*) AS denominator, count(*) FILTER (WHERE is_attack) AS numerator, {ratio_sql('count(*) FILTER (WHERE is_attack)', 'count(*)')} AS prevalence FROM labels_v GROUP BY ROLLUP (split)",
)
def prevalence(spark, sf):
    return R.prevalence(T.labels(spark, sf))


@query(
    "A43_value_counts",
    RULE_UNION.join(
        f"SELECT '{f}' AS field, {f} AS value, coalesce(split, 'all') AS split, count(*) AS n FROM labelled WHERE {f} IS NOT NULL GROUP BY GROUPING SETS (({f}, split), ({f}))"
        for f in ("channel", "outcome", "scenario_type", "failure_category")
    ),
)
def value_counts(spark, sf):
    return R.value_counts(T.labelled_attempts(spark, sf))


@query(
    "A44_group_sizes",
    f"SELECT what, count(*) AS count, min(n) AS min, max(n) AS max, {ranks('n', 50, 95)} FROM (SELECT 'campaign' AS what, count(*) AS n FROM labelled WHERE campaign_id IS NOT NULL GROUP BY campaign_id"
    " UNION ALL SELECT 'merchant', count(*) FROM labelled GROUP BY merchant_id) g GROUP BY what",
)
def group_sizes(spark, sf):
    return R.group_sizes(T.labelled_attempts(spark, sf))


@query(
    "A45_retry_chains",
    f"SELECT count(*) AS count, min(n) AS min, max(n) AS max, {ranks('n', 50, 95)}, count(*) FILTER (WHERE ok) AS succeeded, {ratio_sql('count(*) FILTER (WHERE ok)', 'count(*)')} AS success_rate"
    " FROM (SELECT count(*) AS n, bool_or(outcome = 'authorized') AS ok FROM labelled WHERE scenario_type = 'legitimate_retry' GROUP BY scenario_instance_id) c",
)
def retry_report(spark, sf):
    return R.retry_chains(T.labelled_attempts(spark, sf))


@query(
    "A46_entity_reuse",
    f"SELECT field, count(*) AS unique_tokens, min(n) AS min, max(n) AS max, {ranks('n', 50, 95)} FROM ("
    + RULE_UNION.join(f"SELECT '{f}' AS field, count(*) AS n FROM attempts WHERE {f} IS NOT NULL GROUP BY {f}" for f in R.TOKEN_FIELDS)
    + ") t GROUP BY field",
)
def entity_reuse(spark, sf):
    return R.entity_reuse(T.attempts(spark, sf))


@query(
    "A47_attack_entity_reuse",
    f"SELECT *, {ratio_sql('attack_events', 'unique_tokens')} AS attack_events_per_unique_token, {ratio_sql('unique_tokens', 'attack_events')} AS unique_tokens_per_attack_event FROM ("
    + RULE_UNION.join(
        f"SELECT split, '{k}' AS entity, count(*) AS attack_events, count(DISTINCT {k}_token) AS unique_tokens, count({k}_token) AS non_missing_events FROM labelled WHERE is_attack GROUP BY split"
        for k in ("device", "network", "session")
    ) + ") r",
)
def attack_entity_reuse(spark, sf):
    return R.attack_entity_reuse(T.labelled_attempts(spark, sf))
