"""Projections, scalars, joins, sets and order."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardweir.functions import scalars as S
from cardweir.functions import text as X
from cardweir.operators import features as E
from cardweir.operators import joins as J
from cardweir.operators import ordering as O
from cardweir.operators import policy as P
from cardweir.plans.registry import query
from cardweir.session import materialise, passing_tables
from cardweir.sources import tables as T

A = "attempts"


@query("P2_assume_authorized", "SELECT event_id, 'authorized' AS outcome, NULL AS failure_category FROM attempts")
def assume_authorized(spark, sf):
    return E.assume_authorized(T.attempts(spark, sf)).select("event_id", "outcome", "failure_category")


EVENT_COLUMNS = (
    "event_id, merchant_id, checkout_id, customer_token, device_token, network_token, session_token,"
    " payment_instrument_token, amount_subunits, currency, channel"
)


@query(
    "P3_preflight_to_event",
    f"SELECT {EVENT_COLUMNS}, occurred_at_ms + 5 AS occurred_at_ms, 'authorized' AS outcome, NULL AS failure_category FROM attempts",
)
def preflight_to_event(spark, sf):
    return E.preflight_to_event(
        T.attempts(spark, sf).withColumn("assigned_at_ms", F.col("occurred_at_ms") + 5)
    )


@query("P4_classify", "SELECT event_id, CASE WHEN p >= 0.62 THEN 'deny' ELSE 'allow' END AS risk_decision FROM scored")
def classify(spark, sf):
    return T.scored(spark, sf).select("event_id", P.classify("p", 0.62).alias("risk_decision"))


@query(
    "P5_band_route",
    "SELECT event_id, CASE WHEN p >= 0.8 THEN 'deny' WHEN p >= 0.5 THEN 'review' ELSE 'allow' END AS route FROM scored",
)
def band_route(spark, sf):
    return T.scored(spark, sf).select("event_id", P.band_route("p", 0.5, 0.8).alias("route"))


@query(
    "P6_fail_safe_action",
    "SELECT id, CASE WHEN fail_safe_reason IS NOT NULL THEN 'review' ELSE risk_decision END AS action, risk_decision FROM ledger",
)
def fail_safe(spark, sf):
    return T.ledger(spark, sf).select(
        "id", P.fail_safe_action("risk_decision", "fail_safe_reason").alias("action"), "risk_decision"
    )


@query(
    "P7_audit_decimal",
    "SELECT event_id, CAST(CAST(CAST(p AS VARCHAR) AS DECIMAL(20,18)) AS VARCHAR) AS audit FROM scored",
)
def audit_decimal(spark, sf):
    return T.scored(spark, sf).select("event_id", S.audit_decimal("p").cast("string").alias("audit"))


@query(
    "P12_supported_payment_event",
    "SELECT name, CASE WHEN name IN ('payment.authorized', 'payment.captured', 'payment.failed') THEN 'processed'"
    " ELSE 'ignored' END AS result, count(*) AS n FROM webhook_calls GROUP BY name",
)
def supported(spark, sf):
    from cardweir.operators.webhooks import processing_result

    names = T.webhooks(spark, sf).select(F.get_json_object("body", "$.event").alias("name"))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).select(
        "name", processing_result("name").alias("result"), "n"
    )


@query("P13_assign_split", "SELECT event_id, split FROM labels_v")
def assign_split(spark, sf):
    from cardweir.operators.quality import assign_split

    bounds = [
        ("train", T.START_MS, T.TRAIN_END_MS),
        ("calibration", T.TRAIN_END_MS, T.CALIBRATION_END_MS),
        ("test", T.CALIBRATION_END_MS, None),
    ]
    return T.attempts(spark, sf).select("event_id", assign_split("occurred_at_ms", bounds).alias("split"))


SIDE_SQL = (
    f"CASE WHEN occurred_at_ms < {T.TRAIN_END_MS} + ({T.CALIBRATION_END_MS} - {T.TRAIN_END_MS}) * 6000 // 10000"
    " THEN 'calibration_fit' ELSE 'policy_selection' END"
)


@query("P14_calibration_side", f"SELECT event_id, {SIDE_SQL} AS side FROM labels_v WHERE split = 'calibration'")
def calibration_side(spark, sf):
    from cardweir.operators.quality import calibration_side

    rows = T.labels(spark, sf).filter("split = 'calibration'")
    boundary = S.boundary_ms(F.lit(T.TRAIN_END_MS), F.lit(T.CALIBRATION_END_MS), 6000)
    return rows.select("event_id", calibration_side("occurred_at_ms", boundary).alias("side"))


@query(
    "P15_class_filters",
    "SELECT event_id, CASE WHEN split = 'test' THEN 'positive' ELSE 'control' END AS role FROM scored"
    " WHERE split = 'test' OR y = 1",
)
def class_filters(spark, sf):
    from cardweir.operators.analysis import control_filter, positive_class_filter

    s = T.scored(spark, sf)
    return positive_class_filter(s).select("event_id", F.lit("positive").alias("role")).unionByName(
        control_filter(s).filter("y = 1").select("event_id", F.lit("control").alias("role"))
    )


@query("F1_bp_floor", "SELECT event_no, CASE WHEN event_no % 7 = 0 THEN 0 ELSE (event_no % 5) * 10000 // (event_no % 7) END AS bp FROM attempts")
def bp_floor(spark, sf):
    n = F.col("event_no")
    return T.attempts(spark, sf).select("event_no", S.bp_floor(n % 5, n % 7).alias("bp"))


@query("F2_bp_half_up", "SELECT event_no, ((event_no % 5) * 20000 + event_no % 7) // (2 * nullif(event_no % 7, 0)) AS bp FROM attempts")
def bp_half_up(spark, sf):
    n = F.col("event_no")
    return T.attempts(spark, sf).select("event_no", S.bp_half_up(n % 5, n % 7).alias("bp"))


def ratio_sql(n: str, d: str, places: int = 6) -> str:
    scale = 10**places
    scaled = f"((({n}) * {scale} + ({d}) // 2) // nullif({d}, 0))"
    return (
        f"CASE WHEN ({d}) <= 0 THEN '0.{'0' * places}' ELSE CAST({scaled} // {scale} AS VARCHAR) || '.'"
        f" || lpad(CAST({scaled} % {scale} AS VARCHAR), {places}, '0') END"
    )


@query("F3_fixed_decimal_ratio", f"SELECT event_no, {ratio_sql('event_no % 5', 'event_no % 7')} AS ratio FROM attempts")
def fixed_ratio(spark, sf):
    n = F.col("event_no")
    return T.attempts(spark, sf).select("event_no", S.fixed_decimal_ratio(n % 5, n % 7).alias("ratio"))


@query("F4_rate", "SELECT event_no, (event_no % 5) / nullif(event_no % 7, 0)::DOUBLE AS rate FROM attempts")
def rate(spark, sf):
    n = F.col("event_no")
    return T.attempts(spark, sf).select("event_no", S.rate(n % 5, n % 7).alias("rate"))


@query("F5_elapsed_ms", f"SELECT event_id, occurred_at_ms - {T.START_MS} AS elapsed_ms FROM attempts")
def elapsed(spark, sf):
    ts = F.timestamp_millis("occurred_at_ms")
    return T.attempts(spark, sf).select(
        "event_id", S.elapsed_ms(S.to_millis(ts), F.lit(T.START_MS)).alias("elapsed_ms")
    )


@query("F6_boundary_ts", "SELECT event_id, occurred_at_ms + amount_subunits * 6001 // 10000 AS boundary_ms FROM attempts")
def boundary(spark, sf):
    start = F.col("occurred_at_ms")
    return T.attempts(spark, sf).select(
        "event_id", S.boundary_ms(start, start + F.col("amount_subunits"), 6001).alias("boundary_ms")
    )


@query("F7_anchor_time", "SELECT id, coalesce(occurred_at_ms, created_at_ms) AS anchor_ms FROM ledger")
def anchor(spark, sf):
    return T.ledger(spark, sf).select("id", S.anchor_time().alias("anchor_ms"))


TOKEN_COLUMNS = [c for c in S.TOKEN_PREFIXES if c not in ("campaign_id", "scenario_instance_id")]


@query(
    "F8_token_shapes",
    "SELECT " + ", ".join(
        f"count(*) FILTER (WHERE regexp_matches({c}, '^{S.TOKEN_PREFIXES[c]}_[0-9a-f]{{32}}$')) AS {c}"
        for c in S.TOKEN_PREFIXES
    ) + " FROM labelled",
)
def token_shapes(spark, sf):
    return T.labelled_attempts(spark, sf).agg(*[
        F.count_if(S.is_token(c)).alias(c) for c in S.TOKEN_PREFIXES
    ])


Z = "(value / 10.0::DOUBLE - 4)"


@query(
    "F9_sigmoid_and_clip",
    f"SELECT event_id, round(CASE WHEN {Z} >= 0 THEN 1 / (1 + exp(-abs({Z}))) ELSE exp(-abs({Z})) / (1 + exp(-abs({Z}))) END, 12) AS p,"
    " least(greatest(value / 100.0::DOUBLE, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE) AS clipped FROM events",
)
def sigmoid(spark, sf):
    v = F.col("value")
    return T.table(spark, sf, "events").select(
        "event_id",
        F.round(S.sigmoid_stable(v / 10.0 - 4), 12).alias("p"),
        S.clip_probability(v / 100.0).alias("clipped"),
    )


JSON_SQL = (
    """'{"amount_subunits":' || amount_subunits || ',"device_token":' ||"""
    """ coalesce('"' || device_token || '"', 'null') || ',"event_id":"' || event_id || '"}'"""
)


@query("F10_canonical_json", f"SELECT event_id, {JSON_SQL} AS body FROM attempts")
def canonical_json(spark, sf):
    return T.attempts(spark, sf).select(
        "event_id", S.canonical_json("event_id", "amount_subunits", "device_token").alias("body")
    )


@query("F11_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def sha256(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", S.sha256_hex("text").alias("digest"))


@query("F12_hmac_sha256", "SELECT call_no, mac AS signature FROM webhooks")
def hmac(spark, sf):
    return T.webhooks(spark, sf).select("call_no", S.hmac_sha256("body", T.WEBHOOK_KEY).alias("signature"))


KEY_SQL = (
    "regexp_replace(regexp_replace(lower(regexp_replace({k}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')),"
    " '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
)
RAW_KEY = "(channel || 'IP Address.' || CAST(event_no % 9 AS VARCHAR) || 'PhoneNo__')"


@query("F13_normalise_key", f"SELECT event_no, {KEY_SQL.format(k=RAW_KEY)} AS k FROM attempts")
def normalise_key(spark, sf):
    raw = F.concat("channel", F.lit("IP Address."), (F.col("event_no") % 9).cast("string"), F.lit("PhoneNo__"))
    return T.attempts(spark, sf).select("event_no", X.normalise_key(raw).alias("k"))


def number_sql(v: str) -> str:
    return (
        f"regexp_replace(regexp_replace(regexp_replace(trim(replace({v}, ',', '')),"
        " '(\\.[0-9]*?)0+$', '\\1'), '\\.$', ''), '^0+([0-9])', '\\1')"
    )


RAW_NUMBER = "('0' || CAST(event_no // 100 AS VARCHAR) || ',' || lpad(CAST(event_no % 1000 AS VARCHAR), 3, '0') || '.' || CAST(event_no % 10 AS VARCHAR) || '00')"


@query("F14_normalise_number", f"SELECT event_no, {number_sql(RAW_NUMBER)} AS v FROM attempts")
def normalise_number(spark, sf):
    n = F.col("event_no")
    raw = F.concat(
        F.lit("0"), S.int_div(n, F.lit(100)).cast("string"), F.lit(","),
        F.lpad((n % 1000).cast("string"), 3, "0"), F.lit("."), (n % 10).cast("string"), F.lit("00"),
    )
    return T.attempts(spark, sf).select("event_no", X.normalise_number(raw).alias("v"))


@query(
    "F15_duration_parts",
    """SELECT event_no, CAST(s AS VARCHAR)
  || CASE WHEN s >= 60 THEN ' ' || (s // 60) || ' ' || (s % 60) ELSE '' END
  || CASE WHEN s >= 3600 THEN ' ' || (s // 3600) || ' ' || ((s % 3600) // 60) ELSE '' END AS parts
FROM (SELECT event_no, amount_subunits AS s FROM attempts) a""",
)
def duration_parts(spark, sf):
    return T.attempts(spark, sf).select(
        "event_no", F.array_join(X.duration_parts("amount_subunits"), " ").alias("parts")
    )


@query("F16_from_epoch_seconds", "SELECT n AS call_no, strftime(to_timestamp(seconds) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS at FROM webhook_calls")
def epoch_seconds(spark, sf):
    at = S.from_epoch_seconds(F.get_json_object("body", "$.created_at").cast("long"))
    return T.webhooks(spark, sf).select(
        "call_no", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at")
    )


@query("F17_clamp", "SELECT event_no, greatest(least(amount_subunits, 5000), 60) AS v FROM attempts")
def clamp(spark, sf):
    return T.attempts(spark, sf).select("event_no", S.clamp("amount_subunits", F.lit(60), F.lit(5000)).alias("v"))


@query(
    "F18_allowlist_or_redact",
    "SELECT doc_id, CASE WHEN regexp_matches(lang, '^[a-z]{2}$') THEN lang ELSE '[REDACTED]' END AS lang,"
    " CASE WHEN regexp_matches(source, '^[A-Za-z0-9_.-]+$') THEN source ELSE '[REDACTED]' END AS source FROM documents",
)
def allowlist(spark, sf):
    return T.table(spark, sf, "documents").select(
        "doc_id",
        S.allowlist_or_redact("lang", F.col("lang").rlike("^[a-z]{2}$")).alias("lang"),
        S.allowlist_or_redact("source", F.col("source").rlike("^[A-Za-z0-9_.-]+$")).alias("source"),
    )


def full_width_sql() -> str:
    from cardweir.operators.rolling import FAMILIES
    from cardweir.plans.rolling_queries import ALL_SQL

    joined = " ".join(f"JOIN {f.name} USING (event_id)" for f in FAMILIES)
    return f"{ALL_SQL} SELECT cur.* EXCLUDE (occurred_at_ms), " + ", ".join(f"{f.name}.* EXCLUDE (event_id)" for f in FAMILIES) + f", split, is_attack, campaign_id FROM cur {joined} JOIN (SELECT event_id, split, is_attack, campaign_id FROM labels_v) l USING (event_id)"


@query("J1_join_labels", full_width_sql())
def join_labels(spark, sf):
    labels = T.labels(spark, sf).select("event_id", "split", "is_attack", "campaign_id")
    with passing_tables() as keep:  # written before they are dealt again, so that the disk holds the shuffles of one step at a time
        vectors = keep(materialise(E.feature_vector(T.attempts(spark, sf)).drop("occurred_at_ms"), "vectors"))
    return J.join_labels(vectors, labels)


HALVES = """l AS (SELECT event_id FROM attempts WHERE channel <> 'web' UNION ALL SELECT event_id FROM attempts WHERE outcome = 'failed' AND channel <> 'web'),
r AS (SELECT event_id FROM attempts WHERE channel <> 'mobile_app')"""


@query(
    "J2_join_anomalies",
    f"""WITH {HALVES}, c AS (SELECT * FROM (SELECT event_id, count(*) AS nl FROM l GROUP BY 1) a
  FULL JOIN (SELECT event_id, count(*) AS nr FROM r GROUP BY 1) b USING (event_id))
SELECT event_id, 'missing_left' AS problem FROM c WHERE nl IS NULL
UNION ALL SELECT event_id, 'missing_right' FROM c WHERE nr IS NULL
UNION ALL SELECT event_id, 'duplicate_left' FROM c WHERE nl > 1
UNION ALL SELECT event_id, 'duplicate_right' FROM c WHERE nr > 1
UNION ALL SELECT event_id, 'order_left' FROM (SELECT *, lag(occurred_at_ms) OVER w AS pt, lag(event_id) OVER w AS pe FROM (
    SELECT event_id, occurred_at_ms, 2 * event_no AS place FROM attempts WHERE channel <> 'web'
    UNION ALL SELECT event_id, occurred_at_ms, 2 * event_no + 1 FROM attempts WHERE outcome = 'failed' AND channel <> 'web') x WINDOW w AS (ORDER BY place)) o
  WHERE occurred_at_ms < pt OR (occurred_at_ms = pt AND event_id <= pe)
UNION ALL SELECT event_id, 'order_right' FROM (SELECT *, lag(occurred_at_ms) OVER w AS pt, lag(event_id) OVER w AS pe FROM attempts
    WHERE channel <> 'mobile_app' WINDOW w AS (ORDER BY xor(event_no, 1))) o
  WHERE occurred_at_ms < pt OR (occurred_at_ms = pt AND event_id <= pe)""",
)
def join_anomalies(spark, sf):
    """Two joined sources: rows missing on a side, repeated, or not ascending by (time, id) as they stand in it."""
    a = T.attempts(spark, sf)
    some = a.filter("channel <> 'web'")
    left = some.select("event_id", "occurred_at_ms", (2 * F.col("event_no")).alias("place")).union(
        some.filter("outcome = 'failed'").select("event_id", "occurred_at_ms", 2 * F.col("event_no") + 1)
    )
    right = a.filter("channel <> 'mobile_app'").select("event_id", "occurred_at_ms", F.col("event_no").bitwiseXOR(F.lit(1)).alias("place"))
    return J.join_anomalies(left, right, "place")


@query("J3_lookup_labels", "SELECT a.event_id, amount_subunits, is_attack, scenario_type FROM attempts a JOIN labels_v USING (event_id)")
def lookup_labels(spark, sf):
    return J.lookup_labels(
        T.attempts(spark, sf).select("event_id", "amount_subunits"), T.labels(spark, sf), "is_attack", "scenario_type"
    )


@query(
    "J8_compare_features",
    """SELECT event_id, CASE WHEN channel = 'web' AND outcome = 'failed' THEN 'missing' ELSE 'different' END AS problem
FROM attempts WHERE (channel = 'web' AND outcome = 'failed') OR (NOT (channel = 'web' AND outcome = 'failed') AND amount_subunits % 10 = 3)""",
)
def compare_features(spark, sf):
    with passing_tables() as keep:
        expected = keep(materialise(E.feature_vector(T.attempts(spark, sf)), "expected-features"))
    present = T.attempts(spark, sf).filter("not (channel = 'web' and outcome = 'failed')").select("event_id")
    actual = expected.join(present, "event_id", "left_semi").withColumn(
        "utc_hour", F.expr("if(amount_subunits % 10 = 3, utc_hour + 1, utc_hour)")
    )
    return J.compare_rows(actual, expected, list(E.FEATURE_NAMES))


@query(
    "J9_assert_disjoint",
    "SELECT device_token FROM labelled WHERE split = 'train' AND device_token IS NOT NULL"
    " INTERSECT SELECT device_token FROM labelled WHERE split = 'test' AND is_attack",
)
def disjoint(spark, sf):
    a = T.labelled_attempts(spark, sf)
    return J.overlap(
        a.filter("split = 'train' and device_token is not null"), a.filter("split = 'test' and is_attack"), "device_token"
    )


@query("X1_candidate_union", "SELECT DISTINCT p FROM scored UNION SELECT 0.0 UNION SELECT 1.0 UNION SELECT 0.615")
def candidate_union(spark, sf):
    return P.sweep_candidates(T.scored(spark, sf), 1 << 40, (0.615,))


@query(
    "X2_attack_only_values",
    " UNION ALL ".join(
        f"SELECT '{n}' AS field, v FROM (SELECT DISTINCT CAST({e} AS VARCHAR) AS v FROM labelled WHERE is_attack"
        f" EXCEPT SELECT CAST({e} AS VARCHAR) FROM labelled WHERE NOT is_attack) x"
        for n, e in (("amount_subunits", "amount_subunits"), ("outcome", "outcome"), ("failure_category", "failure_category"),
                     ("channel", "channel"), ("customer_missing", "customer_token IS NULL"),
                     ("device_missing", "device_token IS NULL"), ("network_missing", "network_token IS NULL"))
    ),
)
def attack_only_values(spark, sf):
    from cardweir.operators.quality import attack_only_values

    return attack_only_values(T.labelled_attempts(spark, sf))


@query("X3_identity_overlap", "SELECT session_token FROM labelled WHERE split = 'train' INTERSECT SELECT session_token FROM labelled WHERE split = 'test'")
def identity_overlap(spark, sf):
    a = T.labelled_attempts(spark, sf)
    return J.overlap(a.filter("split = 'train'"), a.filter("split = 'test'"), "session_token")


@query(
    "W4_strict_monotonic_time",
    """SELECT event_id, max(now - i) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) + i AS assigned_at_ms
FROM (SELECT event_id, occurred_at_ms // 4000 AS now, row_number() OVER (ORDER BY occurred_at_ms, event_id) AS i FROM attempts) a""",
)
def strict_times(spark, sf):
    a = T.attempts(spark, sf).select("event_id", "occurred_at_ms", F.expr("occurred_at_ms div 4000").alias("now"))
    return O.strict_times(a, "now", F.col("occurred_at_ms"), F.col("event_id")).select("event_id", "assigned_at_ms")


@query(
    "W5_systematic_sample",
    """WITH o AS (SELECT event_id, row_number() OVER (ORDER BY occurred_at_ms, event_id) - 1 AS i, count(*) OVER () AS n FROM attempts)
SELECT event_id FROM o WHERE i IN (SELECT (j * (SELECT max(n) - 1 FROM o)) // 127 FROM (SELECT unnest(range(128)) AS j) g)""",
)
def systematic_sample(spark, sf):
    a = T.attempts(spark, sf).select("event_id", "occurred_at_ms")
    return O.systematic_sample(a, 128, F.col("occurred_at_ms"), F.col("event_id")).select("event_id")


@query(
    "W7_chronological_sort",
    "SELECT event_id, row_number() OVER (ORDER BY occurred_at_ms, event_id) AS position FROM attempts",
)
def chronological_sort(spark, sf):
    a = T.attempts(spark, sf).select("event_id", "occurred_at_ms")
    numbered = O.row_numbers(a, F.col("occurred_at_ms"), F.col("event_id"), name="position")
    return O.chronological(numbered).select("event_id", "position")


@query(
    "W8_retry_and_campaign_gaps",
    """SELECT scenario_instance_id AS chain, event_id, occurred_at_ms - lag(occurred_at_ms) OVER (PARTITION BY scenario_instance_id
  ORDER BY occurred_at_ms, event_id) AS gap_ms FROM labelled WHERE scenario_type = 'legitimate_retry'
UNION ALL SELECT campaign_id, split, first - lag(last) OVER (PARTITION BY split ORDER BY first, last) FROM
  (SELECT split, campaign_id, min(occurred_at_ms) AS first, max(occurred_at_ms) AS last FROM labelled WHERE is_attack GROUP BY 1, 2) e""",
)
def gaps(spark, sf):
    from cardweir.operators.quality import campaign_envelopes, campaign_gaps, retry_gaps

    a = T.labelled_attempts(spark, sf)
    return retry_gaps(a).select(F.col("scenario_instance_id").alias("chain"), "event_id", "gap_ms").union(
        campaign_gaps(campaign_envelopes(a)).select("campaign_id", "split", "gap_ms")
    )


@query(
    "W9_order_check",
    """SELECT event_id FROM (SELECT *, lag(occurred_at_ms) OVER w AS pt, lag(event_id) OVER w AS pe FROM attempts
  WINDOW w AS (ORDER BY xor(event_no, 1))) a WHERE occurred_at_ms < pt OR (occurred_at_ms = pt AND event_id <= pe)""",
)
def order_check(spark, sf):
    arrived = T.attempts(spark, sf).withColumn("arrival", F.col("event_no").bitwiseXOR(F.lit(1)))
    return O.order_violations(arrived, "arrival")


@query("S8_limit_events", "SELECT event_id, occurred_at_ms FROM attempts ORDER BY occurred_at_ms, event_id LIMIT 100")
def limit_events(spark, sf):
    return O.first_events(T.attempts(spark, sf), 100).select("event_id", "occurred_at_ms")
