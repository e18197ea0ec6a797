"""The derived views of ``sources.tables`` as SQL, in dependency order."""

from __future__ import annotations

from cardweir.sources.tables import (
    CALIBRATION_END_MS,
    DENY_THRESHOLD,
    PART_EDGES_MS,
    START_MS,
    TRAIN_END_MS,
    WEBHOOK_KEY,
)


def tok(prefix: str, number: str) -> str:
    return f"printf('{prefix}_%032x', {number})"


def _pad(byte: int) -> str:
    return "".join(f"\\x{b ^ byte:02X}" for b in WEBHOOK_KEY.ljust(64, b"\0"))


VIEWS: dict[str, str] = {}

VIEWS["ev"] = f"""
SELECT event_id, user_id, event_type, value,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
  {START_MS} + 1000 * ((epoch_us(ts) - 1704067200000000) // 60000000) AS ms
FROM events"""

VIEWS["attempts"] = f"""
SELECT {tok('evt', 'event_id')} AS event_id, event_id AS event_no, ms AS occurred_at_ms,
  {tok('mrc', 'user_id % 12')} AS merchant_id,
  {tok('chk', 'event_id // 3')} AS checkout_id,
  CASE WHEN event_id % 20 <> 0 THEN {tok('cus', 'user_id')} END AS customer_token,
  CASE WHEN event_id % 33 <> 0 THEN {tok('dev', 'k % 40')} END AS device_token,
  CASE WHEN event_id % 50 <> 0 THEN {tok('net', 'user_id % 25')} END AS network_token,
  {tok('ses', 'user_id * 4 + k % 4')} AS session_token,
  {tok('pmt', '(event_id * 7) % 500')} AS payment_instrument_token,
  CAST(floor(value * 100 + 0.5) AS BIGINT) + 1 AS amount_subunits,
  'INR' AS currency,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'authorized' END AS outcome,
  CASE WHEN event_type = 'error' THEN CASE k % 5 WHEN 0 THEN 'authentication'
    WHEN 1 THEN 'insufficient_funds' WHEN 2 THEN 'instrument_declined'
    WHEN 3 THEN 'temporary_processing' ELSE 'unknown' END END AS failure_category,
  CASE event_id % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'mobile_web' ELSE 'mobile_app' END AS channel
FROM ev"""

# The event set as the decision stream gets it: in parts, some events with a later part than their time says, and each
# request stamped with its own time or one millisecond more than the request before it, whichever is later.
VIEWS["delivered"] = f"""
SELECT *, part + CASE WHEN part < 3 AND event_no % 13 = 4 THEN 1 ELSE 0 END AS batch
FROM (SELECT *, {' + '.join(f'CAST(occurred_at_ms >= {edge} AS INTEGER)' for edge in PART_EDGES_MS)} AS part FROM attempts) a"""

VIEWS["stamped"] = """
SELECT *, max(received_at_ms - place) OVER (ORDER BY place) + place AS stamp
FROM (SELECT *, occurred_at_ms AS received_at_ms, row_number() OVER (ORDER BY batch, occurred_at_ms, event_id) AS place FROM delivered) d"""

VIEWS["live"] = """
SELECT * REPLACE (stamp AS occurred_at_ms, 'authorized' AS outcome, NULL AS failure_category) FROM stamped"""

VIEWS["labels_v"] = f"""
SELECT {tok('evt', 'event_id')} AS event_id, ms AS occurred_at_ms,
  CASE WHEN ms < {TRAIN_END_MS} THEN 'train' WHEN ms < {CALIBRATION_END_MS} THEN 'calibration'
    ELSE 'test' END AS split,
  (event_type = 'error' AND k >= 60) AS is_attack,
  CASE WHEN event_type = 'error' AND k >= 60 THEN {tok('cmp', 'k % 10')} END AS campaign_id,
  CASE WHEN event_type = 'error' AND k >= 60 THEN 'card_testing_campaign'
    WHEN event_type = 'click' THEN 'normal' WHEN event_type = 'view' THEN 'flash_sale'
    WHEN event_type = 'purchase' THEN 'legitimate_retry'
    WHEN event_type = 'signup' THEN 'shared_infrastructure'
    WHEN event_type = 'error' THEN 'legitimate_failure' END AS scenario_type,
  CASE WHEN event_type = 'error' AND k >= 60 THEN {tok('scn', '1000000 + k % 10')}
    WHEN event_type = 'purchase' THEN {tok('scn', 'event_id // 4')} END AS scenario_instance_id,
  CASE WHEN event_type = 'error' AND k >= 60 THEN
    CASE WHEN ms >= {CALIBRATION_END_MS} THEN 'entity_reuse_shift' ELSE 'baseline_reuse' END
    END AS campaign_profile
FROM ev"""

VIEWS["labelled"] = """
SELECT a.*, l.split, l.is_attack, l.campaign_id, l.scenario_type, l.scenario_instance_id,
  l.campaign_profile
FROM attempts a JOIN labels_v l USING (event_id)"""

VIEWS["scored"] = f"""
SELECT {tok('evt', 'e.event_id')} AS event_id, l.occurred_at_ms,
  CASE WHEN e.event_type = 'error' AND e.k >= 60 THEN 1 ELSE 0 END AS y,
  least(100.0::DOUBLE, floor(100 * e.value / (e.value + 50))
    + 30 * CASE WHEN e.event_type = 'error' AND e.k >= 60 THEN 1 ELSE 0 END) / 100.0::DOUBLE AS p,
  l.split, l.scenario_type, l.campaign_id
FROM ev e JOIN labels_v l ON l.event_id = {tok('evt', 'e.event_id')}"""

VIEWS["ledger"] = f"""
SELECT {tok('dec', 'a.event_no')} AS id, a.event_id, a.event_no, a.merchant_id, a.checkout_id,
  a.session_token, a.payment_instrument_token, a.customer_token, a.device_token, a.network_token,
  a.amount_subunits, a.currency, a.channel,
  CASE WHEN a.event_no % 71 <> 0 AND a.event_no % 97 <> 0 THEN a.occurred_at_ms END
    AS occurred_at_ms,
  a.occurred_at_ms + 1000 AS created_at_ms,
  CASE WHEN a.event_no % 71 <> 0 AND a.event_no % 89 <> 0
    THEN CAST(CAST(s.p AS VARCHAR) AS DECIMAL(20,18)) END AS calibrated_probability,
  CAST('{DENY_THRESHOLD}' AS DECIMAL(20,18)) AS decision_threshold,
  CASE WHEN a.event_no % 71 <> 0 AND a.event_no % 89 <> 0
    THEN CASE WHEN s.p >= {DENY_THRESHOLD}::DOUBLE THEN 'deny' ELSE 'allow' END END
    AS risk_decision,
  CASE WHEN a.event_no % 71 = 0 THEN NULL WHEN a.event_no % 89 = 0 THEN 'review'
    WHEN s.p >= {DENY_THRESHOLD}::DOUBLE THEN 'deny' WHEN a.event_no % 53 = 0 THEN 'review'
    ELSE 'allow' END AS action,
  CASE WHEN a.event_no % 71 = 0 THEN NULL
    WHEN a.event_no % 89 = 0 THEN 'feature_computation_failed'
    WHEN s.p < {DENY_THRESHOLD}::DOUBLE AND a.event_no % 53 = 0 THEN 'order_creation_failed'
    END AS fail_safe_reason,
  CASE WHEN a.event_no % 71 <> 0 AND a.event_no % 89 <> 0 AND s.p < {DENY_THRESHOLD}::DOUBLE
    AND a.event_no % 53 <> 0 THEN {tok('order', 'a.event_no')} END AS provider_order_id,
  CASE WHEN a.event_no % 2 = 0 THEN 'model_a' ELSE 'model_b' END AS model_id,
  '1.0.0' AS feature_schema_version, '1.0.0' AS feature_engine_version,
  CASE WHEN a.event_no % 71 = 0 THEN 'pending' ELSE 'final' END AS status
FROM attempts a JOIN scored s USING (event_id)"""

VIEWS["reviews"] = f"""
SELECT {tok('rev', 'event_no')} AS review_id, id AS risk_decision_id, fail_safe_reason AS reason,
  'pending' AS status, created_at_ms
FROM ledger WHERE action = 'review'"""

VIEWS["explanations"] = """
SELECT l.id AS risk_decision_id, l.event_no, g.n AS attempt_number,
  CASE (l.event_no + g.n) % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'ready'
    ELSE 'rejected' END AS status,
  l.created_at_ms + 1000 * g.n AS created_at_ms,
  CASE WHEN (l.event_no + g.n) % 4 = 2 THEN 'summary ' || CAST(l.event_no AS VARCHAR) END
    AS summary,
  CASE WHEN (l.event_no + g.n) % 4 IN (0, 3) THEN 'provider_error' END AS failure_reason
FROM ledger l JOIN (SELECT unnest([1, 2, 3]) AS n) g ON g.n <= l.event_no % 4
WHERE l.risk_decision = 'deny'"""

VIEWS["reference_bins"] = """
SELECT i.n AS bin, i.n / 10.0::DOUBLE AS lower_inclusive,
  (i.n + 1) / 10.0::DOUBLE AS upper_value, i.n = 9 AS upper_inclusive,
  count(s.event_id) AS bin_count
FROM (SELECT unnest(range(10)) AS n) i
LEFT JOIN (SELECT * FROM scored WHERE split = 'train') s
  ON least(floor(s.p * 10), 9) = i.n
GROUP BY i.n"""

VIEWS["webhook_calls"] = """
SELECT o_orderkey AS n, o_custkey, CAST(floor(CAST(o_totalprice AS DOUBLE) * 100 + 0.5) AS BIGINT) AS cents,
  CASE WHEN o_orderstatus = 'F' THEN 'payment.failed'
    WHEN o_orderstatus = 'O' THEN 'payment.authorized'
    WHEN o_orderkey % 2 = 0 THEN 'payment.captured' ELSE 'refund.created' END AS name,
  1700000000 + o_orderkey * 7 AS seconds
FROM orders"""

VIEWS["webhook_bodies"] = f"""
SELECT n AS call_no,
  CASE WHEN n % 61 <> 0 THEN 'wh_' || CAST(n % 1400 AS VARCHAR) END AS provider_event_id,
  CASE WHEN n % 31 = 0 THEN 'text/plain' ELSE 'Application/JSON; charset=utf-8' END
    AS content_type,
  '{{"entity":"' || CASE WHEN n % 43 = 0 THEN 'thing' ELSE 'event' END
  || '","event":"' || name || '","account_id":"acc_' || CAST(o_custkey AS VARCHAR)
  || '","contains":["payment"],"created_at":' || CAST(seconds AS VARCHAR)
  || ',"extra":"dropped","payload":{{"payment":{{"entity":{{"id":"pay_' || CAST(n AS VARCHAR)
  || '","entity":"payment","amount":'
  || CAST(CASE WHEN n % 47 = 0 THEN -cents ELSE cents END AS VARCHAR)
  || ',"amount_refunded":0,"currency":"' || CASE WHEN n % 59 = 0 THEN 'inr' ELSE 'INR' END
  || '","status":"' || split_part(name, '.', 2) || '","order_id":'
  || CASE WHEN n % 5 = 0 THEN 'null' ELSE '"ord_' || CAST(n AS VARCHAR) || '"' END
  || ',"method":"card","captured":'
  || CASE WHEN name = 'payment.captured' THEN 'true' ELSE 'false' END
  || ',"email":"a@b.example","card":{{"last4":"1111"}},"error_code":'
  || CASE WHEN name = 'payment.failed' AND n % 2 = 0 THEN '"BAD REQUEST"'
     WHEN n % 3 = 0 THEN '"GATEWAY_ERROR"' ELSE 'null' END
  || ',"created_at":' || CAST(seconds - 60 AS VARCHAR) || '}}}}}}}}' AS body,
  {START_MS} + n AS received_at_ms
FROM webhook_calls"""

VIEWS["webhooks"] = f"""
SELECT b.*, CASE WHEN call_no % 41 = 0 THEN NULL WHEN call_no % 37 = 0 THEN repeat('0', 64)
    WHEN call_no % 29 = 0 THEN upper(mac) ELSE mac END AS signature
FROM (SELECT *, sha256('{_pad(0x5C)}'::BLOB
    || unhex(sha256('{_pad(0x36)}'::BLOB || encode(body)))) AS mac
  FROM webhook_bodies) b"""
