"""Webhook screening, sanitising and observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardweir.operators import webhooks as H
from cardweir.plans.registry import query
from cardweir.sources import tables as T

NAMED = "webhooks w JOIN webhook_calls c ON c.n = w.call_no"
BAD_PAYMENT = "(name <> 'refund.created' AND (n % 47 = 0 AND cents > 0 OR n % 59 = 0 OR (name = 'payment.failed' AND n % 2 = 0)))"
REASON = f"""CASE WHEN n % 31 = 0 THEN 'unsupported_content_type' WHEN n % 41 = 0 THEN 'missing_signature'
  WHEN n % 37 = 0 THEN 'invalid_signature' WHEN n % 61 = 0 THEN 'invalid_event_id' WHEN n % 43 = 0 THEN 'invalid_webhook_envelope'
  WHEN {BAD_PAYMENT} THEN 'invalid_payment_payload' END"""
SCREENED = f"""sc AS (SELECT w.*, c.*, {REASON} AS reject_reason FROM {NAMED}),
dl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider_event_id ORDER BY received_at_ms, call_no) AS rn FROM sc WHERE reject_reason IS NULL) x WHERE rn = 1)"""
AMOUNT = "CAST(CASE WHEN n % 47 = 0 THEN -cents ELSE cents END AS BIGINT)"
ORDER = "CASE WHEN n % 5 <> 0 THEN 'ord_' || n END"
ERROR = "CASE WHEN name = 'payment.failed' AND n % 2 = 0 THEN 'BAD REQUEST' WHEN n % 3 = 0 THEN 'GATEWAY_ERROR' END"
UTC = "strftime(to_timestamp({s}) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')"


def _screened(spark, sf):
    return H.screen(T.webhooks(spark, sf), T.WEBHOOK_KEY)


def _deliveries(spark, sf):
    return H.first_deliveries(_screened(spark, sf))


def _times(df):
    names = [c for c, t in df.dtypes if t.startswith("timestamp")]
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in names})


@query("K1_screen_requests", f"SELECT call_no, {REASON} AS reject_reason FROM {NAMED}")
def screen(spark, sf):
    return _screened(spark, sf).select("call_no", "reject_reason")


@query("K2_verify_signature", "SELECT call_no, call_no % 41 <> 0 AND call_no % 37 <> 0 AS ok FROM webhooks")
def verify(spark, sf):
    return T.webhooks(spark, sf).select("call_no", H.signature_valid(T.WEBHOOK_KEY).alias("ok"))


@query("K3_parse_envelope", "SELECT n AS call_no, n % 43 <> 0 AS valid, name AS event_name, seconds AS created_at FROM webhook_calls")
def envelope(spark, sf):
    calls = H.parsed_once(T.webhooks(spark, sf), "body")
    return calls.select(
        "call_no", F.expr(H.envelope_valid()).alias("valid"),
        F.expr("try_variant_get(v, '$.event', 'string')").alias("event_name"),
        F.expr("try_variant_get(v, '$.created_at', 'bigint')").alias("created_at"),
    )


@query(
    "K4_parse_payment",
    f"""SELECT n AS call_no, NOT (n % 47 = 0 AND cents > 0 OR n % 59 = 0 OR (name = 'payment.failed' AND n % 2 = 0)) AS valid,
  'pay_' || n AS id, {AMOUNT} AS amount FROM webhook_calls""",
)
def payment(spark, sf):
    calls = H.parsed_once(T.webhooks(spark, sf), "body")
    p = "$.payload.payment.entity"
    return calls.select(
        "call_no", F.expr(H.payment_valid()).alias("valid"),
        F.expr(f"try_variant_get(v, '{p}.id', 'string')").alias("id"),
        F.expr(f"try_variant_get(v, '{p}.amount', 'bigint')").alias("amount"),
    )


SANITISED = """'{"entity":' || CASE WHEN n % 43 = 0 THEN '"[REDACTED]"' ELSE '"event"' END || ',"event":"' || name || '","created_at":' || seconds
  || ',"account_id":"acc_' || o_custkey || '","contains":["payment"],"payload":{"payment":{"entity":{"id":"pay_' || n || '","entity":"payment","amount":'
  || CASE WHEN n % 47 = 0 AND cents > 0 THEN '"[REDACTED]"' ELSE CAST(cents AS VARCHAR) END || ',"amount_refunded":0,"currency":"'
  || CASE WHEN n % 59 = 0 THEN '[REDACTED]' ELSE 'INR' END || '","status":"' || split_part(name, '.', 2) || '","order_id":'
  || CASE WHEN n % 5 = 0 THEN 'null' ELSE '"ord_' || n || '"' END || ',"method":"card","captured":'
  || CASE WHEN name = 'payment.captured' THEN 'true' ELSE 'false' END || ',"created_at":' || (seconds - 60) || ',"error_code":'
  || CASE WHEN name = 'payment.failed' AND n % 2 = 0 THEN '"[REDACTED]"' WHEN n % 3 = 0 THEN '"GATEWAY_ERROR"' ELSE 'null' END
  || ',"card":"[REDACTED]","email":"[REDACTED]"}}}}'"""


@query("K5_sanitise_payload", f"SELECT n AS call_no, {SANITISED} AS sanitized_payload FROM webhook_calls")
def sanitise(spark, sf):
    calls = H.parsed_once(T.webhooks(spark, sf), "body")
    return calls.select("call_no", H.sanitised_payload().alias("sanitized_payload"))


@query("K6_dedupe_webhooks", f"WITH {SCREENED} SELECT provider_event_id, call_no FROM dl")
def dedupe(spark, sf):
    return _deliveries(spark, sf).select("provider_event_id", "call_no")


@query(
    "K7_observations",
    f"""WITH {SCREENED} SELECT provider_event_id AS webhook_event_id, 'pay_' || n AS provider_payment_id, {ORDER} AS provider_order_id,
  name AS event_name, split_part(name, '.', 2) AS payment_status, {AMOUNT} AS amount, 'INR' AS currency, 'card' AS payment_method,
  {ERROR} AS error_code, NULL AS error_source, NULL AS error_step, NULL AS error_reason,
  {UTC.format(s='seconds')} AS provider_event_created_at, {UTC.format(s='seconds - 60')} AS provider_payment_created_at
FROM dl WHERE name <> 'refund.created'""",
)
def observations(spark, sf):
    return _times(H.observations(_deliveries(spark, sf)))


@query("K8_body_digest", "SELECT call_no, sha256(body) AS digest FROM webhook_bodies")
def digest(spark, sf):
    return T.webhooks(spark, sf).select("call_no", F.sha2("body", 256).alias("digest"))


@query("S11_webhook_landing", "SELECT call_no, provider_event_id, content_type, received_at_ms, strlen(body) AS n_bytes FROM webhooks WHERE strlen(body) <= 560")
def landing(spark, sf):
    from cardweir.sources.landing import within_size

    return within_size(T.webhooks(spark, sf), 560).select(
        "call_no", "provider_event_id", "content_type", "received_at_ms", F.octet_length("body").alias("n_bytes")
    )


@query(
    "J10_observation_of",
    f"WITH {SCREENED} SELECT provider_event_id, name AS event_name, 'processed' AS processing_result, 'pay_' || n AS provider_payment_id FROM dl WHERE name <> 'refund.created'",
)
def observation_of(spark, sf):
    d = _deliveries(spark, sf)
    facts = H.observations(d).select("webhook_event_id", "provider_payment_id")
    return H.observation_of(H.audit_rows(d), facts).select(
        "provider_event_id", "event_name", "processing_result", "provider_payment_id"
    )
