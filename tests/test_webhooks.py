import hashlib
import hmac
import json

from cardweir.operators import webhooks as H
from cardweir.sources.landing import LANDING_SCHEMA

KEY = b"6-key-with-a-six-and-\\-and-more-than-sixty-four-bytes-in-total-so-it-is-hashed"


def body(**changes):
    entity = {
        "id": "pay_1", "entity": "payment", "amount": 500, "currency": "INR", "status": "failed", "order_id": None,
        "method": "card", "created_at": 1_700_000_000, "error_code": "BAD", "email": "a@b.example",
        "card": {"number": "4111"}, "unknown": 1, **changes.pop("payment", {}),
    }
    top = {"entity": "event", "event": "payment.failed", "created_at": 1_700_000_001, "secret": "x",
           "payload": {"payment": {"entity": entity}}, **changes}
    return json.dumps({k: v for k, v in top.items() if v is not ...})


def sign(text):
    return hmac.new(KEY, text.encode(), hashlib.sha256).hexdigest()


def call(n, text, **over):
    row = {"provider_event_id": f"wh_{n}", "content_type": "application/json; charset=utf-8", "signature": sign(text), **over}
    return (n, row["provider_event_id"], row["content_type"], text, n, row["signature"])


def test_screening_order_and_reasons(spark):
    good = body()
    rows = [
        call(1, good), call(2, good, content_type="text/plain", signature=None), call(3, good, signature=None),
        call(4, good, signature="0" * 64), call(5, good, provider_event_id=None), call(6, body(entity="thing")),
        call(7, body(payment={"amount": -1})), call(8, body(payment={"amount": "500"})), call(9, "not json"),
        call(10, body(event="refund.created", payment={"amount": "x"})), call(11, good, signature=sign(good).upper()),
        call(12, body(contains=["x"] * 21)), call(13, body(account_id="bad id")), call(14, good + " " * 270_000),
        call(18, good + " " * 100_000), call(19, body(payment={"amount": "5x"})), call(20, body(created_at="1700000001.0", payment={"amount": 500.0})),
        call(21, body(payment={"amount": 500.5})), call(15, body(payload=[1])), call(16, body(created_at=True)), call(17, body(payment={"error_code": ""})),
    ]
    got = {r.call_no: r.reject_reason for r in H.screen(spark.createDataFrame(rows, LANDING_SCHEMA), KEY).collect()}
    assert got == {
        1: None, 2: "unsupported_content_type", 3: "missing_signature", 4: "invalid_signature", 5: "invalid_event_id",
        6: "invalid_webhook_envelope", 7: "invalid_payment_payload", 8: None,
        9: "invalid_webhook_envelope", 10: None, 11: None, 12: "invalid_webhook_envelope", 13: "invalid_webhook_envelope",
        14: "request_too_large", 15: "invalid_webhook_envelope", 16: "invalid_webhook_envelope", 17: None,
        18: None, 19: "invalid_payment_payload", 20: None, 21: "invalid_payment_payload",
    }


def test_sanitised_copy(spark):
    text = body(payment={"amount": "5", "error_code": ""}, contains=["payment"], account_id="acc_1")
    df = H.parsed_once(spark.createDataFrame([(text,), (body(contains=[]),)], "body string"), "body")
    first, second = (json.loads(r.s) for r in df.select(H.sanitised_payload().alias("s")).collect())
    entity = first["payload"]["payment"]["entity"]
    assert entity["amount"] == "[REDACTED]" and entity["email"] == entity["card"] == "[REDACTED]"
    assert entity["error_code"] == "[REDACTED]" and entity["order_id"] is None and entity["id"] == "pay_1"
    assert "unknown" not in entity and "secret" not in first and first["contains"] == ["payment"]
    assert second["account_id"] == "[REDACTED]" and second["contains"] == []


def test_first_delivery_wins(spark):
    a, b = body(), body(payment={"amount": 700})
    rows = [call(2, b, provider_event_id="w"), call(1, a, provider_event_id="w"), call(3, a, provider_event_id="v")]
    d = H.first_deliveries(H.screen(spark.createDataFrame(rows, LANDING_SCHEMA), KEY))
    facts = {r.webhook_event_id: r.amount for r in H.observations(d).collect()}
    assert facts == {"w": 500, "v": 500}
    audit = {r.provider_event_id: r for r in H.audit_rows(d).collect()}
    assert audit["w"].raw_body_sha256 == hashlib.sha256(a.encode()).hexdigest() and audit["w"].processing_result == "processed"


def test_members_of_a_payment_are_read_in_one_pass():
    """Each look at a path searches all members of the objects on its way."""
    assert H.payment_valid().count("try_variant_get(v") == 1
    assert H._members(H.PAYMENT_ALLOWLIST, H.PAYMENT_REDACTIONS, "$.payload.payment.entity").count("try_variant_get(v") == 1


def test_payloads_without_the_objects_they_should_hold(spark):
    texts = [body(payload=[1]), body(payload={"payment": {"entity": None}}), body(payload={"payment": {"entity": {}}}), body(payload=...), "[]", "{}"]
    df = H.parsed_once(spark.createDataFrame([(t,) for t in texts], "body string"), "body")
    got = [json.loads(r.s) for r in df.select(H.sanitised_payload().alias("s")).collect()]
    assert ["payload" in g for g in got] == [False, False, True, False, False, False]
    assert got[2]["payload"] == {"payment": {"entity": {}}}
    assert got[4] == got[5] == {"account_id": "[REDACTED]", "contains": []}
    valid = [r.ok for r in df.selectExpr(f"{H.payment_valid()} as ok").collect()]
    assert valid == [False] * 6
