"""Integer, ratio, time and probability rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS = 3_600_000


def _c(value) -> Column:
    return value if isinstance(value, Column) else F.col(value) if isinstance(value, str) else F.lit(value)


def int_div(numerator, denominator) -> Column:
    """Truncating integer division (``div``); operands here are never negative."""
    return F.call_function("div", _c(numerator).cast("long"), _c(denominator).cast("long"))


def int_ratio_or_null(numerator, denominator) -> Column:
    d = _c(denominator)
    return F.when(d != 0, int_div(numerator, d))


def bp_floor(numerator, denominator) -> Column:
    """Basis points rounded down; 0 when there is nothing to divide by."""
    d = _c(denominator)
    return F.when(d == 0, F.lit(0).cast("long")).otherwise(int_div(_c(numerator) * 10_000, d))


def bp_half_up(numerator, denominator) -> Column:
    """Basis points rounded half up; null when there is nothing to divide by."""
    n, d = _c(numerator), _c(denominator)
    return F.when(d != 0, int_div(n * 20_000 + d, d * 2))


def fixed_decimal_ratio(numerator, denominator, places: int = 6) -> Column:
    """Ratio as decimal text with exactly ``places`` digits, rounded half up in integers."""
    n, d = _c(numerator).cast("long"), _c(denominator).cast("long")
    scale = 10**places
    scaled = int_div(n * scale + int_div(d, F.lit(2)), d)
    text = F.concat(
        int_div(scaled, F.lit(scale)).cast("string"),
        F.lit("."),
        F.lpad((scaled % scale).cast("string"), places, "0"),
    )
    return F.when(d <= 0, F.lit("0." + "0" * places)).otherwise(text)


def rate(numerator, denominator) -> Column:
    """One floating division; null on a zero denominator."""
    d = _c(denominator).cast("double")
    return F.when(d != 0, _c(numerator).cast("double") / d)


def elapsed_ms(later, earlier) -> Column:
    return _c(later).cast("long") - _c(earlier).cast("long")


def to_millis(ts) -> Column:
    return F.unix_millis(_c(ts))


def boundary_ms(start_ms, end_ms, basis_points: int) -> Column:
    """Point ``basis_points`` of the way from start to end, rounded down to the millisecond."""
    if not 1 <= basis_points <= 9_999:
        raise ValueError("basis points must lie strictly between 0 and 10000")
    s, e = _c(start_ms), _c(end_ms)
    return s + int_div((e - s) * basis_points, F.lit(10_000))


def anchor_time(occurred_at="occurred_at_ms", created_at="created_at_ms") -> Column:
    """The time a ledger row is filed under: when it happened, else when it was written."""
    return F.coalesce(_c(occurred_at), _c(created_at))


def clamp(value, low, high) -> Column:
    return F.greatest(F.least(_c(value), _c(high)), _c(low))


def clip_probability(p, epsilon: float = 1e-15) -> Column:
    return clamp(p, F.lit(epsilon), F.lit(1.0 - epsilon))


def sigmoid_stable(z) -> Column:
    """Logistic function that never exponentiates a positive number."""
    x = _c(z).cast("double")
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, F.lit(1.0) / (F.lit(1.0) + e)).otherwise(e / (F.lit(1.0) + e))


def audit_decimal(p) -> Column:
    """``decimal(20,18)`` copy of a double, HALF_EVEN on its shortest decimal text."""
    return F.bround(_c(p).cast("string").cast("decimal(38,30)"), 18).cast("decimal(20,18)")


def plain_decimal_text(value) -> Column:
    """Exact decimal text without an exponent."""
    return _c(value).cast("string")


def from_epoch_seconds(n) -> Column:
    return F.timestamp_seconds(_c(n))


def millis_to_timestamp(ms) -> Column:
    return F.timestamp_millis(_c(ms))


def iso_millis(ms) -> Column:
    """``2026-01-01T00:00:00.000Z`` from epoch milliseconds (session time zone UTC)."""
    return F.date_format(F.timestamp_millis(_c(ms)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def canonical_json(*columns: str) -> Column:
    """Compact JSON of the named columns with keys in name order and nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def sha256_hex(value) -> Column:
    return F.sha2(_c(value).cast("binary"), 256)


def hmac_sha256(body, key: bytes) -> Column:
    """HMAC-SHA256 over the exact bytes of ``body``; the two padded keys are driver constants."""
    import hashlib

    block = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = block.ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in block))
    outer = F.lit(bytearray(b ^ 0x5C for b in block))
    first = F.sha2(F.concat(inner, _c(body).cast("binary")), 256)
    return F.sha2(F.concat(outer, F.unhex(first)), 256)


def allowlist_or_redact(value, valid: Column, marker: str = "[REDACTED]") -> Column:
    """Keep a value that passes its rule, mark any other."""
    return F.when(valid, _c(value)).otherwise(F.lit(marker))


def token(prefix: str, number) -> Column:
    """Prefixed 128-bit hexadecimal token."""
    return F.concat(F.lit(prefix + "_"), F.lpad(F.lower(F.hex(_c(number).cast("long"))), 32, "0"))


# The prefix of each token column and the shape shared by all of them.
TOKEN_PREFIXES = {
    "event_id": "evt",
    "merchant_id": "mrc",
    "checkout_id": "chk",
    "customer_token": "cus",
    "device_token": "dev",
    "network_token": "net",
    "session_token": "ses",
    "payment_instrument_token": "pmt",
    "campaign_id": "cmp",
    "scenario_instance_id": "scn",
}


def is_token(column: str, prefix: str | None = None) -> Column:
    return F.col(column).rlike(f"^{prefix or TOKEN_PREFIXES[column]}_[0-9a-f]{{32}}$")
