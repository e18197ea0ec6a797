"""Small attempt sets and a plain-Python reading of the window definition."""

from __future__ import annotations

import random

from cardweir.operators.rolling import FAMILIES

T0 = 1_767_225_600_000
SCHEMA = (
    "event_id string, occurred_at_ms bigint, merchant_id string, checkout_id string, customer_token string,"
    " device_token string, network_token string, session_token string, payment_instrument_token string,"
    " amount_subunits bigint, currency string, outcome string, failure_category string, channel string"
)


def tok(prefix, n):
    return None if n is None else f"{prefix}_{n:032x}"


def row(n, t_ms, outcome="authorized", merchant=0, checkout=0, device=0, network=0, instrument=0, session=0, customer=0):
    return (
        tok("evt", n), T0 + t_ms, tok("mrc", merchant), tok("chk", checkout), tok("cus", customer),
        tok("dev", device), tok("net", network), tok("ses", session), tok("pmt", instrument),
        100 + n, "INR", outcome, "unknown" if outcome == "failed" else None, "web",
    )


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def random_rows(n=400, seed=7):
    """A third of all rows share one merchant, device and network; many share a millisecond."""
    rng = random.Random(seed)
    rows = []
    for i in rng.sample(range(10_000), n):
        hot = rng.random() < 0.34
        pick = lambda k: 0 if hot else rng.randrange(k)
        rows.append(row(
            i, rng.choice([0, 59_999, 60_000, 60_001, 300_000, 3_600_000, rng.randrange(0, 8_000_000)]) + rng.randrange(0, 3) * 1000,
            rng.choice(["failed", "authorized"]), merchant=pick(6), checkout=rng.randrange(90),
            device=None if rng.random() < 0.1 else pick(8), network=None if rng.random() < 0.1 else pick(5),
            instrument=rng.randrange(15), session=rng.randrange(20),
        ))
    return rows


def brute_force(rows):
    """event_id -> window columns, straight from the definition."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    events = sorted((dict(zip(names, r)) for r in rows), key=lambda e: (e["occurred_at_ms"], e["event_id"]))
    out = {}
    for i, e in enumerate(events):
        values = {}
        for f in FAMILIES:
            for w in f.windows:
                prior = [
                    p for p in events[:i]
                    if e[f.key] is not None and p[f.key] == e[f.key] and p["occurred_at_ms"] > e["occurred_at_ms"] - w * 1000
                ]
                values[f"{f.name}_prior_attempt_count_{w}s"] = len(prior)
                fails = sum(p["outcome"] == "failed" for p in prior)
                if f.failures:
                    values[f"{f.name}_prior_failure_count_{w}s"] = fails
                for plural, c in f.distinct:
                    values[f"{f.name}_distinct_{plural}_{w}s"] = len({p[c] for p in prior} - {None})
                if f.failures and w == 300:
                    values[f"{f.name}_prior_failure_rate_300s_bp"] = fails * 10_000 // len(prior) if prior else 0
                if f.last_seen:
                    values[f"{f.name}_history_present"] = int(bool(prior))
                    values[f"{f.name}_previous_attempt_age_ms"] = (
                        e["occurred_at_ms"] - prior[-1]["occurred_at_ms"] if prior else 0
                    )
        out[e["event_id"]] = values
    return out
