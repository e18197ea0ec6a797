"""The ledger's read side."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardweir.operators import drift as D
from cardweir.operators import graph as G
from cardweir.operators import ledger as L
from cardweir.operators import metrics as M
from cardweir.operators.joins import assign_bin
from cardweir.plans.metric_queries import CAMPAIGNS, rounded
from cardweir.plans.registry import query
from cardweir.session import materialise, new_table_path
from cardweir.sources import ledger as G_
from cardweir.sources import tables as T

ANCHOR = "coalesce(occurred_at_ms, created_at_ms)"
NOW = "(SELECT max(occurred_at_ms) FROM ledger)"
SUMMARY_SQL = """id AS decision_id, event_id, merchant_id, checkout_id, device_token, network_token,
  payment_instrument_token, session_token, customer_token, amount_subunits, currency, channel, occurred_at_ms,
  created_at_ms, CAST(calibrated_probability AS VARCHAR) AS calibrated_probability,
  coalesce(CAST(decision_threshold AS VARCHAR), '0') AS decision_threshold, risk_decision,
  coalesce(action, 'review') AS action, fail_safe_reason, provider_order_id, status, model_id"""
SINCE = T.CALIBRATION_END_MS


def _clustered(spark, sf):
    """The ledger as it is stored for readers: by day, with the time a row is filed under."""
    path = new_table_path(spark, "ledger")
    G_.write_clustered(T.ledger(spark, sf), path)
    return G_.read_clustered(spark, path)


@query(
    "P8_ledger_filter",
    f"SELECT id, action, {ANCHOR} AS anchor_ms FROM ledger WHERE action = 'deny' AND {ANCHOR} >= {SINCE}",
)
def ledger_filter(spark, sf):
    kept = L.ledger_filter(_clustered(spark, sf), "deny", SINCE)
    return L.with_anchor(kept).select("id", "action", "anchor_ms")


@query("P9_ledger_summary_view", f"SELECT {SUMMARY_SQL} FROM ledger")
def summary_view(spark, sf):
    return L.summary_view(T.ledger(spark, sf))


@query("P10_since_window", f"SELECT id, {ANCHOR} AS anchor_ms FROM ledger WHERE {ANCHOR} >= {NOW} - 3600000")
def since_window(spark, sf):
    l = _clustered(spark, sf)
    return L.with_anchor(L.since_window(l, L.latest_time(l), 3600, 60, 86_400)).select("id", "anchor_ms")


@query("P11_eligible_for_explanation", "SELECT id FROM ledger WHERE status = 'final' AND risk_decision = 'deny'")
def eligible(spark, sf):
    return L.eligible_for_explanation(T.ledger(spark, sf)).select("id")


@query(
    "J6_review_pending",
    "SELECT id, id IN (SELECT risk_decision_id FROM reviews) AS review_pending FROM ledger",
)
def review_pending(spark, sf):
    return L.review_pending(T.ledger(spark, sf), T.reviews(spark, sf)).select("id", "review_pending")


@query(
    "W1_ledger_page",
    f"SELECT {SUMMARY_SQL}, (SELECT count(*) FROM ledger WHERE action = 'allow') AS total FROM ledger"
    f" WHERE action = 'allow' ORDER BY {ANCHOR} DESC, ledger.created_at_ms DESC, id LIMIT 50 OFFSET 100",
)
def ledger_page(spark, sf):
    return L.ledger_page(T.ledger(spark, sf), 50, 100, action="allow")


@query(
    "W1_ledger_page_deep",
    f"SELECT {SUMMARY_SQL}, (SELECT count(*) FROM ledger) AS total FROM ledger ORDER BY {ANCHOR} DESC, ledger.created_at_ms DESC, id LIMIT 500 OFFSET 5100",
)
def ledger_page_deep(spark, sf):
    """A page in the middle of the ledger, from the slices that hold it."""
    return L.ledger_page(T.ledger(spark, sf), 500, 5100)


@query(
    "W2_latest_explanation",
    """SELECT risk_decision_id, attempt_number, status, summary, failure_reason, greatest(3 - used, 0) AS attempts_remaining
FROM (SELECT *, count(*) OVER (PARTITION BY risk_decision_id) AS used, row_number() OVER (PARTITION BY risk_decision_id
  ORDER BY status = 'ready' DESC, attempt_number DESC) AS rn FROM explanations) e WHERE rn = 1""",
)
def latest_explanation(spark, sf):
    return L.latest_explanation(T.explanations(spark, sf))


@query(
    "W3_order_budget",
    """SELECT id, CASE WHEN action = 'allow' AND rn > 500 THEN 'review' ELSE action END AS action,
  CASE WHEN action = 'allow' AND rn > 500 THEN 'order_budget_exhausted' ELSE fail_safe_reason END AS fail_safe_reason
FROM (SELECT *, row_number() OVER (PARTITION BY action ORDER BY created_at_ms, id) AS rn FROM ledger) l""",
)
def order_budget(spark, sf):
    return L.order_budget(T.ledger(spark, sf), 500).select("id", "action", "fail_safe_reason")


@query(
    "W6_recent_scored",
    f"SELECT id, CAST(calibrated_probability AS VARCHAR) AS p FROM ledger WHERE calibrated_probability IS NOT NULL"
    f" ORDER BY {ANCHOR} DESC, created_at_ms DESC, id LIMIT 3000",
)
def recent_scored(spark, sf):
    return L.recent_scored(T.ledger(spark, sf), 3000).select(
        "id", F.col("calibrated_probability").cast("string").alias("p")
    )


@query(
    "A36_ledger_summary",
    f"""SELECT count(*) AS total_decisions, count(*) FILTER (WHERE action = 'allow') AS allow,
  count(*) FILTER (WHERE action = 'review') AS review, count(*) FILTER (WHERE action = 'deny') AS deny,
  count(provider_order_id) AS orders_created, max({ANCHOR}) AS latest_decision_ms,
  (SELECT count(*) FROM reviews WHERE status = 'pending') AS review_items_pending,
  (SELECT model_id FROM ledger ORDER BY {ANCHOR} DESC, created_at_ms DESC, id DESC LIMIT 1) AS model_id,
  max(feature_schema_version) AS feature_schema_version, max(feature_engine_version) AS feature_engine_version
FROM ledger""",
)
def ledger_summary(spark, sf):
    return L.ledger_summary(T.ledger(spark, sf), T.reviews(spark, sf))


def context_sql(exclude: bool) -> str:
    join = " AND o.id <> e.id" if exclude else ""
    return f"""WITH en AS (SELECT id, action, {ANCHOR} AS t, unnest(['device', 'network', 'instrument', 'merchant']) AS kind,
  unnest([device_token, network_token, payment_instrument_token, merchant_id]) AS token FROM ledger)
SELECT e.id, e.kind, e.token, count(o.id) AS decision_count,
  count(o.id) FILTER (WHERE o.action = 'deny') AS denied_count,
  count(o.id) FILTER (WHERE o.action = 'review') AS review_count,
  min(o.t) AS first_seen_ms, max(o.t) AS last_seen_ms, (max(o.t) - min(o.t)) // 1000 AS span_seconds
FROM en e LEFT JOIN en o ON o.kind = e.kind AND o.token = e.token{join} GROUP BY e.id, e.kind, e.token"""


@query("A37_entity_context_include_self", context_sql(False))
def context_include(spark, sf):
    return L.entity_context(T.ledger(spark, sf), exclude_self=False)


@query("A37_entity_context_exclude_self", context_sql(True))
def context_exclude(spark, sf):
    return L.entity_context(T.ledger(spark, sf), exclude_self=True)


@query("A38_attempts_used", "SELECT risk_decision_id, count(*) AS attempts_used FROM explanations GROUP BY risk_decision_id")
def attempts_used(spark, sf):
    return L.attempts_used(T.explanations(spark, sf))


@query(
    "E10_attempt_gate",
    """SELECT id, CASE WHEN bool_or(e.status = 'pending') THEN 'in_progress' WHEN bool_or(e.status = 'ready') THEN 'ready'
  WHEN count(e.status) >= 3 THEN 'attempts_exhausted' ELSE 'open' END AS gate
FROM ledger l LEFT JOIN explanations e ON e.risk_decision_id = l.id
WHERE l.status = 'final' AND l.risk_decision = 'deny' GROUP BY id""",
)
def attempt_gate(spark, sf):
    return L.attempt_gate(T.ledger(spark, sf), T.explanations(spark, sf))


@query(
    "J5_assign_bin",
    """SELECT b.bin, count(*) AS n FROM scored s JOIN reference_bins b ON s.p >= b.lower_inclusive
  AND (s.p < b.upper_value OR (b.upper_inclusive AND s.p <= b.upper_value)) GROUP BY b.bin""",
)
def assign_bins(spark, sf):
    binned = assign_bin(T.scored(spark, sf), T.reference_bins(spark, sf))
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


OBSERVED = """ob AS (SELECT b.*, count(s.p) AS observed_count FROM reference_bins b
  LEFT JOIN (SELECT p FROM scored WHERE split = 'test') s ON s.p >= b.lower_inclusive
  AND (s.p < b.upper_value OR (b.upper_inclusive AND s.p <= b.upper_value)) GROUP BY ALL),
sh AS (SELECT *, bin_count / (sum(bin_count) OVER ())::DOUBLE AS reference_share,
  observed_count / (sum(observed_count) OVER ())::DOUBLE AS observed_share FROM ob),
pt AS (SELECT *, (greatest(observed_share, 1e-4::DOUBLE) - greatest(reference_share, 1e-4::DOUBLE))
  * ln(greatest(observed_share, 1e-4::DOUBLE) / greatest(reference_share, 1e-4::DOUBLE)) AS contribution FROM sh)"""
BAND = "CASE WHEN {v} < 0.1 THEN 'none' WHEN {v} <= 0.25 THEN 'moderate' WHEN {v} IS NOT NULL THEN 'significant' END"


def _test_counts(spark, sf):
    return D.bin_counts(T.scored(spark, sf).filter("split = 'test'"), T.reference_bins(spark, sf))


@query(
    "A33_psi",
    f"WITH {OBSERVED} SELECT bin, bin_count, observed_count, reference_share, observed_share,"
    " round(contribution, 9) AS contribution, round(sum(contribution) OVER (), 9) AS psi FROM pt",
)
def psi(spark, sf):
    terms = D.psi_terms(_test_counts(spark, sf))
    total = terms.agg(F.sum("contribution").alias("psi")).scalar()
    return rounded(
        terms.select(
            "bin", "bin_count", "observed_count", "reference_share", "observed_share", "contribution",
            total.alias("psi"),
        ),
        "contribution", "psi",
    )


@query(
    "A34_psi_band",
    "SELECT p, " + BAND.format(v="p") + " AS band, count(*) AS n FROM scored GROUP BY p",
)
def psi_band(spark, sf):
    return T.scored(spark, sf).groupBy("p").agg(F.count(F.lit(1)).alias("n")).select(
        "p", D.psi_band("p").alias("band"), "n"
    )


# The report over a CTE ``rec`` of recent probabilities.
DRIFT_SQL = (
    OBSERVED.replace("(SELECT p FROM scored WHERE split = 'test') s", "rec s")
    + ", tt AS (SELECT sum(contribution) AS v, sum(abs(contribution)) AS a, sum(observed_count)::BIGINT AS n FROM pt)"
    + " SELECT CASE WHEN n >= 200 THEN 'ok' ELSE 'insufficient_data' END AS status,"
    + " CASE WHEN n >= 200 THEN round(v, 9) END AS psi, "
    + BAND.format(v="(CASE WHEN n >= 200 THEN v END)")
    + " AS band, n AS observed_rows, bin, bin_count, observed_count, reference_share,"
    " coalesce(observed_share, 0) AS observed_share, round(CASE WHEN n >= 200 THEN contribution ELSE 0 END, 9)"
    " AS contribution, round(CASE WHEN n >= 200 AND a > 0 THEN abs(contribution) / a ELSE 0 END, 9)"
    " AS contribution_share FROM pt, tt"
)


@query(
    "A35_drift_report",
    f"""WITH rec AS (SELECT CAST(calibrated_probability AS DOUBLE) AS p FROM ledger
  WHERE calibrated_probability IS NOT NULL AND {ANCHOR} >= {NOW} - 7200000), """
    + DRIFT_SQL,
)
def drift_report(spark, sf):
    l = T.ledger(spark, sf)
    report = D.drift_report(l, T.reference_bins(spark, sf), L.latest_time(l), 2)
    return rounded(report, "psi", "contribution", "contribution_share")


GRAPH = f"""w AS (SELECT * FROM ledger WHERE {ANCHOR} >= {NOW} - 3600000),
en AS (SELECT id, unnest(['device', 'network', 'instrument']) AS kind,
  unnest([device_token, network_token, payment_instrument_token]) AS token FROM w),
hub AS (SELECT kind || ':' || token AS hub_id, kind, token, count(*) AS degree FROM en WHERE token IS NOT NULL
  GROUP BY kind, token HAVING count(*) > 1),
ed AS (SELECT 'event:' || e.id AS source, h.hub_id AS target, 1 AS weight, e.id, e.kind, e.token
  FROM en e JOIN hub h USING (kind, token)),
ke AS (SELECT id, count(DISTINCT kind) AS kinds FROM ed GROUP BY id),
hk AS (SELECT a.target AS hub_id, count(DISTINCT CASE WHEN b.kind <> a.kind THEN b.kind END) AS shared_kinds
  FROM ed a JOIN ed b USING (id) GROUP BY a.target)"""


def _window(spark, sf):
    l = T.ledger(spark, sf)
    return G.window_decisions(l, L.latest_time(l), 3600)


@query("G1_hubs", f"WITH {GRAPH} SELECT * FROM hub")
def hubs(spark, sf):
    return G.hubs(_window(spark, sf))


@query("G2_edges", f"WITH {GRAPH} SELECT source, target, weight FROM ed")
def edges(spark, sf):
    return G.edges(_window(spark, sf)).select("source", "target", "weight")


@query("J7_event_hub_edges", f"WITH {GRAPH} SELECT id, kind, token FROM ed")
def event_hub_edges(spark, sf):
    return G.edges(_window(spark, sf)).select("id", "kind", "token")


@query("G3_kinds_per_event", f"WITH {GRAPH} SELECT id, kinds FROM ke")
def kinds_per_event(spark, sf):
    return G.kinds_per_event(G.edges(_window(spark, sf))).select("id", F.col("kinds").cast("long").alias("kinds"))


@query("G4_hub_shared_kinds", f"WITH {GRAPH} SELECT hub_id, shared_kinds FROM hk")
def hub_shared_kinds(spark, sf):
    return G.hub_shared_kinds(materialise(G.edges(_window(spark, sf)), "edges")).select("hub_id", F.col("shared_kinds").cast("long").alias("shared_kinds"))


@query(
    "G5_nodes",
    f"""WITH {GRAPH} SELECT hub_id AS node_id, kind, token AS label, NULL AS action, NULL AS decision_id, degree, shared_kinds
FROM hub JOIN hk USING (hub_id)
UNION ALL SELECT 'event:' || id, 'event', event_id, coalesce(action, 'review'), id, kinds, kinds FROM ke JOIN w USING (id)""",
)
def nodes(spark, sf):
    return G.nodes(_window(spark, sf))


@query(
    "G6_graph_totals",
    f"WITH {GRAPH} SELECT (SELECT count(*) FROM w) AS decision_count, (SELECT count(*) FROM hub) AS clustered_entity_count",
)
def graph_totals(spark, sf):
    return G.graph_totals(_window(spark, sf))


@query(
    "G7_clusters",
    f"""WITH RECURSIVE {GRAPH}, lk AS (SELECT DISTINCT a.target AS u, b.target AS v FROM ed a JOIN ed b USING (id)),
reach(u, v) AS (SELECT hub_id, hub_id FROM hub UNION SELECT r.u, l.v FROM reach r JOIN lk l ON l.u = r.v)
SELECT u AS hub_id, min(v) AS cluster_id FROM reach GROUP BY u""",
)
def clusters(spark, sf):
    return G.clusters(_window(spark, sf))


@query(
    "X4_missed_campaigns",
    f"WITH {CAMPAIGNS} SELECT campaign_id FROM k WHERE first_flag IS NULL",
)
def missed_campaigns(spark, sf):
    c = M.campaigns(T.scored(spark, sf), 0.95)
    return c.select("campaign_id").exceptAll(c.filter("first_flagged_ms is not null").select("campaign_id"))
