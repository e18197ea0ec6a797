"""Metrics, thresholds and policy on the scored view. W5 and A2 use the same ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardweir.operators import features as X
from cardweir.operators import metrics as M
from cardweir.operators import policy as P
from cardweir.plans.registry import query
from cardweir.operators.rolling import FAMILIES
from cardweir.sources import tables as T

THRESHOLD = 0.62
LOWER, UPPER = 0.5, 0.8


def rounded(df, *columns, places=9):
    """Sums of doubles depend on their order in every engine; compare them to nine places."""
    names = columns or [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, places) for c in names})


def counts_sql(flag: str, source: str = "scored") -> str:
    return f"""SELECT count(*) FILTER (WHERE y = 1 AND {flag}) AS true_positive,
  count(*) FILTER (WHERE y = 0 AND {flag}) AS false_positive,
  count(*) FILTER (WHERE y = 0 AND NOT {flag}) AS true_negative,
  count(*) FILTER (WHERE y = 1 AND NOT {flag}) AS false_negative FROM {source}"""


def derived_sql(counts: str, fp_cost: int = 1, fn_cost: int = 25, extra: str = "") -> str:
    return f"""SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1_score,
  cost_units * 10000 / nullif(row_count, 0)::DOUBLE AS cost_per_10000_events,
  false_positive * 10000 / nullif(legitimate_count, 0)::DOUBLE AS false_positives_per_10000_legitimate,
  false_positive / nullif(legitimate_count, 0)::DOUBLE AS false_positive_rate,
  attack_count / nullif(row_count, 0)::DOUBLE AS prevalence,
  review_count / nullif(row_count, 0)::DOUBLE AS review_rate,
  true_negative / nullif(legitimate_count, 0)::DOUBLE AS specificity
FROM (SELECT *, true_positive + false_negative AS attack_count,
  true_negative + false_positive AS legitimate_count, true_positive + false_positive AS review_count,
  true_positive + false_positive + true_negative + false_negative AS row_count,
  false_positive * {fp_cost} + false_negative * {fn_cost} AS cost_units,
  true_positive / nullif(true_positive + false_positive, 0)::DOUBLE AS precision,
  true_positive / nullif(true_positive + false_negative, 0)::DOUBLE AS recall
  FROM ({counts}) c) d"""


THRESHOLD_SQL = derived_sql(counts_sql(f"p >= {THRESHOLD}").replace("SELECT count", f"SELECT {THRESHOLD}::DOUBLE AS threshold, count", 1))

CURVE_COUNTS = """SELECT t.p AS threshold, count(*) FILTER (WHERE s.y = 1 AND s.p >= t.p) AS true_positive,
  count(*) FILTER (WHERE s.y = 0 AND s.p >= t.p) AS false_positive,
  count(*) FILTER (WHERE s.y = 0 AND s.p < t.p) AS true_negative,
  count(*) FILTER (WHERE s.y = 1 AND s.p < t.p) AS false_negative
FROM (SELECT DISTINCT p FROM scored UNION SELECT 0.0 UNION SELECT 1.0) t, scored s GROUP BY t.p"""


@query("A3_confusion", counts_sql("p >= 0.62"))
def confusion(spark, sf):
    return M.confusion(T.scored(spark, sf), "y", "p >= 0.62D")


@query("A4_threshold_metrics", THRESHOLD_SQL)
def threshold_metrics(spark, sf):
    return M.threshold_metrics(T.scored(spark, sf), THRESHOLD)


@query("A5_threshold_curve", derived_sql(CURVE_COUNTS))
def threshold_curve(spark, sf):
    return M.threshold_curve(T.scored(spark, sf))


@query(
    "A6_select_threshold",
    derived_sql(CURVE_COUNTS)
    + " ORDER BY cost_units, false_positive, true_positive DESC, coalesce(precision, 0) DESC,"
    " threshold DESC LIMIT 1",
)
def select_threshold(spark, sf):
    return M.select_threshold(M.threshold_curve(T.scored(spark, sf)))


RANKED = """h AS (SELECT p, sum(y)::BIGINT AS a, sum(1 - y)::BIGINT AS l FROM scored GROUP BY p),
c AS (SELECT *, sum(a) OVER (ORDER BY p DESC)::BIGINT AS tp, sum(l) OVER (ORDER BY p DESC)::BIGINT AS fp,
  sum(a) OVER ()::BIGINT AS pos, sum(l) OVER ()::BIGINT AS neg FROM h),
r AS (SELECT *, tp / (tp + fp)::DOUBLE AS prec,
  lag(tp / (tp + fp)::DOUBLE, 1, 1.0) OVER (ORDER BY p DESC) AS prev_prec,
  lag(tp, 1, 0) OVER (ORDER BY p DESC) AS prev_tp FROM c)"""


@query(
    "A7_average_precision",
    f"WITH {RANKED} SELECT round(sum(a / pos::DOUBLE * prec), 9) AS average_precision FROM r",
)
def average_precision(spark, sf):
    return rounded(M.ranking_metrics(T.scored(spark, sf)).select("average_precision"))


@query(
    "A8_average_precision_stepwise",
    """SELECT round(sum(CASE WHEN y = 1 THEN hits / rank::DOUBLE ELSE 0 END) / sum(y), 9) AS average_precision
FROM (SELECT y, sum(y) OVER w AS hits, row_number() OVER w AS rank FROM scored
  WINDOW w AS (ORDER BY p DESC, occurred_at_ms, event_id ROWS UNBOUNDED PRECEDING)) s""",
)
def average_precision_stepwise(spark, sf):
    return rounded(
        M.average_precision_stepwise(T.scored(spark, sf), F.col("occurred_at_ms"), F.col("event_id"))
    )


@query(
    "A9_pr_auc_trapezoidal",
    f"WITH {RANKED} SELECT round(sum(a / pos::DOUBLE * (prec + prev_prec) / 2), 9) AS pr_auc_trapezoidal FROM r",
)
def pr_auc(spark, sf):
    return rounded(M.ranking_metrics(T.scored(spark, sf)).select("pr_auc_trapezoidal"))


@query(
    "A10_roc_auc",
    f"WITH {RANKED} SELECT round(sum(l / neg::DOUBLE * (tp + prev_tp) / 2.0::DOUBLE / pos), 9) AS roc_auc FROM r",
)
def roc_auc(spark, sf):
    return rounded(M.ranking_metrics(T.scored(spark, sf)).select("roc_auc"))


@query("A11_brier", "SELECT round(avg((p - y) * (p - y)), 9) AS brier_score FROM scored")
def brier(spark, sf):
    return rounded(M.calibration_losses(T.scored(spark, sf)).select("brier_score"))


Q = "least(greatest(p, 2.220446049250313e-16::DOUBLE), 1 - 2.220446049250313e-16::DOUBLE)"
LOG_LOSS = f"round(avg(-CASE WHEN y = 1 THEN ln({Q}) ELSE ln(1 - {Q}) END), 9)"


@query("A12_log_loss", f"SELECT {LOG_LOSS} AS log_loss FROM scored")
def log_loss(spark, sf):
    return rounded(M.calibration_losses(T.scored(spark, sf)).select("log_loss"))


BINS = """b AS (SELECT i.n AS bin, i.n / 10.0::DOUBLE AS lower_inclusive, (i.n + 1) / 10.0::DOUBLE AS upper_value,
  i.n = 9 AS upper_inclusive, count(s.p) AS bin_count, avg(s.p) AS mean_probability, avg(s.y) AS attack_rate
FROM (SELECT unnest(range(10)) AS n) i LEFT JOIN scored s ON s.p >= i.n / 10.0::DOUBLE
  AND (s.p < (i.n + 1) / 10.0::DOUBLE OR (i.n = 9 AND s.p <= 1)) GROUP BY i.n)"""


@query(
    "A13_reliability",
    f"WITH {BINS} SELECT bin, lower_inclusive, upper_value, upper_inclusive, bin_count,"
    " round(mean_probability, 9) AS mean_probability, round(attack_rate, 9) AS attack_rate FROM b",
)
def reliability(spark, sf):
    return rounded(M.reliability(T.scored(spark, sf)), "mean_probability", "attack_rate")


ECE = "round(sum(bin_count * abs(mean_probability - attack_rate)) / sum(bin_count), 9) AS expected_calibration_error"


@query("A14_ece", f"WITH {BINS} SELECT {ECE} FROM b")
def ece(spark, sf):
    return rounded(M.expected_calibration_error(M.reliability(T.scored(spark, sf))))


@query(
    "A15_hard_negative_slices",
    """SELECT n.s AS scenario_type, count(p) AS row_count, count(p) FILTER (WHERE p >= 0.62) AS false_positive_count,
  count(p) FILTER (WHERE p >= 0.62) AS false_positive_cost_units,
  count(p) FILTER (WHERE p >= 0.62) / nullif(count(p), 0)::DOUBLE AS false_positive_rate,
  count(p) FILTER (WHERE p >= 0.62) * 10000 / nullif(count(p), 0)::DOUBLE AS false_positives_per_10000
FROM (SELECT unnest(['flash_sale', 'legitimate_failure', 'legitimate_retry', 'normal', 'shared_infrastructure']) AS s) n
LEFT JOIN scored ON scenario_type = n.s AND y = 0 GROUP BY n.s""",
)
def hard_negatives(spark, sf):
    return M.hard_negative_slices(T.scored(spark, sf), THRESHOLD)


CAMPAIGNS = """k AS (SELECT campaign_id, count(*) AS attacks, count(*) FILTER (WHERE p >= 0.95) AS flagged,
  min(occurred_at_ms) AS first_attack, min(occurred_at_ms) FILTER (WHERE p >= 0.95) AS first_flag
FROM scored WHERE y = 1 GROUP BY campaign_id)"""
RANK = lambda v, n, p: (
    f"list_sort(list({v}) FILTER (WHERE {v} IS NOT NULL))[greatest(1, ({p} * count({v}) + 99) // 100)] AS {n}"
)
CAMPAIGN_COLUMNS = f"""count(*) AS campaign_count, count(first_flag) AS detected_campaign_count,
  count(*) - count(first_flag) AS missed_campaign_count,
  count(first_flag) / nullif(count(*), 0)::DOUBLE AS campaign_recall,
  CAST(sum(flagged) AS BIGINT) / nullif(count(*), 0)::DOUBLE AS flagged_mean,
  min(first_flag - first_attack) AS delay_ms_minimum, max(first_flag - first_attack) AS delay_ms_maximum,
  {RANK('(first_flag - first_attack)', 'delay_ms_median', 50)}, {RANK('(first_flag - first_attack)', 'delay_ms_p95', 95)},
  min(flagged) AS flagged_minimum, max(flagged) AS flagged_maximum,
  {RANK('flagged', 'flagged_median', 50)}, {RANK('flagged', 'flagged_p95', 95)}"""


@query("A16_campaign_metrics", f"WITH {CAMPAIGNS} SELECT {CAMPAIGN_COLUMNS} FROM k")
def campaign_metrics(spark, sf):
    return M.campaign_metrics(T.scored(spark, sf), 0.95)


@query(
    "A17_flagged_histogram",
    f"WITH {CAMPAIGNS} SELECT flagged, count(*) AS campaigns FROM k GROUP BY flagged",
)
def flagged_histogram(spark, sf):
    return M.flagged_histogram(T.scored(spark, sf), 0.95)


@query(
    "A18_evaluation_report",
    f"""WITH {RANKED}, {BINS}, {CAMPAIGNS.replace('0.95', '0.62')}
SELECT t.*, x.*, c.*, l.*, e.*, rb.*, hn.* FROM ({THRESHOLD_SQL}) t,
(SELECT round(sum(a / pos::DOUBLE * prec), 9) AS average_precision,
  round(sum(a / pos::DOUBLE * (prec + prev_prec) / 2), 9) AS pr_auc_trapezoidal,
  round(sum(l / neg::DOUBLE * (tp + prev_tp) / 2.0::DOUBLE / pos), 9) AS roc_auc FROM r) x,
(SELECT {CAMPAIGN_COLUMNS} FROM k) c,
(SELECT round(avg((p - y) * (p - y)), 9) AS brier_score, {LOG_LOSS} AS log_loss FROM scored) l,
(SELECT {ECE} FROM b) e,
(SELECT string_agg(bin || ':' || bin_count || ':' || coalesce(CAST(CAST(round(mean_probability * 1000000) AS BIGINT) AS VARCHAR), '') || ':'
    || coalesce(CAST(CAST(round(attack_rate * 1000000) AS BIGINT) AS VARCHAR), ''), ',' ORDER BY bin) AS reliability FROM b) rb,
(SELECT string_agg(s || ':' || n || ':' || f, ',' ORDER BY s) AS hard_negative_slices FROM (
  SELECT names.s, count(p) AS n, count(p) FILTER (WHERE p >= 0.62) AS f
  FROM (SELECT unnest(['flash_sale', 'legitimate_failure', 'legitimate_retry', 'normal', 'shared_infrastructure']) AS s) names
  LEFT JOIN scored ON scenario_type = names.s AND y = 0 GROUP BY names.s) q) hn""",
)
def evaluation_report(spark, sf):
    """The report with its bins and slices, these as text: rates in millionths."""
    def text(column, fields):
        return F.expr(f"array_join(transform({column}, x -> concat_ws(':', {', '.join(fields)})), ',')").alias(column)

    millionth = "coalesce(string(bigint(round(x.{c} * 1000000))), '')".format
    report = M.evaluation_report(T.scored(spark, sf), THRESHOLD)
    return rounded(
        report.withColumns({
            "reliability": text("reliability", ["x.bin", "x.bin_count", millionth(c="mean_probability"), millionth(c="attack_rate")]),
            "hard_negative_slices": text("hard_negative_slices", ["x.scenario_type", "x.row_count", "x.false_positive_count"]),
        }),
        "average_precision", "pr_auc_trapezoidal", "roc_auc", "brier_score", "log_loss",
        "expected_calibration_error",
    )


EVERY_CANDIDATE = "cand AS (SELECT p FROM scored UNION SELECT 0.0 UNION SELECT 1.0 UNION SELECT 0.615)"
CANDIDATES = """o AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS i, count(*) OVER () AS n
  FROM (SELECT DISTINCT p FROM scored UNION SELECT 0.0 UNION SELECT 1.0) d),
cand AS (SELECT p FROM o WHERE n <= {g} OR i IN (SELECT (g.j * (SELECT max(n) - 1 FROM o)) // ({g} - 1)
  FROM (SELECT unnest(range({g})) AS j) g) UNION SELECT 0.615)"""


@query("A19_sweep_candidates", "WITH " + CANDIDATES.format(g=32) + " SELECT p FROM cand")
def sweep_candidates(spark, sf):
    return P.sweep_candidates(T.scored(spark, sf), 32, (0.615,))


def band_sql(lo: str, hi: str, source: str = "scored") -> str:
    return f"""SELECT *, false_negative * 25 + false_positive + review_count * 3 AS cost_units FROM (SELECT
  count(*) FILTER (WHERE p < {lo}) AS allow_count,
  count(*) FILTER (WHERE p >= {lo} AND p < {hi}) AS review_count,
  count(*) FILTER (WHERE p >= {hi}) AS deny_count,
  count(*) FILTER (WHERE p >= {hi} AND y = 1) AS true_positive,
  count(*) FILTER (WHERE p >= {hi} AND y = 0) AS false_positive,
  count(*) FILTER (WHERE p < {lo} AND y = 0) AS true_negative,
  count(*) FILTER (WHERE p < {lo} AND y = 1) AS false_negative,
  count(*) AS row_count, count(*) FILTER (WHERE y = 1) AS attack_count,
  count(*) FILTER (WHERE y = 0) AS legitimate_count FROM {source}) z"""


@query("A20_evaluate_band", band_sql("0.5", "0.8"))
def evaluate_band(spark, sf):
    return P.evaluate_band(T.scored(spark, sf), LOWER, UPPER)


@query("A21_evaluate_single_threshold", band_sql("0.62", "0.62"))
def evaluate_single_threshold(spark, sf):
    return P.evaluate_single_threshold(T.scored(spark, sf), THRESHOLD)


@query(
    "A22_select_band",
    "WITH " + EVERY_CANDIDATE + """,
n AS (SELECT c.p, count(s.p) FILTER (WHERE s.p < c.p) AS below,
  count(s.p) FILTER (WHERE s.p < c.p AND y = 1) AS fn,
  count(s.p) FILTER (WHERE s.p >= c.p AND y = 0) AS fp,
  count(s.p) FILTER (WHERE s.p >= c.p AND y = 1) AS tp, count(s.p) AS total
  FROM cand c, scored s GROUP BY c.p)
SELECT lo.p AS lower_threshold, hi.p AS upper_threshold,
  lo.fn * 25 + hi.fp + (hi.below - lo.below) * 3 AS cost_units, hi.fp AS false_positive,
  hi.tp AS true_positive, lo.fn AS false_negative, hi.below - lo.below AS review_count,
  lo.below AS allow_count, hi.total - hi.below AS deny_count, hi.total AS row_count
FROM n lo JOIN n hi ON lo.p <= hi.p
ORDER BY 3, 4, 5 DESC, 7, 2 DESC, 1 DESC LIMIT 1""",
)
def select_band(spark, sf):
    return P.select_band(T.scored(spark, sf), required=(0.615,))


REPORT_EXTRA = """false_positive / nullif(legitimate_count, 0)::DOUBLE AS false_positive_rate,
  (false_positive * 20000 + legitimate_count) // (2 * nullif(legitimate_count, 0)) AS false_positive_rate_basis_points,
  false_positive * 10000 / nullif(legitimate_count, 0)::DOUBLE AS false_positives_per_10000_legitimate,
  review_count / nullif(row_count, 0)::DOUBLE AS review_rate"""


@query("A23_band_report", f"SELECT *, {REPORT_EXTRA} FROM ({band_sql('0.5', '0.8')}) r")
def band_report(spark, sf):
    return P.band_report(P.evaluate_band(T.scored(spark, sf), LOWER, UPPER))


def boundary_sql(t: str) -> str:
    return f"""SELECT (SELECT count(DISTINCT p) FROM scored) AS distinct_probability_count,
  (SELECT max(p) FROM scored WHERE p < {t}) AS nearest_below,
  EXISTS (SELECT 1 FROM scored WHERE p = {t}::DOUBLE) AS threshold_is_observed,
  (SELECT count(*) FROM scored WHERE p = (SELECT max(p) FROM scored WHERE p < {t})) AS tied_rows,
  (SELECT count(*) FROM scored WHERE y = 1 AND p = (SELECT max(p) FROM scored WHERE p < {t})) AS tied_attacks"""


@query("A24_boundary_diagnostics", boundary_sql("0.625"))
def boundary_diagnostics(spark, sf):
    return P.boundary_diagnostics(T.scored(spark, sf), 0.625)


@query(
    "A25_decision_boundary",
    f"SELECT 0.62::DOUBLE AS decision_threshold, *, tied_rows - tied_attacks AS tied_legitimate FROM ({boundary_sql('0.62')}) b",
)
def decision_boundary(spark, sf):
    return P.decision_boundary(T.scored(spark, sf), THRESHOLD)


GATES_SQL = """SELECT NOT (NOT beats OR NOT within OR NOT enough) AS approval_eligible, beats AS beats_incumbent_cost,
  delta AS cost_delta_units, array_to_string(list_filter([
    CASE WHEN NOT beats THEN 'banded_policy_does_not_beat_incumbent_cost' END,
    CASE WHEN NOT within THEN 'banded_policy_exceeds_false_positive_rate_ceiling' END,
    CASE WHEN NOT enough THEN 'validation_batch_below_minimum_evidence' END], lambda x: x IS NOT NULL), ',') AS failed_gates,
  bp AS false_positive_rate_basis_points, within AS false_positive_rate_within_ceiling,
  enough AS validation_batch_sufficient
FROM (SELECT b.cost_units < i.cost_units AS beats, b.cost_units - i.cost_units AS delta, bp,
  coalesce(bp <= 100, false) AS within, b.row_count >= 2000 AND b.attack_count >= 100 AS enough
FROM (SELECT *, """ + REPORT_EXTRA.split(",\n")[1].replace("false_positive_rate_basis_points", "bp") + f""" FROM ({band_sql('0.5', '0.8')}) z) b,
  ({band_sql('0.62', '0.62')}) i) g"""


@query("A26_evaluate_gates", GATES_SQL)
def evaluate_gates(spark, sf):
    s = T.scored(spark, sf)
    return P.evaluate_gates(
        P.evaluate_single_threshold(s, THRESHOLD), P.evaluate_band(s, LOWER, UPPER)
    )


def _prefixed(prefix: str, sql: str, columns: str) -> str:
    names = ", ".join(f"{c} AS {prefix}_{c}" for c in columns.split())
    return f"(SELECT {names} FROM ({sql}) q) {prefix}"


OUTCOME = "cost_units true_positive false_positive false_negative review_count"


@query(
    "A27_compare_policies",
    f"SELECT *, true AS has_review_tier FROM ({GATES_SQL}) gates, "
    + ", ".join([
        _prefixed("incumbent", band_sql("0.62", "0.62"), OUTCOME),
        _prefixed("banded", band_sql("0.5", "0.8"), OUTCOME),
        _prefixed("lower_boundary", boundary_sql("0.5"), "nearest_below tied_rows"),
        _prefixed("upper_boundary", boundary_sql("0.8"), "nearest_below tied_rows"),
        _prefixed("incumbent_boundary", boundary_sql("0.62"), "nearest_below tied_rows"),
    ]),
)
def compare_policies(spark, sf):
    return P.compare_policies(T.scored(spark, sf), LOWER, UPPER, THRESHOLD)


@query(
    "A28_balanced_weights",
    "SELECT y, count(*) AS n, (SELECT count(*) FROM scored) / (2 * count(*))::DOUBLE AS weight FROM scored GROUP BY y",
)
def balanced_weights(spark, sf):
    return M.balanced_weights(T.scored(spark, sf))


@query(
    "A29_partition_summary",
    "SELECT coalesce(split, 'all') AS split, count(*) AS row_count, CAST(sum(y) AS BIGINT) AS attack_count,"
    " CAST(sum(1 - y) AS BIGINT) AS legitimate_count FROM scored GROUP BY ROLLUP (split)",
)
def partition_summary(spark, sf):
    return M.partition_summary(T.scored(spark, sf))


def distributions_sql() -> str:
    from cardweir.plans.rolling_queries import ALL_SQL

    joined = " ".join(f"JOIN {f.name} USING (event_id)" for f in FAMILIES)
    return (
        f"{ALL_SQL}, g AS (SELECT {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in X.FEATURE_NAMES)} FROM cur {joined}), "
        "u AS (UNPIVOT g ON COLUMNS(*) INTO NAME feature VALUE v), "
        "o AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY v) AS rn, count(*) OVER (PARTITION BY feature) AS n FROM u) "
        "SELECT feature, min(v) AS min, max(v) AS max, "
        + ", ".join(f"min(CASE WHEN rn >= greatest(1, ({p} * n + 99) // 100) THEN v END) AS p{p}" for p in (50, 95, 99))
        + ", count(*) FILTER (WHERE v = 0) AS zero_count FROM o GROUP BY feature"
    )


@query("A1_feature_distributions", distributions_sql())
def feature_distributions(spark, sf):
    return M.feature_distributions(X.feature_vector(T.attempts(spark, sf)), list(X.FEATURE_NAMES))


@query(
    "A2_nearest_rank",
    "SELECT amount_subunits AS value FROM (SELECT amount_subunits, row_number() OVER (ORDER BY amount_subunits) AS rn,"
    " count(*) OVER () AS n FROM attempts) a WHERE rn = greatest(1, (95 * n + 99) // 100)",
)
def nearest_rank(spark, sf):
    return M.nearest_rank(T.attempts(spark, sf), "amount_subunits", 95)
