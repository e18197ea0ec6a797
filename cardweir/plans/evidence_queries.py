"""Evidence for denials and screening of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardweir.operators import evidence as E
from cardweir.plans.ledger_queries import context_sql
from cardweir.plans.registry import query
from cardweir.plans.scalar_queries import number_sql
from cardweir.sources import tables as T

KINDS = ("device", "network", "instrument", "merchant")
FACTS = "cx AS (" + context_sql(True) + """), fx AS (SELECT l.id, l.event_no, l.amount_subunits, l.currency, l.channel, l.risk_decision,
  l.action, l.fail_safe_reason, l.calibrated_probability, l.decision_threshold, """ + ", ".join(
    f"bool_or(kind = '{k}' AND token IS NOT NULL) AS {k}_present, "
    + ", ".join(f"max(CASE WHEN kind = '{k}' THEN {c} END) AS {k}_{c}" for c in ("decision_count", "denied_count", "review_count", "span_seconds"))
    for k in KINDS
) + """ FROM ledger l JOIN cx USING (id) WHERE l.status = 'final' AND l.risk_decision = 'deny' GROUP BY ALL)"""
# What entails each factor, written out for the checks.
SUPPORT = (
    ("probability_at_or_above_threshold", "calibrated_probability >= decision_threshold"),
    ("device_reuse", "device_present AND device_decision_count > 1"),
    ("network_reuse", "network_present AND network_decision_count > 1"),
    ("instrument_reuse", "instrument_present AND instrument_decision_count > 1"),
    ("merchant_volume", "merchant_present AND merchant_decision_count >= 5"),
    ("prior_denials_on_device", "device_present AND device_denied_count > 0"),
    ("prior_denials_on_network", "network_present AND network_denied_count > 0"),
    ("prior_denials_on_instrument", "instrument_present AND instrument_denied_count > 0"),
    (
        "rapid_succession",
        "(device_present AND device_decision_count >= 3 AND device_span_seconds <= 300)"
        " OR (network_present AND network_decision_count >= 3 AND network_span_seconds <= 300)"
        " OR (instrument_present AND instrument_decision_count >= 3 AND instrument_span_seconds <= 300)"
        " OR (merchant_present AND merchant_decision_count >= 3 AND merchant_span_seconds <= 300)",
    ),
)
CODES = "list_filter([" + ", ".join(f"CASE WHEN {e} THEN '{c}' END" for c, e in SUPPORT) + "], lambda x: x IS NOT NULL)"
ALLOWED = "['1', '2', '5', '10', '1000']"


def _facts(spark, sf):
    return E.facts(T.ledger(spark, sf))


def _texts(spark, sf):
    docs = T.table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("k"), "text")
    talk = T.table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("k"), "text"
    )
    return T.spread(docs.union(talk), "k")


TEXTS = "tx AS (SELECT 'd' || doc_id AS k, text FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations)"


@query("E1_factor_codes", f"WITH {FACTS} SELECT id, array_to_string({CODES}, ',') AS codes FROM fx")
def factor_codes(spark, sf):
    return _facts(spark, sf).select("id", F.array_join(E.factor_codes(), ",").alias("codes"))


SELECTED = "CASE event_no % 3 WHEN 0 THEN ['device_reuse', 'rapid_succession', 'device_reuse'] WHEN 1 THEN ['merchant_volume', 'rapid_succession'] ELSE ['prior_denials_on_instrument'] END"
SELECTED_SPARK = "case event_no % 3 when 0 then array('device_reuse', 'rapid_succession', 'device_reuse') when 1 then array('merchant_volume', 'rapid_succession') else array('prior_denials_on_instrument') end"


def _unsupported(spark, sf):
    numbered = _facts(spark, sf).join(T.ledger(spark, sf).select("id", "event_no"), "id")
    f = numbered.withColumns({"entailed": E.factor_codes(), "selected": F.expr(SELECTED_SPARK)})
    return f.select(
        "id", F.array_join(E.unsupported_factors("selected", "entailed"), ",").alias("unsupported"),
        E.has_duplicates("selected").alias("duplicated"),
    )


UNSUPPORTED_SQL = f"""WITH {FACTS}, s AS (SELECT id, {SELECTED} AS sel, {CODES} AS codes FROM fx)
SELECT id, array_to_string(list_filter(CASE WHEN len(sel) = 3 THEN sel[1:2] ELSE sel END, lambda x: NOT list_contains(codes, x)), ',') AS unsupported,
  len(sel) = 3 AS duplicated FROM s"""
query("E2_unsupported_factors", UNSUPPORTED_SQL)(_unsupported)


@query("X5_factor_difference", UNSUPPORTED_SQL.replace(",\n  len(sel) = 3 AS duplicated", ""))
def factor_difference(spark, sf):
    return _unsupported(spark, sf).drop("duplicated")


def jbool(e: str) -> str:
    return f"CASE WHEN {e} THEN 'true' ELSE 'false' END"


FACTS_JSON = (
    """'{"action":"' || action || '","amount_subunits":' || amount_subunits || ',"available_factor_codes":[' || """
    f"""array_to_string(list_transform({CODES}, lambda c: '"' || c || '"'), ',')"""
    """ || '],"calibrated_probability":"' || CAST(calibrated_probability AS VARCHAR) || '","channel":"' || channel || '","currency":"' || currency
  || '","decision_threshold":"' || CAST(decision_threshold AS VARCHAR) || '","fail_safe_reason":' || coalesce('"' || fail_safe_reason || '"', 'null')
  || ',"ledger_co_occurrence":[' || """
    + " || ',' || ".join(
        f"""'{{"decision_count":' || {k}_decision_count || ',"denied_count":' || {k}_denied_count || ',"kind":"{k}","present":' || {jbool(f'{k}_present')}
  || ',"review_count":' || {k}_review_count || ',"span_seconds":' || coalesce(CAST({k}_span_seconds AS VARCHAR), 'null') || '}}'"""
        for k in KINDS
    )
    + """ || '],"probability_exceeds_threshold":' || """ + jbool("calibrated_probability >= decision_threshold")
    + """ || ',"risk_decision":"' || risk_decision || '"}'"""
)


@query("E3_explanation_facts", f"WITH {FACTS} SELECT id, {FACTS_JSON} AS facts, sha256({FACTS_JSON}) AS digest FROM fx")
def explanation_facts(spark, sf):
    return _facts(spark, sf).select("id", E.facts_json().alias("facts"), E.input_digest().alias("digest"))


def span_sql(k: str) -> str:
    s = f"{k}_span_seconds"
    return (
        f"CASE WHEN {s} IS NULL THEN [] ELSE [CAST({s} AS VARCHAR)] || CASE WHEN {s} >= 60 THEN [CAST({s} // 60 AS VARCHAR), CAST({s} % 60 AS VARCHAR)] ELSE [] END"
        f" || CASE WHEN {s} >= 3600 THEN [CAST({s} // 3600 AS VARCHAR), CAST(({s} % 3600) // 60 AS VARCHAR)] ELSE [] END END"
    )


PERMITTED = (
    "list_sort(list_distinct(list_transform([CAST(amount_subunits AS VARCHAR), (amount_subunits // 100) || '.' || lpad(CAST(amount_subunits % 100 AS VARCHAR), 2, '0'),"
    " CAST(calibrated_probability AS VARCHAR), CAST(CAST(calibrated_probability AS DECIMAL(38,18)) * 100 AS VARCHAR),"
    " CAST(decision_threshold AS VARCHAR), CAST(CAST(decision_threshold AS DECIMAL(38,18)) * 100 AS VARCHAR), "
    + ", ".join(f"CAST({k}_{c} AS VARCHAR)" for k in KINDS for c in ("decision_count", "denied_count", "review_count"))
    + "] || " + " || ".join(span_sql(k) for k in KINDS)
    + f", lambda x: {number_sql('x')})))"
)


@query("E4_permitted_numbers", f"WITH {FACTS} SELECT id, array_to_string({PERMITTED}, ' ') AS permitted FROM fx")
def permitted_numbers(spark, sf):
    return _facts(spark, sf).select("id", F.array_join(F.array_sort(E.permitted_numbers()), " ").alias("permitted"))


NUMERAL = r"\p{Nd}[\p{Nd},]*(?:[.]\p{Nd}+)?"
WORD = r"[\p{L}\p{N}_]+"
WORDS_SQL = (
    "['two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve', 'thirteen', 'fourteen', 'fifteen',"
    " 'sixteen', 'seventeen', 'eighteen', 'nineteen', 'twenty', 'thirty', 'forty', 'fifty', 'hundred', 'thousand']"
)
VALUES_SQL = (
    "['2', '3', '4', '5', '6', '7', '8', '9', '10', '11', '12', '13', '14', '15', '16', '17', '18', '19', '20', '30', '40', '50', '100', '1000']"
)


def unsupported_sql(text: str, allowed: str) -> str:
    numerals = f"list_transform(regexp_extract_all({text}, '{NUMERAL}'), lambda x: {number_sql('x')})"
    words = (
        f"list_transform(list_filter(list_distinct(regexp_extract_all(lower({text}), '{WORD}')), lambda x: list_contains({WORDS_SQL}, x)),"
        f" lambda x: {VALUES_SQL}[list_position({WORDS_SQL}, x)])"
    )
    return f"list_sort(list_distinct(list_filter({numerals} || {words}, lambda x: NOT list_contains({allowed}, x))))"


@query("E5_unsupported_numbers", f"WITH {TEXTS} SELECT k, array_to_string({unsupported_sql('text', ALLOWED)}, ' ') AS numbers FROM tx")
def unsupported_numbers(spark, sf):
    allowed = F.array(*[F.lit(v) for v in ("1", "2", "5", "10", "1000")])
    return _texts(spark, sf).select(
        "k", F.array_join(F.array_sort(E.unsupported_numbers("text", allowed)), " ").alias("numbers")
    )


# The shapes and fragments once more, for the checks.
SHAPES = (
    "(evt|mrc|chk|cus|dev|net|ses|pmt)_[0-9a-f]{32}",
    r"<[\s]*[a-zA-Z/!]", r"(?i)javascript[\s]*:", r"(?i)data[\s]*:[\s]*[a-z]+/", "&#[0-9]",
    r"(^|[^\p{Nd}.,])[0-9]{13,19}([^\p{Nd}.,]|$)",
    r"(^|[^\p{Nd}.,])[+]?\p{Nd}[\p{Nd}\s\p{Z}-]{8,}\p{Nd}([^\p{Nd}.,]|$)",
    "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+",
)
FRAGMENTS = ("email", "cardholder", "card_number", "ip_address", "cvv", "@", "acquirer", "token_id")


def forbidden_sql(text: str) -> str:
    tests = [f"regexp_matches({text}, '{s}')" for s in SHAPES]
    tests += [f"contains(lower({text}), '{f}')" for f in FRAGMENTS]
    return "(" + " OR ".join(tests) + ")"


@query("E6_forbidden_content", f"WITH {TEXTS} SELECT k, {forbidden_sql('text')} AS forbidden FROM tx")
def forbidden_content(spark, sf):
    return _texts(spark, sf).select("k", E.forbidden_content("text").alias("forbidden"))


def mismatch_sql(text: str, currency: str) -> str:
    return f"(len(list_filter(regexp_extract_all({text}, '{WORD}'), lambda x: regexp_matches(x, '^[A-Z]{{3}}$') AND x <> {currency})) > 0)"


def contradiction_sql(text: str) -> str:
    return f"(len(list_filter(regexp_extract_all(lower({text}), '{WORD}'), lambda x: x IN ('approved', 'allowed'))) > 0)"


@query("E7_currency_and_contradiction", f"WITH {TEXTS} SELECT k, {mismatch_sql('text', chr(39) + 'INR' + chr(39))} AS currency_mismatch, {contradiction_sql('text')} AS contradiction FROM tx")
def currency_and_contradiction(spark, sf):
    return _texts(spark, sf).select(
        "k", E.currency_mismatch("text", F.lit("INR")).alias("currency_mismatch"),
        E.contradiction("text", F.lit("deny")).alias("contradiction"),
    )


@query(
    "E8_length_bounds",
    f"WITH {TEXTS} SELECT k, length(text) < 20 OR length(text) > 400 OR strlen(text) > 4096 AS malformed FROM tx",
)
def length_bounds(spark, sf):
    t = _texts(spark, sf).withColumns({"caveat": F.lit(""), "factors": F.array(F.lit("device_reuse"))})
    return t.select("k", E.malformed("text", "caveat", "factors").alias("malformed"))


# One draft per denial, in eight shapes: sound, and one for each way to fail.
SUMMARY = """CASE event_no % 8
  WHEN 0 THEN 'Score ' || CAST(calibrated_probability AS VARCHAR) || ' met the threshold for ' || amount_subunits || ' subunits.'
  WHEN 1 THEN 'The score was roughly 61.7 percent at this merchant.'
  WHEN 2 THEN 'The decision on ' || id || ' of evt_' || repeat('0', 32) || ' stands.'
  WHEN 3 THEN 'This attempt in USD met the locked threshold.'
  WHEN 4 THEN 'This attempt was approved after it met the threshold.'
  WHEN 5 THEN 'This attempt met the locked threshold for denial.'
  WHEN 6 THEN 'Too short.'
  ELSE 'This entity was seen on seven hundred occasions.' END"""
FACTOR_PICK = "CASE WHEN event_no % 8 = 5 THEN ['merchant_volume', 'merchant_volume'] ELSE ['probability_at_or_above_threshold'] END"


@query(
    "E9_screen_explanations",
    f"""WITH {FACTS}, dr AS (SELECT *, {SUMMARY} AS summary, {FACTOR_PICK} AS factors, {PERMITTED} AS permitted, {CODES} AS codes FROM fx)
SELECT id, CASE WHEN length(summary) < 20 OR length(summary) > 400 THEN 'malformed_response'
  WHEN len(factors) = 2 OR len(list_filter(factors, lambda x: NOT list_contains(codes, x))) > 0 THEN 'unsupported_factor'
  WHEN {forbidden_sql('summary')} THEN 'forbidden_content' WHEN {mismatch_sql('summary', 'currency')} THEN 'unsupported_number'
  WHEN {contradiction_sql('summary')} THEN 'contradicts_decision'
  WHEN len({unsupported_sql('summary', 'permitted')}) > 0 THEN 'unsupported_number' END AS reason FROM dr
UNION ALL SELECT id, 'malformed_response' FROM ledger WHERE id NOT IN (SELECT id FROM fx)""",
)
def screen_explanations(spark, sf):
    known = _facts(spark, sf)
    text = SUMMARY.replace("||", "concat_op").replace("CAST(calibrated_probability AS VARCHAR)", "string(calibrated_probability)")
    text = text.replace("concat_op", "||").replace("amount_subunits ||", "string(amount_subunits) ||")
    drafts = T.ledger(spark, sf).select(
        "id", F.expr(text).alias("summary"), F.lit("").alias("caveat"),
        F.expr(
            "if(event_no % 8 = 5, array('merchant_volume', 'merchant_volume'), array('probability_at_or_above_threshold'))"
        ).alias("factors"),
    )
    return E.screen_explanations(drafts, known)


WORDING = (
    "risk at or above the locked threshold", "device reused across decisions", "network reused across decisions",
    "instrument reused across decisions", "elevated merchant volume in window", "prior denials on this device",
    "prior denials on this network", "prior denials on this instrument", "decisions in rapid succession",
)
LABELS = "[" + ", ".join(f"'{v}'" for v in WORDING) + "]"
NAMES = "[" + ", ".join(f"'{c}'" for c, _ in SUPPORT) + "]"


@query("E11_render_factors", f"WITH {FACTS} SELECT id, array_to_string(list_transform({CODES}, lambda c: {LABELS}[list_position({NAMES}, c)]), '; ') AS labels FROM fx")
def render_factors(spark, sf):
    f = _facts(spark, sf).withColumn("codes", E.factor_codes())
    return f.select("id", F.array_join(E.render_factors("codes"), "; ").alias("labels"))
