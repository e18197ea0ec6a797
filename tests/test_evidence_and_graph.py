import random

import pytest
from pyspark.sql import functions as F

from cardweir.functions.text import duration_parts, normalise_key, normalise_number
from cardweir.operators import evidence as E
from cardweir.operators import graph as G
from cardweir.operators import ledger as L
from cardweir.operators import quality as Q

LEDGER = (
    "id string, event_id string, event_no long, action string, risk_decision string, status string, fail_safe_reason string,"
    " calibrated_probability decimal(20,18), decision_threshold decimal(20,18), amount_subunits long, currency string, channel string,"
    " occurred_at_ms long, created_at_ms long, device_token string, network_token string, payment_instrument_token string, merchant_id string"
)


def decisions(spark, rows):
    """(n, t seconds, action, device, network, instrument)"""
    from decimal import Decimal

    return spark.createDataFrame([
        (f"dec_{n}", f"evt_{n}", n, action, "deny" if action == "deny" else "allow", "final", None, Decimal("0.007053679692244301"),
         Decimal("0.003386294915518273"), 25_000, "INR", "web", None if n % 4 == 3 else t * 1000, t * 1000, device, network, instrument, "m")
        for n, t, action, device, network, instrument in rows
    ], LEDGER)


SEED = [(1, 0, "deny", "d", "w", "i1"), (2, 60, "deny", "d", "w", "i2"), (3, 120, "review", "d", "w", "i3"),
        (4, 201, "allow", "d", "w", "i4"), (5, 300, "allow", None, "x", "i5")]


def test_graph_seed(spark):
    df = decisions(spark, SEED)
    assert {(r.kind, r.token, r.degree) for r in G.hubs(df).collect()} == {("device", "d", 4), ("network", "w", 4)}
    assert G.edges(df).count() == 8
    nodes = {r.node_id: r for r in G.nodes(df).collect()}
    assert len(nodes) == 6 and nodes["device:d"].shared_kinds == 1 and nodes["event:dec_1"].degree == 2
    assert nodes["event:dec_3"].action == "review"
    assert {r.cluster_id for r in G.clusters(df).collect()} == {"device:d"}


def test_one_network_on_all_rows_with_hot_labels(spark):
    rng = random.Random(9)
    rows = [(n, n, "allow", f"d{rng.randrange(60)}", "w", f"i{rng.randrange(90)}") for n in range(150)]
    rows += [(500 + n, n, "allow", f"x{n // 2}", None, f"y{n // 3}") for n in range(40)]
    df = decisions(spark, rows)
    plain = {r.hub_id: r.cluster_id for r in G.clusters(df).collect()}
    hot = {r.hub_id: r.cluster_id for r in G.clusters(df, share=0.01, minimum_rows=0).collect()}
    assert hot == plain and len({c for h, c in plain.items() if h[7:8] != "x" and "y" not in h}) == 1 and len(set(plain.values())) > 3


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_union_find(spark, seed):
    rng = random.Random(seed)
    rows = [(n, n, "allow", f"d{rng.randrange(40)}", f"w{rng.randrange(60)}", f"i{rng.randrange(70)}") for n in range(70)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    used = {}
    for r in rows:
        for kind, token in zip(("device", "network", "instrument"), r[3:]):
            used.setdefault(f"{kind}:{token}", []).append(r[0])
    hubs = {h for h, ids in used.items() if len(ids) > 1}
    for r in rows:
        own = [h for h in (f"device:{r[3]}", f"network:{r[4]}", f"instrument:{r[5]}") if h in hubs]
        for h in own[1:]:
            a, b = find(own[0]), find(h)
            parent[max(a, b)] = min(a, b)
    got = {r.hub_id: r.cluster_id for r in G.clusters(decisions(spark, rows)).collect()}
    groups = {}
    for h in hubs:
        groups.setdefault(find(h), set()).add(h)
    assert got == {h: min(g) for g in groups.values() for h in g}


def test_context_excludes_self_by_id(spark):
    df = decisions(spark, SEED)
    with_self = {(r.id, r.kind): r for r in L.entity_context(df, False).collect()}
    without = {(r.id, r.kind): r for r in L.entity_context(df, True).collect()}
    assert len(with_self) == len(without) == 20
    for key, row in with_self.items():
        assert without[key].decision_count == max(row.decision_count - 1, 0)
    first = without[("dec_1", "device")]
    assert (first.decision_count, first.denied_count, first.first_seen_ms, first.last_seen_ms, first.span_seconds) == (3, 1, 60_000, 201_000, 141)
    assert without[("dec_5", "device")].token is None and without[("dec_5", "instrument")].first_seen_ms is None


def screened(spark, summary, caveat="", factors=("probability_at_or_above_threshold",)):
    known = E.facts(decisions(spark, SEED))
    drafts = spark.createDataFrame([("dec_1", summary, caveat, list(factors))], "id string, summary string, caveat string, factors array<string>")
    return E.screen_explanations(drafts, known).first().reason


@pytest.mark.parametrize("summary,reason", [
    ("The score 0.007053679692244301 met the threshold.", None),
    ("The score 0.7053679692244301 percent met the threshold.", None),
    ("The score of about 0.0071 met the threshold.", "unsupported_number"),
    ("An amount of 250.00 on three devices in 2 minutes 21 seconds.", None),
    ("An amount of 250.00 seen on nine other devices.", "unsupported_number"),
    ("Card 4111111111111111 was used on this attempt.", "forbidden_content"),
    ("Write to someone@example about this attempt.", "forbidden_content"),
    ("This USD attempt met the locked threshold.", "unsupported_number"),
    ("This attempt was Approved for the merchant.", "contradicts_decision"),
    ("Too short", "malformed_response"),
    ("<b>bold</b> text about this denied attempt", "forbidden_content"),
])
def test_screening(spark, summary, reason):
    assert screened(spark, summary) == reason


def test_factors(spark):
    codes = E.facts(decisions(spark, SEED)).withColumn("c", E.factor_codes()).filter("id = 'dec_1'").first().c
    assert codes == ["probability_at_or_above_threshold", "device_reuse", "network_reuse", "prior_denials_on_device",
                     "prior_denials_on_network", "rapid_succession"]
    fine = "This attempt met the locked threshold."
    assert screened(spark, fine, factors=("merchant_volume",)) == "unsupported_factor"
    assert screened(spark, fine, factors=("device_reuse", "device_reuse")) == "unsupported_factor"
    assert screened(spark, fine, factors=()) == "malformed_response"


def test_text_rules(spark):
    df = spark.createDataFrame([("ipAddress", "0,250.00", 3661), ("Card-Number ", "0070", 201), ("a", "0.0070", 59)], "k string, n string, s long")
    rows = df.select(normalise_key("k").alias("k"), normalise_number("n").alias("n"), duration_parts("s").alias("d")).collect()
    assert [r.k for r in rows] == ["ip_address", "card_number", "a"]
    assert [r.n for r in rows] == ["250", "70", "0.007"]
    assert [r.d for r in rows] == [["3661", "61", "1", "1", "1"], ["201", "3", "21"], ["59"]]


def test_sensitive_values_and_keys(spark):
    values = ["a@b.co", "a@b", "10.0.0.1", "::1", "fe80::1", "4111111111111", "1234", "12", "plain", "999.1.1.1"]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", Q.sensitive_value("v").alias("k"))
    assert {r.v: r.k for r in df.collect()} == {
        "a@b.co": "contact_shaped", "a@b": "contact_shaped", "10.0.0.1": "network_address", "::1": "network_address",
        "fe80::1": "network_address", "4111111111111": "pan_shaped", "1234": "cvv_shaped", "12": None, "plain": None, "999.1.1.1": None}
    doc = '{"a":[{"cardNumber":1,"x":"\\"email\\":"}],"billing address":{"b":2}}'
    keys = Q.prohibited_keys(spark.createDataFrame([(1, doc)], "i int, j string"), "j", "i").collect()
    assert {r.normalised for r in keys} == {"card_number", "billing_address"}


def test_pages_from_slices_equal_plain_pages(spark, sf, monkeypatch, uncoalesced):
    from cardweir.sources import tables as T

    ledger = T.ledger(spark, sf).repartition(5)
    index = L.PageIndex(ledger, action="allow")
    assert len(index.starts) > 1
    for limit, offset in ((50, 0), (7, 333), (500, index.total - 3), (50, index.total), (1, index.starts[1][1] - 1), (9, index.starts[1][1] - 4)):
        plain = [r.decision_id for r in L.ledger_page(ledger, limit, offset, action="allow").collect()]
        assert [r.decision_id for r in index.page(limit, offset).collect()] == plain
    plan = index.page(2, index.starts[1][1])._jdf.queryExecution().executedPlan().toString()
    assert "slice" in plan.split("PartitionFilters")[1][:80]
    want = L.ledger_page(ledger, 20, 150).collect()
    monkeypatch.setattr(L, "DEEP", 100)
    assert L.ledger_page(ledger, 20, 150).collect() == want
    assert L.ledger_page(ledger.limit(0), 20, 150).collect() == []


def test_context_of_targets_equals_that_of_all(spark):
    rng = random.Random(3)
    df = decisions(spark, [(n, n % 40, rng.choice(["deny", "allow", "review"]), rng.choice([None, "d1", "d2"]), f"w{rng.randrange(9)}", f"i{rng.randrange(30)}") for n in range(120)])
    targets = df.filter("action = 'deny'")
    ids = {r.id for r in targets.collect()}
    key = lambda r: tuple(sorted(r.asDict().items(), key=lambda x: x[0]))
    for own in (True, False):
        want = {key(r) for r in L.entity_context(df, own).collect() if r.id in ids}
        assert {key(r) for r in L.entity_context(df, own, targets).collect()} == want


def test_drafts_without_facts_are_refused(spark, sf):
    from cardweir.sources import tables as T

    known = E.facts(T.ledger(spark, sf))
    ids = [r.id for r in known.limit(2).collect()]
    drafts = spark.createDataFrame([(i, "x", "", ["device_reuse"]) for i in [*ids, "dec_unknown"]], "id string, summary string, caveat string, factors array<string>")
    got = {r.id: r.reason for r in E.screen_explanations(drafts, known).collect()}
    assert set(got) == {*ids, "dec_unknown"} and got["dec_unknown"] == "malformed_response"


def test_entities_of_some_ten_thousand_rows_are_joined_by_broadcast(spark):
    from cardweir.operators.joins import join_on_entity

    entities = spark.createDataFrame([("a", 60_000), ("b", 1)], "token string, n bigint")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, token string")
    joined = join_on_entity(rows, entities, ["token"], "n")
    assert "Union" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.id, r.n) for r in joined.collect()) == [(1, 60_000), (2, 1)]
