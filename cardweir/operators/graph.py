"""Shared-token graph: hubs, edges, nodes and connected clusters of a ledger window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardweir.operators.joins import join_on_entity
from cardweir.operators.ledger import GRAPH_KINDS, entity_rows, since_window
from cardweir.operators.ordering import row_numbers
from cardweir.session import discard, materialise


def window_decisions(ledger: DataFrame, now_ms, seconds: int = 3_600) -> DataFrame:
    return since_window(ledger, now_ms, seconds, 60, 86_400)


def hubs(decisions: DataFrame) -> DataFrame:
    """Tokens carried by more than one decision of the window, with how many."""
    return (
        entity_rows(decisions, GRAPH_KINDS)
        .groupBy("kind", "token")
        .agg(F.count(F.lit(1)).alias("degree"))
        .filter("degree > 1")
        .select(F.concat_ws(":", "kind", "token").alias("hub_id"), "kind", "token", "degree")
    )


def edges(decisions: DataFrame, hub_rows: DataFrame | None = None) -> DataFrame:
    """event -> hub for every decision that carries a shared token. ``hub_rows``: the hubs, if they are written already."""
    hub_rows = materialise(hubs(decisions), "hubs") if hub_rows is None else hub_rows
    return (
        join_on_entity(entity_rows(decisions, GRAPH_KINDS), hub_rows, ["kind", "token"], "degree")
        .select(
            F.concat(F.lit("event:"), F.col("id")).alias("source"),
            F.col("hub_id").alias("target"),
            F.lit(1).alias("weight"),
            "id", "kind", "token",
        )
    )


def kinds_per_event(edge_rows: DataFrame) -> DataFrame:
    """The kinds a decision shares, as three flags (there are three graph kinds) and their number."""
    flags = [F.max(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"on_{k}") for k, _ in GRAPH_KINDS]
    total = sum((F.col(f"on_{k}") for k, _ in GRAPH_KINDS[1:]), F.col(f"on_{GRAPH_KINDS[0][0]}"))
    return edge_rows.groupBy("id").agg(*flags).withColumn("kinds", total)


def hub_shared_kinds(edge_rows: DataFrame) -> DataFrame:
    """Per hub: how many other kinds its decisions also share.

    Edges meet the three flags of their decision, then the flags are combined map-side per hub; no
    pair of edges is ever built. The edges are read twice: pass a written table.
    """
    joined = edge_rows.join(kinds_per_event(edge_rows), "id")
    others = [
        F.max(F.when(F.col("kind") != k, F.col(f"on_{k}")).otherwise(0)).alias(f"on_{k}")
        for k, _ in GRAPH_KINDS
    ]
    total = sum((F.col(f"on_{k}") for k, _ in GRAPH_KINDS[1:]), F.col(f"on_{GRAPH_KINDS[0][0]}"))
    return (
        joined.groupBy("target")
        .agg(*others)
        .select(F.col("target").alias("hub_id"), total.alias("shared_kinds"))
    )


def nodes(decisions: DataFrame) -> DataFrame:
    """Hub and event nodes with degree, shared kinds and action."""
    h = materialise(hubs(decisions), "hubs")
    e = materialise(edges(decisions, h), "edges")
    hub_nodes = h.join(hub_shared_kinds(e), "hub_id").select(
        F.col("hub_id").alias("node_id"), "kind", F.col("token").alias("label"),
        F.lit(None).cast("string").alias("action"), F.lit(None).cast("string").alias("decision_id"),
        F.col("degree").cast("long").alias("degree"), F.col("shared_kinds").cast("long").alias("shared_kinds"),
    )
    event_nodes = kinds_per_event(e).join(decisions.select("id", "event_id", "action"), "id").select(
        F.concat(F.lit("event:"), F.col("id")).alias("node_id"), F.lit("event").alias("kind"),
        F.col("event_id").alias("label"), F.coalesce("action", F.lit("review")).alias("action"),
        F.col("id").alias("decision_id"),
        F.col("kinds").cast("long").alias("degree"), F.col("kinds").cast("long").alias("shared_kinds"),
    )
    return hub_nodes.unionByName(event_nodes)


def graph_totals(decisions: DataFrame) -> DataFrame:
    clustered = hubs(decisions).agg(F.count(F.lit(1)).alias("n")).scalar()
    return decisions.agg(F.count(F.lit(1)).alias("decision_count")).withColumn(
        "clustered_entity_count", clustered
    )


def clusters(decisions: DataFrame, share: float = 1e-3, minimum_rows: int = 1_000_000) -> DataFrame:
    """(hub_id, cluster_id): connected components of hubs through shared decisions.

    Alternating large-star and small-star contraction: every round links nodes to the smallest
    label around them, so the number of rounds grows with the logarithm of the longest chain. Hubs are numbered
    in the order of their ids first, so a link is two long integers and the smallest number is the smallest id. Each
    round is written to the shared folder, which keeps the plan short and survives lost executors.

    A component that holds most hubs ends as one star: all its links meet at one label. Labels above ``share`` of the links, of
    which there are at most ``2 / share``, are broadcast with their smallest neighbour, so their links stay in the tasks they are in.
    """
    h = materialise(row_numbers(hubs(decisions), F.col("hub_id"), name="no"), "hubs")
    e = materialise(join_on_entity(entity_rows(decisions, GRAPH_KINDS), h, ["kind", "token"], "degree").select("id", "no"), "edges")
    # A star per decision: its hubs all point to the smallest, so no pair list is built.
    centre = e.groupBy("id").agg(F.min("no").alias("v"))
    links = materialise(e.join(centre, "id").select(F.col("no").alias("u"), "v").filter("u <> v").distinct(), "cluster-links")
    previous = None
    while True:
        for star in (_large_star, _small_star):
            before, links = links, materialise(star(links, share, minimum_rows), "cluster-links")
            discard(before)
        state = links.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if state == previous:
            break
        previous = state
    names = h.select("no", "hub_id")
    # every hub and the root it ends at; the roots' names are joined by number, many hubs to few roots
    rooted = names.join(links.select(F.col("u").alias("no"), "v"), "no", "left").withColumn("root", F.coalesce("v", "no"))
    roots = materialise(rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n")).join(names.select(F.col("no").alias("root"), F.col("hub_id").alias("cluster_id")), "root"), "roots")
    return join_on_entity(rooted, roots, ["root"], "n", share, minimum_rows).select("hub_id", "cluster_id")


def _neighbours(links: DataFrame, share: float, minimum_rows: int) -> DataFrame:
    """(a, b, m) for links seen from a: m is the smallest neighbour of a."""
    low = materialise(links.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "cluster-low")
    return join_on_entity(links, low, ["a"], "n", share, minimum_rows)


def _large_star(links: DataFrame, share: float, minimum_rows: int) -> DataFrame:
    """Every neighbour above a node points to the smallest of the node and its neighbours."""
    both_ways = links.selectExpr("inline(array(struct(u as a, v as b), struct(v as a, u as b)))")
    near = _neighbours(both_ways, share, minimum_rows)
    return near.filter("b > a").selectExpr("b as u", "least(a, m) as v").distinct()


def _small_star(links: DataFrame, share: float, minimum_rows: int) -> DataFrame:
    """A node and its neighbours below it all point to the smallest among them."""
    down = _neighbours(links.selectExpr("greatest(u, v) as a", "least(u, v) as b"), share, minimum_rows)
    return down.selectExpr("inline(array(struct(b as u, m as v), struct(a as u, m as v)))").filter("u <> v").distinct()
