"""Operator 2: mixing sources to target weights by temperature.

A source with n tokens gets a weight proportional to n ** exponent. Exponent 1 keeps the natural
shares, 0 makes all sources equal. The exponent is bisected on a grid of 1/1024 to the lowest one
that keeps every source within ``max_repeats`` passes, or to the highest one whose mixture has at
least ``target_entropy`` (in nats). The token budget is given, or is the least that reads every source
once in full, so that no document is lost; each source's part of it is its weight's.

The budget is met by block permutations: a source's documents are dealt by hash into blocks of about
``BLOCK_DOCS``; each epoch orders the blocks, and the documents in each, anew by hashes. A document
starts at a token of its source's stream and is in the mixture if that lies below the budget, so the
last epoch is cut off at a document. Sorting by ``mix_key`` (start over budget) interleaves the sources such that
every stretch has the weights.

Everything is DataFrame functions. A hot source is many blocks: running sums go over one block and
over one source's block totals only. The source table is broadcast up to ``BROADCAST_SOURCES`` rows.

Defined cases: null sources are one source; null and empty texts have 0 tokens and are read with
their block; a source without any tokens is read once; empty tables give empty results. Each of
several equal rows is a document; ``mixed`` gives them the same number of copies, rounded up.
An unreachable limit gives exponent 1, an unreachable entropy exponent 0. Result columns of ``plan``
are its own; ``mixed`` keeps the input's columns, extra ones too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardweir.llm.common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
GRID = 1024
BLOCK_DOCS = 1024
BROADCAST_SOURCES = 100_000
MAX_REPEATS = 2.0
SEED = "mix"


@dataclass(frozen=True)
class Target:
    """One of the two limits, and the budget in tokens (none: the least that reads every source once)."""

    max_repeats: float | None = MAX_REPEATS
    target_entropy: float | None = None
    budget: int | None = None


def _narrow(docs: DataFrame) -> DataFrame:
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", F.xxhash64("text").alias("text_key"), n.alias("n_tokens"))


def choose_exponent(sources: DataFrame, target: Target) -> int:
    """The exponent in 1/1024, by bisection; each step aggregates the sources to one row."""
    full = sources.filter("n > 0")
    ends = full.agg(F.min("n").alias("low"), F.max("n").alias("high")).first()
    if ends.low is None:
        return GRID

    def holds(k: int) -> bool:
        power = k / GRID
        share = F.pow(F.col("n") / F.lit(float(ends.high)), F.lit(power))
        r = full.agg(F.sum(share).alias("z"), F.sum(share * F.log(share)).alias("h")).first()
        if target.target_entropy is not None:
            import math

            return math.log(r.z) - r.h / r.z >= target.target_entropy
        if target.budget is None:
            return (ends.high / ends.low) ** (1 - power) <= target.max_repeats
        return target.budget * (ends.low / ends.high) ** power / r.z / ends.low <= target.max_repeats

    rising = target.target_entropy is None  # holds from some exponent on; else up to one
    low, high = 0, GRID
    while low < high:
        if rising:
            k = (low + high) // 2
            low, high = (low, k) if holds(k) else (k + 1, high)
        else:
            k = (low + high + 1) // 2
            low, high = (k, high) if holds(k) else (low, k - 1)
    return low


def source_budgets(docs: DataFrame, target: Target, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes, and each source's tokens, documents, blocks, exponent and budget."""
    sizes = scratch.write(_narrow(docs), "sizes")
    sources = scratch.write(sizes.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs")), "sources")
    k = choose_exponent(sources, target)
    power = F.lit(k / GRID)
    top = sources.agg(F.max("n").alias("high"), F.count(F.lit(1)).alias("sources")).first()
    if target.budget is None:
        repeats = F.pow(F.lit(float(top.high or 0)) / F.col("n"), 1 - power)
    else:
        z = sources.filter("n > 0").agg(F.sum(F.pow(F.col("n") / F.lit(float(top.high or 1)), power)).alias("z")).first().z
        repeats = F.lit(float(target.budget)) * F.pow(F.col("n") / F.lit(float(top.high or 1)), power) / F.lit(z) / F.col("n")
    budget = F.when(F.col("n") > 0, F.round(F.col("n") * repeats).cast("long")).otherwise(0)
    blocks = F.ceil(F.col("docs") / BLOCK_DOCS)
    out = sources.select(F.col("source").alias("s"), "n", blocks.alias("blocks"), budget.alias("budget"), power.alias("exponent"))
    return sizes, F.broadcast(out) if top.sources <= BROADCAST_SOURCES else out


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


def plan(docs: DataFrame, target: Target = Target()) -> DataFrame:
    """A row for each document and epoch that the mixture reads, with its place in its source's stream."""
    return _plan(docs, target).drop("text_key")


def _plan(docs: DataFrame, target: Target) -> DataFrame:
    sizes, sources = source_budgets(docs, target, Scratch(docs.sparkSession, "mixing"))
    rows = sizes.join(sources, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    block = F.pmod(F.conv(F.substring(_hash(F.col("doc_id")), 1, 8), 16, 10).cast("long"), F.col("blocks"))
    epochs = F.when(F.col("n") > 0, F.greatest(F.ceil(F.col("budget") / F.col("n")), F.lit(1))).otherwise(1)
    rows = rows.withColumn("block", block).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), epochs - 1)))

    order = [_hash(F.col("epoch"), F.col("doc_id")), F.col("doc_id"), F.col("n_tokens"), F.col("text_key")]
    local = Window.partitionBy("source", "block", "epoch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("n_tokens").over(local), F.lit(0)))

    totals = rows.groupBy("source", "block", "epoch").agg(F.sum("n_tokens").alias("t"))
    stream = Window.partitionBy("source", "epoch").orderBy(_hash(F.col("epoch"), F.col("source"), F.col("block")), "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("s"), F.col("block").alias("b"), F.col("epoch").alias("e"), F.coalesce(F.sum("t").over(stream), F.lit(0)).alias("offset"))
    on = F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")) & (F.col("epoch") == F.col("e"))
    start = F.col("epoch") * F.col("n") + F.col("offset") + F.col("before")
    out = placed.join(offsets, on).withColumn("start_token", start)
    out = out.filter((F.col("start_token") < F.col("budget")) | ((F.col("n_tokens") == 0) & (F.col("epoch") == 0)))
    key = F.when(F.col("budget") > 0, F.col("start_token") / F.col("budget")).otherwise(0.0)
    return out.select("doc_id", "text_key", "source", "n_tokens", "epoch", "block", "start_token", "budget", "exponent", key.alias("mix_key"))


def mixed(docs: DataFrame, target: Target = Target()) -> DataFrame:
    """The documents of the mixture with their own columns; a document read in several epochs has several rows."""
    copies = _plan(docs, target).groupBy("doc_id", "source", "text_key").agg(F.count(F.lit(1)).alias("_reads"))
    key = ["doc_id", "source", "text_key"]
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("text_key")).groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
    copies = copies.join(rows, [copies[c].eqNullSafe(rows[c]) for c in key]).select(
        copies.doc_id.alias("_d"), copies.source.alias("_s"), copies.text_key.alias("_k"), F.ceil(F.col("_reads") / F.col("_rows")).cast("int").alias("_copies")
    )
    on = docs.doc_id.eqNullSafe(F.col("_d")) & docs.source.eqNullSafe(F.col("_s")) & (F.xxhash64(docs.text) == F.col("_k"))
    out = docs.join(copies, on).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return out.select([docs[c] for c in docs.columns])
