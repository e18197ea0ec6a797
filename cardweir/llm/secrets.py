"""Operator 9: secrets in whole texts, with multipart credentials linked by an interval join.

Three base kinds are reported wherever they match: assignments, access identifiers and hex runs. Two
weak kinds, 40-character keys and endpoints, are common in clean text and count only next to their
complement: a key in reach of an access identifier, an endpoint in reach of an identifier or an
assignment. Reach is ``scope`` code points within one document. Identifiers are laid into every bin of
``scope`` code points that they reach, weak candidates into every bin they touch, so two within reach
share a bin; the equality join on (document, bin) and the distance test are the interval join, and no
document pairs all its spans.

Everything is DataFrame functions: positions come from running sums over the lengths of matches and
of the gaps between them.

Defined cases: null and empty texts have no spans, and base_sha256 is that of the empty string; null
doc_ids and repeated rows are kept, each with its own spans; touching and overlapping spans of
different kinds are all reported; empty tables give empty results; extra columns stay in ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardweir.llm.common import Scratch

# The kinds in their order, their patterns and least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the leftmost match is a maximal run
KEY = r"[A-Za-z0-9+/]{40,}"  # kept if it is 40 long
ENDPOINT = r"""(?:https?|s3|ftp|jdbc:[a-z]+|amqps?|redis|postgres|mysql|mongodb)://[^\x20\x09-\x0D"'<>]+"""
KINDS = ("assign", "access", "hex", "key", "endpoint")
BASE = KINDS[:3]
LEAST_ASSIGNED, LEAST_ACCESS, KEY_LENGTH = 8, 16, 40
SCOPE = 400


def _lengths(parts: Column) -> Column:
    return F.transform(parts, F.length)


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """For each match the gap before it, its length and that of a group; a last entry without a match."""
    p = F.lit(pattern)
    gaps, whole = _lengths(F.split(text, p, -1)), _lengths(F.regexp_extract_all(text, p, F.lit(0)))
    part = _lengths(F.regexp_extract_all(text, p, F.lit(group))) if group else F.array().cast("array<int>")
    zipped = F.arrays_zip(gaps.alias("gap"), whole.alias("len"), part.alias("part"))
    return F.transform(zipped, lambda x: F.struct(x["gap"].alias("gap"), x["len"].alias("len"), x["part"].alias("part")))


def _key() -> list[Column]:
    """A row's document: its id and a hash of its text, as an id may stand on several texts."""
    return [F.col("doc_id"), F.xxhash64("text").alias("text_key")]


def _candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, kind, start, end) of all kinds, weak ones unlinked; once for equal rows."""
    t = F.col("text")
    strong = t.rlike(ASSIGN) | t.rlike(ACCESS)
    found = {
        "assign": _matches(t, ASSIGN, 2),
        "access": _matches(t, ACCESS),
        "hex": _matches(t, HEX),
        "key": F.when(t.rlike(ACCESS), _matches(t, KEY)),
        "endpoint": F.when(strong, _matches(t, ENDPOINT)),
    }
    rows = docs.filter(t.isNotNull()).select(*_key(), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), m.alias("m")) for k, m in found.items()])).alias("f"))
    rows = rows.filter(F.size("f.m") > 1).select("doc_id", "text_key", "f.kind", F.posexplode("f.m").alias("i", "x"))
    rows = rows.filter("x.len is not null").select("doc_id", "text_key", "kind", "i", "x.gap", "x.len", "x.part").dropDuplicates(["doc_id", "text_key", "kind", "i"])
    before = Window.partitionBy("doc_id", "text_key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum((F.col("gap") + F.col("len")).cast("long")).over(before)
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("len"))
    kept = (
        F.when(F.col("kind") == "assign", F.col("part") >= LEAST_ASSIGNED)
        .when(F.col("kind") == "access", F.col("len") >= LEAST_ACCESS)
        .when(F.col("kind") == "key", F.col("len") == KEY_LENGTH)
        .otherwise(True)
    )
    return rows.filter(kept).select("doc_id", "text_key", "kind", "start", "end")


def _linked(spans: DataFrame, scope: int) -> DataFrame:
    """Weak spans with a complement within ``scope`` code points."""
    reach = F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("end") + scope) / scope))
    strong = spans.filter(F.col("kind").isin("access", "assign")).select(
        F.col("doc_id").alias("d"), F.col("text_key").alias("k"), F.col("kind").alias("by"), F.col("start").alias("s"), F.col("end").alias("e"), F.explode(reach).alias("bin")
    )
    touched = F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("end") / scope))
    weak = spans.filter(F.col("kind").isin("key", "endpoint")).withColumn("own_bin", F.explode(touched))
    on = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")) & (F.col("own_bin") == F.col("bin"))
    near = (F.col("start") <= F.col("e") + scope) & (F.col("end") >= F.col("s") - scope)
    fits = (F.col("by") == "access") | (F.col("kind") == "endpoint")
    # a span is linked in several bins, and spans are distinct
    return weak.join(strong, on & near & fits, "left_semi").drop("own_bin").distinct()


def find_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, text_key, kind, start, end) of base spans and of linked weak ones."""
    # the rows are few and read three times; texts are searched once
    found = Scratch(docs.sparkSession, "secrets").write(_candidates(docs), "found")
    return found.filter(F.col("kind").isin(*BASE)).unionByName(_linked(found, scope))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _rank(kind: str) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col(kind))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Counts, digest and spans of each document."""
    one = F.struct(F.col("start"), _rank("kind").alias("rank"), F.col("end"), F.col("kind"))
    lists = find_spans(docs, scope).groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(one)).alias("all")).withColumnsRenamed({"doc_id": "d", "text_key": "k"})
    rows = docs.select(*_key())
    on = rows.doc_id.eqNullSafe(F.col("d")) & (rows.text_key == F.col("k"))
    all_ = F.coalesce(F.col("all"), F.array().cast(lists.schema["all"].dataType))
    out = rows.join(lists, on, "left").select("doc_id", all_.alias("all"))
    out = out.withColumn("base", F.filter("all", lambda x: x["rank"] <= len(BASE)))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in BASE], F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))


def redact(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``docs`` with every span replaced by ``[secret]``; n_chars, where present and set, follows the text.

    Overlapping and touching spans are replaced together.
    """
    spans = find_spans(docs, scope)
    by_doc = Window.partitionBy("doc_id", "text_key").orderBy("start", "end")
    before = F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce((F.col("start") > before).cast("int"), F.lit(1))
    marked = spans.withColumn("opens", opens).withColumn("no", F.sum("opens").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    merged = marked.groupBy("doc_id", "text_key", "no").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    gap = Window.partitionBy("doc_id", "text_key").orderBy("start")
    merged = merged.withColumn("from", F.coalesce(F.lag("end").over(gap), F.lit(0)))
    cuts = merged.groupBy(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).agg(F.sort_array(F.collect_list(F.struct("from", "start", "end"))).alias("_cuts"))
    text = F.col("text")
    piece = lambda c: F.concat(text.substr((c["from"] + 1).cast("int"), (c["start"] - c["from"]).cast("int")), F.lit("[secret]"))
    tail = text.substr((F.element_at("_cuts", -1)["end"] + 1).cast("int"), F.length(text))
    clean = F.when(F.col("_cuts").isNull(), text).otherwise(F.concat(F.array_join(F.transform("_cuts", piece), ""), tail))
    on = docs.doc_id.eqNullSafe(F.col("_d")) & (F.xxhash64(docs.text) == F.col("_k"))
    out = docs.join(cuts, on, "left").withColumn("_clean", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_cuts").isNull(), F.col("n_chars")).otherwise(F.length("_clean").cast(docs.schema["n_chars"].dataType)))
    return out.withColumn("text", F.col("_clean")).select(docs.columns)
