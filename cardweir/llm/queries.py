"""The registered queries of the operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cardweir.session import use_utc
from cardweir.sources.tables import table

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def wrap(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(use_utc(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op7_quality_classifier")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardweir.llm.quality_classifier import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op4_jaccard_join",
    r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles
  FROM w
), n AS (SELECT doc_id, len(shingles) AS n FROM s),
e AS (SELECT doc_id, unnest(shingles) AS g FROM s),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other
)
SELECT n.doc_id, any_value(n.n) AS n_shingles, min(r.other) AS component_id FROM n JOIN reach r USING (doc_id) GROUP BY n.doc_id
""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardweir.llm.jaccard_join import near_components

    return near_components(table(spark, sf_dir, "documents"))


def _op9_sql() -> str:
    # The patterns are written out once more here; DuckDB has no positions of matches, so they come
    # from the lengths of matches and gaps as well, but the links from plain distances.
    assign = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    kinds = {
        "assign": (assign, 2),
        "access": (r"AKIA[A-Z0-9]+", 0),
        "hex": (r"[0-9a-f]{32,}", 0),
        "key": (r"[A-Za-z0-9+/]{40,}", 0),
        "endpoint": (r"""(?:https?|s3|ftp|jdbc:[a-z]+|amqps?|redis|postgres|mysql|mongodb)://[^\x20\x09-\x0D"''<>]+""", 0),
    }
    parts = [
        f"""SELECT doc_id, '{k}' AS kind, {r} AS rank, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(p) AS p, unnest(g[:len(m)]) AS g
        FROM (SELECT doc_id, regexp_extract_all(text, '{e}', 0) AS m, regexp_extract_all(text, '{e}', {n}) AS p, string_split_regex(text, '{e}') AS g FROM documents) WHERE len(m) > 0"""
        for r, (k, (e, n)) in enumerate(kinds.items(), 1)
    ]
    return f"""
WITH found AS ({" UNION ALL ".join(parts)}),
placed AS (
  SELECT doc_id, kind, rank, length(m) AS l, length(p) AS lp, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM found
), kept AS (
  SELECT doc_id, kind, rank, CAST(e - l AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM placed
  WHERE CASE kind WHEN 'assign' THEN lp >= 8 WHEN 'access' THEN l >= 16 WHEN 'key' THEN l = 40 ELSE true END
), spans AS (
  SELECT * FROM kept WHERE rank <= 3
  UNION ALL
  SELECT * FROM kept w WHERE rank > 3 AND EXISTS (
    SELECT 1 FROM kept c WHERE c.doc_id = w.doc_id AND (c.kind = 'access' OR (c.kind = 'assign' AND w.kind = 'endpoint')) AND w.s <= c.e + 400 AND w.e >= c.s - 400)
), lists AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank <= 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN lists USING (doc_id)
"""


@query("op9_secrets", _op9_sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardweir.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents"))


@query(
    "op2_mixing",
    r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents
), sources AS (
  SELECT source, CAST(sum(n_tokens) AS BIGINT) AS n, count(*) AS docs, CAST(ceil(count(*) / 1024) AS BIGINT) AS blocks FROM sizes GROUP BY source
), ends AS (SELECT min(n) AS low, max(n) AS high FROM sources WHERE n > 0),
exponent AS (
  SELECT min(k) AS k FROM ends, range(0, 1025) g(k) WHERE k = 1024 OR pow(high / low, 1 - k / 1024) <= 2.0
), budgets AS (
  SELECT source, n, blocks, k / 1024 AS exponent, CASE WHEN n > 0 THEN CAST(round(n * pow(high / n, 1 - k / 1024)) AS BIGINT) ELSE 0 END AS budget
  FROM sources, ends, exponent
), rows_ AS (
  SELECT doc_id, source, n_tokens, n, budget, exponent, CAST('0x' || substr(md5('mix|' || doc_id), 1, 8) AS UBIGINT) % blocks AS block,
    unnest(range(0, CASE WHEN n > 0 THEN greatest(CAST(ceil(budget / n) AS BIGINT), 1) ELSE 1 END)) AS epoch
  FROM sizes JOIN budgets USING (source)
), placed AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source, block, epoch ORDER BY md5('mix|' || epoch || '|' || doc_id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM rows_
), totals AS (SELECT source, block, epoch, sum(n_tokens) AS t FROM rows_ GROUP BY ALL),
offsets AS (
  SELECT source, block, epoch, coalesce(sum(t) OVER (PARTITION BY source, epoch ORDER BY md5('mix|' || epoch || '|' || source || '|' || block) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o
  FROM totals
), starts AS (SELECT *, CAST(epoch * n + o + before AS BIGINT) AS start_token FROM placed JOIN offsets USING (source, block, epoch))
SELECT doc_id, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(epoch AS BIGINT) AS epoch, CAST(block AS BIGINT) AS block, start_token, budget, exponent,
  CASE WHEN budget > 0 THEN start_token / budget ELSE 0.0 END AS mix_key
FROM starts WHERE start_token < budget OR (n_tokens = 0 AND epoch = 0)
""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardweir.llm.mixing import plan

    return plan(table(spark, sf_dir, "documents"))


@query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardweir.llm.packing import pack_documents
    from cardweir.llm.tokens import MANY

    return pack_documents(table(spark, sf_dir, "documents"), remembered=MANY)


@query("op5_token_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardweir.llm.token_files import token_file_rows

    return token_file_rows(table(spark, sf_dir, "documents"))


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardweir.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op1_substring_dedup",
    r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(words) - 11)) AS i, words FROM w WHERE len(words) >= 13),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS s FROM p),
f AS (SELECT s, min(doc_id) AS low FROM g GROUP BY s),
marked AS (SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 13)) AS i FROM g JOIN f ON f.s = g.s AND f.low < g.doc_id),
gone AS (SELECT doc_id, list(i) AS places, count(*) AS n FROM marked GROUP BY doc_id),
flat AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
kept AS (SELECT flat.doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM flat ANTI JOIN marked USING (doc_id, i) GROUP BY flat.doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardweir.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardweir.llm.language_id import languages

    return languages(table(spark, sf_dir, "documents"))


@query(
    "op8_topk_search",
    r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), c AS (SELECT count(*) AS n, sum(len(words)) / count(*) AS mean FROM w),
t AS (SELECT doc_id, len(words) AS l, unnest(words) AS term FROM w),
tf AS (SELECT doc_id, l, term, count(*) AS tf FROM t GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
i AS (
  SELECT doc_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean)) AS s FROM tf JOIN df USING (term), c
), scored AS (
  SELECT q.doc_id AS query_id, i.doc_id, round(sum(s), 6) AS score FROM tf q JOIN i USING (term) WHERE q.doc_id % 20 = 0 GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardweir.llm.topk_search import search_all

    return search_all(table(spark, sf_dir, "documents"))


@query("op11_token_counts")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardweir.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


@query(
    "op12_lexical_scan",
    r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), c AS (SELECT count(*) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS total FROM w WHERE len(words) > 0),
t AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n, unnest(words) AS term FROM w),
i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), asked AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM t GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (
  SELECT a.item_id, tf.doc_id,
    CAST(sum(times * CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // total)))) AS BIGINT) AS score
  FROM asked a JOIN tf USING (term) JOIN df USING (term), c GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cardweir.llm.lexical_scan import search_items

    return search_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op13_hard_negatives",
    r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS alike, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT a, b, score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) AS INTEGER) AS rank,
  n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.alike AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) <= 5
""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from cardweir.llm.hard_negatives import mine, quantised, usable

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").filter(usable("embedding"))
    return mine(rows.select("vec_id", label.alias("label"), quantised("embedding").alias("q")))
