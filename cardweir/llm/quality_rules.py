"""Operator 10: quality rules as learned decision lists.

Statistics of whole texts are built-in functions. Rules come from labelled statistics by sequential
covering: on two thirds of the training rows a conjunction of thresholds grows by the condition with
the best information gain, on the other third its last conditions are pruned while that helps; an
accepted rule takes out what it covers and the next one is grown. A rule that is too weak on the
pruning rows ends the list. Thresholds are quantiles, so a step needs one histogram of (statistic, bin), a few
hundred rows whatever the corpus. The list is emitted as one ordered CASE expression.

Defined cases: null and empty texts have all statistics 0 and base_failed true; labels that are null
or not 0 or 1 and rows of the held-out fold are not learned from; with no bad or no good row the list
is empty and kept is the opposite of base_failed; repeated rows are judged alike; empty tables give
empty results. Windows are compared by 64-bit hashes within one text. Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardweir.llm.common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
LEAST_WORDS = 50
#: Bins of each statistic, conditions of a rule, rules of a list.
BINS, MOST_CONDITIONS, MOST_RULES = 32, 4, 12
#: A rule must reach this precision on the rows it is pruned on, and cover so many bad ones there.
LEAST_PRECISION, LEAST_COVERED = 0.97, 3

FEATURES = ("symbol_share", "duplicate_line_share", "repeat_share", "upper_share", "mark_share", "word_length", "digit_share", "words")


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool  # else: below
    threshold: float

    def column(self) -> Column:
        x = F.col(self.feature)
        return x >= self.threshold if self.at_least else x < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:g}"


Rule = tuple[Condition, ...]


def _less(text: Column, characters: str) -> Column:
    """How many of these characters a text has."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and the shares that rules are made of."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    word = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.translate(x, _SPACES, "") != "")
    rows = rows.select(
        "doc_id",
        (F.length("text") - _less(F.col("text"), _SPACES)).alias("word_chars"),
        _less(F.col("text"), SYMBOLS).alias("n_symbols"),
        _less(F.col("text"), _UPPER).alias("n_upper"),
        _less(F.col("text"), _LOWER).alias("n_lower"),
        _less(F.col("text"), "!?").alias("n_marks"),
        _less(F.col("text"), "0123456789").alias("n_digits"),
        lines.alias("lines"),
        F.transform(word, lambda w: F.xxhash64(w)).alias("h"),
    )
    # each array below is used more than once and so is computed once, in a projection of its own
    counts = [c for c in rows.columns if c not in ("lines", "h")]
    n = F.size("h")
    window = F.arrays_zip(F.slice("h", F.lit(1), F.greatest(n - 2, F.lit(0))).alias("a"), F.slice("h", 2, F.greatest(n - 2, F.lit(0))).alias("b"), F.slice("h", 3, F.greatest(n - 2, F.lit(0))).alias("c"))
    keyed = F.sort_array(F.transform(window, lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("k"), i.alias("i"))))
    rows = rows.select(*counts, n.cast("long").alias("n_words"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").cast("long").alias("n_lines"), keyed.alias("w"))
    counts += ["n_words", "n_dup_lines", "n_lines"]
    near = F.arrays_zip(
        F.col("w").alias("own"), F.concat(F.array(F.lit(None).cast("long")), F.col("w.k")).alias("last"), F.concat(F.slice(F.col("w.k"), F.lit(2), F.size("w")), F.array(F.lit(None).cast("long"))).alias("next")
    )
    found = F.filter(near, lambda x: x["own"].isNotNull() & ((x["own"]["k"] == x["last"]) | (x["own"]["k"] == x["next"])))
    rows = rows.select(*counts, F.sort_array(F.transform(found, lambda x: x["own"]["i"])).alias("p"))
    # words covered by windows at sorted places: 3 each, less what the next window covers again
    gaps = F.arrays_zip(F.col("p").alias("at"), F.slice("p", F.lit(2), F.greatest(F.size("p"), F.lit(1))).alias("next"))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda total, x: total + F.least(F.lit(3), F.coalesce(x["next"] - x["at"], F.lit(3))))
    rows = rows.select(*counts, covered.alias("n_repeat_words"))
    share = lambda x, of: F.col(x) / F.greatest(F.col(of), F.lit(1))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("n_symbols", "word_chars").alias("symbol_share"), share("n_dup_lines", "n_lines").alias("duplicate_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), (F.col("n_upper") / F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1))).alias("upper_share"),
        share("n_marks", "word_chars").alias("mark_share"), share("word_chars", "n_words").alias("word_length"), share("n_digits", "word_chars").alias("digit_share"),
        F.col("n_words").cast("double").alias("words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def in_training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


class _Learner:
    def __init__(self, statistics: DataFrame, labels: DataFrame) -> None:
        known = labels.filter(F.col("quality").isin(0, 1) & in_training(F.col("doc_id"))).select("doc_id", (F.col("quality") == 0).alias("bad"))
        fold = F.pmod(F.xxhash64("doc_id"), F.lit(3))
        self.scratch = Scratch(statistics.sparkSession, "rules")
        # texts that fail the base rules anyway are not what the list is for
        rows = statistics.filter(~base_failed()).join(known, "doc_id").select("bad", (fold > 0).alias("growing"), *FEATURES)
        self.rows = self.scratch.write(rows, "labelled")
        shares = [i / BINS for i in range(1, BINS)]
        # quantiles of the good and of the bad rows: bad ones are few
        cuts = self.rows.groupBy("bad").agg(*[F.percentile_approx(f, shares, 10_000).alias(f) for f in FEATURES]).collect()
        self.cuts = {f: sorted({float(x) for r in cuts for x in r[f]}) for f in FEATURES}
        self.both = len(cuts) == 2

    def histogram(self, rows: DataFrame) -> dict[str, list[tuple[int, int]]]:
        """(bad, good) rows in each bin of each statistic."""
        bins = F.array(*[F.struct(F.lit(f).alias("f"), self._bin(f).alias("b")) for f in FEATURES])
        counts = rows.select("bad", F.explode(bins).alias("x")).groupBy("x.f", "x.b").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"))
        out = {f: [(0, 0)] * (len(self.cuts[f]) + 1) for f in FEATURES}
        for r in counts.collect():
            out[r.f][r.b] = (r.bad, r.good)
        return out

    def _bin(self, feature: str) -> Column:
        cuts = F.array(*[F.lit(c) for c in self.cuts[feature]])
        return F.size(F.filter(cuts, lambda c: c <= F.col(feature)))

    def grow(self, left: DataFrame) -> Rule:
        rule: Rule = ()
        while len(rule) < MOST_CONDITIONS:
            rows = left
            for c in rule:
                rows = rows.filter(c.column())
            found = self.histogram(rows)
            bad, good = (sum(x[i] for x in found[FEATURES[0]]) for i in (0, 1))
            if not bad or not good:
                break
            best, gain = None, 0.0
            for f, bins in found.items():
                below = [0, 0]
                for i, cut in enumerate(self.cuts[f]):
                    below = [below[0] + bins[i][0], below[1] + bins[i][1]]
                    for at_least, (p, n) in ((False, below), (True, (bad - below[0], good - below[1]))):
                        if p and (g := p * (math.log2(p / (p + n)) - math.log2(bad / (bad + good)))) > gain + 1e-9:
                            best, gain = Condition(f, at_least, cut), g
            if best is None:
                break
            rule += (best,)
        return rule

    def prune(self, rule: Rule, left: DataFrame) -> tuple[Rule, int, int]:
        """The rule's best beginning on the pruning rows, with the bad and good rows it covers there."""
        aggs, whole = [], F.lit(True)
        for i, c in enumerate(rule):
            whole = whole & c.column()
            aggs += [F.count_if(whole & F.col("bad")).alias(f"p{i}"), F.count_if(whole & ~F.col("bad")).alias(f"n{i}")]
        r = left.agg(*aggs).first()
        worth = [((r[f"p{i}"] - r[f"n{i}"]) / max(1, r[f"p{i}"] + r[f"n{i}"]), r[f"p{i}"], -i) for i in range(len(rule))]
        i = -max(worth)[2]
        return rule[: i + 1], r[f"p{i}"], r[f"n{i}"]

    def learn(self) -> list[Rule]:
        rules: list[Rule] = []
        left = self.rows
        while self.both and len(rules) < MOST_RULES:
            rule = self.grow(left.filter("growing"))
            if not rule:
                break
            rule, bad, good = self.prune(rule, left.filter(~F.col("growing")))
            if bad < LEAST_COVERED or bad < LEAST_PRECISION * (bad + good):
                break
            rules.append(rule)
            left = left.filter(~covers(rule))
        self.scratch.drop(self.rows)
        return rules


def covers(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def learn_rules(statistics: DataFrame, labels: DataFrame) -> list[Rule]:
    return _Learner(statistics, labels).learn()


def first_rule(rules: list[Rule]) -> Column:
    """The text of the first rule that covers a row, else null."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(covers(rule), F.lit(" and ".join(map(str, rule)))).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics and verdict of each document; ``rule``: the learned rule that refused it."""
    statistics = Scratch(docs.sparkSession, "rules").write(text_statistics(docs), "statistics")
    rule = first_rule(learn_rules(statistics, labels))
    out = statistics.withColumn("base_failed", base_failed()).withColumn("rule", rule)
    kept = ~F.col("base_failed") & F.col("rule").isNull()
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "rule")
