"""Quality rules: text statistics, and decision lists learned from labelled statistics as Spark conditional expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import register
from .store import small_side, stored

MIN_WORDS = 50
MAX_REPEAT = 50            # per cent of the words
BINS = 32                  # quantile thresholds tried per statistic
MAX_RULES = 8
MAX_CONDITIONS = 4
MIN_COVER = 5              # labelled bad rows a rule must catch in its growing part
MIN_PRECISION = 0.9        # of a rule on the pruning part (a third of the labelled rows, by hash)
LABELS_AT_ONCE = 1_000_000  # labels up to which they are broadcast

SPLIT = "[ \\t\\n\\x0B\\f\\r]+"
STATISTICS = ("n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "shout_rate", "distinct_rate", "line_words", "comma_rate")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every whole text (null: none), one row per row: ``id``, the base counts and the statistics rules may use.

    Repeated three-word windows come from one sort of the window hashes of a text: equal neighbours are repeats, and a
    walk over their sorted places counts the words they cover.
    """
    t = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    filled = lambda c: F.filter(c, lambda x: x != "")
    w = t.select("id", "t", filled(F.split("t", SPLIT)).alias("w"), F.filter(F.split("t", "\n"), lambda x: F.rlike(x, F.lit("[^ \\t\\x0B\\f\\r]"))).alias("lines"))
    n = F.size("w")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(
        F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i")))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    count = lambda pattern: F.regexp_count("t", F.lit(pattern)).cast("long")
    s = w.select("id", n.cast("long").alias("n_words"), F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
                 count("[#*$%&|<>]").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.size("lines").alias("n_lines"), count("[A-Z]").alias("n_upper"), count("[0-9]").alias("n_digits"), count("[!?]").alias("n_shout"),
                 count("[.,]").alias("n_stops"), F.size(F.array_distinct("w")).alias("n_distinct"), F.sort_array(windows).alias("s"))
    last = F.size("s") - 1
    same = lambda k, j: F.coalesce(F.get("s", k)["h"] == F.get("s", j)["h"], F.lit(False))
    places = F.when(last >= 1, F.sort_array(F.filter(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.when(same(k, k - 1) | same(k, k + 1), F.get("s", k)["i"])),
                                                     lambda x: x.isNotNull()))).otherwise(F.array().cast("array<int>"))
    p = s.withColumn("p", places).drop("s")
    covered = F.aggregate("p", F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("sum")),
                          lambda a, x: F.struct(x.alias("last"), (a["sum"] + F.least(F.lit(3), x - a["last"])).alias("sum")))["sum"]
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return p.withColumn("n_repeat_words", covered).drop("p").select(
        "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("word_chars") / words).alias("mean_word"), (F.col("n_symbols") / words).alias("symbol_rate"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_rate"), (F.col("n_repeat_words") / words).alias("repeat_rate"),
        (F.col("n_upper") / chars).alias("upper_rate"), (F.col("n_digits") / chars).alias("digit_rate"), (F.col("n_shout") / words).alias("shout_rate"),
        (F.col("n_distinct") / words).alias("distinct_rate"), (F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1))).alias("line_words"), (F.col("n_stops") / words).alias("comma_rate"))


@dataclass(frozen=True)
class Condition:
    """``statistic >= threshold`` or ``statistic < threshold``."""

    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.statistic)
        return c >= self.threshold if self.above else c < self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.above else '<'} {self.threshold:g}"


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """What a further condition gains: covered bad rows times the growth of the log share."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p > 0 else 0.0


def learn(rows: DataFrame, names=STATISTICS) -> list[list[Condition]]:
    """An ordered list of conjunctions that tell bad rows (``bad`` 1) from good ones, by sequential covering.

    ``rows`` has ``id``, ``bad`` and the statistics. Thresholds are quantiles. Each step is one grouped count over the rows
    that are still uncovered and meet the rule so far, per statistic and bin, so the driver sees at most statistics × bins × 2 counts.
    A grown rule is cut back to its best prefix on the pruning part, and the list ends at the first rule that falls short there.
    """
    cuts = rows.agg(*[F.percentile_approx(c, [k / BINS for k in range(1, BINS)], 10_000).alias(c) for c in names]).first()
    steps = {c: sorted({float(x) for x in cuts[c] or ()}) for c in names}
    if not any(steps.values()):
        return []
    bin_of = lambda c: F.size(F.filter(F.array(*[F.lit(t) for t in steps[c]]), lambda t: t <= F.col(c))) if steps[c] else F.lit(0)
    part = (F.pmod(F.xxhash64("id", F.lit("prune")), F.lit(3)) == 0).alias("prune")
    table = stored(rows.select("bad", part, *names, *[bin_of(c).alias(f"b_{c}") for c in names]), "rule-rows")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(f"b_{c}").alias("bin")) for c in names])).alias("x")
    rules, uncovered = [], F.lit(True)
    for _ in range(MAX_RULES):
        rule: list[Condition] = []
        while len(rule) < MAX_CONDITIONS:
            here = table.filter(~F.col("prune") & uncovered & _all(rule)).select("bad", pairs).groupBy("x.statistic", "x.bin", "bad").count().collect()
            seen = {(r["statistic"], r["bin"], r["bad"]): r["count"] for r in here}
            total = [sum(v for (c, _, y), v in seen.items() if c == names[0] and y == k) for k in (0, 1)]
            if total[1] < MIN_COVER or total[0] == 0:
                break
            best, score = None, 1e-9
            for c in names:
                over = [total[0], total[1]]
                for k, t in enumerate(steps[c]):  # rows at or above threshold k are those of a bin beyond k
                    for y in (0, 1):
                        over[y] -= seen.get((c, k, y), 0)
                    for above in (True, False):
                        n, p = over if above else (total[0] - over[0], total[1] - over[1])
                        if p >= MIN_COVER and (g := _gain(p, n, total[1], total[0])) > score:
                            best, score = Condition(c, above, t), g
            if best is None:
                break
            rule.append(best)
        if not rule:
            break
        checks = [_all(rule[:k]) for k in range(1, len(rule) + 1)]
        sums = table.filter(F.col("prune") & uncovered).agg(*[F.sum(F.when(c & (F.col("bad") == y), 1).otherwise(0)).alias(f"s{k}_{y}") for k, c in enumerate(checks) for y in (0, 1)]).first()
        worth = [((sums[f"s{k}_1"] or 0) - (sums[f"s{k}_0"] or 0)) / max(1, (sums[f"s{k}_1"] or 0) + (sums[f"s{k}_0"] or 0)) for k in range(len(rule))]
        k = max(range(len(rule)), key=lambda j: (worth[j], -j))
        p, n = sums[f"s{k}_1"] or 0, sums[f"s{k}_0"] or 0
        if p == 0 or p / (p + n) < MIN_PRECISION:
            break
        rules.append(rule[:k + 1])
        uncovered = uncovered & ~_all(rules[-1])
    return rules


def decision(rules: list[list[Condition]]) -> Column:
    """The list as one conditional expression: number of the first rule that holds, 0 if none does."""
    out = F.lit(0)
    for k in reversed(range(len(rules))):
        out = F.when(_all(rules[k]), k + 1).otherwise(out)
    return out


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``id``, base counts, ``base_failed``, ``rule`` (first learned rule that holds, 0: none) and ``kept`` of every row.

    Base: fewer than MIN_WORDS words, or more than MAX_REPEAT per cent of the words in repeated three-word windows. Labels with null id or
    value count as none; of several labels of an id the smallest holds. Without labels of both kinds no rule is learned and only the base decides.
    Null text has no words. Null and repeated ids stay. The text is read once; learning works on the stored statistics.
    """
    stats = stored(statistics(docs, id_col, text_col), "quality-statistics")
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("good"))
    rows = stats.join(small_side(known, LABELS_AT_ONCE), "id").withColumn("bad", (F.col("good") <= 0).cast("int"))
    rules = learn(rows)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return stats.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), decision(rules).alias("rule")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rule") == 0))


@register("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality(docs, labels).withColumnRenamed("id", "doc_id")
