"""Mixing sources to target weights: token weights raked to marginals, then documents sampled by calibrated probabilities."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import register
from .store import small_side, stored

MARGINS = ("source", "lang", "topic")
ROUNDS = 5             # raking rounds of one job
MAX_JOBS = 8
TOLERANCE = 1e-6       # largest relative gap of a marginal
CELLS_AT_ONCE = 200_000  # cells up to which their factors are broadcast to the documents

# A number tempers the present shares (share to this power), a dictionary names weights; values that it doesn't name keep their present share.
TARGETS = {"source": 0.5, "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}, "topic": 0.7}
BUDGET = 0.6           # tokens to keep, as a share of all


def topic_of(text: Column) -> Column:
    """Kind of a text by its marks, the first that fits."""
    return (F.when(F.rlike(text, F.lit(r"(?i)licen[cs]e|copyright|all rights reserved")), "legal").when(F.rlike(text, F.lit(r"(\|[^|]*){8}")), "table")
            .when(F.rlike(text, F.lit(r"[\w.]@[\w.]")), "contact").when(F.rlike(text, F.lit(r"[{}=;]")), "code").otherwise("prose"))


def tokens_of(text: Column) -> Column:
    """Estimated tokens: a quarter of the UTF-8 bytes, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(text) / 4)).cast("long")


def _target(cells: DataFrame, dim: str, rule: float | dict) -> Column:
    """Wanted share of a cell's value of ``dim``, as an expression over its present share ``s_<dim>``."""
    share = F.col(f"s_{dim}")
    if isinstance(rule, dict):
        raw = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in rule.items() for x in kv]), F.coalesce(F.col(dim), F.lit("\0"))) if rule else F.lit(None), share)
    else:
        raw = F.pow(share, F.lit(float(rule)))
    total = cells.select(dim, f"s_{dim}").distinct().agg(F.sum(raw)).first()[0]
    return raw / F.lit(total)


def rake(cells: DataFrame, targets: dict = TARGETS) -> DataFrame:
    """Cells with ``weight``: their tokens scaled by iterative proportional fitting until every marginal has its target share.

    ``cells`` has one row per combination of the margins with ``tokens`` above zero. A round scales to each margin in turn, each one window
    sum over the cells. Marginals that cannot be met together (empty combinations) end after MAX_JOBS * ROUNDS rounds at the closest fit found,
    with a warning that names the gap.
    """
    total = cells.agg(F.sum("tokens")).first()[0]
    if not total:
        return cells.withColumn("weight", F.lit(0.0))
    w = cells
    for d in MARGINS:
        w = w.withColumn(f"s_{d}", F.sum("tokens").over(Window.partitionBy(d)) / F.lit(float(total)))
    w = stored(w, "mix-shares")
    w = stored(w.select(*cells.columns, *[_target(w, d, targets.get(d, 1.0)).alias(f"t_{d}") for d in MARGINS], F.col("tokens").cast("double").alias("weight")), "mix-targets")
    for _ in range(MAX_JOBS):
        for _ in range(ROUNDS):
            for d in MARGINS:
                w = w.withColumn("weight", F.col("weight") * F.col(f"t_{d}") * F.lit(float(total)) / F.sum("weight").over(Window.partitionBy(d)))
        w = stored(w, "mix-round")
        gap = F.lit(0.0)
        checked = w
        for d in MARGINS:
            checked = checked.withColumn(f"g_{d}", F.abs(F.sum("weight").over(Window.partitionBy(d)) / (F.col(f"t_{d}") * F.lit(float(total))) - 1))
            gap = F.greatest(gap, F.col(f"g_{d}"))
        left = checked.agg(F.max(gap)).first()[0]
        if left < TOLERANCE:
            break
    else:
        warnings.warn(f"raking ended after {MAX_JOBS * ROUNDS} rounds with a marginal {left:.3g} off its target share", stacklevel=2)
    return w.select(*cells.columns, "weight")


def _scale(cells: DataFrame, budget: float) -> float:
    """The factor c for which the tokens kept with probability min(1, c * weight / tokens) are expected to reach the budget."""
    c = 0.0
    while True:
        full = F.col("weight") * F.lit(c) >= F.col("tokens")
        r = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("part")).first()
        if not r["part"]:
            return c
        new = (budget - float(r["full"])) / r["part"]
        if new <= c * (1 + 1e-12):
            return max(c, new)
        c = new


def mix(docs: DataFrame, targets: dict = TARGETS, budget: float = BUDGET, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None) -> DataFrame:
    """All columns of ``docs`` with ``topic``, ``n_tokens``, ``probability``, ``sample_weight``, ``sampled`` and ``copies``.

    Token sums per source, language and topic are raked to the target marginals. A document is kept with probability min(1, c * raked / present
    tokens of its cell), where c spends the budget; ``sample_weight`` is what the cap at 1 leaves (1 elsewhere), so that weighted samples
    meet the marginals. ``copies`` says the same in whole rows: a sampled document is taken sample_weight times, its fraction drawn (0 if not sampled), so that scarce
    documents repeat and the copies meet the marginals unweighted. The budget counts each document once; copies come on top. The draw is a hash of seed, id and text: the same rows give the same sample wherever they lie.

    Null source, language or text count as values of their own (a null text is one token of prose). Rows equal in id and text are drawn alike. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    extra = ("topic", "n_tokens", "probability", "sample_weight", "sampled", "copies")
    base = docs.drop(*extra)
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), text), F.lit(1 << 40)) / F.lit(float(1 << 40))
    marks = stored(base.select(F.col("source"), F.col("lang"), (topic if topic is not None else topic_of(text)).alias("topic"), tokens_of(text).alias("n_tokens"), draw.alias("draw"),
                               *[F.col(c).alias(f"c_{k}") for k, c in enumerate(base.columns) if c != text_col], F.col(text_col).alias("c_text")), "mix-rows")
    cells = stored(marks.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "mix-cells")
    raked = rake(cells, targets)
    c = _scale(raked, budget * float(cells.agg(F.sum("tokens")).first()[0] or 0))
    wanted = F.lit(c) * F.col("weight") / F.col("tokens")
    factor = stored(raked.select(*[F.col(d).alias(f"k_{d}") for d in MARGINS], F.least(F.lit(1.0), wanted).alias("probability"), F.greatest(F.lit(1.0), wanted).alias("sample_weight")), "mix-factors")
    same = F.lit(True)
    for d in MARGINS:
        same = same & F.col(d).eqNullSafe(F.col(f"k_{d}"))
    out = marks.join(small_side(factor, CELLS_AT_ONCE), same)
    # a weight above 1 goes with a probability of 1, so the draw is still free to decide on the fraction
    copies = F.floor("sample_weight") + (F.col("draw") < F.col("sample_weight") - F.floor("sample_weight")).cast("long")
    sampled = F.col("draw") < F.col("probability")
    return out.select(*[F.col("c_text" if x == text_col else f"c_{k}").alias(x) for k, x in enumerate(base.columns)], "topic", "n_tokens", "probability", "sample_weight",
                      sampled.alias("sampled"), F.when(sampled, copies).otherwise(0).alias("copies"))


def sample(docs: DataFrame, **how) -> DataFrame:
    """The rows that ``mix`` draws, each as often as its ``copies``, with the columns of ``docs``: their token shares meet the targets without weights."""
    drawn = mix(docs, **how).filter("sampled").withColumn("_copy", F.explode(F.expr("sequence(1, copies)")))
    return drawn.select(docs.columns)


@register("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang"))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "sample_weight", "sampled", "copies")
