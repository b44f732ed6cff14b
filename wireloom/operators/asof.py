"""Time-band joins in linear work.

Each helper splits a key by time slices, so one hot key is spread over as many
tasks as it has slices, and no helper ever emits the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage

HOUR = 3_600_000_000
MINUTE = 60_000_000
PARTS = 16  # slices of a look-back horizon


def micros(col: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session time zone is."""
    c = F.col(col) if isinstance(col, str) else col
    seconds = (F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(c)) * 3600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")


def slice_of(us: Column, length: int) -> Column:
    return F.floor(us / F.lit(float(length))).cast("long")


def previous_within(df: DataFrame, keys: Sequence[str], us: str, tie: str, horizon: int, carry: Sequence[str],
                    out: str = "prev", among: Column | None = None) -> DataFrame:
    """Latest earlier row of the same key at most ``horizon`` microseconds before, as struct ``out`` (or null).

    ``among`` limits which rows can be found. A slice is a part of the horizon, so a key that fills one window of time
    is sorted in many tasks: the running maximum inside a slice comes first, and where that finds nothing, the last
    row of the slices before, which are one row each.
    """
    cut = df.withColumn("_slice", slice_of(F.col(us), max(horizon // PARTS, 1)))
    item = F.struct(F.col(us).alias("us"), F.col(tie).alias("tie"), *[F.col(c) for c in carry])
    item = item if among is None else F.when(among, item)
    before = W.partitionBy(*keys, "_slice").orderBy(us, tie).rowsBetween(W.unboundedPreceding, -1)
    inside = cut.withColumn("_in", F.last(item, ignorenulls=True).over(before))
    ends = cut.groupBy(*keys, "_slice").agg(F.max_by(item, F.when(item.isNotNull(), F.struct(us, tie))).alias("_end"))
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    tails = ends.withColumn("_tail", F.last("_end", ignorenulls=True).over(earlier)).drop("_end")
    best = F.coalesce("_in", "_tail")
    return (
        inside.join(tails, [*keys, "_slice"], "left")
        .withColumn(out, F.when(best["us"] >= F.col(us) - horizon, best))
        .drop("_slice", "_in", "_tail")
    )


def next_from(probes: DataFrame, facts: DataFrame, keys: Sequence[str], at: str, us: str, tie: str, length: int, out: str = "next") -> DataFrame:
    """``probes`` with the first fact (struct ``us``, ``tie``) of an equal key whose ``us`` is at least the probe's ``at``, or null.

    The mirror of :func:`previous_within` without a horizon: facts and probes meet in slices of ``length`` microseconds, and where a
    slice has nothing left, the head of the next slice that has facts answers, which is one row per key and slice.
    """
    fact = F.struct(F.col(us).cast("long").alias("us"), F.col(tie).cast("long").alias("tie"))
    f = facts.select(*keys, slice_of(F.col(us), length).alias("_slice"), F.col(us).cast("long").alias("_t"), F.lit(1).alias("_is"), fact.alias("_fact"))
    id_cols = [c for c in probes.columns if c not in keys]
    row = F.struct(*id_cols)
    p = probes.select(*keys, slice_of(F.col(at), length).alias("_slice"), F.col(at).cast("long").alias("_t"), F.lit(0).alias("_is"), row.alias("_row"))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    both = f.select("*", none(p, "_row")).unionByName(p.select("*", none(f, "_fact")))
    # a fact at the very time of a probe counts, so facts stand first when the slice is read backwards
    back = W.partitionBy(*keys, "_slice").orderBy(F.desc("_t"), F.desc("_is")).rowsBetween(W.unboundedPreceding, 0)
    seen = both.withColumn("_in", F.min("_fact").over(back)).filter("_is = 0")
    heads = both.groupBy(*keys, "_slice").agg(F.min("_fact").alias("_head"))
    later = W.partitionBy(*keys).orderBy(F.desc("_slice")).rowsBetween(W.unboundedPreceding, -1)
    heads = heads.withColumn("_later", F.last("_head", ignorenulls=True).over(later)).drop("_head")
    found = seen.join(heads, [*keys, "_slice"])
    return found.select(*keys, "_row.*", F.coalesce("_in", "_later").alias(out))


def spaced(rows: DataFrame, keys: Sequence[str], us: str, tie: str, gap: int) -> DataFrame:
    """The ``tie`` ids that a greedy reading in (us, tie) order keeps: the first row of a key, then always the first more than ``gap`` after the last kept.

    Which row is kept next depends on the row kept, not on what came before it: every row points to its successor, and the kept rows
    are the path from the first. Paths are marked by pointer doubling, so a key with n kept rows takes log2(n) rounds, in each of
    which every row is a key of its own: a hot key spreads over all tasks. Ids must tell rows apart.
    """
    r = cut_lineage(rows.select(*keys, F.col(us).cast("long").alias("_us"), F.col(tie).cast("long").alias("_id")))
    probes = r.select(*keys, F.col("_id").alias("node"), (F.col("_us") + gap + 1).alias("_from"))
    ahead = next_from(probes, r, keys, "_from", "_us", "_id", max(gap // PARTS, 1)).filter("next IS NOT NULL")
    ahead = cut_lineage(ahead.select("node", F.col("next.tie").alias("to")))
    kept = cut_lineage(r.groupBy(*keys).agg(F.min(F.struct("_us", "_id")).alias("f")).select(F.col("f._id").alias("node")))
    while True:
        more = cut_lineage(kept.join(ahead, "node").select(F.col("to").alias("node")))
        if more.isEmpty():
            return kept.withColumnRenamed("node", tie)
        kept = kept.unionByName(more)
        ahead = cut_lineage(ahead.join(ahead.select(F.col("node").alias("to"), F.col("to").alias("far")), "to").select("node", F.col("far").alias("to")))


def range_best(probes: DataFrame, facts: DataFrame, key: str, probe_id: Sequence[str], best: str, block: int) -> DataFrame:
    """For each probe: the greatest ``best`` struct among facts of an equal key with ``lo <= t <= hi``.

    ``probes``: key, probe_id…, lo, hi.  ``facts``: key, t, best.  Needs ``hi - lo >= block``. The interval is cut
    into a block suffix, whole blocks and a block prefix; suffix and prefix come from running maxima, so the work is
    one sorted pass over facts and probe ends.
    """
    facts = facts.select(key, "t", best)
    blocks = facts.groupBy(key, slice_of(F.col("t"), block).alias("_b")).agg(F.max(best).alias(best))
    empty = F.lit(None).cast(facts.schema[best].dataType)
    ids = F.struct(*[F.col(c) for c in probe_id])
    no_id = F.lit(None).cast(probes.select(ids.alias("i")).schema["i"].dataType)

    def running(end: str, forward: bool) -> DataFrame:
        marks = probes.select(key, F.col(end).alias("t"), empty.alias(best), ids.alias("_id"), F.lit(1).alias("_p"))
        both = facts.select(key, "t", best, no_id.alias("_id"), F.lit(0).alias("_p")).unionByName(marks)
        order = [F.col("t") if forward else F.col("t").desc(), "_p"]
        w = W.partitionBy(key, slice_of(F.col("t"), block)).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return both.withColumn("_m", F.max(best).over(w)).filter("_p = 1").select("_id", F.col("_m").alias(best))

    first, last = slice_of(F.col("lo"), block) + 1, slice_of(F.col("hi"), block) - 1
    whole = (
        probes.filter(first <= last)
        .select(key, ids.alias("_id"), F.explode(F.sequence(first, last)).alias("_b"))
        .join(blocks, [key, "_b"])
        .select("_id", best)
    )
    return (
        running("lo", False).unionByName(running("hi", True)).unionByName(whole)
        .filter(F.col(best).isNotNull())
        .groupBy("_id").agg(F.max(best).alias(best))
        .select("_id.*", best)
    )


def position_in(df: DataFrame, keys: Sequence[str], order: Sequence, out: str) -> DataFrame:
    """Exact 1-based position inside ``keys`` by ``order``, whatever share of the rows one key, hour or score has.

    Rows are dealt by ranges of (keys, order) between sampled splitters, so every task sorts about as many rows; a row's
    position is its place in its partition plus what the partitions before hold of its key. Rows that tie in ``order`` stay
    together, so give an order that tells rows apart.
    """
    by = [*keys, *order]
    dealt = cut_lineage(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33))
    heads = dealt.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_of")).agg(F.min("_at").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    key = [f"_k{i}" for i in range(len(keys))]
    before = (W.partitionBy(*key) if keys else W.partitionBy(F.lit(0))).orderBy("_of").rowsBetween(W.unboundedPreceding, -1)
    starts = heads.select(*key, "_of", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_lo") + 1).alias("_shift"))
    same = F.col("_of") == F.col("_part")
    for i, k in enumerate(keys):
        same = same & F.col(f"_k{i}").eqNullSafe(dealt[k])
    return dealt.join(starts, same).withColumn(out, (F.col("_at") + F.col("_shift")).cast("long")).drop("_at", "_part", "_of", "_shift", *key)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """One row per key, first in ``order``; the rank limit runs before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence, n: int, out: str = "position") -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n)
