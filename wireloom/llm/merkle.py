"""Merkle manifest of a data set: trees grown by sibling-shift self-joins, a proof for every row, and verification by folding it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import register
from .store import small_side, stored

ARITY = 16              # nodes of a run
STARTS_AT_ONCE = 100_000  # (group, partition) rows up to which the offsets of a numbering are broadcast
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(F.lit(""), *parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value, so that no two rows are written alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``tree`` (a number that grows with the group, null first), ``idx`` (place in the group by ``order``, from 0) and ``n`` (rows of the group).

    Rows are dealt by ranges of (group, order), so a hot group spans many tasks; a row's place is its place in its partition plus the
    rows of the group in the partitions before. ``rows`` must come from a written table. Rows that tie are told apart by where they are stored.
    """
    by = [group, *order, "_tie"]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    placed = stored(dealt.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "merkle-order").withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_of")).agg(F.min("_at").alias("_lo"), F.count("*").alias("_rows"))
    whole = Window.partitionBy("_group")
    before = F.sum("_rows").over(whole.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("_group", "_of", (F.coalesce(before, F.lit(0)) - F.col("_lo")).alias("_shift"), F.sum("_rows").over(whole).alias("n"), F.min("_lo").over(whole).alias("tree"))
    found = placed.join(small_side(starts, STARTS_AT_ONCE), F.col("_group").eqNullSafe(F.col(group)) & (F.col("_of") == F.col("_part")))
    return found.withColumn("idx", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_group", "_of", "_shift")


@dataclass
class Trees:
    """Written levels of many trees: ``levels[k]`` has a row per run of level k with its members (``run``) and, as ``tree, idx, n, digest``, its parent."""

    levels: list[DataFrame]
    tops: DataFrame  # tree, digest
    arity: int


def grow(nodes: DataFrame, arity: int = ARITY) -> Trees:
    """Trees over ``nodes`` (tree, idx, n, digest). A tree whose level has one node is done; a run may be short, even a single node.

    At every level the slot-zero node of a run computes the indices of its siblings by slot offsets, an equijoin on (tree, index) fetches
    them, and the slot-zero row emits the parent. All keys differ, so no key is hot, and a row never holds more than ``arity`` digests.
    """
    levels, tops = [], nodes.filter("n = 1").select("tree", "digest")
    while True:
        level = nodes.filter("n > 1")
        if level.isEmpty():
            return Trees(levels, tops, arity)
        siblings = F.sequence("idx", F.least(F.col("idx") + arity - 1, F.col("n") - 1))
        asks = level.filter(F.col("idx") % arity == 0).select("tree", "n", F.col("idx").alias("zero"), F.explode(siblings).alias("idx"))
        met = asks.join(level.select("tree", "idx", "digest"), ["tree", "idx"])
        runs = met.groupBy("tree", "n", "zero").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"]).alias("run"))
        runs = runs.select("tree", F.floor(F.col("zero") / arity).alias("idx"), F.ceil(F.col("n") / arity).alias("n"), "run", digest(F.array_join("run", "")).alias("digest"))
        runs = stored(runs, "merkle-runs")
        levels.append(runs)
        nodes = runs.select("tree", "idx", "n", "digest")
        tops = tops.unionByName(nodes.filter("n = 1").select("tree", "digest"))


def _sides(run: Column, slot: Column, arity: int) -> Column:
    """The digests of a run before and after a slot."""
    return F.struct(F.array_join(F.slice(run, F.lit(1), slot), "").alias("left"), F.array_join(F.slice(run, slot + 2, F.lit(arity)), "").alias("right"))


def prove(leaves: DataFrame, trees: Trees, above: DataFrame) -> DataFrame:
    """``leaves`` (tree, idx, n and more) with ``path`` and the further columns of ``above`` (tree, path and more: one row per tree, the path from its top on).

    A path is what a leaf needs to reach the root: per level the digests left and right of it. It is built downwards, so what nodes
    share is put together once per node, and a leaf meets one row of its run.
    """
    arity, extra = trees.arity, [c for c in above.columns if c not in ("tree", "path")]
    known = None
    for k, runs in reversed(list(enumerate(trees.levels))):
        ends = runs.filter("n = 1").select("tree", "idx").join(above, "tree")
        from_above = ends if known is None else ends.unionByName(known)
        told = runs.select("tree", "idx", "run").join(from_above, ["tree", "idx"])
        if k:
            kids = told.select("tree", F.col("idx").alias("up"), "run", "path", *extra, F.posexplode("run").alias("slot", "_"))
            known = stored(kids.select("tree", (F.col("up") * arity + F.col("slot")).alias("idx"), F.concat(F.array(_sides(F.col("run"), F.col("slot"), arity)), "path").alias("path"), *extra), "merkle-paths")
    lone = leaves.filter("n = 1").join(above, "tree")
    if not trees.levels:
        return lone
    told = told.withColumnRenamed("idx", "_run")
    slot = (F.col("idx") % arity).cast("int")
    many = leaves.filter("n > 1").withColumn("_run", F.floor(F.col("idx") / arity)).join(told, ["tree", "_run"])
    many = many.withColumn("path", F.concat(F.array(_sides(F.col("run"), slot, arity)), "path")).drop("run", "_run")
    return many.unionByName(lone)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def siblings_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def manifest(leaves: DataFrame, group: str, order: list[str], arity: int = ARITY) -> DataFrame:
    """``leaves`` (any columns, among them ``leaf``) with ``subroot``, ``root`` and ``path``: one tree per group, and one over the groups' subroots.

    Groups are ordered bytewise, null first; leaves by ``order``, null first, and rows that tie there by their digest, so equal rows are
    equal leaves and the root does not depend on how the table was read. ``leaves`` must come from a written table. An empty table
    gives an empty result. The driver gets one digest.
    """
    leaves = numbered(leaves, group, [*order, "leaf"])
    trees = grow(leaves.select("tree", "idx", "n", F.col("leaf").alias("digest")), arity)
    subroots = stored(trees.tops.select(F.lit(0).alias("one"), F.col("tree").alias("of"), F.col("digest").alias("subroot")), "merkle-subroots")
    over = numbered(subroots, "one", ["of"]).select("tree", "idx", "n", "of", "subroot")
    top = grow(over.select("tree", "idx", "n", F.col("subroot").alias("digest")), arity)
    root = top.tops.first()
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    start = top.tops.select("tree", nothing.alias("path"))
    above = prove(over, top, start).select(F.col("of").alias("tree"), "path", "subroot")
    return prove(leaves, trees, stored(above, "merkle-above")).withColumn("root", F.lit(root["digest"] if root else None).cast("string"))


def merkle_rows(docs: DataFrame, changed: DataFrame | None = None, group: str = "source", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, arity: int = ARITY) -> DataFrame:
    """``id``, ``leaf``, ``seen``, ``subroot``, ``root``, ``path``, ``folded_root`` and ``verified`` of every row of ``docs``.

    ``fields`` are hashed in this order; null is a value of its own. ``docs`` may carry ``seen_<field>`` columns, the values found when
    the data are verified (by default the same): ``seen`` is the leaf they give, ``folded_root`` where it leads along the original siblings, and
    ``verified`` whether that is the root. Empty and very long texts are hashed whole. Null ids stand first in their group, repeated rows are equal leaves side by side.
    Other columns are not read.
    """
    seen = [F.col(f"seen_{c}" if f"seen_{c}" in docs.columns else c) for c in fields]
    leaves = docs.select(F.col(order).alias("id"), F.col(group).alias("group"), digest(*[field(F.col(c)) for c in fields]).alias("leaf"), digest(*[field(c) for c in seen]).alias("seen"))
    out = manifest(stored(leaves, "merkle-leaves"), "group", ["id"], arity)
    out = out.withColumn("folded_root", fold(F.col("seen"), F.col("path")))
    return out.select("id", "leaf", "seen", "subroot", "root", "path", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field_sql(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c} END"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(c) for c in (*FIELDS[:-1], text)) + ")"


def _levels_sql(name: str, start: str) -> str:
    """Recursive table of the nodes of all levels."""
    return f"""{name} AS ({start} UNION ALL SELECT tree, lvl + 1, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY tree, lvl, idx // 16, n)"""


def _walk_sql(name: str, nodes: str, start: str) -> str:
    """Recursive table that carries every row's digest and its siblings up."""
    return f"""{name} AS ({start} UNION ALL SELECT w.rid, w.tree, w.lvl + 1, w.idx // 16, (w.n + 15) // 16,
    sha256(string_agg(CASE WHEN u.idx = w.idx THEN w.cur ELSE u.h END, '' ORDER BY u.idx)), w.proof || coalesce(string_agg(CASE WHEN u.idx <> w.idx THEN u.h END, '' ORDER BY u.idx), '')
  FROM {name} w JOIN {nodes} u ON u.tree = w.tree AND u.lvl = w.lvl AND u.idx // 16 = w.idx // 16 WHERE w.n > 1 GROUP BY w.rid, w.tree, w.lvl, w.idx, w.n, w.proof)"""


_CRC = """list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda t, x: CASE WHEN x >= 0 THEN xor(t, x) WHEN t % 2 = 1 THEN xor(t >> 1, 3988292384) ELSE t >> 1 END)"""

SQL = f"""WITH RECURSIVE hashed AS (SELECT doc_id, source, {_leaf_sql('text')} AS leaf, coalesce(xor({_CRC}, 4294967295) % 5 = 0, false) AS hit, {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} AS low FROM documents),
leaves AS (SELECT *, row_number() OVER () AS rid, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM hashed),
{_levels_sql('up', 'SELECT tree, 0 AS lvl, idx, n, leaf AS h FROM leaves')},
subs AS (SELECT tree AS of, h AS subroot, 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
{_levels_sql('tops', 'SELECT tree, 0 AS lvl, idx, n, subroot AS h FROM subs')},
{_walk_sql('walk', 'up', "SELECT rid, tree, 0 AS lvl, idx, n, CASE WHEN hit THEN low ELSE leaf END AS cur, '' AS proof FROM leaves")},
{_walk_sql('climb', 'tops', 'SELECT w.rid, s.tree, 0 AS lvl, s.idx, s.n, w.cur, w.proof FROM walk w JOIN subs s ON s.of = w.tree WHERE w.n = 1')}
SELECT l.doc_id, l.leaf, s.subroot, t.h AS root, sha256(c.proof) AS proof_sha256, c.cur AS folded_root, c.cur = t.h AS verified
FROM leaves l JOIN subs s ON s.of = l.tree JOIN climb c ON c.rid = l.rid AND c.n = 1 JOIN tops t ON t.n = 1"""


@register("op12_merkle", SQL)
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = merkle_rows(docs.withColumn("seen_text", F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))))
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")
