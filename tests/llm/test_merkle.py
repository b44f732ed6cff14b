"""Merkle manifest against a plain tree, and against its SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import checker
from pyspark.sql import functions as F

from wireloom.llm import ORACLES, QUERIES, load
from wireloom.llm.merkle import LOWER, UPPER, merkle_rows, siblings_digest

load()
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain(rows, arity=16):
    """rows -> sorted (doc_id, leaf, subroot, root, proof, folded root, verified)."""

    def tree(leaves):
        """(top, siblings of every leaf as (left, right) per level)."""
        paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
        while len(level) > 1:
            for k, i in enumerate(at):
                run = level[i - i % arity:i - i % arity + arity]
                paths[k].append(("".join(run[:i % arity]), "".join(run[i % arity + 1:])))
            level = [sha("".join(level[i:i + arity])) for i in range(0, len(level), arity)]
            at = [i // arity for i in at]
        return level[0], paths

    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    keys = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops, out = [], []
    for k in keys:
        groups[k].sort(key=lambda x: x[:3])
        tops.append(tree([x[2] for x in groups[k]]))
    root, over = tree([t[0] for t in tops]) if tops else (None, [])
    for k, (sub, paths), rest in zip(keys, tops, over):
        for (_, _, leaf, r), path in zip(groups[k], paths):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            text = r[4].translate(str.maketrans(UPPER, LOWER)) if hit and r[4] is not None else r[4]
            cur, path = leaf_of((*r[:4], text)), path + rest
            for left, right in path:
                cur = sha(left + cur + right)
            out.append((r[0], leaf, sub, root, sha("".join(a + b for a, b in path)), cur, cur == root))
    return sorted(out, key=str)


def got(df):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = merkle_rows(df.withColumn("seen_text", F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))))
    return sorted((tuple(r) for r in out.select("id", "leaf", "subroot", "root", siblings_digest(F.col("path")), "folded_root", "verified").collect()), key=str)


def test_query_equals_oracle(spark):
    ok, msg = checker.compare(spark, "op12", QUERIES["op12_merkle"], ORACLES["op12_merkle"], checker.connect())
    assert ok, msg


def test_groups_of_all_sizes(spark):
    rnd, rows = random.Random(1), []
    for source, n in ((None, 1), ("", 2), ("a", 16), ("Z", 17), ("é", 1), ("b", 700), *((f"s{k}", 1) for k in range(40))):
        rows += [(rnd.randrange(10**6), source, rnd.choice(["en", None]), rnd.choice([None, 5]), rnd.choice(["Some Text", "low", "", None, "ÄÖ É"])) for _ in range(n)]
    rnd.shuffle(rows)
    assert got(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_nulls_repeated_rows_clashing_columns_and_empty_table(spark):
    rows = [(1, "s", "en", 1, "A")] * 40 + [(None, "s", None, None, None), (None, "s", "x", 0, ""), (2, None, None, None, "B" * 2_000_000), (5, "t", "en", 3, "C")]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("tree", "idx", "n", "path", "leaf", "_at", "group", "seen"):
        df = df.withColumn(c, F.lit("clash"))
    assert got(df) == plain(rows)
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame(rows[-1:], SCHEMA)) == plain(rows[-1:])


def test_other_arity_and_one_group(spark):
    rows = [(i, "s", "en", i, f"T{i}") for i in range(200)]
    out = merkle_rows(spark.createDataFrame(rows, SCHEMA), arity=2).select("id", "root", F.size("path").alias("depth"), "verified").collect()
    assert {(r.root, r.depth, r.verified) for r in out} == {(plain(rows, 2)[0][3], 8, True)}


def test_hot_group_spans_partitions(spark):
    """A group is numbered over many range partitions, and nothing sorts it in one task."""
    from wireloom.llm import merkle
    from wireloom.llm.store import stored

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = stored(spark.range(20_000).select(F.lit("hot").alias("g"), F.col("id")), "test")
        df = merkle.numbered(rows, "g", ["id"])
        assert df.filter("id <> idx or n <> 20000").count() == 0
        assert df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 10_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
