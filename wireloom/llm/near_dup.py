"""Near duplicates by min-max hashing: banded signatures find candidates, full shingle sets confirm them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import register
from .linked import labels_of
from .ragged import blank_words, hash_windows, hash_words, mix, texts, words
from .store import stored

SIZE = 5          # words of a shingle
PERMUTATIONS = 64  # each gives a minimum and a maximum: 128 signature values
BANDS = 32        # of two minima and two maxima each; a pair at 0.75 is missed with probability (1 - 0.75^4)^32 < 6e-6
SMALL = 16        # members up to which the open pairs of a bucket are compared one by one
STAR_ROUNDS = 2   # rounds in which large open buckets try further hubs
HUBS = 8          # hubs a member meets in such a round
CHUNK = 1024      # about as many members of a bucket learn in one task what is known of it

_RNG = np.random.default_rng(4711)
_A = _RNG.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64)


def shingle_sets(column: pa.Array, size: int = SIZE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text: ``size`` words, or all of them if there are fewer."""
    table = blank_words()
    for _, _, data, bounds in texts(column):
        start, end, first = words(data, bounds, table)
        h = hash_words(data, start, end)
        full = hash_windows(h, size)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= size:
                yield np.unique(full[a:b - size + 1])
            elif b > a:
                yield hash_windows(h[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)


def min_max(sets: list[np.ndarray]) -> np.ndarray:
    """Band keys of every (non-empty) set, one row each. Every permutation is evaluated once and gives both its extremes."""
    flat, starts = np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets[:-1]])
    low, high = (np.empty((len(sets), PERMUTATIONS), np.uint64) for _ in range(2))
    for k in range(PERMUTATIONS):
        y = flat * _A[k] + _B[k]
        low[:, k], high[:, k] = np.minimum.reduceat(y, starts), np.maximum.reduceat(y, starts)
    out = np.empty((len(sets), BANDS), np.uint64)
    for j in range(BANDS):
        # minima and maxima of different permutations, so that the four values of a band are independent
        a, b, c, d = low[:, 2 * j], low[:, 2 * j + 1], high[:, (2 * j + 2) % PERMUTATIONS], high[:, (2 * j + 3) % PERMUTATIONS]
        out[:, j] = mix(mix(mix(mix(a) + b) + c) + d + np.uint64(j))
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets, ids, rows = [], batch.column(0), []
        done, held = 0, 0

        def flush():
            filled = [s for s in sets if len(s)]
            keys = min_max(filled).view(np.int64) if filled else np.zeros((0, BANDS), np.int64)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            full = np.cumsum([0] + [BANDS * bool(len(s)) for s in sets]).astype(np.int32)
            return pa.RecordBatch.from_arrays([
                ids.slice(done, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                pa.ListArray.from_arrays(pa.array(full), pa.array(keys.ravel()))], names=["id", "n_shingles", "digest", "bands"])

        for s in shingle_sets(batch.column(1)):
            sets.append(s)
            held += len(s)
            if held >= 200_000:
                yield flush()
                done, held, sets = done + len(sets), 0, []
        if sets:
            yield flush()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done, held, sets = 0, 0, []

        def flush():
            at = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            return pa.RecordBatch.from_arrays([
                batch.column(0).slice(done, len(sets)), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets).view(np.int64)))], names=["node", "shingles"])

        for s in shingle_sets(batch.column(1)):
            sets.append(s)
            held += len(s)
            if held >= 500_000:
                yield flush()
                done, held, sets = done + len(sets), 0, []
        if sets:
            yield flush()


def _confirmed(pairs: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """Pairs (a, b) with ``whole * |A and B| >= part * |A or B|`` on full sets."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    na, nb = F.size("sa"), F.size("sb")
    both = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(a, "a").join(b, "b").filter(F.least(na, nb) * whole >= F.greatest(na, nb) * part)
            .select("a", "b", both.alias("both"), (na + nb).alias("sum")).filter(F.col("both") * whole >= (F.col("sum") - F.col("both")) * part).select("a", "b"))


def _told(members: DataFrame, per_key: DataFrame) -> DataFrame:
    """Members joined with the one row of their bucket; a large bucket is dealt to several tasks, with its row repeated in each."""
    pieces = F.ceil(F.col("size") / CHUNK)
    rows = per_key.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))).drop("size")
    return members.withColumn("piece", F.pmod(F.xxhash64("node"), pieces)).join(rows, ["key", "piece"]).drop("piece")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with their label, of the buckets whose members do not all belong together yet."""
    m = members.join(labels, "node", "left").select("key", "node", "size", F.coalesce("label", "node").alias("label"))
    keys = m.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("size").alias("size")).filter("lo <> hi").select("key", "size")
    return _told(m, keys)


def _proposals(members: DataFrame, turns: list[int]) -> DataFrame:
    """At most one pair for each member and turn: it meets the hub (smallest by a hash of the turn) of one of its buckets."""
    rank = lambda t: F.col("node") if t == 0 else F.xxhash64("node", F.lit(t))
    who = lambda t: F.struct(rank(t).alias("rank"), F.col("node").alias("hub"), F.col("label").alias("hub_label"))
    hubs = members.groupBy("key").agg(*[F.min(who(t)).alias(f"h{t}") for t in turns], F.max("size").alias("size"))
    best = lambda t: F.min(F.when(F.col("label") != F.col(f"h{t}.hub_label"), F.col(f"h{t}"))).alias(f"h{t}")
    met = _told(members, hubs).groupBy("node").agg(*[best(t) for t in turns]).select("node", F.explode(F.array_distinct(F.array(*[F.col(f"h{t}.hub") for t in turns]))).alias("hub"))
    return met.filter("hub is not null").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _cross(tokens: DataFrame, possible: Column | None = None) -> DataFrame:
    """Pairs of nodes that share a token and have different labels, where ``possible`` (over the columns of x and y) holds.

    Per token, the members of the most frequent label only meet the others: two members of one label are never paired.
    """
    per = tokens.groupBy("token", "label").count()
    main = per.groupBy("token").agg(F.max(F.struct("count", "label")).alias("m"), F.count("*").alias("labels")).filter("labels > 1")
    t = tokens.join(main.select("token", F.col("m.label").alias("main")), "token")
    side = lambda df, k: df.select("token", *[F.col(c).alias(f"{k}_{c}") for c in tokens.columns if c != "token"])
    x, y = side(t.filter("label <> main"), "x"), side(t, "y")
    return (x.join(y, (x["token"] == y["token"]) & (F.col("x_label") != F.col("y_label")) & (F.lit(True) if possible is None else possible))
            .select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct())


def _prefixes(members: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """The rarest shingles of every member of a large open bucket, with their places, as many as an exact prefix filter needs."""
    nodes = members.groupBy("node").agg(F.first("label").alias("label"))
    each = nodes.join(sets, "node").select("node", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    often = each.groupBy("token").count()
    ranked = each.join(often, "token").groupBy("node", "label", "n").agg(F.sort_array(F.collect_list(F.struct("count", "token"))).alias("order"))
    keep = F.col("n") - F.ceil(F.col("n") * part / whole) + 1
    places = ranked.select("node", "label", "n", F.posexplode(F.slice("order", F.lit(1), keep.cast("int"))).alias("place", "o"))
    return places.filter("o.count > 1").select("node", "label", "n", "place", "o.token")


def _reachable(part: int, whole: int) -> Column:
    """Whether two sets whose first common token stands at these places can still overlap enough: what follows bounds the overlap."""
    left = F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place"))
    return left * (part + whole) >= (F.col("x_n") + F.col("y_n")) * part


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = 75, whole: int = 100) -> DataFrame:
    """Class of near duplicates of every document: ``id``, ``n_shingles``, ``component_id``, ``kept``.

    Documents with equal shingle sets are one class from the start (128-bit digest of the sorted set), so copies are
    never paired. The smallest id of a class stands for it. Class representatives that share a band meet: every
    member first proposes to one hub of its buckets, and large buckets that still hold several components try other
    hubs for a few rounds. What is then open is settled exactly: small buckets pair members of different
    components, large ones do so through the prefix and position filters of an exact set join. Every link is confirmed on full sets.

    Empty or null text: no shingles, linked with nothing. Null id: not compared, ``component_id`` null, ``kept`` true.
    Rows that repeat an id count as one document: its links are those of all its rows. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sig = stored(d.mapInArrow(_signatures, "id long, n_shingles long, digest binary, bands array<long>"), "near-sig")
    known = sig.filter("id is not null and digest is not null")
    classes = stored(known.groupBy("digest").agg(F.min("id").alias("node"), F.max("id").alias("last")), "near-class")
    heads = known.join(classes.select("digest", F.col("node").alias("id")), ["digest", "id"]).select(F.col("id").alias("node"), F.explode("bands").alias("key"))
    heads = stored(heads, "near-bands")
    shared = heads.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("key", "size")
    members = stored(heads.join(shared, "key").distinct(), "near-members")
    wanted = members.select(F.col("node").alias("id")).distinct()
    sets = stored(d.join(wanted, "id").mapInArrow(_sets, "node long, shingles array<long>"), "near-sets")
    same_id = known.select("id", "digest").join(classes, "digest").select(F.col("node").alias("a"), F.col("id").alias("b"))

    edges = stored(_confirmed(_proposals(members.withColumn("label", F.col("node")), [0]), sets, part, whole), "near-links")
    links, labels = [edges], labels_of(edges)
    rest = stored(_open(members, labels), "near-open")
    for turn in range(STAR_ROUNDS):
        large = rest.filter(F.col("size") > SMALL)
        if large.isEmpty():
            break
        more = stored(_confirmed(_proposals(large, [turn * HUBS + k + 1 for k in range(HUBS)]), sets, part, whole), "near-links")
        if more.isEmpty():
            continue
        links.append(more)
        labels = labels_of(reduce(DataFrame.unionByName, links))
        rest = stored(_open(members, labels), "near-open")
    small = rest.filter(F.col("size") <= SMALL).select(F.col("key").alias("token"), "node", "label")
    pairs = _cross(small)
    large = rest.filter(F.col("size") > SMALL)
    if not large.isEmpty():
        pairs = pairs.unionByName(_cross(_prefixes(large, sets, part, whole), _reachable(part, whole))).distinct()
    links.append(stored(_confirmed(pairs, sets, part, whole), "near-links"))
    # a repeated id ties the classes of its rows together
    tie = same_id.groupBy("b").agg(F.min("a").alias("a"), F.max("a").alias("z")).filter("a <> z").select("b").join(same_id, "b").select("b", "a").distinct()
    links.append(tie.select("a", "b"))
    labels = stored(labels_of(reduce(DataFrame.unionByName, links)), "near-labels")
    top = classes.join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("component_id"))
    named = known.select("id", "n_shingles", "digest").join(top, "digest").select("id", "n_shingles", "component_id")
    alone = sig.filter("id is null or digest is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    return named.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


@register("op2_near_dup")
def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")
