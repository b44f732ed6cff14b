"""Sharding over fixed virtual slots: rows hash into slots, and a versioned map sends slots to shards by bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import register
from .store import stored
from ..session import scratch_path

SLOTS = 8192  # virtual slots; fixed for the life of a data set, and the bound of every map
WHOLE = 64    # a group of equal texts stays in one slot up to this part of a shard's equal share of bytes


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Virtual slot of a hashed key."""
    return F.pmod(key, F.lit(slots)).cast("int")


def heavy(rows: DataFrame, key: str, limit: int, slots: int = SLOTS) -> DataFrame:
    """Keys whose rows hold more than ``limit`` bytes (``size``), exactly.

    Bytes are summed per slot first; only keys of slots beyond the limit are summed one by one, so little is shuffled. At most
    total / limit keys can be returned, which bounds the broadcasts here and at the caller.
    """
    full = rows.groupBy(slot_of(F.col(key), slots).alias("_s")).agg(F.sum("size").alias("_b")).filter(F.col("_b") > limit).select("_s")
    inside = rows.withColumn("_s", slot_of(F.col(key), slots)).join(F.broadcast(full), "_s", "left_semi")
    return inside.groupBy(key).agg(F.sum("size").alias("_b")).filter(F.col("_b") > limit).select(key)


def with_slots(rows: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """Adds ``vslot`` to rows of ``size``, ``text_key``, ``row_key`` (hash of id and text) and ``number`` (any numbering of the rows).

    A group of equal texts shares one slot. Beyond 1 / WHOLE of a shard's equal share its rows are dealt by id as well, and rows
    equal in id and text, where even these are that many, by their number.
    """
    limit = -(-(rows.agg(F.sum("size")).first()[0] or 0) // (shards * WHOLE))
    # both lists hold at most shards * WHOLE keys, as each key has more than the limit of bytes
    texts = stored(heavy(rows, "text_key", limit, slots), "heavy-texts")
    wide = rows.join(F.broadcast(texts), "text_key", "left_semi")
    copies = stored(heavy(wide, "row_key", limit, slots), "heavy-rows")
    marked = rows.join(F.broadcast(texts.withColumn("_t", F.lit(True))), "text_key", "left").join(F.broadcast(copies.withColumn("_r", F.lit(True))), "row_key", "left")
    key = F.when(F.col("_r"), F.xxhash64("row_key", "number")).when(F.col("_t"), F.col("row_key")).otherwise(F.col("text_key"))
    return marked.withColumn("vslot", slot_of(key, slots)).drop("_t", "_r")


def initial_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0: slots dealt round."""
    return spark.range(slots).select(F.lit(0).alias("version"), F.col("id").cast("int").alias("vslot"), (F.col("id") % shards).cast("int").alias("shard"))


def rebalanced(current: DataFrame, slot_bytes: DataFrame, shards: int) -> DataFrame:
    """The next version of a map: shards give up what exceeds an equal share, smallest slots first, and each of these slots,
    largest first, goes to the shard with the fewest bytes so far (the lowest number among equals).

    Both tables have at most one row per virtual slot. All other slots stay where they are, so few bytes move. A map that names
    shards beyond ``shards`` gives those slots up, so a smaller shard count is an edit as well.
    """
    sized = current.join(slot_bytes.select("vslot", "bytes"), "vslot", "left").fillna(0, ["bytes"])
    share = sized.agg(F.ceil(F.sum("bytes") / shards)).first()[0] or 0
    running = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0))
    marked = stored(sized.withColumn("running", running).withColumn("stays", (F.col("running") <= share) & (F.col("shard") < shards)), "slot-marks")
    stays, pool = marked.filter("stays"), marked.filter("not stays")
    loads = sized.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(stays.groupBy("shard").agg(F.sum("bytes").alias("load")), "shard", "left")
    loads = loads.agg(F.lit(1).alias("one"), F.transform(F.sort_array(F.collect_list(F.struct("shard", F.coalesce("load", F.lit(0)).alias("load")))), lambda x: x["load"]).alias("loads"))
    order = pool.agg(F.lit(1).alias("one"), F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "vslot"))).alias("pool"))

    def place(state: Column, slot: Column) -> Column:
        least = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        return F.struct(F.transform(state["loads"], lambda v, i: F.when(i == least, v - slot["minus"]).otherwise(v)).alias("loads"),
                        F.concat(state["moves"], F.array(F.struct(slot["vslot"].alias("vslot"), least.alias("shard")))).alias("moves"))

    start = F.struct(F.col("loads"), F.array().cast("array<struct<vslot:int,shard:int>>").alias("moves"))
    moves = loads.join(order, "one").select(F.explode(F.aggregate("pool", start, place)["moves"]).alias("m")).select("m.vslot", "m.shard")
    version = current.agg(F.max("version")).first()[0] + 1
    return stays.select("vslot", "shard").unionByName(moves).select(F.lit(version).alias("version"), "vslot", "shard")


def save_map(slot_map: DataFrame, folder: str) -> None:
    """Add a version to a stored map; earlier versions stay readable."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(folder)


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """One version of a stored map, by default the last."""
    kept = spark.read.schema("vslot int, shard int, version int").parquet(folder)
    if version is None:
        version = kept.agg(F.max("version")).first()[0]
    return kept.filter(F.col("version") == version).select("version", "vslot", "shard")


def shard_rows(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """``id``, ``size``, ``text_crc32``, ``vslot``, ``version``, ``shard`` and ``slot`` (place in the shard, from 0 without gaps) of every row.

    Law: shards are near equal in bytes. Size is the text's UTF-8 bytes plus 16. Rows of equal text share a slot and thus a shard,
    as long as they hold at most 1 / WHOLE of a shard's equal share; larger groups are split (:func:`with_slots`), so no group of
    copies, rows that are equal altogether included, can overfill a shard or a task. Sizes are summed per slot, the map starts as slots dealt round, and its next version is
    rebalanced by these sums; both versions are stored in ``folder`` (a new one by default). The place in the shard is the place in the
    slot plus the rows of the shard's slots before, so no task sorts more than a slot.

    Null text counts as empty, and rows without text are a group like any other. Null ids are an id of their own. Texts of any length count whole; one that is
    longer than a shard's share fills its shard. An empty table gives an empty result. Equal rows take neighbouring places in no fixed order.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                       F.xxhash64(text).alias("text_key"), F.xxhash64(F.col(id_col), text).alias("row_key"), F.monotonically_increasing_id().alias("number"))
    rows = stored(with_slots(stored(rows, "shard-keys"), shards, slots).select("id", "size", "text_crc32", "vslot"), "shard-rows")
    sums = stored(rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "slot-sums")
    folder = folder or scratch_path(spark, "slot-map")
    save_map(initial_map(spark, shards, slots), folder)
    save_map(rebalanced(load_map(spark, folder), sums, shards), folder)
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1))
    placed = load_map(spark, folder).join(sums, "vslot").select("version", "vslot", "shard", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("id", "text_crc32", "size")) - 1
    # the map has at most one row for each of the fixed slots
    return rows.withColumn("place", place).join(F.broadcast(placed), "vslot").select(
        "id", "size", "text_crc32", "vslot", "version", "shard", (F.col("before") + F.col("place")).alias("slot"))


@register("op8_sharding")
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
