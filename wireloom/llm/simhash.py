"""Near duplicates by SimHash fingerprints, joined through Golay-code keys of fingerprint segments."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import register
from .linked import labels_of
from .near_dup import _cross, _open, _proposals
from .store import small_side, stored

SIZE, SEED = 3, 42       # words of a shingle; seed of its XXH64
WIDTHS = (22, 21, 21)    # bits of the three segments, each a Golay word of 23 bits with leading zeros
DISTANCE = 3             # the key scheme below holds for three differing bits
LARGE = 64               # members that wait for others in a bucket up to which they are all compared
STAR_ROUNDS, HUBS = 2, 8  # rounds in which the members of larger buckets try hubs, and hubs of a round
HOT = 10_000             # rows of a fingerprint from which its component goes to them by broadcast
AT_ONCE = 200_000        # keys, or such fingerprints, up to which they are broadcast
CHUNK = 1 << 16          # shingles hashed at a time

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str) -> int:
    """64 majority bits of the shingles' hashes; 0 without words."""
    from xxhash import xxh64_intdigest

    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    if len(words) >= SIZE:
        starts, ends = starts[:len(words) - SIZE + 1], ends[SIZE - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    votes = np.zeros(64, np.int64)
    for k in range(0, len(starts), CHUNK):
        h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[k:k + CHUNK].tolist(), ends[k:k + CHUNK].tolist())], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(starts), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t or "") for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])


class Golay:
    """The perfect binary Golay code of 23 bits, 12 of them free: every word is within three bits of exactly one codeword.

    ``leader``: the error that leads to that codeword, by syndrome. ``errors``: all errors of at most four bits, by syndrome (-1 fills up):
    one if the leader has at most two bits, else six. If two words differ in one bit, the nearest codeword of either is among the
    codewords within four bits of the other.
    """

    BITS, CHECK, POLYNOMIAL = 23, 11, 0xC75

    def __init__(self) -> None:
        step, of_bit = 1, []
        for _ in range(self.BITS):
            of_bit.append(step)
            step <<= 1
            step ^= self.POLYNOMIAL if step >> self.CHECK else 0
        self._bytes = np.zeros((3, 256), np.int64)
        for part in range(3):
            for bit in range(8):
                if 8 * part + bit < self.BITS:
                    self._bytes[part] ^= np.where(np.arange(256) >> bit & 1, of_bit[8 * part + bit], 0)
        self.leader = np.zeros(1 << self.CHECK, np.int64)
        for n in (1, 2, 3):
            for bits in combinations(range(self.BITS), n):
                self.leader[reduce(lambda a, b: a ^ of_bit[b], bits, 0)] = sum(1 << b for b in bits)
        self.errors = np.full((1 << self.CHECK, 6), -1, np.int64)
        for s, first in enumerate(self.leader.tolist()):
            more = {1 << b | int(self.leader[s ^ of_bit[b]]) for b in range(self.BITS) if not first >> b & 1} if first.bit_count() == 3 else set()
            self.errors[s, :1 + len(more)] = [first, *sorted(more)]

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self._bytes[0][words & 255] ^ self._bytes[1][words >> 8 & 255] ^ self._bytes[2][words >> 16]

    def nearest(self, words: np.ndarray) -> np.ndarray:
        """Index (12 bits) of the codeword within three bits."""
        return (words ^ self.leader[self.syndrome(words)]) >> self.CHECK

    def around(self, words: np.ndarray) -> np.ndarray:
        """Indices of the codewords within four bits, six columns, -1 where there are fewer."""
        errors = self.errors[self.syndrome(words)]
        return np.where(errors < 0, -1, (words[:, None] ^ errors) >> self.CHECK)


_CODE: list[Golay] = []


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fingerprint, side) rows: two fingerprints that differ in one to three bits share a key, and one of them waits there while the other asks.

    Three errors in three segments leave, by the pigeonhole principle, one of these cases, each with keys of its own:
    two segments are equal (both segments are the key; all members wait and ask, side 2);
    one is equal and another has one error (the equal one and a Golay index of the other);
    all have one error (Golay indices of two, parities of the others).
    One error turns a segment's parity, so only fingerprints with even parity there wait (side 0, under the nearest codeword),
    and only odd ones ask (side 1, at all codewords within four bits). These are 37 rows on average.
    """
    if not _CODE:
        _CODE.append(Golay())
    code, u = _CODE[0], fps.view(np.uint64)
    seg, shift = [], 0
    for width in WIDTHS:
        seg.append((u >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64))
        shift += width
    odd = [np.bitwise_count(s) & 1 == 1 for s in seg]
    near, around = [code.nearest(s) for s in seg], [code.around(s) for s in seg]
    keys, nodes, sides = [], [], []

    def add(kind: int, value: np.ndarray, who: np.ndarray, side: int) -> None:
        keys.append(value | np.int64(kind) << np.int64(48))
        nodes.append(fps[who])
        sides.append(np.full(len(who), side, np.int8))

    every, kind = np.arange(len(fps)), 0
    for x, y in combinations(range(3), 2):
        add(kind, seg[x] << 22 | seg[y], every, 2)
        kind += 1
    for x, y in permutations(range(3), 2):
        wait = np.flatnonzero(~odd[y])
        add(kind, seg[x][wait] << 12 | near[y][wait], wait, 0)
        ask, k = np.nonzero((around[y] >= 0) & odd[y][:, None])
        add(kind, seg[x][ask] << 12 | around[y][ask, k], ask, 1)
        kind += 1
    a, b, c = range(3)
    wait = np.flatnonzero(~odd[a])
    add(kind, near[a][wait] << 14 | near[b][wait] << 2 | odd[b][wait] << 1 | odd[c][wait], wait, 0)
    ask, k, m = np.nonzero((around[a] >= 0)[:, :, None] & (around[b] >= 0)[:, None, :] & odd[a][:, None, None])
    add(kind, around[a][ask, k] << 14 | around[b][ask, m] << 2 | ~odd[b][ask] << 1 | ~odd[c][ask], ask, 1)
    return np.concatenate(keys), np.concatenate(nodes), np.concatenate(sides)


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy()
        for k in range(0, len(fps), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in keys_of(fps[k:k + 20_000])], names=["key", "node", "side"])


def _close(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= DISTANCE


def _links(nodes: DataFrame) -> list[DataFrame]:
    """Links (a, b) that tie together all fingerprints (column node) that a chain of close ones ties together."""
    keys = stored(nodes.mapInArrow(_key_rows, "key long, node long, side byte"), "simhash-keys")
    waiting = keys.filter("side <> 1")
    crowded = stored(waiting.groupBy("key").count().filter(F.col("count") > LARGE).select("key"), "simhash-crowded")
    few = small_side(crowded, AT_ONCE)
    x = waiting.join(few, "key", "left_anti").select("key", F.col("node").alias("a"), F.col("side").alias("a_side"))
    y = keys.filter("side <> 0").select("key", F.col("node").alias("b"), F.col("side").alias("b_side"))
    # a waiting fingerprint and one that asks; those that do both meet once
    met = x.join(y, "key").filter(_close(F.col("a"), F.col("b")) & ((F.col("a_side") == 0) | (F.col("a") < F.col("b"))))
    links = [stored(met.select("a", "b"), "simhash-links")]
    if crowded.isEmpty():
        return links
    members = keys.join(few, "key").select("key", "node")
    sizes = members.groupBy("key").agg(F.count("*").alias("size"))
    members = stored(members.join(small_side(sizes, AT_ONCE), "key"), "simhash-members")
    labels = labels_of(links[0])
    for turn in range(STAR_ROUNDS):
        rest = stored(_open(members, labels), "simhash-open")
        if rest.isEmpty():
            return links
        more = stored(_proposals(rest, [turn * HUBS + k for k in range(HUBS)]).filter(_close(F.col("a"), F.col("b"))), "simhash-links")
        links.append(more)
        labels = labels_of(reduce(DataFrame.unionByName, links))
    rest = stored(_open(members, labels), "simhash-open")
    pairs = _cross(rest.select(F.col("key").alias("token"), "node", "label"), _close(F.col("x_node"), F.col("y_node")))
    return [*links, stored(pairs, "simhash-links")]


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``fp`` (the fingerprint as a signed long) and ``component_id`` (smallest id reachable over fingerprints that differ in at most three bits).

    Rows of equal fingerprint are one node, so copies never meet. Nodes meet in the buckets of :func:`keys_of` and every link is
    verified on the fingerprints themselves, inside the join. A bucket where more than ``LARGE`` nodes wait is not joined:
    its members try a few hubs, and then only members of different components meet.

    Null and empty texts have fingerprint 0 and are linked like any other; texts are hashed whole, however long. Null ids are never
    the smallest, and a component of null ids only has a null id; rows that repeat an id are linked each by its own text. Other columns are not read.
    An empty table gives an empty result.
    """
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = stored(d.mapInArrow(_fingerprints, "id long, fp long"), "simhash-rows")
    classes = stored(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("size")), "simhash-classes")
    labels = labels_of(reduce(DataFrame.unionByName, _links(classes.select(F.col("fp").alias("node"))))).withColumnRenamed("node", "fp")
    tied = classes.join(labels, "fp")
    of_label = tied.groupBy("label").agg(F.min("least").alias("component_id"))
    tied = tied.join(of_label, "label").select("fp", "size", "component_id")
    alone = classes.join(labels, "fp", "left_anti").select("fp", "size", F.col("least").alias("component_id"))
    named = stored(tied.unionByName(alone), "simhash-named")
    hot = named.filter(F.col("size") >= HOT).drop("size")
    if hot.isEmpty():
        return rows.join(named.drop("size"), "fp").select("id", "fp", "component_id")
    hot = small_side(hot, AT_ONCE)
    rest = rows.join(hot.select("fp"), "fp", "left_anti").join(named.filter(F.col("size") < HOT).drop("size"), "fp")
    return rows.join(hot, "fp").unionByName(rest).select("id", "fp", "component_id")


@register("op13_simhash")
def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
