"""Benchmark decontamination by templates: numbers, names and units become typed slots, equal template windows meet in a hash join,
and the slots of aligned windows must be filled consistently."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import register
from .ragged import alnum_words, hash_windows, hash_word, hash_words, runs, texts
from .store import small_side, stored

WINDOW = 8            # template tokens of a window
LITERALS = 4          # of which at least so many are words, not slots
COVER = 0.5           # of an item's windows, or of its words in verbatim runs, that a document must hold
RUN = 13              # words of a verbatim run that is a leak, whatever share of the item it is
SHORT = 4             # words of a literal window of items of WINDOW to 2 * WINDOW words
SKETCH_ROWS = 2_000_000  # benchmark windows up to which their hashes go along with the scan; beyond, all windows meet in the join

# fixed values: words that are numbers, and units if a number stands before
NUMBER_WORDS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
                "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion").split()
UNITS = ("mm cm m km g kg mg lb lbs oz ml l s ms h hz kw inch inches foot feet yard yards mile miles meter meters metre metres gram grams kilogram kilograms pound pounds ounce ounces "
         "liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents degree degrees").split()

_NUMBERS = np.sort(np.array([hash_word(w) for w in NUMBER_WORDS], np.uint64))
_UNITS = np.sort(np.array([hash_word(w) for w in UNITS], np.uint64))
_NUM, _NAME, _UNIT = (np.uint64(hash_word(f"slot{k}")) for k in range(3))
_LITERAL = np.uint64(hash_word("literal"))
_ALNUM = alnum_words()


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def _size_of(n: int) -> int:
    """Words of a literal window of an item of ``n`` words: all of a short item; a few while a changed word in the middle could leave no whole WINDOW beside it."""
    return n if n < WINDOW else WINDOW if n > 2 * WINDOW else SHORT


def text_windows(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, template window hashes, window starts, value hash of every template token or 0 for a word, first word of every token and the end, hash of every word) of every text.

    Letters and digits are split from each other; digits with inner points or commas are one number. A capitalised (not all upper
    case) word of two letters or more that begins no sentence is a name; runs of names or of numbers are one slot whose value is the sum of its parts.
    """
    row = 0
    for first, last, data, bounds in texts(column):
        inside = _ALNUM[data]
        digit = (data >= 48) & (data <= 57)
        point = ((data == 46) | (data == 44))
        point[:1] = point[-1:] = False
        point[1:-1] &= digit[:-2] & digit[2:]
        inside, kind = inside | point, digit | point
        joined = inside[:-1] & inside[1:] & (kind[:-1] == kind[1:])
        start, end, at = runs(inside, joined, bounds)
        if not len(start):
            continue
        upper = (data >= 65) & (data <= 90)
        accent = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97))  # capital letters of Latin-1
        upper[accent] = True
        plain = data.copy()
        plain[accent + 1] += 0x20
        h = hash_words(plain, start, end)
        nxt = start + 1 + (data[start] >= 0xC0)
        more = nxt < end
        nxt = np.minimum(nxt, len(data) - 1)
        stops = np.concatenate([[0], np.cumsum(np.isin(data, np.frombuffer(b".!?:\n\"(", np.uint8)))])
        opens = np.ones(len(start), bool)
        opens[1:] = stops[start[1:]] > stops[end[:-1]]
        opens[at[:-1][at[:-1] < len(start)]] = True
        number = kind[start] | _among(h, _NUMBERS)
        name = upper[start] & more & ~upper[nxt] & ~opens & ~number
        unit = np.zeros(len(start), bool)
        unit[1:] = _among(h[1:], _UNITS) & number[:-1]
        unit[at[:-1][at[:-1] < len(start)]] = False
        name &= ~unit
        token = np.where(number, _NUM, np.where(name, _NAME, np.where(unit, _UNIT, h)))
        fresh = np.ones(len(start), bool)
        fresh[1:] = ~((number[1:] & number[:-1]) | (name[1:] & name[:-1]))
        fresh[at[:-1][at[:-1] < len(start)]] = True
        head = np.flatnonzero(fresh)
        slot = number | name | unit
        value = np.where(slot[head], np.add.reduceat(h, head), np.uint64(0))
        token = token[head]
        bound = np.searchsorted(head, at)
        windows = hash_windows(token, WINDOW)
        words = np.concatenate([[0], np.cumsum(value == 0)])
        enough = words[WINDOW:] - words[:-WINDOW] >= LITERALS if len(token) >= WINDOW else np.zeros(0, bool)
        for k in range(last - first):
            a, b = bound[k], bound[k + 1]
            if b > a:
                ok = np.flatnonzero(enough[a:b - WINDOW + 1]) if b - a >= WINDOW else np.zeros(0, int)
                yield first + k, windows[a + ok], ok, value[a:b], np.append(head[a:b], at[k + 1]) - at[k], h[at[k]:at[k + 1]]


def _windows(df: DataFrame, sketch: np.ndarray | None, sizes: list[int] | None = None) -> DataFrame:
    """(id, size, hash, place, slots, from, to) of every window, or of those whose hash is in the sorted ``sketch``; from and to count words.

    ``size`` is 0 for template windows, whose places count template tokens. Literal windows have ``size`` words, all lower-cased, and no slots: the
    ``sizes`` given, or the one that an item of this length has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sized, hashes, places, slots, starts, ends, n = [], [], [], [], [], [], [], 0

            def out() -> pa.RecordBatch:
                flat = np.concatenate(slots).view(np.int64) if slots else np.zeros(0, np.int64)
                return pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(sized).astype(np.int32)), pa.array(np.concatenate(hashes).view(np.int64)),
                    pa.array(np.concatenate(places).astype(np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(flat), WINDOW).cast(pa.list_(pa.int64())),
                    pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(ends).astype(np.int32))], names=["id", "size", "hash", "place", "slots", "from", "to"])

            for row, h, place, value, head, word in text_windows(batch.column(1)):
                forms = [(0, h, place)]
                for size in sizes if sizes is not None else [_size_of(len(word))]:
                    found = hash_windows(word, size) ^ _LITERAL
                    place = np.arange(len(found))
                    if sketch is not None and size not in (SHORT, WINDOW):  # a whole short item: where it stands first is enough
                        found, place = np.unique(found, return_index=True)
                    forms.append((size, found, place))
                for size, h, place in forms:
                    if sketch is not None:
                        hit = _among(h, sketch)
                        h, place = h[hit], place[hit]
                    if not len(h):
                        continue
                    rows.append(np.full(len(h), row))
                    sized.append(np.full(len(h), size))
                    hashes.append(h)
                    places.append(place)
                    slots.append(np.zeros(len(h) * WINDOW, np.uint64) if size else value[place[:, None] + np.arange(WINDOW)].ravel())
                    starts.append(place if size else head[place])
                    ends.append(place + size if size else head[place + WINDOW])
                    n += len(h)
                if n > 100_000:
                    yield out()
                    rows, sized, hashes, places, slots, starts, ends, n = [], [], [], [], [], [], [], 0
            if n:
                yield out()

    return df.mapInArrow(run, "id long, size int, hash long, place int, slots array<long>, from int, to int")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", cover: float = COVER) -> DataFrame:
    """One row per document and benchmark item it contains: ``doc_id``, ``item_id``, ``n_windows``, ``item_windows``, ``coverage``, ``exact``.

    Windows of one document and item that stand on one diagonal are aligned; on a diagonal every value of the item's slots stands
    for one value of the document, the one most of its places have; windows over a place that is neither equal nor has that value don't count. Windows also meet
    by their words alone, lower-cased, so that case and punctuation lose nothing. ``coverage``, at least ``cover``, is the share of the item's template windows held by
    either form, or of its words in aligned verbatim runs, whichever is more (less than ``cover`` if a run has RUN words); ``exact`` says that there is a verbatim run or a diagonal of only equal values,
    otherwise the item was re-parameterised.

    Null ids and texts, and texts without a word, are contained nowhere and contain nothing. An item of fewer than WINDOW words is contained where all its words stand.
    Rows that repeat an id count as one document, repeated items as one item. Empty tables give an empty result.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).filter("id is not null")
    index = stored(_windows(items, None).select("size", "hash", F.col("id").alias("item_id"), F.col("place").alias("item_place"), F.col("slots").alias("item_slots"),
                                                F.col("from").alias("item_from"), F.col("to").alias("item_to")).distinct(), "leak-index")
    sizes = sorted(r["size"] for r in index.filter("size > 0").select("size").distinct().collect())
    keys = index.select("hash").distinct().limit(SKETCH_ROWS + 1).toArrow()["hash"].to_numpy()
    sketch = np.sort(keys.view(np.uint64)) if len(keys) <= SKETCH_ROWS else None
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    hits = stored(_windows(rows, sketch, sizes).select("id", "size", "hash", "place", "slots").join(small_side(index, SKETCH_ROWS), ["size", "hash"]), "leak-hits")
    filled = F.expr("filter(transform(item_slots, (i, k) -> struct(item_place + k AS at, i AS i, slots[k] AS d)), x -> x.i <> 0)")
    lines = hits.filter("size = 0").select("id", "item_id", (F.col("place") - F.col("item_place")).alias("diagonal"), "item_place", filled.alias("pairs"))
    # an item bounds what a diagonal gathers: its windows and its slots
    per = lines.groupBy("id", "item_id", "diagonal").agg(F.collect_set("item_place").alias("places"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    odd = F.expr("transform(filter(pairs, x -> x.i <> x.d AND 2 * size(filter(pairs, y -> y.i = x.i AND y.d = x.d)) <= size(filter(pairs, y -> y.i = x.i))), x -> x.at)")
    kept = per.withColumn("odd", odd).withColumn("places", F.expr(f"filter(places, p -> NOT exists(odd, a -> a >= p AND a < p + {WINDOW}))"))
    good = kept.select("id", "item_id", F.forall("pairs", lambda x: x["i"] == x["d"]).alias("exact"), F.explode("places").alias("item_place"))
    # literal windows of a diagonal that touch are one verbatim run of words
    order = Window.partitionBy("id", "item_id", "diagonal").orderBy("item_from", "item_to")
    word = hits.filter("size > 0").select("id", "item_id", (F.col("place") - F.col("item_place")).alias("diagonal"), "item_from", "item_to").distinct()
    word = word.withColumn("fresh", F.coalesce(F.lag("item_to").over(order) < F.col("item_from"), F.lit(True)).cast("int")).withColumn("run", F.sum("fresh").over(order))
    runs = stored(word.groupBy("id", "item_id", "diagonal", "run").agg(F.min("item_from").alias("a"), F.max("item_to").alias("z")), "leak-runs")
    # a run is counted with those one word further on, so that an inserted or left out word doesn't part them
    near = runs.select("id", "item_id", F.explode(F.array(F.col("diagonal"), F.col("diagonal") + 1)).alias("diagonal"), "a", "z").groupBy("id", "item_id", "diagonal").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(F.expr("sequence(a, z - 1)"))))).alias("words"), F.max(F.expr("z - a")).alias("longest"))
    sizes_of = index.groupBy("item_id").agg(F.countDistinct(F.when(F.col("size") == 0, F.col("item_place"))).alias("item_windows"), F.max("item_to").alias("item_words"),
                                            F.collect_set(F.when(F.col("size") == 0, F.struct("item_place", "item_from", "item_to"))).alias("spans"))
    sizes_of = small_side(stored(sizes_of, "leak-items"), SKETCH_ROWS)
    inside = runs.join(sizes_of, "item_id").select("id", "item_id", F.lit(True).alias("exact"), F.explode(F.expr("transform(filter(spans, s -> s.item_from >= a AND s.item_to <= z), s -> s.item_place)")).alias("item_place"))
    held = good.unionByName(inside).groupBy("id", "item_id", "item_place").agg(F.max("exact").alias("exact")).groupBy("id", "item_id").agg(F.count("*").alias("n_windows"), F.max("exact").alias("exact"))
    both = held.select("id", "item_id", "n_windows", "exact", F.lit(0).alias("words"), F.lit(0).alias("longest")).unionByName(
        near.select("id", "item_id", F.lit(0).cast("long").alias("n_windows"), F.lit(True).alias("exact"), "words", "longest"))
    found = both.groupBy("id", "item_id").agg(*[F.max(c).alias(c) for c in ("n_windows", "exact", "words", "longest")])
    share = F.greatest(F.coalesce(F.try_divide("n_windows", "item_windows"), F.lit(0.0)), F.col("words") / F.col("item_words"))
    return found.join(sizes_of, "item_id").filter((share >= cover) | (F.col("longest") >= RUN)).select(F.col("id").alias("doc_id"), "item_id", "n_windows", "item_windows", share.alias("coverage"), "exact")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that contain no benchmark item (null ids stay), with all their columns."""
    leaks = stored(find_leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(id_col)).distinct(), "leak-ids")
    return docs.join(small_side(leaks, SKETCH_ROWS), id_col, "left_anti").select(docs.columns)


@register("op3_decontaminate")
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
