"""Toxicity scores: a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pyspark.sql.types import DoubleType, StructField, StructType

from . import register
from .store import small_side, stored

GRAMS = (4, 5, 6)          # characters of an n-gram
BITS = 18                  # n-grams hash into 2^BITS buckets; also the bound of what the driver gets as counts
FEATURES = 4096            # buckets that tell most between the classes and carry a weight
FIT_ROWS = 20_000          # labelled training rows the weights are fitted on, those with the smallest hash of id and text; counts use all
SMOOTHING = 1.0
PENALTY = 3e-6
STEPS = 300
LABELS_AT_ONCE = 1_000_000  # labels up to which they are broadcast; beyond, labels and texts meet in a shuffle

_MULT = np.random.default_rng(5).integers(1, 2**31, max(GRAMS), dtype=np.uint32) | np.uint32(1)
_SPACE = np.array([32], np.uint32)
_SPREAD = np.uint32(0x9E3779B1)


def buckets(text: str | None) -> np.ndarray:
    """Buckets of all n-grams of a text, in order and with repeats. Runs of what is no letter or digit count as one space."""
    if not text:
        return np.zeros(0, np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    word = (codes >= 0x80) | ((codes >= 97) & (codes <= 122)) | ((codes >= 48) & (codes <= 57))
    codes = np.where(word, codes, np.uint32(32))
    codes = np.concatenate([_SPACE, codes[np.r_[True, word[1:] | word[:-1]]], _SPACE])
    out, h = [], np.zeros(len(codes), np.uint32)
    for k in range(min(max(GRAMS), len(codes))):
        n = len(codes) - k
        h = h[:n] + codes[k:] * _MULT[k]
        if k + 1 in GRAMS:
            out.append((h + np.uint32(k)) * _SPREAD >> np.uint32(32 - BITS))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def _pieces(text: str | None, size: int = 1 << 20) -> Iterator[str]:
    """A very long text in pieces that overlap by an n-gram less one, so that all its n-grams are seen in bounded memory."""
    text = text or ""
    for k in range(0, max(1, len(text)), size):
        yield text[k:k + size + max(GRAMS) - 1]


def _distinct(b: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """Distinct values without sorting: of each value the place that was written last remains."""
    at = np.arange(len(b))
    scratch[b] = at
    return b[scratch[b] == at]


def text_features(text: str | None, place: np.ndarray) -> np.ndarray:
    """Distinct features (by place) of a text; ``place`` is -1 for a bucket without weight."""
    hit = np.concatenate([place[buckets(p)] for p in _pieces(text)])
    return np.unique(hit[hit >= 0]).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with each bucket for either class, over all rows of the task."""
    seen, scratch = np.zeros((2, 1 << BITS), np.int64), np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
            parts = [_distinct(buckets(p), scratch) for p in _pieces(text.as_py())]
            seen[label, parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))] += 1
    at = np.flatnonzero(seen.any(axis=0))
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[0, at]), pa.array(seen[1, at])], names=["bucket", "clean", "toxic"])


def ratios(clean: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Log-count ratio of every bucket: log of its share of the toxic counts over its share of the clean ones."""
    p, q = toxic + SMOOTHING, clean + SMOOTHING
    return np.log((p / p.sum()) / (q / q.sum()))


def choose(clean: np.ndarray, toxic: np.ndarray, rows: tuple[int, int]) -> np.ndarray:
    """The FEATURES buckets with the largest chi-square of presence against class."""
    a, b = toxic.astype(float), clean.astype(float)
    n0, n1 = rows
    n, seen = n0 + n1, a + b
    gap = a * (n0 - b) - b * (n1 - a)
    chi = n * gap ** 2 / np.maximum(1.0, seen * (n - seen) * float(n0) * n1)
    order = np.lexsort((np.arange(len(chi)), -chi))[:FEATURES]
    return np.sort(order[seen[order] > 0])


def fit(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic regression on ``scale``-d presence, each row at unit length."""
    col = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    val = scale[col]
    norm = np.sqrt(np.bincount(row, val ** 2, len(rows)))
    val = val / np.maximum(norm, 1e-12)[row]
    w, b = np.zeros(len(scale)), 0.0
    vw, vb, mw, mb = np.zeros(len(scale)), 0.0, np.zeros(len(scale)), 0.0
    for t in range(1, STEPS + 1):  # Adam over all rows: each step is two passes over the sparse values
        z = np.bincount(row, val * w[col], len(rows)) + b
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(rows)
        gw, gb = np.bincount(col, val * err[row], len(scale)) + PENALTY * w, err.sum()
        mw, mb = 0.9 * mw + 0.1 * gw, 0.9 * mb + 0.1 * gb
        vw, vb = 0.999 * vw + 0.001 * gw ** 2, 0.999 * vb + 0.001 * gb ** 2
        rate = 0.1 / np.sqrt(1 + t / 50)
        w -= rate * (mw / (1 - 0.9 ** t)) / (np.sqrt(vw / (1 - 0.999 ** t)) + 1e-9)
        b -= rate * (mb / (1 - 0.9 ** t)) / (np.sqrt(vb / (1 - 0.999 ** t)) + 1e-9)
    return w, b


class Model:
    """What scoring needs: the place of every bucket, and scaled weights by place."""

    def __init__(self, place: np.ndarray, scale: np.ndarray, weight: np.ndarray, offset: float):
        self.place, self.square, self.product, self.offset = place, scale ** 2, scale * weight, offset

    def score(self, text: str | None) -> float:
        x = text_features(text, self.place)
        z = self.offset + self.product[x].sum() / max(np.sqrt(self.square[x].sum()), 1e-12)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit_part(rows: DataFrame, n: int, most: int = FIT_ROWS) -> DataFrame:
    """The ``most`` rows with the smallest hash of id and text (``order``), whatever the partitions; rows equal in both count once.

    ``n`` is the number of rows.
    """
    keyed = rows.withColumn("order", F.xxhash64("id", "text", F.lit("fit")))
    # the first hash beyond the sample is looked for in a share of the hash range that is likely to hold enough of them, then among all
    for share in (2 * most / max(n, 1), 1.0) if n > 2 * most else (1.0,):
        top = min(int(share * 2**64) - 2**63, 2**63 - 1)
        beyond = keyed.filter(F.col("order") <= top).select("order").distinct().orderBy("order").offset(most).limit(1).collect()
        if beyond:
            keyed = keyed.filter(F.col("order") < beyond[0][0])
            break
    return keyed.dropDuplicates(["order"])


def train(rows: DataFrame) -> Model:
    """The classifier of labelled ``rows`` (id, text, toxic 0 or 1).

    Counts, ratios and the choice of features cover all rows; the driver gets at most 2^BITS count rows. Weights are fitted on
    the driver on at most FIT_ROWS rows of at most FEATURES small integers. With one class only, every score is the
    smoothed share of toxic rows.
    """
    per_class = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = per_class.get(0, 0), per_class.get(1, 0)
    place = np.full(1 << BITS, -1, np.int16)
    if not n0 or not n1:
        share = (n1 + 0.5) / (n0 + n1 + 2)
        return Model(place, np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    seen = np.zeros((2, 1 << BITS), np.int64)
    sums = rows.select("text", "toxic").mapInArrow(_counts, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    got = sums.toArrow()
    seen[:, got["bucket"].to_numpy()] = got["clean"].to_numpy(), got["toxic"].to_numpy()
    chosen = choose(seen[0], seen[1], (n0, n1))
    place[chosen] = np.arange(len(chosen))
    scale = ratios(seen[0], seen[1])[chosen]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [text_features(t.as_py(), place) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int64())).cast(pa.list_(pa.int32())), batch.column(1), batch.column(2)], names=["x", "toxic", "order"])

    part = fit_part(rows, n0 + n1).select("text", "toxic", "order")
    sample = part.mapInArrow(features, "x array<int>, toxic int, order long").toArrow().sort_by("order")
    x = sample["x"].combine_chunks()
    at = x.offsets.to_numpy()
    flat = x.values.to_numpy()
    weight, offset = fit([flat[a:b] for a, b in zip(at[:-1], at[1:])], sample["toxic"].to_numpy().astype(float), scale)
    return Model(place, scale, weight, offset)


def is_held_out(id_col: str, parts: int = 5) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", parts: int = 5) -> DataFrame:
    """All columns of ``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Learned from labelled rows that are not held out (crc32 of the id as text, modulo ``parts``, is not 0). Only the text is an input.
    Null and empty texts score the offset of the model. Null labels count as none; of several labels of an id the largest holds.
    Null ids are never labelled nor held out. Without any label every score is 0.25. Columns of the result replace equal names.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    texts = docs.filter(~is_held_out(id_col, parts)).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(small_side(known, LABELS_AT_ONCE), "id").select("id", "text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    model = train(stored(rows, "toxic-rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.schema.get_field_index(text_col)
            scores = [model.score(x.as_py()) for x in batch.column(t)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    plain = docs.drop("held_out", "score", "predicted").withColumn(text_col, F.col(text_col).cast("string"))
    scored = plain.mapInArrow(run, StructType([*plain.schema.fields, StructField("score", DoubleType())]))
    return scored.withColumn("held_out", is_held_out(id_col, parts)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@register("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted")
