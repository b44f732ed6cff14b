"""Alignment of two tokenizers' tokens by byte offsets, skipping along diagonals of one-to-one tokens."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import accumulate
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import register
from .store import stored

PART = 1 << 16          # characters from which a text is cut, at a place where neither tokenizer joins across
BATCH = 1 << 20         # characters encoded at a time
PAIRS_AT_ONCE = 2_000_000  # id pairs up to which their counts are broadcast whole
PROBE = 16              # tokens of the first block that is compared along a diagonal
HOT_PAIRS = 100_000     # beyond: pairs with at least this part of all links are broadcast, so there are at most so many

# fixed value: how byte-level BPE files of this kind cut a text before merging
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_CUT = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
_LOADED: dict = {}


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_level(path: str):
    """Encoder of a byte-level BPE file and the bytes of every token.

    Merges are applied by rank: in these files a merged token's id grows with its merge, which is checked, so ids are ranks and the
    faster engine gives the ids of the file's own library (as the tests hold it to). Special strings are ordinary text.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocabulary, cut, byte = spec["model"]["vocab"], spec["pre_tokenizer"], byte_of_char()
    merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    if spec["normalizer"] or cut["type"] != "ByteLevel" or not cut["use_regex"] or cut["add_prefix_space"] or merged != sorted(merged):
        raise ValueError(f"{path} is no plain byte-level BPE")
    special = {t["id"] for t in spec["added_tokens"]}
    spelled = {i: bytes(byte[c] for c in t) for t, i in vocabulary.items() if i not in special}
    table = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks={t: i for i, t in spelled.items()}, special_tokens={}), table


class Encoders:
    """Both tokenizers, and the bytes of every token of each."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a, self.bytes_a = byte_level(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)  # no piece of B joins a character and the space after it
        self.len_a, self.len_b = ([len(t) for t in x] for x in (self.bytes_a, self.bytes_b))
        self.name_a, self.name_b = ([str(i) for i in range(len(x))] for x in (self.bytes_a, self.bytes_b))
        self.left_a = [f"{n}|" for n in self.name_a]

    def parts(self, text: str) -> list[str]:
        """The text, if long cut at single spaces between visible characters: neither tokenizer joins across, and each puts that space before a part itself."""
        out, at = [], 0
        while self.cuts and len(text) - at > PART and (m := _CUT.search(text, at + PART)):
            out.append(text[at:m.start()])
            at = m.end()
        return [*out, text[at:]]

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of A and of B for every text; none if the tokens do not spell the text (those of A, which has all bytes, always do)."""
        cut = [self.parts(t) if t else [] for t in texts]
        ids_b, at = self.b.encode([p for parts in cut for p in parts], num_threads=1) if any(cut) else [], 0
        for text, parts in zip(texts, cut):
            own, at = ids_b[at:at + len(parts)], at + len(parts)
            b = own[0] if len(own) == 1 else [i for x in own for i in x]
            if text and b"".join(map(self.bytes_b.__getitem__, b)) == (" " + text).encode():
                a = self.a.encode_ordinary(" " + parts[0])
                for p in parts[1:]:
                    a += self.a.encode_ordinary(" " + p)
                yield a, b
            else:
                yield [], []


def diagonal_runs(ends_a: list[int], ends_b: list[int]) -> tuple[list[tuple[int, int, int, int, int]], list[int], list[int]]:
    """Groups of tokens between common ends: rows (i, j, n, i2, j2), and the token pairs that overlap inside irregular groups.

    From token i of A and j of B on, n tokens are one to one; tokens i + n to i2 of A and j + n to j2 of B are then one irregular group
    (none at the end of the text). Both lists increase and end with the same number.

    While the shift j - i holds, blocks of doubling length are compared and jumped; a block with a difference is halved, and what is
    left of it is read up to the first pair that differs. There the shorter side takes tokens until both end together, which gives the new shift.
    """
    out, left, right = [], [], []
    i, j, n = 0, 0, len(ends_a)
    while i < n:
        i0, j0, step = i, j, PROBE
        while i < n and ends_a[i:i + step] == ends_b[j:j + step]:
            i, j, step = i + step, j + step, 2 * step
        if i < n:
            while step > PROBE:
                step >>= 1
                if ends_a[i:i + step] == ends_b[j:j + step]:
                    i, j = i + step, j + step
            while ends_a[i] == ends_b[j]:
                i, j = i + 1, j + 1
        i, j = min(i, n), min(j, len(ends_b))
        run = i - i0
        if i < n:
            x, y = ends_a[i], ends_b[j]
            left.append(i), right.append(j)
            while x != y:
                if x < y:
                    i += 1
                    x = ends_a[i]
                else:
                    j += 1
                    y = ends_b[j]
                left.append(i), right.append(j)
            i, j = i + 1, j + 1
        out.append((i0, j0, run, i, j))
    return out, left, right


def _aligned(known: Encoders, a: list[int], b: list[int]) -> tuple[list[str], list[int], list[int]]:
    """Written groups, and A's and B's ids of every link."""
    runs, left, right = diagonal_runs(*(list(accumulate(map(size.__getitem__, ids))) for size, ids in ((known.len_a, a), (known.len_b, b))))
    one, two, names_a, names_b, lefts = [a[k] for k in left], [b[k] for k in right], known.name_a, known.name_b, known.left_a
    groups: list[str] = []
    for i, j, n, i2, j2 in runs:
        if n:
            x, y = a[i:i + n], b[j:j + n]
            one += x
            two += y
            groups += map(add, map(lefts.__getitem__, x), map(names_b.__getitem__, y))
        if i + n < i2:
            groups.append(",".join([names_a[k] for k in a[i + n:i2]]) + "|" + ",".join([names_b[k] for k in b[j + n:j2]]))
    return groups, one, two


def _paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, detail: bool = False) -> DataFrame:
    """One row per document: ``id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups``, and the distinct linked id pairs as ``pairs`` (A's id * 2^32 + B's) with ``links``, how many links hold each.

    A (a byte-level BPE file) encodes a space and the text, B (a sentencepiece model that puts the space itself) the text, both
    without special tokens. Byte offsets where tokens of both end cut the tokens into groups, written ``a1,a2|b1;a3|b2,b3``; tokens
    are linked where their bytes overlap. With ``detail`` the ids come too, as ``a_ids`` and ``b_ids``.

    Null and empty texts, and texts that either tokenizer does not spell byte by byte, have no tokens. Very long texts are encoded
    in parts, cut only where no token can span, and aligned whole. Null and repeated ids stay as they are; other columns are not
    read. An empty table gives an empty result. Both files must exist on every executor.
    """
    paths = (path_a or _paths()[0], path_b or _paths()[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if paths not in _LOADED:
            _LOADED[paths] = Encoders(*paths)
        known = _LOADED[paths]

        def rows(ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
            kept_a, kept_b, counts, written, one, two, size = [], [], [], [], [], [], []
            for a, b in known.encode(texts):
                groups, x, y = _aligned(known, a, b) if a else ([], [], [])
                counts.append((len(a), len(b), len(groups), len(x)))
                written.append(";".join(groups))
                one += x
                two += y
                if detail:
                    kept_a.append(a), kept_b.append(b)
            # distinct pairs of every text: one sort of (text, id of A, id of B) over the whole batch
            size = np.array([c[3] for c in counts], np.int64)
            wide = (len(known.bytes_a) - 1).bit_length(), (len(known.bytes_b) - 1).bit_length()
            code = (np.repeat(np.arange(len(texts)), size) << wide[0] | np.array(one, np.int64)) << wide[1] | np.array(two, np.int64)
            code, links = np.unique(code, return_counts=True)
            pairs = (code >> wide[1] & (1 << wide[0]) - 1) << 32 | code & (1 << wide[1]) - 1
            offsets = pa.array(np.searchsorted(code >> sum(wide), np.arange(len(texts) + 1)), pa.int32())
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(v) for v in x]), pa.int32()), pa.array([i for v in x for i in v], pa.int32()))
            arrays = [ids, *(pa.array(c, pa.int64()) for c in zip(*counts)), pa.array(written, pa.string()),
                      pa.ListArray.from_arrays(offsets, pa.array(pairs, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(links.astype(np.int32)))]
            if detail:
                arrays += [lists(kept_a), lists(kept_b)]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            texts, at = [t or "" for t in batch.column(1).to_pylist()], 0
            while at < len(texts):
                size, k = len(texts[at]), at + 1
                while k < len(texts) and size + len(texts[k]) < BATCH:
                    size, k = size + len(texts[k]), k + 1
                yield rows(batch.column(0).slice(at, k - at), texts[at:k])
                at = k

    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {d.schema['id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, links array<int>"
    schema += ", a_ids array<int>, b_ids array<int>" if detail else ""
    names = [c.split()[0] for c in schema.split(", ")]
    return d.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): links of every id pair over the whole corpus, and whether no pair with the same id of B has more."""
    counts = aligned.select(F.explode(F.arrays_zip("pairs", "links")).alias("p")).groupBy("p.pairs").agg(F.sum("p.links").alias("count")).withColumnRenamed("pairs", "pair")
    counts = stored(counts, "align-counts")
    id_b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    top = counts.groupBy(id_b).agg(F.max("count").alias("most"))
    return stored(counts.withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))).join(top, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "align-pairs")


def scored(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``aligned`` (from a written table, with a column ``row`` that tells its rows apart) with ``n_best`` and ``count_sum`` of its links instead of pairs and links.

    Counts are broadcast up to ``PAIRS_AT_ONCE`` pairs. Beyond, pairs with at least a ``HOT_PAIRS``th of all links are, of which there
    can be no more than that, and the rest, none of them hot, meets its counts in a shuffle.
    """
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.links").alias("m"))
    if counts.limit(PAIRS_AT_ONCE + 1).count() <= PAIRS_AT_ONCE:
        found = each.join(F.broadcast(counts), "pair")
    else:
        least = counts.agg(F.sum("count")).first()[0] / HOT_PAIRS
        hot = F.broadcast(counts.filter(F.col("count") >= least))
        rest = each.join(hot.select("pair"), "pair", "left_anti").join(counts.filter(F.col("count") < least), "pair")
        found = each.join(hot, "pair").unionByName(rest)
    sums = found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("m") * F.col("count")).alias("count_sum"))
    return aligned.drop("pairs", "links").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"]).drop("row")


@register("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    kept = stored(found.select(F.monotonically_increasing_id().alias("row"), F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "pairs", "links"), "align-rows")
    out = scored(kept, pair_counts(kept))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
