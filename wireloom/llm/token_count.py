"""Token counts by rank-synchronous array merging: byte-fallback BPE over whole texts."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import register

NONE = np.iinfo(np.int32).max
LONG = 256          # symbols from which a pre-token is merged with a queue instead of in rounds
CACHE = 200_000     # pre-tokens whose counts a task keeps
BATCH = 20_000      # pre-tokens merged at a time
_LOADED: dict = {}


class PieceModel:
    """The vocabulary of a sentencepiece BPE model as arrays: symbols of code points, and rank and result of every pair.

    Two neighbours merge if their concatenation is a piece; the best score goes first, the leftmost among equals.
    The model must have the identity normalizer, a dummy prefix and byte fallback, and no piece with a space after a letter,
    so that texts can be cut before every run of spaces; ``__init__`` checks the last.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        if any("▁" in p.lstrip("▁") or (p[:2] == "▁▁" and p.strip("▁")) for p in score):
            raise ValueError("a piece has a space after its first character")
        self.id = {p: i for i, p in enumerate(dict.fromkeys([*score, *(c for p in score for c in p)]))}
        self.symbol = np.full(0x110000, -1, np.int32)
        for p, i in self.id.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.single = np.zeros(0x110000, bool)  # code points that are pieces; others fall back to bytes
        for p in score:
            if len(p) == 1:
                self.single[ord(p)] = True
        order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs = [(self.id[p[:k]] << 32 | self.id[p[k:]], order[s], self.id[p]) for p, s in score.items() for k in range(1, len(p)) if p[:k] in self.id and p[k:] in self.id]
        pairs.sort()
        self.keys = np.array([p[0] for p in pairs], np.int64)
        self.ranks = np.array([p[1] for p in pairs], np.int32)
        self.merged = np.array([p[2] for p in pairs], np.int32)
        self.line_cuts = not any("\n" in p for p in score)
        self.space = self.id["▁"]
        self.runs = [0] + [int(self.merge(["▁" * m])[0][0]) for m in range(1, 65)]
        if any(self.runs[m] != self.runs[m - 16] + 1 for m in range(33, 65)):
            raise ValueError("runs of spaces do not repeat with period 16")

    def run(self, m: int) -> int:
        """Tokens of ``m`` spaces that no word takes up."""
        if m < 64:
            return self.runs[m]
        blocks = (m - 48) // 16
        return blocks + self.runs[m - 16 * blocks]

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, q), len(self.keys) - 1)
        hit = (self.keys[at] == q) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NONE), self.merged[at]

    def merge(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token count of every pre-token, and whether its first symbol is still a single space.

        All pre-tokens lie one after the other in one array. In every round each of them applies its best pair (the
        leftmost of the best rank); those without a pair leave the array.
        """
        size = np.array([len(t) for t in tokens])
        codes = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym, seq = self.symbol[codes], np.repeat(np.arange(len(tokens)), size)
        wide = np.where(self.single[codes], 1, 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))
        count = np.bincount(seq, wide, len(tokens)).astype(np.int64)
        head = np.empty(len(tokens), np.int32)
        head[:] = sym[np.cumsum(size) - size]
        rank, into = np.full(len(sym), NONE, np.int32), np.zeros(len(sym), np.int32)
        rank[:-1], into[:-1] = self._pairs(sym[:-1], sym[1:])
        rank[:-1][seq[1:] != seq[:-1]] = NONE
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            best = np.minimum.reduceat(rank.astype(np.int64) << 32 | np.arange(len(rank)), starts)
            live = best >> 32 != NONE
            at = best[live] & 0xFFFFFFFF
            if not len(at):
                break
            count[seq[at]] -= 1
            sym[at] = into[at]
            first = starts[live] == at
            head[seq[at[first]]] = sym[at[first]]
            keep = np.repeat(live, np.diff(np.r_[starts, len(sym)]))
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            sym, seq, rank, into = sym[keep], seq[keep], rank[keep], into[keep]
            at = place[at]
            for i in (at, at[at > 0] - 1):  # the merged symbol has new neighbours on both sides
                inside = i + 1 < len(sym)
                rank[i[~inside]] = NONE
                i = i[inside]
                r, m = self._pairs(sym[i], sym[i + 1])
                rank[i], into[i] = np.where(seq[i] == seq[i + 1], r, NONE), m
        return count, head == self.space

    def merge_long(self, token: str) -> tuple[int, bool]:
        """The same for one long pre-token with a queue of pairs, so that its time does not grow with the square of its length."""
        codes = np.frombuffer(token.encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.symbol[codes].tolist()
        count = int(np.where(self.single[codes], 1, 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)).sum())
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        arr = np.array(sym, np.int32)
        rank, into = self._pairs(arr[:-1], arr[1:])
        heap = [(int(rank[i]), i, sym[i], sym[i + 1], int(into[i])) for i in np.flatnonzero(rank != NONE)]
        heapq.heapify(heap)
        table = _Lookup.of(self)
        while heap:
            _, i, left, right, result = heapq.heappop(heap)
            j = after[i]
            if sym[i] != left or j >= n or sym[j] != right:
                continue
            sym[i], sym[j] = result, -2
            count -= 1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (hit := table.get(sym[a] << 32 | sym[b])) and sym[a] >= 0 and sym[b] >= 0:
                    heapq.heappush(heap, (hit[0], a, sym[a], sym[b], hit[1]))
        return count, sym[0] == self.space


class _Lookup:
    """The pair table as a dictionary, made when the first long pre-token comes."""

    @staticmethod
    def of(model: PieceModel) -> dict:
        if not hasattr(model, "_dict"):
            model._dict = {k: (r, m) for k, r, m in zip(model.keys.tolist(), model.ranks.tolist(), model.merged.tolist())}
        return model._dict


class Counts:
    """Counts of pre-tokens met so far: words after a space, words at the start of a line, and those before which the space stays alone."""

    def __init__(self, model: PieceModel):
        self.model, self.spaced, self.bare, self.alone = model, {}, {}, set()

    def learn(self, words: set[str], lead: str, cache: dict) -> None:
        short = []
        for w in words - cache.keys():
            if len(w) >= LONG:
                cache[w], alone = self.model.merge_long(lead + w)
                if alone:
                    self.alone.add(w)
            else:
                short.append(w)
        for k in range(0, len(short), BATCH):
            part = short[k:k + BATCH]
            n, alone = self.model.merge([lead + w for w in part])
            cache.update(zip(part, n.tolist()))
            if lead:
                self.alone.update(part[i] for i in np.flatnonzero(alone))

    def forget(self) -> None:
        if len(self.spaced) + len(self.bare) > CACHE:
            self.spaced.clear(), self.bare.clear(), self.alone.clear()


def count_texts(texts: list[str], model: PieceModel, counts: Counts) -> list[int]:
    """Token count of every text."""
    cut, spaced, bare = [], set(), set()
    for text in texts:
        # a line is a word and then words after runs of spaces; a line feed belongs to no piece, so it cuts and is one byte token
        text = " " + text.replace("▁", " ") if text else ""
        cut.append([line.split(" ") for line in (text.split("\n") if model.line_cuts else [text])] if text else [])
        for parts in cut[-1]:
            spaced.update(parts[1:])
            bare.add(parts[0])
    spaced.discard(""), bare.discard("")
    counts.learn(spaced, "▁", counts.spaced)
    counts.learn(bare, "", counts.bare)
    get, out = counts.spaced.__getitem__, []
    for lines in cut:
        total = max(0, len(lines) - 1)
        for parts in lines:
            total += counts.bare[parts[0]] if parts[0] else 0
            rest = parts[1:]
            if "" not in rest:
                total += sum(map(get, rest))
                continue
            spaces = 0
            for w in rest:
                spaces += 1
                if w:
                    if spaces > 1:
                        total += model.run(spaces) - 1 if w in counts.alone else model.run(spaces - 1)
                    total += get(w)
                    spaces = 0
            total += model.run(spaces)
        out.append(total)
    counts.forget()
    return out


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, limit: int = 4096) -> DataFrame:
    """``id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of every row, as the model's own library counts whole texts without added tokens.

    Null and empty texts have no bytes and no tokens. Null and repeated ids stay as they are. An empty table gives an empty result.
    ``model_path`` (by default that of the installed public vocabulary) must exist on every executor.
    """
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _LOADED:
            _LOADED[model_path] = Counts(PieceModel(model_path))
        known = _LOADED[model_path]
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # a few hundred texts at a time, so that the pre-tokens of long ones do not pile up
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                counts, k = [], 0
                while k < len(texts):
                    size, j = len(texts[k]), k + 1
                    while j < len(texts) and size + len(texts[j]) < 2_000_000:
                        size, j = size + len(texts[j]), j + 1
                    counts += count_texts(texts[k:j], known.model, known)
                    k = j
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])
                at += 256

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


@register("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", "over_limit")
