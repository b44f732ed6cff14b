"""Token alignment against plain byte offsets, with the libraries' own tokens of whole texts."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wireloom.llm import QUERIES, alignment, load
from wireloom.llm.alignment import align, byte_of_char, diagonal_runs, pair_counts, scored

load()
A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
BYTE = byte_of_char()
NAME = {i: t for t, i in A.get_vocab().items()}


def tokens(text):
    """(id, start, end) of both sides; none if a side does not spell the text."""
    if not text:
        return [], []
    out = []
    for ids, spell in ((A.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(BYTE[c] for c in NAME[i])),
                       (B.encode(text), lambda i: bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode())):
        rows, at, joined = [], 0, b""
        for i in ids:
            joined += spell(i)
            rows.append((i, at, len(joined)))
            at = len(joined)
        if joined != (" " + text).encode():
            return [], []
        out.append(rows)
    return out


def plain(rows):
    """rows (id, text) -> the query's rows."""
    per, corpus = [], Counter()
    for i, text in rows:
        a, b = tokens(text)
        common = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, low = [], 0
        for end in common:
            groups.append(",".join(str(t) for t, s, e in a if low <= s and e <= end) + "|" + ",".join(str(t) for t, s, e in b if low <= s and e <= end))
            low = end
        links = Counter((x, y) for x, s, e in a for y, s2, e2 in b if s < e2 and s2 < e)
        corpus.update(links)
        per.append((i, len(a), len(b), groups, links))
    most = {}
    for (_, y), n in corpus.items():
        most[y] = max(most.get(y, 0), n)
    return sorted(((i, na, nb, len(g), sum(ls.values()), sum(n for p, n in ls.items() if corpus[p] == most[p[1]]), sum(n * corpus[p] for p, n in ls.items()),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if na else "") for i, na, nb, g, ls in per), key=str)


TEXTS = ["Hello world", "", None, " ", "  two  spaces ", "naïve café — Ünïcode ﬁ", "日本語のテキスト、中文", "🙂🙃 emoji 👩‍👩‍👧", "<|endoftext|> and <s> </s> <unk> <0x41>", "has ▁ inside", "a\tb\r\n\n c\x00d\x1f", "1234567890 3.14",
         "e" * 300, "don't we'll I'VE", "x_y(z)[0]; return {};", "   ", "\n", "ÀÈ́ ​ 　 \xa0.", "Hello world", "Hello world"]


def got(df):
    kept = alignment.stored(align(df).select(F.monotonically_increasing_id().alias("row"), "*"), "test")
    out = scored(kept, pair_counts(kept)).collect()
    return sorted(((r.id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else "") for r in out), key=str)


def test_diagonal_runs():
    rnd = random.Random(1)
    for _ in range(400):
        n = rnd.randrange(1, 60)
        cut = lambda p: sorted({e for e in range(1, n) if rnd.random() < p} | {n})
        a, b = cut(rnd.choice([0.2, 0.9, 1])), cut(rnd.choice([0.2, 0.9, 1]))
        runs, left, right = diagonal_runs(a, b)
        ends, i, j, pairs = [], 0, 0, list(zip(left, right))
        for i0, j0, m, i2, j2 in runs:
            assert (i0, j0) == (i, j) and a[i0:i0 + m] == b[j0:j0 + m]
            ends += a[i0:i0 + m]
            pairs += list(zip(range(i0, i0 + m), range(j0, j0 + m)))
            if i0 + m < i2:
                assert a[i2 - 1] == b[j2 - 1] and (i2 - i0 - m, j2 - j0 - m) != (1, 1)
                ends.append(a[i2 - 1])
            i, j = i2, j2
        assert (i, j) == (len(a), len(b)) and ends == sorted(set(a) & set(b))
        span = lambda x, k: (x[k - 1] if k else 0, x[k])
        want = {(i, j) for i in range(len(a)) for j in range(len(b)) if max(span(a, i)[0], span(b, j)[0]) < min(a[i], b[j])}
        assert len(pairs) == len(want) and set(pairs) == want


def test_odd_texts(spark):
    rows = [*enumerate(TEXTS), (None, "null id"), (3, "repeated id"), (3, "repeated id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("row", "pair", "pairs", "links", "count", "best", "groups"):
        df = df.withColumn(c, F.lit("clash"))
    assert got(df) == plain(rows)


def test_shuffled_counts_and_small_parts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "PAIRS_AT_ONCE", 0)
    monkeypatch.setattr(alignment, "HOT_PAIRS", 300)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    rows = [tuple(r) for r in docs.collect()]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


@pytest.mark.parametrize("part", [1, 7, 50])
def test_cuts_do_not_change_tokens(part, monkeypatch):
    monkeypatch.setattr(alignment, "PART", part)
    known = alignment.Encoders(*alignment._paths())
    rnd = random.Random(part)
    words = [t for t in TEXTS if t] + ["Abc", "it's", "  ", " ", "\n", "-", "ß", "'s", "9"]
    texts = [rnd.choice([" ", "", "  "]).join(rnd.choice(words) for _ in range(40)) for _ in range(60)]
    for text, (a, b) in zip(texts, known.encode(texts)):
        x, y = tokens(text)
        assert (a, b) == ([t[0] for t in x], [t[0] for t in y])


def test_given_table_very_long_text_and_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = sorted((tuple(r) for r in QUERIES["op11_alignment"](spark, "/root/testdata/sf0.001").collect()), key=str)
    by_id = {r[0]: r for r in rows}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert by_id.keys() == texts.keys()
    for i, t in texts.items():
        a, b = tokens(t)
        assert by_id[i][1:4] == (len(a), len(b), len({e for *_, e in a} & {e for *_, e in b}))
        assert by_id[i][4] == by_id[i][1] + by_id[i][2] - by_id[i][3]
    rnd = random.Random(3)
    long = " ".join(rnd.choice(["alpha", "béta", "gamma,", "Delta\n", "42"]) for _ in range(200_000))
    r = align(spark.createDataFrame([(1, long)], "doc_id long, text string"), detail=True).collect()[0]
    assert r.a_ids == A.encode(" " + long, add_special_tokens=False).ids and r.b_ids == B.encode(long)
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []
