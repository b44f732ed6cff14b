"""Token counts against the model's own library."""

import random

import public_tokenizers
import sentencepiece
from hypothesis import given, settings, strategies as st

from wireloom.llm.token_count import Counts, PieceModel, count_texts, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = PieceModel(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab the\n▁  é☃→z.日\t0<s> ́"), max_size=60), min_size=1, max_size=5))
def test_any_text(texts):
    assert count_texts(texts, MODEL, Counts(MODEL)) == [len(LIBRARY.encode(t)) for t in texts]


def test_tables_and_odd_texts(spark):
    rnd = random.Random(2)
    odd = [" " * n for n in range(0, 120)] + ["x" * 5000, "ab" * 4000, "☃" * 700, "<s>a</s><unk><0x0A>", "a\x00b", "▁▁▁ q", "the " * 200_000]
    odd += ["".join(rnd.choice("abcdefghestionth") for _ in range(rnd.randrange(250, 900))) for _ in range(30)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([*enumerate(odd, 10**6), (None, "null id"), (7, None)], docs.schema)
    rows = docs.unionByName(more).collect()
    got = token_counts(docs.unionByName(more)).collect()
    want = [(r.doc_id, len((r.text or "").encode()), n := len(LIBRARY.encode(r.text or "")), n > 4096) for r in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts(docs.limit(0)).collect() == []
