"""Each stage of the pipeline against a plain version over what its predecessor kept."""

import corpus_pipeline
from wireloom.llm.decontaminate import find_leaks
from wireloom.llm.mixing import mix
from wireloom.llm.store import stored
from test_near_dup import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    shape, kept, seen = docs.schema.simpleString(), [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, seen, SF), f"test-{name}")
        assert out.schema.simpleString() == shape
        before, after = {r.doc_id: r.text for r in seen.collect()}, {r.doc_id for r in out.collect()}
        assert after <= set(before)
        if name == "toxicity":
            toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            clean = [i for i in before if toxic.get(i) == 0]
            assert sum(i in after for i in clean) >= 0.98 * len(clean)
            assert sum(toxic.get(i) == 1 for i in after) < 0.5 * sum(toxic.get(i) == 1 for i in before)
        if name == "near_dup":
            assert after == {i for i, _, _, first in brute(sorted(before.items())) if first}
        if name == "decontaminate":
            assert after == set(before) - {r.doc_id for r in find_leaks(seen, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
        if name == "mixing":
            assert after == {r.doc_id for r in mix(seen).filter("sampled").collect()}
        seen = out
        kept.append(len(after))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == after and all(0 <= r.shard < 40 for r in rows)
