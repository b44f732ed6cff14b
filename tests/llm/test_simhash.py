"""SimHash fingerprints and their components against plain loops."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wireloom.llm import QUERIES, load, simhash
from wireloom.llm.simhash import Golay, fingerprint, keys_of, simhash_duplicates

load()
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def plain_fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    """Smallest index reachable, for every fingerprint of a list."""
    arr, root = np.array(fps, np.uint64), list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1:] ^ arr[i]) <= 3):
            x, y = sorted((find(i), find(i + 1 + int(j))))
            root[y] = x
    return [find(i) for i in range(len(fps))]


def linked(spark, fps):
    """Components by the operator's links."""
    from functools import reduce

    from pyspark.sql import DataFrame

    from wireloom.llm.linked import labels_of
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in set(fps)], "node long")
    got = {r.node: r.label for r in labels_of(reduce(DataFrame.unionByName, simhash._links(nodes))).collect()}
    out = {}
    for i, f in enumerate(fps):
        node = int(np.uint64(f).view(np.int64))
        out.setdefault(got.get(node, node), []).append(i)
    first = {i: min(m) for m in out.values() for i in m}
    return [first[i] for i in range(len(fps))]


def test_golay_code():
    code, words = Golay(), np.random.default_rng(1).integers(0, 1 << 23, 5000)
    assert sorted(np.bitwise_count(code.leader)) == [0] + [1] * 23 + [2] * 253 + [3] * 1771
    around = code.around(words)
    assert set((around >= 0).sum(axis=1)) == {1, 6}
    for b in range(23):
        assert (code.nearest(words ^ (1 << b))[:, None] == around).any(axis=1).all()


def test_every_close_pair_shares_a_key():
    rnd = random.Random(2)
    for n in (1, 2, 3):
        for _ in range(700):
            u = rnd.getrandbits(64)
            v = u
            for b in rnd.sample(range(64), n):
                v ^= 1 << b
            key, node, side = keys_of(np.array([u, v], np.uint64).view(np.int64))
            rows = {(k, x): s for k, x, s in zip(key.tolist(), node.view(np.uint64).tolist(), side.tolist())}
            assert any((k, v) in rows and {s, rows[k, v]} in ({0, 1}, {2}) for (k, x), s in rows.items() if x == u)


def test_fingerprints():
    for text in ("", "A b", "one", "x y z", "a  B\tc\nd a b c", "Ä ä é x \x1c y", "w " * 999, "1 2 3 4"):
        assert fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("large", [64, 3])
def test_clouds_chains_and_strangers(spark, monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE", large)
    rnd, fps = random.Random(3), []
    for bits, n in ((9, 300), (40, 300), (16, 200)):  # clouds: every member turns some of these bits
        base, soft = rnd.getrandbits(64), rnd.sample(range(64), bits)
        fps += [base ^ sum(1 << b for b in soft if rnd.random() < 0.4) for _ in range(n)]
    f = rnd.getrandbits(64)
    for _ in range(200):  # a chain
        for b in rnd.sample(range(64), 3):
            f ^= 1 << b
        fps.append(f)
    fps += [rnd.getrandbits(64) for _ in range(500)] + [0, 1 << 63, (1 << 64) - 1]
    rnd.shuffle(fps)
    assert linked(spark, fps) == components(fps)


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.id, int(np.int64(r.fp).view(np.uint64)), r.component_id) for r in simhash_duplicates(df).collect())
    order = sorted(rows, key=lambda r: r[0])
    fps = [plain_fingerprint(t) for _, t in order]
    assert got == sorted((i, f, order[k][0]) for (i, _), f, k in zip(order, fps, components(fps)))


def test_given_table_and_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    check(spark, [tuple(r) for r in docs.collect()])
    rows = QUERIES["op13_simhash"](spark, "/root/testdata/sf0.001").collect()
    want = {r.doc_id: f"{plain_fingerprint(r.text):016x}" for r in docs.collect()}
    assert {r.doc_id: r.fingerprint for r in rows} == want


def test_copies_empty_texts_and_hot_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 20)
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(500)}" for _ in range(300)]
    rows = [" ".join(base[:k] + ["edit"] + base[k + 1:]) for k in range(0, 300, 7)] + ["same text here now"] * 50 + [""] * 30 + [None, " \n", "a", "A b"]
    check(spark, list(enumerate(rows)))


def test_nulls_repeated_ids_clashing_columns_long_texts_and_empty_table(spark):
    rnd = random.Random(5)
    long = " ".join(str(rnd.randrange(10**6)) for _ in range(300_000))
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "other words stand here"), (None, "left alone in the cold"), (9, long), (8, long + " end"), (7, "x" * 3_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("id", "fp", "node", "key", "label", "component_id"):
        df = df.withColumn(c, F.lit("clash"))
    got = sorted(((r.id, r.component_id) for r in simhash_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 4), (4, 4), (4, 4), (None, None), (9, 8), (8, 8), (7, 7)], key=str)
    check(spark, [])
