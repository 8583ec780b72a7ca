"""SimHash and vector near-duplicates against all pairs."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from levelloom.llm import common, simhash, vectors
from levelloom.llm.queries import QUERIES
from tests.llm.conftest import ODD, SF, union_find


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    return dict(fps), union_find([i for i, _ in fps], [(a, b) for k, (a, x) in enumerate(fps) for b, y in fps[:k] if (x ^ y).bit_count() <= 4])


def test_simhash_against_all_pairs(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    fps, want = plain_components(rows)
    got = QUERIES["op4_simhash"](spark, SF).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r.doc_id: r.component_id for r in got} == want
    kept = simhash.drop_near_duplicates(documents)
    assert kept.columns == documents.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("block", [simhash.BLOCK, 8])
def test_links_span_all_components(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 20, dtype=np.uint64)
    fps = set(map(int, rng.integers(0, 2**63, 300, dtype=np.uint64)))
    for c in centres:
        for _ in range(60):
            f = int(c)
            for bit in rng.choice(64, rng.integers(0, 7), replace=False):
                f ^= 1 << int(bit)
            fps.add(f)
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    d = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = [(r.a, r.b) for r in simhash.links(d, block=block).collect()]
    want = union_find(signed, [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4])
    assert union_find(signed, found) == want


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (500, 501), (501, 502), (502, 500), (501, 500)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges for n in e}
    assert got == {n: c for n, c in union_find(nodes, edges).items()}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_documents(odd_query, odd, none):
    got = odd_query("op4_simhash")
    assert len(got) == len(ODD)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    assert by[1, "0" * 16] == by[2, "0" * 16] == by[3, "0" * 16] == 1  # no words: linked like any other
    assert {r.component_id for r in got if r.doc_id in (None, 4)} == {4}
    kept = sorted(str(r.doc_id) for r in simhash.drop_near_duplicates(odd).collect())
    assert kept == ["1", "4", "5", "6", "7", "8"]
    assert simhash.near_duplicates(none).count() == simhash.drop_near_duplicates(none).count() == 0


def plain_links(rows):
    ok = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, pairs = {i: 0 for i, _ in rows}, []
    for k, (a, x) in enumerate(ok):
        for b, y in ok[:k]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                n[a] += 1
                n[b] += 1
                pairs.append((a, b))
    return n, union_find([i for i, _ in rows], pairs)


@pytest.mark.parametrize("block", [vectors.BLOCK, 3])
def test_vectors_against_all_pairs(spark, block):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in e.collect()]
    first = rows[0][1]
    rows += [(10_000 + i, [2 * x for x in rows[i][1]]) for i in range(5)] + [(20_000 + i, list(first)) for i in range(4)]
    rows += [(30_000, None), (30_001, []), (30_002, [0.0] * 64), (30_003, [float("nan")] * 64), (30_004, [None] * 64), (30_005, [1.0, 2.0]), (30_006, [2.0, 4.1])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("size", F.lit("x"))
    n, part = plain_links(rows)
    got = {r.vec_id: r for r in vectors.near_vectors(d, block=block).collect()}
    assert {i: r.n_links for i, r in got.items()} == n
    assert {i: r.component_id for i, r in got.items()} == part
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_empty_vectors(spark):
    e = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.near_vectors(e).count() == 0


def test_shape_keeps_recall():
    for n in (10, 10_000, 10**9):
        cells, tables = vectors.shape(n)
        assert (1 - vectors.collision(np.sqrt(0.1)) ** cells) ** tables <= 1.001e-3
