"""HNSW: recall against brute force, ties, copies, unusable vectors."""

import numpy as np
import pytest

from sirenframe.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>, label int"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)


def _vectors(n, d, seed, copies=0.0):
    rng = np.random.default_rng(seed)
    out = rng.normal(size=(n, d)) * rng.uniform(0.2, 3, size=(n, 1))
    out[rng.random(n) < copies] = out[0]
    return out.astype(np.float32)


def _brute(rows, every, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        scores = x @ x[q]
        others = [j for j in range(len(ids)) if j != q]
        best = sorted(others, key=lambda j: (-scores[j], ids[j]))[:k]
        out[int(ids[q])] = [(int(ids[j]), scores[j]) for j in best]
    return out


@pytest.mark.parametrize("copies, shard_rows", [(0.0, 700), (0.4, 5000)])
def test_recall_against_brute_force(spark, copies, shard_rows):
    x = _vectors(2500, 32, 3, copies)
    rows = [(i, [float(v) for v in x[i]]) for i in range(len(x))]
    got = hnsw.nearest_neighbours(_frame(spark, rows), shard_rows=shard_rows).collect()
    want = _brute(rows, 20, 20)
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert found.keys() == want.keys()
    hits = 0
    for q, hits_of in found.items():
        hits_of.sort()
        assert [h[0] for h in hits_of] == list(range(1, 21))
        assert [(-h[2], h[1]) for h in hits_of] == sorted((-h[2], h[1]) for h in hits_of)
        assert all(abs(h[2] - float(x[q].astype(float) @ x[h[1]].astype(float))) < 1e-9 for h in hits_of)
        hits += len({h[1] for h in hits_of} & {w[0] for w in want[q]})
    assert hits / (20 * len(want)) >= 0.95


def test_small_tables_are_exact_and_unusable_vectors_take_no_part(spark):
    rows = [(i, [float(i % 3 + 1), float(i % 5)]) for i in range(0, 15)]
    odd = [
        (20, None), (40, []), (60, [0.0, 0.0]), (80, [1.0, None]), (100, [float("nan"), 1.0]),
        (120, [float("inf"), 1.0]), (140, [1.0, 2.0, 3.0]), (None, [9.0, 9.0]),
    ]
    got = hnsw.nearest_neighbours(_frame(spark, rows + odd), every=5, k=20).collect()
    have = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        have.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert have == _brute(rows, 5, 20)


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5])]
    got = hnsw.nearest_neighbours(_frame(spark, rows), k=5).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [
        (0, 1, 0), (0, 1, 0), (0, 2, 1), (0, 2, 1),
    ]


@pytest.mark.parametrize("n", [0, 1])
def test_nothing_to_find(spark, n):
    assert hnsw.nearest_neighbours(_frame(spark, [(0, [1.0, 2.0])]).limit(n)).count() == 0


def test_same_graph_for_same_vectors():
    x = hnsw.one_norm(_vectors(600, 8, 1).astype(float))
    a, b = hnsw.build(x), hnsw.build(x)
    assert all((p == q).all() for p, q in zip(a.neighbours, b.neighbours))
    assert np.allclose(np.linalg.norm(x, axis=1), 1, atol=1e-5)

@pytest.mark.parametrize("longer", [1e3, 1e6, 1e200])
def test_a_few_long_vectors_do_not_cost_the_others_their_recall(longer):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:3] *= longer
    classes = hnsw.norm_classes(x)
    assert sorted(np.concatenate(classes)) == list(range(3000))
    shard = object.__new__(hnsw.Shard)
    shard.vectors, shard.starts = x, np.arange(3001)
    shard.vec_ids = shard.rows = np.arange(3000)
    shard.graphs = [
        (own, hnsw.log_norms(x[own]).max(), hnsw.build(hnsw.one_norm(x[own]))) for own in classes
    ]
    asked = np.arange(0, 3000, 20)
    got = shard.nearest(x[asked], asked, 20, hnsw.SEARCH_BEAM)
    hits = 0
    for q, found in zip(asked, got):
        scores = hnsw._products(x, x[q])
        scores[q] = -np.inf
        hits += len({i for _, i in found} & set(np.argsort(-scores, kind="stable")[:20].tolist()))
    assert hits / (20 * len(asked)) >= 0.95


def test_stored_shards_of_mixed_norms(spark):
    x = _vectors(600, 16, 5).astype(np.float64)
    x[::100] *= 1e5
    rows = [(i, [float(v) for v in x[i]]) for i in range(len(x))]
    frame = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    found = {}
    for r in hnsw.nearest_neighbours(frame).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    want = _brute(rows, 20, 20)
    hits = sum(len(found[q] & {w[0] for w in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.99
