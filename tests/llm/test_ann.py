import numpy as np
import pytest

from flowlens.llm import hnsw
from flowlens.llm.ann import nearest_neighbours


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id bigint, embedding array<float>, label int, shard int")


def brute(rows, every, nearest):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault((i, tuple(np.float32(v))), None)
    out = {}
    for i, v in good:
        if i % every == 0:
            scores = [(-float(np.sum(np.float64(v) * np.float64(w))), j) for j, w in good if j != i and len(w) == len(v)]
            out[i] = [(j, -s) for s, j in sorted(scores)[:nearest]]
    return out


def answers(result):
    out = {}
    for r in sorted(result.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("scaled", [False, True])
def test_recall_and_scores(spark, scaled):
    dice = np.random.default_rng(1)
    vectors = dice.normal(size=(1500, 24)).astype(np.float32)
    if scaled:  # inner products of vectors of unlike length
        vectors *= dice.uniform(0.2, 3, (1500, 1)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    want, got = brute(rows, 20, 20), answers(nearest_neighbours(frame(spark, rows), shard_rows=150))
    assert got.keys() == want.keys()
    recall = np.mean([len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.95
    for q, found in got.items():
        assert all(abs(s - float(vectors[q].astype(float) @ vectors[j].astype(float))) < 1e-9 for j, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))


def test_recall_beside_very_long_vectors(spark):
    dice = np.random.default_rng(8)
    vectors = dice.normal(size=(4000, 24)).astype(np.float32)
    vectors[dice.permutation(4000)[:8]] *= 10_000
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    want, got = brute(rows, 20, 20), answers(nearest_neighbours(frame(spark, rows), shard_rows=2000))
    assert np.mean([len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 20 for q in want]) >= 0.95


def test_special_rows_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [0.0, 0.0]), (4, None), (5, []),
            (6, [nan, 1.0]), (7, [1.0, inf]), (8, [1.0, None]), (None, [1.0, 1.0]), (40, [1.0, 2.0, 3.0]), (60, [0.0, -1.0])]
    rows += [(100 + i, [1.0, 0.0]) for i in range(1, 60)]
    assert answers(nearest_neighbours(frame(spark, rows))) == {q: f for q, f in brute(rows, 20, 20).items() if f}


def test_empty_table(spark):
    assert nearest_neighbours(frame(spark, [])).count() == 0
    assert nearest_neighbours(frame(spark, [(0, [1.0])])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 30, 700])
def test_graph_reaches_every_node(n):
    vectors = np.random.default_rng(n).normal(size=(n, 8)).astype(np.float32)
    graph = hnsw.build(vectors)
    found = graph.search(vectors, 64, 1)
    # nodes compare as points of one length: by distance
    pairs = graph.vectors @ hnsw._asking(graph.vectors).T
    square, most = (vectors.astype(float) ** 2).sum(1), 0
    rest = np.setdiff1d(np.arange(n), graph.apart)
    most = square[rest].max()
    even = np.sqrt(most - square[rest])
    want = vectors[rest].astype(float) @ vectors[rest].T + np.outer(even, even) - most
    assert np.allclose(pairs[np.ix_(rest, rest)], want, atol=1e-3 * most)
    assert len(graph.apart) == min(64, n // 8) and (not len(graph.apart) or square[graph.apart].min() >= most)
    best = rest[np.argmax(vectors @ vectors[rest].T, 1)]
    assert (found[:, 0] == best).mean() > 0.97
