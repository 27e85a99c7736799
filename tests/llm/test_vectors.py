import numpy as np
import pytest

from quern.llm import vectors as v

SCHEMA = "chunk_id string, embedding array<float>, cell int, vec string, key string, id int, code binary"


def frame(spark, pairs):
    return spark.createDataFrame([(i, None if x is None else [None if y is None else float(y) for y in x], 1, "v", "k", 2, b"c") for i, x in pairs], SCHEMA)


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def clustered(n, dim, seed=0):
    """Random directions, a third of them within one tight bunch, another part in pairs."""
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, dim))
    third = n // 3
    m[:third] = m[0] + 0.35 * rng.standard_normal((third, dim))
    m[third + 1 : 2 * third : 2] = m[third : 2 * third - 1 : 2] + 0.3 * rng.standard_normal((len(range(third + 1, 2 * third, 2)), dim))
    return m.astype(np.float32)


def brute(m, k, least):
    s = unit(m.astype(np.float64)) @ unit(m.astype(np.float64)).T
    np.fill_diagonal(s, -9)
    out = set()
    for i in range(len(m)):
        for j in np.lexsort((np.arange(len(m)), -s[i].round(12)))[:k]:
            if s[i, j] >= least:
                out.add((i, int(j)))
    return out


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(v, "BASE_BLOCK", 60)
    monkeypatch.setattr(v, "QUERY_BLOCK", 300)
    m = clustered(1500, 32)
    got = {(int(r.id[1:]), int(r.neighbour[1:])) for r in v.similar_vectors(frame(spark, [(f"c{i:05d}", x) for i, x in enumerate(m)]), "chunk_id", "embedding", 32, 5, 0.8).collect()}
    want = brute(m, 5, 0.8)
    assert len(want) > 1000
    assert len(got & want) / len(want) >= 0.9
    assert len(got & want) / len(got) >= 0.9


def test_every_query_meets_all(spark, monkeypatch):
    monkeypatch.setattr(v, "BASE_BLOCK", 100)
    m = clustered(700, 24, 4)
    df = frame(spark, [(f"c{i:05d}", x) for i, x in enumerate(m)])
    asked = df.where("chunk_id like '%00'")
    got = {(int(r.id[1:]), int(r.neighbour[1:])) for r in v.nearest_for_queries(df, asked, "chunk_id", "embedding", 24, 5).collect()}
    want = {p for p in brute(m, 5, -1) if p[0] % 100 == 0}
    assert len(got & want) / len(want) >= 0.98


def test_bounds_hold():
    m = unit(np.random.default_rng(2).standard_normal((400, 96))).astype(np.float32)
    rotate, centre = v.rotation(96), m.mean(axis=0)
    codes, fine, facts = v.base_codes(m, centre, rotate)
    planes, asks = v.query_codes(m[:100], centre, rotate)
    squared = float(centre @ centre)
    est, bound = v.estimate(planes, asks, codes, facts, 96, squared)
    exact = m[:100] @ m.T
    assert (np.abs(est - exact) <= bound).mean() > 0.99
    i, j = np.nonzero(np.ones_like(exact))
    finer, tight = v.refine(planes, asks, fine, facts, i, j, 96, squared)
    assert (np.abs(finer - exact[i, j]) <= tight).mean() > 0.99 and tight.mean() < bound.mean() / 3


def test_recall_without_a_floor(spark):
    m = clustered(1500, 32, 7)
    got = {(int(r.id[1:]), int(r.neighbour[1:])) for r in v.similar_vectors(frame(spark, [(f"c{i:05d}", x) for i, x in enumerate(m)]), "chunk_id", "embedding", 32, 5, -1.0).collect()}
    want = brute(m, 5, -1)
    assert len(got) == len(want) == 7500 and len(got & want) / len(want) >= 0.9


def test_an_id_with_several_vectors_counts_with_the_greatest(spark):
    pairs = [("a", [1.0, 0, 0, 0]), ("a", [0, 1.0, 0, 0]), ("b", [0.99, 0.1, 0, 0]), ("c", [0.01, 1.0, 0, 0])]
    got = {(r.id, r.neighbour) for r in v.similar_vectors(frame(spark, pairs), "chunk_id", "embedding", 4, 3, 0.8).collect()}
    assert got == {("a", "b"), ("b", "a")}


def test_unusable_copies_and_ties(spark):
    a, b = [1.0, 0, 0, 0], [0, 1.0, 0, 0]
    pairs = [(f"a{i}", a) for i in range(8)] + [("b", b), ("c", [0, 0.999, 0.01, 0]), ("d", None), ("e", []), ("f", [1.0, 2]), ("g", [0, 0, 0, 0]), ("h", [float("nan"), 1, 1, 1]), ("i", [float("inf"), 1, 1, 1]), ("j", [None, 1, 1, 1]), (None, a), ("b", b), ("k", [5.0, 0, 0, 0])]
    got = {}
    for r in v.similar_vectors(frame(spark, pairs), "chunk_id", "embedding", 4, 3, 0.8).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbour, round(r.similarity, 3)))
    assert sorted(got["a7"]) == [(1, "a0", 1.0), (2, "a1", 1.0), (3, "a2", 1.0)]
    assert [x[1] for x in sorted(got["a0"])] == ["a1", "a2", "a3"]
    assert sorted(got["k"]) == [(1, "a0", 1.0), (2, "a1", 1.0), (3, "a2", 1.0)]
    assert [x[1] for x in got["b"]] == ["c"] and [x[1] for x in got["c"]] == ["b"]
    assert set(got) == {*(f"a{i}" for i in range(8)), "b", "c", "k"}


@pytest.mark.parametrize("pairs", [[], [("a", [1.0, 0, 0, 0])], [("a", None)]])
def test_nothing_to_compare(spark, pairs):
    df = frame(spark, pairs)
    assert v.similar_vectors(df, "chunk_id", "embedding", 4, 5, 0.8).count() == 0
    assert v.nearest_for_queries(df, df, "chunk_id", "embedding", 4, 5).count() == 0
