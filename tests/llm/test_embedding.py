import numpy as np
import pytest
from helpers import components
from tablog.llm.embedding import forest, linked_pairs, near_vectors, quantised

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, threshold=0.9):
    good = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.float32(v).astype(np.float64)
            x = x / np.abs(x).max()
            good[i] = x / np.linalg.norm(x)
    links = [
        (a, b)
        for a in good
        for b in good
        if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold
    ]
    group = components([i for i, _ in rows], links)
    count = {i: 0 for i, _ in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return sorted((i, count[i], group[i], group[i] == i) for i, _ in rows)


def rows_of(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("group", [37, 10_000])
def test_links_against_brute_force(spark, group):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16))
    vectors = [
        (centres[rng.integers(6)] + rng.normal(size=16) * rng.choice([0, 0.2, 0.35, 0.5])) * rng.choice([1e-20, 1, 50])
        for _ in range(260)
    ] + list(rng.normal(size=(60, 16)))
    ids = rng.permutation(1000)[: len(vectors)].tolist()
    rows = [(i, np.float32(v).tolist()) for i, v in zip(ids, vectors)]
    got = near_vectors(rows_of(spark, rows), group=group).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]),
        (7, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [2.0, 4.0]), (10, [1.0, 2.0, 0.0]), (11, [-0.0, 0.0]),
        (12, [3e38, 3e38]), (13, [1e-40, 1e-40]),
    ]
    got = near_vectors(rows_of(spark, rows)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)
    without = near_vectors(rows_of(spark, [(None, [1.0, 2.0]), (4, [1.0, 2.0])])).collect()
    assert sorted(((r.vec_id or -1), r.n_links, r.component_id, r.kept) for r in without) == [
        (-1, 0, None, True), (4, 0, 4, True),
    ]
    assert near_vectors(rows_of(spark, [])).count() == 0


def test_repeated_rows_count_as_further_vectors(spark):
    got = near_vectors(rows_of(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1])])).collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]


def test_bounds_hold_and_settle_nothing_wrongly():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    x[:150] = x[0] + rng.normal(size=(150, 8)) * 0.45
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes, scale, error = quantised(x)
    off = np.abs(x @ x.T - (codes * scale[:, None]) @ (codes * scale[:, None]).T)
    assert (off <= error[:, None] + error + error[:, None] * error + 1e-12).all()
    i, j = linked_pairs(x, x, 0.9, True)
    want = {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.9)) if a < b}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_forest():
    i, j = np.array([0, 1, 5, 7, 6]), np.array([3, 4, 6, 8, 8])
    assert forest(10, i, j).tolist() == [0, 1, 2, 0, 1, 5, 5, 5, 5, 9]
