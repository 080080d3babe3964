import numpy as np
from pyspark.sql import functions as F

from quernstone.llm import p4_neighbours as m

SCHEMA = "vec_id long, embedding_model string, vector array<float>, leaf int, a string"


def rows(seed: int, n: int, dim: int, first: int, model: str):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, dim))
    v = centres[rng.integers(0, n // 6, n)] + 0.3 * rng.normal(size=(n, dim))
    return [(first + i, model, v[i].astype(np.float32).tolist(), 1, "x") for i in range(n)]


def brute(data, k=5):
    out = {}
    for model in {(r[1], len(r[2])) for r in data if r[2]}:
        own = {r[0]: np.array(r[2], dtype=np.float32).astype(np.float64) for r in data if r[2] and None not in r[2] and (r[1], len(r[2])) == model}
        own = {i: x for i, x in own.items() if np.isfinite(x).all() and x.any()}
        ids = sorted(own)
        x = np.array([own[i] / np.linalg.norm(own[i]) for i in ids])
        s = np.round(x @ x.T, 9)
        np.fill_diagonal(s, -9)
        for i, row in zip(ids, s):
            out[i] = [(ids[j], row[j]) for j in np.argsort(-row, kind="stable")[:k] if row[j] > -9]
    return out


def test_recall_ties_and_dirty_rows(spark):
    data = rows(1, 600, 16, 0, "m") + rows(2, 60, 8, 1000, "m") + rows(3, 60, 16, 2000, "n")
    copy = data[0][2]
    data += [(5000 + i, "m", copy, 1, "x") for i in range(40)]
    data += [(9000, "m", None, 1, "x"), (9001, "m", [0.0] * 16, 1, "x"), (9002, "m", [float("nan")] * 16, 1, "x"), (9003, None, [1.0] * 16, 1, "x"), (9004, "m", [None] * 16, 1, "x"), data[3], data[3]]
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    search = m.nearest(df, leaf_rows=64)
    got = {}
    for r in search.found.collect():
        got.setdefault(r.a, {})[r.b] = r.cosine
    want = brute([r for r in data if r[1]])
    hits = sum(j in got.get(i, {}) for i, v in want.items() for j, _ in v)
    assert hits >= 0.9 * sum(len(v) for v in want.values())
    for i in range(5000, 5040):  # copies: the five smallest other ids of the group
        assert sorted(got[i]) == [x for x in [0, *range(5000, 5040)] if x != i][:5]
    assert not {9000, 9001, 9002, 9003, 9004} & got.keys()
    assert all(r[2] >= 0.9 for r in search.recall.values())


def test_queries_floor_and_empty(spark):
    df = spark.createDataFrame(rows(4, 200, 16, 0, "m"), SCHEMA)
    some = m.nearest(df, queries=F.col("vec_id") % 20 == 0, leaf_rows=64).found
    assert {r.a for r in some.collect()} == set(range(0, 200, 20))
    assert m.nearest(df, minimum_cosine=0.9, leaf_rows=64).found.where("cosine < 0.9").count() == 0
    assert m.nearest(df.limit(0)).found.count() == 0


def test_best_bin_first_visits_all_leaves_once():
    x = np.random.default_rng(1).normal(size=(500, 12)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = m.fit_tree(x, 500, leaf_rows=20, branches=4)
    v = tree.visits(x[:20], tree.leaves)
    assert tree.leaves > 8 and all(sorted(r) == list(range(tree.leaves)) for r in v.tolist())


def test_calibration_goes_on_until_the_recall_is_reached(spark, monkeypatch):
    df = spark.createDataFrame(rows(7, 400, 24, 0, "m"), SCHEMA)
    monkeypatch.setattr(m, "FIRST_REACH", 1)
    search = m.nearest(df, leaf_rows=16, wanted=0.999)
    ((n, visits, recall),) = search.recall.values()
    assert n == 400 and visits > 1 and recall >= 0.999
    (capped,) = m.nearest(df, leaf_rows=16, wanted=0.999, most_visits=2).recall.values()
    assert capped[1] == 2 and capped[2] < 0.999  # a ceiling asked for is kept, and its recall told
