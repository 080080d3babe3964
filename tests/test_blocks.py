"""The best k rows a query, of scans in blocks, against brute force."""

import numpy as np
import pytest

from quernstone.operators import blocks, dense, lexical
from quernstone.queries import search


@pytest.fixture
def small_batches(spark):
    """Several batches a task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_equal_texts_are_searched_once(spark, tmp_path, monkeypatch):
    texts = ["cobalt mine by the river", "the river of the town", "a town of mills", "mills and cobalt", "harbour"]
    spark.createDataFrame([(f"c{i}", "d", f"s{i % 2}", t, 0) for i, t in enumerate(texts)], "chunk_id string, document_id string, source_id string, contents string, health_flags int").write.parquet(f"{tmp_path}/chunks.parquet")
    asked = ["cobalt river", "town mills", "of the", "cobalt river", None, "cobalt river"]
    spark.createDataFrame([(i, t) for i, t in enumerate(asked)] * 2, "search_id long, query_text string").write.parquet(f"{tmp_path}/search_log.parquet")
    seen, top_k = [], lexical.bm25_top_k
    monkeypatch.setattr(lexical, "bm25_top_k", lambda index, queries, k, *a: seen.append((queries.count(), k)) or top_k(index, queries, k, *a))
    got: dict[int, list] = {}
    for r in search.q_search_hybrid_embedded(spark, str(tmp_path)).orderBy("query_id", "selected_rank").collect():
        got.setdefault(r.query_id, []).append(tuple(r)[1:])
    assert seen == [(3, 80)]  # three texts, and no rank beyond those that the walk looks at
    assert got[0] == got[3] == got[5] and {r[1] for r in got[0]} >= {"c0", "c1", "c3"} and [r[0] for r in got[0]] == list(range(1, len(got[0]) + 1))
    assert {r[1] for r in got[1]} >= {"c1", "c2", "c3"} and 4 not in got


def test_dense_blocks_equal_brute_force(spark, small_batches):
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (900, 4)).astype(float)  # few values: many equal cosines
    x[~x.any(axis=1)] = 1.0
    keys = [f"k{i:04}" for i in rng.permutation(900)]
    keys[10:14] = [keys[0]] * 4  # one key with several vectors, of which two are equal
    x[11] = x[10]
    kinds = ["m" if i % 7 else "n" for i in range(900)]
    q = x[rng.choice(900, 40)] * 3
    vectors = spark.createDataFrame(list(zip(keys, kinds, x.tolist(), strict=True)), "chunk_id string, kind string, vector array<float>")
    queries = spark.createDataFrame([(i, "mn"[i % 2], v) for i, v in enumerate(q.tolist())], "query_id long, kind string, vector array<float>")
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    cosine = np.round(unit(q) @ unit(x).T, 9)
    want = {}
    for i in range(40):
        pairs = {(-cosine[i, j], keys[j]) for j in range(900) if kinds[j] == "mn"[i % 2]}
        want[i] = [(k, -s) for s, k in sorted(pairs)[:6]]
    for bytes_ in (1 << 20, 400):
        got: dict[int, list] = {}
        for r in dense.exact_top_k(vectors, queries, 6, slice_bytes=bytes_).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
        assert got == want


def test_bm25_blocks_equal_the_joined_scores(spark, small_batches, monkeypatch):
    rng = np.random.default_rng(6)
    words = [f"w{i:02}" for i in range(40)]
    texts = spark.createDataFrame([(f"c{i:04}", " ".join(rng.choice(words, rng.integers(1, 6)))) for i in rng.permutation(1500)], "chunk_id string, contents string")
    queries = spark.createDataFrame([(i * 3, " ".join(rng.choice([*words, "zz"], rng.integers(1, 4)))) for i in range(30)], "query_id long, query string")
    index = lexical.build_index(texts)
    for k, held in ((1, blocks.HELD_BYTES), (7, 1000), (400, blocks.HELD_BYTES)):
        monkeypatch.setattr(blocks, "HELD_BYTES", held)  # 1000: several slices
        want = {tuple(r) for r in lexical.ranked(lexical.bm25(index, queries), k).collect()}
        assert {tuple(r) for r in lexical.bm25_top_k(index, queries, k).collect()} == want


def test_bar_is_reached_by_k():
    rng = np.random.default_rng(7)
    for shape, k in (((5, 1000), 3), ((4, 30), 20), ((3, 9), 20)):
        s = rng.normal(size=shape)
        bar = blocks.bar(s, k)
        assert ((s >= bar[:, None]).sum(axis=1) >= min(k, shape[1])).all()
