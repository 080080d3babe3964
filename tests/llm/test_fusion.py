from statistics import NormalDist

from quernstone.llm.p2_fusion import first_places, fuse_scores, fused_positions

SCHEMA = "search_id long, component string, chunk_id string, source_id string, score double, percentile double"


def brute(rows):
    seen = {}
    for s, c, k, _, v, _ in rows:
        if None not in (s, c, k, v) and v == v:
            seen[s, c, k] = max(v, seen.get((s, c, k), v))
    out = {}
    for s in {x[0] for x in seen}:
        parts = {x[1] for x in seen if x[0] == s}
        for p in parts:
            group = {x[2]: v for x, v in seen.items() if x[:2] == (s, p)}
            for k, v in group.items():
                below, same = sum(w < v for w in group.values()), sum(w == v for w in group.values())
                out[s, k] = out.get((s, k), 0) + NormalDist().inv_cdf((below + same / 2) / len(group)) / len(parts)
    return out


def test_against_brute_force(spark):
    import random

    r = random.Random(3)
    rows = [(s, c, f"k{i}", "x", r.choice([None, float("nan"), r.gauss(0, 10 ** len(c)), 5.0, -0.0, 0.0]), 1.0) for s in (1, 2) for c in ("a", "bb", "cccc") for i in range(12)]
    rows += rows[:5] + [(None, "a", "k", "x", 1.0, 1.0), (3, "a", "only", "x", 1.0, 1.0)]
    fused = fuse_scores(spark.createDataFrame(rows, SCHEMA))
    want = brute(rows)
    got = {(x.search_id, x.chunk_id): x.fused for x in fused.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    best = {x.search_id: x.chunk_id for x in first_places(fused).collect()}
    assert best == {s: min((-round(v, 9), k) for (t, k), v in got.items() if t == s)[1] for s in {k[0] for k in got}}
    places = fused_positions(fused).where("search_id = 1").orderBy("position").collect()
    assert [p.position for p in places] == list(range(1, len(places) + 1))
    assert [p.chunk_id for p in places] == [k for _, k in sorted((-v, k) for (s, k), v in got.items() if s == 1)]


def test_wide_scale_does_not_prevail_and_empty(spark):
    rows = [(1, "a", "x", "", 1e9, 0.0), (1, "a", "y", "", 1.0, 0.0), (1, "a", "z", "", 0.0, 0.0), (1, "b", "x", "", 0.1, 0.0), (1, "b", "y", "", 0.3, 0.0), (1, "b", "z", "", 0.2, 0.0), (1, "c", "y", "", 2.0, 0.0), (1, "c", "x", "", 1.0, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert first_places(fuse_scores(df)).collect()[0].chunk_id == "y"
    assert fuse_scores(df.limit(0)).count() == 0
