import json
import random

import pytest
from pyspark.sql import functions as F

from quernstone.functions import derivations, html, metadata, quality, reading
from quernstone.functions.mathx import inverse_normal
from quernstone.operators import catalogue, chunking, dense, evaluation, fusion, lexical, usage
from quernstone.operators.components import connected_components
from quernstone.operators.ranks import averaged_percentiles
from quernstone.plans.generations import Store, fingerprint, no_change, reuse_axes, run_stages
from quernstone.sources import files
from quernstone.streaming import search_log


def test_inverse_normal(spark):
    from statistics import NormalDist

    rows = spark.createDataFrame([(p,) for p in (0.001, 0.02, 0.3, 0.5, 0.9, 0.99, 0.0, 1.0)], "p double").select("p", inverse_normal("p").alias("z")).collect()
    assert all(abs(r.z - NormalDist().inv_cdf(r.p)) < 1e-7 for r in rows if 0 < r.p < 1) and all(r.z is None for r in rows if r.p in (0.0, 1.0))


def test_averaged_percentiles(spark):
    r = random.Random(1)
    data = [(r.choice(["a", "b", None]), r.choice([None, 0.0, -0.0, -3.5, 1e-300, 7.0, r.gauss(0, 5), float("nan")])) for _ in range(300)]
    got = averaged_percentiles(spark.createDataFrame(data, "g string, v double"), ["g"], "v", "p").collect()
    assert len(got) == len(data)
    for x in got:
        own = [v for g, v in data if g == x.g and v is not None and v == v]
        if x.v is None or x.v != x.v:
            assert x.p is None
        else:
            assert abs(x.p - (sum(v < x.v for v in own) + sum(v == x.v for v in own) / 2) / len(own)) < 1e-12


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200), (None, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "x long, y long"), "x", "y").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 200: 200}


def test_bm25_paths_agree(spark):
    texts = spark.createDataFrame([("a", "cobalt mine cobalt"), ("b", "cobalt river"), ("c", "the river of the town"), ("d", None), ("e", "")], "chunk_id string, contents string")
    queries = spark.createDataFrame([(1, "cobalt river"), (2, "nothing"), (3, None)], "query_id long, query string")
    index = lexical.build_index(texts)
    one = {(r.query_id, r.chunk_id): r.score for r in lexical.bm25(index, queries).collect()}
    two = {(r.query_id, r.chunk_id): r.score for r in lexical.bm25(index, queries, broadcast_rows=-1).collect()}
    assert one == two and set(one) == {(1, "a"), (1, "b"), (1, "c")}
    assert [r.chunk_id for r in lexical.ranked(lexical.bm25(index, queries)).orderBy("rank").collect()][0] == "b"
    for k in (1, 2, 9):
        want = [tuple(r) for r in lexical.ranked(lexical.bm25(index, queries), k).orderBy("rank").collect()]
        assert [tuple(r) for r in lexical.bm25_top_k(index, queries, k).orderBy("rank").collect()] == want
        assert [tuple(r) for r in lexical.bm25_top_k(index, queries, k, broadcast_rows=0).orderBy("rank").collect()] == want


def test_walk_stops_at_depth_and_filters_after_ranking(spark):
    ranking = spark.createDataFrame([(1, f"c{i:02}", float(100 - i), i) for i in range(1, 41)], "query_id long, chunk_id string, score double, rank int")
    chunks = spark.createDataFrame([(f"c{i:02}", "s", "target" if i > 30 else "other", 0 if i != 33 else 1, "cobalt words here") for i in range(1, 41)], "chunk_id string, source_id string, document_id string, health_flags int, contents string")
    queries = spark.createDataFrame([(1, "cobalt")], "query_id long, query string")
    plain = lexical.gated(ranking, chunks, queries, 5).collect()
    assert len(plain) == 5 and all(r.gate is None for r in plain)
    some = lexical.gated(ranking, chunks, queries, 5, F.col("document_id") == "target").where("gate IS NULL").orderBy("place").collect()
    assert [r.chunk_id for r in some] == ["c31", "c32", "c34", "c35", "c36"]
    none = lexical.gated(ranking, chunks, queries, 2, F.col("document_id") == "target", maximum_candidates=20).where("gate IS NULL").count()
    assert none == 0


def test_dense_gate_and_order(spark):
    v = spark.createDataFrame([("c0", "m", [1.0, 0.0]), ("c1", "m", [0.0, 1.0]), ("c2", "m", [1.0, 1.0]), ("c3", "m", [-1.0, 0.0]), ("c4", "n", [1.0, 0.0]), ("c5", "m", [2.0, 0.0])], "chunk_id string, kind string, vector array<float>")
    q = spark.createDataFrame([(1, "m", [1.0, 0.0])], "query_id long, kind string, vector array<float>")
    for bytes_ in (1 << 20, 8):
        got = [(r.chunk_id, r.score) for r in dense.exact_top_k(v, q, 10, slice_bytes=bytes_).orderBy("rank").collect()]
        assert [g[0] for g in got] == ["c0", "c5", "c2", "c1", "c3"] and abs(got[2][1] - 0.707106781) < 1e-9
    h = spark.createDataFrame([(1, "a", 0.80), (1, "b", 0.71), (1, "c", 0.69), (2, "a", 0.71), (2, "b", 0.70)], "query_id long, chunk_id string, score double")
    assert {(r.query_id, r.chunk_id) for r in dense.relative_gate(h, 0.72, 0.10).where("admitted").collect()} == {(1, "a"), (1, "b")}


def test_fusion_and_diversity_equal_greedy(spark):
    lex = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id long, chunk_id string, rank int")
    den = spark.createDataFrame([(1, "c", 1), (1, "d", 2)], "query_id long, chunk_id string, rank int")
    assert fusion.reciprocal_rank_fusion(lex, den).orderBy("position").first().chunk_id == "c"
    r = random.Random(5)
    rows = []
    for q in range(20):
        scores = sorted((r.random() for _ in range(15)), reverse=True)
        rows += [(q, f"k{i:02}", r.choice("xyz"), scores[i], i + 1) for i in range(15)]
    got = {}
    for x in fusion.source_diverse(spark.createDataFrame(rows, "query_id long, chunk_id string, source_id string, fusion_score double, position int"), 6).collect():
        got.setdefault(x.query_id, {})[x.selected_rank] = x.chunk_id
    for q in range(20):
        own = [x for x in rows if x[0] == q]
        low, high = min(x[3] for x in own), max(x[3] for x in own)
        taken, picked, left = {}, [], list(own)
        while len(picked) < 6:
            best = min(left, key=lambda x: (-round(round((x[3] - low) / (high - low), 9) - 0.25 * taken.get(x[2], 0), 9), x[4]))
            left.remove(best)
            picked.append(best[1])
            taken[best[2]] = taken.get(best[2], 0) + 1
        assert [got[q][i] for i in range(1, 7)] == picked


def test_collapse(spark):
    rows = [(1, "a", 1, "Same words."), (1, "b", 2, "same WORDS"), (1, "c", 3, "other"), (1, "d", 4, "Other!"), (1, "e", 5, "..."), (1, "f", 6, "!!!"), (1, "g", 7, "third")]
    ranked = spark.createDataFrame(rows, "query_id long, chunk_id string, position int, contents string")
    vectors = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "c", [1.0, 0.001]), (3, "g", None), (4, "e", [0.0, 0.0])], "vec_id long, chunk_id string, vector array<float>")
    got = {r.chunk_id: (r.kept_as, r.reason) for r in fusion.collapse_repetitions(ranked, vectors).collect()}
    # c goes by meaning, so its twin d has no kept copy of its words and stays
    assert got == {"a": (None, None), "b": ("a", "same_words"), "c": ("a", "same_meaning"), "d": (None, None), "e": (None, None), "f": (None, None), "g": (None, None)}


def test_windows_skip_unreadable(spark):
    chunks = spark.createDataFrame([(f"c{i}", "d", i, 1 if i == 3 else 0) for i in range(6)], "chunk_id string, document_id string, document_chunk_index int, health_flags int")
    got = [(r.chunk_id, r.offset) for r in catalogue.passage_window(chunks, spark.createDataFrame([("c2",)], "chunk_id string"), 1).orderBy("offset").collect()]
    assert got == [("c1", -1), ("c2", 0), ("c4", 1)]


def test_overlay_and_staleness(spark):
    docs = spark.createDataFrame([("d1", "Old", ["A"]), ("d2", "Two", ["B"])], "document_id string, title string, authors array<string>")
    over = spark.createDataFrame([("d1", "New", [], ["authors"])], "document_id string, title string, authors array<string>, present array<string>")
    got = {r.document_id: (r.title, r.authors, r.overridden) for r in catalogue.overlaid(docs, over, "document_id", ["title", "authors"]).collect()}
    assert got == {"d1": ("Old", [], ["authors"]), "d2": ("Two", ["B"], [])}
    scan = spark.createDataFrame([("a", 1, 9, "x"), ("b", 1, 8, "x"), ("c", 2, 7, "x"), ("e", 1, 1, "x")], "k string, size_bytes long, modified_at long, sha256 string")
    old = spark.createDataFrame([("a", 1, 7, "x"), ("b", 1, 7, "y"), ("c", 1, 7, "x"), ("d", 1, 7, "x")], "k string, size_bytes long, modified_at long, sha256 string")
    assert {(r.k, r.change) for r in catalogue.staleness(scan, old, "k").collect()} == {("b", "modified"), ("c", "modified"), ("d", "removed"), ("e", "added")}


def test_percentile_definitions(spark):
    log = spark.createDataFrame([(i, float(i), i) for i in range(1, 32)], "search_id long, elapsed_ms double, s long").withColumn("searched_at", F.timestamp_seconds("s"))
    r = usage.recent_latency(log).first()
    assert (r.n, r.median_ms, r.p95_ms) == (31, 16.0, 29.0)  # index round(28.5), half to even
    n = usage.nearest_rank(log.withColumn("g", F.lit(1)), ["g"], "elapsed_ms", {"p95": 0.95}).first()
    assert n.p95 == 30.0
    assert usage.recent_latency(log.limit(0)).first().median_ms is None


def test_usage_grain(spark):
    for days, grain, buckets in ((60, "day", 61), (61, "week", None), (420, "week", None), (421, "month", None)):
        log = spark.createDataFrame([(0,), (days * 86400,)], "s long").select(F.timestamp_seconds("s").alias("searched_at"))
        rows = usage.usage_series(log).collect()
        assert {r.grain for r in rows} == {grain} and sum(r.searches for r in rows) == 2 and (buckets is None or len(rows) == buckets)


def test_chunk_windows(spark):
    u = spark.createDataFrame([("u", "AaBbCcDd"), ("v", None), ("w", "  ")], "unit_id string, contents string")
    for overlap in (1, 4):
        rows = [r.contents for r in chunking.windows(u, 4, overlap, token=r"\S").orderBy("window").collect()]
        assert rows == ["AaBb", "bCcD", "Dd"]


def test_quality(spark):
    t = spark.createDataFrame([("bad � and Ã© here",), ("one � only",), ("clean text",), (None,), ("a �� b",)], "t string").select("t", quality.corruption_reasons(F.col("t")).alias("r")).collect()
    assert [x.r for x in t] == [["replacement_characters", "known_mojibake"], [], [], None, ["replacement_characters"]]
    lines = ["Prose.", "References", "Smith, J. (1999). A book.", "Jones, A. (2001). Another.", "Prose again.", "References", "Ordinary prose follows.", "Notes", "1 A note.", "* Another."]
    rows = spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "document_id string, position int, paragraph string")
    got = [r.removed for r in quality.removed_sections(rows, "document_id", ["position"]).orderBy("position").collect()]
    assert got == [None, "bibliography", "bibliography", "bibliography", None, None, None, "footnotes", "footnotes", "footnotes"]


def test_reading(spark):
    assert reading.reading_text("A bro-\nken ﬁne line\nflows.\n\nNew one\n- item") == "A broken fine line flows.\n\nNew one\n\n- item"
    assert reading.unmangled("FÃ¼r â€” cafÃ©") == "Für — café" and reading.unmangled("SÃO £40 ÃƒÂ©") == "SÃO £40 é"
    assert reading.without_damaged_words("a b�d c� e") == ("a [...] e", 5, 2)
    assert reading.author_names("Smith, J.; Oxford University Press and Jane Doe2") == ["Smith, J", "Jane Doe"]
    rows = spark.createDataFrame([("x\ny",), (None,)], "t string").select(reading.normalize_inline_text("t").alias("t")).collect()
    assert [r.t for r in rows] == ["x y", None]


def test_metadata(spark):
    r = spark.createDataFrame([("see 10.1234/ab.c). ok", "en-XX", "report.pdf")], "t string, l string, n string").select(metadata.doi(F.col("t")).alias("d"), metadata.language_code(F.col("l")).alias("l"), metadata.valid_title(F.col("n")).alias("v")).first()
    assert (r.d, r.l, r.v) == ("10.1234/ab.c", "en", False)


def test_html():
    page = "<nav>menu</nav><h1>Title</h1><p>One<a href='#n1'>1</a> two</p><div>bare <b>text</b><p>Three</p></div><table><tr><th>a</th><td>b</td></tr><tr><td>c</td></tr></table><div class='sidebar'>x</div><h2>End</h2>"
    assert [(u[0], u[1]) for u in html.html_units(page)] == [("Title\n\nOne two", "prose"), ("bare text", "prose"), ("Three", "prose"), ("a | b\nc", "table"), ("End", "prose")]


def test_evaluation(spark):
    rankings = spark.createDataFrame([("m", 1, c, i) for i, c in enumerate("abc", 1)], "condition string, query_id long, chunk_id string, rank int")
    r = evaluation.known_item(rankings, spark.createDataFrame([(1, "b"), (1, "z")], "query_id long, chunk_id string")).first()
    assert r.reciprocal_rank == 0.5 and r.success_at_1 == 0 and r.success_at_k == 1 and abs(r.ndcg - 0.63093 / 1.63093) < 1e-4
    g = evaluation.graded(rankings, spark.createDataFrame([(1, "b", 0)], "query_id long, chunk_id string, grade int")).first()
    assert g.graded_ndcg is None and g.direct_at_k == 0
    one = evaluation.cluster_bootstrap(spark.createDataFrame([("x", "f", 0.5)], "comparison string, family string, difference double")).first()
    assert one.low is None and one["mean"] == 0.5
    two = evaluation.cluster_bootstrap(spark.createDataFrame([("x", "f", 0.5), ("x", "g", 0.7)], "comparison string, family string, difference double")).first()
    assert (two.low, two.high) == (0.5, 0.7)


BELLS = "Both bells of Orrin are cast in bronze; they ring at noon. Because the tower leans, its stair is closed. Nobody climbs it [GAP 3] today."


def derivation(**changes):
    d = {
        "sources": {"S1": {"author": "Vane", "title": "Bells", "locator": "p. 4", "text": BELLS}}, "conclusion": "The stair is closed.", "checks": [{"source": "S1", "result": "holds"}],
        "steps": [
            {"id": "A", "claim": "bronze", "supports": "Z", "status": "part", "why": "it says what they are"},
            {"id": "B", "claim": "because", "supports": "A", "status": "stated", "why": "it joins them", "licence": {"source": "S1", "text": "Because the tower leans"}},
            {"id": "C", "claim": "access", "supports": "A", "status": "gap", "why": "nobody says so", "missing": "A → C"},
        ],
        "sentences": [
            {"step": "A", "pieces": [{"source": "S1", "text": "Both bells of Orrin are cast in bronze", "ops": [{"op": "INFLECT", "kind": "agreement", "from": "bells", "to": "bell"}, {"op": "INFLECT", "kind": "agreement", "from": "are", "to": "is"}, {"op": "DELETE", "text": "of Orrin"}, {"op": "NORMALISE", "rule": "end-stop"}]}]},
            {"step": ["B", "C"], "pieces": [{"source": "S1", "text": "its stair is closed", "ops": [{"op": "INFLECT", "kind": "antecedent", "from": "its", "to": "tower’s"}, {"op": "NORMALISE", "rule": "case", "to": "upper"}]}, {"source": "S1", "link": "B", "text": "Because", "ops": [{"op": "NORMALISE", "rule": "case", "to": "lower"}]}, {"source": "S1", "text": "the tower leans", "ops": [{"op": "NORMALISE", "rule": "end-stop"}]}]},
        ],
    }
    return d | changes


def test_derivations(spark):
    out = derivations.render(derivation())
    assert out["synthesis"] == "Both bell is cast in bronze [S1]. Tower’s stair is closed because the tower leans [S1]. ⟦GAP: A → C⟧"
    assert out["references"] == "[S1] Vane, Bells, p. 4" and out["used_sentences"] == 2 and out["deviations"] == []
    assert "S1 0-38 (agreement “bells” to “bell”; agreement “are” to “is”; without “of Orrin”; full stop)" in out["provenance"] and "S1: 2 of 3 sentences; holds" in out["reasoning"]
    piece = lambda *p, **k: derivation(sentences=[{"step": ["A", "B", "C"], "pieces": list(p), **k}])
    part = {"source": "S1", "text": "they ring at noon."}
    fragment = derivations.render(piece(part, deviation="a fragment"))
    assert fragment["synthesis"].startswith("they ring at noon [S1].") and fragment["deviations"] == ["1: a fragment (Sentence 1: begins with a small letter)"]
    refused = {
        "no check": derivation(checks=[]), "not there": piece({"source": "S1", "text": "Both bells fell."}), "half a word": piece({"source": "S1", "text": "oth bells"}), "a marker": piece({"source": "S1", "text": "Nobody climbs it [GAP 3] today."}),
        "a small letter": piece(part), "two contents": piece(part, part), "unknown source": piece({"source": "S9", "text": "x"}), "other verb": piece(part | {"ops": [{"op": "INFLECT", "kind": "agreement", "from": "ring", "to": "toll"}]}, deviation="x"),
        "a loop": derivation(steps=[{"id": "A", "supports": "B", "status": "part", "why": "x"}, {"id": "B", "supports": "A", "status": "part", "why": "x"}]), "a step unsaid": derivation(sentences=derivation()["sentences"][:1]),
        "a figure by model": derivation(ai_allowed="all", steps=[derivation()["steps"][0], derivation()["steps"][1], {"id": "C", "supports": "A", "status": "ai", "why": "x", "missing": "A → C", "text": "It has 9 bells."}]),
    }
    for name, d in refused.items():
        with pytest.raises(derivations.Unlicensed):
            derivations.render(d)
            pytest.fail(name)
    rows = spark.createDataFrame([(json.dumps(derivation()),), ("{}",), (None,), ("no json",)], "j string").select(derivations.render_derivation("j").alias("r")).select("r.*").collect()
    assert rows[0].refused is None and "Every source has a check" not in rows[1].refused and "There are sources" in rows[1].refused and rows[2].synthesis is None and rows[2].refused is None and rows[3].refused


def test_generations(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = spark.range(5)
    assert store.current() is None and store.names() == []
    first = store.build({"chunks": rows}, {"size": 384})
    part = store.build({"chunks": rows.limit(2)}, {"size": 384}, partial=True)
    assert store.current() == first and store.table("chunks").count() == 5 and set(store.names()) == {first, part}
    assert store.use(part) and not store.use(part) and store.table("chunks").count() == 2
    with pytest.raises(ValueError):
        store.remove(part, part)
    store.remove(first, first)
    assert store.names() == [part] and store.manifest(part)["fingerprint"] == fingerprint({"size": 384})
    assert reuse_axes({"chunking": 1}, {"chunking": 2}) == {"units": True, "chunks": False, "vectors": True}
    assert no_change(rows.withColumn("d", F.lit(1)), rows.withColumn("d", F.lit(1)), "id", "d")
    stages = [("a", lambda: rows), ("b", lambda: rows)]
    assert run_stages(str(tmp_path / "w"), spark, "x", stages) == ["a", "b"] and run_stages(str(tmp_path / "w"), spark, "x", stages) == []


def test_files(spark, tmp_path):
    import numpy as np

    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.pdf").write_bytes(b"x")
    (tmp_path / "in/sub/b.EPUB").write_bytes(b"yy")
    (tmp_path / "in/c.txt").write_bytes(b"z")
    got = {r.source_relative_path: r.size_bytes for r in files.scan_sources(spark, str(tmp_path / "in"), "p").collect()}
    assert got == {"a.pdf": 1, "sub/b.EPUB": 2}
    assert [tuple(r) for r in files.ignored_extensions(spark, str(tmp_path / "in")).collect()] == [("txt", 1)]
    np.save(tmp_path / "v.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    assert [r.vector for r in files.read_vector_matrices(spark, str(tmp_path / "v.npy"), 2).orderBy("ordinal").collect()] == [[0, 1], [2, 3], [4, 5]]
    files.write_json_lines(spark.range(3), str(tmp_path / "j"))
    assert files.read_json_lines(spark, str(tmp_path / "j"), "id long").count() == 3


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "agent"), (1, "agent"), (2, None)], "search_id long, caller string")
    full = rows.select("search_id", F.timestamp_seconds(F.lit(1_700_000_000)).alias("searched_at"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("recorded_at"), F.lit("g").alias("generation_id"), F.lit(5).alias("requested_top_k"), F.lit(1).alias("result_count"), F.lit(2.0).alias("elapsed_ms"), F.lit("q").alias("query_text"), F.lit(None).cast("string").alias("filters"), "caller")
    full.write.parquet(str(tmp_path / "in"))
    search_log.append_searches(search_log.read_searches(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_registry_names_are_core_or_training():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_target_resolution_of_whole_texts(spark):
    from quernstone.queries.evaluation import resolved

    opening = "one two three four five six seven eight"
    items = [(1, f"{opening} nine TEN"), (2, f"{opening} eleven"), (3, opening), (4, f"{opening} twelve"), (5, "Two, three"), (6, "zero"), (7, ""), (8, None), (9, f"{opening} nine t"), (1, f"{opening} nine TEN")]
    docs = [(1, f"So: {opening} nine ten."), (2, f"{opening}, eleven; {opening} nine"), (3, f"{opening} eleven more"), (4, "two and three"), (5, None), (6, "")]
    got = {r.item_id: (r.resolution, r.documents) for r in resolved(spark.createDataFrame(items, "item_id long, item_text string"), spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: ("unique", 1), 2: ("several", 2), 3: ("several", 3), 4: ("none", 0), 5: ("several", 3), 6: ("none", 0), 7: ("none", 0), 8: ("none", 0), 9: ("none", 0)}


def test_staleness_diff_takes_every_source(spark, tmp_path):
    from datetime import datetime

    from quernstone.queries.catalogue import q_staleness_diff

    rows = []
    for s in ("aaa", "src_0a", "src_5", "src_e9", "zzz", None):
        rows += [(s, f"{s}_d1", 1, datetime(2020, 1, 1), "x"), (s, f"{s}_d2", 2, datetime(2021, 1, 1), "y"), (s, f"{s}_d2", 2, datetime(2021, 1, 1), "y")]
    rows += [("src_f", "f_d1", 1, datetime(2020, 1, 1), "x"), ("src_0b", "b_d1", 1, datetime(2020, 1, 1), "x")]
    spark.createDataFrame(rows, "source_id string, document_id string, size_bytes long, modified_at timestamp, sha256 string").write.parquet(str(tmp_path / "source_documents.parquet"))
    got = {(r.source_id, r.change) for r in q_staleness_diff(spark, str(tmp_path)).collect()}
    assert got == {(s, "modified") for s in ("aaa", "src_0a", "src_5", "src_e9", "zzz")}
