import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.functions import hooks, metadata, quality
from quernstone.operators import evaluation, fusion, policies, screening
from quernstone.plans import builds
from quernstone.sources import files


def rows(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


def test_served_method(spark):
    cases = [(None, ["bm25", "dense", "hybrid"], False), (None, ["bm25", "hybrid"], True), ("dense", ["bm25", "dense"], True), ("dense", ["bm25", "dense"], False), (None, ["bm25"], False), (None, None, False), ("hybrid", [], False)]
    got = [r.s for r in rows(spark, "i int, r string, a array<string>, m boolean", *[(i, *x) for i, x in enumerate(cases)]).select("i", policies.served_method(F.col("r"), F.col("a"), F.col("m")).alias("s")).orderBy("i").collect()]
    assert [s.method for s in got] == ["hybrid", "bm25", None, "dense", "bm25", "bm25", None]
    assert got[1].reason == "embedding_model_mismatch" and [bool(s.refused) for s in got] == [False, False, True, False, False, False, True] and got[2].refused == "available: bm25"
    depth = spark.range(1).select(policies.candidate_depth(F.lit(1000), F.lit(10)).alias("a"), policies.candidate_depth(F.lit(7), F.lit(10)).alias("b"), policies.candidate_depth(F.lit(1000), F.lit(99)).alias("c"), policies.candidate_depth(F.lit(1000), F.lit(1)).alias("d")).first()
    assert tuple(depth) == (40, 7, 200, 20)


def passages(spark):
    return rows(spark, "chunk_id string, source_id string, document_id string, document_chunk_index int, health_flags int, extra int", ("a", "s1", "d", 0, None, 1), ("b", "s1", "d", 1, 1, 1), ("c", "s1", "d", 2, 4, 1), ("e", "s1", "d", 3, 0, 1), ("f", "s2", "d2", 0, 0, 1))


def test_passages_and_exclusions(spark):
    decided = policies.Decisions(rows(spark, "source_id string, reason string", ("s2", "x"), ("s9", "gone")), rows(spark, "chunk_id string, reason string", ("e", "y")))
    asked = rows(spark, "chunk_id string", ("a",), ("a",), ("b",), ("e",), ("f",), ("zzz",), (None,))
    got = {(r.target_id, r.refusal, r.chunk_id, r.offset, r.excluded) for r in policies.get_passage(passages(spark), asked, 2, decided).collect()}
    assert got == {("a", None, "a", 0, False), ("a", None, "c", 1, False), ("a", None, "e", 2, True), ("b", "unreadable", None, None, False), ("e", "excluded", None, None, True), ("f", "excluded", None, None, True), ("zzz", "unknown", None, None, False)}
    assert policies.get_passage(passages(spark).limit(0), asked.limit(0), 2, decided).count() == 0
    with pytest.raises(ValueError):
        policies.get_passage(passages(spark), asked, 6, decided)
    assert {r.chunk_id for r in policies.without_excluded(passages(spark), decided).collect()} == {"a", "b", "c"}
    listed = {(r.kind, r.id, r.documents, r.chunks) for r in policies.exclusion_listing(decided, passages(spark)).collect()}
    assert listed == {("source", "s2", 1, 1), ("source", "s9", 0, 0), ("chunk", "e", 1, 1)}
    listing = policies.list_sources(*(rows(spark, "source_id string, x int", *[(i, 1) for i in ids]) for ids in (["s1", "s1", None], ["s1", "s2"], ["s3"], ["s2"]))).orderBy("source_id").collect()
    assert [tuple(r) for r in listing] == [("s1", True, True, False, False), ("s2", False, True, False, True), ("s3", False, False, True, False)]


def test_disclosures_conserve_counts(spark):
    judged = rows(spark, "query_id long, chunk_id string, rank int, gate string", (1, "a", 1, None), (1, "b", 2, "corrupt"), (1, "c", 3, "no_query_token_overlap"))
    dense = rows(spark, "query_id long, chunk_id string, score double, admitted boolean", (1, "a", 0.8, True), (1, "d", 0.71, True), (1, "e", 0.5, False), (2, "a", 0.3, False))
    fused = rows(spark, "query_id long, chunk_id string, source_id string", (1, "a", "s"), (1, "d", "s"))
    answer = rows(spark, "query_id long, source_id string, embedding_token_count int, dense_truncated boolean", (1, "s", 5, True), (1, "s", None, None))
    wanted = rows(spark, "query_id long, requested_top_k int", (1, 5), (2, 5), (3, 5))
    got = {r.query_id: r for r in policies.disclosures(judged, dense, fused, answer, wanted, 0.72).collect()}
    one = got[1]
    assert one.bm25_looked_at == one.bm25_accepted + one.bm25_corrupt + one.bm25_no_query_token_overlap and one.dense_eligible == one.dense_above_floor + one.dense_rescued + one.dense_below_threshold
    assert (one.results, one.result_sources, one.audited_results, one.truncated_results, one.relevance_limited) == (2, 1, 1, 1, True)
    assert got[2].bm25_looked_at is None and got[2].candidates == 0 and 3 not in got
    examples = policies.bounded_examples(rows(spark, "query_id long, reason string, chunk_id string, rank int", *[(1, "x", f"c{i}", i) for i in range(9)]), 5).collect()
    assert sorted(r.chunk_id for r in examples) == [f"c{i}" for i in range(5)]
    d = spark.range(1).select(policies.policy_differences({"a": F.lit(1), "b": F.lit(None), "c": F.lit("x")}, {"a": F.lit(1), "b": F.lit(2), "c": F.lit("y")}).alias("d")).first().d
    assert d == ["b", "c"]


def test_screening(spark):
    units = [("s", "Sound words here."), ("s", "Sound words here.\n\nlost �� words"), ("s", "x\n\n" + "�" * 40), ("s", "***"), ("s", None), ("t", "��"), ("u", "12 34"), (None, "Sound.")]
    got = {r.source: r for r in screening.screened(rows(spark, "source string, contents string, units int", *[(*u, 1) for u in units]), "source").collect()}
    s = got["s"]
    assert (s.units, s.retained, s.symbol_only, s.replacement_characters) == (5, 2, 2, 1) and s.removed_characters == len("\n\nlost �� words") and s.verdict == ["unclean_text"]
    assert got["t"].verdict == ["no_readable_text"] and got["u"].verdict == ["no_letter_text"] and got[None].retained == 1
    assert screening.screened(rows(spark, "source string, contents string", *units).limit(0), "source").count() == 0
    why = {r.t: r.w for r in rows(spark, "t string", ("",), ("a" * 9 + "\x01",), (None,)).select("t", screening.passage_health_reasons(F.col("t")).alias("w")).collect()}
    assert why[""] == ["symbol_only"] and why["a" * 9 + "\x01"] == ["unclean_text"] and why[None] is None


def test_metadata_identity(spark):
    r = rows(spark, "a string, b string, p string", ("A Book", "a book", "x/y.pdf"), ("A Book", "Other Book", "x/y.pdf"), ("untitled", "Seen Title", "x/y.pdf"), (None, None, "x/the-name.epub"), ("doi:1", "", "plain")).select(metadata.identity(F.col("a"), F.col("b"), F.col("p")).alias("i")).collect()
    assert [tuple(x.i) for x in r] == [("A Book", "embedded", False), ("A Book", "embedded", True), ("Seen Title", "visible", False), ("the-name", "filename", False), ("plain", "filename", False)]
    names = rows(spark, "a array<string>", ([" Lee,  A. ", "lee, a.", "7", "x@y.de", "Ã©x", "Ng"],), (None,), ([],)).select(metadata.valid_authors(F.col("a")).alias("n"), metadata.identifiers(F.col("a")).alias("i")).collect()
    assert names[0].n == ["Lee, A.", "Ng"] and names[1].n == [] and names[1].i == [] and names[2].n == [] and names[0].i[0] == "Lee,  A."


def test_hooks(spark):
    texts = rows(spark, "k string, t string, vector int", ("a", "the red map", 1), ("b", "the red map", 1), ("c", "", 1), ("d", None, 1))
    v = {r.k: r.vector for r in hooks.embedded(texts, hooks.HashingEmbedder(), "k", "t").collect()}
    assert v["a"] == v["b"] and abs(np.linalg.norm(v["a"]) - 1) < 1e-6 and not any(v["c"]) and "d" not in v

    class Wrong(hooks.HashingEmbedder):
        def embed(self, texts):
            return super().embed(texts) * np.float32("nan")

    with pytest.raises(Exception, match="finite"):
        hooks.embedded(texts, Wrong(), "k", "t").collect()

    class Broken:
        def score(self, queries, texts):
            raise RuntimeError("no model")

    pairs = rows(spark, "query_id long, chunk_id string, query string, text string", (1, "a", "red map", "the red map"), (1, "b", None, None))
    assert [(r.rerank_score, r.rerank_fallback) for r in hooks.reranked(pairs, hooks.OverlapReranker()).orderBy("chunk_id").collect()] == [(1.0, False), (0.0, False)]
    assert all(r.rerank_score is None and r.rerank_fallback for r in hooks.reranked(pairs, Broken()).collect())
    e = spark.range(1).select(hooks.embedding_text(F.lit("T"), F.lit("S"), F.lit("x")).alias("a"), hooks.embedding_text(F.lit(None), F.lit(" "), F.lit("x")).alias("b")).first()
    assert (e.a, e.b) == ("T — S\n\nx", "x") and hooks.minimum_tokens(0.125, 384) == 48 and hooks.minimum_tokens(0, 0) == 0
    with pytest.raises(ValueError):
        hooks.minimum_tokens(0.1, 0)


def test_builds(spark, tmp_path):
    ids = lambda *x: rows(spark, "source_id string", *[(i,) for i in x])
    pick = lambda **k: {(r.source_id, r.carried) for r in builds.selected_sources(ids("a", "b", "c", None), ids("b", "c", "gone"), ids("a", "b"), **k).collect()}
    assert pick() == {("b", True), ("c", False)} and pick(named=ids("a"), mode="ingest") == {("a", False), ("b", True), ("c", True)} and pick(named=ids("b"), mode="remove") == {("c", True)}
    with pytest.raises(ValueError):
        pick(mode="other")
    files = "source_id string, size_bytes long, modified_at timestamp, sha256 string"
    same = rows(spark, files, ("a", 1, None, "x"))
    assert builds.revalidated(same, same, ids("q"), ids("q")).first().publishable and not builds.revalidated(same, same, ids("q"), ids()).first().publishable and builds.revalidated(rows(spark, files, ("a", 2, None, "x")), same, ids(), ids()).first().modified == 1
    a, b = builds.policy_identity({"size": 1, "rrf_k": 60}), builds.policy_identity({"size": 1, "rrf_k": 50})
    assert a["artifacts"] == b["artifacts"] and a["ranking"] != b["ranking"]


def test_two_level_means_and_handoff(spark):
    m = rows(spark, "condition string, family string, v double", ("x", "f", 1.0), ("x", "f", 0.0), ("x", "g", 1.0), ("x", "h", None), ("y", "f", None))
    got = {r.condition: r for r in evaluation.two_level_means(m, "v").collect()}
    assert got["x"].query_mean == round(2 / 3, 6) and got["x"].family_mean == 0.75 and (got["x"].families_evaluated, got["x"].families) == (2, 3) and got["y"].query_mean is None and got["y"].families_evaluated == 0
    q, j = rows(spark, "query_id long", (1,), (2,), (None,)), rows(spark, "query_id long, chunk_id string, grade int", (1, "a", 9), (1, "a", 1), (5, "a", 1))
    r = rows(spark, "condition string, query_id long, chunk_id string, score double", ("x", 1, "a", float("nan")), ("x", 1, "a", 1.0), ("x", 7, "a", None))
    assert {x.rule: x.n for x in evaluation.handoff_violations(q, j, r).collect()} == {"questions without an id": 1, "judgments of no question": 1, "judgments given twice": 1, "grades out of range": 1, "rankings of no question": 1, "passages ranked twice": 1, "scores missing or not finite": 2, "questions without a judgment": 1}


def test_collapse_contract(spark):
    """Copies collapse by words, near ones by meaning, each into the kept passage; empty words and missing vectors match nothing."""
    ranked = rows(spark, "query_id long, chunk_id string, position int, contents string", (1, "a", 1, "The red map."), (1, "b", 2, "the RED map"), (1, "c", 3, "Another text"), (1, "d", 4, "***"), (1, "e", 5, "!!!"), (1, "f", 6, "another TEXT"), (1, "g", 7, "No vector"), (2, "b", 1, "the RED map"))
    vectors = rows(spark, "vec_id long, chunk_id string, vector array<float>", (1, "a", [1.0, 0.0]), (2, "c", [0.999, 0.01]), (3, "d", [0.0, 1.0]), (4, "e", [float("nan"), 1.0]), (5, "f", [0.0, 1.0]))
    got = {(r.query_id, r.chunk_id): (r.kept_as, r.reason) for r in fusion.collapse_repetitions(ranked, vectors).collect()}
    assert got == {(1, "a"): (None, None), (1, "b"): ("a", "same_words"), (1, "c"): ("a", "same_meaning"), (1, "d"): (None, None), (1, "e"): (None, None), (1, "f"): ("d", "same_meaning"), (1, "g"): (None, None), (2, "b"): (None, None)}


def test_page_units_of_payloads(spark):
    payload = '{"pages": {"3": [{"contents": " a  b ", "content_kind": "prose"}, {"contents": " "}, {"contents": "c"}], "5": [{"contents": null}], "7": [{"contents": "d", "content_kind": "table"}], "x": [{"contents": "no page"}]}, "page_labels": {"3": "iii"}, "other": 1}'
    units = screening.page_units(rows(spark, "document_id string, payload string, page int", ("d", payload, 1), ("e", "no json", 1), ("f", None, 1), ("g", "{}", 1)))
    assert {tuple(r) for r in units.collect()} == {("d", 3, "iii", 0, "a b", "prose"), ("d", 3, "iii", 1, "c", "prose"), ("d", 7, None, 0, "d", "table")}
    assert [tuple(r) for r in screening.blank_pages(units).collect()] == [("d", 3, 7, 2, 3)]


def test_mixed_scripts(spark):
    cases = {"aб": False, "aбγא": True, "aaaaaaaaaaaaaaaaaaaaaбγא": False, "": False, None: False}
    got = {r.t: r.m for r in rows(spark, "t string", *[(t,) for t in cases]).select("t", quality.mixed_scripts(F.col("t")).alias("m")).collect()}
    assert got == cases


def test_token_windows(spark, tmp_path):
    """A vocabulary of single bytes: a sign is a token."""
    vocabulary = tmp_path / "bytes.tiktoken"
    vocabulary.write_text("".join(f"{base64.b64encode(bytes([b])).decode()} {b}\n" for b in range(256)))
    units = rows(spark, "unit_id string, contents string, window int", ("u", "AaBbCcDd", 1), ("blank", "  ", 1), ("null", None, 1), ("one", "x", 1))
    for overlap in (1, 4):
        got = {(r.unit_id, r.window): r.contents for r in hooks.token_windows(units, str(vocabulary), 4, overlap).collect()}
        assert got == {("u", 0): "AaBb", ("u", 1): "bCcD", ("u", 2): "Dd", ("one", 0): "x"}
    counted = {r.unit_id: r.n for r in units.select("unit_id", hooks.BytePairTokenizer(str(vocabulary)).count(F.col("contents")).alias("n")).collect()}
    assert counted == {"u": 8, "blank": 2, "null": None, "one": 1}
    assert units.select(hooks.BytePairTokenizer(None).count(F.col("contents")).alias("n")).first().n is None


def test_durable_files(spark, tmp_path):
    out = str(tmp_path / "out")
    files.write_json_lines(spark.range(5), out)
    with pytest.raises(FileExistsError):
        files.write_json_lines(spark.range(1), out)
    assert files.read_json_lines(spark, out, "id long").count() == 5 and [p.name for p in tmp_path.iterdir()] == ["out"]
    n, size = files.directory_statistics(spark, out)
    assert n >= 2 and size > 0 and files.directory_statistics(spark, str(tmp_path / "none")) == (0, 0) and files.scan_sources(spark, str(tmp_path / "none"), "p").count() == 0
