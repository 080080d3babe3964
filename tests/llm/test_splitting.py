from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.llm.p1_splitting import split_text, split_units


def check(text: str, limit: int, overlap: int):
    cuts = split_text(text, limit, overlap)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    for a, b, _ in cuts:
        assert len(text[a:b].encode()) <= limit
    for (a, b, _), (c, d, _) in zip(cuts, cuts[1:]):
        assert a < c <= b < d
    return cuts


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abc é😀.,\n", max_size=400), st.integers(8, 60), st.integers(0, 40))
def test_pieces_cover_and_fit(text, limit, overlap):
    check(text, limit, overlap)


def test_cuts_prefer_paragraphs_and_balance():
    text = "\n\n".join("Sentence one is here. Sentence two is there." for _ in range(8))
    cuts = check(text, 120, 10)
    assert {k for _, _, k in cuts[:-1]} <= {"paragraph", "sentence"}
    assert split_text("short", 100, 10) == [(0, 5, "end")]
    assert split_text("", 100, 10) == [(0, 0, "end")]


def test_long_words_and_marks():
    check("x" * 5000, 256, 32)
    for a, _, _ in check("é" * 900, 256, 0)[1:]:
        assert ("é" * 900)[a] == "e"


def test_units(spark):
    units = spark.createDataFrame(
        [("u1", "d1", "word " * 400, 1), ("u1", "d1", "word " * 400, 1), ("u2", "d1", None, 1), ("u3", "d1", "", 1), ("u4", "d9", "word " * 400, 1), ("u5", "d2", "word " * 400, 1), (None, "d1", "word " * 400, 1), ("u6", None, "word " * 400, 1)],
        "unit_id string, document_id string, contents string, limit_bytes int")
    docs = spark.createDataFrame([("d1", "m", 5), ("d1", "m", 5), ("d2", "big", 5), ("d3", None, 5)], "document_id string, embedding_model string, overlap_bytes int")
    models = spark.createDataFrame([("m", 256, 32), ("big", 4096, None), (None, 1, 1)], "model_name string, maximum_tokens int, overlap_tokens int")
    rows = split_units(units, docs, models).collect()
    assert {r.unit_id for r in rows} == {"u1"} and len(rows) == rows[0].pieces >= 2
    assert all(len(r.contents.encode()) <= 1024 for r in rows)
    assert split_units(units.limit(0), docs, models).count() == 0
