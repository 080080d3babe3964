"""Lexical, dense and hybrid search over all recorded queries in one job."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import hooks
from quernstone.functions.tokens import equality_key, gate_tokens, gate_tokens_sql, index_tokens_sql
from quernstone.operators import dense, fusion, lexical
from quernstone.plans.stages import cut
from quernstone.queries import common as c
from quernstone.sources import read_table

TOP_K = 10
DEPTH = 20
FLOOR, MARGIN = 0.72, 0.10
#: The floor for vectors of the stand-in embedder, whose cosines lie lower.
EMBEDDED_FLOOR = 0.35


def q_gate_tokens(spark: SparkSession, d: str) -> DataFrame:
    return c.text_queries(spark, d).select("query_id", F.explode(gate_tokens(F.col("query"))).alias("term"))


def _index(spark: SparkSession, d: str) -> lexical.Index:
    return lexical.build_index(c.chunks(spark, d, "contents"))


def q_document_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def _ranking(spark: SparkSession, d: str, k: int, queries: DataFrame | None = None) -> DataFrame:
    return lexical.bm25_top_k(_index(spark, d), c.text_queries(spark, d) if queries is None else queries, k)


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return c.chunks(spark, d, "source_id", "document_id", "contents", "health_flags")


def q_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _ranking(spark, d, TOP_K).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def _gated(spark: SparkSession, d: str, passes: Column | None = None, queries: DataFrame | None = None) -> DataFrame:
    facts, queries = _facts(spark, d), c.text_queries(spark, d) if queries is None else queries
    if passes is not None:
        facts = facts.join(c.documents(spark, d, "languages"), "document_id", "left")
    return lexical.gated(_ranking(spark, d, lexical.window(DEPTH, passes is not None), queries), facts, queries, DEPTH, passes)


def q_bm25_gated(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, d).groupBy("query_id", F.coalesce("gate", F.lit("accepted")).alias("gate")).agg(F.count(F.lit(1)).alias("n"))


def q_bm25_window_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Accepted chunks of documents in French or German, found after ranking within the bounded window."""
    passes = F.arrays_overlap("languages", F.array(F.lit("fr"), F.lit("de")))
    return _gated(spark, d, passes).where("gate IS NULL").select("query_id", "chunk_id", "rank", F.col("place").cast("int").alias("place"))


def q_prf_terms(spark: SparkSession, d: str) -> DataFrame:
    return _mined(spark, d, _index(spark, d))


def _mined(spark: SparkSession, d: str, index: lexical.Index) -> DataFrame:
    queries, texts = c.text_queries(spark, d), c.chunks(spark, d, "contents")
    first = lexical.gated(lexical.bm25_top_k(index, queries, 200), _facts(spark, d), queries, DEPTH)
    leaders = first.where("gate IS NULL AND place <= 5").select("query_id", "chunk_id", "place").join(texts, "chunk_id")
    return lexical.feedback_terms(leaders, texts, queries)


def q_bm25_with_feedback(spark: SparkSession, d: str) -> DataFrame:
    """The second pass: each query with its mined terms, ranked and gated again; one index serves both passes."""
    index = _index(spark, d)
    terms = _mined(spark, d, index).groupBy("query_id").agg(F.array_sort(F.collect_list("term")).alias("more"))  # at most eight
    queries = c.text_queries(spark, d).join(terms, "query_id", "left").select("query_id", F.concat_ws(" ", "query", F.array_join(F.coalesce("more", F.array().cast("array<string>")), " ")).alias("query"))
    second = lexical.gated(lexical.bm25_top_k(index, queries, 200), _facts(spark, d), queries, DEPTH)
    return second.where(F.col("place") <= TOP_K).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank", F.col("place").cast("int").alias("place"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return dense.clean_vectors(read_table(spark, d, "reuse_vectors").dropDuplicates(["vec_id"])).select("vec_id", "chunk_id", F.col("embedding_model").alias("kind"), "vector").where("kind IS NOT NULL")


def _query_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "kind", "vector")


def q_dense_exact_topk(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return dense.exact_top_k(v, _query_vectors(v), TOP_K, "vec_id").select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def q_dense_filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    """Filters on documents apply before scoring: only chunks of documents in French are scanned."""
    v = _vectors(spark, d)
    allowed = c.chunks(spark, d, "document_id").join(c.documents(spark, d, "languages").where(F.array_contains("languages", "fr")), "document_id", "left_semi").select("chunk_id")
    return dense.exact_top_k(v.join(allowed, "chunk_id", "left_semi"), _query_vectors(v), TOP_K, "vec_id").select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def _component(spark: SparkSession, d: str, name: str) -> DataFrame:
    h = c.hits(spark, d, name).select(F.col("search_id").alias("query_id"), "chunk_id", "source_id", "score")
    return lexical.ranked(h)


def _admitted(spark: SparkSession, d: str) -> DataFrame:
    return dense.relative_gate(_component(spark, d, "dense"), FLOOR, MARGIN)


def q_dense_gate(spark: SparkSession, d: str) -> DataFrame:
    return _admitted(spark, d).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.round("effective_floor", 6).alias("effective_floor"), "admitted")


def q_dense_gate_counts(spark: SparkSession, d: str) -> DataFrame:
    above = F.col("score") >= FLOOR
    return _admitted(spark, d).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("eligible"), F.count_if(above).alias("above_floor"), F.count_if(F.col("admitted") & ~above).alias("rescued"), F.count_if(~F.col("admitted")).alias("rejected"))


def _fused(spark: SparkSession, d: str) -> DataFrame:
    admitted = lexical.ranked(_admitted(spark, d).where("admitted").drop("rank"))
    return fusion.reciprocal_rank_fusion(_component(spark, d, "bm25"), admitted)


def q_rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).select("query_id", "chunk_id", "bm25_rank", "dense_rank", F.round("fusion_score", 6).alias("fusion_score"), "position")


def q_hybrid_match_kind(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).groupBy("match_kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("position") <= TOP_K).alias("in_top"))


def _sourced(fused: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    return fused.join(c.chunks(spark, d, "source_id"), "chunk_id", "left")


def q_relevance_normalised(spark: SparkSession, d: str) -> DataFrame:
    return fusion.normalised_relevance(_fused(spark, d)).select("query_id", "chunk_id", F.round("relevance", 6).alias("relevance"))


def q_source_diverse_topk(spark: SparkSession, d: str) -> DataFrame:
    return fusion.source_diverse(_sourced(_fused(spark, d), spark, d), TOP_K).select("query_id", "chunk_id", "source_id", "position", "selected_rank")


def q_search_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over the texts with its gates, the recorded dense candidates with theirs, fused, diversified and cited."""
    accepted = _gated(spark, d).where("gate IS NULL").select("query_id", "chunk_id", F.col("place").alias("rank"))
    admitted = lexical.ranked(_admitted(spark, d).where("admitted").drop("rank"))
    fused = fusion.reciprocal_rank_fusion(accepted, admitted)
    facts = c.chunks(spark, d, "source_id", "document_id")
    top = fusion.source_diverse(fused.join(facts, "chunk_id"), TOP_K)
    cited = top.join(c.documents(spark, d, "title", "authors", "pub_year"), "document_id", "left")
    return cited.select("query_id", "selected_rank", "chunk_id", "source_id", "match_kind", F.round("fusion_score", 6).alias("fusion_score"), citation().alias("citation"))


def q_search_hybrid_embedded(spark: SparkSession, d: str) -> DataFrame:
    """Both halves computed: BM25 with its gates, and an exact scan of all chunk vectors for every query, of the stand-in embedder."""
    asked, embedder = c.text_queries(spark, d), hooks.HashingEmbedder()
    queries = asked.groupBy("query").agg(F.min("query_id").alias("query_id"))  # equal texts are searched once, under the smallest id
    vectors = cut(hooks.embedded(c.chunks(spark, d, "contents"), embedder, "chunk_id", "contents").withColumn("kind", F.lit("hashing")))
    query_vectors = cut(hooks.embedded(queries, embedder, "query_id", "query").withColumn("kind", F.lit("hashing")))
    found = dense.exact_top_k(dense.clean_vectors(vectors), dense.clean_vectors(query_vectors, "query_id"), DEPTH)
    admitted = dense.relative_gate(found, EMBEDDED_FLOOR, MARGIN).where("admitted").select("query_id", "chunk_id", "rank")
    accepted = _gated(spark, d, queries=queries).where("gate IS NULL").select("query_id", "chunk_id", F.col("place").alias("rank"))
    fused = fusion.reciprocal_rank_fusion(accepted, admitted)
    top = fusion.source_diverse(fused.join(c.chunks(spark, d, "source_id"), "chunk_id"), TOP_K)
    each = asked.distinct().join(queries.select("query", F.col("query_id").alias("first_id")), "query").select("query_id", "first_id")
    answers = top.withColumnRenamed("query_id", "first_id").join(each, "first_id")
    return answers.select("query_id", "selected_rank", "chunk_id", "source_id", "match_kind", F.round("fusion_score", 6).alias("fusion_score"))


def citation() -> Column:
    """``authors, title (year)`` of what is known."""
    authors = F.when(F.size("authors") > 0, F.array_join("authors", "; "))
    year = F.when(F.col("pub_year") > 0, F.concat(F.lit("("), F.col("pub_year").cast("string"), F.lit(")")))
    return F.concat_ws(" ", F.concat_ws(", ", authors, F.col("title")), year)


def _with_contents(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).join(c.chunks(spark, d, "contents", "source_id"), "chunk_id")


def q_collapse_repetitions(spark: SparkSession, d: str) -> DataFrame:
    return fusion.collapse_repetitions(_with_contents(spark, d), read_table(spark, d, "reuse_vectors").dropDuplicates(["vec_id"]))


def q_reranked_search(spark: SparkSession, d: str) -> DataFrame:
    """Reranked by the share of the query's tokens a chunk holds, the substitute where no cross-encoder is at hand."""
    base = _with_contents(spark, d).join(c.text_queries(spark, d), "query_id")
    q, t = gate_tokens(F.col("query")), gate_tokens(F.col("contents"))
    share = F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(0.0)
    out = fusion.rerank(base.withColumn("rerank_score", F.round(share, 6)), "rerank_score", TOP_K)
    return out.select("query_id", "chunk_id", "rerank_score", "position", "rerank_position", "in_window")


def q_search_trace(spark: SparkSession, d: str) -> DataFrame:
    """Per search the count, the first 256 chunk ids and a truncation flag of each stage."""
    stages = [("bm25", _component(spark, d, "bm25").select("query_id", "chunk_id", "rank")), ("dense", _component(spark, d, "dense").select("query_id", "chunk_id", "rank")), ("fused", _fused(spark, d).select("query_id", "chunk_id", F.col("position").alias("rank"))), ("selected", q_source_diverse_topk(spark, d).select("query_id", "chunk_id", F.col("selected_rank").alias("rank")))]
    rows = None
    for name, df in stages:
        s = df.withColumn("stage", F.lit(name))
        rows = s if rows is None else rows.unionByName(s)
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 256, F.struct("rank", "chunk_id")))), lambda x: x["chunk_id"])
    return rows.groupBy("query_id", "stage").agg(F.count(F.lit(1)).alias("n"), F.array_join(kept, " ").alias("ids"), (F.count(F.lit(1)) > 256).alias("truncated"))


def q_equality_key_groups(spark: SparkSession, d: str) -> DataFrame:
    key = equality_key(F.col("contents"))
    groups = c.chunks(spark, d, "contents", "source_id").groupBy(F.sha2(key, 256).alias("key_sha256")).agg(F.count(F.lit(1)).alias("copies"), F.count_distinct("source_id").alias("sources"), F.min("chunk_id").alias("first_chunk_id"))
    return groups.where("copies > 1")


_BM25 = f"""
WITH c AS {c.CHUNKS_SQL}, q AS {c.QUERIES_SQL},
sized AS (SELECT chunk_id, t, len(t) AS dl FROM (SELECT chunk_id, {index_tokens_sql("contents")} AS t FROM c) WHERE len(t) > 0),
post AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, dl, unnest(t) AS term FROM sized) GROUP BY ALL),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sized),
terms AS (SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY 1), tot),
qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({index_tokens_sql("query")}) AS term FROM q) GROUP BY ALL),
scores AS (SELECT query_id, chunk_id, round(sum(qf * idf * tf / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 9) AS score
  FROM qt JOIN terms USING (term) JOIN post USING (term), tot GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scores)
"""


def _gated_sql(passes: str, window: int) -> str:
    return _BM25 + f"""
, d AS {c.DOCUMENTS_SQL},
judged AS (SELECT r.*, c.source_id, CASE WHEN NOT coalesce({passes}, true) THEN 'filtered_out'
    WHEN coalesce(c.health_flags, 0) & 2 <> 0 THEN 'extraction_artifact' WHEN coalesce(c.health_flags, 0) & 1 <> 0 THEN 'corrupt'
    WHEN NOT list_has_any({gate_tokens_sql("q.query")}, {gate_tokens_sql("c.contents")}) THEN 'no_query_token_overlap' END AS gate
  FROM ranked r JOIN c USING (chunk_id) JOIN q USING (query_id) LEFT JOIN d ON d.document_id = c.document_id WHERE r.rank <= {window}),
walked AS (SELECT *, coalesce(sum(CASE WHEN gate IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM judged),
looked AS (SELECT *, CASE WHEN gate IS NULL THEN before + 1 END AS place FROM walked WHERE before < 20)
"""


_PLAIN = _gated_sql("true", 80)
_PRF = _PLAIN + f"""
, lead AS (SELECT query_id, unnest({gate_tokens_sql("contents")}) AS term FROM looked JOIN (SELECT chunk_id, contents FROM c) USING (chunk_id) WHERE place <= 5),
own AS (SELECT query_id, unnest({gate_tokens_sql("query")}) AS term FROM q),
support AS (SELECT query_id, term, count(*) AS support FROM lead ANTI JOIN own USING (query_id, term) GROUP BY 1, 2),
frequent AS (SELECT term, count(*) AS df FROM (SELECT unnest({gate_tokens_sql("contents")}) AS term FROM (SELECT DISTINCT chunk_id, contents FROM c)) GROUP BY 1),
mined AS (SELECT query_id, term, support, row_number() OVER (PARTITION BY query_id ORDER BY round(support * (ln((n + 1) / (coalesce(df, 0) + 1)) + 1), 9) DESC, support DESC, term) AS place
  FROM support LEFT JOIN frequent USING (term), (SELECT count(DISTINCT chunk_id) AS n FROM c))
"""
_SECOND = _PRF + f"""
, q2 AS (SELECT query_id, concat_ws(' ', query, more) AS query FROM q LEFT JOIN (SELECT query_id, string_agg(term, ' ' ORDER BY term) AS more FROM mined WHERE place <= 8 GROUP BY 1) USING (query_id)),
qt2 AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({index_tokens_sql("query")}) AS term FROM q2) GROUP BY ALL),
scores2 AS (SELECT query_id, chunk_id, round(sum(qf * idf * tf / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 9) AS score FROM qt2 JOIN terms USING (term) JOIN post USING (term), tot GROUP BY 1, 2),
ranked2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scores2),
accepted2 AS (SELECT r.*, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM ranked2 r JOIN c USING (chunk_id) JOIN q2 USING (query_id)
  WHERE rank <= 80 AND coalesce(c.health_flags, 0) & 3 = 0 AND list_has_any({gate_tokens_sql("q2.query")}, {gate_tokens_sql("c.contents")}))
"""

_V = "(SELECT DISTINCT vec_id, chunk_id, embedding_model AS kind, vector FROM reuse_vectors WHERE vector IS NOT NULL AND embedding_model IS NOT NULL AND chunk_id IS NOT NULL AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0)"


def _dense_sql(allowed: str) -> str:
    return f"""
WITH v AS {_V}, pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[]), 9) AS score
  FROM v a JOIN v b ON a.kind = b.kind AND len(a.vector) = len(b.vector) WHERE a.vec_id % 20 = 0 {allowed})
SELECT query_id, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 10"""


_GATE = f"""
WITH h AS {c.HITS_SQL}, c AS {c.CHUNKS_SQL},
lexical AS (SELECT search_id AS query_id, chunk_id, row_number() OVER (PARTITION BY search_id ORDER BY score DESC, chunk_id) AS rank FROM h WHERE component = 'bm25'),
semantic AS (SELECT search_id AS query_id, chunk_id, score, row_number() OVER (PARTITION BY search_id ORDER BY score DESC, chunk_id) AS rank, max(score) OVER (PARTITION BY search_id) AS best FROM h WHERE component = 'dense'),
gate AS (SELECT *, CASE WHEN best >= 0.72e0 THEN least(0.72e0, round(best - 0.1e0, 9)) ELSE 0.72e0 END AS effective_floor FROM semantic),
admitted AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM gate WHERE score >= effective_floor),
both_ AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.rank AS bm25_rank, b.rank AS dense_rank
  FROM lexical a FULL JOIN admitted b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, least(coalesce(bm25_rank, 201), coalesce(dense_rank, 201)), chunk_id) AS position FROM (
  SELECT *, round(coalesce(1.25e0 / (60 + bm25_rank), 0) + coalesce(1e0 / (60 + dense_rank), 0), 9) AS fusion_score,
    CASE WHEN bm25_rank IS NULL THEN 'semantic' WHEN dense_rank IS NULL THEN 'lexical' ELSE 'hybrid' END AS match_kind FROM both_)),
relevant AS (SELECT f.*, c.source_id, CASE WHEN max(fusion_score) OVER w <= min(fusion_score) OVER w THEN 1.0 ELSE round((fusion_score - min(fusion_score) OVER w) / (max(fusion_score) OVER w - min(fusion_score) OVER w), 9) END AS relevance
  FROM fused f LEFT JOIN c USING (chunk_id) WINDOW w AS (PARTITION BY query_id)),
charged AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY query_id) <= 10 THEN 0 ELSE round(relevance - 0.25e0 * (row_number() OVER (PARTITION BY query_id, coalesce(source_id, chunk_id) ORDER BY relevance DESC, position, chunk_id) - 1), 9) END AS adjusted FROM relevant),
diverse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, position, chunk_id) AS selected_rank FROM charged)
"""

_HYBRID = _PLAIN + f", h AS {c.HITS_SQL}, lexical AS (SELECT query_id, chunk_id, place AS rank FROM looked WHERE gate IS NULL),\n" + _GATE[_GATE.index("semantic AS") :]
_CITED = "concat_ws(' ', concat_ws(', ', CASE WHEN len(authors) > 0 THEN array_to_string(authors, '; ') END, title), CASE WHEN pub_year > 0 THEN '(' || pub_year || ')' END)"
_TRACED = _GATE + """, stages AS (SELECT query_id, 'bm25' AS stage, chunk_id, rank FROM lexical UNION ALL SELECT query_id, 'dense', chunk_id, rank FROM semantic
UNION ALL SELECT query_id, 'fused', chunk_id, position FROM fused UNION ALL SELECT query_id, 'selected', chunk_id, selected_rank FROM diverse WHERE selected_rank <= 10)
SELECT query_id, stage, count(*) AS n, string_agg(chunk_id, ' ' ORDER BY rank) FILTER (WHERE rank <= 256) AS ids, count(*) > 256 AS truncated FROM stages GROUP BY 1, 2"""

QUERIES = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
ORACLES = {
    "gate_tokens": f"SELECT query_id, unnest({gate_tokens_sql('query')}) AS term FROM {c.QUERIES_SQL}",
    "document_frequencies": _BM25 + "SELECT term, df, round(idf, 6) AS idf FROM terms",
    "bm25_topk": _BM25 + "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10",
    "bm25_gated": _PLAIN + "SELECT query_id, coalesce(gate, 'accepted') AS gate, count(*) AS n FROM looked GROUP BY 1, 2",
    "bm25_window_filtered": _gated_sql("coalesce(list_has_any(d.languages, ['fr', 'de']), NULL)", 200) + "SELECT query_id, chunk_id, rank, place FROM looked WHERE gate IS NULL",
    "prf_terms": _PRF + "SELECT query_id, term, support, place FROM mined WHERE place <= 8",
    "bm25_with_feedback": _SECOND + "SELECT query_id, chunk_id, round(score, 6) AS score, rank, place FROM accepted2 WHERE place <= 10",
    "dense_exact_topk": _dense_sql(""),
    "dense_filtered_topk": _dense_sql("AND b.chunk_id IN (SELECT chunk_id FROM chunks WHERE document_id IN (SELECT document_id FROM source_documents WHERE list_contains(languages, 'fr')))"),
    "dense_gate": _GATE + "SELECT query_id, chunk_id, round(score, 6) AS score, round(effective_floor, 6) AS effective_floor, score >= effective_floor AS admitted FROM gate",
    "dense_gate_counts": _GATE + "SELECT query_id, count(*) AS eligible, count(*) FILTER (WHERE score >= 0.72e0) AS above_floor, count(*) FILTER (WHERE score >= effective_floor AND score < 0.72e0) AS rescued, count(*) FILTER (WHERE score < effective_floor) AS rejected FROM gate GROUP BY 1",
    "rrf_fusion": _GATE + "SELECT query_id, chunk_id, bm25_rank, dense_rank, round(fusion_score, 6) AS fusion_score, position FROM fused",
    "hybrid_match_kind": _GATE + "SELECT match_kind, count(*) AS n, count(*) FILTER (WHERE position <= 10) AS in_top FROM fused GROUP BY 1",
    "relevance_normalised": _GATE + "SELECT query_id, chunk_id, round(relevance, 6) AS relevance FROM relevant",
    "source_diverse_topk": _GATE + "SELECT query_id, chunk_id, source_id, position, selected_rank FROM diverse WHERE selected_rank <= 10",
    "search_hybrid": _HYBRID + f"SELECT query_id, selected_rank, v.chunk_id, v.source_id, match_kind, round(fusion_score, 6) AS fusion_score, {_CITED} AS citation FROM diverse v JOIN c USING (chunk_id) LEFT JOIN d ON d.document_id = c.document_id WHERE selected_rank <= 10",
    "reranked_search": _GATE + f""", t AS (SELECT query_id, {gate_tokens_sql("query")} AS asked FROM {c.QUERIES_SQL}), k AS (SELECT chunk_id, {gate_tokens_sql("contents")} AS held FROM c),
b AS (SELECT query_id, chunk_id, position, round(CASE WHEN len(asked) > 0 THEN len(list_intersect(asked, held)) / len(asked) ELSE 0 END, 6) AS rerank_score FROM fused JOIN k USING (chunk_id) JOIN t USING (query_id))
SELECT *, position <= 20 AS in_window, row_number() OVER (PARTITION BY query_id ORDER BY position <= 20 DESC, CASE WHEN position <= 20 THEN rerank_score END DESC NULLS LAST, position, chunk_id) AS rerank_position FROM b""",
    "search_trace": _TRACED,
    "equality_key_groups": f"SELECT sha256(array_to_string(regexp_extract_all(lower(contents), '[\\p{{L}}\\p{{N}}]+'), ' ')) AS key_sha256, count(*) AS copies, count(DISTINCT source_id) AS sources, min(chunk_id) AS first_chunk_id FROM {c.CHUNKS_SQL} GROUP BY 1 HAVING count(*) > 1",
}
