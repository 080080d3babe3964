"""Served methods, exclusions, passages, disclosures and listings over the tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators import catalogue as k
from quernstone.operators import fusion, lexical
from quernstone.operators import policies as p
from quernstone.queries import common as c
from quernstone.queries import search as s
from quernstone.queries.catalogue import _A, _C, _D, _S
from quernstone.sources import read_table

CONFIGURED_MODEL = "marrow-multi"
RADIUS = 2


def decisions(spark: SparkSession, d: str) -> p.Decisions:
    """Decisions a reviewer might take: out with sources without authors and with corrupt chunks."""
    sources = read_table(spark, d, "source_documents").where(F.array_contains("metadata_warnings", "authors_missing") & F.col("source_id").isNotNull()).select("source_id", F.lit("authors_missing").alias("reason")).distinct()
    chunks = c.chunks(spark, d, "health_flags").where(F.col("health_flags").bitwiseAND(lexical.CORRUPT) != 0).select("chunk_id", F.lit("corrupt").alias("reason")).distinct()
    return p.Decisions(sources, chunks)


def q_served_method(spark: SparkSession, d: str) -> DataFrame:
    """For every document the method that answers each request: its vectors, if any, must be of the configured model."""
    owners = c.chunks(spark, d, "document_id").join(read_table(spark, d, "reuse_vectors").where("vector IS NOT NULL").select("chunk_id").distinct(), "chunk_id", "left_semi").select("document_id", F.lit(True).alias("has")).distinct()
    docs = c.documents(spark, d, "embedding_model").join(owners, "document_id", "left")
    available = F.when(F.col("has"), F.array(F.lit("bm25"), F.lit("dense"), F.lit("hybrid"))).otherwise(F.array(F.lit("bm25")))
    asked = docs.withColumn("requested", F.explode(F.array(F.lit(None).cast("string"), F.lit("bm25"), F.lit("dense"), F.lit("hybrid"))))
    return asked.select("document_id", "requested", p.served_method(F.col("requested"), available, F.col("embedding_model") != CONFIGURED_MODEL).alias("s")).select("document_id", F.coalesce("requested", F.lit("default")).alias("requested"), "s.*")


def q_candidate_depth(spark: SparkSession, d: str) -> DataFrame:
    """Per search how many chunks its filters and the exclusions leave, and how many candidates are ranked."""
    kept = c.chunks(spark, d, "document_id").join(decisions(spark, d).chunks, "chunk_id", "left_anti").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    log = c.searches(spark, d).where("requested_top_k IS NOT NULL").select("search_id", "requested_top_k", "filters")
    asked = log.where("filters IS NOT NULL").select("filters", F.explode(k.normalised(F.from_json("filters", "languages_any array<string>")["languages_any"])).alias("language")).distinct()
    spoken = c.documents(spark, d, "languages").select("document_id", F.explode(k.normalised(F.col("languages"))).alias("language")).distinct()
    narrowed = asked.join(spoken, "language").select("filters", "document_id").distinct().join(kept, "document_id").groupBy("filters").agg(F.sum("n").alias("narrowed"))
    every = kept.agg(F.sum("n").alias("every"))  # one row
    out = log.join(narrowed, "filters", "left").join(F.broadcast(every), how="cross")
    active = F.when(F.col("filters").isNull(), F.col("every")).otherwise(F.coalesce("narrowed", F.lit(0)))
    return out.select("search_id", active.alias("active"), p.candidate_depth(active, F.col("requested_top_k")).alias("depth"))


def q_answers_by_method(spark: SparkSession, d: str) -> DataFrame:
    admitted = lexical.ranked(s._admitted(spark, d).where("admitted").drop("rank"))
    out = p.answers_by_method(s._component(spark, d, "bm25"), admitted, s._fused(spark, d), s.TOP_K)
    return out.withColumn("fusion_score", F.round("fusion_score", 6))


def q_excluded_search(spark: SparkSession, d: str) -> DataFrame:
    """The fused answers without excluded sources and chunks, ranked anew."""
    left = p.without_excluded(s._sourced(s._fused(spark, d), spark, d), decisions(spark, d))
    return lexical.ranked(left.select("query_id", "chunk_id", "source_id", (-F.col("position")).alias("score")), s.TOP_K).select("query_id", "chunk_id", "source_id", "rank")


def q_exclusion_listing(spark: SparkSession, d: str) -> DataFrame:
    return p.exclusion_listing(decisions(spark, d), c.chunks(spark, d, "source_id", "document_id"))


def q_get_passage(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk served first and every unit id, asked for as passages: the units are unknown."""
    asked = c.appearances(spark, d).where("rank = 1").select("chunk_id").union(read_table(spark, d, "units").select("unit_id"))
    return p.get_passage(c.chunks(spark, d, "source_id", "document_id", "document_chunk_index", "health_flags"), asked, RADIUS, decisions(spark, d))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return lexical.gated(s._component(spark, d, "bm25").drop("source_id"), s._facts(spark, d), c.text_queries(spark, d), s.DEPTH)


def q_search_disclosures(spark: SparkSession, d: str) -> DataFrame:
    """What each stage of a recorded search let through and kept out."""
    judged, dense = _judged(spark, d), s._admitted(spark, d)
    accepted = judged.where("gate IS NULL").select("query_id", "chunk_id", F.col("place").alias("rank"))
    fused = fusion.reciprocal_rank_fusion(accepted, lexical.ranked(dense.where("admitted").drop("rank"))).join(c.chunks(spark, d, "source_id", "embedding_token_count", "dense_truncated"), "chunk_id")
    wanted = c.searches(spark, d).where("query_text IS NOT NULL").select(F.col("search_id").alias("query_id"), "requested_top_k")
    return p.disclosures(judged, dense, fused, fusion.source_diverse(fused, s.TOP_K), wanted, s.FLOOR)


def q_rejected_examples(spark: SparkSession, d: str) -> DataFrame:
    """Up to five candidates per search and reason, with their sources and, for the dense half, their cosine."""
    lexical_half = _judged(spark, d).where("gate IS NOT NULL").select("query_id", F.concat(F.lit("bm25_"), "gate").alias("reason"), "chunk_id", "source_id", "rank", F.lit(None).cast("double").alias("cosine"))
    dense_half = s._admitted(spark, d).where("NOT admitted").select("query_id", F.lit("dense_below_threshold").alias("reason"), "chunk_id", "source_id", "rank", F.round("score", 6).alias("cosine"))
    return p.bounded_examples(lexical_half.unionByName(dense_half)).drop("rank")


def q_policy_differences(spark: SparkSession, d: str) -> DataFrame:
    """In which settings the model a document was built with differs from the configured one; a document it does not cover says so too."""
    models = read_table(spark, d, "embedding_models").withColumnRenamed("languages", "covered")
    now = models.where(F.col("model_name") == CONFIGURED_MODEL).select(*[F.col(x).alias(f"now_{x}") for x in ("model_name", "maximum_tokens", "overlap_tokens", "dimension")])
    rows = c.documents(spark, d, "embedding_model", "languages").join(models, F.col("embedding_model") == F.col("model_name"), "left").join(F.broadcast(now), how="cross")  # one row
    names = ("model_name", "maximum_tokens", "overlap_tokens", "dimension")
    differs = p.policy_differences({x: F.col(x) for x in names}, {x: F.col(f"now_{x}") for x in names})
    covered = F.size(F.array_except(k.normalised(F.col("languages")), "covered")) <= 0
    differs = F.when(F.coalesce(covered, F.lit(True)), differs).otherwise(F.concat(differs, F.array(F.lit("languages"))))
    return rows.select("document_id", F.array_join(differs, ",").alias("differences"))


def q_models_covering(spark: SparkSession, d: str) -> DataFrame:
    """For each set of languages that documents have, the smallest model that covers it."""
    sets = c.documents(spark, d, "languages").select(F.array_sort(k.normalised(F.col("languages"))).alias("wanted")).where(F.size("wanted") > 0).distinct()
    models = read_table(spark, d, "embedding_models").select("model_name", "size_gb", "languages").distinct()  # seven rows
    covering = sets.join(F.broadcast(models), F.size(F.array_except("wanted", "languages")) == 0)
    return covering.groupBy(F.array_join("wanted", ",").alias("languages")).agg(F.min_by("model_name", F.struct("size_gb", "model_name")).alias("model_name"), F.count(F.lit(1)).alias("models"))


def q_list_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources with a document in German, and which lists have them."""
    flags = p.list_sources(c.documents(spark, d, "source_id"), read_table(spark, d, "units"), c.appearances(spark, d), decisions(spark, d).sources)
    german = c.documents(spark, d, "source_id", "languages").where(k.any_of(F.col("languages"), ["de"])).select("source_id")
    return flags.join(german.distinct(), "source_id", "left_semi")


def q_read_appearances(spark: SparkSession, d: str) -> DataFrame:
    """How often each chunk of the most served source came out, and how often first."""
    board = c.appearances(spark, d).where("source_id IS NOT NULL")
    top = board.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "source_id").limit(1).select("source_id")
    return board.join(top, "source_id", "left_semi").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("appearances"), F.count_if(F.col("rank") == 1).alias("rank_one"))


def q_units_of_documents(spark: SparkSession, d: str) -> DataFrame:
    """Units of each document in reading order, numbered."""
    rows = c.units(spark, d, "document_id", "unit_ordinal").where("document_id IS NOT NULL")
    from pyspark.sql import Window as W

    return rows.withColumn("place", F.row_number().over(W.partitionBy("document_id").orderBy("unit_ordinal", "unit_id"))).select("document_id", "unit_id", "place")


_G = s._GATE
_OUT_SOURCES = "(SELECT DISTINCT source_id FROM source_documents WHERE list_contains(metadata_warnings, 'authors_missing') AND source_id IS NOT NULL)"
_OUT_CHUNKS = "(SELECT DISTINCT chunk_id FROM chunks WHERE health_flags & 1 <> 0)"
_JUDGED = _G[: _G.index("lexical AS")] + f"""q AS {c.QUERIES_SQL}, r0 AS (SELECT search_id AS query_id, chunk_id, score, row_number() OVER (PARTITION BY search_id ORDER BY score DESC, chunk_id) AS rank FROM h WHERE component = 'bm25'),
judged AS (SELECT r.query_id, r.chunk_id, c.source_id, r.rank, CASE WHEN coalesce(c.health_flags, 0) & 2 <> 0 THEN 'extraction_artifact' WHEN coalesce(c.health_flags, 0) & 1 <> 0 THEN 'corrupt'
    WHEN NOT list_has_any({s.gate_tokens_sql("q.query")}, {s.gate_tokens_sql("c.contents")}) THEN 'no_query_token_overlap' END AS gate FROM r0 r JOIN c USING (chunk_id) JOIN q USING (query_id) WHERE r.rank <= 80),
walked AS (SELECT *, coalesce(sum((gate IS NULL)::INT) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM judged),
looked AS (SELECT *, CASE WHEN gate IS NULL THEN before + 1 END AS place FROM walked WHERE before < 20), lexical AS (SELECT query_id, chunk_id, place AS rank FROM looked WHERE gate IS NULL),
""" + _G[_G.index("semantic AS") :]

QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
ORACLES = {
    "served_method": f"""WITH o AS (SELECT DISTINCT k.document_id FROM {_C} k JOIN reuse_vectors v USING (chunk_id) WHERE v.vector IS NOT NULL), x AS (SELECT d.document_id, embedding_model <> '{CONFIGURED_MODEL}' AS other, o.document_id IS NOT NULL AS has FROM {_D} d LEFT JOIN o ON o.document_id = d.document_id),
r AS (SELECT *, has AND NOT other AS full_, unnest([NULL, 'bm25', 'dense', 'hybrid']) AS requested FROM x)
SELECT document_id, coalesce(requested, 'default') AS requested, CASE WHEN full_ THEN coalesce(requested, 'hybrid') WHEN coalesce(requested, 'bm25') = 'bm25' THEN 'bm25' END AS method, CASE WHEN requested IS NULL AND other THEN 'embedding_model_mismatch' END AS reason,
  CASE WHEN NOT full_ AND requested IN ('dense', 'hybrid') THEN 'available: bm25' END AS refused FROM r""",
    "candidate_depth": f"""WITH kept AS (SELECT document_id, count(*) AS n FROM (SELECT DISTINCT chunk_id, document_id FROM chunks) WHERE chunk_id NOT IN {_OUT_CHUNKS} GROUP BY 1),
f AS (SELECT DISTINCT filters, list_transform((filters::JSON -> '$.languages_any')::VARCHAR[], lambda x: lower(trim(x))) AS l FROM search_log WHERE filters IS NOT NULL),
n AS (SELECT filters, sum(n) AS n FROM f JOIN {_D} d ON list_has_any(d.languages, f.l) JOIN kept USING (document_id) GROUP BY 1),
a AS (SELECT search_id, requested_top_k, CASE WHEN s.filters IS NULL THEN (SELECT sum(n) FROM kept) ELSE coalesce(n.n, 0) END::BIGINT AS active FROM {_S} s LEFT JOIN n ON n.filters = s.filters WHERE requested_top_k IS NOT NULL)
SELECT search_id, active, least(active, 200, greatest(20, requested_top_k * 4)) AS depth FROM a""",
    "answers_by_method": _G + """SELECT 'bm25' AS method, query_id, chunk_id, rank, NULL::DOUBLE AS fusion_score FROM lexical WHERE rank <= 10 UNION ALL SELECT 'dense', query_id, chunk_id, rank, NULL FROM admitted WHERE rank <= 10
UNION ALL SELECT 'hybrid', query_id, chunk_id, position, round(fusion_score, 6) FROM fused WHERE position <= 10""",
    "excluded_search": _G + f"""SELECT * FROM (SELECT query_id, f.chunk_id, source_id, row_number() OVER (PARTITION BY query_id ORDER BY position) AS rank FROM fused f LEFT JOIN c USING (chunk_id)
WHERE f.chunk_id NOT IN {_OUT_CHUNKS} AND (source_id IS NULL OR source_id NOT IN {_OUT_SOURCES})) WHERE rank <= 10""",
    "exclusion_listing": f"""WITH k AS (SELECT DISTINCT chunk_id, source_id, document_id FROM chunks) SELECT 'source' AS kind, o.source_id AS id, 'authors_missing' AS reason, count(DISTINCT document_id) AS documents, count(DISTINCT chunk_id) AS chunks FROM {_OUT_SOURCES} o LEFT JOIN k USING (source_id) GROUP BY 2
UNION ALL SELECT 'chunk', o.chunk_id, 'corrupt', count(DISTINCT document_id), count(DISTINCT chunk_id) FROM {_OUT_CHUNKS} o LEFT JOIN k USING (chunk_id) GROUP BY 2""",
    "get_passage": f"""WITH k AS (SELECT DISTINCT chunk_id, source_id, document_id, document_chunk_index, coalesce(health_flags, 0) AS flags, chunk_id IN {_OUT_CHUNKS} OR coalesce(source_id IN {_OUT_SOURCES}, false) AS excluded FROM chunks),
a AS (SELECT DISTINCT id FROM (SELECT chunk_id AS id FROM appearances WHERE rank = 1 UNION ALL SELECT unit_id FROM units) WHERE id IS NOT NULL),
j AS (SELECT id, CASE WHEN chunk_id IS NULL THEN 'unknown' WHEN excluded THEN 'excluded' WHEN flags & 3 <> 0 THEN 'unreadable' END AS refusal FROM a LEFT JOIN k ON k.chunk_id = a.id),
p AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY document_chunk_index) AS place FROM k WHERE flags & 3 = 0 AND document_id IS NOT NULL AND document_chunk_index IS NOT NULL)
SELECT t.chunk_id AS target_id, NULL AS refusal, n.chunk_id, (n.place - t.place)::INT AS "offset", n.excluded FROM p t JOIN p n ON t.document_id = n.document_id AND n.place BETWEEN t.place - {RADIUS} AND t.place + {RADIUS} WHERE t.chunk_id IN (SELECT id FROM j WHERE refusal IS NULL)
UNION ALL SELECT id, refusal, NULL, NULL, refusal = 'excluded' FROM j WHERE refusal IS NOT NULL""",
    "search_disclosures": _JUDGED + f""", a AS (SELECT query_id, count(*) AS bm25_looked_at, count(*) FILTER (gate IS NULL) AS bm25_accepted, count(*) FILTER (gate = 'filtered_out') AS bm25_filtered_out, count(*) FILTER (gate = 'extraction_artifact') AS bm25_extraction_artifact, count(*) FILTER (gate = 'corrupt') AS bm25_corrupt, count(*) FILTER (gate = 'no_query_token_overlap') AS bm25_no_query_token_overlap, max(rank) AS window_reached FROM looked GROUP BY 1),
e AS (SELECT query_id, count(*) AS dense_eligible, count(*) FILTER (score >= 0.72e0) AS dense_above_floor, count(*) FILTER (score >= effective_floor AND score < 0.72e0) AS dense_rescued, count(*) FILTER (score < effective_floor) AS dense_below_threshold FROM gate GROUP BY 1),
f AS (SELECT query_id, count(*) AS candidates, count(DISTINCT c.source_id) AS candidate_sources FROM fused JOIN c USING (chunk_id) GROUP BY 1),
v AS (SELECT query_id, count(*) AS results, count(DISTINCT c.source_id) AS result_sources, count(embedding_token_count) AS audited_results, count(*) FILTER (dense_truncated) AS truncated_results FROM diverse JOIN c USING (chunk_id) WHERE selected_rank <= 10 GROUP BY 1),
w AS (SELECT search_id AS query_id, requested_top_k FROM {_S} WHERE query_text IS NOT NULL)
SELECT w.query_id, requested_top_k, a.* EXCLUDE (query_id), e.* EXCLUDE (query_id), coalesce(candidates, 0) AS candidates, coalesce(candidate_sources, 0) AS candidate_sources, coalesce(results, 0) AS results, coalesce(result_sources, 0) AS result_sources, coalesce(audited_results, 0) AS audited_results, coalesce(truncated_results, 0) AS truncated_results,
  coalesce(candidates, 0) < requested_top_k AS relevance_limited FROM w LEFT JOIN a USING (query_id) LEFT JOIN e USING (query_id) LEFT JOIN f USING (query_id) LEFT JOIN v USING (query_id) WHERE bm25_looked_at IS NOT NULL OR dense_eligible IS NOT NULL""",
    "rejected_examples": _JUDGED + """, x AS (SELECT query_id, 'bm25_' || gate AS reason, chunk_id, source_id, rank, NULL::DOUBLE AS cosine FROM looked WHERE gate IS NOT NULL
UNION ALL SELECT g.query_id, 'dense_below_threshold', g.chunk_id, s.source_id, rank, round(g.score, 6) FROM gate g JOIN (SELECT search_id, chunk_id, source_id FROM h WHERE component = 'dense') s ON s.search_id = g.query_id AND s.chunk_id = g.chunk_id WHERE g.score < effective_floor)
SELECT * EXCLUDE (rank) FROM (SELECT *, row_number() OVER (PARTITION BY query_id, reason ORDER BY rank, chunk_id) AS example FROM x) WHERE example <= 5""",
    "policy_differences": f"""WITH n AS (SELECT * FROM embedding_models WHERE model_name = '{CONFIGURED_MODEL}')
SELECT document_id, concat_ws(',', CASE WHEN m.model_name IS DISTINCT FROM n.model_name THEN 'model_name' END, CASE WHEN m.maximum_tokens IS DISTINCT FROM n.maximum_tokens THEN 'maximum_tokens' END, CASE WHEN m.overlap_tokens IS DISTINCT FROM n.overlap_tokens THEN 'overlap_tokens' END,
  CASE WHEN m.dimension IS DISTINCT FROM n.dimension THEN 'dimension' END, CASE WHEN NOT coalesce(list_has_all(m.languages, list_transform(d.languages, lambda x: lower(trim(x)))), true) THEN 'languages' END) AS differences FROM {_D} d LEFT JOIN embedding_models m ON m.model_name = d.embedding_model, n""",
    "models_covering": f"""WITH w AS (SELECT DISTINCT list_sort(list_distinct(list_transform(languages, lambda x: lower(trim(x))))) AS l FROM {_D} WHERE len(languages) > 0)
SELECT array_to_string(l, ',') AS languages, arg_min(model_name, (size_gb, model_name)) AS model_name, count(*) AS models FROM w JOIN embedding_models m ON list_has_all(m.languages, w.l) GROUP BY 1""",
    "list_sources": f"""WITH g AS (SELECT DISTINCT source_id FROM {_D} WHERE list_contains(list_transform(languages, lambda x: lower(trim(x))), 'de') AND source_id IS NOT NULL)
SELECT source_id, true AS indexed, source_id IN (SELECT source_id FROM units WHERE source_id IS NOT NULL) AS discovered, source_id IN (SELECT source_id FROM appearances WHERE source_id IS NOT NULL) AS known, source_id IN {_OUT_SOURCES} AS reviewed FROM g""",
    "read_appearances": f"SELECT chunk_id, count(*) AS appearances, count(*) FILTER (rank = 1) AS rank_one FROM {_A} WHERE source_id = (SELECT source_id FROM {_A} WHERE source_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) GROUP BY 1",
    "units_of_documents": "SELECT document_id, unit_id, row_number() OVER (PARTITION BY document_id ORDER BY unit_ordinal, unit_id) AS place FROM (SELECT DISTINCT unit_id, document_id, unit_ordinal FROM units WHERE document_id IS NOT NULL)",
}
