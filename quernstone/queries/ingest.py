"""Screening, metadata, token counts, embedding and builds over the tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import hooks
from quernstone.functions import metadata as m
from quernstone.operators import catalogue as k
from quernstone.operators import evaluation as e
from quernstone.operators import screening
from quernstone.plans import builds
from quernstone.plans.generations import reusable_vectors
from quernstone.queries import common as c
from quernstone.queries import evaluation as qe
from quernstone.queries import texts as qt
from quernstone.queries.policies import _OUT_SOURCES, CONFIGURED_MODEL, decisions
from quernstone.sources import read_table

TOKEN_FRACTION, CHUNK_SIZE = 0.125, 384


def q_source_screening(spark: SparkSession, d: str) -> DataFrame:
    """The pages of ``documents`` as units of their ``source``: counts, losses and the verdict on each source."""
    out = screening.screened(read_table(spark, d, "documents").where("source IS NOT NULL"), "source", "text")
    return out.withColumn("verdict", F.array_join("verdict", ","))


def q_passage_health(spark: SparkSession, d: str) -> DataFrame:
    """Pages that are not served as they are, and why."""
    rows = read_table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(screening.passage_health_reasons(F.col("text")), ",").alias("reasons"))
    return rows.where("reasons <> ''")


def q_document_loss(spark: SparkSession, d: str) -> DataFrame:
    """Corrupt pages: what dropping their corrupt paragraphs leaves, null where too little is left."""
    rows = read_table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text", screening.readable_text(F.col("text")).alias("kept"))
    return rows.where(~F.col("text").eqNullSafe(F.col("kept"))).select("doc_id", F.length("text").alias("characters"), F.length("kept").alias("kept_characters"))


def q_document_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Resolved title with its provenance, authors, year, languages and what is missing of each document."""
    first = read_table(spark, d, "units").where("document_id IS NOT NULL").groupBy("document_id").agg(F.min_by("title", F.struct("unit_ordinal", "unit_id")).alias("heading"))
    docs = c.documents(spark, d, "source_relative_path", "title", "authors", "pub_year", "languages").join(first, "document_id", "left")
    docs = docs.select("document_id", m.identity(F.col("title"), F.col("heading"), F.col("source_relative_path")).alias("i"), m.valid_authors(F.col("authors")).alias("authors"), F.when(F.col("pub_year").between(1, 9999), F.col("pub_year")).alias("year"), F.filter(F.array_distinct(F.transform(F.coalesce("languages", F.array().cast("array<string>")), m.language_code)), lambda x: x != "").alias("languages"))
    warnings = m.metadata_warnings(F.col("i.provenance"), F.col("i.conflict"), F.col("authors"), F.col("year"), F.col("languages"))
    return docs.select("document_id", "i.title", "i.provenance", "i.conflict", F.array_join("authors", ";").alias("authors"), F.coalesce("year", F.lit(0)).alias("year"), F.array_join("languages", ",").alias("languages"), F.array_join(warnings, ",").alias("warnings"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    rows = c.chunks(spark, d, "document_id", "contents", "locator", "content_kind").join(c.documents(spark, d, "title", "embedding_model"), "document_id", "left")
    text = hooks.embedding_text(F.col("title"), F.col("locator.section_title"), F.col("contents"))
    tokenizer = hooks.PatternTokenizer()
    return rows.select("chunk_id", "embedding_model", "content_kind", tokenizer.count(text).alias("tokens"), tokenizer.count(F.col("contents")).alias("own_tokens"))


def q_embedding_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of what each chunk is embedded from, header included, and whether its model cuts it."""
    models = read_table(spark, d, "embedding_models").select(F.col("model_name").alias("embedding_model"), "maximum_tokens").distinct()
    out = _sized(spark, d).join(F.broadcast(models), "embedding_model", "left")  # seven models
    return out.select("chunk_id", "tokens", (F.col("tokens") > F.col("maximum_tokens")).alias("dense_truncated"))


def q_minimum_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Per kind the chunks that are too short to be cited: under an eighth of the size chunks are cut to."""
    floor = hooks.minimum_tokens(TOKEN_FRACTION, CHUNK_SIZE)
    return _sized(spark, d).groupBy(F.coalesce("content_kind", F.lit("unknown")).alias("kind")).agg(F.count_if(F.col("own_tokens") < floor).alias("too_short"), F.count(F.lit(1)).alias("chunks"))


def q_embed_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every different chunk embedded by the stand-in embedder: dimension and length of its vector."""
    vectors = hooks.embedded(c.chunks(spark, d, "contents"), hooks.HashingEmbedder(), "chunk_id", "contents")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return vectors.select("chunk_id", F.size("vector").alias("dimension"), F.round(norm, 3).alias("norm"))


def q_family_means(spark: SparkSession, d: str) -> DataFrame:
    """Graded nDCG per component over searches, and over callers as families."""
    callers = c.searches(spark, d).select(F.col("search_id").alias("query_id"), qe.caller_class(F.col("caller")).alias("family"))
    return e.two_level_means(qe._graded(spark, d).join(callers, "query_id"), "graded_ndcg")


def q_handoff_validation(spark: SparkSession, d: str) -> DataFrame:
    """The rules of a handed-over evaluation over the raw tables, repeated rows and all."""
    questions = read_table(spark, d, "search_log").where("query_text IS NOT NULL").select(F.col("search_id").alias("query_id"))
    judgments = read_table(spark, d, "appearances").select(F.col("search_id").alias("query_id"), "chunk_id", (5 - F.col("rank")).alias("grade"))
    rankings = read_table(spark, d, "component_hits").select(F.col("component").alias("condition"), F.col("search_id").alias("query_id"), "chunk_id", "score")
    return e.handoff_violations(questions, judgments, rankings)


def q_source_selection(spark: SparkSession, d: str) -> DataFrame:
    """What builds of all sources, of named ones and without named ones hold; named are sources with several versions, held those with units."""
    docs = c.documents(spark, d, "source_id")
    named = docs.where("source_id IS NOT NULL").groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held, out = read_table(spark, d, "units").select("source_id"), decisions(spark, d).sources
    parts = [builds.selected_sources(docs, held, out, None if mode is None else named, mode).withColumn("mode", F.lit(mode or "all")) for mode in (None, "ingest", "remove")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def q_revalidation(spark: SparkSession, d: str) -> DataFrame:
    """The latest versions against the first recorded, with the exclusions taken since."""
    docs = read_table(spark, d, "source_documents").select("source_id", "document_id", "size_bytes", "modified_at", "sha256").where("source_id IS NOT NULL").dropDuplicates(["document_id"])
    now = k.latest_versions(docs, "source_id", ["modified_at", "document_id"])
    before = docs.groupBy("source_id").agg(F.min_by(F.struct("size_bytes", "modified_at", "sha256"), F.struct("modified_at", "document_id")).alias("s")).select("source_id", "s.*")
    out = decisions(spark, d).sources
    return builds.revalidated(now, before, out, out.limit(0))


def q_build_metrics(spark: SparkSession, d: str) -> DataFrame:
    documents = read_table(spark, d, "source_documents").select("document_id", "discarded_corrupt_character_count", "cleaned_corrupt_span_count", "partially_cleaned_passage_count").distinct()
    chunks = reusable_vectors(c.chunks(spark, d, "contents"), read_table(spark, d, "reuse_vectors"), CONFIGURED_MODEL)
    return builds.build_metrics(documents, c.units(spark, d, "contents"), chunks)


_BAD = qt._re(screening.UNREADABLE)


def _corrupt_sql(t: str) -> str:
    lost, private, garbled = f"len(regexp_extract_all({t}, chr(65533)))", f"len(regexp_extract_all({t}, '[\\x{{E000}}-\\x{{F01F}}\\x{{F100}}-\\x{{F8E4}}]'))", f"regexp_matches({t}, {qt._re(qt.q.MOJIBAKE)})"
    return f"[CASE WHEN {lost} >= 2 OR {lost} = 1 AND ({private} > 0 OR {garbled}) THEN 'replacement_characters' END, CASE WHEN {private} >= 2 OR {private} = 1 AND {lost} > 0 THEN 'private_or_unassigned_characters' END, CASE WHEN {garbled} THEN 'known_mojibake' END]"


def _why_sql(t: str, share: bool = True) -> str:
    more = f"CASE WHEN NOT regexp_matches({t}, '[\\p{{L}}\\p{{N}}]') THEN 'symbol_only' END" + (f", CASE WHEN len(regexp_extract_all({t}, {_BAD})) * 100 > length({t}) * {screening.MAXIMUM_UNCLEAN_PERCENT} THEN 'unclean_text' END" if share else "")
    return f"list_filter({_corrupt_sql(t)} || [{more}], lambda x: x IS NOT NULL)"


_SOUND = f"len(list_filter({_corrupt_sql('p')}, lambda x: x IS NOT NULL)) = 0"
_READ = f"""t0 AS (SELECT *, list_filter(string_split(t, chr(10) || chr(10)), lambda p: trim(p, ' ') <> '' AND {_SOUND}) AS sound, len(list_filter({_corrupt_sql('t')}, lambda x: x IS NOT NULL)) = 0 AS whole FROM raw),
t1 AS (SELECT *, array_to_string(sound, chr(10) || chr(10)) AS j FROM t0), t2 AS (SELECT *, CASE WHEN whole THEN t WHEN length(j) * 100 >= length(t) * 50 AND len({_why_sql('j', False)}) = 0 THEN j END AS kept FROM t1)"""
_VALID = "(length(trim({0})) <= 500 AND length(regexp_replace(trim({0}), '[^\\p{{L}}]', '', 'g')) >= 3 AND NOT regexp_matches(trim({0}), '(?i)^(?:doi:|10\\.\\d{{4,9}}/|https?://|www\\.|untitled\\b|microsoft word)|\\.(?:pdf|epub|mobi|docx?|indd|qxd)$'))"
_TOKENS = "len(regexp_extract_all({0}, " + qt._re(hooks.TOKEN).replace("{", "{{").replace("}", "}}") + "))"
_SIZED = f"""s AS (SELECT k.chunk_id, k.contents, k.content_kind, d.embedding_model, nullif(CASE WHEN lower(d.t) = lower(k.s) THEN d.t ELSE concat_ws(' — ', d.t, k.s) END, '') AS header
  FROM (SELECT DISTINCT chunk_id, document_id, contents, content_kind, nullif(trim(locator.section_title), '') AS s FROM chunks) k LEFT JOIN (SELECT DISTINCT document_id, embedding_model, nullif(trim(title), '') AS t FROM source_documents) d USING (document_id))"""
_CODE = "lower(regexp_extract(trim(x), '^([A-Za-z]{2,3})(?:[-_].*)?$', 1))"

QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
ORACLES = {
    "source_screening": f"""WITH raw AS (SELECT source, coalesce(text, '') AS t FROM documents WHERE source IS NOT NULL), {_READ}, n AS (SELECT source, t, coalesce(kept, t) AS now FROM t2), y AS (SELECT *, {_why_sql('now')} AS why FROM n),
g AS (SELECT source, count(*) AS units, count(*) FILTER (len(why) = 0) AS retained, sum(CASE WHEN len(why) = 0 THEN length(now) ELSE 0 END)::BIGINT AS kept_characters, sum(length(t) - length(now))::BIGINT AS removed_characters, sum(CASE WHEN len(why) = 0 THEN 0 ELSE length(now) END)::BIGINT AS withheld_characters,
  sum(CASE WHEN len(why) = 0 THEN len(regexp_extract_all(now, '\\p{{L}}')) ELSE 0 END)::BIGINT AS letters, {", ".join(f"count(*) FILTER (list_contains(why, '{x}')) AS {x}" for x in ("replacement_characters", "private_or_unassigned_characters", "known_mojibake", "symbol_only", "unclean_text"))} FROM y GROUP BY 1)
SELECT *, CASE WHEN retained <= 0 THEN 'no_readable_text' ELSE concat_ws(',', CASE WHEN retained * 100 < units * 10 THEN 'almost_all_units_withheld' END, CASE WHEN retained * 100 < units * 10 AND symbol_only * 100 >= units * 50 THEN 'artifact_laden_text' END, CASE WHEN letters = 0 THEN 'no_letter_text' END,
  CASE WHEN withheld_characters > 0 AND withheld_characters * 100 > kept_characters * {screening.MAXIMUM_UNCLEAN_PERCENT} THEN 'unclean_text' END, CASE WHEN removed_characters >= 500 AND removed_characters * 100 > (kept_characters + removed_characters) * 50 THEN 'unsafe_to_clean' END) END AS verdict FROM g""",
    "passage_health": f"SELECT doc_id, array_to_string({_why_sql('text')}, ',') AS reasons FROM documents WHERE text IS NOT NULL AND len({_why_sql('text')}) > 0",
    "document_loss": f"WITH raw AS (SELECT doc_id, text AS t FROM documents WHERE text IS NOT NULL), {_READ} SELECT doc_id, length(t) AS characters, length(kept) AS kept_characters FROM t2 WHERE kept IS DISTINCT FROM t",
    "document_metadata": f"""WITH f AS (SELECT document_id, arg_min_null(title, (unit_ordinal, unit_id)) AS heading FROM units WHERE document_id IS NOT NULL GROUP BY 1),
v AS (SELECT d.*, CASE WHEN {_VALID.format("title")} THEN trim(title) END AS inside, CASE WHEN {_VALID.format("heading")} THEN trim(heading) END AS shown, list_filter(list_transform(coalesce(authors, []), lambda x: trim(regexp_replace(x, '[ \\t\\n\\r\\f]+', ' ', 'g'))), lambda x: x <> '') AS a FROM {c.DOCUMENTS_SQL} d LEFT JOIN f USING (document_id)),
w AS (SELECT *, CASE WHEN inside IS NOT NULL THEN 'embedded' WHEN shown IS NOT NULL THEN 'visible' ELSE 'filename' END AS provenance, coalesce(lower(inside) <> lower(shown), false) AS conflict, CASE WHEN pub_year BETWEEN 1 AND 9999 THEN pub_year END AS y,
  list_filter(list_filter(a, lambda x, i: list_position(list_transform(a, lambda z: lower(z)), lower(x)) = i), lambda x: regexp_matches(x, '\\p{{L}}.*\\p{{L}}') AND NOT regexp_matches(x, '[0-9@\\x{{FFFD}}]|[ÃÂ][\\x{{80}}-\\x{{BF}}]|â€')) AS names, list_transform(coalesce(languages, []), lambda x: {_CODE}) AS codes FROM v),
l AS (SELECT *, list_filter(codes, lambda x, i: x <> '' AND list_position(codes, x) = i) AS spoken FROM w)
SELECT document_id, coalesce(inside, shown, regexp_extract(source_relative_path, '([^/]+?)(?:\\.[A-Za-z0-9]+)?$', 1)) AS title, provenance, conflict, array_to_string(names, ';') AS authors, coalesce(y, 0) AS year, array_to_string(spoken, ',') AS languages,
  concat_ws(',', CASE WHEN provenance = 'filename' THEN 'title_from_filename' END, CASE WHEN conflict THEN 'conflicting_candidates' END, CASE WHEN len(names) = 0 THEN 'authors_missing' END, CASE WHEN y IS NULL THEN 'year_missing' END, CASE WHEN len(spoken) = 0 THEN 'languages_missing' END) AS warnings FROM l""",
    "embedding_tokens": f"WITH {_SIZED}, t AS (SELECT chunk_id, embedding_model, {_TOKENS.format('CASE WHEN header IS NULL THEN contents ELSE header || chr(10) || chr(10) || contents END')}::INT AS tokens FROM s) SELECT chunk_id, tokens, tokens > maximum_tokens AS dense_truncated FROM t LEFT JOIN (SELECT DISTINCT model_name, maximum_tokens FROM embedding_models) ON model_name = embedding_model",
    "minimum_tokens": f"WITH {_SIZED} SELECT coalesce(content_kind, 'unknown') AS kind, count(*) FILTER ({_TOKENS.format('contents')} < {hooks.minimum_tokens(TOKEN_FRACTION, CHUNK_SIZE)}) AS too_short, count(*) AS chunks FROM s GROUP BY 1",
    "family_means": qe._R + """, f AS (SELECT condition, caller, avg(graded_ndcg) AS m, sum(graded_ndcg) AS s, count(graded_ndcg) AS e, count(*) AS n FROM graded JOIN callers USING (query_id) GROUP BY 1, 2)
SELECT condition, round(sum(s) / sum(e), 6) AS query_mean, sum(e)::BIGINT AS queries_evaluated, sum(n)::BIGINT AS queries, round(avg(m), 6) AS family_mean, count(m) AS families_evaluated, count(*) AS families FROM f GROUP BY 1""",
    "handoff_validation": """WITH a AS (SELECT DISTINCT search_id AS query_id FROM search_log WHERE query_text IS NOT NULL AND search_id IS NOT NULL), j AS (SELECT search_id AS query_id, chunk_id, 5 - rank AS grade FROM appearances), r AS (SELECT component AS condition, search_id AS query_id, chunk_id, score FROM component_hits)
SELECT 'questions without an id' AS rule, (SELECT count(*) FROM search_log WHERE query_text IS NOT NULL AND search_id IS NULL) AS n UNION ALL SELECT 'judgments of no question', (SELECT count(*) FROM j WHERE query_id IS NULL OR query_id NOT IN (SELECT query_id FROM a))
UNION ALL SELECT 'judgments given twice', (SELECT count(*) FROM (SELECT 1 FROM j GROUP BY query_id, chunk_id HAVING count(*) > 1)) UNION ALL SELECT 'grades out of range', (SELECT count(*) FROM j WHERE grade IS NULL OR grade NOT BETWEEN 0 AND 4)
UNION ALL SELECT 'rankings of no question', (SELECT count(*) FROM r WHERE query_id IS NULL OR query_id NOT IN (SELECT query_id FROM a)) UNION ALL SELECT 'passages ranked twice', (SELECT count(*) FROM (SELECT 1 FROM r GROUP BY condition, query_id, chunk_id HAVING count(*) > 1))
UNION ALL SELECT 'scores missing or not finite', (SELECT count(*) FROM r WHERE score IS NULL OR isnan(score) OR isinf(score)) UNION ALL SELECT 'questions without a judgment', (SELECT count(*) FROM a WHERE query_id NOT IN (SELECT query_id FROM j WHERE query_id IS NOT NULL))""",
    "source_selection": f"""WITH x AS (SELECT source_id, count(*) > 1 AS named FROM (SELECT DISTINCT source_id, document_id FROM source_documents WHERE source_id IS NOT NULL) GROUP BY 1),
y AS (SELECT *, source_id IN (SELECT source_id FROM units WHERE source_id IS NOT NULL) AS held, source_id IN {_OUT_SOURCES} AS excluded FROM x)
SELECT source_id, excluded AS carried, 'all' AS mode FROM y WHERE NOT excluded OR held UNION ALL SELECT source_id, NOT named, 'ingest' FROM y WHERE named OR held UNION ALL SELECT source_id, NOT named, 'remove' FROM y WHERE held AND NOT named""",
    "revalidation": f"""WITH d AS (SELECT DISTINCT source_id, document_id, size_bytes, modified_at, sha256 FROM source_documents WHERE source_id IS NOT NULL),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY modified_at DESC NULLS LAST, document_id DESC) AS r FROM d) WHERE r = 1), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY modified_at ASC NULLS FIRST, document_id) AS r FROM d) WHERE r = 1),
m AS (SELECT count(*) FILTER (n.size_bytes <> o.size_bytes OR n.modified_at IS DISTINCT FROM o.modified_at AND n.sha256 IS DISTINCT FROM o.sha256) AS modified FROM n JOIN o USING (source_id)), x AS (SELECT count(*) AS decisions_changed FROM {_OUT_SOURCES})
SELECT 0::BIGINT AS added, 0::BIGINT AS removed, modified, decisions_changed, modified + decisions_changed = 0 AS publishable FROM m, x""",
    "build_metrics": f"""SELECT * FROM (SELECT count(*) AS documents, count(discarded_corrupt_character_count) AS documents_measured, sum(discarded_corrupt_character_count)::BIGINT AS discarded_corrupt_character, sum(cleaned_corrupt_span_count)::BIGINT AS cleaned_corrupt_span, sum(partially_cleaned_passage_count)::BIGINT AS partially_cleaned_passage
  FROM (SELECT DISTINCT document_id, discarded_corrupt_character_count, cleaned_corrupt_span_count, partially_cleaned_passage_count FROM source_documents)),
(SELECT count(*) AS units, count(*) FILTER (contents IS NULL) AS units_without_text FROM (SELECT DISTINCT unit_id, contents FROM units)),
(SELECT count(*) AS chunks, count(*) FILTER (reused) AS chunks_reused, count(*) FILTER (NOT reused) AS chunks_rebuilt FROM (SELECT coalesce(sha256(contents) IN (SELECT content_sha256 FROM reuse_vectors WHERE embedding_model = '{CONFIGURED_MODEL}' AND content_sha256 IS NOT NULL AND vector IS NOT NULL), false) AS reused FROM {c.CHUNKS_SQL}))""",
    "embed_texts": "SELECT chunk_id, 64 AS dimension, CASE WHEN regexp_matches(contents, '[\\p{L}\\p{N}]') THEN 1.0::DOUBLE ELSE 0.0 END AS norm FROM (SELECT DISTINCT chunk_id, contents FROM chunks WHERE contents IS NOT NULL)",
}
