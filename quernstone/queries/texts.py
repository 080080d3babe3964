"""Text quality, metadata, normalisation and chunking over the tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import metadata as m
from quernstone.functions import quality as q
from quernstone.functions import reading as r
from quernstone.functions.tokens import all_tokens
from quernstone.operators import chunking
from quernstone.queries import common as c
from quernstone.sources import read_table


def q_quality_flags(spark: SparkSession, d: str) -> DataFrame:
    return c.units(spark, d, "contents", "content_kind").select("unit_id", q.quality_flag(F.col("contents"), F.col("content_kind")).alias("flag"))


def q_corruption_reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(q.corruption_reasons(F.col("text")), ",").alias("reasons"), q.script_notes(F.col("text")).alias("note"))
    return rows.where("reasons <> '' OR note <> ''")


def q_reference_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = q.paragraphs(c.chunks(spark, d, "contents"), ["chunk_id"], ["chunk_id"])
    return rows.where(q.is_reference_entry(F.col("paragraph"))).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("entries"))


def q_section_headings(spark: SparkSession, d: str) -> DataFrame:
    rows = q.paragraphs(c.chunks(spark, d, "contents"), ["chunk_id"], ["chunk_id"])
    return rows.withColumn("kind", q.section_heading(F.col("paragraph"))).where("kind IS NOT NULL").select("chunk_id", "position", "kind")


def q_removed_sections(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of confirmed reference and note sections per document, in reading order over all its units."""
    rows = q.paragraphs(c.units(spark, d, "document_id", "unit_ordinal", "contents").where("document_id IS NOT NULL AND contents IS NOT NULL"), ["unit_ordinal", "unit_id"], ["document_id"])
    flagged = q.removed_sections(rows, "document_id", ["unit_ordinal", "unit_id", "position"])
    return flagged.where("removed IS NOT NULL").groupBy("document_id", "removed").agg(F.count(F.lit(1)).alias("paragraphs"), F.sum(F.length("paragraph")).alias("characters"))


def q_source_health(spark: SparkSession, d: str) -> DataFrame:
    """Documents that lost more than half of at least 500 characters, or kept under a tenth, of what their record counts."""
    docs = read_table(spark, d, "source_documents").select("document_id", "substantive_character_count", "discarded_corrupt_character_count").dropDuplicates(["document_id"]).where("substantive_character_count IS NOT NULL")
    kept, lost = F.col("substantive_character_count"), F.col("discarded_corrupt_character_count")
    verdict = F.when(kept + lost == 0, "empty").when((lost > 0.5 * (kept + lost)) & (kept + lost >= 500), "mostly_removed").when(kept < 0.1 * (kept + lost), "little_retained").when(lost > 0.02 * (kept + lost), "over_budget").otherwise("sound")
    return docs.select("document_id", verdict.alias("verdict"))


def q_apparatus_kind(spark: SparkSession, d: str) -> DataFrame:
    return c.chunks(spark, d, "contents").select("chunk_id", q.apparatus_kind(F.col("contents")).alias("kind")).where("kind IS NOT NULL")


def q_chunk_health(spark: SparkSession, d: str) -> DataFrame:
    """The bitmask computed anew for every chunk, beside the stored one."""
    flags = c.units(spark, d, "quality_flags")
    rows = c.chunks(spark, d, "unit_id", "contents", "health_flags").join(flags, "unit_id", "left")
    return rows.select("chunk_id", q.health_flags(F.col("contents"), F.col("quality_flags")).alias("computed"), "health_flags")


def q_section_context(spark: SparkSession, d: str) -> DataFrame:
    """The section heading last seen before each chunk of a document."""
    from pyspark.sql import Window as W

    rows = c.chunks(spark, d, "document_id", "document_chunk_index", "contents").where("document_id IS NOT NULL")
    heading = q.section_heading(F.element_at(F.split("contents", "\n"), 1))
    w = W.partitionBy("document_id").orderBy("document_chunk_index", "chunk_id").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(heading, ignorenulls=True).over(w)).where("section IS NOT NULL").select("chunk_id", "section")


def q_language_detection(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "documents").where("doc_id IS NOT NULL").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)).alias("tokens"))
    return rows.select("doc_id", m.detected_language(F.col("tokens")).alias("language"))


def q_language_codes(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").groupBy(F.coalesce(m.language_code(F.col("lang")), F.lit("")).alias("code")).agg(F.count(F.lit(1)).alias("documents"))


def q_doi_extraction(spark: SparkSession, d: str) -> DataFrame:
    return c.chunks(spark, d, "contents").select("chunk_id", m.doi(F.col("contents")).alias("doi")).where("doi <> ''")


def q_title_checks(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("doc_id", "title")
    return docs.select("doc_id", m.valid_title(F.col("title")).alias("valid"), m.year(F.col("title")).alias("year"))


def q_chunk_headers(spark: SparkSession, d: str) -> DataFrame:
    rows = c.chunks(spark, d, "document_id", "locator").join(c.documents(spark, d, "title"), "document_id", "left")
    return rows.select("chunk_id", m.chunk_header(F.col("title"), F.col("locator.section_title")).alias("header"))


def q_citation_marks(spark: SparkSession, d: str) -> DataFrame:
    return c.chunks(spark, d, "contents").select("chunk_id", F.explode(q.citations(F.col("contents"))).alias("citation")).groupBy("citation").agg(F.count(F.lit(1)).alias("chunks"))


def q_chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    """Every unit in windows of 96 words that share 16."""
    pieces = chunking.windows(c.units(spark, d, "contents"), 96, 16)
    return pieces.select("unit_id", "window", F.sha2("contents", 256).alias("contents_sha256"), F.length("contents").alias("characters"))


def q_chunk_ids_sha256(spark: SparkSession, d: str) -> DataFrame:
    units = c.units(spark, d, "contents", "document_id", "source_id", "unit_ordinal", "content_kind")
    return chunking.enriched(chunking.windows(units, 96, 16), units).select("chunk_id", "unit_id", "document_chunk_index")


def q_chunk_census(spark: SparkSession, d: str) -> DataFrame:
    rows = c.chunks(spark, d, "content_kind", "health_flags", "embedding_token_count", "dense_truncated")
    flag = F.coalesce("health_flags", F.lit(0))
    return rows.groupBy(F.coalesce("content_kind", F.lit("unknown")).alias("kind")).agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(flag.bitwiseAND(3) != 0).alias("withheld"), F.count("embedding_token_count").alias("audited"), F.count_if(F.col("dense_truncated")).alias("truncated"), F.max("embedding_token_count").alias("most_tokens"))


def q_normalize_reading_text(spark: SparkSession, d: str) -> DataFrame:
    return c.chunks(spark, d, "contents").select("chunk_id", r.normalize_reading_text("contents").alias("text"))


def q_mojibake_repair(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the corruption rules withhold, with what reversing a single-byte reading gives."""
    bad = read_table(spark, d, "documents").where(F.size(q.corruption_reasons(F.col("text"))) > 0)
    return bad.select("doc_id", r.repair_mojibake("text").alias("text"))


def q_damaged_words(spark: SparkSession, d: str) -> DataFrame:
    bad = read_table(spark, d, "documents").where(F.size(q.corruption_reasons(F.col("text"))) > 0)
    return bad.select("doc_id", r.clean_damaged("text").alias("x")).select("doc_id", "x.*")


def q_author_names(spark: SparkSession, d: str) -> DataFrame:
    docs = c.documents(spark, d, "authors").where(F.size("authors") > 0)
    return docs.select("document_id", F.array_join(r.split_authors(F.array_join("authors", "; ")), "|").alias("names"))


_PAR = "(SELECT {keep}, unnest(p) AS paragraph, generate_subscripts(p, 1) - 1 AS position FROM (SELECT {keep}, list_filter(list_transform(string_split(contents, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS p FROM {table}))"
_CP = _PAR.format(keep="chunk_id", table=c.CHUNKS_SQL)
_U = "(SELECT DISTINCT unit_id, document_id, source_id, unit_ordinal, contents, content_kind, quality_flags FROM units)"


def _re(pattern: str) -> str:
    return "'" + pattern.replace("'", "''").replace("\\x{80}-\\x{BF}", "\\x{80}-\\x{BF}") + "'"


_ENTRY = f"(length(paragraph) <= 400 AND regexp_matches(paragraph, {_re(q.ENTRY_LEAD)}) AND regexp_matches(paragraph, {_re(q.ENTRY_MARK)}))"


def _in(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_KEY = "lower(trim(regexp_replace(paragraph, '[:.]+$', '')))"
_HEADING = f"CASE WHEN length(paragraph) <= 80 AND NOT regexp_matches(paragraph, '[.,;!?]$') THEN CASE WHEN {_KEY} IN {_in(q.REFERENCE_HEADINGS)} THEN 'bibliography' WHEN {_KEY} IN {_in(q.NOTE_HEADINGS)} THEN 'footnotes' WHEN {_KEY} IN {_in(q.INDEX_HEADINGS)} THEN 'index' END END"
_COVER = ", ".join(f"{{'coverage': len(list_intersect(list_distinct(tokens[1:4000]), {list(w)!r})) / {len(w)}e0, 'code': '{k}'}}" for k, w in m.LANGUAGE_WORDS.items())
_WINDOWS = f"""(SELECT unit_id, unnest(range(0, n)) AS "window", trim(array_to_string(t[unnest(range(0, n)) * 80 + 1 : unnest(range(0, n)) * 80 + 96], '')) AS contents FROM (
  SELECT unit_id, t, greatest(1, ceil((len(t) - 16) / 80.0))::INT AS n FROM (SELECT unit_id, regexp_extract_all(trim(contents), '\\S+\\s*') AS t FROM {_U} WHERE contents IS NOT NULL) WHERE len(t) > 0))"""

_UP = _PAR.format(keep="document_id, unit_ordinal, unit_id", table=f"(SELECT * FROM {_U} WHERE document_id IS NOT NULL AND contents IS NOT NULL)")
_N = "len(regexp_extract_all({0}, {1}))"
_WORDS = "regexp_extract_all(contents, '\\p{L}+')"
_APPARATUS = f"""(SELECT chunk_id, CASE WHEN argues <= 0.06 AND ((entries >= 3 AND numbers / n >= 0.25) OR (entries >= 1 AND numbers / n >= 0.5)) THEN 'index'
  WHEN argues <= 0.06 AND capitals >= 0.25 AND marks / n >= 0.06 AND measured < 6 THEN 'bibliography' WHEN argues <= 0.12 AND front >= 2 AND measured < 6 THEN 'front_matter' END AS kind FROM (
  SELECT chunk_id, greatest(len({_WORDS}), 1) AS n, len(list_filter({_WORDS}, lambda x: lower(x) IN {_in(q.ARGUMENT_WORDS)})) / greatest(len({_WORDS}), 1) AS argues, len(list_filter({_WORDS}, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) / greatest(len({_WORDS}), 1) AS capitals,
  {_N.format("contents", _re(q.LOCATOR))} AS numbers, {_N.format("contents", _re(q.INDEX_ENTRY))} AS entries, {_N.format("contents", _re(q.FRONT_MATTER))} AS front, {_N.format("contents", _re(q.MEASUREMENT))} AS measured,
  {_N.format("contents", _re(q.ENTRY_MARK))} + {_N.format("contents", _re(q.NAME_MARK))} + {_N.format("contents", _re(q.VENUE_MARK))} AS marks FROM {c.CHUNKS_SQL}))"""

QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
ORACLES = {
    "quality_flags": f"SELECT unit_id, CASE WHEN contents IS NOT NULL AND (NOT regexp_matches(contents, '[\\p{{L}}\\p{{N}}]') OR (coalesce(content_kind, 'prose') = 'prose' AND length(regexp_replace(contents, '[^\\p{{L}}]', '', 'g')) < 3)) THEN 'extraction_artifact' ELSE '' END AS flag FROM {_U}",
    "corruption_reasons": f"""WITH x AS (SELECT doc_id, len(regexp_extract_all(text, chr(65533))) AS lost, len(regexp_extract_all(text, '[\\x{{E000}}-\\x{{F01F}}\\x{{F100}}-\\x{{F8E4}}]')) AS private, regexp_matches(text, {_re(q.MOJIBAKE)}) AS garbled,
  len(regexp_extract_all(text, '\\p{{L}}')) AS letters, len(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{24F}}]')) AS latin FROM documents WHERE text IS NOT NULL),
y AS (SELECT doc_id, concat_ws(',', CASE WHEN lost >= 2 OR (lost = 1 AND (private > 0 OR garbled)) THEN 'replacement_characters' END, CASE WHEN private >= 2 OR (private = 1 AND lost > 0) THEN 'private_or_unassigned_characters' END, CASE WHEN garbled THEN 'known_mojibake' END) AS reasons,
  CASE WHEN letters >= 20 AND latin < 0.5 * letters THEN 'non_latin_dominant' ELSE '' END AS note FROM x) SELECT * FROM y WHERE reasons <> '' OR note <> ''""",
    "reference_entries": f"SELECT chunk_id, count(*) AS entries FROM {_CP} WHERE {_ENTRY} GROUP BY 1",
    "section_headings": f"SELECT chunk_id, position, {_HEADING} AS kind FROM {_CP} WHERE ({_HEADING}) IS NOT NULL",
    "removed_sections": f"""WITH p AS {_UP}, m AS (SELECT *, {_HEADING} AS h0, coalesce({_ENTRY}, false) AS e, regexp_matches(paragraph, {_re(q.NOTE_MARK)}) AS t FROM p),
k AS (SELECT *, CASE WHEN h0 IN ('bibliography', 'footnotes') THEN h0 END AS h FROM m), l AS (SELECT *, last_value(h IGNORE NULLS) OVER w AS kind FROM k WINDOW w AS (PARTITION BY document_id ORDER BY unit_ordinal, unit_id, position)),
f AS (SELECT *, h IS NULL AND CASE kind WHEN 'bibliography' THEN e WHEN 'footnotes' THEN t ELSE false END AS fits FROM l),
s AS (SELECT *, sum((NOT fits)::INT) OVER w AS sec, lead(fits) OVER w AS confirmed FROM f WINDOW w AS (PARTITION BY document_id ORDER BY unit_ordinal, unit_id, position)),
o AS (SELECT *, max(h) OVER (PARTITION BY document_id, sec) AS opener FROM s), r AS (SELECT *, CASE WHEN fits AND opener IS NOT NULL THEN kind WHEN h IS NOT NULL AND coalesce(confirmed, false) THEN h END AS removed FROM o)
SELECT document_id, removed, count(*) AS paragraphs, sum(length(paragraph)) AS characters FROM r WHERE removed IS NOT NULL GROUP BY 1, 2""",
    "apparatus_kind": f"SELECT * FROM {_APPARATUS} WHERE kind IS NOT NULL",
    "chunk_health": f"""WITH x AS (SELECT chunk_id, unit_id, contents, health_flags, len(regexp_extract_all(contents, chr(65533))) AS lost, len(regexp_extract_all(contents, '[\\x{{E000}}-\\x{{F01F}}\\x{{F100}}-\\x{{F8E4}}]')) AS private, regexp_matches(contents, {_re(q.MOJIBAKE)}) AS garbled FROM (SELECT DISTINCT chunk_id, unit_id, contents, health_flags FROM chunks))
SELECT x.chunk_id, (coalesce((lost >= 2 OR lost = 1 AND (private > 0 OR garbled) OR private >= 2 OR private = 1 AND lost > 0 OR garbled)::INT, 0) + 2 * coalesce((coalesce(list_contains(quality_flags, 'extraction_artifact'), false) OR NOT regexp_matches(contents, '[\\p{{L}}\\p{{N}}]'))::INT, 0) + 4 * (kind IS NOT NULL)::INT)::INT AS computed, health_flags
FROM x LEFT JOIN (SELECT DISTINCT unit_id, quality_flags FROM units) u USING (unit_id) LEFT JOIN (SELECT DISTINCT * FROM {_APPARATUS} WHERE kind IS NOT NULL) a ON a.chunk_id = x.chunk_id""",
    "citation_marks": f"SELECT citation, count(*) AS chunks FROM (SELECT chunk_id, unnest(list_distinct(regexp_extract_all(contents, {_re(q.CITATION)}))) AS citation FROM {c.CHUNKS_SQL}) GROUP BY 1",
    "source_health": "SELECT document_id, CASE WHEN k + l = 0 THEN 'empty' WHEN l > 0.5 * (k + l) AND k + l >= 500 THEN 'mostly_removed' WHEN k < 0.1 * (k + l) THEN 'little_retained' WHEN l > 0.02 * (k + l) THEN 'over_budget' ELSE 'sound' END AS verdict FROM (SELECT DISTINCT document_id, substantive_character_count AS k, discarded_corrupt_character_count AS l FROM source_documents WHERE substantive_character_count IS NOT NULL)",
    "section_context": f"SELECT chunk_id, section FROM (SELECT chunk_id, last_value({_HEADING} IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY document_chunk_index, chunk_id) AS section FROM (SELECT *, trim(string_split(contents, chr(10))[1]) AS paragraph FROM {c.CHUNKS_SQL} WHERE document_id IS NOT NULL)) WHERE section IS NOT NULL",
    "language_detection": f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '\\p{{L}}+') AS tokens FROM documents WHERE doc_id IS NOT NULL), s AS (SELECT doc_id, tokens, list_sort([{_COVER}], 'DESC') AS s FROM t)
SELECT doc_id, CASE WHEN len(tokens) >= 120 AND s[1].coverage >= 0.1e0 AND s[1].coverage >= 1.5e0 * s[2].coverage THEN s[1].code ELSE '' END AS language FROM s""",
    "language_codes": "SELECT coalesce(lower(regexp_extract(trim(lang), '^([A-Za-z]{2,3})(?:[-_].*)?$', 1)), '') AS code, count(*) AS documents FROM documents GROUP BY 1",
    "doi_extraction": f"SELECT chunk_id, doi FROM (SELECT chunk_id, regexp_replace(regexp_extract(contents, '\\b(10\\.\\d{{4,9}}/[^\\s\"<>]+)', 1), '[.,;:)\\]}}]+$', '') AS doi FROM {c.CHUNKS_SQL}) WHERE doi <> ''",
    "title_checks": "SELECT doc_id, coalesce(length(trim(title)) <= 500 AND length(regexp_replace(trim(title), '[^\\p{L}]', '', 'g')) >= 3 AND NOT regexp_matches(trim(title), '(?i)^(?:doi:|10\\.\\d{4,9}/|https?://|www\\.|untitled\\b|microsoft word)|\\.(?:pdf|epub|mobi|docx?|indd|qxd)$'), false) AS valid, CASE WHEN regexp_extract(title, '(?:^|[^0-9])((?:18|19|20|21)[0-9]{2})(?:[^0-9]|$)', 1) <> '' THEN regexp_extract(title, '(?:^|[^0-9])((?:18|19|20|21)[0-9]{2})(?:[^0-9]|$)', 1)::INT END AS year FROM documents",
    "chunk_headers": f"SELECT k.chunk_id, CASE WHEN lower(t) = lower(s) THEN t ELSE concat_ws(' — ', t, s) END AS header FROM (SELECT DISTINCT chunk_id, document_id, nullif(trim(locator.section_title), '') AS s FROM chunks) k LEFT JOIN (SELECT document_id, nullif(trim(title), '') AS t FROM {c.DOCUMENTS_SQL}) d USING (document_id)",
    "chunk_windows": f"SELECT unit_id, \"window\", sha256(contents) AS contents_sha256, length(contents) AS characters FROM {_WINDOWS} WHERE contents <> ''",
    "chunk_ids_sha256": f"SELECT 'chk_' || left(sha256(unit_id || chr(0) || \"window\" || chr(0) || w.contents), 24) AS chunk_id, unit_id, row_number() OVER (PARTITION BY document_id ORDER BY unit_ordinal, unit_id, \"window\") - 1 AS document_chunk_index FROM {_WINDOWS} w JOIN {_U} u USING (unit_id) WHERE regexp_matches(w.contents, '[\\p{{L}}\\p{{N}}]')",
    "chunk_census": f"SELECT coalesce(content_kind, 'unknown') AS kind, count(*) AS chunks, count(*) FILTER (WHERE coalesce(health_flags, 0) & 3 <> 0) AS withheld, count(embedding_token_count) AS audited, count(*) FILTER (WHERE dense_truncated) AS truncated, max(embedding_token_count) AS most_tokens FROM {c.CHUNKS_SQL} GROUP BY 1",
}
