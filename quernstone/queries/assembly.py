"""Assembled hits, lookups by id, converter payloads and scripts over the tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import hooks
from quernstone.functions import quality as q
from quernstone.operators import fusion, screening
from quernstone.queries import common as c
from quernstone.queries import search as s
from quernstone.sources import read_table


def place(locator: str) -> Column:
    """``p. 5`` by the label a page has or else its number, ``section Y`` for a section, empty without a locator."""
    page = F.coalesce(F.nullif(F.trim(f"{locator}.page_label"), F.lit("")), F.col(f"{locator}.page_no").cast("string"))
    section = F.nullif(F.trim(f"{locator}.section_title"), F.lit(""))
    return F.concat_ws(" / ", F.concat(F.lit("p. "), page), F.concat(F.lit("section "), section))


def q_hits(spark: SparkSession, d: str) -> DataFrame:
    """The answers in full: ranks and scores of each half, the fusion, and a citation down to the page or section."""
    fused = s._fused(spark, d).join(c.chunks(spark, d, "source_id", "document_id", "locator"), "chunk_id")
    top = fusion.source_diverse(fused, s.TOP_K)
    scores = {n: s._component(spark, d, n).select("query_id", "chunk_id", F.round("score", 6).alias(f"{n}_score")) for n in ("bm25", "dense")}
    full = top.join(scores["bm25"], ["query_id", "chunk_id"], "left").join(scores["dense"], ["query_id", "chunk_id"], "left")
    full = full.join(c.documents(spark, d, "title", "authors", "pub_year", "doi"), "document_id", "left")
    cited = F.concat_ws(", ", s.citation(), F.concat(F.lit("doi:"), F.nullif(F.trim("doi"), F.lit(""))), F.nullif(place("locator"), F.lit("")))
    return full.select("query_id", F.col("selected_rank").alias("rank"), F.col("position").alias("retrieval_rank"), "chunk_id", "match_kind", "bm25_rank", "dense_rank", "bm25_score", F.when(F.col("dense_rank").isNotNull(), F.col("dense_score")).alias("dense_score"), F.round("fusion_score", 6).alias("fusion_score"), cited.alias("citation"))


def q_chunks_by_ids(spark: SparkSession, d: str) -> DataFrame:
    """Point lookups by id: the chunks that were served first, with their places in their documents."""
    wanted = c.appearances(spark, d).where("rank = 1").select("chunk_id").distinct()
    return c.chunks(spark, d, "document_id", "document_chunk_index", "content_kind").join(wanted, "chunk_id", "left_semi")


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """Units with pages as the payload a converter would give: blocks by page, in order, and the labels."""
    units = read_table(spark, d, "units").where("document_id IS NOT NULL AND locator.page_no IS NOT NULL").select("document_id", "unit_id", "unit_ordinal", "contents", "content_kind", F.col("locator.page_no").cast("string").alias("page"), "locator.page_label").distinct()
    pages = units.groupBy("document_id", "page").agg(F.array_sort(F.collect_list(F.struct("unit_ordinal", "unit_id", "contents", "content_kind"))).alias("u"), F.min("page_label").alias("label"))  # the blocks of one page
    pages = pages.withColumn("blocks", F.transform("u", lambda x: F.struct(x["contents"].alias("contents"), x["content_kind"].alias("content_kind"))))
    whole = pages.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("page", "blocks"))).alias("pages"), F.map_from_entries(F.collect_list(F.struct("page", "label"))).alias("page_labels"))  # the pages of one document
    return whole.select("document_id", F.to_json(F.struct("pages", "page_labels")).alias("payload"))


def q_page_units(spark: SparkSession, d: str) -> DataFrame:
    units = screening.page_units(_payloads(spark, d))
    return units.select("document_id", "page_no", "page_label", "block", "content_kind", F.sha2("contents", 256).alias("contents_sha256"))


def q_blank_pages(spark: SparkSession, d: str) -> DataFrame:
    return screening.blank_pages(screening.page_units(_payloads(spark, d)))


def q_mixed_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Letters of each family of scripts over all documents, and in how many documents; mixed ones counted beside."""
    rows = read_table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text", q.mixed_scripts(F.col("text")).alias("mixed"))
    counted = rows.select("mixed", F.explode(F.array(*[F.struct(F.lit(x).alias("script"), F.regexp_count("text", F.lit(rf"\p{{Is{x}}}")).alias("n")) for x in q.SCRIPTS])).alias("s"))
    return counted.where("s.n > 0").groupBy("s.script").agg(F.sum("s.n").alias("letters"), F.count(F.lit(1)).alias("documents"), F.count_if("mixed").alias("mixed_documents"))


def q_token_windows(spark: SparkSession, d: str) -> DataFrame:
    """Every unit in windows of 384 byte-pair tokens that share 64; the vocabulary file is a setting."""
    path = spark.conf.get("quernstone.tokenizer", "/opt/tokenizers/byte_bpe_50k.tiktoken")
    windows = hooks.token_windows(c.units(spark, d, "contents"), path, 384, 64)
    return windows.select("unit_id", "window", F.length("contents").alias("characters"), hooks.BytePairTokenizer(path).count(F.col("contents")).alias("tokens"))


_COUNT = ", ".join(f"{{'script': '{x}', 'n': len(regexp_extract_all(text, '\\p{{{x}}}'))}}" for x in q.SCRIPTS)
_UNITS = """(SELECT *, row_number() OVER (PARTITION BY document_id, page_no ORDER BY unit_ordinal, unit_id) - 1 AS block, min(page_label_) OVER (PARTITION BY document_id, page_no) AS page_label FROM (
SELECT DISTINCT document_id, unit_id, unit_ordinal, trim(regexp_replace(coalesce(contents, ''), '\\s+', ' ', 'g')) AS t, coalesce(content_kind, 'prose') AS content_kind, locator.page_no AS page_no, locator.page_label AS page_label_ FROM units WHERE document_id IS NOT NULL AND locator.page_no IS NOT NULL) WHERE t <> '')"""

QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
ORACLES = {
    "hits": s._GATE + f""", sc AS (SELECT search_id AS query_id, chunk_id, component, score FROM h), k AS (SELECT DISTINCT chunk_id, document_id, locator.page_no AS page_no, nullif(trim(locator.page_label), '') AS label, nullif(trim(locator.section_title), '') AS section FROM chunks), d AS {c.DOCUMENTS_SQL}
SELECT v.query_id, selected_rank AS rank, position AS retrieval_rank, v.chunk_id, match_kind, bm25_rank, dense_rank, round(b.score, 6) AS bm25_score, CASE WHEN dense_rank IS NOT NULL THEN round(e.score, 6) END AS dense_score, round(fusion_score, 6) AS fusion_score,
  concat_ws(', ', {s._CITED}, 'doi:' || nullif(trim(doi), ''), nullif(concat_ws(' / ', 'p. ' || coalesce(label, page_no::VARCHAR), 'section ' || section), '')) AS citation
FROM diverse v JOIN k USING (chunk_id) LEFT JOIN sc b ON b.query_id = v.query_id AND b.chunk_id = v.chunk_id AND b.component = 'bm25' LEFT JOIN sc e ON e.query_id = v.query_id AND e.chunk_id = v.chunk_id AND e.component = 'dense' LEFT JOIN d ON d.document_id = k.document_id WHERE selected_rank <= 10""",
    "chunks_by_ids": f"SELECT chunk_id, document_id, document_chunk_index, content_kind FROM {c.CHUNKS_SQL} WHERE chunk_id IN (SELECT chunk_id FROM appearances WHERE rank = 1)",
    "page_units": f"SELECT document_id, page_no, page_label, block, content_kind, sha256(t) AS contents_sha256 FROM {_UNITS}",
    "blank_pages": f"SELECT document_id, min(page_no) AS first_page, max(page_no) AS last_page, count(DISTINCT page_no) AS pages, max(page_no) - min(page_no) + 1 - count(DISTINCT page_no) AS blank FROM {_UNITS} GROUP BY 1",
    "mixed_scripts": f"""WITH x AS (SELECT doc_id, list_filter([{_COUNT}], lambda x: x.n > 0) AS l FROM documents WHERE text IS NOT NULL), y AS (SELECT *, len(l) >= 4 AND list_max(list_transform(l, lambda x: x.n)) < 0.7 * list_sum(list_transform(l, lambda x: x.n)) AS mixed FROM x), z AS (SELECT unnest(l) AS s, coalesce(mixed, false) AS mixed FROM y)
SELECT s.script AS script, sum(s.n)::BIGINT AS letters, count(*) AS documents, count(*) FILTER (mixed) AS mixed_documents FROM z GROUP BY 1""",
}
