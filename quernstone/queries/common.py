"""Tables as the queries use them: repeated rows once, and the same as SQL for DuckDB."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.sources import read_table

CHUNK_COLUMNS = ["chunk_id", "document_id", "source_id", "unit_id", "document_chunk_index", "contents", "content_kind", "content_sha256", "health_flags", "embedding_token_count", "dense_truncated"]
DOCUMENT_COLUMNS = ["document_id", "source_id", "source_relative_path", "file_format", "sha256", "size_bytes", "modified_at", "title", "authors", "pub_year", "doi", "languages", "keywords", "embedding_model"]


def chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Chunks once each; repeated rows are exact copies, so a hash aggregate over the columns asked for removes them."""
    return read_table(spark, d, "chunks").select("chunk_id", *[c for c in columns if c != "chunk_id"]).distinct()


def documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return read_table(spark, d, "source_documents").select("document_id", *[c for c in columns if c != "document_id"]).distinct()


def units(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return read_table(spark, d, "units").select("unit_id", *[c for c in columns if c != "unit_id"]).distinct()


def searches(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "search_log").distinct()


def appearances(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "appearances").distinct()


def hits(spark: SparkSession, d: str, *components: str) -> DataFrame:
    h = read_table(spark, d, "component_hits").where("score IS NOT NULL")
    return (h.where(F.col("component").isin(*components)) if components else h).distinct()


def text_queries(spark: SparkSession, d: str) -> DataFrame:
    """``(query_id, query)``: every recorded search with a query text."""
    return searches(spark, d).where("query_text IS NOT NULL").select(F.col("search_id").alias("query_id"), F.col("query_text").alias("query"))


CHUNKS_SQL = "(SELECT DISTINCT " + ", ".join(CHUNK_COLUMNS) + " FROM chunks)"
DOCUMENTS_SQL = "(SELECT DISTINCT " + ", ".join(DOCUMENT_COLUMNS) + " FROM source_documents)"
SEARCHES_SQL = "(SELECT DISTINCT * FROM search_log)"
HITS_SQL = "(SELECT DISTINCT * FROM component_hits WHERE score IS NOT NULL)"
QUERIES_SQL = f"(SELECT search_id AS query_id, query_text AS query FROM {SEARCHES_SQL} WHERE query_text IS NOT NULL)"
