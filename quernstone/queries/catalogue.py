"""Filters, lookups, windows, overlays, inventories and usage over the tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators import catalogue as k
from quernstone.operators import usage as u
from quernstone.queries import common as c
from quernstone.sources import read_table


def q_filter_any_of(spark: SparkSession, d: str) -> DataFrame:
    return c.documents(spark, d, "languages").where(k.any_of(F.col("languages"), ["FR", " es"])).select("document_id")


def q_filter_all_of(spark: SparkSession, d: str) -> DataFrame:
    return c.documents(spark, d, "keywords").where(k.all_of(F.col("keywords"), ["Meadow"])).select("document_id")


def q_filter_substring(spark: SparkSession, d: str) -> DataFrame:
    docs = c.documents(spark, d, "authors", "title")
    return docs.where(k.contains_any(F.col("authors"), ["kr", "vel"]) & k.contains_any(F.array("title"), ["the", "und"])).select("document_id")


def _top_sources(spark: SparkSession, d: str) -> DataFrame:
    return u.leaderboard(c.appearances(spark, d).where("source_id IS NOT NULL"), "source_id").limit(10)


def q_filter_include_exclude(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the ten most served sources without those of documents in French."""
    french = c.documents(spark, d, "languages").where(F.array_contains("languages", "fr")).select("document_id")
    rows = k.included(c.chunks(spark, d, "source_id", "document_id"), "source_id", _top_sources(spark, d), None)
    return k.included(rows, "document_id", None, french).select("chunk_id")


def q_filter_unknown_ids(spark: SparkSession, d: str) -> DataFrame:
    """What is asked for as source ids and is none: the ids of served sources, and of the documents they were served from."""
    served = c.chunks(spark, d, "document_id").join(c.appearances(spark, d).select("chunk_id").distinct(), "chunk_id", "left_semi").select(F.col("document_id").alias("source_id"))
    return k.unknown_ids(c.appearances(spark, d).select("source_id").union(served), c.documents(spark, d, "source_id"), "source_id")


def q_metadata_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Reviewed metadata of documents whose id ends in 0: no authors, presence-aware, and a reviewed title for those ending in 10."""
    docs = c.documents(spark, d, "title", "authors", "pub_year")
    reviewed = docs.where(F.col("document_id").endswith("0")).select("document_id", F.lit("Reviewed").alias("title"), F.array().cast("array<string>").alias("authors"), F.when(F.col("document_id").endswith("10"), F.array(F.lit("title"), F.lit("authors"))).otherwise(F.array(F.lit("authors"))).alias("present"))
    out = k.overlaid(docs, reviewed, "document_id", ["title", "authors"])
    return out.select("document_id", "title", F.array_join("authors", ";").alias("authors"), F.array_join("overridden", ",").alias("overridden"))


def q_value_inventory(spark: SparkSession, d: str) -> DataFrame:
    return k.value_inventory(c.documents(spark, d, "keywords"), "document_id", "keywords")


def q_staleness_diff(spark: SparkSession, d: str) -> DataFrame:
    """The latest version of each source file against the first one recorded, over all sources.

    Both sides come from one table, so every source is on both and the rows are modifications.
    """
    docs = read_table(spark, d, "source_documents").select("source_id", "document_id", "size_bytes", "modified_at", "sha256").where("source_id IS NOT NULL").dropDuplicates(["document_id"])
    now = k.latest_versions(docs, "source_id", ["modified_at", "document_id"])
    before = docs.groupBy("source_id").agg(F.min_by(F.struct("size_bytes", "modified_at", "sha256"), F.struct("modified_at", "document_id")).alias("s")).select("source_id", "s.*")
    return k.staleness(now, before, "source_id")


def q_find_source(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose path, title or authors hold the phrase, the first fifty by path."""
    docs = c.documents(spark, d, "source_relative_path", "title", "authors")
    text = F.lower(F.concat_ws("\n", "source_relative_path", "title", F.array_join(F.coalesce("authors", F.array().cast("array<string>")), "\n")))
    return docs.where(text.contains("harbour")).orderBy("source_relative_path", "document_id").limit(50).select("document_id", "source_relative_path")


def q_known_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources known from documents, else from units, else from served results."""
    parts = [c.documents(spark, d, "source_id").select("source_id").distinct(), read_table(spark, d, "units").select("source_id").distinct(), c.appearances(spark, d).select("source_id").distinct()]
    return k.with_precedence([p.where("source_id IS NOT NULL") for p in parts], "source_id")


def q_passage_window(spark: SparkSession, d: str) -> DataFrame:
    """Two readable neighbours on either side of every chunk that was served first."""
    targets = c.appearances(spark, d).where("rank = 1").select("chunk_id")
    return k.passage_window(c.chunks(spark, d, "document_id", "document_chunk_index", "health_flags"), targets, 2)


def q_document_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of twenty chunks of the document with the most chunks, with previews and served counts."""
    rows = c.chunks(spark, d, "document_id", "document_chunk_index", "contents")
    largest, total = rows.groupBy("document_id").count().orderBy(F.col("count").desc(), "document_id").first()
    served = c.appearances(spark, d).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("served"))
    page = k.page(rows.where(F.col("document_id") == largest), ["document_chunk_index"], 2, 20, total)
    return page.join(served, "chunk_id", "left").select("chunk_id", "document_chunk_index", F.substring("contents", 1, 420).alias("preview"), F.coalesce("served", F.lit(0)).alias("served"))


def q_chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = c.chunks(spark, d, "document_id", "contents", "health_flags")
    return rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.octet_length("contents")).alias("text_bytes"), F.count_if(F.coalesce("health_flags", F.lit(0)).bitwiseAND(4) != 0).alias("apparatus"))


def q_chunks_by_contents(spark: SparkSession, d: str) -> DataFrame:
    """Point lookups by digest: chunks whose text equals that of a unit."""
    texts = c.units(spark, d, "contents").where("contents IS NOT NULL").select(F.sha2("contents", 256).alias("digest")).distinct()
    return c.chunks(spark, d, "contents").withColumn("digest", F.sha2("contents", 256)).join(texts, "digest", "left_semi").select("chunk_id", "digest")


def q_search_totals(spark: SparkSession, d: str) -> DataFrame:
    return u.search_totals(c.searches(spark, d)).withColumn("first_at", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss")).withColumn("last_at", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss"))


def q_latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return u.recent_latency(c.searches(spark, d))


def q_searches_by_day(spark: SparkSession, d: str) -> DataFrame:
    return u.per_day(c.searches(spark, d))


def q_leaderboard_sources(spark: SparkSession, d: str) -> DataFrame:
    return u.leaderboard(c.appearances(spark, d).where("source_id IS NOT NULL"), "source_id").select("source_id", "top_five", "rank_one")


def q_leaderboard_passages(spark: SparkSession, d: str) -> DataFrame:
    return u.leaderboard(c.appearances(spark, d).where("chunk_id IS NOT NULL"), "chunk_id").limit(100)


def q_unreached_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources that no search of the last thirty days of the log served."""
    log = c.searches(spark, d).where("searched_at IS NOT NULL").select("search_id", "searched_at")
    recent = log.join(F.broadcast(log.agg(F.max("searched_at").alias("last"))), how="cross").where("searched_at > last - INTERVAL 30 DAYS").select("search_id")  # one row
    reached = c.appearances(spark, d).join(recent, "search_id", "left_semi").select("source_id").distinct()
    return c.documents(spark, d, "source_id").select("source_id").where("source_id IS NOT NULL").distinct().join(reached, "source_id", "left_anti")


def q_search_history(spark: SparkSession, d: str) -> DataFrame:
    """The latest two hundred searches with a query."""
    log = c.searches(spark, d).where("query_text IS NOT NULL AND searched_at IS NOT NULL").orderBy(F.col("searched_at").desc(), F.col("search_id").desc()).limit(200)
    return log.select("search_id", "query_text", F.get_json_object("filters", "$.languages_any[0]").alias("language"), u.caller_class(F.col("caller")).alias("caller"))


def q_caller_classes(spark: SparkSession, d: str) -> DataFrame:
    return c.searches(spark, d).groupBy(u.caller_class(F.col("caller")).alias("caller")).agg(F.count(F.lit(1)).alias("searches"), F.round(F.avg("elapsed_ms"), 3).alias("mean_ms"))


def q_usage_buckets(spark: SparkSession, d: str) -> DataFrame:
    return u.usage_series(c.searches(spark, d)).withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


def q_generation_latency(spark: SparkSession, d: str) -> DataFrame:
    return u.nearest_rank(c.searches(spark, d).where("generation_id IS NOT NULL"), ["generation_id"], "elapsed_ms", {"p50": 0.5, "p95": 0.95})


def q_corpus_facts(spark: SparkSession, d: str) -> DataFrame:
    """Documents by format, language, decade and keyword, one row per fact and value."""
    docs = c.documents(spark, d, "file_format", "languages", "pub_year", "keywords")
    one = docs.select(F.explode(F.array(F.struct(F.lit("format").alias("fact"), F.lower("file_format").alias("value")), F.struct(F.lit("decade").alias("fact"), u.decade(F.col("pub_year")).alias("value")))).alias("x")).select("x.*")
    many = docs.select(F.explode(F.when(F.coalesce(F.size("languages"), F.lit(0)) > 0, F.col("languages")).otherwise(F.array(F.lit("unknown")))).alias("value")).select(F.lit("language").alias("fact"), "value")
    return one.unionByName(many).groupBy("fact", "value").agg(F.count(F.lit(1)).alias("documents"))


def q_passages_per_document(spark: SparkSession, d: str) -> DataFrame:
    n = c.chunks(spark, d, "document_id").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.min("n").alias("least"), F.round(F.expr("percentile(n, 0.5)"), 3).alias("median"), F.max("n").alias("most"), F.sum("n").alias("passages"))


def q_missing_metadata(spark: SparkSession, d: str) -> DataFrame:
    docs = c.documents(spark, d, "title", "authors", "pub_year", "languages", "doi")
    return docs.agg(F.count_if(F.col("title").isNull() | (F.col("title") == "")).alias("title"), F.count_if(F.coalesce(F.size("authors"), F.lit(0)) <= 0).alias("authors"), F.count_if(F.col("pub_year").isNull() | (F.col("pub_year") <= 0)).alias("year"), F.count_if(F.coalesce(F.size("languages"), F.lit(0)) <= 0).alias("languages"), F.count_if(F.col("doi").isNull()).alias("doi"))


def q_late_rows(spark: SparkSession, d: str) -> DataFrame:
    """Searches recorded more than a day after they ran, by caller."""
    log = c.searches(spark, d).where("searched_at IS NOT NULL AND recorded_at IS NOT NULL")
    late = F.col("recorded_at").cast("double") - F.col("searched_at").cast("double") > 86400
    return log.groupBy(u.caller_class(F.col("caller")).alias("caller")).agg(F.count_if(late).alias("late"), F.count(F.lit(1)).alias("searches"))


_CALLER = "CASE WHEN caller IS NULL OR trim(caller) = '' THEN 'unknown' WHEN lower(trim(caller)) IN ('workspace', 'command line', 'synthesise', 'agent') THEN lower(trim(caller)) ELSE 'agent' END"
_D, _C, _S = c.DOCUMENTS_SQL, c.CHUNKS_SQL, c.SEARCHES_SQL
_A = "(SELECT DISTINCT * FROM appearances)"
_BOARD = f"SELECT source_id, count(*) AS top_five, count(*) FILTER (WHERE rank = 1) AS rank_one FROM {_A} WHERE source_id IS NOT NULL AND rank <= 5 GROUP BY 1"

QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}
ORACLES = {
    "filter_any_of": f"SELECT document_id FROM {_D} WHERE list_has_any(list_transform(languages, lambda x: lower(trim(x))), ['fr', 'es'])",
    "filter_all_of": f"SELECT document_id FROM {_D} WHERE list_contains(list_transform(keywords, lambda x: lower(trim(x))), 'meadow')",
    "filter_substring": f"SELECT document_id FROM {_D} WHERE len(list_filter(authors, lambda x: contains(lower(x), 'kr') OR contains(lower(x), 'vel'))) > 0 AND (contains(lower(title), 'the') OR contains(lower(title), 'und'))",
    "filter_include_exclude": f"SELECT chunk_id FROM {_C} WHERE source_id IN (SELECT source_id FROM ({_BOARD}) ORDER BY top_five DESC, rank_one DESC, source_id LIMIT 10) AND document_id NOT IN (SELECT document_id FROM {_D} WHERE list_contains(languages, 'fr'))",
    "filter_unknown_ids": f"SELECT DISTINCT source_id FROM (SELECT source_id FROM {_A} UNION ALL SELECT document_id FROM {_C} WHERE chunk_id IN (SELECT chunk_id FROM appearances)) WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT source_id FROM source_documents WHERE source_id IS NOT NULL)",
    "metadata_overlay": f"SELECT document_id, CASE WHEN document_id LIKE '%10' THEN 'Reviewed' ELSE title END AS title, CASE WHEN document_id LIKE '%0' THEN '' ELSE array_to_string(authors, ';') END AS authors, CASE WHEN document_id LIKE '%10' THEN 'title,authors' WHEN document_id LIKE '%0' THEN 'authors' ELSE '' END AS overridden FROM {_D}",
    "value_inventory": f"SELECT value, arg_min(trim(shown), (document_id, pos)) AS display, count(DISTINCT document_id) AS documents FROM (SELECT document_id, unnest(keywords) AS shown, generate_subscripts(keywords, 1) - 1 AS pos, lower(trim(unnest(keywords))) AS value FROM {_D}) WHERE value <> '' GROUP BY value",
    "staleness_diff": f"""WITH d AS (SELECT DISTINCT source_id, document_id, size_bytes, modified_at, sha256 FROM source_documents WHERE source_id IS NOT NULL),
now_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY modified_at DESC NULLS LAST, document_id DESC) AS r FROM d) WHERE r = 1),
old_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY modified_at ASC NULLS FIRST, document_id) AS r FROM d) WHERE r = 1),
b AS (SELECT coalesce(n.source_id, o.source_id) AS source_id, CASE WHEN o.source_id IS NULL THEN 'added' WHEN n.source_id IS NULL THEN 'removed'
  WHEN n.size_bytes <> o.size_bytes OR (n.modified_at IS DISTINCT FROM o.modified_at AND n.sha256 IS DISTINCT FROM o.sha256) THEN 'modified' END AS change FROM now_ n FULL JOIN old_ o ON n.source_id = o.source_id)
SELECT * FROM b WHERE change IS NOT NULL""",
    "find_source": f"SELECT document_id, source_relative_path FROM {_D} WHERE contains(lower(concat_ws(chr(10), source_relative_path, title, array_to_string(coalesce(authors, []), chr(10)))), 'harbour') ORDER BY source_relative_path, document_id LIMIT 50",
    "known_sources": f"SELECT source_id, min(origin) AS origin FROM (SELECT source_id, 0 AS origin FROM source_documents UNION ALL SELECT source_id, 1 FROM units UNION ALL SELECT source_id, 2 FROM appearances) WHERE source_id IS NOT NULL GROUP BY 1",
    "passage_window": f"""WITH p AS (SELECT chunk_id, document_id, document_chunk_index, row_number() OVER (PARTITION BY document_id ORDER BY document_chunk_index) AS place FROM {_C} WHERE coalesce(health_flags, 0) & 3 = 0 AND document_id IS NOT NULL AND document_chunk_index IS NOT NULL)
SELECT t.chunk_id AS target_id, n.chunk_id, n.document_chunk_index, n.place - t.place AS "offset" FROM p t JOIN p n ON t.document_id = n.document_id AND n.place BETWEEN t.place - 2 AND t.place + 2 WHERE t.chunk_id IN (SELECT chunk_id FROM appearances WHERE rank = 1)""",
    "document_page": f"""WITH c AS {_C}, big AS (SELECT document_id FROM c GROUP BY 1 ORDER BY count(*) DESC, document_id LIMIT 1),
own AS (SELECT *, row_number() OVER (ORDER BY document_chunk_index) AS r, count(*) OVER () AS total FROM c WHERE document_id IN (SELECT document_id FROM big))
SELECT o.chunk_id, document_chunk_index, left(contents, 420) AS preview, coalesce(n, 0) AS served FROM own o LEFT JOIN (SELECT chunk_id, count(*) AS n FROM {_A} GROUP BY 1) a USING (chunk_id)
WHERE r > (least(2, ceil(total / 20.0)) - 1) * 20 AND r <= least(2, ceil(total / 20.0)) * 20""",
    "chunk_counts": f"SELECT document_id, count(*) AS chunks, sum(strlen(contents)) AS text_bytes, count(*) FILTER (WHERE coalesce(health_flags, 0) & 4 <> 0) AS apparatus FROM {_C} GROUP BY 1",
    "chunks_by_contents": f"SELECT chunk_id, sha256(contents) AS digest FROM {_C} WHERE contents IN (SELECT contents FROM units WHERE contents IS NOT NULL)",
    "search_totals": f"SELECT count(*) AS searches, count(*) FILTER (WHERE result_count = 0) AS without_results, round(avg(result_count), 2) AS mean_results, strftime(min(searched_at), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(searched_at), '%Y-%m-%d %H:%M:%S') AS last_at FROM {_S}",
    "latency_percentiles": f"""WITH v AS (SELECT elapsed_ms FROM {_S} WHERE elapsed_ms IS NOT NULL AND searched_at IS NOT NULL ORDER BY searched_at DESC, search_id DESC LIMIT 1000),
r AS (SELECT elapsed_ms, row_number() OVER (ORDER BY elapsed_ms) AS r, count(*) OVER () AS n FROM v)
SELECT any_value(n) AS n, round(median(elapsed_ms), 1) AS median_ms, round(max(elapsed_ms) FILTER (WHERE r = round_even(0.95 * (n - 1), 0) + 1), 1) AS p95_ms FROM r""",
    "searches_by_day": f"SELECT strftime(searched_at, '%Y-%m-%d') AS day, count(*) AS searches FROM {_S} WHERE searched_at IS NOT NULL GROUP BY 1",
    "leaderboard_sources": _BOARD,
    "leaderboard_passages": f"SELECT chunk_id, count(*) AS top_five, count(*) FILTER (WHERE rank = 1) AS rank_one, min(source_id) AS a_source FROM {_A} WHERE chunk_id IS NOT NULL AND rank <= 5 GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 100",
    "unreached_sources": f"SELECT DISTINCT source_id FROM source_documents WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT source_id FROM appearances WHERE source_id IS NOT NULL AND search_id IN (SELECT search_id FROM {_S} WHERE searched_at > (SELECT max(searched_at) FROM search_log) - INTERVAL 30 DAY))",
    "search_history": f"SELECT search_id, query_text, filters::JSON ->> '$.languages_any[0]' AS language, {_CALLER} AS caller FROM {_S} WHERE query_text IS NOT NULL AND searched_at IS NOT NULL ORDER BY searched_at DESC, search_id DESC LIMIT 200",
    "caller_classes": f"SELECT {_CALLER} AS caller, count(*) AS searches, round(avg(elapsed_ms), 3) AS mean_ms FROM {_S} GROUP BY 1",
    "usage_buckets": f"""WITH s AS (SELECT searched_at::DATE AS day FROM {_S} WHERE searched_at IS NOT NULL), span AS (SELECT min(day) AS lo, max(day) AS hi, max(day) - min(day) AS days FROM s),
g AS (SELECT *, CASE WHEN days <= 60 THEN 'day' WHEN days <= 420 THEN 'week' ELSE 'month' END AS grain FROM span),
series AS (SELECT grain, unnest(generate_series(date_trunc(grain, lo)::TIMESTAMP, hi::TIMESTAMP, CASE grain WHEN 'day' THEN INTERVAL 1 DAY WHEN 'week' THEN INTERVAL 7 DAY ELSE INTERVAL 1 MONTH END))::DATE AS bucket FROM g)
SELECT strftime(bucket, '%Y-%m-%d') AS bucket, any_value(series.grain) AS grain, count(day) AS searches FROM series LEFT JOIN (SELECT day, date_trunc(grain, day)::DATE AS b FROM s, g) x ON x.b = bucket GROUP BY bucket""",
    "generation_latency": f"""WITH r AS (SELECT generation_id, elapsed_ms, row_number() OVER (PARTITION BY generation_id ORDER BY elapsed_ms) AS r, count(*) OVER (PARTITION BY generation_id) AS n FROM {_S} WHERE generation_id IS NOT NULL AND elapsed_ms IS NOT NULL)
SELECT generation_id, any_value(n) AS n, max(elapsed_ms) FILTER (WHERE r = greatest(ceil(0.5 * n), 1)) AS p50, max(elapsed_ms) FILTER (WHERE r = greatest(ceil(0.95 * n), 1)) AS p95 FROM r GROUP BY 1""",
    "corpus_facts": f"""SELECT fact, value, count(*) AS documents FROM (
SELECT 'format' AS fact, lower(file_format) AS value FROM {_D} UNION ALL SELECT 'decade', CASE WHEN pub_year IS NULL OR pub_year <= 0 THEN 'no year' ELSE (pub_year // 10 * 10)::VARCHAR || 's' END FROM {_D}
UNION ALL SELECT 'language', unnest(CASE WHEN len(languages) > 0 THEN languages ELSE ['unknown'] END) FROM {_D}) GROUP BY 1, 2""",
    "passages_per_document": f"SELECT min(n) AS least, round(median(n), 3) AS median, max(n) AS most, sum(n) AS passages FROM (SELECT count(*) AS n FROM {_C} GROUP BY document_id)",
    "missing_metadata": f"SELECT count(*) FILTER (WHERE title IS NULL OR title = '') AS title, count(*) FILTER (WHERE coalesce(len(authors), 0) = 0) AS authors, count(*) FILTER (WHERE pub_year IS NULL OR pub_year <= 0) AS year, count(*) FILTER (WHERE coalesce(len(languages), 0) = 0) AS languages, count(*) FILTER (WHERE doi IS NULL) AS doi FROM {_D}",
    "late_rows": f"SELECT {_CALLER} AS caller, count(*) FILTER (WHERE epoch_us(recorded_at) - epoch_us(searched_at) > 86400000000) AS late, count(*) AS searches FROM {_S} WHERE searched_at IS NOT NULL AND recorded_at IS NOT NULL GROUP BY 1",
}
