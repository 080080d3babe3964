"""The search log as a stream: an extension of batch recording, with event time and late rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

TRACKED_RANKS = 5
SEARCH_SCHEMA = "search_id long, searched_at timestamp, recorded_at timestamp, generation_id string, requested_top_k int, result_count int, elapsed_ms double, query_text string, filters string, caller string"


def read_searches(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SEARCH_SCHEMA).parquet(folder)


def append_searches(searches: DataFrame, target: str, checkpoint: str, late: str = "7 days") -> StreamingQuery:
    """Appends each search once, though it be delivered again within the watermark."""
    once = searches.withWatermark("searched_at", late).dropDuplicatesWithinWatermark(["search_id"])
    return once.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(searches: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Searches and mean latency per window and caller, closed once the watermark has passed."""
    return searches.withWatermark("searched_at", late).groupBy(F.window("searched_at", window), F.coalesce("caller", F.lit("unknown")).alias("caller")).agg(F.count(F.lit(1)).alias("searches"), F.avg("elapsed_ms").alias("mean_ms"))


def record(search: DataFrame, ranked: DataFrame, folder: str) -> None:
    """The sink of one answer batch: search facts, and appearances of the first five ranks."""
    search.write.mode("append").parquet(f"{folder}/search_log.parquet")
    ranked.where(F.col("rank").between(1, TRACKED_RANKS)).select("search_id", "rank", "chunk_id", "source_id").write.mode("append").parquet(f"{folder}/appearances.parquet")
