"""Statistics of recorded searches and of the corpus."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.operators.ranks import order_statistics

RECENT = 1000
TRACKED_RANKS = 5


def search_totals(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count(F.lit(1)).alias("searches"), F.count_if(F.col("result_count") == 0).alias("without_results"), F.round(F.avg("result_count"), 2).alias("mean_results"), F.min("searched_at").alias("first_at"), F.max("searched_at").alias("last_at"))


def recent_latency(log: DataFrame, recent: int = RECENT) -> DataFrame:
    """Median (interpolated, one decimal) and p95 of the ``recent`` latest searches.

    p95 is the value at index round(0.95 (n - 1)), half to even.  The latest are taken by a top-k, not a
    full sort, and are then few.
    """
    latest = log.where("elapsed_ms IS NOT NULL AND searched_at IS NOT NULL").orderBy(F.col("searched_at").desc(), F.col("search_id").desc()).limit(recent)
    sorted_ = latest.agg(F.array_sort(F.collect_list("elapsed_ms")).alias("v"))  # at most ``recent`` values
    n = F.size("v")
    at = F.bround(F.lit(0.95) * (n - 1), 0).cast("int")
    median = (F.element_at("v", F.floor((n + 1) / 2).cast("int")) + F.element_at("v", F.ceil((n + 1) / 2).cast("int"))) / 2
    return sorted_.select(n.cast("long").alias("n"), F.when(n > 0, F.round(median, 1)).alias("median_ms"), F.when(n > 0, F.round(F.element_at("v", at + 1), 1)).alias("p95_ms"))


def per_day(log: DataFrame) -> DataFrame:
    return log.where("searched_at IS NOT NULL").groupBy(F.date_format("searched_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("searches"))


def leaderboard(appearances: DataFrame, key: str) -> DataFrame:
    """How often each key came out in the first five and first, in order: top_five, rank_one, key."""
    board = appearances.where(F.col("rank") <= TRACKED_RANKS).groupBy(key).agg(F.count(F.lit(1)).alias("top_five"), F.count_if(F.col("rank") == 1).alias("rank_one"), F.min("source_id").alias("a_source"))
    return board.orderBy(F.col("top_five").desc(), F.col("rank_one").desc(), key)


def caller_class(caller: Column) -> Column:
    """workspace, command line, synthesise, agent or unknown."""
    c = F.lower(F.trim(caller))
    return F.when(c.isNull() | (c == ""), "unknown").when(c.isin("workspace", "command line", "synthesise", "agent"), c).otherwise("agent")


def usage_series(log: DataFrame) -> DataFrame:
    """``(bucket, grain, searches)`` over the whole span, quiet buckets with 0.

    Days up to a span of 60 days, weeks from Monday up to 420, months beyond.  The span is one row; the
    series is generated from it and joined with the counts.
    """
    at = log.where("searched_at IS NOT NULL").select(F.to_date("searched_at").alias("day"))
    span = at.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).where("lo IS NOT NULL").withColumn("days", F.datediff("hi", "lo"))
    grain = F.when(F.col("days") <= 60, "day").when(F.col("days") <= 420, "week").otherwise("month")
    span = span.withColumn("grain", grain)
    start = _bucket(F.col("lo"), F.col("grain"))
    days = F.when(F.col("grain") == "month", F.sequence(start, F.col("hi"), F.expr("INTERVAL 1 MONTH"))).when(F.col("grain") == "week", F.sequence(start, F.col("hi"), F.expr("INTERVAL 7 DAY"))).otherwise(F.sequence(start, F.col("hi"), F.expr("INTERVAL 1 DAY")))
    series = span.select("grain", F.explode(days).alias("bucket"))
    counted = at.groupBy("day").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(span.select("grain")), how="cross").groupBy(_bucket(F.col("day"), F.col("grain")).alias("bucket")).agg(F.sum("n").alias("searches"))
    return series.join(counted, "bucket", "left").select("bucket", "grain", F.coalesce("searches", F.lit(0)).alias("searches"))


def _bucket(day: Column, grain: Column) -> Column:
    return F.when(grain == "day", day).when(grain == "week", F.trunc(day, "week")).otherwise(F.trunc(day, "month"))


def nearest_rank(rows: DataFrame, group: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles ``sorted[ceil(q n) - 1]`` per group, whatever share of the rows a group has; no row for a group without values."""
    places = {name: lambda n, q=q: F.greatest(F.ceil(F.lit(q) * n), F.lit(1)) for name, q in quantiles.items()}
    return order_statistics(rows, group, value, places)


def decade(year: Column) -> Column:
    return F.when(year.isNull() | (year <= 0), "no year").otherwise(F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s")))
