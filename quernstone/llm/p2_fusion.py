"""Problem 2: one ranking from several differently scaled scores.

Each score becomes its empirical percentile among the candidates of its (search, component), ties
averaged; the percentile goes through the inverse normal distribution; a chunk's score is the
weighted mean over all components of the search.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quernstone.functions.mathx import inverse_normal, inverse_normal_sql
from quernstone.operators.ranks import averaged_percentiles
from quernstone.sources import read_table


def fuse_scores(hits: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``(search_id, chunk_id, fused, components, first_rank_bound)`` for each scored candidate.

    - Repeated rows count once; of several scores of one (search, component, chunk) the highest counts.
    - Null and NaN scores, and rows with a null search, component or chunk, are no evidence.
    - A candidate that a component has no score for stands at that component's middle (0), so that
      neither presence nor absence in one list outweighs the others.
    - Ties share a percentile; equal fused scores are left for the caller to break by chunk_id.
    - ``weights`` by component default to 1.  An empty table gives no rows.
    """
    clean = hits.select("search_id", "component", "chunk_id", F.col("score").cast("double").alias("score"))
    clean = clean.where("search_id IS NOT NULL AND component IS NOT NULL AND chunk_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    clean = clean.groupBy("search_id", "component", "chunk_id").agg(F.max("score").alias("score"))
    scored = averaged_percentiles(clean, ["search_id", "component"], "score", "percentile")
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("component") == name, F.lit(float(w))).otherwise(weight)
    scored = scored.withColumn("weight", weight).withColumn("normal", inverse_normal("percentile"))
    per_component = scored.groupBy("search_id", "component").agg(F.first("weight").alias("weight"))
    total = per_component.groupBy("search_id").agg(F.sum("weight").alias("total_weight"), F.count(F.lit(1)).alias("search_components"))
    sums = scored.groupBy("search_id", "chunk_id").agg(F.sum(F.col("weight") * F.col("normal")).alias("evidence"), F.count(F.lit(1)).alias("components"))
    return sums.join(total, "search_id").select("search_id", "chunk_id", F.round(F.col("evidence") / F.col("total_weight"), 9).alias("fused"), "components", "search_components")


def first_places(fused: DataFrame) -> DataFrame:
    """The first chunk of each search: highest fused score, then smallest chunk_id; a partial aggregate, no sort."""
    best = F.min(F.struct((-F.col("fused")).alias("low"), F.col("chunk_id").alias("chunk_id")))
    return fused.groupBy("search_id").agg(best.alias("best")).select("search_id", F.col("best.chunk_id").alias("chunk_id"))


def fused_positions(fused: DataFrame, blocks: int = 64) -> DataFrame:
    """``fused`` with ``position`` (1 is best) in its search, ordered by score, then chunk_id.

    Positions are counted in blocks of the score's range, so that a search with any number of
    candidates is sorted in pieces: a block's rows are numbered within it and lifted by the counts
    of the better blocks.  Scores lie within the normal quantiles, so ``blocks`` are cut evenly there.
    """
    cut = fused.withColumn("_block", F.greatest(F.lit(0), F.least(F.lit(blocks - 1), F.floor((F.lit(4.0) - F.col("fused")) / 8.0 * blocks))).cast("int"))
    counts = cut.groupBy("search_id", "_block").agg(F.count(F.lit(1)).alias("_n"))
    ahead = W.partitionBy("search_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("search_id", "_block", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    within = W.partitionBy("search_id", "_block").orderBy(F.col("fused").desc(), "chunk_id")
    return cut.withColumn("_r", F.row_number().over(within)).join(counts, ["search_id", "_block"]).withColumn("position", F.col("_r") + F.col("_ahead")).drop("_r", "_ahead", "_block")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return first_places(fuse_scores(read_table(spark, folder, "component_hits")))


def p2_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """The whole combined ranking, with the rank at which the chunk was served, if it was."""
    ranked = fused_positions(fuse_scores(read_table(spark, folder, "component_hits")))
    served = read_table(spark, folder, "appearances").where("search_id IS NOT NULL AND chunk_id IS NOT NULL").groupBy("search_id", "chunk_id").agg(F.min("rank").alias("served_rank"))
    return ranked.join(served, ["search_id", "chunk_id"], "left").select("search_id", "chunk_id", F.round("fused", 6).alias("fused"), "components", "position", "served_rank")


_FUSED_SQL = f"""
WITH clean AS (
  SELECT search_id, component, chunk_id, max(score) AS score FROM component_hits
  WHERE search_id IS NOT NULL AND component IS NOT NULL AND chunk_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)
  GROUP BY ALL),
ranked AS (
  SELECT *, (rank() OVER (PARTITION BY search_id, component ORDER BY score) - 1
      + count(*) OVER (PARTITION BY search_id, component, score) / 2.0) / count(*) OVER (PARTITION BY search_id, component) AS p
  FROM clean),
normal AS (SELECT *, {inverse_normal_sql("p")} AS z FROM ranked),
total AS (SELECT search_id, count(DISTINCT component) AS m FROM clean GROUP BY 1),
fused AS (
  SELECT n.search_id, n.chunk_id, round(sum(n.z) / any_value(t.m), 9) AS fused, count(*) AS components
  FROM normal n JOIN total t USING (search_id) GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY fused DESC, chunk_id) AS position FROM fused)
"""

QUERIES = {"p2_found": p2_found, "p2_ranking": p2_ranking}
ORACLES = {
    "p2_found": _FUSED_SQL + "SELECT search_id, chunk_id FROM placed WHERE position = 1",
    "p2_ranking": _FUSED_SQL
    + """SELECT p.search_id, p.chunk_id, round(p.fused, 6) AS fused, p.components, p.position, a.served_rank
FROM placed p LEFT JOIN (SELECT search_id, chunk_id, min(rank) AS served_rank FROM appearances GROUP BY 1, 2) a USING (search_id, chunk_id)""",
}
