"""Retrieval metrics over tables of rankings and judgements; a value that could not be measured is null, never 0."""

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quernstone.functions.tokens import word_runs

# Words that deny, for the protected signature.
NEGATIONS = ("no", "not", "never", "none", "nor", "neither", "cannot", "without", "ni", "ne", "nicht", "kein", "keine", "weder", "nunca", "sin")
BOOTSTRAP_DRAWS = 2000
LEAST_DRAWS = 200


def known_item(rankings: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """``(condition, query_id, reciprocal_rank, success_at_1, success_at_k, ndcg)`` of rankings ``(condition, query_id, chunk_id, rank)``.

    ``relevant`` is ``(query_id, chunk_id)``; gains are binary, discounts 1 / log2(rank + 1), the ideal
    runs over min(relevant, k).  Queries without relevant chunks give no rows.
    """
    wanted = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    asked = rankings.select("condition", "query_id").distinct().join(wanted, "query_id")
    found = rankings.join(relevant.withColumn("hit", F.lit(1)), ["query_id", "chunk_id"])
    per = found.groupBy("condition", "query_id").agg(F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    out = asked.join(per, ["condition", "query_id"], "left")
    return out.select(
        "condition", "query_id", F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"), F.coalesce((F.col("first") <= 1).cast("int"), F.lit(0)).alias("success_at_1"),
        F.coalesce((F.col("first") <= k).cast("int"), F.lit(0)).alias("success_at_k"), F.round(F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal, 6).alias("ndcg"))


def by_grain(metrics: DataFrame, grain: str) -> DataFrame:
    """Means of all metrics per condition, and per condition and ``grain``, in one pass of grouping sets; ``grain`` is null on the first."""
    means = [F.round(F.avg(m), 6).alias(m) for m in ("reciprocal_rank", "success_at_1", "success_at_k", "ndcg")]
    rolled = metrics.groupingSets([[F.col("condition")], [F.col("condition"), F.col(grain)]], F.col("condition"), F.col(grain)).agg(F.count(F.lit(1)).alias("queries"), F.grouping(F.col(grain)).alias("over_all"), *means)
    return rolled.withColumnRenamed(grain, "grain")


def graded(rankings: DataFrame, grades: DataFrame, k: int = 10, direct: int = 3) -> DataFrame:
    """Per condition and query: graded nDCG (2^g - 1; null without a positive grade), direct precision at k and of what came, direct coverage.

    ``grades`` is ``(query_id, chunk_id, grade)``; ungraded chunks count 0.
    """
    order = W.partitionBy("query_id").orderBy(F.col("grade").desc(), "chunk_id")
    best = grades.withColumn("_r", F.row_number().over(order))
    ideal = best.groupBy("query_id").agg(F.sum(F.when(F.col("_r") <= k, (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("_r") + 1)).otherwise(0.0)).alias("ideal"), F.sum((F.col("grade") >= direct).cast("int")).alias("directs"))
    top = rankings.where(F.col("rank") <= k).join(grades, ["query_id", "chunk_id"], "left")
    g = F.coalesce("grade", F.lit(0))
    per = top.groupBy("condition", "query_id").agg(F.sum((F.pow(F.lit(2.0), g) - 1) / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum((g >= direct).cast("int")).alias("hits"), F.count(F.lit(1)).alias("returned"))
    out = per.join(ideal, "query_id")
    return out.select(
        "condition", "query_id", F.round(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")), 6).alias("graded_ndcg"), F.round(F.col("hits") / k, 6).alias("direct_at_k"),
        F.round(F.when(F.col("returned") > 0, F.col("hits") / F.col("returned")), 6).alias("direct_of_returned"), F.round(F.when(F.col("directs") > 0, F.col("hits") / F.col("directs")), 6).alias("direct_coverage"))


def paired_differences(metrics: DataFrame, value: str, a: str, b: str, family: str) -> DataFrame:
    """``(family, difference, queries)``: the mean over the family's queries of value under a minus under b, where both have one."""
    x = metrics.where((F.col("condition") == a) & F.col(value).isNotNull()).select("query_id", family, F.col(value).alias("x"))
    y = metrics.where((F.col("condition") == b) & F.col(value).isNotNull()).select("query_id", F.col(value).alias("y"))
    return x.join(y, "query_id").groupBy(F.col(family).alias("family")).agg(F.round(F.avg(F.col("x") - F.col("y")), 9).alias("difference"), F.count(F.lit(1)).alias("queries"))


def _percentile(values: list[float], q: float) -> float:
    at = (len(values) - 1) * q
    low = int(at)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)


def cluster_bootstrap(families: DataFrame, draws: int = BOOTSTRAP_DRAWS, seed: int = 7) -> DataFrame:
    """``(comparison, families, mean, low, high)`` of rows ``(comparison, family, difference)``: a 95 % interval that resamples families.

    Null interval for fewer than two families or fewer than 200 draws.  Families per comparison are few
    (means of queries), so one task holds a comparison's.
    """

    def interval(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values("family")["difference"].tolist()
        n = len(values)
        low = high = None
        if n >= 2 and draws >= LEAST_DRAWS:
            rng = random.Random(seed)
            means = sorted(sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(draws))
            low, high = round(_percentile(means, 0.025), 9), round(_percentile(means, 0.975), 9)
        return pd.DataFrame({"comparison": [pdf["comparison"].iloc[0]], "families": [n], "mean": [round(sum(values) / n, 9)], "low": [low], "high": [high]})

    return families.groupBy("comparison").applyInPandas(interval, "comparison string, families long, mean double, low double, high double")


def paired_ratios(times: DataFrame, pair: list[str], condition: str, value: str, baseline: str) -> DataFrame:
    """``(pair.., condition, ratio)`` of each condition against the baseline within a pair; zero and missing baselines give none."""
    base = times.where((F.col(condition) == baseline) & (F.col(value) > 0)).groupBy(*pair).agg(F.min(value).alias("_base"))
    return times.where((F.col(condition) != baseline) & F.col(value).isNotNull()).join(base, pair).withColumn("ratio", F.round(F.col(value) / F.col("_base"), 9)).select(*pair, condition, "ratio")


def content_tokens(text: Column, stopwords: tuple[str, ...]) -> Column:
    """Distinct Latin words and numbers of three signs and more, without stopwords."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: (F.length(t) >= 3) & ~t.isin(*stopwords)))


def lexical_overlap(query: Column, text: Column, stopwords: tuple[str, ...]) -> Column:
    """The share of the query's content words that the text holds; 0 for a query without any."""
    q = content_tokens(query, stopwords)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, content_tokens(text, stopwords))) / F.size(q)).otherwise(0.0)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def shingles(words: Column, size: int = 2) -> Column:
    """The distinct runs of ``size`` words of a word array, case kept; a shorter text is one run, a text without words none."""
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).when(F.size(words) < size, F.array(F.array_join(words, " "))).otherwise(F.array_distinct(word_runs(words, size)))


def protected_signature(text: Column) -> Column:
    """Numbers with their percent signs, operator runs, and the denying words, as one comparable string."""
    numbers = F.regexp_extract_all(text, F.lit(r"[0-9]+(?:[.,][0-9]+)*%?"), F.lit(0))
    operators = F.filter(F.regexp_extract_all(text, F.lit(r"[+*/=<>≤≥±×÷-]+"), F.lit(0)), lambda r: ~r.rlike("^-+$"))
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    denies = F.array_sort(F.array_distinct(F.filter(words, lambda w: w.isin(*NEGATIONS) | w.startswith("un") | w.startswith("non"))))
    return F.concat_ws("|", F.array_join(numbers, " "), F.array_join(operators, " "), F.array_join(denies, " "))


def contained_repetitions(slots: DataFrame, group: str, threshold: float = 0.9) -> DataFrame:
    """``(<group>, chunk_id, contained_in)``: a chunk whose shingles lie to ``threshold`` in another of its group, of equal signature.

    ``slots`` is ``(<group>, chunk_id, contents)``.  The container is the first by id.  Shingles join on
    (group, signature, shingle), so work follows shared shingles and not pairs.
    """
    base = slots.withColumn("_words", words_of(F.col("contents"))).select(group, "chunk_id", protected_signature(F.col("contents")).alias("_sig"), shingles(F.col("_words")).alias("_s"))
    rows = base.select(group, "chunk_id", "_sig", F.size("_s").alias("_n"), F.explode("_s").alias("_w"))
    other = rows.select(group, F.col("chunk_id").alias("other"), "_sig", "_w")
    both = rows.join(other, [group, "_sig", "_w"]).where("chunk_id <> other").groupBy(group, "chunk_id", "other", "_n").agg(F.count(F.lit(1)).alias("_k"))
    return both.where(F.col("_k") >= threshold * F.col("_n")).groupBy(group, "chunk_id").agg(F.min("other").alias("contained_in"))




def two_level_means(rows: DataFrame, metric: str, condition: str = "condition", family: str = "family") -> DataFrame:
    """Per condition the mean of a metric over queries, and over the means of families, with how many of each had a value.

    A null value is not evaluated and lowers no mean; a family all of whose queries are null is not evaluated.
    """
    per_family = rows.groupBy(condition, family).agg(F.avg(metric).alias("_m"), F.sum(metric).alias("_s"), F.count(metric).alias("_e"), F.count(F.lit(1)).alias("_n"))
    return per_family.groupBy(condition).agg(
        F.round(F.sum("_s") / F.sum("_e"), 6).alias("query_mean"), F.sum("_e").alias("queries_evaluated"), F.sum("_n").alias("queries"), F.round(F.avg("_m"), 6).alias("family_mean"), F.count("_m").alias("families_evaluated"), F.count(F.lit(1)).alias("families"))


def handoff_violations(questions: DataFrame, judgments: DataFrame, rankings: DataFrame, grades: tuple[int, int] = (0, 4)) -> DataFrame:
    """``(rule, n)``: how many rows of a handed-over evaluation break each rule; zeros are kept.

    ``questions (query_id)``, ``judgments (query_id, chunk_id, grade)``, ``rankings (condition, query_id, chunk_id, score)``.
    """
    asked = questions.select("query_id").where("query_id IS NOT NULL").distinct()
    low, high = grades
    rules = {
        "questions without an id": questions.where("query_id IS NULL"),
        "judgments of no question": judgments.join(asked, "query_id", "left_anti"),
        "judgments given twice": judgments.groupBy("query_id", "chunk_id").count().where("count > 1"),
        "grades out of range": judgments.where(F.col("grade").isNull() | ~F.col("grade").between(low, high)),
        "rankings of no question": rankings.join(asked, "query_id", "left_anti"),
        "passages ranked twice": rankings.groupBy("condition", "query_id", "chunk_id").count().where("count > 1"),
        "scores missing or not finite": rankings.where(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))),
        "questions without a judgment": asked.join(judgments.select("query_id"), "query_id", "left_anti"),
    }
    out = None
    for rule, rows in rules.items():
        part = rows.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out
