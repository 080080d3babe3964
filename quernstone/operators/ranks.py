"""Ranks within groups that may hold any share of the rows.

A window over a hot group would sort that group in one task.  Here the values of a group are
pre-aggregated, cut into buckets by the leading bits of the number (a monotone map, so buckets are
in value order), ranked within (group, bucket), and lifted by the row counts of the buckets below.
"""

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def ordered_bucket(value: Column, bits: int = 24) -> Column:
    """A number that never falls as the finite double ``value`` rises: the leading ``bits`` of its order-preserving form."""
    size = F.abs(value.cast("double"))
    exponent = F.when(size == 0, F.lit(-1100)).otherwise(F.floor(F.log2(size)))
    fraction = F.when(size == 0, F.lit(0)).otherwise(F.floor(size / F.pow(F.lit(2.0), exponent) * (1 << (bits - 12))))
    height = (exponent + 1101) * (1 << (bits - 10)) + fraction
    return F.when(value < 0, -height).otherwise(height).cast("long")


def averaged_percentiles(df: DataFrame, groups: list[str], value: str, into: str) -> DataFrame:
    """``df`` with ``into``: the empirical percentile (mean rank of ties - 0.5) / n of ``value`` in its group.

    Null and NaN values get a null percentile and count for nothing.  Groups are compared
    null-safely; exact ties share one percentile.  No group is gathered into one task: equal values
    are counted before the shuffle, and a group spreads over as many tasks as it has buckets.
    """
    usable = F.col(value).isNotNull() & ~F.isnan(value)
    keys = [f"_g{i}" for i in range(len(groups))]
    named = [F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)]
    counts = df.where(usable).select(*named, (F.col(value) + F.lit(0.0)).alias("_v")).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_b", ordered_bucket(F.col("_v")))
    buckets = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_in"))
    below = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    buckets = buckets.select(*keys, "_b", F.coalesce(F.sum("_in").over(below), F.lit(0)).alias("_below"), F.sum("_in").over(W.partitionBy(*keys)).alias("_all"))
    lower = W.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    ranked = counts.withColumn("_lower", F.coalesce(F.sum("_n").over(lower), F.lit(0)))
    on = [ranked[k].eqNullSafe(buckets[k]) for k in [*keys, "_b"]]
    ranked = ranked.join(buckets, on, "inner").select(*(ranked[k] for k in keys), "_v", ((F.col("_below") + F.col("_lower") + F.col("_n") / 2.0) / F.col("_all")).alias(into))
    same = [df[g].eqNullSafe(ranked[k]) for g, k in zip(groups, keys, strict=True)]
    return df.join(ranked, [*same, (df[value] + F.lit(0.0)).eqNullSafe(ranked["_v"])], "left").select(df["*"], ranked[into])


def order_statistics(rows: DataFrame, groups: list[str], value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``(*groups, n, *places)``: for each name the value at the place, from 1, that its function gives for the number of values.

    Null and NaN values count for nothing; a group without values gives no row.  Equal values are counted
    before the shuffle, the bucket that holds a place is found from the counts of buckets, and only the
    values of such buckets are put in order, so no group is sorted in one task.
    """
    keys = [f"_g{i}" for i in range(len(groups))]
    usable = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)], (F.col(value) + F.lit(0.0)).alias("_v"))
    counts = usable.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", ordered_bucket(F.col("_v")))
    below = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    buckets = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_in"))
    buckets = buckets.withColumn("_below", F.coalesce(F.sum("_in").over(below), F.lit(0))).withColumn("n", F.sum("_in").over(W.partitionBy(*keys)))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), at(F.col("n")).cast("long").alias("at")) for name, at in places.items()]))
    hit = buckets.withColumn("_w", wanted).where((F.col("_w.at") > F.col("_below")) & (F.col("_w.at") <= F.col("_below") + F.col("_in")))
    hit = hit.select(*[F.col(k).alias(f"h{k}") for k in keys], F.col("_b").alias("_hb"), "n", F.col("_w.name").alias("_name"), (F.col("_w.at") - F.col("_below")).alias("_left"))
    same = reduce(operator.and_, [counts[k].eqNullSafe(hit[f"h{k}"]) for k in keys], counts["_b"] == hit["_hb"])
    within = counts.join(hit, same).withColumn("_upto", F.sum("_n").over(W.partitionBy(*keys, "_b", "_name").orderBy("_v")))
    found = within.where(F.col("_upto") >= F.col("_left")).groupBy(*keys, "n").agg(*[F.min(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in places])
    return found.select(*[F.col(k).alias(g) for g, k in zip(groups, keys, strict=True)], "n", *places)
