"""What a build takes in, whether its inputs still hold, and what it did."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.operators.catalogue import staleness
from quernstone.plans.generations import fingerprint

#: Settings that change how a search ranks, not what is built.
RANKING_SETTINGS = frozenset("rrf_k bm25_weight dense_weight minimum_candidates maximum_candidates dense_minimum_cosine_similarity dense_relative_similarity_margin source_diversity_penalty duplicate_cosine prf prf_documents prf_terms".split())


def policy_identity(settings: dict) -> dict[str, str]:
    """Fingerprints of the settings that artifacts depend on and of those that only ranking does, so that one may change without the other."""
    return {"artifacts": fingerprint({k: v for k, v in settings.items() if k not in RANKING_SETTINGS}), "ranking": fingerprint({k: v for k, v in settings.items() if k in RANKING_SETTINGS})}


def selected_sources(scan: DataFrame, held: DataFrame, excluded: DataFrame, named: DataFrame | None = None, mode: str | None = None) -> DataFrame:
    """``(source_id, carried)``: the sources a build holds, and whether it carries them unread.

    All inputs have ``source_id``.  Without a mode every scanned source is read but an excluded one, which
    is carried if held; "ingest" reads the named ones and carries what else is held; "remove" carries what
    is held but the named ones.  A source that is no longer scanned leaves every build.
    """
    if mode not in (None, "ingest", "remove"):
        raise ValueError(f"unknown mode {mode!r}")
    rows = scan.select("source_id").where("source_id IS NOT NULL").distinct()
    for name, keys in (("_held", held), ("_out", excluded), ("_named", named)):
        marked = rows.select("source_id").limit(0).withColumn(name, F.lit(True)) if keys is None else keys.select("source_id").distinct().withColumn(name, F.lit(True))
        rows = rows.join(marked, "source_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    h, o, n = F.col("_held"), F.col("_out"), F.col("_named")
    keep, carried = {None: (~o | h, o), "ingest": (n | h, ~n), "remove": (h & ~n, ~n)}[mode]
    return rows.where(keep).select("source_id", carried.alias("carried"))


def revalidated(scanned: DataFrame, recorded: DataFrame, excluded_now: DataFrame, excluded_then: DataFrame, key: str = "source_id") -> DataFrame:
    """One row: how many sources came, went or changed since a build began, whether the exclusions are the same, and whether the build may be published."""
    changes = staleness(scanned, recorded, key).agg(*[F.count_if(F.col("change") == x).alias(x) for x in ("added", "removed", "modified")])
    now, then = excluded_now.select(key).distinct(), excluded_then.select(key).distinct()
    other = now.join(then, key, "left_anti").union(then.join(now, key, "left_anti")).agg(F.count(F.lit(1)).alias("decisions_changed"))
    both = changes.join(F.broadcast(other), how="cross")  # one row each
    return both.withColumn("publishable", F.col("added") + F.col("removed") + F.col("modified") + F.col("decisions_changed") == 0)


def build_metrics(documents: DataFrame, units: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of what a build holds, reused and lost.

    ``documents`` has the four loss counts, null where not measured, ``units`` ``contents``, ``chunks`` ``reused``.
    """
    losses = ("discarded_corrupt_character_count", "cleaned_corrupt_span_count", "partially_cleaned_passage_count")
    of_documents = documents.agg(F.count(F.lit(1)).alias("documents"), F.count(losses[0]).alias("documents_measured"), *[F.sum(x).alias(x.removesuffix("_count")) for x in losses])
    of_units = units.agg(F.count(F.lit(1)).alias("units"), F.count_if(F.col("contents").isNull()).alias("units_without_text"))
    of_chunks = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_if("reused").alias("chunks_reused"), F.count_if(~F.col("reused")).alias("chunks_rebuilt"))
    return of_documents.join(F.broadcast(of_units), how="cross").join(F.broadcast(of_chunks), how="cross")  # one row each
