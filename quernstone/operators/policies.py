"""What a search may answer with, what reviewed decisions take out of it, and what it tells about both."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quernstone.operators.catalogue import passage_window
from quernstone.operators.lexical import ARTIFACT, CORRUPT

DEFAULT_METHOD = "hybrid"
DENSE_METHODS = ("dense", "hybrid")
MINIMUM_CANDIDATES, MAXIMUM_CANDIDATES = 20, 200
MOST_EXAMPLES = 5
MOST_RADIUS = 5


def served_method(requested: Column, available: Column, mismatch: Column) -> Column:
    """``struct(method, reason, refused)``: the method that answers a request.

    A null request asks for the default.  Where the vectors are of another model (``mismatch``), only
    lexical search is served, to a null request with a reason.  A method asked for by name and not
    available is refused with those that are; an empty or null array of methods stands for lexical search.
    """
    lexical = F.array(F.lit("bm25"))
    usable = F.when(mismatch | (F.coalesce(F.size(available), F.lit(0)) <= 0), lexical).otherwise(available)
    asked = F.coalesce(requested, F.lit(DEFAULT_METHOD))
    served = F.when(F.array_contains(usable, asked), asked).when(requested.isNull() & F.array_contains(usable, "bm25"), "bm25")
    reason = F.when(requested.isNull() & mismatch & ~F.array_contains(usable, asked), "embedding_model_mismatch")
    refused = F.when(served.isNull(), F.concat(F.lit("available: "), F.array_join(F.array_sort(usable), ", ")))
    return F.struct(served.alias("method"), reason.alias("reason"), refused.alias("refused"))


def candidate_depth(active: Column, top_k: Column, minimum: int = MINIMUM_CANDIDATES, maximum: int = MAXIMUM_CANDIDATES) -> Column:
    """How many candidates each half ranks: four times what is wanted, within bounds, and no more than there are."""
    return F.least(active, F.lit(maximum), F.greatest(F.lit(minimum), top_k * 4))


def answers_by_method(lexical: DataFrame, dense: DataFrame, fused: DataFrame, top_k: int) -> DataFrame:
    """``(method, query_id, chunk_id, rank, fusion_score)``: a single method answers in its own order, without a fusion score."""
    none = F.lit(None).cast("double")
    parts = [
        lexical.select(F.lit("bm25").alias("method"), "query_id", "chunk_id", "rank", none.alias("fusion_score")),
        dense.select(F.lit("dense").alias("method"), "query_id", "chunk_id", "rank", none.alias("fusion_score")),
        fused.select(F.lit("hybrid").alias("method"), "query_id", "chunk_id", F.col("position").alias("rank"), "fusion_score"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where(F.col("rank") <= top_k)


@dataclass
class Decisions:
    """Reviewed exclusions: ``sources (source_id, reason)`` and ``chunks (chunk_id, reason)``, each key once."""

    sources: DataFrame
    chunks: DataFrame


def without_excluded(rows: DataFrame, decisions: Decisions) -> DataFrame:
    """Rows ``(chunk_id, source_id, ...)`` without those of excluded sources and chunks; an exclusion wins over any inclusion. Null keys stay."""
    return rows.join(decisions.sources.select("source_id"), "source_id", "left_anti").join(decisions.chunks.select("chunk_id"), "chunk_id", "left_anti")


def exclusion_listing(decisions: Decisions, chunks: DataFrame) -> DataFrame:
    """``(kind, id, reason, documents, chunks)``: each decision with what it takes out; zeros for one that meets nothing."""
    per_source = chunks.groupBy("source_id").agg(F.count_distinct("document_id").alias("documents"), F.count_distinct("chunk_id").alias("chunks"))
    of_source = decisions.sources.join(per_source, "source_id", "left").select(F.lit("source").alias("kind"), F.col("source_id").alias("id"), "reason", "documents", "chunks")
    per_chunk = chunks.groupBy("chunk_id").agg(F.count_distinct("document_id").alias("documents"), F.lit(1).cast("long").alias("chunks"))
    of_chunk = decisions.chunks.join(per_chunk, "chunk_id", "left").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"), "reason", "documents", "chunks")
    return of_source.unionByName(of_chunk).fillna(0, ["documents", "chunks"])


def get_passage(chunks: DataFrame, asked: DataFrame, radius: int, decisions: Decisions) -> DataFrame:
    """``(target_id, refusal, chunk_id, offset, excluded)``: each passage asked for with its readable neighbours, or why it is refused.

    Refused are ids that no chunk has (unknown), excluded ones, and unreadable ones, in this order; such
    an id gives one row without a chunk.  An excluded neighbour stays and is marked.  Null ids are not
    asked for; ``radius`` is 0 to 5.
    """
    if not 0 <= radius <= MOST_RADIUS:
        raise ValueError(f"radius must be 0 to {MOST_RADIUS}")
    out = decisions.chunks.select("chunk_id", F.lit(True).alias("_by_chunk"))
    by_source = decisions.sources.select("source_id", F.lit(True).alias("_by_source"))
    known = chunks.join(out, "chunk_id", "left").join(by_source, "source_id", "left")
    known = known.withColumn("excluded", F.coalesce("_by_chunk", "_by_source", F.lit(False))).drop("_by_chunk", "_by_source")
    unreadable = F.coalesce("health_flags", F.lit(0)).bitwiseAND(ARTIFACT | CORRUPT) != 0
    facts = known.select(F.col("chunk_id").alias("target_id"), F.when(F.col("excluded"), "excluded").when(unreadable, "unreadable").otherwise("").alias("_why"))
    judged = asked.select(F.col("chunk_id").alias("target_id")).where("target_id IS NOT NULL").distinct().join(facts, "target_id", "left")
    judged = judged.select("target_id", F.nullif(F.coalesce("_why", F.lit("unknown")), F.lit("")).alias("refusal"))
    window = passage_window(known, judged.where("refusal IS NULL").select(F.col("target_id").alias("chunk_id")), radius)
    shown = window.join(known.select("chunk_id", "excluded"), "chunk_id").select("target_id", F.lit(None).cast("string").alias("refusal"), "chunk_id", "offset", "excluded")
    refused = judged.where("refusal IS NOT NULL").select("target_id", "refusal", F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast("int").alias("offset"), (F.col("refusal") == "excluded").alias("excluded"))
    return shown.unionByName(refused)


def bounded_examples(rejected: DataFrame, most: int = MOST_EXAMPLES) -> DataFrame:
    """The first ``most`` rejected candidates ``(query_id, reason, chunk_id, rank, ...)`` of each query and reason, with ``example`` from 1."""
    order = W.partitionBy("query_id", "reason").orderBy("rank", "chunk_id")
    return rejected.withColumn("example", F.row_number().over(order)).where(F.col("example") <= most)


def disclosures(judged: DataFrame, dense: DataFrame, fused: DataFrame, selected: DataFrame, wanted: DataFrame, floor: float) -> DataFrame:
    """One row per query of what each stage let through and kept out.

    ``judged`` is the walk down the lexical ranking with its gates, ``dense`` the candidates with
    ``admitted``, ``fused`` the fusion with ``source_id``, ``selected`` the answer with ``source_id``,
    ``embedding_token_count`` and ``dense_truncated``, ``wanted`` is ``(query_id, requested_top_k)``.  A half
    that did not run for a query has nulls, not zeros.
    """
    gate = F.col("gate")
    of_lexical = judged.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("bm25_looked_at"), F.count_if(gate.isNull()).alias("bm25_accepted"), *[F.count_if(gate == g).alias(f"bm25_{g}") for g in ("filtered_out", "extraction_artifact", "corrupt", "no_query_token_overlap")], F.max("rank").alias("window_reached"))
    above = F.col("score") >= floor
    of_dense = dense.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("dense_eligible"), F.count_if(above).alias("dense_above_floor"), F.count_if(F.col("admitted") & ~above).alias("dense_rescued"), F.count_if(~F.col("admitted")).alias("dense_below_threshold"))
    of_fused = fused.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_distinct("source_id").alias("candidate_sources"))
    of_answer = selected.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("results"), F.count_distinct("source_id").alias("result_sources"), F.count("embedding_token_count").alias("audited_results"), F.count_if("dense_truncated").alias("truncated_results"))
    out = wanted.join(of_lexical, "query_id", "left").join(of_dense, "query_id", "left").join(of_fused, "query_id", "left").join(of_answer, "query_id", "left")
    out = out.where("bm25_looked_at IS NOT NULL OR dense_eligible IS NOT NULL").fillna(0, ["candidates", "candidate_sources", "results", "result_sources", "audited_results", "truncated_results"])
    return out.withColumn("relevance_limited", F.col("candidates") < F.col("requested_top_k"))


def policy_differences(recorded: dict[str, Column], current: dict[str, Column]) -> Column:
    """The names, in order, of the settings in which what was recorded differs from what holds now; null differs from a value."""
    return F.array_compact(F.array(*[F.when(~recorded[name].eqNullSafe(current[name]), F.lit(name)) for name in recorded]))


def list_sources(indexed: DataFrame, discovered: DataFrame, known: DataFrame, reviewed: DataFrame) -> DataFrame:
    """``(source_id, indexed, discovered, known, reviewed)``: every source of four lists of ``source_id``, and which of them have it."""
    lists = {"indexed": indexed, "discovered": discovered, "known": known, "reviewed": reviewed}
    tagged = None
    for name, rows in lists.items():
        part = rows.select("source_id").where("source_id IS NOT NULL").distinct().withColumn("_list", F.lit(name))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy("source_id").agg(*[F.bool_or(F.col("_list") == name).alias(name) for name in lists])
