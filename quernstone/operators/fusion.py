"""Fusion of rankings, relevance, diversity and repetition."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quernstone.functions.tokens import equality_key

RRF_K = 60
BM25_WEIGHT = 1.25
DENSE_WEIGHT = 1.0
MAXIMUM_CANDIDATES = 200
DIVERSITY_PENALTY = 0.25
DUPLICATE_COSINE = 0.99


def reciprocal_rank_fusion(lexical: DataFrame, dense: DataFrame, k: int = RRF_K, lexical_weight: float = BM25_WEIGHT, dense_weight: float = DENSE_WEIGHT, absent: int = MAXIMUM_CANDIDATES + 1) -> DataFrame:
    """``(query_id, chunk_id, bm25_rank, dense_rank, match_kind, fusion_score, position)`` of two rankings ``(query_id, chunk_id, rank)``.

    A full outer join; score = sum of weight / (k + rank); equal scores go to the best single rank (an
    absent one counts as ``absent``), then the smaller chunk_id.
    """
    a = lexical.select("query_id", "chunk_id", F.col("rank").alias("bm25_rank"))
    b = dense.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"))
    both = a.join(b, ["query_id", "chunk_id"], "full_outer")
    score = F.coalesce(lexical_weight / (k + F.col("bm25_rank")), F.lit(0.0)) + F.coalesce(dense_weight / (k + F.col("dense_rank")), F.lit(0.0))
    kind = F.when(F.col("bm25_rank").isNull(), "semantic").when(F.col("dense_rank").isNull(), "lexical").otherwise("hybrid")
    best = F.least(F.coalesce("bm25_rank", F.lit(absent)), F.coalesce("dense_rank", F.lit(absent)))
    scored = both.withColumn("match_kind", kind).withColumn("fusion_score", F.round(score, 9)).withColumn("_best", best)
    order = W.partitionBy("query_id").orderBy(F.col("fusion_score").desc(), "_best", "chunk_id")
    return scored.withColumn("position", F.row_number().over(order)).drop("_best")


def normalised_relevance(scored: DataFrame, score: str = "fusion_score") -> DataFrame:
    """``scored`` with ``relevance``: min-max over a query's scored rows, 1 on a flat band, 0 where unscored."""
    w = W.partitionBy("query_id")
    low, high = F.min(score).over(w), F.max(score).over(w)
    return scored.withColumn("relevance", F.when(F.col(score).isNull(), 0.0).when(high <= low, 1.0).otherwise(F.round((F.col(score) - low) / (high - low), 9)))


def source_diverse(ranked: DataFrame, top_k: int, penalty: float = DIVERSITY_PENALTY, score: str = "fusion_score") -> DataFrame:
    """The ``top_k`` rows per query after charging a source ``penalty`` for each of its rows already taken, with ``selected_rank``.

    The greedy choice is a merge of per-source sequences that fall strictly, so it equals one global
    order by relevance - penalty x (place within the source - 1).  Plain order where the penalty is not
    positive, the pool is no deeper than top_k, or nothing is scored.
    """
    with_relevance = normalised_relevance(ranked, score)
    within = W.partitionBy("query_id", F.coalesce("source_id", "chunk_id")).orderBy(F.col("relevance").desc(), "position", "chunk_id")
    per_query = W.partitionBy("query_id")
    charged = with_relevance.withColumn("adjusted", F.round(F.col("relevance") - penalty * (F.row_number().over(within) - 1), 9))
    plain = (F.lit(penalty) <= 0) | (F.count(F.lit(1)).over(per_query) <= top_k) | (F.count(score).over(per_query) == 0)
    charged = charged.withColumn("adjusted", F.when(plain, F.lit(0.0)).otherwise(F.col("adjusted")))
    order = per_query.orderBy(F.col("adjusted").desc(), "position", "chunk_id")
    return charged.withColumn("selected_rank", F.row_number().over(order)).where(F.col("selected_rank") <= top_k)


def collapse_repetitions(ranked: DataFrame, vectors: DataFrame, threshold: float = DUPLICATE_COSINE) -> DataFrame:
    """``ranked`` with ``kept_as`` (the chunk a repetition repeats, null if kept) and ``reason`` (same_words or same_meaning).

    In rank order a row repeats a kept row with the same words, or else the kept row of the highest
    cosine at or above the threshold.  Empty words match nothing; a missing, zero or non-finite vector
    is not compared.  The kept set depends on the order, so each query's rows (bounded by the candidate
    depth) are judged in one call.  ``ranked`` needs query_id, chunk_id, position and contents.
    """
    first = vectors.groupBy("chunk_id").agg(F.min_by("vector", "vec_id").alias("vector"))
    joined = ranked.join(first, "chunk_id", "left").withColumn("_key", equality_key(F.col("contents"))).select("query_id", "chunk_id", "position", "_key", "vector")

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        words: dict[str, str] = {}
        kept_ids: list[str] = []
        kept: list[np.ndarray] = []
        as_, why = [], []
        for chunk, key, vector in zip(pdf["chunk_id"], pdf["_key"], pdf["vector"], strict=True):
            unit = None
            if vector is not None:
                v = np.asarray(vector, dtype=np.float64)
                norm = np.linalg.norm(v)
                unit = v / norm if np.isfinite(norm) and norm > 0 else None
            twin, reason = (words[key], "same_words") if key and key in words else (None, None)
            if twin is None and unit is not None:
                same = [i for i, u in enumerate(kept) if u is not None and len(u) == len(unit)]
                if same:
                    cosines = np.stack([kept[i] for i in same]) @ unit
                    if cosines.max() >= threshold:
                        twin, reason = kept_ids[same[int(cosines.argmax())]], "same_meaning"
            if twin is None:
                kept_ids.append(chunk)
                kept.append(unit)
                if key:
                    words.setdefault(key, chunk)
            as_.append(twin)
            why.append(reason)
        return pd.DataFrame({"query_id": pdf["query_id"], "chunk_id": pdf["chunk_id"], "position": pdf["position"], "kept_as": as_, "reason": why})

    query_type = ranked.schema["query_id"].dataType.simpleString()
    return joined.groupBy("query_id").applyInPandas(judge, f"query_id {query_type}, chunk_id string, position int, kept_as string, reason string")


def rerank(ranked: DataFrame, score: str, top_k: int, window_multiple: int = 2, window_floor: int = 10, most: int = 50) -> DataFrame:
    """``ranked`` with ``rerank_position``: the head of the window ordered by ``score``, the tail as it was.

    The window is ``min(most, max(top_k x multiple, floor))``.  Equal scores keep the base order.
    """
    window = min(most, max(top_k * window_multiple, window_floor))
    head = F.col("position") <= window
    order = W.partitionBy("query_id").orderBy(head.desc(), F.when(head, F.col(score)).desc_nulls_last(), "position", "chunk_id")
    return ranked.withColumn("rerank_position", F.row_number().over(order)).withColumn("in_window", head)
