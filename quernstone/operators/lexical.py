"""BM25 over an inverted index of plain tables, for batches of queries in one job."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quernstone.functions.tokens import gate_tokens, index_tokens
from quernstone.operators import blocks
from quernstone.plans.stages import cut

K1 = 1.5
B = 0.75
CORRUPT, ARTIFACT, APPARATUS = 1, 2, 4


@dataclass
class Index:
    """``postings(term, chunk_id, tf, dl)``, ``terms(term, df, idf)`` and ``totals(n, avgdl)`` (one row)."""

    postings: DataFrame
    terms: DataFrame
    totals: DataFrame


def build_index(texts: DataFrame) -> Index:
    """The index of rows ``(chunk_id, contents)``; null texts and texts without tokens are not in it.

    Postings are laid out by chunk and written once to the shared checkpoint folder, as all that
    follows reads them; the other tables are small aggregates of them.
    """
    tokens = texts.where("chunk_id IS NOT NULL").select("chunk_id", index_tokens(F.col("contents")).alias("tokens")).where(F.size("tokens") > 0)
    sized = tokens.withColumn("dl", F.size("tokens"))
    exploded = sized.repartition("chunk_id").select("chunk_id", "dl", F.explode("tokens").alias("term"))
    postings = cut(exploded.groupBy("chunk_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")))
    totals = postings.select("chunk_id", "dl").distinct().agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    frequency = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = frequency.join(F.broadcast(totals), how="cross").select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    return Index(postings, terms, totals)


#: Query terms of up to so many rows are sent to every task; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _weighted(index: Index, queries: DataFrame) -> DataFrame:
    terms = queries.select("query_id", F.explode(index_tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
    return terms.join(index.terms, "term").select("query_id", "term", (F.col("qf") * F.col("idf")).alias("weight"))


def _gains(index: Index) -> DataFrame:
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    return index.postings.join(F.broadcast(index.totals.select("avgdl")), how="cross").select("term", "chunk_id", (F.col("tf") / norm).alias("gain"))


def bm25(index: Index, queries: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(query_id, chunk_id, score)`` for each chunk that shares an index term with a query ``(query_id, query)``.

    A query's repeated terms count as often as they occur.  Where the query terms are few enough to
    broadcast, the postings are laid out by chunk once and each task sums the scores of its own chunks:
    neither the matches nor the sums are shuffled, and a top-k that follows is cut in the same tasks.
    Otherwise both sides are shuffled by term.
    """
    weighted, postings = _weighted(index, queries), _gains(index)
    if weighted.count() <= broadcast_rows:
        hits = postings.repartition("chunk_id").join(F.broadcast(weighted), "term")
    else:
        hits = weighted.join(postings, "term")
    return hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("weight") * F.col("gain")), 9).alias("score"))


#: Chunks scored at once: a query's scores of them stay in a core's cache.
CHUNKS = 32_768


def bm25_top_k(index: Index, queries: DataFrame, k: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(query_id, chunk_id, score, rank)``: the first k of :func:`bm25` for each query, equal scores by chunk_id.

    Where the query terms are few enough to broadcast, only their postings are kept, by a join in the
    JVM that puts numbers for terms; a task then sums the scores of its chunks in blocks, query by query,
    and passes on no more than k chunks a query, packed, so that the matches, which are many more, are
    never rows.  Otherwise the joined scores are ranked.
    """
    weighted = _weighted(index, queries)
    table = weighted.limit(broadcast_rows + 1).toArrow()
    if not 0 < table.num_rows <= broadcast_rows:
        return ranked(bm25(index, queries, -1), k)
    spark = queries.sparkSession
    ids, at = np.unique(table.column("query_id").to_numpy(), return_inverse=True)
    terms = {t: i for i, t in enumerate(dict.fromkeys(table.column("term").to_pylist()))}
    term_of = np.array([terms[t] for t in table.column("term").to_pylist()], dtype=np.int64)
    order = np.lexsort((term_of, at))
    term_of, weights, starts = term_of[order], table.column("weight").to_numpy()[order], np.concatenate(([0], np.cumsum(np.bincount(at))))
    numbers_of = spark.createDataFrame(pa.table({"term": pa.array(list(terms), pa.string()), "number": pa.array(list(terms.values()), pa.int32())}))  # at most broadcast_rows
    asked = _gains(index).join(F.broadcast(numbers_of), "term")
    by_chunk = asked.groupBy("chunk_id").agg(F.collect_list(F.struct("number", "gain")).alias("p"))  # the distinct terms of one chunk
    rows = blocks.numbered(by_chunk.select("chunk_id", F.col("p.number").alias("terms"), F.col("p.gain").alias("gains")), "chunk_id")
    parts, per = [], max(1, blocks.HELD_BYTES // (16 * k))
    for first in range(0, len(ids), per):
        own = starts[first : first + per + 1]
        known = spark.sparkContext.broadcast((own - own[0], term_of[own[0] : own[-1]], weights[own[0] : own[-1]], len(terms)))
        known_ids = spark.sparkContext.broadcast(blocks.in_blocks(pa.array(ids[first : first + per], pa.int64())))

        def score(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            best, held = blocks.Best(len(known.value[0]) - 1, k), []
            for b in batches:
                held.append(b)
                if sum(map(len, held)) >= CHUNKS:
                    _score(pa.Table.from_batches(held), *known.value, best)
                    held = []
            if held:
                _score(pa.Table.from_batches(held), *known.value, best)
            yield from best.packed(0)

        packed = rows.select("number", "terms", "gains").mapInArrow(score, "block int, scores binary, numbers binary")
        parts.append(blocks.merged(packed, k, known_ids, "long"))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return ranked(found.join(rows.select("number", "chunk_id"), "number").select("query_id", "chunk_id", "score"), k)


def _score(chunks: pa.Table, starts: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int, best: blocks.Best) -> None:
    """Adds to ``best`` the chunks ``(number, terms, gains)`` that may be among the best of each query, whose terms are ``terms[starts[q]:starts[q + 1]]``."""
    numbers = chunks.column(0).to_numpy()
    if not len(numbers):
        return
    lists = pa.concat_arrays(chunks.column(1).chunks)
    term, gain = lists.flatten().to_numpy(), pa.concat_arrays(chunks.column(2).chunks).flatten().to_numpy()
    order = np.argsort(term, kind="stable")
    chunk, gain = np.repeat(np.arange(len(numbers)), lists.value_lengths().to_numpy())[order], gain[order]
    at = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=n_terms)))).tolist()
    groups = 4 * best.k
    depth = -(-len(numbers) // groups)
    terms, weights, bounds = terms.tolist(), weights.tolist(), starts.tolist()
    for first in range(0, len(bounds) - 1, blocks.BLOCK):
        last = min(first + blocks.BLOCK, len(bounds) - 1)
        least, query, columns, scores = best.least[first:last].tolist(), [], [], []
        for q in range(first, last):
            own = [(at[terms[i]], at[terms[i] + 1], weights[i]) for i in range(bounds[q], bounds[q + 1])]
            sums = np.bincount(np.concatenate([chunk[a:b] for a, b, _ in own]), np.concatenate([gain[a:b] * w for a, b, w in own]), depth * groups)
            # the groups' k-th best maximum is reached by k chunks
            bar = max(float(np.partition(sums.reshape(depth, groups).max(axis=0), groups - best.k)[groups - best.k]), least[q - first]) - blocks.SLACK
            some = np.flatnonzero(sums >= bar) if bar > 0 else np.flatnonzero(sums)
            query.append(len(some))
            columns.append(some)
            scores.append(sums[some])
        score = np.rint(np.concatenate(scores) * blocks.UNIT).astype(np.int64)
        kept = score > 0
        best.add(first, last, np.repeat(np.arange(last - first), query)[kept], score[kept], numbers[np.concatenate(columns)][kept])


def ranked(scores: DataFrame, k: int | None = None, score: str = "score", tie: str = "chunk_id", group: str = "query_id", into: str = "rank") -> DataFrame:
    """Scores with ranks from 1 in each group, equal scores by ``tie``; with ``k`` only the first k, pruned before the shuffle."""
    out = scores.withColumn(into, F.row_number().over(W.partitionBy(group).orderBy(F.col(score).desc(), tie)))
    return out.where(F.col(into) <= k) if k else out


def first_gate(flags: Column, filtered: Column, overlap: Column, words: Column, minimum_words: int, exclude_apparatus: bool) -> Column:
    """The first gate that rejects a candidate, in the order they apply; null if it passes all."""
    gate = F.when(~F.coalesce(filtered, F.lit(True)), "filtered_out")
    gate = gate.when(flags.bitwiseAND(ARTIFACT) != 0, "extraction_artifact").when(flags.bitwiseAND(CORRUPT) != 0, "corrupt")
    if exclude_apparatus:
        gate = gate.when(flags.bitwiseAND(APPARATUS) != 0, "apparatus")
    gate = gate.when(~F.coalesce(overlap, F.lit(False)), "no_query_token_overlap")
    return gate.when(words < minimum_words, "too_short") if minimum_words else gate


def window(depth: int, filtered: bool, minimum_candidates: int = 20, maximum_candidates: int = 200) -> int:
    """How many ranks the walk of :func:`gated` may look at."""
    return max(4 * depth, minimum_candidates, maximum_candidates if filtered else 0)


def gated(ranking: DataFrame, chunks: DataFrame, queries: DataFrame, depth: int, passes: Column | None = None, minimum_candidates: int = 20, maximum_candidates: int = 200, minimum_words: int = 0, exclude_apparatus: bool = False) -> DataFrame:
    """Every candidate the walk down a ranking looks at, with ``gate`` (null if accepted) and ``place`` among the accepted.

    The window is ``max(4 depth, minimum)`` ranks, or up to the ceiling ``maximum_candidates`` where a
    filter (``passes``, over the chunk's columns) is set; the walk ends at the depth-th accepted
    candidate.  Filters apply after ranking, within the window, never before it.
    """
    looked = ranking.where(F.col("rank") <= window(depth, passes is not None, minimum_candidates, maximum_candidates))
    facts = chunks.select("chunk_id", "source_id", "document_id", F.coalesce("health_flags", F.lit(0)).alias("flags"), gate_tokens(F.col("contents")).alias("tokens"), F.size(F.regexp_extract_all("contents", F.lit(r"\S+"), F.lit(0))).alias("words"), *([passes.alias("passes")] if passes is not None else [F.lit(True).alias("passes")]))
    # tokens are taken before the join, once a chunk and once a query, not once a candidate; a candidate's chunk comes last, as its tokens are many and the gate is all that goes on
    joined = looked.join(queries.select("query_id", gate_tokens(F.col("query")).alias("asked")), "query_id").join(facts, "chunk_id")
    judged = joined.withColumn("gate", first_gate(F.col("flags"), F.col("passes"), F.arrays_overlap("asked", "tokens"), F.col("words"), minimum_words, exclude_apparatus))
    order = W.partitionBy("query_id").orderBy("rank")
    accepted = F.col("gate").isNull()
    judged = judged.withColumn("before", F.coalesce(F.sum(accepted.cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    judged = judged.where(F.col("before") < depth)
    return judged.select("query_id", "chunk_id", "source_id", "document_id", "score", "rank", "gate", F.when(accepted, F.col("before") + 1).alias("place"))


def gate_frequencies(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(term, df)``: in how many texts each wanted term is a gate token; tokens of no wanted term leave before the shuffle where the wish is small."""
    held = texts.where("contents IS NOT NULL").select(F.explode(gate_tokens(F.col("contents"))).alias("term"))
    return held.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def feedback_terms(leaders: DataFrame, texts: DataFrame, queries: DataFrame, documents: int = 5, terms: int = 8) -> DataFrame:
    """``(query_id, term, support, place)``: terms mined from the first ``documents`` accepted chunks ``(query_id, contents, place)``.

    Support is the number of leaders holding the term; terms of the query itself are left out; order is
    support x idf, then support, then the term.  ``idf`` is ln((N + 1) / (df + 1)) + 1 over the gate
    tokens of all ``texts`` (chunk_id, contents), of which there are N.
    """
    own = queries.select("query_id", F.explode(gate_tokens(F.col("query"))).alias("term"))
    found = leaders.where(F.col("place") <= documents).select("query_id", F.explode(gate_tokens(F.col("contents"))).alias("term")).join(own, ["query_id", "term"], "left_anti")
    support = cut(found.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("support")))
    total = texts.agg(F.count_distinct("chunk_id").alias("n"))  # one row
    scored = support.join(gate_frequencies(texts, support), "term", "left").join(F.broadcast(total), how="cross")
    weight = F.round(F.col("support") * (F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1), 9)
    order = W.partitionBy("query_id").orderBy(weight.desc(), F.col("support").desc(), "term")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= terms).select("query_id", "term", "support", "place")
