"""Exact cosine search of a stated query set against all vectors, in blocks."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quernstone.operators import blocks

#: Bytes of query vectors that travel to the tasks at once; larger query sets are worked off in slices.
SLICE_BYTES = 48 << 20


def clean_vectors(vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows with non-null, finite, non-zero vectors of non-null keys."""
    good = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    return vectors.where(good & F.col(key).isNotNull())


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _units(column: pa.Array) -> np.ndarray:
    x = _rows(column)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


#: Queries and vectors whose cosines are taken at once; the block stays in a core's cache.
TILE, COLUMNS = 256, 4096


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``(query_id, <key>, score, rank)``: the k rows of highest cosine per query, equal ones by the smaller key.

    ``vectors`` has the key, ``kind`` (model) and ``vector``; ``queries`` has ``query_id``, ``kind`` and
    ``vector``.  Only vectors of one kind and length are compared.  Each task scans its rows in blocks
    against a slice of the queries and keeps k candidates per query, so what is shuffled is k packed
    numbers per query and task.  All pairs are compared in single precision, which only says which of them
    can be among the k: its error is bounded by the length.  Their cosines are taken in double precision
    and rounded to nine decimals.
    """
    spark = vectors.sparkSession
    rows = blocks.numbered(vectors.select(key, "kind", "vector"), key)
    n, width = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    slices = max(1, -(-n * width * 8 // slice_bytes), -(-n * k * 16 // blocks.HELD_BYTES))
    query_type = queries.schema["query_id"].dataType.simpleString()
    parts = []
    for s in range(slices):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(slices)) == s) if slices > 1 else queries
        table = part.select("query_id", "kind", "vector").toArrow().combine_chunks()  # bounded by slice_bytes
        ids, values = (pa.concat_arrays(table.column(c).chunks) if table.num_rows else pa.array([], table.schema.field(c).type) for c in ("query_id", "vector"))
        kinds, sizes = np.array(table.column("kind").to_pylist(), dtype=object), values.value_lengths().to_numpy()
        groups, names = [], []
        for kind, size in dict.fromkeys(zip(kinds.tolist(), sizes.tolist(), strict=True)):
            at = pa.array(np.nonzero((kinds == kind) & (sizes == size))[0])
            groups.append((kind, size, _units(values.take(at)), len(names)))
            names += blocks.in_blocks(ids.take(at))
        known, known_ids = spark.sparkContext.broadcast(groups), spark.sparkContext.broadcast(names)

        def scan(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            best = [blocks.Best(len(q), k) for _, _, q, _ in known.value]
            last_key, last_number = None, 0
            for b in batches:
                keys, numbers = b.column(0).to_pylist(), b.column(3).to_numpy().copy()
                again = np.zeros(len(keys), dtype=bool)  # rows of the key before: they count under its number
                for i, x in enumerate(keys):
                    if x == last_key:
                        again[i], numbers[i] = True, last_number
                    else:
                        last_key, last_number = x, numbers[i]
                kinds, sizes = np.array(b.column(1).to_pylist(), dtype=object), b.column(2).value_lengths().to_numpy()
                for (kind, size, q, _), held in zip(known.value, best, strict=True):
                    for repeated in (False, True):
                        at = np.nonzero((kinds == kind) & (sizes == size) & (again == repeated))[0]
                        if len(at):
                            _compare(q, _units(b.column(2).take(pa.array(at))), numbers[at], held, not repeated)
            for (_, _, _, first), held in zip(known.value, best, strict=True):
                yield from held.packed(first)

        packed = rows.select(key, "kind", "vector", "number").mapInArrow(scan, "block int, scores binary, numbers binary")
        parts.append(blocks.merged(packed, k, known_ids, query_type))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    found = found.distinct().join(rows.select("number", key), "number").select("query_id", key, "score")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _compare(q: np.ndarray, x: np.ndarray, numbers: np.ndarray, best: blocks.Best, distinct: bool) -> None:
    """Adds to ``best`` what of ``x`` may be among the best of ``q``; rows of ``distinct`` keys may also raise the bar."""
    error = (x.shape[1] + 8) * 2.0**-23 + blocks.SLACK  # of a cosine in single precision, twice over
    x32 = x.astype(np.float32)
    for i in range(0, len(q), TILE):
        part = q[i : i + TILE]
        q32, least, found = part.astype(np.float32), best.least[i : i + TILE], []
        for j in range(0, len(x), COLUMNS):
            s = q32 @ x32[j : j + COLUMNS].T
            if distinct and not np.isfinite(least).all():
                least = np.maximum(least, blocks.bar(s, best.k) - error)
            rows, columns = np.divmod(np.flatnonzero(s >= (least - error).astype(np.float32)[:, None]), s.shape[1])
            found.append((rows, columns + j))
        rows, columns = (np.concatenate(f) for f in zip(*found, strict=True))
        if len(rows):
            scores = np.rint(np.einsum("ij,ij->i", part[rows], x[columns]) * blocks.UNIT).astype(np.int64)
            best.add(i, i + TILE, rows, scores, numbers[columns])


def relative_gate(hits: DataFrame, floor: float, margin: float) -> DataFrame:
    """``hits`` with ``effective_floor`` and ``admitted``.

    Where the best score of a query clears the floor and the margin is positive, the floor falls to
    ``min(floor, best - margin)``; where nothing clears it, nothing is admitted below it.
    """
    best = F.max("score").over(W.partitionBy("query_id"))
    effective = F.when((F.lit(margin) > 0) & (best >= floor), F.least(F.lit(floor), F.round(best - margin, 9))).otherwise(F.lit(floor))
    return hits.withColumn("effective_floor", effective).withColumn("admitted", F.col("score") >= F.col("effective_floor"))
