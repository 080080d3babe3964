"""The best k rows a query, kept by each task while it scans and passed on as packed blocks of queries."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.plans.stages import cut

#: Queries of one packed row.
BLOCK = 1024
#: Bytes of answers that a task holds while it scans; more queries are worked off in slices.
HELD_BYTES = 128 << 20
#: Scores are whole numbers of 1e-9, so that equal ones are equal after any order of summing.
UNIT = 1e9
#: How far a score may lie from its rounded one.
SLACK = 2e-9
NONE = np.iinfo(np.int64).min
PACKED = pa.schema([("block", pa.int32()), ("scores", pa.binary()), ("numbers", pa.binary())])


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``number``, which grows with ``key``: sorted ranges, one a core, written once to the shared checkpoint folder.

    Rows of one key lie in one range, one after the other.  What a scan passes on grows with the ranges.
    """
    ranges = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    return cut(rows.repartitionByRange(ranges, key).sortWithinPartitions(key).withColumn("number", F.monotonically_increasing_id()))


class Best:
    """The ``k`` rows of highest score of each of ``n`` queries so far, equal scores by the smaller number, each row and score once."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores, self.numbers = np.full((n, k), NONE), np.zeros((n, k), dtype=np.int64)
        #: The k-th best score; -inf where there are fewer.
        self.least = np.full(n, -np.inf)

    def add(self, first: int, last: int, query: np.ndarray, score: np.ndarray, number: np.ndarray) -> None:
        """Takes rows of the queries ``first`` to ``last``; ``query`` counts from ``first``, ``score`` is in units of 1e-9."""
        held_q, held_at = np.nonzero(self.scores[first:last] != NONE)
        query = np.concatenate((held_q, query))
        score = np.concatenate((self.scores[first:last][held_q, held_at], score))
        number = np.concatenate((self.numbers[first:last][held_q, held_at], number))
        order = np.lexsort((number, -score, query))
        query, score, number = query[order], score[order], number[order]
        new = np.ones(len(query), dtype=bool)
        new[1:] = (query[1:] != query[:-1]) | (score[1:] != score[:-1]) | (number[1:] != number[:-1])
        query, score, number = query[new], score[new], number[new]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        at = (first + query[kept], place[kept])
        self.scores[at], self.numbers[at] = score[kept], number[kept]
        full = self.scores[first:last, -1]
        self.least[first:last] = np.where(full != NONE, full / UNIT, -np.inf)

    def packed(self, first_block: int) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.scores), BLOCK):
            if (self.scores[i : i + BLOCK] != NONE).any():
                yield pa.RecordBatch.from_arrays([pa.array([first_block + i // BLOCK], pa.int32()), pa.array([self.scores[i : i + BLOCK].tobytes()], pa.binary()), pa.array([self.numbers[i : i + BLOCK].tobytes()], pa.binary())], schema=PACKED)


def merged(packed: DataFrame, k: int, ids, query_type: str) -> DataFrame:
    """``(query_id, number, score)``: the best k of all tasks' packed rows; ``ids`` is a broadcast of the queries' ids by block."""

    def run(table: pa.Table) -> pa.Table:
        q_ids = ids.value[table.column("block")[0].as_py()]
        best = Best(len(q_ids), k)
        for scores, numbers in zip(table.column("scores"), table.column("numbers"), strict=True):
            s, n = (np.frombuffer(x.as_buffer(), dtype=np.int64).reshape(len(q_ids), k) for x in (scores, numbers))
            query, at = np.nonzero(s != NONE)
            best.add(0, len(q_ids), query, s[query, at], n[query, at])
        query, at = np.nonzero(best.scores != NONE)
        return pa.table({"query_id": q_ids.take(pa.array(query)), "number": best.numbers[query, at], "score": best.scores[query, at] / UNIT})

    return packed.groupBy("block").applyInArrow(run, f"query_id {query_type}, number long, score double")


def in_blocks(ids: pa.Array) -> list[pa.Array]:
    return [ids.take(pa.array(range(i, min(i + BLOCK, len(ids))))) for i in range(0, len(ids), BLOCK)]  # copies: a slice would travel with the whole


def bar(scores: np.ndarray, k: int) -> np.ndarray:
    """A score for each row of ``scores`` that k of its columns reach at least; -inf where there are fewer columns.

    The columns are dealt to groups, and the k-th best of the groups' maxima is reached by k columns: one
    pass over the block in place of a sort.
    """
    columns = scores.shape[1]
    groups = 4 * k
    depth = columns // groups
    if depth < 2:
        return np.partition(scores, columns - k, axis=1)[:, columns - k] if columns >= k else np.full(len(scores), -np.inf)
    most = scores[:, : depth * groups].reshape(len(scores), depth, groups).max(axis=1)
    return np.partition(most, groups - k, axis=1)[:, groups - k]
