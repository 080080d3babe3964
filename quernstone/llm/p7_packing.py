"""Problem 7: fill containers of fixed capacity with items, by bin completion.

The largest open document is put into a container and its undominated fillings are enumerated, the
fullest first; branches whose waste exceeds what a better packing could afford are cut.  A best-fit
packing is the incumbent, and stays where the search does not beat it.  The search may be limited, as
packing is hard; each packing tells whether it is proven to be the least possible.
"""

import base64
import math
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.sources import read_table

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenization pattern of the byte-level vocabularies, in the form Rust's and Python's regex both take.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents that are packed together; a group wastes at most one partly filled container.
GROUP_ROWS = 2048


@dataclass(frozen=True)
class Limits:
    """How far a search goes: fillings kept of a container, steps to enumerate them, containers tried; None for no limit."""

    fillings: int | None = 6
    filling_nodes: int | None = 400
    search_nodes: int | None = 4000


UNLIMITED = Limits(None, None, None)



@lru_cache(4)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def token_counts(texts: DataFrame, tokenizer: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """``(doc_id, tokens)`` by the vocabulary file ``tokenizer``, else the one the setting ``quernstone.tokenizer`` names, else the usual one; null and empty texts have no tokens.  The vocabulary file is read on the driver and sent to the tasks (under 2 MB)."""
    with open(tokenizer or texts.sparkSession.conf.get("quernstone.tokenizer", TOKENIZER), "rb") as f:
        ranks = texts.sparkSession.sparkContext.broadcast(f.read())
    schema = pa.schema([("doc_id", pa.int64()), ("tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(ranks.value, pattern).encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(sizes, pa.int64())], schema=schema)

    return texts.select("doc_id", "text").mapInArrow(count, "doc_id long, tokens long")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers of positions of ``sizes``: largest first, each into the fullest container that has room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room left, container), sorted
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        k = bisect_left(room, (sizes[i], -1))
        if k == len(room):
            bins.append([i])
            left = capacity - sizes[i]
            b = len(bins) - 1
        else:
            left, b = room.pop(k)
            bins[b].append(i)
            left -= sizes[i]
        if left:
            insort(room, (left, b))
    return bins


def least_bins(sizes: list[int], capacity: int) -> int:
    """A lower bound on the containers: Martello and Toth's L2 over the thresholds that occur."""
    ordered = sorted(sizes)
    total = [0]
    for s in ordered:
        total.append(total[-1] + s)
    n, best = len(ordered), -(-total[-1] // capacity)
    half = bisect_right(ordered, capacity // 2)
    for k in sorted(set(ordered[:half])):
        big, low = bisect_right(ordered, capacity - k), bisect_left(ordered, k)
        free = (n - half) * capacity - (total[n] - total[half]) - ((n - big) * capacity - (total[n] - total[big]))
        best = max(best, n - half + max(0, -(-(total[half] - total[low] - free) // capacity)))
    return best


def fillings(sizes: list[int], counts: Counter, room: int, limits: Limits = Limits()) -> tuple[list[tuple[int, ...]], bool]:
    """Ways to fill ``room`` with the open ``sizes`` (sorted, distinct), the least waste first, and whether these are all that count.

    A filling is dropped if an open item left out could replace one of its items, or two of them, and
    fill more without exceeding the room: whatever packs with the dropped filling packs with that one.
    A filling that only three items or more could replace stays, which costs time and loses nothing.
    """
    out: list[tuple[int, tuple[int, ...]]] = []
    used: Counter = Counter()
    limit = limits.fillings
    budget = math.inf if limits.filling_nodes is None else limits.filling_nodes
    cut = False

    def dominated(chosen: list[int], left: int) -> bool:
        for x in set(chosen):
            k = bisect_right(sizes, x + left)
            while k and sizes[k - 1] > x:
                if counts[sizes[k - 1]] > used[sizes[k - 1]]:
                    return True
                k -= 1
        for i, x in enumerate(chosen):
            for y in chosen[i + 1 :]:
                k = bisect_right(sizes, x + y + left)
                while k and sizes[k - 1] >= x + y:
                    if counts[sizes[k - 1]] > used[sizes[k - 1]]:
                        return True
                    k -= 1
        return False

    def go(left: int, top: int, chosen: list[int]) -> bool:
        """Whether to go on; ``top`` bounds the index of the next size."""
        nonlocal budget, cut
        budget -= 1
        k = min(top, bisect_right(sizes, left))
        fits = False
        while k:
            k -= 1
            s = sizes[k]
            if counts[s] > used[s]:
                fits = True
                used[s] += 1
                chosen.append(s)
                on = go(left - s, k + 1, chosen)
                chosen.pop()
                used[s] -= 1
                if not on:
                    return False
        if not fits and not any(counts[s] > used[s] for s in sizes[: bisect_right(sizes, left)]):
            if not dominated(chosen, left):
                out.append((left, tuple(chosen)))
            if left == 0 and limit is not None and len(out) >= limit:
                cut = True
                return False
        cut = cut or budget <= 0
        return budget > 0

    go(room, len(sizes), [])
    found = [f for _, f in sorted(dict.fromkeys(out), key=lambda x: (x[0], len(x[1])))]
    return found[:limit], not cut and (limit is None or len(found) <= limit)


def bin_completion(sizes: list[int], capacity: int, limits: Limits = Limits()) -> tuple[list[list[int]], bool]:
    """A packing with no more containers than best fit and as few as the search reaches, and whether fewer are proven impossible."""
    incumbent = best_fit(sizes, capacity)
    bound = least_bins(sizes, capacity)
    if len(incumbent) <= bound:
        return incumbent, True
    whole = True
    counts, total = Counter(sizes), sum(sizes)
    best: list[tuple[int, ...]] | None = None
    target = len(incumbent) - 1  # containers to do with
    stack: list[tuple[Iterator[tuple[int, ...]], int, tuple[int, ...] | None]] = []
    order = sorted(counts)
    waste, placed = 0, []

    def take(items: tuple[int, ...], sign: int) -> None:
        for s in items:
            had = counts[s]
            counts[s] += sign
            if not counts[s]:
                del order[bisect_left(order, s)]
            elif not had:
                insort(order, s)

    def options() -> Iterator[tuple[int, ...]]:
        nonlocal whole
        largest = order[-1]
        take((largest,), -1)
        found, every = fillings(order, counts, capacity - largest, limits)
        take((largest,), 1)
        whole = whole and every
        return iter([(largest, *f) for f in found])

    nodes = 0
    stack.append((options(), 0, None))
    while stack and (limits.search_nodes is None or nodes < limits.search_nodes):
        choices, before, last = stack[-1]
        if last is not None:
            take(last, 1)
            placed.pop()
            stack[-1] = (choices, before, None)
        waste = before
        filling = next(choices, None)
        if filling is None:
            stack.pop()
            continue
        nodes += 1
        spoiled = waste + capacity - sum(filling)
        if spoiled > target * capacity - total:
            continue  # later fillings waste more, but are few
        take(filling, -1)
        placed.append(filling)
        stack[-1] = (choices, before, filling)
        if not order:
            best = list(placed)
            if len(best) <= bound:
                break
            target = len(best) - 1
            continue
        if len(placed) < target:
            stack.append((options(), spoiled, None))
    proven = whole and not stack
    if best is None:
        return incumbent, proven
    proven = proven or len(best) <= bound
    of_size: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        of_size.setdefault(s, []).append(i)
    return [[of_size[s].pop() for s in filling] for filling in best], proven


_PACKED = pa.schema([("doc_id", pa.int64()), ("piece_index", pa.int32()), ("start_token", pa.int64()), ("tokens", pa.int64()), ("container", pa.int64()), ("proven", pa.bool_())])


def pack(sized: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, count: int | None = None, limits: Limits = Limits()) -> DataFrame:
    """``(doc_id, piece_index, start_token, tokens, container, proven)`` for rows ``(doc_id, tokens)``.

    - A text within the capacity is one piece; a larger one is cut into full pieces and a rest, and only then.
    - Texts without tokens take no room and go into the first container of their group; null ids and counts give no rows; repeated
      ids count once, with the most tokens given for them.
    - Texts are spread by hash over groups of about ``group_rows``, so the work of a task is bounded at any size and no key is hot; every
      group leaves at most one container that is not nearly full.
    - ``proven`` says whether no fewer containers could hold the texts of the group; ``limits`` bound the search for fewer.
    - ``count`` is the number of rows where it is known, which spares counting them (and their tokens) first.
    """
    rows = sized.where("doc_id IS NOT NULL AND tokens IS NOT NULL").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
    groups = max(1, -(-(sized.count() if count is None else count) // group_rows))

    def run(table: pa.Table) -> pa.Table:
        docs, tokens = table.column("doc_id").to_pylist(), table.column("tokens").to_pylist()
        group = table.column("g")[0].as_py()
        pieces = [(d, k, k * capacity, min(capacity, t - k * capacity)) for d, t in sorted(zip(docs, tokens, strict=True)) for k in range(max(1, -(-t // capacity)))]
        some = [p for p in pieces if p[3]]
        bins, proven = bin_completion([p[3] for p in some], capacity, limits) if some else ([], True)
        rows = [(*some[i], (group << 32) + b, proven) for b, items in enumerate(bins) for i in items]
        rows += [(*p, group << 32, proven) for p in pieces if not p[3]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED)

    spread = rows.withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    return spread.groupBy("g").applyInArrow(run, "doc_id long, piece_index int, start_token long, tokens long, container long, proven boolean")


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents")
    return pack(token_counts(documents), count=documents.count())


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every text of documents, or the pieces of one larger than a container, with its container."""
    return _packed(spark, folder)


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are, and how many belong to groups proven to need them all."""
    of = _packed(spark, folder).groupBy("container").agg(F.sum("tokens").alias("t"), F.bool_and("proven").alias("proven"))
    return of.agg(F.count_if("proven").alias("proven_containers"), F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.ceil(F.sum("t") / CAPACITY).alias("least_containers"), F.max("t").alias("fullest"), F.round(F.avg(F.col("t") / CAPACITY), 6).alias("mean_fill"))


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill}
ORACLES: dict[str, str] = {}
