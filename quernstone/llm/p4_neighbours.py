"""Problem 4: the most similar vectors for every vector, by a hierarchical k-means tree.

The tree is fitted on a bounded sample; every row is put into its leaf.  A query visits leaves best
bin first: the most promising node of a priority queue is opened, and its children are queued, until
enough leaves were visited.  How many are enough is calibrated against brute force on a sample of
queries, widening until the wanted recall is reached.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quernstone.sources import read_table

NEIGHBOURS = 5
MINIMUM_COSINE = 0.75
#: Rows the tree is fitted on at most, per model; every row is indexed.
FIT_ROWS = 24_576
#: Rows of a leaf that are aimed at, and branches of a node.
LEAF_ROWS = 4096
BRANCHES = 12
#: Queries that are compared with all rows to calibrate the leaf visits, and the recall wanted.
CALIBRATION_QUERIES = 384
WANTED_RECALL = 0.975
#: Leaf visits that calibration looks at first; it goes on to four times as many until the recall is reached.
FIRST_REACH = 64
MOST_TASKS = 20_000
#: A leaf of more rows than this (expected from the sample) is worked on in blocks.
BLOCK_ROWS = 16384
DIGITS = 9


def spherical_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """``k`` (or fewer) unit centres of the unit rows ``x``."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        order = np.argsort(own, kind="stable")
        counts = np.bincount(own, minlength=len(centres))
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        full = counts > 0
        centres[full] = np.add.reduceat(x[order], starts[full], axis=0)
        norms = np.linalg.norm(centres, axis=1, keepdims=True)
        centres /= np.where(norms > 0, norms, 1)
    return centres[full]


@dataclass
class Tree:
    """Nodes in one table; ``children[i]`` are the rows of node i's children, none for a leaf."""

    centres: np.ndarray
    children: list[np.ndarray]
    leaf_of: np.ndarray  # leaf number of a node, -1 for inner nodes
    blocks: np.ndarray = field(default_factory=lambda: np.ones(1, dtype=np.int64))  # blocks of each leaf

    @property
    def leaves(self) -> int:
        return int(self.leaf_of.max()) + 1

    def visits(self, x: np.ndarray, count: int) -> np.ndarray:
        """The first ``count`` leaves that each unit row of ``x`` visits, best bin first; -1 where there are no more."""
        return np.concatenate([self._visits(x[i : i + 1024], count) for i in range(0, len(x), 1024)]) if len(x) else np.empty((0, count), dtype=np.int64)

    def _visits(self, x: np.ndarray, count: int) -> np.ndarray:
        queue = np.full((len(x), len(self.children)), -np.inf, dtype=np.float32)  # the priority of every queued node
        top = self.children[0]
        queue[:, top] = x @ self.centres[top].T
        out = np.full((len(x), count), -1, dtype=np.int64)
        visited = np.zeros(len(x), dtype=np.int64)
        active = np.arange(len(x))
        while len(active):
            best = queue[active].argmax(axis=1)
            open_ = queue[active, best] > -np.inf
            active, best = active[open_], best[open_]
            queue[active, best] = -np.inf
            leaf = self.leaf_of[best]
            hit = leaf >= 0
            rows = active[hit]
            out[rows, visited[rows]] = leaf[hit]
            visited[rows] += 1
            for node in np.unique(best[~hit]):
                rows = active[~hit][best[~hit] == node]
                queue[np.ix_(rows, self.children[node])] = x[rows] @ self.centres[self.children[node]].T
            active = active[visited[active] < count]
        return out


def fit_tree(sample: np.ndarray, rows: int, leaf_rows: int = LEAF_ROWS, branches: int = BRANCHES, seed: int = 7) -> Tree:
    """A tree over unit rows of which ``sample`` is a share, for ``rows`` rows in all."""
    rng = np.random.default_rng(seed)
    centres, children, leaf_of, shares = [sample.mean(axis=0)], [np.empty(0, dtype=np.int64)], [-1], []
    pending = [(0, sample)]
    scale = rows / max(1, len(sample))
    while pending:
        node, x = pending.pop()
        pieces = min(branches, round(len(x) * scale / leaf_rows))
        if pieces < 2 or len(x) < 4 * pieces:
            if node == 0:  # the root is never a leaf itself
                centres.append(centres[0])
                children.append(np.empty(0, dtype=np.int64))
                leaf_of.append(0)
                children[0] = np.array([1])
            else:
                leaf_of[node] = len(shares)
            shares.append(len(x) * scale)
            continue
        means = spherical_means(x, pieces, rng)
        own = (x @ means.T).argmax(axis=1)
        filled = [i for i in range(len(means)) if (own == i).any()]
        if len(filled) < 2:  # equal rows cannot be told apart
            pieces = 1
            centres.append(means[0])
            children.append(np.empty(0, dtype=np.int64))
            leaf_of.append(len(shares))
            children[node] = np.array([len(centres) - 1])
            shares.append(len(x) * scale)
            continue
        first = len(centres)
        for i in filled:
            centres.append(means[i])
            children.append(np.empty(0, dtype=np.int64))
            leaf_of.append(-1)
        children[node] = np.arange(first, len(centres))
        pending += [(first + k, x[own == i]) for k, i in enumerate(filled)]
    blocks = np.maximum(1, np.ceil(np.array(shares) / BLOCK_ROWS)).astype(np.int64)
    return Tree(np.array(centres, dtype=np.float32), children, np.array(leaf_of), blocks)


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a batch, all of one length, as rows."""
    values = column.flatten() if isinstance(column, pa.ListArray) else column
    return values.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    wide = x.astype(np.float64)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, model, vector)`` of non-null, finite, non-zero vectors; other columns are left out.

    ``model`` is the embedding model and the vector's length, as vectors of two lengths have no cosine.
    """
    v = vectors.select("vec_id", F.col("embedding_model").alias("_m"), F.col("vector").cast("array<float>").alias("vector"))
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("_m").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    return v.select("vec_id", F.concat_ws("/", "_m", F.size("vector").cast("string")).alias("model"), "vector")


def _by_model(b: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """``(model, ids, vectors)`` for each model of a batch of (vec_id, model, vector)."""
    names = np.array(b.column(1).to_pylist(), dtype=object)
    for model in dict.fromkeys(names.tolist()):
        part = b.filter(pa.array(names == model))
        yield model, part.column(0).to_numpy(), _matrix(part.column(2))


def _least_copies(ids: np.ndarray, x: np.ndarray, keep: int) -> np.ndarray:
    """Positions of the ``keep`` smallest distinct ids of each group of equal vectors."""
    order = np.argsort(ids, kind="stable")
    seen: dict[bytes, int] = {}
    out, last = [], None
    for i in order.tolist():
        key = x[i].tobytes()
        if (ids[i], key) == last:
            continue
        last = (ids[i], key)
        n = seen.get(key, 0)
        if n < keep:
            out.append(i)
        seen[key] = n + 1
    return np.array(out, dtype=np.int64)


_PLACED = pa.schema([("leaf", pa.int64()), ("is_query", pa.bool_()), ("member", pa.bool_()), ("vec_id", pa.int64()), ("vector", pa.binary())])
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cosine", pa.float64())])


class Index:
    """What tasks need to place vectors: the tree of each model, and a number for each of its leaf blocks."""

    def __init__(self, trees: dict[str, Tree], visits: dict[str, int]):
        self.trees, self.visits, self.first = trees, visits, {}
        total = 0
        for model, tree in trees.items():
            self.first[model] = total + np.concatenate(([0], np.cumsum(tree.blocks)[:-1]))
            total += int(tree.blocks.sum())

    def placed(self, model: str, ids: np.ndarray, x: np.ndarray, asked: np.ndarray) -> list[np.ndarray | list[bytes]]:
        """Rows (leaf block, is_query, member, vec_id, vector): one as a member, and one for every other block a query visits."""
        tree, first = self.trees[model], self.first[model]
        seen = tree.visits(_unit(x), self.visits[model])
        own_block = np.abs(ids) % tree.blocks[seen[:, 0]]
        home = first[seen[:, 0]] + own_block
        parts = [(home, np.arange(len(ids)), asked, np.ones(len(ids), dtype=bool))]
        for k in range(seen.shape[1]):
            rows = np.nonzero(asked & (seen[:, k] >= 0))[0]
            leaf = seen[rows, k]
            for block in range(int(tree.blocks[leaf].max()) if len(rows) else 0):
                m = (tree.blocks[leaf] > block) & ~((k == 0) & (own_block[rows] == block))
                parts.append((first[leaf[m]] + block, rows[m], np.ones(int(m.sum()), dtype=bool), np.zeros(int(m.sum()), dtype=bool)))
        leaves, rows, queries, members = (np.concatenate([p[i] for p in parts]) for i in range(4))
        raw = np.ascontiguousarray(x, dtype=np.float32)
        data = [raw[i].tobytes() for i in range(len(raw))]
        return [leaves, queries, members, ids[rows], [data[i] for i in rows.tolist()]]


def _leaf_search(k: int, floor: float, symmetric: bool):
    """The work on one leaf block: each query's best members and, where all rows are queries, each member's best queries."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, query, member = table.column("vec_id").to_numpy(), table.column("is_query").to_numpy(), table.column("member").to_numpy()
        x = np.frombuffer(b"".join(table.column("vector").to_pylist()), dtype=np.float32).reshape(len(ids), -1)
        order = np.argsort(~member, kind="stable")  # a row that is a member stays so, when equal rows are dropped
        ids, query, member, x = ids[order], query[order], member[order], x[order]
        m = np.nonzero(member)[0]
        m = m[_least_copies(ids[m], x[m], k + 1)]
        q = np.nonzero(query)[0]
        _, once = np.unique(ids[q], return_index=True)
        q = q[once]
        wide = x.astype(np.float64)
        wide /= np.linalg.norm(wide, axis=1, keepdims=True)
        unit = wide.astype(np.float32)
        rows: list[tuple[np.ndarray, np.ndarray]] = []
        for i in range(0, len(q), 1024):
            part = q[i : i + 1024]
            s = unit[part] @ unit[m].T
            s[ids[part][:, None] == ids[m][None, :]] = -2
            rows += [(part[a], m[b]) for a, b in (_best(s, k, floor), *([_best(s.T, k, floor)[::-1]] if symmetric else []))]
        a = np.concatenate([r[0] for r in rows]) if rows else np.empty(0, dtype=np.int64)
        b = np.concatenate([r[1] for r in rows]) if rows else np.empty(0, dtype=np.int64)
        cosine = np.round(np.einsum("ij,ij->i", wide[a], wide[b]), DIGITS)
        if symmetric:
            pairs = np.unique(np.stack([ids[a], ids[b]], axis=1), axis=0, return_index=True)[1] if len(a) else np.empty(0, dtype=np.int64)
            a, b, cosine = a[pairs], b[pairs], cosine[pairs]
            a, b, cosine = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([cosine, cosine])
        keep = cosine >= floor
        return pa.Table.from_arrays([pa.array(ids[a[keep]]), pa.array(ids[b[keep]]), pa.array(cosine[keep])], schema=_FOUND)

    return run


def _best(s: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of every entry among the k best of its row (ties at single precision included) and not below the floor."""
    near = s >= floor - np.float32(2e-6)
    per_row = near.sum(axis=1)
    if s.shape[1] > k and 8 * int((per_row > k).sum()) < len(s):  # few rows have more than k entries to choose from
        for i in np.nonzero(per_row > k)[0].tolist():
            at = np.nonzero(near[i])[0]
            near[i, at] = s[i, at] >= np.partition(s[i, at], -k)[-k] - np.float32(2e-6)
        return np.nonzero(near)
    if s.shape[1] > k:
        bound = np.partition(s, -k, axis=1)[:, -k]
        return np.nonzero(s >= np.maximum(bound, floor)[:, None] - np.float32(2e-6))
    return np.nonzero(near)


def _take(rows: DataFrame, fraction: float, most: int, seed: int) -> DataFrame:
    """About ``fraction`` of the rows, the same ones each time, by a hash of the id; at most ``most``."""
    return rows.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1_000_000)) < int(fraction * 1_000_000) + 1).limit(most)


def _sampled(good: DataFrame, model: str, rows: int, most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    t = _take(good.where(F.col("model") == model), most / rows, most, seed).toArrow()  # bounded by most
    ids, x = t.column("vec_id").to_numpy(), _matrix(t.column("vector").combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.float32())))
    _, once = np.unique(ids, return_index=True)
    return ids[once], x[once]


def _truth(good: DataFrame, index: Index, samples: dict[str, tuple[np.ndarray, np.ndarray]], k: int, most_visits: int) -> list:
    """For sampled queries, their k most similar rows by brute force, with the leaves these rows would visit."""
    sc = good.sparkSession.sparkContext
    known = sc.broadcast((index, samples))
    schema = pa.schema([("model", pa.string()), ("q", pa.int64()), ("b", pa.int64()), ("cosine", pa.float64()), ("leaves", pa.list_(pa.int64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, samples = known.value
        for batch in batches:
            rows: list[tuple] = []
            for model, ids, x in _by_model(batch):
                q_ids, q = samples[model]
                keep = _least_copies(ids, x, k + 1)
                ids, x = ids[keep], x[keep]
                s = _unit(q) @ _unit(x).T
                s[q_ids[:, None] == ids[None, :]] = -2
                one, two = _best(s, k, -1.5)
                wide_q, wide = q.astype(np.float64), x.astype(np.float64)
                cosine = np.einsum("ij,ij->i", wide_q[one], wide[two]) / np.linalg.norm(wide_q[one], axis=1) / np.linalg.norm(wide[two], axis=1)
                needed, back = np.unique(two, return_inverse=True)
                leaves = index.trees[model].visits(_unit(x[needed]), most_visits).tolist() if len(needed) else []
                rows += [(model, int(q_ids[i]), int(ids[j]), float(round(c, DIGITS)), leaves[n]) for i, j, c, n in zip(one.tolist(), two.tolist(), cosine.tolist(), back.tolist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    found = good.mapInArrow(scan, "model string, q long, b long, cosine double, leaves array<long>").dropDuplicates(["model", "q", "b"])
    order = W.partitionBy("model", "q").orderBy(F.col("cosine").desc(), "b")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r").collect()  # k rows for each sampled query


def calibrated(tree: Tree, q_ids: np.ndarray, q: np.ndarray, truth: list, floor: float, wanted: float, symmetric: bool, most: int) -> tuple[int, float]:
    """The least number of leaf visits whose recall on the sampled queries reaches ``wanted``, and that recall."""
    seen = dict(zip(q_ids.tolist(), tree.visits(_unit(q), most).tolist(), strict=True))
    pairs = [(seen[r.q], r.leaves) for r in truth if r.cosine >= floor and r.q in seen]
    if not pairs:
        return 1, 1.0
    recall = 0.0
    for count in range(1, most + 1):
        got = sum(other[0] in own[:count] or symmetric and own[0] in other[:count] for own, other in pairs)
        recall = got / len(pairs)
        if recall >= wanted:
            return count, recall
    return most, recall


@dataclass
class Search:
    found: DataFrame  # (a, b, cosine): at most k rows of each query a
    recall: dict[str, tuple[int, int, float]]  # by model: rows, leaf visits, recall on the calibration sample


def nearest(vectors: DataFrame, k: int = NEIGHBOURS, minimum_cosine: float = -1.0, queries: Column | None = None, wanted: float = WANTED_RECALL, fit_rows: int = FIT_ROWS, leaf_rows: int = LEAF_ROWS, most_visits: int = 0) -> Search:
    """For each query row (all rows by default) the k rows of its model with the highest cosine, not below ``minimum_cosine``.

    - Cosines are computed in double precision from the stored vectors and rounded to nine decimals; equal ones go to the smaller ``vec_id``.
    - Null, zero and non-finite vectors, null ids and models are neither queries nor answers.  An id given twice with equal vectors counts once.
    - Of equal vectors only the k + 1 smallest ids can be anyone's answer, so a group of copies of any size costs a leaf k + 1 members;
      the other copies get the k smallest as their answers directly.
    - The tree is fitted on at most ``fit_rows`` rows of each model and indexes every row.  Leaf visits are widened until the sampled
      queries' neighbours at or above ``minimum_cosine`` are found with recall ``wanted`` (at most ``most_visits`` leaves, 0 for all);
      the visits taken and the recall they reach are in ``recall``.
    - An empty table gives no rows.
    """
    spark = vectors.sparkSession
    good = usable(vectors)
    counts = {r[0]: r[1] for r in good.groupBy("model").count().collect()}  # a row per model
    symmetric = queries is None
    asked = F.lit(True) if symmetric else F.coalesce(queries, F.lit(False))
    trees, samples = {}, {}
    for model, n in counts.items():
        _, x = _sampled(good, model, n, fit_rows, 1)
        trees[model] = fit_tree(_unit(x), n, leaf_rows) if len(x) else fit_tree(_unit(_matrix(good.where(F.col("model") == model).limit(1).toArrow().column("vector").combine_chunks())), n, leaf_rows)
        ids, x = _sampled(good, model, n, CALIBRATION_QUERIES, 2)
        _, once = np.unique(x, axis=0, return_index=True)  # copies of a hot vector find one another whatever the visits
        samples[model] = ids[once], x[once]
    index = Index(trees, dict.fromkeys(trees, 1))
    recall: dict[str, tuple[int, int, float]] = {}
    most = {m: min(t.leaves, most_visits or t.leaves) for m, t in trees.items()}
    reach = {m: min(n, FIRST_REACH) if symmetric else n for m, n in most.items()}
    while pending := [m for m in trees if m not in recall]:
        truth = _truth(good.where(F.col("model").isin(pending)), index, samples, k, max(2, *(reach[m] for m in pending)) if symmetric else 1)
        for model in pending:
            count, got = calibrated(trees[model], *samples[model], [r for r in truth if r.model == model], minimum_cosine, wanted, symmetric, reach[model])
            if got >= wanted or reach[model] >= most[model]:
                index.visits[model] = count
                recall[model] = (counts[model], count, got)
            else:
                reach[model] = min(most[model], 4 * reach[model])
    shared = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            wanted_ids = b.column(3).to_numpy(zero_copy_only=False)
            names = np.array(b.column(1).to_pylist(), dtype=object)
            for model in dict.fromkeys(names.tolist()):
                part = np.nonzero(names == model)[0]
                sub = b.take(pa.array(part))
                ids, x, ask = sub.column(0).to_numpy(), _matrix(sub.column(2)), wanted_ids[part]
                keep = _least_copies(ids, x, k + 1)
                columns = index.placed(model, ids[keep], x[keep], ask[keep])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PLACED, strict=True)], schema=_PLACED)

    rows = good.select("vec_id", "model", "vector", asked.alias("asked")).mapInArrow(place, "leaf long, is_query boolean, member boolean, vec_id long, vector binary")
    # as many partitions as leaves, so that a task's share stays that of few leaves however many rows there are
    tasks = min(MOST_TASKS, sum(t.leaves for t in trees.values())) or 1
    found = rows.repartition(tasks, "leaf").groupBy("leaf").applyInArrow(_leaf_search(k, minimum_cosine, symmetric), "a long, b long, cosine double")
    found = found.union(_copies(good, asked, k))
    best = W.partitionBy("a").orderBy(F.col("cosine").desc(), "b")
    found = found.dropDuplicates(["a", "b"]).repartition("a").withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
    return Search(found.select("a", "b", "cosine", F.col("_r").alias("place")), recall)


def _copies(good: DataFrame, asked: Column, k: int) -> DataFrame:
    """Answers of copies beyond the k + 1 smallest ids of a group of equal vectors: its k smallest ids, at cosine 1.

    Groups are named by two hashes of the vector; batches give their k + 1 smallest ids first, so that
    a group of any size is never sorted as a whole.
    """
    named = good.select("vec_id", "model", F.xxhash64("model", "vector").alias("h1"), F.hash("vector", "model").alias("h2"), asked.alias("asked"))
    key = ["h1", "h2"]
    salted = named.groupBy(*key, F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("_s")).agg(F.count_distinct("vec_id").alias("n"))
    many = salted.groupBy(*key).agg(F.sum("n").alias("n")).where(F.col("n") > k + 1).select(*key)
    rows = named.join(many, key).select(*key, "vec_id", "asked").distinct()
    part = W.partitionBy(*key, F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    least = rows.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= k + 1)
    least = least.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    first = least.groupBy(*key).agg(F.array_sort(F.collect_list("vec_id")).alias("smallest"))  # k + 1 ids
    follow = rows.where("asked").join(first, key).where(F.col("vec_id") > F.element_at("smallest", -1))
    return follow.select(F.col("vec_id").alias("a"), F.explode(F.slice("smallest", 1, k)).alias("b"), F.lit(1.0).alias("cosine"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    found = nearest(read_table(spark, folder, "reuse_vectors"), minimum_cosine=MINIMUM_COSINE).found
    return found.select(F.least("a", "b").alias("vec_id_a"), F.greatest("a", "b").alias("vec_id_b")).distinct()


def p4_recall(spark: SparkSession, folder: str) -> DataFrame:
    """By model the rows, the leaf visits that p4_found takes, and their recall on the calibration queries."""
    recall = nearest(read_table(spark, folder, "reuse_vectors"), minimum_cosine=MINIMUM_COSINE).recall
    return spark.createDataFrame([(m, n, visits, float(got)) for m, (n, visits, got) in recall.items()], "embedding_model string, n_rows long, leaf_visits int, recall double")


def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest of every row whose id is divisible by 20, however low their cosine, against all rows."""
    found = nearest(read_table(spark, folder, "reuse_vectors"), queries=F.col("vec_id") % 20 == 0, wanted=0.95).found
    return found.select(F.col("a").alias("vec_id"), F.col("b").alias("neighbour_id"), "cosine", "place")


QUERIES = {"p4_found": p4_found, "p4_neighbours": p4_neighbours, "p4_recall": p4_recall}
ORACLES = {
    "p4_found": """
WITH v AS (SELECT DISTINCT vec_id, embedding_model AS m, vector::DOUBLE[] AS v FROM reuse_vectors WHERE vec_id IS NOT NULL AND embedding_model IS NOT NULL AND vector IS NOT NULL
  AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM v a JOIN v b ON a.m = b.m AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY s DESC, y) AS r FROM p)
SELECT DISTINCT least(x, y) AS vec_id_a, greatest(x, y) AS vec_id_b FROM r WHERE r <= 5 AND s >= 0.75""",
}
