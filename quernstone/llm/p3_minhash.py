"""Problem 3: near-duplicate records with small edits, by b-bit MinHash.

Band keys of full minima propose candidates; the minima themselves are reduced to their low bits
and packed, and the similarity of a candidate is estimated from a bit count, corrected for the
collisions that low bits have by chance.  Candidates that the estimate cannot rule out are decided
on their shingle sets.  Records with the same shingle set form a class and are compared once.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quernstone.llm.wordstream import WORD, gram_hashes, mixed, stream
from quernstone.operators.components import connected_components
from quernstone.plans.stages import cut
from quernstone.sources import read_table

SHINGLE = 3
MINIMUM_WORDS = 40
THRESHOLD = 0.5
ROWS = 4
BANDS = 48
LOW_BITS = 2
#: Candidates whose estimate lies so many standard errors below the threshold are ruled out.
SLACK = 4.0
#: Buckets of more classes than this are compared in blocks, their signatures checked before any pair is emitted.
HOT_BUCKET = 128
BLOCK = 512
#: Classes of up to so many ids are written as all their pairs.  Of larger ones the copies of one text, equal byte for byte, are
#: written as links to the smallest id of that text, which stands for them in all pairs with other texts.
EXPAND = 256


def shingle_sets(texts: list[str], shingle: int, minimum: int) -> list[np.ndarray | None]:
    """The sorted distinct shingle hashes of each text; None for texts of fewer than ``minimum`` words."""
    hashes, offsets = stream([WORD.findall(t.lower()) if t else [] for t in texts])
    grams = gram_hashes(hashes, shingle)
    out: list[np.ndarray | None] = []
    for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        out.append(np.unique(grams[low : high - shingle + 1]) if high - low >= max(minimum, shingle) else None)
    return out


def set_key(s: np.ndarray) -> bytes:
    """16 bytes that name a shingle set."""
    a, b = mixed(s), mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return np.array([a.sum(dtype=np.uint64), b.sum(dtype=np.uint64)], dtype=np.uint64).tobytes()


class Sketcher:
    """Minima of ``count`` seeded hash functions over 32-bit shingle codes."""

    def __init__(self, count: int):
        rng = np.random.default_rng(20240501)
        self.a = (rng.integers(1, 1 << 31, size=(count, 1), dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, size=(count, 1), dtype=np.uint32)

    def minima(self, s: np.ndarray) -> np.ndarray:
        codes = (s >> np.uint64(32)).astype(np.uint32)[None, :]
        return (codes * self.a + self.b).min(axis=1).astype(np.uint64)


def band_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    """For each row of minima one 64-bit key per band, different for different bands."""
    table = mixed(minima).reshape(len(minima), -1, rows)
    out = np.broadcast_to(np.arange(1, table.shape[1] + 1, dtype=np.uint64), table.shape[:2])
    for j in range(rows):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + table[:, :, j])
    return out


def packed(minima: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of each row of minima as 64-bit words: bit plane after bit plane, 64 minima to a word."""
    low = mixed(minima)
    planes = [np.packbits(((low >> np.uint64(i)) & np.uint64(1)).astype(np.uint8), axis=1) for i in range(bits)]
    return np.ascontiguousarray(np.concatenate(planes, axis=1)).view(np.int64)


def estimated(a: Column, b: Column, count: int, bits: int) -> Column:
    """The collision-corrected similarity of two packed signatures, by counting the bits in which no plane differs.

    A minimum's low bits agree by chance with probability 2**-bits, so E[agreeing share] = c + (1 - c) J.
    """
    chance = 2.0**-bits
    words = count // 64
    differing = F.lit(0)
    for w in range(words):
        planes = [_word(a, p * words + w).bitwiseXOR(_word(b, p * words + w)) for p in range(bits)]
        any_plane = planes[0]
        for p in planes[1:]:
            any_plane = any_plane.bitwiseOR(p)
        differing = differing + F.bit_count(any_plane)
    share = 1 - differing / F.lit(float(count))
    return (share - chance) / (1 - chance)


def _word(a: Column, k: int) -> Column:
    return F.element_at(a, k + 1)


def slack_below(threshold: float, count: int, bits: int, errors: float) -> float:
    """The estimate below which a pair of similarity ``threshold`` falls only with ``errors`` standard errors."""
    chance = 2.0**-bits
    p = chance + (1 - chance) * threshold
    return threshold - errors * (p * (1 - p) / count) ** 0.5 / (1 - chance)


def _sketched(texts: DataFrame, shingle: int, minimum: int, rows: int, bands: int, bits: int) -> DataFrame:
    """``(chunk_id, member, text, signature, bands)`` of each text of enough words, in one pass over the texts.

    ``member`` is the first 8 bytes of the class, ``text`` a hash of the text as it stands.  Rows repeated in a batch are given once, and of each class a batch holds
    only one row has the packed signature and the band keys; the others have nulls there.
    """
    schema = pa.schema([("chunk_id", pa.string()), ("member", pa.int64()), ("text", pa.int64()), ("signature", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(rows * bands)
        for b in batches:
            found: dict[tuple[str, int, int], bool] = {}
            minima: dict[int, np.ndarray] = {}
            for i, s, text in zip(b.column(0).to_pylist(), shingle_sets(b.column(1).to_pylist(), shingle, minimum), b.column(2).to_pylist(), strict=True):
                if s is not None:
                    member = int.from_bytes(set_key(s)[:8], "little", signed=True)
                    if (new := member not in minima):
                        minima[member] = sketcher.minima(s)
                    found[i, member, text] = new or found.get((i, member, text), False)
            signatures, keys = [], []
            if minima:
                table = np.stack(list(minima.values()))
                signatures, keys = packed(table, bits), band_keys(table, rows).view(np.int64)
            place = {member: k for k, member in enumerate(minima)}
            heads = [place[member] if first else None for (_, member, _), first in found.items()]
            columns = [[i for i, _, _ in found], [member for _, member, _ in found], [text for _, _, text in found], [None if k is None else signatures[k] for k in heads], [None if k is None else keys[k] for k in heads]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return texts.select("chunk_id", "contents", F.xxhash64("contents").alias("text")).mapInArrow(run, "chunk_id string, member long, text long, signature array<long>, bands array<long>")


def _hot_pairs(rows: DataFrame, floor: float, count: int, bits: int) -> DataFrame:
    """Candidate pairs of hot buckets: members in blocks, each pair of blocks a task's work of its own, signatures checked in place."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    chance, words = 2.0**-bits, count // 64

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids = np.array(table.column("member").to_pylist(), dtype=np.int64)
        side = np.array(table.column("block").to_pylist(), dtype=np.int64)
        signs = np.array(table.column("signature").to_pylist(), dtype=np.int64).reshape(len(ids), bits, words).view(np.uint64)
        i, j = key[1].as_py(), key[2].as_py()
        left, right = np.nonzero(side == i)[0], np.nonzero(side == j)[0]
        out_a, out_b = [], []
        for x in left.tolist():
            differ = np.bitwise_or.reduce(signs[right] ^ signs[x][None], axis=1)
            share = 1 - np.bitwise_count(differ).sum(axis=1) / count
            y = right[(share - chance) / (1 - chance) >= floor]
            y = y[ids[y] > ids[x]] if i == j else y[ids[y] != ids[x]]
            out_a.append(np.minimum(ids[x], ids[y]))
            out_b.append(np.maximum(ids[x], ids[y]))
        a = np.concatenate(out_a) if out_a else np.empty(0, dtype=np.int64)
        b = np.concatenate(out_b) if out_b else np.empty(0, dtype=np.int64)
        return pa.Table.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("other", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return rows.select("band", "i", "j", "member", "block", "signature").groupBy("band", "i", "j").applyInArrow(run, "a long, b long")


def _decided(pairs: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """``pairs`` with the similarity of their texts, those under the threshold left out."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, one, two = (c.to_pylist() for c in b.columns)
            rows = []
            for p, q, s, t in zip(x, y, shingle_sets(one, shingle, 0), shingle_sets(two, shingle, 0), strict=True):
                both = len(np.intersect1d(s, t, assume_unique=True))
                if both >= threshold * (len(s) + len(t) - both):
                    rows.append((p, q, both / (len(s) + len(t) - both)))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")


def near_duplicates(texts: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, minimum: int = MINIMUM_WORDS, rows: int = ROWS, bands: int = BANDS, bits: int = LOW_BITS, hot: int = HOT_BUCKET) -> tuple[DataFrame, DataFrame]:
    """Members ``(chunk_id, class, text)`` and links ``(a, b, similarity)`` between classes of different shingle sets.

    - ``texts`` has ``chunk_id`` and ``contents``; other columns are ignored.  Null ids and texts, and
      texts of fewer than ``minimum`` words, are no members; repeated rows count once.
    - A class is named by 8 bytes of its shingle set, so copies, whatever their number, are one class.
    - An id with several texts belongs to several classes.
    - Every link found is exact; two classes at the threshold itself share a band with probability
      1 - (1 - threshold**rows)**bands (0.955 by default, 0.99 at 0.55, 0.999 at 0.6).
    - A bucket of any size is compared in full: small ones by a join, hot ones in blocks.
    """
    count = rows * bands
    least = 2 * minimum - 1
    texts = texts.select("chunk_id", "contents").where(F.col("chunk_id").isNotNull() & (F.octet_length("contents") >= least))
    sketched = cut(_sketched(texts, shingle, minimum, rows, bands, bits))
    members, heads = sketched.select("chunk_id", "member", "text"), sketched.where("signature IS NOT NULL")
    signs = heads.groupBy("member").agg(F.first("signature").alias("signature"), F.min("chunk_id").alias("chunk_id"))
    keyed = heads.select(F.explode("bands").alias("band"), "member").repartition("band").dropDuplicates(["band", "member"])
    shared = cut(keyed.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("band"))).where("n > 1"))
    cool = shared.where(F.col("n") <= hot).select("band", "member")
    left, right = cool.select("band", F.col("member").alias("a")), cool.select("band", F.col("member").alias("b"))
    pairs = left.join(right, "band").where("a < b").select("a", "b").distinct()
    floor = slack_below(threshold, count, bits, SLACK)
    sign_a, sign_b = (signs.select(F.col("member").alias(x), F.col("signature").alias(f"s_{x}"), F.col("chunk_id").alias(f"chunk_{x}")) for x in "ab")
    pairs = pairs.join(sign_a, "a").join(sign_b, "b").where(estimated(F.col("s_a"), F.col("s_b"), count, bits) >= floor).select("a", "b")
    warm = shared.where(F.col("n") > hot)
    if warm.limit(1).count():
        pairs = pairs.union(_hot_pairs(warm.join(signs.select("member", "signature"), "member"), floor, count, bits)).distinct()
    pairs = cut(pairs)
    wanted = pairs.select(F.col("a").alias("member")).union(pairs.select("b")).distinct()
    sources = signs.join(wanted, "member", "left_semi").select("member", "chunk_id")
    # an id may have several texts: the class is looked up again so that the text belongs to it
    bodies = texts.join(sources, "chunk_id").dropDuplicates(["chunk_id", "member", "contents"]).select("member", "contents")
    ambiguous = members.groupBy("chunk_id").agg(F.count_distinct("member").alias("k")).where("k > 1")
    bodies = bodies if not ambiguous.limit(1).count() else _own(bodies, shingle)
    text_a, text_b = (bodies.select(F.col("member").alias(x), F.col("contents").alias(f"text_{x}")) for x in "ab")
    links = _decided(pairs.join(text_a, "a").join(text_b, "b"), threshold, shingle)
    return members.select("chunk_id", F.col("member").alias("class"), "text").distinct(), links


def _own(bodies: DataFrame, shingle: int) -> DataFrame:
    """The texts whose shingle set is their class's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, sets = b.column(0).to_pylist(), shingle_sets(b.column(1).to_pylist(), shingle, 0)
            keep = [s is not None and int(np.frombuffer(set_key(s)[:8], dtype=np.int64)[0]) == m for m, s in zip(names, sets, strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return bodies.mapInArrow(run, bodies.schema)


def expanded(members: DataFrame, links: DataFrame, expand: int = EXPAND) -> DataFrame:
    """Pairs ``(chunk_id_a, chunk_id_b)``, the smaller id first, from classes and their links.

    Every pair of ids comes out but for copies in classes of more than ``expand`` ids: of the copies of
    one text the smallest id stands for all, and the others are linked to it.  So no pair of different
    texts is left out, whatever the size of a class.
    """
    large = cut(members.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > expand).select("class"))
    units, star = members.select("class", "chunk_id"), None
    if large.limit(1).count():
        counted = members.join(large, "class").groupBy("class", "text").agg(F.min("chunk_id").alias("first"))
        units = units.join(large, "class", "left_anti").union(counted.select("class", "first"))
        star = members.join(counted, ["class", "text"]).select(F.col("first").alias("x"), F.col("chunk_id").alias("y"))
    u_a, u_b = (units.select(F.col("class").alias(s), F.col("chunk_id").alias(c)) for s, c in (("a", "x"), ("b", "y")))
    pairs = u_a.join(u_b, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    pairs = pairs.union(links.select("a", "b").join(u_a, "a").join(u_b, "b").select("x", "y"))
    pairs = (pairs.union(star) if star is not None else pairs).where("x <> y")
    return pairs.select(F.least("x", "y").alias("chunk_id_a"), F.greatest("x", "y").alias("chunk_id_b")).distinct()


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return expanded(*near_duplicates(read_table(spark, folder, "chunks")))


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row per chunk of enough words: its class, its group (the least class reachable by links) and its class's number of links."""
    members, links = near_duplicates(read_table(spark, folder, "chunks"))
    links = cut(links)
    groups = connected_components(links.select("a", "b"), "a", "b")
    ends = links.select(F.col("a").alias("class")).union(links.select("b")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    joined = members.select("chunk_id", "class").distinct().join(groups.select(F.col("node").alias("class"), "component"), "class", "left").join(ends, "class", "left")
    return joined.select("chunk_id", "class", F.coalesce("component", "class").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}
ORACLES = {
    "p3_found": r"""
WITH w AS (SELECT DISTINCT chunk_id, regexp_extract_all(lower(contents), '[\p{L}\p{N}]+') AS w FROM chunks WHERE contents IS NOT NULL AND chunk_id IS NOT NULL),
s AS (SELECT chunk_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 40),
x AS (SELECT chunk_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b, a.n AS n, b.n AS m, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY ALL)
SELECT chunk_id_a, chunk_id_b FROM p WHERE 2 * k >= n + m - k""",
}
