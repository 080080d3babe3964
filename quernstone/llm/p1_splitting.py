"""Problem 1: cut oversized items into overlapping pieces at natural boundaries.

Balanced targets: the least number of pieces is computed, targets of equal length are placed, each
is moved to the strongest boundary near it, and pieces are added while any limit fails.
"""

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.sources import read_table

BYTES_PER_TOKEN = 4
#: Share of a piece's length within which a target may move to a stronger boundary.
REACH = 0.25
KINDS = ("hard", "space", "clause", "sentence", "line", "paragraph", "end")

_BOUNDARY = re.compile(
    r"(?P<paragraph>[^\S\n]*\n[^\S\n]*\n\s*)|(?P<line>[^\S\n]*\n\s*)|(?P<sentence>(?<=[.!?…。！？])[\"'”’»)\]]*\s+)|(?P<clause>(?<=[,;:—–])\s+)|(?P<space>\s+)"
)


def _byte_starts(text: str) -> np.ndarray:
    """The byte offset of each character, and the whole length at the end."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    widths = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
    return np.concatenate(([0], np.cumsum(widths)))


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """Pieces of ``text`` as ``(start, end, kind)`` in characters; ``kind`` names the boundary at the end.

    No piece exceeds ``limit`` UTF-8 bytes.  Consecutive pieces share about ``overlap`` bytes (at most
    half the limit) and together cover the text.  A text within the limit is one piece.  Where no
    boundary of any strength lies in reach, the cut falls between characters, never before a
    combining mark if that can be avoided.
    """
    limit = max(4, limit)
    overlap = max(0, min(overlap, limit // 2))
    at = _byte_starts(text)
    total = int(at[-1])
    if total <= limit:
        return [(0, len(text), "end")]
    ends: list[int] = []  # character positions after the white space of a boundary
    strengths: list[int] = []
    for m in _BOUNDARY.finditer(text):
        if 0 < m.end() < len(text):
            ends.append(m.end())
            strengths.append(KINDS.index(m.lastgroup))
    where = at[ends].tolist() if ends else []

    def strongest(low: int, high: int, target: float) -> tuple[int, int] | None:
        """The strongest boundary with low < byte <= high, the nearest to the target among equals."""
        i, j = bisect_right(where, low), bisect_right(where, high)
        if i >= j:
            return None
        best = max(range(i, j), key=lambda k: (strengths[k], -abs(where[k] - target)))
        return ends[best], strengths[best]

    def hard(high: int, low: int) -> int:
        c = int(np.searchsorted(at, high, side="right")) - 1
        k = c
        while k > 0 and at[k] > low and _joins(text, k):
            k -= 1
        return k if at[k] > low else c

    count = max(2, -(-(total - overlap) // (limit - overlap)))
    while True:
        length = (total + (count - 1) * overlap) / count
        reach = min(length * REACH, (length - overlap) / 2)
        pieces: list[tuple[int, int, str]] = []
        start = 0
        for k in range(count):
            first = int(at[start])
            floor = max(first, int(at[pieces[-1][1]]) if pieces else 0)
            if k == count - 1:
                end, kind = len(text), KINDS.index("end")
            else:
                target = length + k * (length - overlap)
                low, high = max(target - reach, floor), min(target + reach, first + limit)
                hit = strongest(int(low), int(high), target) if high > low else None
                hit = hit or strongest(floor, min(first + limit, total), min(target, first + limit))
                end, kind = hit or (hard(min(int(target), first + limit), floor), 0)
            if at[end] <= floor or at[end] - first > limit:
                pieces = []
                break
            pieces.append((start, end, KINDS[kind]))
            if end == len(text):
                break
            start = _overlap_start(text, at, ends, where, strengths, start, end, overlap)
        if pieces and pieces[-1][1] == len(text):
            return pieces
        count += 1
        if count > total:
            return _greedy(at, limit)


def _joins(text: str, k: int) -> bool:
    return k < len(text) and _is_mark(text[k])


@lru_cache(4096)
def _is_mark(ch: str) -> bool:
    import unicodedata

    return bool(unicodedata.combining(ch)) or ch in "‍️"


def _overlap_start(text: str, at: np.ndarray, ends: list[int], where: list[int], strengths: list[int], start: int, end: int, overlap: int) -> int:
    """Where the next piece begins: a boundary nearest to ``overlap`` bytes before ``end``, stronger ones within a quarter of it first."""
    if not overlap:
        return end
    wanted = int(at[end]) - overlap
    i, j = bisect_left(where, wanted - overlap // 4), bisect_right(where, wanted + overlap // 4)
    options = [k for k in range(i, j) if start < ends[k] < end]
    if options:
        return ends[max(options, key=lambda k: (strengths[k] >= KINDS.index("sentence"), -abs(where[k] - wanted)))]
    c = int(np.searchsorted(at, wanted, side="left"))
    while c < end and _joins(text, c):
        c += 1
    return min(max(c, start + 1), end)


def _greedy(at: np.ndarray, limit: int) -> list[tuple[int, int, str]]:
    """Full pieces without overlap, for texts of a few characters per limit."""
    out, start = [], 0
    while start < len(at) - 1:
        end = max(start + 1, int(np.searchsorted(at, at[start] + limit, side="right")) - 1)
        out.append((start, end, "end" if end == len(at) - 1 else "hard"))
        start = end
    return out


PIECE_SCHEMA = "unit_id string, document_id string, limit_bytes int, piece_index int, pieces int, start_byte long, end_byte long, overlap_bytes int, boundary string, contents string"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("unit_id", pa.string()), ("document_id", pa.string()), ("limit_bytes", pa.int32()), ("piece_index", pa.int32()), ("pieces", pa.int32()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("overlap_bytes", pa.int32()), ("boundary", pa.string()), ("contents", pa.string())])
    for batch in batches:
        units, documents, texts, limits, overlaps = (batch.column(c).to_pylist() for c in ("unit_id", "document_id", "contents", "limit_bytes", "overlap_bytes"))
        rows: list[tuple] = []
        for unit, document, text, limit, overlap in zip(units, documents, texts, limits, overlaps, strict=True):
            cuts = split_text(text, limit, overlap)
            at = _byte_starts(text)
            before = 0
            for k, (a, b, kind) in enumerate(cuts):
                rows.append((unit, document, limit, k, len(cuts), int(at[a]), int(at[b]), max(0, before - int(at[a])), kind, text[a:b]))
                before = int(at[b])
        columns = list(zip(*rows, strict=True)) or [()] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def split_units(units: DataFrame, documents: DataFrame, models: DataFrame) -> DataFrame:
    """One row per piece of every unit whose contents exceed its document's limit.

    - The limit is 4 bytes of UTF-8 per token of the model named by the document; ``byte_length`` is not trusted.
    - Null contents, units of unknown documents and models without a limit give no rows; empty texts never exceed one.
    - Repeated rows count once; extra columns are ignored.
    - ``models`` is a table of fixed size (a row per model) and is broadcast; documents and units are shuffled.
      Units no model could object to are left out before any shuffle.
    """
    limits = models.where("model_name IS NOT NULL AND maximum_tokens > 0").groupBy("model_name").agg(
        F.min(F.col("maximum_tokens") * BYTES_PER_TOKEN).cast("int").alias("limit_bytes"), F.coalesce(F.min(F.col("overlap_tokens") * BYTES_PER_TOKEN), F.lit(0)).cast("int").alias("overlap_bytes"))
    least = limits.agg(F.min("limit_bytes").alias("_least"))
    of_document = documents.select("document_id", F.col("embedding_model").alias("model_name")).where("document_id IS NOT NULL").join(F.broadcast(limits), "model_name")
    of_document = of_document.groupBy("document_id").agg(F.min("limit_bytes").alias("limit_bytes"), F.min("overlap_bytes").alias("overlap_bytes"))
    large = units.select("unit_id", "document_id", "contents").where("contents IS NOT NULL AND unit_id IS NOT NULL")
    large = large.join(F.broadcast(least), F.octet_length("contents") > F.col("_least")).drop("_least").distinct()
    over = large.join(of_document, "document_id").where(F.octet_length("contents") > F.col("limit_bytes"))
    return over.mapInArrow(_pieces, PIECE_SCHEMA)


def _split(spark: SparkSession, folder: str) -> DataFrame:
    return split_units(read_table(spark, folder, "units"), read_table(spark, folder, "source_documents"), read_table(spark, folder, "embedding_models"))


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every oversized unit."""
    return _split(spark, folder)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The units that the splitter cut."""
    return _split(spark, folder).where("pieces > 1 AND piece_index = 0").select("unit_id").distinct()


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces}
ORACLES = {
    "p1_found": """SELECT DISTINCT u.unit_id FROM units u JOIN source_documents d ON u.document_id = d.document_id
JOIN embedding_models m ON m.model_name = d.embedding_model WHERE u.contents IS NOT NULL AND strlen(u.contents) > 4 * m.maximum_tokens""",
}
