"""Windows of tokens over units, chunk identities and their census."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SIZE, OVERLAP = 384, 64


def windows(units: DataFrame, size: int = SIZE, overlap: int = OVERLAP, token: str = r"\S+\s*") -> DataFrame:
    """``(unit_id, window, contents)``: windows of ``size`` tokens that step by size - overlap, stripped.

    ``token`` is the pattern of a token with the space after it, so that windows keep the text as it
    stands.  An overlap of the size or more falls back to a quarter of it.  Null and blank texts give no
    window; a window that would lie wholly within the one before is not emitted.
    """
    overlap = size // 4 if overlap >= size else overlap
    step = size - overlap
    tokens = units.select("unit_id", F.regexp_extract_all(F.trim("contents"), F.lit(token), F.lit(0)).alias("tokens")).where(F.size("tokens") > 0)
    count = F.greatest(F.lit(1), F.ceil((F.size("tokens") - overlap) / step)).cast("int")
    starts = F.sequence(F.lit(0), (count - 1) * step, F.lit(step))
    spread = tokens.select("unit_id", "tokens", F.posexplode(starts).alias("window", "start"))
    return spread.select("unit_id", "window", F.trim(F.array_join(F.slice("tokens", F.col("start") + 1, F.lit(size)), "")).alias("contents")).where("contents <> ''")


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix`` and 24 hex digits of the SHA-256 of the parts, NUL between them."""
    joined = parts[0].cast("string")
    for p in parts[1:]:
        joined = F.concat(joined, F.char(F.lit(0)), p.cast("string"))
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, 24))


def enriched(pieces: DataFrame, units: DataFrame) -> DataFrame:
    """Windows with their unit's fields, ordinals within the document and content-derived ids; texts without letters or digits left out."""
    kept = pieces.where(F.col("contents").rlike(r"[\p{L}\p{N}]")).join(units.select("unit_id", "document_id", "source_id", "unit_ordinal", "content_kind"), "unit_id")
    order = W.partitionBy("document_id").orderBy("unit_ordinal", "unit_id", "window")
    return kept.withColumn("document_chunk_index", F.row_number().over(order) - 1).withColumn("chunk_id", stable_id("chk_", F.col("unit_id"), F.col("window"), F.col("contents")))
