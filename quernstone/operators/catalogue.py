"""Filters, overlays, listings and differences over documents and their sources."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def normalised(values: Column) -> Column:
    """Values of an array in comparable form: trimmed, inner space single, lower case, distinct, no empty ones."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))), lambda x: x != ""))


def any_of(have: Column, want: list[str]) -> Column:
    """True if an array holds one of the wanted values; an empty wish passes all, a null array passes none."""
    wanted = normalised(F.array(*[F.lit(w) for w in want])) if want else None
    return F.lit(True) if wanted is None else F.coalesce(F.arrays_overlap(normalised(have), wanted), F.lit(False))


def all_of(have: Column, want: list[str]) -> Column:
    if not want:
        return F.lit(True)
    return F.coalesce(F.size(F.array_except(normalised(F.array(*[F.lit(w) for w in want])), normalised(have))) == 0, F.lit(False))


def contains_any(have: Column, want: list[str]) -> Column:
    """True if a wanted phrase is part of any value."""
    if not want:
        return F.lit(True)
    return F.coalesce(F.exists(normalised(have), lambda x: reduce(lambda a, b: a | b, [x.contains(w.strip().lower()) for w in want])), F.lit(False))


def included(rows: DataFrame, key: str, include: DataFrame | None, exclude: DataFrame | None) -> DataFrame:
    """Semi-join with the included keys (None: all), anti-join with the excluded ones; exclusion wins."""
    out = rows if include is None else rows.join(include.select(key).distinct(), key, "left_semi")
    return out if exclude is None else out.join(exclude.select(key).distinct(), key, "left_anti")


def unknown_ids(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return asked.select(key).where(F.col(key).isNotNull()).distinct().join(known.select(key), key, "left_anti")


def overlaid(documents: DataFrame, overrides: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Documents with each field taken from the override where it is *present*, even if empty.

    ``overrides`` has the key, the fields and ``present`` (array of field names).  ``overridden`` lists
    the fields taken from the override.
    """
    o = overrides.select(key, F.col("present").alias("_present"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = documents.join(o, key, "left")
    for f in fields:
        joined = joined.withColumn(f, F.when(F.array_contains("_present", f), F.col(f"_{f}")).otherwise(F.col(f)))
    taken = F.filter(F.coalesce(F.col("_present"), F.array().cast("array<string>")), lambda x: x.isin(*fields))
    return joined.withColumn("overridden", taken).drop("_present", *[f"_{f}" for f in fields])


def value_inventory(documents: DataFrame, key: str, column: str) -> DataFrame:
    """``(value, display, documents)`` of an array column: documents per normalised value, each counted once, shown as written first by key."""
    values = documents.select(key, F.posexplode(column).alias("pos", "shown")).withColumn("value", F.lower(F.trim("shown"))).where("value <> ''")
    return values.groupBy("value").agg(F.min_by(F.trim("shown"), F.struct(key, "pos")).alias("display"), F.count_distinct(key).alias("documents"))


def staleness(scanned: DataFrame, recorded: DataFrame, key: str, excluded: DataFrame | None = None) -> DataFrame:
    """``(key, change)``: added, removed or modified files, of scans ``(key, size_bytes, modified_at, sha256)``.

    Modified means another size, or another time *and* another digest.  Excluded keys are never stale.
    """
    fields = ["size_bytes", "modified_at", "sha256"]
    a = scanned.select(key, F.lit(True).alias("_a"), *[F.col(f).alias(f"a_{f}") for f in fields])
    b = recorded.select(key, F.lit(True).alias("_b"), *[F.col(f).alias(f"b_{f}") for f in fields])
    both = a.join(b, key, "full_outer")
    differs = (F.col("a_size_bytes") != F.col("b_size_bytes")) | (~F.col("a_modified_at").eqNullSafe(F.col("b_modified_at")) & ~F.col("a_sha256").eqNullSafe(F.col("b_sha256")))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(differs, "modified")
    out = both.withColumn("change", change).where("change IS NOT NULL").select(key, "change")
    return out if excluded is None else out.join(excluded.select(key), key, "left_anti")


def latest_versions(documents: DataFrame, source: str, by: list[str]) -> DataFrame:
    """The latest version of each source, by ``by`` descending, nulls last."""
    order = W.partitionBy(source).orderBy(*[F.col(b).desc_nulls_last() for b in by])
    return documents.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def with_precedence(parts: list[DataFrame], key: str) -> DataFrame:
    """The union of tables of one schema, a key taken from the first table that has it; ``origin`` is its number."""
    tagged = [p.withColumn("origin", F.lit(i)) for i, p in enumerate(parts)]
    both = reduce(lambda a, b: a.unionByName(b), tagged)
    return both.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy("origin"))).where("_r = 1").drop("_r")


def passage_window(chunks: DataFrame, targets: DataFrame, radius: int) -> DataFrame:
    """``(target_id, chunk_id, document_chunk_index, offset)``: each target with its ``radius`` readable neighbours on either side.

    Unreadable chunks (corrupt or artifact) are skipped, not counted, so this is no range of indexes.
    Positions among the readable chunks of a document are numbered once; targets then join three ways
    on (document, position).  Targets that are themselves unreadable give no rows.
    """
    readable = chunks.where(F.coalesce("health_flags", F.lit(0)).bitwiseAND(3) == 0).where("document_id IS NOT NULL AND document_chunk_index IS NOT NULL")
    order = W.partitionBy("document_id").orderBy("document_chunk_index")
    placed = readable.select("chunk_id", "document_id", "document_chunk_index", F.row_number().over(order).alias("place"))
    around = placed.join(targets.select("chunk_id").distinct(), "chunk_id", "left_semi").select(F.col("chunk_id").alias("target_id"), "document_id", F.col("place").alias("_at"))
    spread = around.withColumn("offset", F.explode(F.sequence(F.lit(-radius), F.lit(radius)))).withColumn("place", F.col("_at") + F.col("offset"))
    return spread.join(placed, ["document_id", "place"]).select("target_id", "chunk_id", "document_chunk_index", "offset")


def page(rows: DataFrame, order: list, number: int, size: int, total: int) -> DataFrame:
    """Page ``number`` of rows in order; a number beyond the last page gives the last."""
    last = max(1, -(-total // size))
    return rows.orderBy(*order).offset((min(max(1, number), last) - 1) * size).limit(size)
