"""Screening of extracted text: which passages are readable, what cleaning loses, and which sources are refused."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.quality import corruption_reasons

#: A passage or source may lose so many percent of its characters.
MAXIMUM_UNCLEAN_PERCENT = 2.0
LEAST_RETAINED_PERCENT = 10
ARTIFACT_LADEN_PERCENT = 50
UNSAFE_CHARACTERS, UNSAFE_PERCENT = 500, 50
READABLE_PERCENT = 50
UNREADABLE = r"[\x{FFFD}\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}\x{E000}-\x{F01F}\x{F100}-\x{F8E4}]"


def unreadable_characters(text: Column) -> Column:
    """Replacement signs, stray controls and private code points; formatting glyphs of symbol fonts are none."""
    return F.regexp_count(text, F.lit(UNREADABLE))


def passage_health_reasons(text: Column, maximum_percent: float | None = MAXIMUM_UNCLEAN_PERCENT) -> Column:
    """Why a passage is not served: signs of corruption, nothing alphanumeric, or too many unreadable characters; null for null.

    The signs of corruption hold whatever the share; an empty text has nothing alphanumeric.
    """
    more = [F.when(~text.rlike(r"[\p{L}\p{N}]"), F.lit("symbol_only"))]
    if maximum_percent is not None:
        more.append(F.when(unreadable_characters(text) * 100 > F.length(text) * maximum_percent, F.lit("unclean_text")))
    return F.concat(corruption_reasons(text), F.array_compact(F.array(*more)))


def readable_text(text: Column) -> Column:
    """A sound text as it is; of a corrupt one its sound paragraphs, if they keep half of its characters and are healthy; else null."""
    sound = F.filter(F.split(text, "\n\n"), lambda p: (F.trim(p) != "") & (F.size(corruption_reasons(p)) == 0))
    joined = F.array_join(sound, "\n\n")
    kept = F.when((F.length(joined) * 100 >= F.length(text) * READABLE_PERCENT) & (F.size(passage_health_reasons(joined, None)) == 0), joined)
    return F.when(F.size(corruption_reasons(text)) == 0, text).otherwise(kept)


def screened(units: DataFrame, source: str, text: str = "contents", maximum_percent: float = MAXIMUM_UNCLEAN_PERCENT) -> DataFrame:
    """One row per source: its units, those kept, characters kept, removed and withheld, units withheld by reason, and ``verdict``.

    Units are cleaned first and judged then; null texts count as units without characters; null sources
    are one group.  ``verdict`` lists why a source is refused, empty where it is kept.
    """
    made = units.select(source, F.coalesce(text, F.lit("")).alias("_t")).withColumn("_clean", readable_text(F.col("_t")))
    made = made.withColumn("_now", F.coalesce("_clean", "_t")).withColumn("_why", passage_health_reasons(F.col("_now"), maximum_percent))
    kept = F.size("_why") == 0
    has = lambda reason: F.count_if(F.array_contains("_why", reason))
    out = made.groupBy(source).agg(
        F.count(F.lit(1)).alias("units"), F.count_if(kept).alias("retained"), F.sum(F.when(kept, F.length("_now")).otherwise(0)).alias("kept_characters"), F.sum(F.length("_t") - F.length("_now")).alias("removed_characters"),
        F.sum(F.when(kept, 0).otherwise(F.length("_now"))).alias("withheld_characters"), F.sum(F.when(kept, F.regexp_count("_now", F.lit(r"\p{L}"))).otherwise(0)).alias("letters"),
        *[has(reason).alias(reason) for reason in ("replacement_characters", "private_or_unassigned_characters", "known_mojibake", "symbol_only", "unclean_text")],
    )
    return out.withColumn("verdict", source_health_reasons(maximum_percent))


def source_health_reasons(maximum_percent: float = MAXIMUM_UNCLEAN_PERCENT) -> Column:
    """Why a source is refused, over the counts of :func:`screened`."""
    n, retained, kept, removed, withheld = (F.col(x) for x in ("units", "retained", "kept_characters", "removed_characters", "withheld_characters"))
    few = retained * 100 < n * LEAST_RETAINED_PERCENT
    reasons = [
        F.when(few, "almost_all_units_withheld"),
        F.when(few & (F.col("symbol_only") * 100 >= n * ARTIFACT_LADEN_PERCENT), "artifact_laden_text"),
        F.when(F.col("letters") == 0, "no_letter_text"),
        F.when((withheld > 0) & (withheld * 100 > kept * maximum_percent), "unclean_text"),
        F.when((removed >= UNSAFE_CHARACTERS) & (removed * 100 > (kept + removed) * UNSAFE_PERCENT), "unsafe_to_clean"),
    ]
    return F.when((n <= 0) | (retained <= 0), F.array(F.lit("no_readable_text"))).otherwise(F.array_compact(F.array(*reasons)))


#: A converter's payload: the blocks of each page, by its number, and the labels printed on pages.
PAYLOAD = "pages map<string, array<struct<contents: string, content_kind: string>>>, page_labels map<string, string>"


def page_units(payloads: DataFrame) -> DataFrame:
    """``(document_id, page_no, page_label, block, contents, content_kind)`` of JSON payloads ``(document_id, payload)``.

    Blocks are numbered on their page, in order, blank ones left out before; white space is made single.
    A payload that is no such JSON, or a page that is no number, gives no rows.
    """
    read = payloads.select("document_id", F.from_json("payload", PAYLOAD).alias("p")).select("document_id", "p.page_labels", F.explode("p.pages").alias("page", "blocks"))
    clean = F.transform("blocks", lambda x: F.struct(F.trim(F.regexp_replace(F.coalesce(x["contents"], F.lit("")), r"\s+", " ")).alias("contents"), F.coalesce(x["content_kind"], F.lit("prose")).alias("content_kind")))
    rows = read.where(F.col("page").rlike("^[0-9]{1,9}$")).select("document_id", F.col("page").cast("int").alias("page_no"), F.col("page_labels")[F.col("page")].alias("page_label"), F.posexplode(F.filter(clean, lambda x: x["contents"] != "")).alias("block", "x"))
    return rows.select("document_id", "page_no", "page_label", "block", "x.contents", "x.content_kind")


def blank_pages(units: DataFrame) -> DataFrame:
    """``(document_id, first_page, last_page, pages, blank)``: how many pages between a document's first and last have no unit."""
    out = units.groupBy("document_id").agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.count_distinct("page_no").alias("pages"))
    return out.withColumn("blank", F.col("last_page") - F.col("first_page") + 1 - F.col("pages"))
