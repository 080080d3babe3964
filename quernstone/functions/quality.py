"""Health of passages: corruption, artifacts, references, apparatus, as column expressions over the whole text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quernstone.operators.lexical import APPARATUS, ARTIFACT, CORRUPT

# Fixed values, whole and as they must be for equal verdicts: headings of sections, the words that an argument needs, the
# phrases of a copyright page, and the forms of a note's mark, of an index entry and of a mis-decoded sign.
REFERENCE_HEADINGS = ("references", "reference", "bibliography", "works cited", "literature cited", "references and notes", "notes and references", "citations", "reference list")
NOTE_HEADINGS = ("notes", "footnotes", "endnotes")
INDEX_HEADINGS = ("index", "subject index", "name index", "index of subjects", "index of names")
ARGUMENT_WORDS = tuple(
    """is are was were be been being am that which who whom whose this these those it its we our us they them their he him his she her not no but however because since although though
    while whereas if then than also only even can could would should must may might will shall do does did has have had there here what when where why how such so thus therefore hence
    yet very more most less much many all any each every both either neither one i you your my me ist sind war wird werden wurde hat haben dass nicht auch wir sie es ich est sont était
    nous ils elle pas qui son fue era está""".split()
)
FRONT_MATTER_PHRASES = (
    "ISBN", "All rights reserved", "Library of Congress", "Cataloging", "Cataloguing", "British Library", "Printed in", "Printed and bound in", "First published", "Typeset", "retrieval system",
    "without prior permission", "without the prior permission", "without prior written permission", "without the prior written permission", "Article reuse guidelines", "Downloaded from", "Terms and Conditions",
    "This content downloaded", "All use subject to", "Creative Commons", "eBookstore",
)
NOTE_MARK = r"^\s*(?:\*|∗|†|‡|§|¶|\d{1,3}[.)]?)(?:\s|$)"
INDEX_ENTRY = r"\p{L}[^,\n]{0,40},\s\d{1,4}(?:[–-]\d{1,4})?(?:,\s\d{1,4}(?:[–-]\d{1,4})?)+"
MOJIBAKE = r"[ÃÂ][\x{80}-\x{BF}]|â€|ï¿½|ðŸ"

# Forms of our own for the rest.
FRONT_MATTER = "|".join(FRONT_MATTER_PHRASES)
ENTRY_LEAD = r"^\s*(?:\p{L}[\p{L}\p{N}_'’-]*[,\s]+(?:\p{L}\.\s?){1,4}|(?:\p{L}\.\s?){1,4}\p{L}[\p{L}\p{N}_'’-]*|(?:https?://|www\.|10\.[0-9]{4,9}/)\S+)"
ENTRY_MARK = r"[(\[]\s*(?:18|19|20|21)[0-9]{2}[a-z]?\s*[)\]]\s*[.,;]|\b10\.[0-9]{4,9}/\S|(?i:\bdoi\s*[:.]|\bhttps?://|\bwww\.)|(?i:\bpp?\.\s*[0-9]+)"
LOCATOR = r"\b[0-9]{1,4}(?:[–-][0-9]{1,4})?\b"
MEASUREMENT = r"[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+\.[0-9]+|[0-9]+\s?%"
NAME_MARK = r"\p{Lu}[\p{L}'’-]+,\s+\p{Lu}\."
VENUE_MARK = r"\bvol\.\s*[0-9]+|\bIn:\s"
CITATION = r"\[[0-9]{1,3}(?:\s*[,–-]\s*[0-9]{1,3})*\]|\(\p{Lu}[\p{L}'’-]+(?:\s+(?:and|&|et al\.)\s*\p{Lu}?[\p{L}'’-]*)?,?\s+[0-9]{4}[a-z]?(?::\s*[0-9]+)?\)|\([0-9]{4}[a-z]?\)|\bpp?\.\s*[0-9]+(?:[–-][0-9]+)?"


def corruption_reasons(text: Column) -> Column:
    """Names of the evidence that a passage is damaged: an empty array for a sound one, null for null.

    One replacement character counts only beside another sign of damage; two count alone.
    """
    lost = F.regexp_count(text, F.lit("\ufffd"))
    private = F.regexp_count(text, F.lit(r"[\x{E000}-\x{F01F}\x{F100}-\x{F8E4}]"))
    garbled = text.rlike(MOJIBAKE)
    reasons = [
        F.when((lost >= 2) | ((lost == 1) & ((private > 0) | garbled)), F.lit("replacement_characters")),
        F.when((private >= 2) | ((private == 1) & (lost > 0)), F.lit("private_or_unassigned_characters")),
        F.when(garbled, F.lit("known_mojibake")),
    ]
    return F.when(text.isNotNull(), F.array_compact(F.array(*reasons)))


#: Families of scripts that a text may mix, as Unicode names them.
SCRIPTS = ("Latin", "Greek", "Cyrillic", "Hebrew", "Arabic", "Devanagari", "Thai", "Hangul", "Hiragana", "Katakana", "Han")


def mixed_scripts(text: Column) -> Column:
    """Whether a text has letters of four families of scripts and more, none of which makes up 70 % of them; false for null."""
    counts = F.array(*[F.regexp_count(text, F.lit(rf"\p{{Is{s}}}")) for s in SCRIPTS])
    total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    return F.coalesce((F.size(F.filter(counts, lambda x: x > 0)) >= 4) & (F.array_max(counts) < 0.7 * total), F.lit(False))


def script_notes(text: Column) -> Column:
    """``non_latin_dominant`` for a text of twenty letters and more of which under half are Latin; else empty."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    latin = F.regexp_count(text, F.lit(r"[A-Za-z\x{C0}-\x{24F}]"))
    return F.when((letters >= 20) & (latin < 0.5 * letters), "non_latin_dominant").otherwise("")


def quality_flag(text: Column, kind: Column) -> Column:
    """``extraction_artifact`` where nothing is alphanumeric, or prose has fewer than three letters; else empty."""
    alnum = text.rlike(r"[\p{L}\p{N}]")
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(text.isNotNull() & (~alnum | ((F.coalesce(kind, F.lit("prose")) == "prose") & (letters < 3))), "extraction_artifact").otherwise("")


def is_reference_entry(paragraph: Column) -> Column:
    """A line of at most 400 characters that opens with an author or a bare locator and has a bibliographic mark."""
    t = F.trim(paragraph)
    return F.coalesce((F.length(t) > 0) & (F.length(t) <= 400) & t.rlike(ENTRY_LEAD) & t.rlike(ENTRY_MARK), F.lit(False))


def section_heading(paragraph: Column) -> Column:
    """bibliography, footnotes, index or null, by the closed sets of headings; a heading is short and ends no sentence."""
    t = F.trim(paragraph)
    key = F.lower(F.trim(F.regexp_replace(t, r"[:.]+$", "")))
    kind = F.when(key.isin(*REFERENCE_HEADINGS), "bibliography").when(key.isin(*NOTE_HEADINGS), "footnotes").when(key.isin(*INDEX_HEADINGS), "index")
    return F.when((F.length(t) <= 80) & ~t.rlike(r"[.,;!?]$"), kind)


def paragraphs(texts: DataFrame, order: list[str], keep: list[str], text: str = "contents") -> DataFrame:
    """One row per line that is not blank, with ``position`` from 0 within its text."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return texts.select(*dict.fromkeys([*keep, *order]), F.posexplode(lines).alias("position", "paragraph"))


def removed_sections(rows: DataFrame, document: str, order: list[str]) -> DataFrame:
    """``rows`` with ``removed``: bibliography or footnotes where a paragraph belongs to a confirmed section, else null.

    A section opens at a heading and lasts while paragraphs keep its shape; the heading itself goes
    only if the next paragraph confirms it.  As windows in reading order: headings and paragraphs of
    no section's shape break, a section's number is the running count of breaks, and an entry belongs
    to the heading that opened its section.
    """
    w = W.partitionBy(document).orderBy(*order)
    heading = section_heading(F.col("paragraph"))
    opened = F.when(heading.isin("bibliography", "footnotes"), heading)
    entry, note = is_reference_entry(F.col("paragraph")), F.col("paragraph").rlike(NOTE_MARK)
    marked = rows.withColumn("_h", opened).withColumn("_e", entry).withColumn("_n", note)
    # a paragraph carries on a section of a kind only if it has that kind's shape
    last = F.last("_h", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    marked = marked.withColumn("_kind", last)
    fits = F.when(F.col("_kind") == "bibliography", F.col("_e")).when(F.col("_kind") == "footnotes", F.col("_n")).otherwise(F.lit(False))
    marked = marked.withColumn("_fits", F.col("_h").isNull() & fits)
    breaks = F.sum((~F.col("_fits")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    marked = marked.withColumn("_s", breaks)
    opener = F.max("_h").over(W.partitionBy(document, "_s"))
    confirmed = F.lead("_fits").over(w)
    removed = F.when(F.col("_fits") & opener.isNotNull(), F.col("_kind")).when(F.col("_h").isNotNull() & F.coalesce(confirmed, F.lit(False)), F.col("_h"))
    return marked.withColumn("removed", removed).drop("_h", "_e", "_n", "_kind", "_fits", "_s")


def apparatus_kind(text: Column) -> Column:
    """bibliography, index, front_matter or null: scholarly apparatus rather than argument.

    By the share of arguing words (6 % at most, 12 % for front matter), entries of an index, density
    and capitals of citations, and a guard for passages with six measurements or more.
    """
    words = F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))
    n = F.greatest(F.size(words), F.lit(1))
    argues = F.size(F.filter(words, lambda x: F.lower(x).isin(*ARGUMENT_WORDS))) / n
    numbers, entries = F.regexp_count(text, F.lit(LOCATOR)) / n, F.regexp_count(text, F.lit(INDEX_ENTRY))
    capitals = F.size(F.filter(words, lambda x: x.rlike(r"^\p{Lu}"))) / n
    marks = F.regexp_count(text, F.lit(ENTRY_MARK)) + F.regexp_count(text, F.lit(NAME_MARK)) + F.regexp_count(text, F.lit(VENUE_MARK))
    index = (argues <= 0.06) & (((entries >= 3) & (numbers >= 0.25)) | ((entries >= 1) & (numbers >= 0.5)))
    bibliography = (argues <= 0.06) & (capitals >= 0.25) & (marks / n >= 0.06)
    front = (argues <= 0.12) & (F.regexp_count(text, F.lit(FRONT_MATTER)) >= 2)
    guarded = F.regexp_count(text, F.lit(MEASUREMENT)) >= 6
    return F.when(index, "index").when(bibliography & ~guarded, "bibliography").when(front & ~guarded, "front_matter")


def health_flags(text: Column, flags: Column) -> Column:
    """The bitmask of a chunk: corrupt 1, artifact 2 (recorded, or without letters and digits), apparatus 4."""
    corrupt = F.when(F.size(corruption_reasons(text)) > 0, CORRUPT).otherwise(0)
    artifact = F.when(F.coalesce(F.array_contains(flags, "extraction_artifact"), F.lit(False)) | ~text.rlike(r"[\p{L}\p{N}]"), ARTIFACT).otherwise(0)
    apparatus = F.when(apparatus_kind(text).isNotNull(), APPARATUS).otherwise(0)
    return (corrupt + artifact + apparatus).cast("int")


def citations(text: Column) -> Column:
    """Distinct citations as written: bracketed numbers, author-year, years in brackets, pages."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CITATION), F.lit(0)))
