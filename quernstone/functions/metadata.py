"""Metadata of documents as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words by language, for telling languages apart.
LANGUAGE_WORDS = {
    "en": "the of and to in is that it was for as with on be by this not are from or at which an have".split(),
    "fr": "le la les des du et en est que qui ne dans par pour une au ce cette avec sur plus sans comme entre".split(),
    "de": "der die das den und in ist ein eine nicht auch als bei mit von zu dass noch man wird weil auf sich war".split(),
    "es": "el los las del y en es que no una por para con se su como más sin entre este esta era nunca hay".split(),
}
LANGUAGE_TOKENS = 4000
LEAST_TOKENS = 120
LEAST_COVERAGE = 0.10
LEAST_LEAD = 1.5


def doi(text: Column) -> Column:
    """The first DOI of a text without closing punctuation; empty if there is none."""
    return F.regexp_replace(F.regexp_extract(text, r"\b(10\.\d{4,9}/[^\s\"<>]+)", 1), r"[.,;:)\]}]+$", "")


def language_code(tag: Column) -> Column:
    """The leading two or three letters of a language tag, lower case; empty otherwise."""
    return F.lower(F.regexp_extract(F.trim(tag), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1))


def year(text: Column) -> Column:
    """The first year from 1800 to 2199; null if there is none."""
    found = F.regexp_extract(text, r"(?:^|[^0-9])((?:18|19|20|21)[0-9]{2})(?:[^0-9]|$)", 1)
    return F.when(found != "", found.cast("int"))


def valid_title(title: Column) -> Column:
    """At most 500 characters, at least three letters, no DOI, address or file name; false for null."""
    t = F.trim(title)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    bad = t.rlike(r"(?i)^(?:doi:|10\.\d{4,9}/|https?://|www\.|untitled\b|microsoft word)|\.(?:pdf|epub|mobi|docx?|indd|qxd)$")
    return F.coalesce((F.length(t) <= 500) & (letters >= 3) & ~bad, F.lit(False))


def detected_language(tokens: Column) -> Column:
    """The language whose function words a token array covers best, empty when the evidence is thin.

    Coverage is the share of a language's words that occur in the first 4,000 tokens.  The best must
    reach 0.10 and 1.5 times the runner-up; ties go to the greater code; under 120 tokens is no evidence.
    """
    first = F.array_distinct(F.slice(tokens, 1, LANGUAGE_TOKENS))
    scored = [F.struct((F.size(F.array_intersect(first, F.array(*[F.lit(w) for w in words]))) / len(words)).alias("coverage"), F.lit(code).alias("code")) for code, words in LANGUAGE_WORDS.items()]
    ordered = F.sort_array(F.array(*scored), asc=False)
    best, second = F.element_at(ordered, 1), F.element_at(ordered, 2)
    clear = (best["coverage"] >= LEAST_COVERAGE) & (best["coverage"] >= LEAST_LEAD * second["coverage"])
    return F.when((F.size(tokens) >= LEAST_TOKENS) & clear, best["code"]).otherwise("")


def chunk_header(title: Column, section: Column) -> Column:
    """``title — section``, one of them where the other is missing or the same."""
    t, s = F.nullif(F.trim(title), F.lit("")), F.nullif(F.trim(section), F.lit(""))
    return F.when(F.lower(t) == F.lower(s), t).otherwise(F.concat_ws(" — ", t, s))


def distinct_ignoring_case(values: Column) -> Column:
    """The values of an array in order, trimmed, without empty ones and later spellings of the same."""
    clean = F.filter(F.transform(values, lambda x: F.trim(F.regexp_replace(x, r"[ \t\n\r\f]+", " "))), lambda x: x != "")
    lowered = F.transform(clean, F.lower)
    return F.filter(clean, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def identifiers(values: Column) -> Column:
    """An array of ids trimmed, without empty ones and repeats, in order; empty for null."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""))


def file_stem(path: Column) -> Column:
    """The file name without folders and its ending."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)


def valid_authors(authors: Column) -> Column:
    """Names of two letters and more without digits, at-signs and signs of damage, each once; empty for null."""
    names = distinct_ignoring_case(F.coalesce(authors, F.array().cast("array<string>")))
    return F.filter(names, lambda x: x.rlike(r"\p{L}.*\p{L}") & ~x.rlike(r"[0-9@\x{FFFD}]|[ÃÂ][\x{80}-\x{BF}]|â€"))


def identity(embedded: Column, visible: Column, path: Column) -> Column:
    """``struct(title, provenance, conflict)``: the embedded title if valid, else the visible heading, else the file's name.

    Two valid titles that differ beyond case are in conflict.
    """
    inside, shown = F.when(valid_title(embedded), F.trim(embedded)), F.when(valid_title(visible), F.trim(visible))
    provenance = F.when(inside.isNotNull(), "embedded").when(shown.isNotNull(), "visible").otherwise("filename")
    conflict = F.coalesce(F.lower(inside) != F.lower(shown), F.lit(False))
    return F.struct(F.coalesce(inside, shown, file_stem(path)).alias("title"), provenance.alias("provenance"), conflict.alias("conflict"))


def metadata_warnings(provenance: Column, conflict: Column, authors: Column, year: Column, languages: Column) -> Column:
    """What is missing or doubtful of a document's metadata, in order."""
    return F.array_compact(F.array(
        F.when(provenance == "filename", "title_from_filename"), F.when(conflict, "conflicting_candidates"), F.when(F.size(authors) == 0, "authors_missing"),
        F.when(year.isNull(), "year_missing"), F.when(F.size(languages) == 0, "languages_missing"),
    ))
