"""Problem 5: statistics of each text, and fixed-threshold rules that tell prose from other matter.

The statistics are built-in column expressions over the whole text; its words and lines are made once
and bound, so no expression makes them anew.  The thresholds are those of published filters, named with
each rule; the rules for apparatus (references, contents, indexes, forms, markup), for which nothing is
published, ask for half of the lines.  Each rule that a text fails is recorded by name.
"""

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.sources import read_table

# Frequent function words of the four languages.
COMMON_EN = "the a an of and in is that no as it there was by for if has be than more its here to how not what but we still which between because although while after when since before so on at with from or are this whereas unless without such every neither nor them then only"
COMMON_FR = "le la les l de d des du et en est que qui ne ni n se s sans dans par pour plus il elle on un une au aux ce c cette avec entre sur quand même comme où mais donc sont pas"
COMMON_DE = "der die das den dem des und in ist im ein eine nicht noch man auch als zu bei von nach mit weil dass ob wie wird war während bevor denn oder weder aber für auf sich obwohl"
COMMON_ES = "el la los las de del y en es que no se un una por para con sin su lo más como cuando entre este esta ni al nunca donde aunque pero si era hay según"
COMMON = tuple(sorted(set(" ".join((COMMON_EN, COMMON_FR, COMMON_DE, COMMON_ES)).split())))

#: Published thresholds.  Gopher: Rae et al. 2021, "Scaling Language Models: Methods, Analysis & Insights from Training Gopher",
#: table A1.  ROOTS: Laurençon et al. 2022, "The BigScience ROOTS Corpus", closed-class words, as set for English.  C4: Raffel et
#: al. 2020, "Exploring the Limits of Transfer Learning", section 2.2.
GOPHER_WORD_LENGTH = (3.0, 10.0)
GOPHER_SYMBOLS_A_WORD = 0.1
GOPHER_BULLET_LINES = 0.9
GOPHER_ELLIPSIS_LINES = 0.3
GOPHER_ALPHABETIC_WORDS = 0.8
GOPHER_STOP_WORDS = 2
ROOTS_CLOSED_CLASS = 0.3
#: Lines of apparatus that make a text apparatus.
MOST_APPARATUS = 0.5
APPARATUS = (("references", "reference"), ("contents", "leader"), ("index", "index"), ("form", "form"), ("markup", "markup"))

_REFERENCE = r"doi:\s?10\.|,\s*vol\.\s*\d+|\bpp?\.\s*\d+[-–]\d+|\bIn: .+ \(\d{4}\) \d+[-–]\d+|^\s*(\[\d+\]\s*)?[\p{L}'-]+,? \p{Lu}\.[^()]{0,40}\(\d{4}\)[.:]|, \d{4}\. \d+ p\."
_LEADER = r"([.·]\s?){4,}\s*[\divxlc]+\s*$|…{1,}\s*[\divxlc]+\s*$|\t\s*\d+\s*$"
_BULLET = r"^\s*([-*•·▪◦‣–]|\(?\d{1,3}[.)]|\(?[a-z][.)])\s+\S"
_MARKUP = r"</?[a-zA-Z][^>]{0,80}>|&[a-z]{2,8};|&#\d+;|[{}]\s*$|[)\]}];\s*$|^\s*[.#]?[\w.-]+\s*[={]"
_ENDS = r"[.!?…][\"'”’»)\]]*(\[\d+\])?\s*$"
_ELLIPSIS = r"(\.\.\.|…)\s*$"
_HASH = r"#|\.\.\.|…"
_SYMBOL = r"[^\p{L}\p{M}\p{N}\s.,;:!?'\"()\[\]“”‘’«»„—–\-…]"
_BLANK = r"[ \t\n\r\f]+"
_FORM = r"_{3,}|\.{6,}\s*$|\[\s?\]|☐|□"
_INDEX = r"(,\s*\d{1,4}([-–]\d{1,4})?){1,}\s*[;.]?\s*$|\bSee also\b"


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 6)).otherwise(F.lit(0.0))


def _bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value computed once.  Named columns would not do: the optimiser writes their expressions out again wherever a filter uses them."""
    return F.transform(F.array(value), of)[0]


def _statistics(s: Column) -> Column:
    """The statistics of a struct ``text, words, lines``; the text's tokens between blanks serve the alphabetic share."""
    t, words, lines, blank = s["text"], s["words"], s["lines"], s["tokens"]
    n, m, chars = F.size(words), F.size(lines), F.length(t)

    def lines_with(pattern: str, needs: Column) -> Column:
        # a text without any of the signs that the pattern needs has no such line
        return F.when(needs, _share(F.size(F.filter(lines, lambda x: x.rlike(pattern))), m)).otherwise(F.lit(0.0))

    def has(*signs: str) -> Column:
        return reduce(operator.or_, [F.contains(t, F.lit(x)) for x in signs])

    known = F.filter(words, lambda w: w.isin(*COMMON))
    return F.struct(
        chars.alias("characters"),
        n.alias("words"),
        m.alias("lines"),
        _share(F.length(F.array_join(words, "")), n).alias("mean_word_length"),
        _share(F.size(known), n).alias("common_share"),
        F.size(F.array_distinct(known)).alias("common_words"),
        _share(F.size(F.filter(words, lambda w: (w < ":") & w.rlike(r"^\p{N}+$"))), n).alias("number_share"),
        _share(F.size(F.filter(blank, lambda w: (F.lower(w) != F.upper(w)))), F.size(blank)).alias("alphabetic_share"),
        _share(F.regexp_count(t, F.lit(_HASH)), n).alias("hash_or_ellipsis"),
        _share(F.regexp_count(t, F.lit(_SYMBOL)), chars).alias("symbol_share"),
        lines_with(_ENDS, F.lit(True)).alias("line_end_share"),
        lines_with(_ELLIPSIS, has("...", "…")).alias("ellipsis_share"),
        lines_with(_BULLET, F.lit(True)).alias("bullet_share"),
        lines_with(_REFERENCE, has("doi:", "vol.", "p.", "(")).alias("reference_share"),
        lines_with(_LEADER, has("..", ". .", "·", "…", "\t")).alias("leader_share"),
        lines_with(_MARKUP, has("<", "&", "{", "}", ";", "=")).alias("markup_share"),
        lines_with(_FORM, has("___", "......", "[ ]", "[]", "☐", "□", "[")).alias("form_share"),
        lines_with(_INDEX, has(",", "See also")).alias("index_share"),
        _share(n - F.size(F.array_distinct(words)), n).alias("repeated_share"),
    )


def _failed(s: Column) -> Column:
    short, long = GOPHER_WORD_LENGTH
    rules = [
        ("no_words", s["words"] == 0),
        ("gopher_word_length", (s["words"] > 0) & ((s["mean_word_length"] < short) | (s["mean_word_length"] > long))),
        ("gopher_symbols", s["hash_or_ellipsis"] > GOPHER_SYMBOLS_A_WORD),
        ("gopher_bullets", s["bullet_share"] > GOPHER_BULLET_LINES),
        ("gopher_ellipsis", s["ellipsis_share"] > GOPHER_ELLIPSIS_LINES),
        ("gopher_alphabetic", (s["words"] > 0) & (s["alphabetic_share"] < GOPHER_ALPHABETIC_WORDS)),
        ("gopher_stop_words", (s["words"] > 0) & (s["common_words"] < GOPHER_STOP_WORDS)),
        ("roots_closed_class", (s["words"] > 0) & (s["common_share"] < ROOTS_CLOSED_CLASS)),
        *((name, s[f"{share}_share"] >= MOST_APPARATUS) for name, share in APPARATUS),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules]))


def text_statistics(texts: DataFrame, column: str = "contents") -> DataFrame:
    """``texts`` with a struct column ``stats`` of its text ``column``, and an array ``failed`` of the rules it fails.

    Null texts have null statistics and a null array; empty texts have zero counts and zero shares; prose fails no rule.
    The text is read whole.
    """
    t = F.col(column)
    made = F.struct(
        t.alias("text"),
        F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("words"),
        F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "").alias("lines"),
        F.filter(F.split(t, _BLANK), lambda x: x != "").alias("tokens"),
    )
    both = _bound(made, lambda s: _bound(_statistics(s), lambda x: F.struct(x.alias("stats"), _failed(x).alias("failed"))))
    graded = texts.withColumn("_graded", F.when(t.isNotNull(), both))
    return graded.withColumn("stats", F.col("_graded.stats")).withColumn("failed", F.col("_graded.failed")).drop("_graded")


def graded(chunks: DataFrame) -> DataFrame:
    """Distinct ``(chunk_id, stats, failed)``; null ids and null texts give no rows, repeated rows count once, extra columns are ignored.

    An id with several texts gives a row for each.
    """
    rows = chunks.select("chunk_id", "contents").where("chunk_id IS NOT NULL AND contents IS NOT NULL")
    return text_statistics(rows).select("chunk_id", "stats", "failed").distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    chunks = read_table(spark, folder, "chunks").select("chunk_id", "contents").where("chunk_id IS NOT NULL AND contents IS NOT NULL")
    return text_statistics(chunks).where(F.size("failed") > 0).select("chunk_id").distinct()


def p5_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk with its statistics and the rules it fails."""
    return graded(read_table(spark, folder, "chunks")).select("chunk_id", "stats.*", F.array_join("failed", ",").alias("failed"))


def p5_substance(spark: SparkSession, folder: str) -> DataFrame:
    """Per document the characters of its prose, letters and digits only, measured anew beside the older count."""
    chunks = read_table(spark, folder, "chunks").select("chunk_id", "document_id", "contents").where("document_id IS NOT NULL AND contents IS NOT NULL").distinct()
    graded_ = text_statistics(chunks)
    solid = F.regexp_count("contents", F.lit(r"[\p{L}\p{N}]"))
    of = graded_.groupBy("document_id").agg(F.sum(F.when(F.size("failed") == 0, solid).otherwise(0)).alias("prose_characters"), F.count(F.lit(1)).alias("chunks"), F.sum((F.size("failed") > 0).cast("long")).alias("other_chunks"))
    older = read_table(spark, folder, "source_documents").groupBy("document_id").agg(F.max("substantive_character_count").alias("older_count"))
    return of.join(older, "document_id", "left")


QUERIES = {"p5_found": p5_found, "p5_statistics": p5_statistics, "p5_substance": p5_substance}

def _lines_sql(pattern: str) -> str:
    pattern = pattern.replace("'", "''")
    return f"CASE WHEN len(l) > 0 THEN round(len(list_filter(l, lambda x: regexp_matches(x, '{pattern}')))::DOUBLE / len(l), 6) ELSE 0.0 END"


def _share_sql(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN round(({part})::DOUBLE / ({whole}), 6) ELSE 0.0 END"


def _graded_sql(ids: str, source: str) -> str:
    """Common table expressions up to ``graded``, for DuckDB: the statistics and the failed rules of ``source``'s texts."""
    common = ", ".join(f"'{w}'" for w in COMMON)
    letters, symbols = r"[\p{L}\p{N}]+", _SYMBOL.replace("'", "''")
    rules = {
        "no_words": "words = 0", "gopher_word_length": f"words > 0 AND (mean_word_length < {GOPHER_WORD_LENGTH[0]} OR mean_word_length > {GOPHER_WORD_LENGTH[1]})", "gopher_symbols": f"hash_or_ellipsis > {GOPHER_SYMBOLS_A_WORD}",
        "gopher_bullets": f"bullet_share > {GOPHER_BULLET_LINES}", "gopher_ellipsis": f"ellipsis_share > {GOPHER_ELLIPSIS_LINES}", "gopher_alphabetic": f"words > 0 AND alphabetic_share < {GOPHER_ALPHABETIC_WORDS}",
        "gopher_stop_words": f"words > 0 AND common_words < {GOPHER_STOP_WORDS}", "roots_closed_class": f"words > 0 AND common_share < {ROOTS_CLOSED_CLASS}",
    } | {name: f"{share}_share >= {MOST_APPARATUS}" for name, share in APPARATUS}
    failed = ", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in rules.items())
    return f"""
made AS (SELECT {ids}, contents, regexp_extract_all(lower(contents), '{letters}') AS w, list_filter(string_split(contents, chr(10)), lambda x: trim(x, ' ') <> '') AS l, list_filter(regexp_split_to_array(contents, '{_BLANK}'), lambda x: x <> '') AS b FROM {source}),
known AS (SELECT *, list_filter(w, lambda x: x IN ({common})) AS k FROM made),
stats AS (
  SELECT {ids}, contents, length(contents)::INT AS characters, len(w)::INT AS words, len(l)::INT AS lines, {_share_sql("length(array_to_string(w, ''))", "len(w)")} AS mean_word_length, {_share_sql("len(k)", "len(w)")} AS common_share,
    len(list_distinct(k))::INT AS common_words, {_share_sql("len(list_filter(w, lambda x: regexp_full_match(x, '[0-9]+')))", "len(w)")} AS number_share, {_share_sql("len(list_filter(b, lambda x: lower(x) <> upper(x)))", "len(b)")} AS alphabetic_share,
    {_share_sql(f"len(regexp_extract_all(contents, '{_HASH}'))", "len(w)")} AS hash_or_ellipsis, {_share_sql(f"len(regexp_extract_all(contents, '{symbols}'))", "length(contents)")} AS symbol_share, {_lines_sql(_ENDS)} AS line_end_share,
    {_lines_sql(_ELLIPSIS)} AS ellipsis_share, {_lines_sql(_BULLET)} AS bullet_share, {_lines_sql(_REFERENCE)} AS reference_share, {_lines_sql(_LEADER)} AS leader_share, {_lines_sql(_MARKUP)} AS markup_share,
    {_lines_sql(_FORM)} AS form_share, {_lines_sql(_INDEX)} AS index_share, {_share_sql("len(w) - len(list_distinct(w))", "len(w)")} AS repeated_share
  FROM known),
graded AS (SELECT *, list_filter([{failed}], lambda x: x IS NOT NULL) AS failed FROM stats)"""


_CHUNKS_SQL = "WITH" + _graded_sql("chunk_id", "(SELECT DISTINCT chunk_id, contents FROM chunks WHERE chunk_id IS NOT NULL AND contents IS NOT NULL)")

ORACLES = {
    "p5_found": _CHUNKS_SQL + " SELECT DISTINCT chunk_id FROM graded WHERE len(failed) > 0",
    "p5_statistics": _CHUNKS_SQL + " SELECT DISTINCT * EXCLUDE (contents, failed), array_to_string(failed, ',') AS failed FROM graded",
    "p5_substance": "WITH" + _graded_sql("document_id", "(SELECT DISTINCT chunk_id, document_id, contents FROM chunks WHERE document_id IS NOT NULL AND contents IS NOT NULL)") + r""",
o AS (SELECT document_id, max(substantive_character_count) AS older_count FROM source_documents GROUP BY 1),
g AS (SELECT document_id, sum(CASE WHEN len(failed) = 0 THEN len(regexp_extract_all(contents, '[\p{L}\p{N}]')) ELSE 0 END)::BIGINT AS prose_characters, count(*) AS chunks, count(*) FILTER (len(failed) > 0) AS other_chunks FROM graded GROUP BY 1)
SELECT g.*, o.older_count FROM g LEFT JOIN o USING (document_id)""",
}
