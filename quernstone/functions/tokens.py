"""Word tokens as built-in column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The function words that neither index nor gate counts.
STOPWORDS = tuple("a an and are as at be but by for from had has have if in into is it no not of on or such that the their then there these they this to was were will with".split())

GATE_PATTERN = r"[\p{L}\p{N}]+"
INDEX_PATTERN = r"[\p{L}\p{N}_]{2,}"


def all_tokens(text: Column, pattern: str = GATE_PATTERN) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def index_tokens(text: Column) -> Column:
    """Tokens that the lexical index counts, in order and with repeats; null for a null text."""
    return F.filter(all_tokens(text, INDEX_PATTERN), lambda t: ~t.isin(*STOPWORDS))


def gate_tokens(text: Column) -> Column:
    """The distinct meaningful tokens of a text; null for a null text."""
    return F.array_distinct(F.filter(all_tokens(text), lambda t: ~t.isin(*STOPWORDS)))


def equality_key(text: Column) -> Column:
    """The words of a passage alone, so that copies differing in case, punctuation and spacing are equal."""
    return F.array_join(all_tokens(text), " ")


def word_runs(words: Column, size: int) -> Column:
    """Every run of ``size`` consecutive words, joined by a space; none for a shorter array.

    Zipped rather than indexed: a lambda that refers to the word array would evaluate it anew for each
    element, which makes long texts quadratic.
    """
    runs = words
    for j in range(1, size):
        n = F.greatest(F.size(words) - j, F.lit(0))
        runs = F.zip_with(F.slice(runs, F.lit(1), n), F.slice(words, F.lit(j + 1), n), lambda a, b: F.concat_ws(" ", a, b))
    return runs


STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"


def index_tokens_sql(text: str) -> str:
    """The same as SQL for DuckDB."""
    return f"list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: t NOT IN {STOP_SQL})"


def gate_tokens_sql(text: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'), lambda t: t NOT IN {STOP_SQL}))"
