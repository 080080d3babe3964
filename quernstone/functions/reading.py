"""Reading text: layout and encoding repairs whose rules depend on order, as Arrow functions."""

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

_FOLDED = re.compile("[ﬀ-ﬆ\U0001d400-\U0001d7ff]")
_DROPPED = re.compile("[\u0000-\u0008\u000b\u000c\u000e-\u001f\u00ad]")
_SPACES = re.compile(r"[^\S\n]+")
_INNER_HYPHEN = re.compile(r"(?<=[^\W\d_])-[^\S\n]+(?=[^\W\d_])")
_ITEM = re.compile(r"^(?:[•◦▪‣*–—-]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])\s")
_ENDS = re.compile(r"[.!?…:;][\"'”’»)\]]*$")


def reading_text(text: str) -> str:
    """A text as paragraphs without layout wrapping.

    Ligatures and mathematical letters are folded, the rest composed; soft hyphens and controls go.
    Lines flow together; a list item, or a blank line after the end of a sentence, opens a paragraph; a
    word broken by a hyphen at a line end is joined.
    """
    folded = unicodedata.normalize("NFC", _FOLDED.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text))
    folded = _DROPPED.sub("", folded.replace("\r\n", "\n").replace("\r", "\n"))
    out: list[str] = []
    gap = False
    for raw in folded.split("\n"):
        line = _INNER_HYPHEN.sub("-", _SPACES.sub(" ", raw).strip())
        if not line:
            gap = True
            continue
        if not out or _ITEM.match(line) or gap and _ENDS.search(out[-1]):
            out.append(line)
        elif len(out[-1]) > 1 and out[-1][-1] == "-" and out[-1][-2].isalpha() and line[0].isalpha():
            out[-1] = out[-1][:-1] + line
        else:
            out[-1] += " " + line
        gap = False
    return "\n\n".join(out)


def inline_text(text: str) -> str:
    """The same on one line."""
    return " ".join(reading_text(text).split())


def _octets() -> dict[str, int]:
    """The byte behind each character of a UTF-8 text read as Latin-1 or Windows-1252."""
    table = {chr(b): b for b in range(0x80, 0x100)}
    for b in range(0x80, 0xA0):
        try:
            table[bytes([b]).decode("cp1252")] = b
        except UnicodeDecodeError:
            pass
    return table


_OCTET = _octets()
_BY_BYTE: dict[int, str] = {}
for _c, _b in _OCTET.items():
    _BY_BYTE[_b] = _BY_BYTE.get(_b, "") + re.escape(_c)


def _class(low: int, high: int) -> str:
    return "[" + "".join(_BY_BYTE[b] for b in range(low, high + 1)) + "]"


_SEQUENCE = re.compile(f"{_class(0xC2, 0xDF)}{_class(0x80, 0xBF)}|{_class(0xE0, 0xEF)}{_class(0x80, 0xBF)}{{2}}|{_class(0xF0, 0xF4)}{_class(0x80, 0xBF)}{{3}}")


def unmangled(text: str, passes: int = 2) -> str:
    """A text with sequences that are UTF-8 read as a single-byte encoding decoded anew, at most twice; others stand as they are."""

    def again(m: re.Match) -> str:
        try:
            return bytes(_OCTET[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    for _ in range(passes):
        new = _SEQUENCE.sub(again, text)
        if new == text:
            break
        text = new
    return text


_BAD = re.compile("[\ufffd\ue000-\uf01f\uf100-\uf8e4\u0080-\u009f]")


def without_damaged_words(text: str) -> tuple[str, int, int]:
    """A text with each word that holds an unreadable sign replaced by a gap, the characters lost, and the number of gaps."""
    lost = gaps = 0
    out: list[str] = []
    for word in text.split():
        if _BAD.search(word):
            lost += len(word)
            gaps += 1
            if not out or out[-1] != "[...]":
                out.append("[...]")
        else:
            out.append(word)
    return (" ".join(out), lost, gaps) if gaps else (text, 0, 0)


@F.pandas_udf(StringType())
def normalize_reading_text(s: pd.Series) -> pd.Series:
    return s.map(reading_text, na_action="ignore")


@F.pandas_udf(StringType())
def normalize_inline_text(s: pd.Series) -> pd.Series:
    return s.map(inline_text, na_action="ignore")


@F.pandas_udf(StringType())
def repair_mojibake(s: pd.Series) -> pd.Series:
    """A repaired passage is normalised to one line; a passage without damage comes back as it is."""
    return s.map(lambda t: t if (new := unmangled(t)) == t else inline_text(new), na_action="ignore")


CLEANED = StructType([StructField("text", StringType()), StructField("lost_characters", IntegerType()), StructField("spans", IntegerType())])


@F.pandas_udf(CLEANED)
def clean_damaged(s: pd.Series) -> pd.DataFrame:
    rows = [(None, None, None) if t is None else without_damaged_words(t) for t in s]
    return pd.DataFrame(rows, columns=["text", "lost_characters", "spans"])


# Words that name an organisation rather than a person.
ORGANISATIONS = frozenset("university press institute department college school society association centre center foundation committee council group ltd inc".split())


def author_names(text: str) -> list[str]:
    """Names of a byline, split at commas between names, semicolons, "and" and "&"; organisations and junk left out."""
    out: list[str] = []
    for part in re.split(r"\s*;\s*|\s+(?:and|&|und|et|y)\s+|,\s+(?=[^\s.;]{2,}\s+\S)", text.strip()):
        name = re.sub(r"[\d*†‡§¶]+$", "", part.strip()).strip(" ,.;")
        words = name.split()
        if words and sum(c.isalpha() for c in name) >= 2 and "@" not in name and not ORGANISATIONS & {w.lower() for w in words} and name not in out:
            out.append(name)
    return out


@F.pandas_udf(ArrayType(StringType()))
def split_authors(s: pd.Series) -> pd.Series:
    return s.map(author_names, na_action="ignore")
