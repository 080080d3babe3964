"""Problem 6: repair of text from scanned pages.

A vocabulary with counts is gathered from all texts and kept as a trie.  For each doubtful word the
trie is intersected with a weighted Levenshtein automaton that also knows the merges and splits of
character recognition, which retrieves every candidate within the budget; candidates are ranked by
edit cost, frequency and the words around.  Then running headers, footers and page numbers are
removed, broken words joined and lines flowed into paragraphs.
"""

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.p5_quality import COMMON
from quernstone.plans.stages import cut
from quernstone.sources import read_table

#: Words in fewer texts are not in the vocabulary.  So many words, the commonest, are sent to all tasks at once; what texts
#: ask of the others is looked up in blocks of as many.
LEAST_TEXTS = 3
VOCABULARY = 400_000
#: A candidate must be so many times as frequent as the word as written, for confusable signs and for any others.
RATIO_CONFUSED = 8.0
RATIO_OTHER = 60.0
BUDGET = 2
HEADER_LETTERS = 70

# What recognition writes, and what stood on the page.
CONFUSIONS = {
    "0": "o ó ö ô", "1": "l i í î", "5": "s", "8": "b", "!": "i l", "|": "l i", "¬": "", "»": "", "^": "", "c": "e é è o", "e": "c", "f": "t", "t": "f", "b": "h", "h": "b", "'": "s e ó é í á",
    "rn": "m", "m": "rn in ni", "in": "m", "ni": "m", "ri": "n", "n": "ri u", "u": "n", "cl": "d", "d": "cl", "li": "h", "h ": "li", "ii": "u n ü", "lc": "k", "vv": "w", "w": "vv", "iii": "m", "tl": "d", "l": "i 1 t", "i": "l í", "6": "b ó", "9": "g", "g": "q", "q": "g", "a": "o á à â ä", "o": "a ó ö ô", "s": "5", "y": "v", "v": "y", "fi": "h", "nn": "m", "z": "2", "2": "z",
}
_EDITS: dict[str, list[tuple[str, str]]] = {}
for _seen, _true in CONFUSIONS.items():
    _EDITS.setdefault(_seen.strip()[0], []).extend((_seen.strip(), t) for t in (_true.split() or [""]))
_EDITS["h"].append(("h", "li"))

_INNER_STRIP = ".,;:?()[]{}“”\"«»—–…‘’-*_/"
_STRIP = ".,;:!?()[]{}“”\"«»—–…‘’'-*_/|"
_DIGITS = re.compile(r"\d")
_BROKEN = re.compile(r"([^\W\d_])[-‐‑¬\xad][ \t]*\n[ \t]*([^\W\d_])")
_SOFT = re.compile("\xad")
_ROMAN = r"(?=[ivxlcdm])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
_NUMBER_LINE = re.compile(rf"^[\s\[(—–\-·|]*(?:(?:page|seite|página|pag|p|s)\b\.?\s*)?(?:[0-9OolI]{{0,2}}\d{{1,3}}|\d[0-9OolI]{{0,3}}|{_ROMAN})(?:\s*(?:/|of|von|de|sur)\s*\d{{1,4}})?[\s\])—–\-·|]*$", re.I)
_CHAPTER = re.compile(r"^\W*(?:\d{1,4}\s+)?(?:CHAPTER|KAPITEL|CHAPITRE|CAP[IÍ]TULO|TEIL|PART|PARTE|PARTIE)\s+(?:[IVXLCDM]+|\d+)\b[.:]?\s+\S", re.I)
_TITLE_YEAR = re.compile(r":\s*[^\W\d_]+\s+\d{4}(?=\D|$)")
_EDGE_NUMBER = re.compile(rf"^\s*(\d{{1,4}}|{_ROMAN})\s+(?=\S)|\s+(\d{{1,4}}|{_ROMAN})\s*$", re.I)
_LEADERS = re.compile(r"(?:[.·]\s?){4,}|…|\t")
_LETTERS = re.compile(r"[^\W\d_]+")
_SENTENCE_END = re.compile(r"[.!?…;,:][\"'”’»)\]]*(?:\[\d+\])?\s*$")
_COMMON = frozenset(COMMON)


class Trie:
    """Nested dictionaries; the key "" holds the count of the word that ends there."""

    def __init__(self, words: dict[str, int]):
        self.root: dict = {}
        for w, n in words.items():
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = n

    def within(self, word: str, budget: int = BUDGET) -> dict[str, tuple[int, int]]:
        """Every vocabulary word the automaton accepts: ``{word: (cost, count)}``.

        A confusion of recognition, a merge or a split costs 1; any other substitution, a sign too
        many or one too few costs 2.
        """
        found: dict[str, tuple[int, int]] = {}
        n = len(word)

        def go(node: dict, i: int, spelt: str, left: int) -> None:
            while not left and i < n:  # no edit left: only the word's own letters lead on
                node = node.get(word[i])
                if node is None:
                    return
                spelt += word[i]
                i += 1
            if i == n:
                if "" in node:
                    cost = budget - left
                    if spelt not in found or cost < found[spelt][0]:
                        found[spelt] = (cost, node[""])
                if left >= 2:
                    for c, child in node.items():
                        if c and "" in child:
                            found.setdefault(spelt + c, (budget - left + 2, child[""]))
                return
            own = word[i]
            if (child := node.get(own)) is not None:
                go(child, i + 1, spelt + own, left)
            for seen, true in _EDITS.get(own, ()):
                if word.startswith(seen, i):
                    at = node
                    for c in true:
                        at = at.get(c)
                        if at is None:
                            break
                    else:
                        if true:
                            go(at, i + len(seen), spelt + true, left - 1)
                        else:  # a sign that stands for any one letter, or for none
                            for c, child in node.items():
                                if c:
                                    go(child, i + 1, spelt + c, left - 1)
                            go(node, i + 1, spelt, left - 1)
            if left >= 2:
                for c, child in node.items():
                    if c:
                        if c != own:
                            go(child, i + 1, spelt + c, left - 2)
                        go(child, i, spelt + c, left - 2)
                go(node, i + 1, spelt, left - 2)

        go(self.root, 0, "", budget)
        return found


@dataclass
class Fix:
    word: str
    cost: int


class Mender:
    """Decides words against the vocabulary; decisions are kept for words seen before."""

    def __init__(self, counts: dict[str, int]):
        self.base, self.trie = counts, Trie(counts)
        self.forget()

    def forget(self) -> None:
        self.counts, self.known = self.base, {}
        self.near: dict[str, list[tuple[str, int, int]]] = {}
        self.tokens: dict[str, Seen] = {}

    def learn(self, facts: list[dict]) -> None:
        """Takes in what is known of a text's words beyond those that all tasks have: their counts and candidates."""
        if len(self.near) > 200_000:
            self.forget()
        if self.counts is self.base:
            self.counts = dict(self.base)
        for fact in facts:
            if fact["n"]:
                self.counts[fact["token"]] = fact["n"]
            self.near[fact["token"]] = [(c["word"], c["cost"], c["n"]) for c in fact["near"] or ()]

    def candidates(self, token: str) -> list[tuple[int, int, str]]:
        """``(cost, -count, word)`` of the words that may be meant by a doubtful lower-case token, empty for one that stands."""
        if (hit := self.known.get(token)) is not None:
            return hit
        if len(self.known) > 300_000:
            self.known.clear()
        own = self.counts.get(token, 0)
        odd = not token.isalpha()
        out = []
        if odd or len(token) >= 3:
            for word, cost, n in [*((w, *x) for w, x in self.trie.within(token).items()), *self.near.get(token, ())]:
                if word == token:
                    continue
                if cost == 1 and (odd or n >= RATIO_CONFUSED * max(1, own)) or cost == 2 and self._plausible(token, word, own, n, odd):
                    out.append((cost, -n, word))
        self.known[token] = out = sorted(out)
        return out

    @staticmethod
    def _plausible(token: str, word: str, own: int, n: int, odd: bool) -> bool:
        if odd:
            return len(word) >= 3
        return own == 0 and len(word) >= 5 and len(token) >= len(word) and n >= RATIO_OTHER

    def split(self, a: str, b: str) -> str | None:
        """The word that two neighbours are halves of."""
        n = self.counts.get(a + b, 0)
        if len(a + b) >= 4 and n >= RATIO_CONFUSED and min(self.counts.get(a, 0), self.counts.get(b, 0)) * RATIO_CONFUSED <= n:
            return a + b
        return None

    def best(self, token: str, around: set[str]) -> Fix | None:
        """The candidate of least cost, then one that the surrounding text uses, then the most frequent."""
        found = self.candidates(token)
        if not found:
            return None
        cost, _, word = min(found, key=lambda c: (c[0], c[2] not in around, c[1], c[2]))
        return Fix(word, cost)


class _Noting(dict):
    """Counts that note what they were asked for and have not."""

    noted: set[str]

    def __contains__(self, word: object) -> bool:
        return dict.__contains__(self, word) or bool(self.noted.add(word))

    def get(self, word: str, default: int = 0) -> int:
        if not dict.__contains__(self, word):
            self.noted.add(word)
        return dict.get(self, word, default)


class Asker(Mender):
    """Knows no candidates and notes every word that mending a text asks for, and more: whatever a candidate would spare asking is asked too."""

    def __init__(self, counts: dict[str, int]):
        self.base = _Noting(counts)
        self.noted = self.base.noted = set()
        self.forget()

    def candidates(self, token: str) -> list[tuple[int, int, str]]:
        self.noted.add(token)
        return []

    def asked(self, text: str, headers: set[str]) -> set[str]:
        if not is_prose(text):
            return set()
        self.noted.clear()
        self.tokens.clear()
        lines = text.split("\n")
        gone = furniture(lines, headers)
        joined, _ = _flowing(lines, gone)
        for part in (*re.split(r"\n[ \t]*\n+", joined), *(lines[i] for i in gone)):
            seen = [_seen(t, self) for t in part.split()]
            for a, b in zip(seen, seen[1:]):  # halves of a word; two common words are none
                if a.half and b.rest and not (dict.__contains__(self.base, a.half) and dict.__contains__(self.base, b.rest)):
                    self.noted |= {a.half + b.rest, a.half, b.rest}
        return {w for w in self.noted if w}


@dataclass
class Mended:
    text: str
    kinds: set[str]
    removed: int  # characters taken out with headers and page numbers
    mended: int  # words mended


_ENTRY = re.compile(r"doi:\s?10\.|, vol\. \d|\bIn: [^\n]+ \(\d{4}\) \d|[^\W\d_],? [^\W\d_]\. \(\d{4}\)[.:]")


def is_prose(text: str) -> bool:
    """Whether common words, without the leaders of contents and the marks of references, make a text prose."""
    words = _LETTERS.findall(text.lower())
    share = sum(map(_COMMON.__contains__, words)) / max(1, len(words))
    return share >= 0.2 and len(_LEADERS.findall(text)) <= 2 and (share >= 0.34 or not _ENTRY.search(text))


def title_like(line: str) -> bool:
    """Whether a line may be a running header: short, no sentence, in capitals or with its long words capitalised."""
    line = line.strip()
    if len(line) > HEADER_LETTERS or not (first := _LETTERS.search(line)) or not first[0][0].isupper():
        return False
    words = _LETTERS.findall(_TITLE_YEAR.sub("", line))
    if not words or _SENTENCE_END.search(line) or _LEADERS.search(line):
        return False
    long = [w for w in words if len(w) > 3] or words
    return words[0][0].isupper() and sum(w[0].isupper() for w in long) >= 0.6 * len(long)


def header_key(line: str) -> str:
    """A header's letters without its chapter mark, numbers and case; empty for a line that can be none."""
    if not title_like(line):
        return ""
    bare = re.sub(r"^\W*(?:\d{1,4}\s+)?(?:chapter|kapitel|chapitre|cap[ií]tulo)\s+(?:[ivxlcdm]+|\d+)\b", "", line.strip(), flags=re.I)
    letters = "".join(_LETTERS.findall(bare.lower()))
    return letters if len(letters) >= 4 else ""


def furniture(lines: list[str], headers: set[str]) -> dict[int, set[str]]:
    """Kinds by position of the lines that are page furniture; a chunk may span page breaks, so every line is looked at."""
    out: dict[int, set[str]] = {}
    full = [i for i, line in enumerate(lines) if line.strip()]
    for i in full:
        line = lines[i]
        if _NUMBER_LINE.match(line):
            out[i] = {"page_number"}
            continue
        key = header_key(line)
        if key and (key in headers or _CHAPTER.match(line)):
            out[i] = {"header"}
            if _EDGE_NUMBER.search(_TITLE_YEAR.sub("", re.sub(_CHAPTER_MARK, "", line))):
                out[i].add("page_number")
    # a text that is nothing but furniture keeps its lines
    return out if len(out) < len(full) else {}


_CHAPTER_MARK = re.compile(r"(?:CHAPTER|KAPITEL|CHAPITRE|CAP[IÍ]TULO|TEIL|PART|PARTE|PARTIE)\s+(?:[IVXLCDM]+|\d+)\b[.:]?\s*", re.I)


def mend(text: str, headers: set[str], mender: Mender) -> Mended:
    """The text as continuous paragraphs, with what was taken out and mended.  Texts that are no prose stay as they are."""
    if not is_prose(text):
        return Mended(text, set(), 0, 0)
    kinds: set[str] = set()
    lines = text.split("\n")
    gone = furniture(lines, headers)
    removed = sum(len(lines[i]) for i in gone)
    for k in gone.values():
        kinds |= k
    joined, broken = _flowing(lines, gone)
    if broken:
        kinds.add("hyphenation")
    paragraphs, mended = [], 0
    words_around = cache(lambda: set(_LETTERS.findall(joined.lower())))  # asked for only by doubtful words
    for block in re.split(r"\n[ \t]*\n+", joined):
        tokens = block.split()
        fixed, n = _mend_tokens(tokens, mender, words_around)
        mended += n
        if fixed:
            paragraphs.append(" ".join(fixed))
    for i, k in gone.items():
        if "header" in k and _mend_tokens(lines[i].split(), mender, words_around)[1]:
            mended += 1
    if mended:
        kinds.add("character")
    return Mended("\n\n".join(paragraphs), kinds, removed, mended + broken)


def _flowing(lines: list[str], gone: dict[int, set[str]]) -> tuple[str, int]:
    """The lines that stay, with words broken across lines joined, and how many were."""
    body = "\n".join(line for i, line in enumerate(lines) if i not in gone)
    joined, broken = _BROKEN.subn(_joined, body)
    return _SOFT.sub("", joined), broken


def _joined(m: re.Match) -> str:
    return m.group(1) + m.group(2)


_FOOTNOTE = re.compile(r"\[\d+\]?$")


@dataclass(slots=True)
class Seen:
    """What holds of a token wherever it stands."""

    core: str
    low: str
    half: str | None  # its lower case, if it is letters alone and so may be the first half of a word
    rest: str | None  # its letters, if they are lower case and so may be the second half
    doubtful: bool


def _seen(token: str, mender: Mender) -> Seen:
    if (hit := mender.tokens.get(token)) is None:
        if len(mender.tokens) > 500_000:
            mender.tokens.clear()
        letters = token.isalpha()
        core = token if letters else _FOOTNOTE.sub("", token).strip(_INNER_STRIP)
        low, rest = core.lower(), token.strip(_STRIP)
        hit = mender.tokens[token] = Seen(core, low, low if letters else None, rest if rest.isalpha() and rest == rest.lower() else None, _doubtful(core, low, mender, set()) is not None)
    return hit


def _mend_tokens(tokens: list[str], mender: Mender, around: Callable[[], set[str]]) -> tuple[list[str], int]:
    out: list[str] = []
    n = i = 0
    seen, counts = [mender.tokens.get(t) or _seen(t, mender) for t in tokens], mender.counts
    last = len(tokens) - 1
    while i <= last:
        token, s = tokens[i], seen[i]
        if i < last and s.half and (rest := seen[i + 1].rest) and s.half + rest in counts:
            whole = mender.split(s.half, rest)
            if whole and min(counts.get(s.half, 0), counts.get(rest, 0)) * 4 < counts[whole] + 1:
                out.append(_cased(s.core, whole) + tokens[i + 1][len(rest) :])
                n += 1
                i += 2
                continue
        fix = _doubtful(s.core, s.low, mender, around()) if s.doubtful else None
        out.append(token.replace(s.core, fix, 1) if fix else token)
        n += bool(fix)
        i += 1
    return out, n


def _doubtful(core: str, low: str, mender: Mender, around: set[str]) -> str | None:
    """The mended form of a token's core, None where it stands."""
    if low in _COMMON or not core or len(core) > 40:
        return None
    if core.isalpha():
        fix = mender.best(low, around)
        return _cased(core, fix.word) if fix else None
    bare = core.rstrip("!?'|.,;:")
    if bare.isalpha():
        # a sign at the end may be punctuation: it is damage only if the word without it is none
        if bare.lower() in mender.counts or bare.lower() in _COMMON or bare == core[:-1] and core[-1] in "!?'.,;:" and not mender.candidates(low):
            return None if bare.lower() in mender.counts or bare.lower() in _COMMON else _alpha(bare, mender, around)
    if not any(c.isalpha() for c in core) or sum(c.isdigit() for c in core) > len(core) / 2:
        return None
    if re.fullmatch(r"[^\W\d_]+(?:['’\-‐][^\W\d_]+)+", core):
        parts = re.split(r"(['’\-‐])", core)
        if all(p.lower() in mender.counts or p.lower() in _COMMON or len(p) < 3 for p in parts[::2]):
            return None
        whole = mender.best(low, around) if "'" in core or "’" in core else None
        if whole and whole.cost == 1 and len(parts[0]) > 2:
            return _cased(core, whole.word)
        fixed = [(_alpha(p, mender, around) or p) if k % 2 == 0 else p for k, p in enumerate(parts)]
        return "".join(fixed) if fixed != parts else None
    pieces = re.split(r"(['’])", core)
    if len(pieces) == 3 and len(pieces[0]) <= 2:  # an elided article before a damaged word
        inner = _doubtful(pieces[2], pieces[2].lower(), mender, around)
        return pieces[0] + pieces[1] + inner if inner else None
    if not re.search(r"[^\W\d_][^\w\s'’\-‐.,;:/()\[\]\"“”—–]|[^\w\s'’\-‐.,;:/()\[\]\"“”—–][^\W\d_]|[^\W\d_]\d|\d[^\W\d_]", core):
        return None
    fix = mender.best(low, around)
    if fix:
        return _cased(core, fix.word)
    # inside a word no digit or sign belongs, whether or not the word is known
    guess = re.sub(r"(?<=[^\W\d_])0(?=[^\W\d_])", "o", re.sub(r"(?<=[^\W\d_])1(?=[^\W\d_])", "l", core))
    if guess != core and guess.isalpha():
        return guess
    return _unknown(core) if re.search(r"[^\W\d_][¬»!^|][^\W\d_]", core) else None


def _unknown(core: str) -> str:
    """A damaged word that no candidate explains keeps its letters, with the sign marked by a query."""
    return re.sub(r"(?<=[^\W\d_])[¬»!^|](?=[^\W\d_])", "?", core)


def _alpha(word: str, mender: Mender, around: set[str]) -> str | None:
    if not word.isalpha() or word.lower() in _COMMON:
        return None
    fix = mender.best(word.lower(), around)
    return _cased(word, fix.word) if fix else None


def _cased(pattern: str, word: str) -> str:
    letters = [c for c in pattern if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word.capitalize() if letters and letters[0].isupper() and pattern[0] == letters[0] else word


def word_counts(chunks: DataFrame, least: int = LEAST_TEXTS) -> DataFrame:
    """``(word, n)``: in how many different texts each word stands, over all texts; words in fewer than ``least`` are left out."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("contents"), F.lit(r"\p{L}{2,30}"), F.lit(0)))
    texts = chunks.select("contents").distinct()  # copies are collapsed before the shuffle, so a hot text is no hot spot
    return texts.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def vocabulary(chunks: DataFrame, least: int = LEAST_TEXTS, most: int = VOCABULARY) -> dict[str, int]:
    """The ``most`` commonest words with their counts."""
    return _commonest(word_counts(chunks, least), most)


def _commonest(counted: DataFrame, most: int) -> dict[str, int]:
    return {r[0]: r[1] for r in counted.orderBy(F.col("n").desc(), "word").limit(most).collect()}  # bounded by most


def _looked_up(joined: DataFrame, counted: DataFrame, base: dict[str, int], most: int) -> DataFrame:
    """``(key, facts)``: for each text what its words have beyond the common ones: their counts, and the words near them.

    The words beyond the common ones are worked off in blocks of ``most``, each a trie that all tasks
    have for one pass over the distinct words asked for.
    """
    sc = joined.sparkSession.sparkContext
    least = min(base.values())
    known = sc.broadcast(base)
    # the commonest words fill the bound; of those as common as its last, the ones it has are marked
    last = joined.sparkSession.createDataFrame([(w,) for w, n in base.items() if n == least], "word string")
    rest = counted.where(F.col("n") <= least).join(last, "word", "left_anti")
    rest = rest.withColumn("block", F.pmod(F.xxhash64("word"), F.lit(max(1, -(-rest.count() // max(1, most // 2))))).cast("int"))
    rest = cut(rest)
    schema = pa.schema([("key", pa.int64()), ("token", pa.string())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asker = Asker(known.value)
        for b in batches:
            out = {(key, w) for key, text, headers in zip(*(c.to_pylist() for c in b.columns), strict=True) for w in asker.asked(text, set(headers or ()))}
            columns = list(zip(*out, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    asked = cut(joined.select("key", "contents", "headers").mapInArrow(ask, "key long, token string").distinct())
    tokens = cut(asked.select("token").distinct())
    near_schema = pa.schema([("token", pa.string()), ("word", pa.string()), ("cost", pa.int32()), ("n", pa.int64())])
    near = None
    for block in sorted(r[0] for r in rest.select("block").distinct().collect()):  # one pass for each block of words
        trie = sc.broadcast({r[0]: r[1] for r in rest.where(F.col("block") == block).select("word", "n").collect()})  # about half of most

        def find(batches: Iterator[pa.RecordBatch], trie=trie) -> Iterator[pa.RecordBatch]:
            words = Trie(trie.value)
            for b in batches:
                out = [(t, w, cost, n) for t in b.column(0).to_pylist() if len(t) >= 3 or not t.isalpha() for w, (cost, n) in words.within(t).items() if w != t]
                columns = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, near_schema, strict=True)], schema=near_schema)

        part = tokens.mapInArrow(find, "token string, word string, cost int, n long")
        near = part if near is None else near.union(part)
    own = tokens.join(rest.select(F.col("word").alias("token"), "n"), "token")
    if near is None:
        facts = own.withColumn("near", F.array().cast("array<struct<word:string,cost:int,n:bigint>>"))
    else:
        facts = own.join(near.groupBy("token").agg(F.collect_list(F.struct("word", "cost", "n")).alias("near")), "token", "full_outer")  # the words within two edits
    return asked.join(facts, "token").groupBy("key").agg(F.collect_list(F.struct("token", "n", "near")).alias("facts"))  # at most the words of a text


def _title_lines(rows: DataFrame) -> DataFrame:
    """``(document_id, key, chunk_id, text)``: the header keys of all lines of each text, and the text's digest."""
    schema = pa.schema([("document_id", pa.string()), ("key", pa.string()), ("chunk_id", pa.string()), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = set()
            for chunk, document, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if keys := {key for line in text.split("\n") if (key := header_key(line))}:
                    digest = blake2b(text.encode(), digest_size=16).digest()
                    out |= {(document, key, chunk, digest) for key in keys}
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, "document_id string, key string, chunk_id string, text binary")


_SCHEMA = pa.schema([("chunk_id", pa.string()), ("contents", pa.string()), ("kinds", pa.list_(pa.string())), ("removed_characters", pa.int32()), ("mended_words", pa.int32())])


def mended(chunks: DataFrame, most: int = VOCABULARY) -> DataFrame:
    """``(chunk_id, contents, kinds, removed_characters, mended_words)`` of every text.

    - A running header is a title-like line that at least two different texts of its document share, or a numbered chapter line, wherever it stands.
    - Null ids and texts give no rows; repeated rows and copies under other ids count once; a null document has no shared headers; extra columns are ignored.
    - Word counts and headers are gathered over all texts; texts are read whole; the ``most`` commonest words are sent to the tasks, and what
      texts ask of the others is looked up and joined to them, so the result is the same whatever ``most`` is.
    """
    rows = chunks.select("chunk_id", "document_id", "contents").where("chunk_id IS NOT NULL AND contents IS NOT NULL").withColumn("document_id", F.coalesce("document_id", F.lit("")))
    counted = cut(word_counts(chunks.where("contents IS NOT NULL")))
    base = _commonest(counted, most)
    beyond = counted.count() > len(base)
    counts = chunks.sparkSession.sparkContext.broadcast(base)
    lines = cut(_title_lines(rows.where("instr(contents, '\n') > 0")))
    shared = lines.where("document_id <> ''").select("document_id", "key", "text").distinct().groupBy("document_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    of_chunk = lines.join(shared, ["document_id", "key"], "left_semi").groupBy("chunk_id", "document_id").agg(F.collect_set("key").alias("headers"))  # at most the lines of a text
    joined = rows.join(of_chunk, ["chunk_id", "document_id"], "left").select("chunk_id", "contents", "headers")
    if beyond and base:
        joined = cut(joined.withColumn("key", F.xxhash64("contents", F.array_sort("headers"))))
        joined = joined.join(_looked_up(joined, counted, base, most), "key", "left").select("chunk_id", "contents", "headers", "facts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mender = _mender(counts)
        for b in batches:
            out = []
            for chunk, text, headers, *facts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if facts and facts[0]:
                    mender.learn(facts[0])
                m = mend(text, set(headers or ()), mender)
                out.append((chunk, m.text, sorted(m.kinds), m.removed, m.mended))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

    return joined.mapInArrow(run, "chunk_id string, contents string, kinds array<string>, removed_characters int, mended_words int")


_mender_of: list = []


def _mender(counts) -> Mender:
    """One mender per worker and vocabulary, so that its decisions serve all batches."""
    if not _mender_of or _mender_of[0] is not counts.value:
        _mender_of[:] = [counts.value, Mender(counts.value)]
    return _mender_of[1]


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found = mended(read_table(spark, folder, "chunks"))
    return found.select("chunk_id", F.explode("kinds").alias("kind")).distinct()


def p6_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks with noise as continuous paragraphs; removed and mended signs beside the document's older count."""
    chunks = read_table(spark, folder, "chunks")
    fixed = mended(chunks).where(F.size("kinds") > 0).dropDuplicates(["chunk_id", "contents"])
    of = chunks.select("chunk_id", "document_id").where("document_id IS NOT NULL").dropDuplicates(["chunk_id"])
    older = read_table(spark, folder, "source_documents").groupBy("document_id").agg(F.max("discarded_corrupt_character_count").alias("older_count"))
    return fixed.join(of, "chunk_id", "left").join(older, "document_id", "left").select("chunk_id", "document_id", "contents", F.array_join("kinds", ",").alias("kinds"), "removed_characters", "mended_words", "older_count")


QUERIES = {"p6_found": p6_found, "p6_repaired": p6_repaired}
ORACLES: dict[str, str] = {}
