"""Problem 9: text decoded with a wrong character encoding.

Every chain of wrong decodings that could have made a passage is undone, and the results are
compressed with zstandard dictionaries of the languages.  The chain of least description length
wins: compressed size, the rarity of each sign at its place in the word, the breaks within words,
and the cost of the chain itself, paid once a text.  Where no chain is shorter than leaving the
text alone, it stays as it is.
"""

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import chain as joined
from random import Random

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.p5_quality import COMMON_DE, COMMON_EN, COMMON_ES, COMMON_FR
from quernstone.sources import read_table

LANGUAGES = ("en", "fr", "de", "es")
#: The size of a dictionary; it has no room for more words than half its bytes, as each takes a sign and a space.
DICTIONARY_BYTES = 24_000
DICTIONARY_WORDS = DICTIONARY_BYTES // 2
#: Words stand in the training text of a dictionary in the proportion of their counts, which are scaled to about so many bytes.
TRAINING_BYTES = 100 * DICTIONARY_BYTES
#: The greedy search of lower levels misses words of the dictionary by chance, by more than a sign costs.
LEVEL = 19
STEP_BITS = 10.0
RARE_STEP_BITS = 20.0
PAIR_BITS = 16.0
BREAK_BITS = 16.0
#: A sign at a place where fewer texts of the language have it is described by its number alone: in bits, by kind.
LEAST_TEXTS, LEAST_SHARE = 3, 5e-4
UNSEEN_BITS, FOREIGN_BITS, LOST_BITS = 20.0, 100.0, 24.0
#: The first letter of a word in another script, which three letters make plain.
SCRIPT_BITS = 40.0
#: A sign known from another language costs so much more; a letter or symbol after one of its own script or kind at most so much; a ligature is a spelling.
BORROWED_BITS = 8.0
RUN_BITS = {"s": 8.0, "": 5.0}
LIGATURE_BITS = 8.0
LOSS_BITS = 1.0
#: A swap is tried where it saves so many bits of a passage's signs.
SWAP_BITS = 4.0
#: A lead byte is taken for one whose followers are lost where it is at least so rare.
LEAD_BITS = 8.0
MOST_STEPS = 3

#: Encodings that UTF-8 bytes are taken for.
READ_AS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "iso8859_15", "cp1254", "cp1253", "koi8_r", "cp866", "iso8859_2")
#: (taken for, true) single-byte encodings.
SWAPPED = (
    *((taken, "cp1252") for taken in ("cp437", "cp850", "mac_roman", "cp1251", "cp1250", "cp1253", "koi8_r", "cp866", "cp1254", "iso8859_2")),
    *(("cp1252", true) for true in ("mac_roman", "cp850", "cp437", "cp1250")),
    ("mac_roman", "cp850"), ("cp437", "mac_roman"), ("cp850", "mac_roman"),
)


@lru_cache(64)
def _to_byte(codec: str) -> dict[str, int]:
    """The byte of each character; bytes without a character stand for the control of that number, as lenient decoders have it."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if codec == "cp1252":
        for b in range(128, 160):
            out.setdefault(chr(b), b)
    return out


@lru_cache(64)
def _runs(codec: str) -> re.Pattern:
    """Matches runs of characters whose bytes are whole multi-byte UTF-8 sequences."""
    of = {b: c for c, b in _to_byte(codec).items()}
    extra: dict[int, str] = {}
    for c, b in _to_byte(codec).items():
        extra[b] = extra.get(b, "") + c

    def chars(low: int, high: int) -> str:
        return "[" + "".join(re.escape(c) for b in range(low, high + 1) for c in extra.get(b, of.get(b, ""))) + "]"

    tail = chars(0x80, 0xBF)
    return re.compile(f"(?:{chars(0xC2, 0xDF)}{tail}|{chars(0xE0, 0xEF)}{tail}{{2}}|{chars(0xF0, 0xF4)}{tail}{{3}})+")


def undo_utf8(text: str, codec: str) -> str:
    """``text`` with every run that is UTF-8 taken for ``codec`` decoded anew."""
    to = _to_byte(codec)

    def again(m: re.Match) -> str:
        try:
            return bytes(to[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    return _runs(codec).sub(again, text)


@lru_cache(64)
def _swap(taken: str, true: str) -> dict[int, str]:
    out = {}
    for c, b in _to_byte(taken).items():
        if c == "\xa0":  # a space that does not break is no sign of anything
            continue
        try:
            out[ord(c)] = bytes([b]).decode(true)
        except UnicodeDecodeError:
            out[ord(c)] = "�"
    return out


_ENTITY = re.compile(r"&#(\d{3,4});")
_LEAD = re.compile("â€?|Ã(?![A-ZÀ-Þ])|�")
_LEADS = {"â": ("\u2000", "\u2fff"), "Ã": ("\xc0", "\xff")}
_HIGH = re.compile(r"[^\x00-\x7f]|&#\d{3,4};")
_ASCII = re.compile("[\x00-\x7f]")
_WORD = re.compile(r"[^\W\d_]+")
_INNER_CAPITAL = re.compile(r"(?<=[a-zà-öø-ÿ])[À-ÖØ-Þ](?=[a-zà-öø-ÿ])")


def _entities(token: str) -> str:
    """A token with its numeric entities as signs, where they make UTF-8 read wrongly; other entities are markup."""
    plain = _ENTITY.sub(lambda m: chr(int(m.group(1))) if 128 <= int(m.group(1)) < 0x2600 else m.group(), token)
    return plain if _readings(plain) else token


@lru_cache(200_000)
def _kind(c: str) -> str:
    """What a character is within a word: lower or capital Latin letter, letter of another script, mark, or symbol."""
    if c.isascii():
        return ("l" if c.islower() else "u") if c.isalpha() else "."
    category = unicodedata.category(c)
    if category == "Cf" or "\u0300" <= c <= "\u036f":
        return "m"
    if category[0] in "LM":
        name = unicodedata.name(c, "OTHER")
        return ("u" if category == "Lu" else "l") if name.startswith("LATIN") else name.split(" ")[0]
    if c in "’‘“”«»–—…¿¡\xa0‐‑":
        return "."
    return "s"


@lru_cache(100_000)
def breaks(token: str) -> int:
    """Places in a token where a letter meets a letter of another script or a symbol, or the case changes as in no word."""
    n, before, capitals = 0, ".", 0
    for c in token:
        k = _kind(c)
        if k == "m":
            continue
        if "." not in (before, k) and before != k and not (before == "u" and k == "l" and (capitals == 1 or c.isascii())):
            n += 1
        capitals = capitals + 1 if k == "u" else 0
        before = k
    # an inner capital is two breaks, like any foreign sign
    return n + len(_INNER_CAPITAL.findall(token))


def unpaired(tokens: Iterable[str]) -> int:
    """Quotation marks of a passage that have no partner."""
    text = "".join(tokens)
    return abs(text.count("“") - text.count("”")) + abs(text.count("«") - text.count("»"))


def places(token: str) -> Iterator[str]:
    """Each non-ASCII sign of a token with its place: 0 alone, 1 before a letter, 2 after one, 3 between two."""
    end = len(token) - 1
    for i, c in enumerate(token):
        if c > "\x7f":
            left = i > 0 and _kind(token[i - 1]) not in ".s"
            right = i < end and _kind(token[i + 1]) not in ".s"
            yield f"{c}{2 * left + right}"


_FUNCTION = {code: frozenset(words.split()) for code, words in zip(LANGUAGES, (COMMON_EN, COMMON_FR, COMMON_DE, COMMON_ES), strict=True)}
_MEMBER: dict[str, tuple[int, ...]] = {}
for _w in set().union(*_FUNCTION.values()):
    _MEMBER[_w] = tuple(i for i, code in enumerate(LANGUAGES) if _w in _FUNCTION[code])


def language(passage: str) -> str:
    """The language with the most function words in a passage, "" where fewer than two speak for one."""
    n = [0] * len(LANGUAGES)
    for w in passage.lower().split():
        if of := _MEMBER.get(w):
            for i in of:
                n[i] += 1
    most = max(n)
    return LANGUAGES[n.index(most)] if most >= 2 and n.count(most) == 1 else ""


def _passages(text: str) -> Iterator[tuple[str, list[str]]]:
    """The lines with signs beyond ASCII or numeric entities, and the words that have them."""
    for line in text.split("\n"):
        if (not line.isascii() or "&#" in line) and (tokens := [t for t in line.split(" ") if _marked(t)]):
            yield line, tokens


def _marked(token: str) -> bool:
    return not token.isascii() or "&#" in token


_BESIDE = re.compile("[^\x00-\x7f]{2}")


@lru_cache(300_000)
def _readings(token: str) -> int:
    """Which encodings UTF-8 may have been taken for in a token, as bits."""
    return sum(1 << i for i, codec in enumerate(READ_AS) if _runs(codec).search(token)) if _BESIDE.search(token) else 0


@lru_cache(300_000)
def _undone(token: str, i: int) -> str:
    return undo_utf8(token, READ_AS[i])


class Alphabet(dict):
    """Code points to bytes; signs without a byte of their own share the last, as their bits are counted apart."""

    def __missing__(self, c: int) -> int:
        self[c] = b = c if c < 128 else 255
        return b


def alphabet(bits: dict[str, float]) -> Alphabet:
    """A byte for each of the commonest signs of a language, so that no encoding of the signs makes one longer than another."""
    best: dict[str, float] = {}
    for p, b in bits.items():
        best[p[0]] = min(b, best.get(p[0], b))
    common = sorted(best, key=lambda c: (best[c], c))[:127]
    return Alphabet({ord(c): 128 + i for i, c in enumerate(common)})


def spelt(text: str, of: Alphabet) -> bytes:
    """A text in one byte a sign."""
    return text.translate(of).encode("latin-1")


_PLAIN = Alphabet()


@dataclass
class Models:
    """By language: the dictionary, the bits of each sign at each place, and words by their form with the signs lost."""

    dictionaries: dict[str, bytes]
    bits: dict[str, dict[str, float]]
    words: dict[str, dict[str, str]]

    def __post_init__(self) -> None:
        self.compressors: dict | None = None
        self.alphabets = {code: alphabet(of) for code, of in self.bits.items()}
        self.costs: dict[str, dict[str, float]] = {code: {} for code in LANGUAGES}
        self.swaps: dict[str, dict[str, tuple[float, ...]]] = {code: {} for code in LANGUAGES}
        self.bounds: dict[str, dict[str, float]] = {code: {} for code in LANGUAGES}
        self.least = {code: min(of.values(), default=0.0) for code, of in self.bits.items()}
        self.likely: dict[tuple[str, str], str] = {}

    def __getstate__(self) -> dict:
        return {"dictionaries": self.dictionaries, "bits": self.bits, "words": self.words}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def clear(self, tokens: tuple[str, ...], code: str) -> bool:
        """Whether no reading, loss or swap can explain any of the tokens better than they stand in the text's language."""
        return not any(map(_readings, tokens)) and not any(map(_LEAD.search, tokens)) and self.swap_bound(tokens, code) < SWAP_BITS

    def believed(self, word: str, code: str) -> bool:
        """Whether no loss or swap explains a word better than it stands, so that it may prove what a word with lost signs was."""
        return not self.spoilt(word, code)[1] and max(self.swapped(word, code)) < SWAP_BITS

    def packed(self, tokens: tuple[str, ...], code: str) -> float:
        """Bits of the tokens compressed with the language's dictionary."""
        if self.compressors is None:
            import zstandard

            self.compressors = {"": zstandard.ZstdCompressor(write_content_size=False, write_checksum=False)}
            for of, d in self.dictionaries.items():
                known = zstandard.ZstdCompressionDict(d)
                known.precompute_compress(level=LEVEL)
                self.compressors[of] = zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
        return 8.0 * len(self.compressors.get(code, self.compressors[""]).compress(spelt(" ".join(tokens), self.alphabets.get(code, _PLAIN))))

    def length(self, tokens: tuple[str, ...], code: str) -> float:
        """The description of a passage in bits: compressed size, signs, breaks and quotation marks without partner."""
        return self.packed(tokens, code) + sum(self.cost(t, code) for t in tokens) + PAIR_BITS * unpaired(tokens)

    def sign(self, place: str, code: str) -> float:
        """Bits of one sign at its place."""
        if (known := self.bits.get(code, {}).get(place)) is not None:
            return known
        c = place[0]
        if c == "�" or c < "\xa0":
            return LOST_BITS
        if "\ufb00" <= c <= "\ufb06":
            return LIGATURE_BITS
        unseen = UNSEEN_BITS if len(_kind(c)) == 1 and not "\u0180" <= c <= "\u02ff" else FOREIGN_BITS
        return min((of[place] + BORROWED_BITS for of in self.bits.values() if place in of), default=unseen)

    def cost(self, token: str, code: str) -> float:
        """Bits of a token beyond its compressed size: its signs and breaks."""
        known = self.costs[code]
        if (hit := known.get(token)) is None:
            if len(known) > 300_000:
                known.clear()
            hit = known[token] = self._cost(token, code)
        return hit

    def swapped(self, token: str, code: str) -> tuple[float, ...]:
        """What each single-byte swap saves of a token's cost."""
        known = self.swaps[code]
        if (hit := known.get(token)) is None:
            if len(known) > 300_000:
                known.clear()
            cost, out = self.cost(token, code), []
            for pair in SWAPPED:
                new = token.translate(_swap(*pair))
                out.append(0.0 if new == token else -math.inf if "�" in new and "�" not in token else cost - self._cost(new, code))
            hit = known[token] = tuple(out)
        return hit

    def swap_bound(self, tokens: tuple[str, ...], code: str) -> float:
        """About so many bits a swap may save of the signs of a passage.

        A swap keeps the number of signs, and each costs the least bits of any, so a token of usual signs has little to save.
        """
        known, bound = self.bounds[code], 0.0
        for t in tokens:
            if (hit := known.get(t)) is None:
                if len(known) > 300_000:
                    known.clear()
                excess = self.cost(t, code) - self.least.get(code, 0.0) * (len(t) - len(_ASCII.findall(t)))
                hit = known[t] = max(0.0, *self.swapped(t, code)) if excess > SWAP_BITS / 2 else max(0.0, excess / 4)
            bound += hit
        return bound

    def _cost(self, token: str, code: str) -> float:
        bits, before = BREAK_BITS * breaks(token), ""
        seats = places(token)
        for i, c in enumerate(token):
            kind = ""
            if c > "\x7f":
                kind, own = _kind(c), self.sign(next(seats), code)
                if kind == before and (kind == "s" or len(kind) > 1):
                    own = min(own, RUN_BITS["s" if kind == "s" else ""])
                elif len(kind) > 1 and all(_kind(d) == kind for d in token[i + 1 : i + 3]) and i + 3 <= len(token):
                    own = min(own, SCRIPT_BITS)
                bits += own
            before = kind
        return bits

    def likeliest(self, place: str, code: str, lead: str) -> str:
        """The commonest sign of a language at a place, of those whose UTF-8 begins with the sign that was left of it, if any."""
        key = (place + lead, code)
        if (hit := self.likely.get(key)) is None:
            low, high = _LEADS.get(lead, ("\xa1", "\uffff"))
            of = [(b, p[0]) for p, b in self.bits.get(code, {}).items() if p[1] == place and low <= p[0] <= high and _kind(p[0]) != "m"]
            hit = self.likely[key] = min(of, default=(0.0, "é" if lead == "Ã" else "—"))[1]
        return hit

    def spoilt(self, token: str, code: str) -> tuple[str, list[str]]:
        """A token with a replacement sign for each lost sign, and the lead byte left of each, if any.

        Lost are replacement signs, and lead bytes at unlikely places whose followers are gone.
        """
        seats = iter(list(places(token)))
        of = {i: next(seats) for i, c in enumerate(token) if c > "\x7f"}
        leads: list[str] = []

        def mark(m: re.Match) -> str:
            if m.group() != "�" and self.sign(of[m.start()], code) < LEAD_BITS:
                return m.group()
            leads.append("" if m.group() == "�" else m.group()[0])
            return "�"

        return _LEAD.sub(mark, token), leads

    def regained(self, token: str, code: str) -> tuple[str, str, int]:
        """A token with lost signs as it may have been, as far as the language's words prove it, and how many signs were lost."""
        spoilt, leads = self.spoilt(token, code)
        guess = proven = spoilt
        if (m := _SPOILT.search(spoilt)) and (word := self.words.get(code, {}).get(m.group())):
            guess = proven = spoilt[: m.start()] + word + spoilt[m.end() :]
            first = spoilt[: m.start()].count("�")
            kept = leads[:first] + leads[first + m.group().count("�") :]
        else:
            kept = leads
        for lead in kept:
            i = guess.index("�")
            place = next(p[1] for p in places(guess) if p[0] == "�")
            guess = guess[:i] + self.likeliest(place, code, lead) + guess[i + 1 :]
        return guess, proven, len(leads)


_SPOILT = re.compile(r"[^\W\d_]*(?:�+[^\W\d_]+)+�*|[^\W\d_]+�+")


@dataclass
class Repair:
    text: str
    chain: str  # the steps undone, outermost first, e.g. "cp1252<utf8"; several chains of several passages joined by ";"
    affected: bool
    recovered: bool


@dataclass
class _Reading:
    """One candidate for the tokens of a passage: bits saved against the passage as it stands."""

    saved: float
    price: float
    tokens: tuple[str, ...]


def _candidates(tokens: tuple[str, ...], code: str, models: Models) -> dict[str, _Reading]:
    """Every chain that shortens the description of a passage, step by step.

    A chain is followed as long as each step shortens it.  Swaps are tried where no reading as UTF-8 shortens it, and
    compressed where they make the signs themselves cheaper by ``SWAP_BITS`` or more.
    """
    base = models.length(tokens, code)
    out: dict[str, _Reading] = {}
    states: list[tuple[str, float, tuple[str, ...], float]] = [("", 0.0, tokens, base)]
    seen = {tokens}

    def weigh(chain: str, price: float, new: tuple[str, ...], shown: tuple[str, ...], extra: float, before: float) -> float:
        seen.add(new)
        bits = models.length(new, code) + extra
        if bits < before:
            out[chain] = _Reading(base - bits, price, shown)
        return bits

    while states:
        later = []
        for chain, price, now, bits in states:
            prefix = f"{chain}>" if chain else ""
            mask = 0
            for t in now:
                mask |= _readings(t)
            shorter = False
            for i, codec in enumerate(READ_AS):
                if mask >> i & 1 and (new := tuple([_undone(t, i) for t in now])) not in seen:
                    left = weigh(f"{prefix}{codec}<utf8", price + STEP_BITS, new, new, 0.0, bits)
                    if left < bits:
                        shorter = True
                        if prefix.count(">") + 1 < MOST_STEPS:
                            later.append((f"{prefix}{codec}<utf8", price + STEP_BITS, new, left))
            if shorter:
                continue
            if models.swap_bound(now, code) >= SWAP_BITS:
                for i, total in enumerate(map(sum, zip(*[models.swapped(t, code) for t in now], strict=True))):
                    if total >= SWAP_BITS:
                        taken, true = SWAPPED[i]
                        new = tuple([t.translate(_swap(taken, true)) for t in now])
                        if new not in seen:
                            weigh(f"{prefix}{taken}<{true}", price + (STEP_BITS if true == "cp1252" else RARE_STEP_BITS), new, new, 0.0, bits)
            if (not chain or chain.endswith("cp1252<utf8")) and any(map(_LEAD.search, now)):
                guess, proven, lost = zip(*[models.regained(t, code) if _LEAD.search(t) else (t, t, 0) for t in now], strict=True)
                if sum(lost) and guess not in seen:
                    weigh(f"{prefix}utf8<cp1252" if "�" in "".join(now) else f"{prefix}lost", price + STEP_BITS, guess, proven, LOSS_BITS * sum(lost), bits)
        states = later
    return out


def _spoken(text: str) -> Iterator[tuple[str, list[str], tuple[str, ...], str]]:
    """Each different passage of a text: its line, its words, the words with entities as signs, and the text's language."""
    seen: set[str] = set()
    of_text = ""
    for line, tokens in _passages(text):
        if line not in seen:
            seen.add(line)
            of_text = of_text or language(line) or language(text) or LANGUAGES[0]
            yield line, tokens, tuple([_entities(t) if "&#" in t else t for t in tokens]), of_text


@lru_cache(300_000)
def _lossy(token: str) -> tuple[str, ...]:
    """A token as ``_candidates`` may ask for its lost signs: as it stands, or after readings of which the last is cp1252."""
    out, now = {token}, {token}
    for _ in range(MOST_STEPS - 1):
        now |= {_undone(t, i) for t in now if (mask := _readings(t)) for i in range(len(READ_AS)) if mask >> i & 1}
        out |= {_undone(t, READ_AS.index("cp1252")) for t in now}
    return tuple(t for t in sorted(out | now) if _LEAD.search(t))


def repaired(text: str, models: Models) -> Repair:
    """The repair of a text; a text without affected passages comes back as it is.

    A chain is paid for once a text and then helps all its passages; chains are taken by what they save, greatest first.
    """
    if text.isascii() and "&#" not in text:
        return Repair(text, "", False, False)
    open_lines: dict[str, dict[str, _Reading]] = {}
    entities = {}
    for line, tokens, plain, of_text in _spoken(text):
        entities[line] = list(plain) != tokens
        if models.clear(plain, of_text):
            continue
        if found := _candidates(plain, language(line) or of_text, models):
            open_lines[line] = found
    fixed: dict[str, tuple[str, ...]] = {}
    chains: list[str] = []
    while open_lines:
        totals: dict[str, float] = {}
        for found in open_lines.values():
            for chain, r in found.items():
                totals[chain] = totals.get(chain, -r.price) + r.saved
        chain = max(totals, key=lambda c: (totals[c], c))
        if totals[chain] <= 0:
            break
        for line in [k for k, found in open_lines.items() if chain in found]:
            best = open_lines[line][chain]
            others = [(r.saved, c) for c, r in open_lines[line].items() if r.saved > best.saved + r.price]
            if others:  # another chain explains this passage better even at its price
                continue
            fixed[line] = best.tokens
            name = f"entities>{chain}" if entities[line] else chain
            if name not in chains:
                chains.append(name)
            del open_lines[line]
        for found in open_lines.values():
            found.pop(chain, None)
        open_lines = {k: v for k, v in open_lines.items() if v}
    if not fixed:
        return Repair(text, "", False, False)
    out = []
    for line in text.split("\n"):
        if (tokens := fixed.get(line)) is not None:
            again = iter(tokens)
            line = " ".join([next(again) if _marked(t) else t for t in line.split(" ")])
        out.append(line)
    new = "\n".join(out)
    return Repair(new, ";".join(chains), True, "�" not in new and not any(c.endswith(("lost", "utf8<cp1252")) for c in chains))


_COUNTS = pa.schema([("h", pa.int64()), ("keys", pa.list_(pa.string()))])
_ASKED = pa.schema([("code", pa.string()), ("form", pa.string())])


@lru_cache(300_000)
def _countable(token: str) -> tuple[tuple[str, ...], tuple[str, ...]] | None:
    """The signs of a token with their places, and the token with its words beyond ASCII; none of an unsound token."""
    if not _sound(token):
        return None
    return tuple(["p" + p for p in places(token)]), ("t" + token, *["w" + w for w in _WORD.findall(token) if not w.isascii()])


def _sound(token: str) -> bool:
    """Whether a token may be counted as written: no reading as UTF-8, no lost or control sign."""
    return not _readings(token) and "&#" not in token and not any(c == "�" or "\x7f" < c < "\xa0" for c in token)


def _keys(text: str) -> list[str]:
    """What a text counts for: signs at their places, tokens and words of its language, the text itself ("#"), and lossy tokens ("l").

    Signs are counted of sound tokens, tokens and words of lines that are sound as a whole; lossy tokens are of their line's language.
    """
    keys: set[str] = set()
    lossy: set[str] = set()
    for line, tokens, plain, of_text in _spoken(text):
        found = list(map(_countable, tokens))
        whole = None not in found
        for signs, words in filter(None, found):
            keys.update(signs)
            if whole:
                keys.update(words)
        if asking := list(joined.from_iterable(map(_lossy, plain))):
            code = language(line) or of_text
            lossy.update(f"{code}l{t}" for t in asking)
    if keys:
        code = language(text) or LANGUAGES[0]
        lossy.update(code + k for k in keys)
        lossy.add(code + "#")
    return list(lossy)


def _marked_rows(documents: DataFrame) -> DataFrame:
    """The rows whose text has signs beyond ASCII or numeric entities; no other text is counted or repaired."""
    return documents.where("text IS NOT NULL").where(F.col("text").rlike(_HIGH.pattern))


def _text_counts(rows: DataFrame) -> DataFrame:
    """``(code, kind, what, n)``: in how many different texts of a language each sign at its place, token, word and lossy token stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(_keys, b.column(1).to_pylist())), pa.list_(pa.string()))], schema=_COUNTS)

    keyed = rows.select(F.xxhash64("text").alias("h"), "text").mapInArrow(run, "h long, keys array<string>")
    once = keyed.groupBy("h").agg(F.first("keys").alias("keys"))  # copies are one text, merged before the shuffle
    counted = once.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.substring("key", 1, 2).alias("code"), F.substring("key", 3, 1).alias("kind"), F.expr("substring(key, 4)").alias("what"), "n")


def _asked_forms(tokens: DataFrame, models: Models) -> DataFrame:
    """``(code, form)`` of all words with lost signs that a repair may look up, of the lossy tokens ``(code, what)``."""
    known = tokens.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column("code").to_pylist(), b.column("what").to_pylist(), strict=True)
            found = {(code, m.group()) for code, t in pairs if (m := _SPOILT.search(known.value.spoilt(t, code)[0]))}
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found, strict=True)] or [pa.array([], pa.string())] * 2, schema=_ASKED)

    return tokens.mapInArrow(run, "code string, form string").distinct()


def _believed_words(words: DataFrame, models: Models) -> DataFrame:
    """The rows of ``(code, form, what, n)`` whose word is not itself better explained by a loss or a swap."""
    known = words.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column("what").to_pylist(), b.column("code").to_pylist(), strict=True)
            yield b.filter(pa.array([known.value.believed(w, code) for w, code in pairs], pa.bool_()))

    return words.mapInArrow(run, words.schema)


def trained(counts: list[tuple[str, int]], signs: Alphabet) -> bytes:
    """A dictionary of the tokens, commonest first, each weighed by its count; the tokens themselves where they are too few."""
    import zstandard

    share = min(1.0, TRAINING_BYTES / max(1, sum(n * (len(t) + 1) for t, n in counts)))
    tokens = [t for t, n in counts for _ in range(max(1, round(n * share)))]
    Random(len(tokens)).shuffle(tokens)  # the order is arbitrary but always the same
    text = spelt(" ".join(tokens), signs)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [text[i : i + 400] for i in range(0, len(text), 400)]).as_bytes()
    except zstandard.ZstdError:
        return spelt(" ".join([t for t, _ in reversed(counts)]), signs)[-DICTIONARY_BYTES:]


def fit(documents: DataFrame, all_words: bool = True) -> Models:
    """The models, all from counts over all different texts, whole, whatever language they are said to be of.

    To the driver come the signs of ``LEAST_TEXTS`` texts and more, bounded by the signs in use; the commonest tokens, as many as
    a dictionary can hold; and the words: all, or only those that a repair of these texts may look up.
    """
    counts = _text_counts(_marked_rows(documents).select("text")).persist(StorageLevel.DISK_ONLY)
    seen = {(r[0], r[1] + r[2]): r[3] for r in counts.where(F.col("kind").isin("p", "#") & (F.col("n") >= LEAST_TEXTS)).collect()}
    bits: dict[str, dict[str, float]] = {}
    for code in LANGUAGES:
        least = max(LEAST_TEXTS, LEAST_SHARE * seen.get((code, "#"), 0))
        of = {k[1:]: n for (own, k), n in seen.items() if own == code and k != "#" and n >= least}
        total = sum(of.values())
        bits[code] = {p: -math.log2(n / total) for p, n in of.items()}
    ranked = [counts.where((F.col("kind") == "t") & (F.col("code") == code)).orderBy(F.desc("n"), "what").limit(DICTIONARY_WORDS) for code in LANGUAGES]
    tokens: dict[str, list[tuple[str, int]]] = {}
    for r in sorted(reduce(DataFrame.unionAll, ranked).collect(), key=lambda r: (-r.n, r.what)):
        tokens.setdefault(r.code, []).append((r.what, r.n))
    dictionaries = {code: trained(of, alphabet(bits[code])) for code, of in tokens.items()}
    signs = Models({}, bits, {})
    known = counts.where("kind = 'w'").select("code", F.regexp_replace("what", "[^\\x00-\\x7f]", "�").alias("form"), "what", "n")
    if not all_words:
        known = known.join(_asked_forms(counts.where("kind = 'l'").select("code", "what"), signs), ["code", "form"], "left_semi")
    commonest = F.min(F.struct((-F.col("n")).alias("n"), "what"))["what"].alias("word")
    words: dict[str, dict[str, str]] = {code: {} for code in LANGUAGES}
    for r in _believed_words(known, signs).groupBy("code", "form").agg(commonest).collect():
        words[r.code][r.form] = r.word
    counts.unpersist()
    return Models(dictionaries, bits, words)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("chain", pa.string()), ("recovered", pa.bool_()), ("text", pa.string())])


def garbled(documents: DataFrame, models: Models | None = None) -> DataFrame:
    """``(doc_id, chain, recovered, text)`` of each text that was decoded wrongly, with the text as far as it could be restored.

    - Null ids, null texts and empty texts give no rows; repeated rows count once; extra columns are ignored.
    - A passage is a line.  Texts with lost signs are affected but not recovered; a word is restored where the language knows only one for it.
    - Whole texts are read, and all of them are counted for the models.  The models sent to the tasks are bounded by the signs in use,
      the size of the dictionaries and the different words that have lost signs in these texts.
    """
    rows = _marked_rows(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    known = documents.sparkSession.sparkContext.broadcast(models or fit(documents, all_words=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                r = repaired(text, known.value)
                if r.affected:
                    found.append((doc, r.chain, r.recovered, r.text))
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

    return rows.mapInArrow(run, "doc_id long, chain string, recovered boolean, text string")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return garbled(read_table(spark, folder, "documents")).select("doc_id").distinct()


def p9_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """The affected documents with what could be restored of their text."""
    return garbled(read_table(spark, folder, "documents")).distinct()


QUERIES = {"p9_found": p9_found, "p9_repaired": p9_repaired}
ORACLES: dict[str, str] = {}
