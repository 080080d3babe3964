"""Words of many texts as one array of 64-bit hashes, so that shingles are computed a batch at a time."""

import re
import unicodedata

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile(r"[̀-ͯ҃-҉᪰-᫿᷀-᷿⃐-⃿︠-︯]+")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑⁃¬­][^\S\n]*\n\s*(?=[^\W\d_])")
_INVISIBLE = re.compile("[­​‌‍⁠﻿]+")
_CACHE_LIMIT = 2_000_000
_hashes: dict[str, int] = {}


def folded(text: str) -> str:
    """``text`` without case, accents, compatibility forms, soft hyphens and line-end hyphenation."""
    if "\n" in text:
        text = _BROKEN.sub("", text)
    if text.isascii():
        return text.lower()
    text = _INVISIBLE.sub("", text)
    return _MARKS.sub("", unicodedata.normalize("NFKD", text)).casefold()


def word_hashes(words: list[str]) -> list[int]:
    """A 64-bit hash of each word, kept for words seen before; the store is emptied when full."""
    if len(_hashes) > _CACHE_LIMIT:
        _hashes.clear()
    try:
        return [_hashes[w] for w in words]
    except KeyError:
        for w in words:
            if w not in _hashes:
                _hashes[w] = xxhash.xxh64_intdigest(w)
        return [_hashes[w] for w in words]


def stream(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the offset of each text (one more than there are texts)."""
    flat = [w for words in texts for w in words]
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(words) for words in texts], out=offsets[1:])
    return np.array(word_hashes(flat), dtype=np.uint64), offsets


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of a public mixing function)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of ``k`` consecutive words; element i starts at word i."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD1342543DE82EF95) + hashes[j : j + n]
    return mixed(out)


def whole_grams(offsets: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the ``n`` grams of the joined stream lie within one text."""
    inside = np.ones(n, dtype=bool)
    for j in range(1, k):
        cut = offsets[1:-1] - j
        inside[cut[(cut >= 0) & (cut < n)]] = False
    return inside
