"""Words that stay the same under letter case, punctuation, spacing, line marks, invisible characters and Unicode form."""

from __future__ import annotations

import unicodedata

import numpy as np
import regex
import xxhash

#: Invisible: format characters, and marks that no letter takes in (variation selectors, stray combining marks).
INVISIBLE = regex.compile(r"[\p{Cf}\p{Mn}\p{Me}\p{Co}ᅟᅠㅤﾠ⠀]+")
WORD = regex.compile(r"[\p{L}\p{N}]+")
_hashes: dict[str, int] = {}


def plain(text: str) -> str:
    """Compatibility form, folded case, without invisible characters."""
    if text.isascii():
        return text.lower()
    text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return INVISIBLE.sub("", unicodedata.normalize("NFKC", text.casefold()))


def words(text: str | None) -> list[str]:
    """The runs of letters and digits of a text."""
    return WORD.findall(plain(text)) if text else []


def hashes(ws: list[str]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    known = _hashes
    if len(known) > 500_000:
        known.clear()
    out = []
    for w in ws:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2^64) of each run of width words."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return out
