"""Words and characters of many texts at once, as numpy arrays.

A word is a maximal run of letters or digits (Unicode L or N). Texts of an
Arrow batch are taken in portions of a bounded number of characters; one text
is never split, so a longer text makes a portion of its own.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

#: Characters in a portion, unless one text has more.
PORTION = 1_000_000

ALNUM, SPACE, STRIP, END = 1, 2, 4, 8


@functools.cache
def char_classes() -> np.ndarray:
    """Flags of every code point: ALNUM for L and N, SPACE for white space, STRIP for space, tab and CR, END for . ! ? ; :"""
    every = [chr(i) for i in range(0x110000)]
    flags = np.fromiter((c.isalnum() for c in every), np.uint8, 0x110000) * ALNUM
    flags |= np.fromiter((c.isspace() for c in every), np.uint8, 0x110000) * np.uint8(SPACE)
    for chars, flag in ((" \t\r", STRIP), (".!?;:", END)):
        flags[[ord(c) for c in chars]] |= flag
    return flags


@functools.cache
def _char_codes() -> np.ndarray:
    """A random 64-bit code of every code point."""
    return np.random.default_rng(7).integers(1, 1 << 63, 0x110000, dtype=np.int64).view(np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BASE = 0x9E3779B97F4A7C15 | 1
_held: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    if base not in _held or len(_held[base]) < n:
        _held[base] = _powers(base, 1 << max(20, n.bit_length()))
    return _held[base]


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, each followed by a line feed, and where each text begins (one more than texts)."""
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    joined = "\n".join([*texts, ""])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), starts


def bounds(alnum: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of true; the last element is false."""
    change = np.flatnonzero(np.diff(alnum.view(np.int8), prepend=np.int8(0)))
    return change[0::2], change[1::2]


def hashes(cp: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of cp[begin[i]:end[i]], the same for the same characters wherever they are."""
    n = len(cp)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_char_codes()[cp] * _power_table(_BASE, n)[:n], out=total[1:])
    h = (total[end] - total[begin]) * _power_table(pow(_BASE, -1, 1 << 64), n + 1)[begin]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def portions(texts: list[str | None], most: int = PORTION) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) portions; null texts become empty ones."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if held and size + len(t) > most:
            yield at, held
            at, held, size = i, [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield at, held


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the lower-cased texts, and the index of each text's first word (one more than texts)."""
    cp, starts = points([t.lower() for t in texts])
    begin, end = bounds((char_classes()[cp] & ALNUM).astype(bool))
    return hashes(cp, begin, end), np.searchsorted(begin, starts)
