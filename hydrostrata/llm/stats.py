"""Counts over one text, shared by the quality operators. Words are runs of bytes other than space and \\t to \\r."""

from __future__ import annotations

import numpy as np

from .common import mix64

SYMBOLS = "#*$%&|<>"
_WINDOW = 8
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(_WINDOW)], np.uint64)


def words_of(text: str) -> list[bytes]:
    """bytes.split() parts at exactly the ASCII white space \\x20 and \\x09-\\x0D."""
    return text.encode().split()


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in an 8-word window found twice or more in the text."""
    n = len(words) - _WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = mix64(np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words)) + np.uint64(1))
    h = np.zeros(n, np.uint64)
    for k in range(_WINDOW):
        h += ids[k : k + n] * _POWERS[k]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int32)
    at = np.flatnonzero(hit)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + _WINDOW, -1)
    return int((np.cumsum(cover) > 0).sum())


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode())
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += bool(line.encode().split())
        else:
            seen.add(line)
    return len(words), chars, symbols, dup, repeat_words(words)
