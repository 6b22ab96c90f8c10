"""Words and character n-grams of a text as numpy arrays."""

from __future__ import annotations

import functools
import sys

import numpy as np

#: First code point of a script's range, and the script. What lies between named ranges is "Other".
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0780, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Other"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"), (0x323B0, "Other"),
)


@functools.cache
def kinds() -> np.ndarray:
    """For each code point: 0 outside words, 1 digit, 2 letter."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        x = chr(c)
        if x.isalpha():
            table[c] = 2
        elif x.isdigit():
            table[c] = 1
    return table


@functools.cache
def script_table() -> tuple[np.ndarray, list[str]]:
    names = list(dict.fromkeys(s for _, s in SCRIPTS))
    starts = [a for a, _ in SCRIPTS]
    lens = np.diff([*starts, sys.maxunicode + 1])
    return np.repeat(np.array([names.index(s) for _, s in SCRIPTS], np.uint8), lens), names


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def word_runs(points: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end (exclusive) of the runs of code points of kind `least` or more."""
    inside = np.zeros(len(points) + 2, np.int8)
    inside[1:-1] = kinds()[points] >= least
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def grams(points: np.ndarray, begin: np.ndarray, end: np.ndarray, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word, its two edges included, word after word; and how many each word has."""
    counts = np.maximum(end - begin + 3 - size, 0)  # an edge at either side
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64), counts
    starts = np.cumsum(counts) - counts
    at = np.arange(total) - np.repeat(starts, counts) + np.repeat(begin - 1, counts)
    last = np.repeat(end, counts)
    first = np.repeat(begin, counts)
    code = np.full(total, size, np.uint64)
    for k in range(size):
        p = at + k
        edge = (p < first) | (p >= last)
        code = (code ^ np.where(edge, 0, points[np.clip(p, 0, len(points) - 1)]).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return (code >> np.uint64(64 - bits)).astype(np.int64), counts


def per_word(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive values (along the first axis), counts[k] of them for word k."""
    sums = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def lettered(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the words (no end being another's begin) that have a letter."""
    if not len(begin):
        return begin, end
    letters = np.r_[0, np.cumsum(kinds()[points] == 2)]
    has = letters[end] > letters[begin]
    return begin[has], end[has]
