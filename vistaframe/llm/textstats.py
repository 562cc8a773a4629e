"""Counts over whole texts that the quality operators share."""

from __future__ import annotations

import numpy as np

from vistaframe.llm.common import U, WordHash, mix, spaced_words

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_echoes", "n_digits")
_BASE = U(0xD6E8FEB86659FD93)


def repeats(keys: np.ndarray) -> np.ndarray:
    """Which of the keys occur twice or more."""
    order = np.argsort(keys)
    k = keys[order]
    same = np.r_[False, k[1:] == k[:-1]]
    out = np.zeros(len(keys), bool)
    out[order] = same | np.r_[same[1:], False]
    return out


def text_stats(texts: list, hashes: WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts by text in the order of COLUMNS, the word hashes of all texts, the text of each word).

    n_dup_lines: lines with a word that equal an earlier one. n_repeat_words: words in three-word windows
    that the text holds twice or more. n_echoes: words equal to the one before. Null texts count as empty.
    """
    texts = [t or "" for t in texts]
    words = [spaced_words(t) for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    a = hashes.of([w for x in words for w in x])
    doc = np.repeat(np.arange(len(texts)), n)
    of = mix(doc.astype(U) + U(1))

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.bincount(doc[: len(flags)][flags], minlength=len(texts))

    inside = np.r_[doc[2:] == doc[:-2], np.zeros(min(2, len(doc)), bool)] if len(doc) > 2 else np.zeros(len(doc), bool)
    at = np.flatnonzero(inside)
    window = mix((a[at] * _BASE + a[at + 1]) * _BASE + a[at + 2]) ^ of[at]
    again = np.zeros(len(a) + 2, bool)
    start = at[repeats(window)]
    for k in range(3):
        again[start + k] = True
    pair = np.sort(a ^ of) if len(a) else a
    order = np.argsort(a ^ of, kind="stable")
    first = np.zeros(len(a), bool)
    first[order] = np.r_[True, pair[1:] != pair[:-1]] if len(a) else []
    echo = np.r_[False, (a[1:] == a[:-1]) & (doc[1:] == doc[:-1])] if len(a) else first
    lines = [t.split("\n") for t in texts]
    full = [[x for x in line if x.strip(SPACES)] for line in lines]
    counts = np.stack([
        n,
        [len(t) - sum(map(t.count, SPACES)) for t in texts],
        [sum(map(t.count, SYMBOLS)) for t in texts],
        [len(x) for x in full],
        [len(x) - len(set(x)) for x in full],
        per_text(again[: len(a)]),
        per_text(first),
        per_text(echo),
        [sum(map(t.count, "0123456789")) for t in texts],
    ], axis=1).astype(np.int64)
    return counts, a, doc


def ratios(counts: np.ndarray) -> np.ndarray:
    """Scale-free statistics of the counts: log length, then shares."""
    c = dict(zip(COLUMNS, counts.T.astype(float)))
    words, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    return np.stack([
        np.log1p(c["n_words"]),
        np.minimum(c["word_chars"] / words, 40),
        c["n_symbols"] / chars,
        c["n_dup_lines"] / lines,
        c["n_repeat_words"] / words,
        c["n_distinct"] / words,
        c["n_echoes"] / words,
        c["n_digits"] / chars,
    ], axis=1)
