"""Whole-text measurements shared by the quality rules and the quality classifier; one pass, integers only."""

from __future__ import annotations

import numpy as np
import pandas as pd

from .arrays import covered, per_row, span_hashes, windows, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_punct", "n_kinds")


def measure(data: np.ndarray, offsets: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    """Counts of every text of a slice.

    word_chars: code points in words. n_lines: ``\\n``-split lines with a word; n_dup_lines: those equal to an earlier
    one. n_repeat_words: words in windows of five words found twice or more in the text. n_kinds: distinct words.
    n_upper, n_digits, n_punct: ASCII capitals, digits and ``.,;:!?``.
    """
    starts, ends, first = words(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    hashes = span_hashes(data, starts, ends)
    salt = (np.arange(len(offsets) - 1, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)

    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0

    at, gram_row = windows(first, window)
    grams = pd.Series(span_hashes(hashes, at, at + window) ^ salt[gram_row])
    again = covered(at[grams.duplicated(keep=False).to_numpy()], window, len(starts))

    line_starts, line_ends, line_first = words(data, offsets, NEWLINE)
    has_word = np.searchsorted(starts, line_starts) < np.searchsorted(starts, line_ends)
    line_row = np.repeat(np.arange(len(offsets) - 1), np.diff(line_first))
    lines = pd.Series(span_hashes(data, line_starts, line_ends) ^ salt[line_row])
    repeated = np.zeros(len(lines), bool)
    repeated[has_word] = lines[has_word].duplicated().to_numpy()

    return {
        "n_words": np.diff(first),
        "word_chars": per_row(inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": per_row(SYMBOLS[data], offsets),
        "n_dup_lines": per_row(repeated, line_first),
        "n_repeat_words": per_row(again, first),
        "n_lines": per_row(has_word, line_first),
        "n_upper": per_row((data >= 65) & (data <= 90), offsets),
        "n_digits": per_row((data >= 48) & (data <= 57), offsets),
        "n_punct": per_row(np.isin(data, np.frombuffer(b".,;:!?", np.uint8)), offsets),
        "n_kinds": per_row(~pd.Series(hashes ^ salt[row]).duplicated().to_numpy(), first),
    }
