"""Numbers that describe a whole text, without reading what it says."""

from __future__ import annotations

import math
from functools import cache

import numpy as np

NAMES = ("log_chars", "log_words", "word_length", "length_spread", "capitals", "digits", "symbols", "marks", "punctuation",
         "letters", "line_length", "variety", "stutter", "repeated_lines")
_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _SYMBOL, _MARK, _OTHER = range(8)


@cache
def _classes() -> np.ndarray:
    table = np.full(0x110000, _OTHER, dtype=np.uint8)
    for cp in range(0x110000):
        ch = chr(cp)
        if ch.isalpha():
            table[cp] = _UPPER if ch.isupper() else _LOWER
        elif ch.isdigit():
            table[cp] = _DIGIT
        elif ch.isspace():
            table[cp] = _LINE if ch == "\n" else _SPACE
    table[[ord(ch) for ch in "#*$%&|<>"]] = _SYMBOL
    table[[ord(ch) for ch in "!?"]] = _MARK
    return table


def describe(text: str | None) -> list[float]:
    """The transformed statistics of one text, in the order of NAMES; null counts as empty.

    Rates are square-rooted and sizes logged, which brings them nearer to normal.
    """
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    n = np.bincount(_classes()[codes], minlength=8).tolist()
    ws = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    many, chars, letters = max(1, len(ws)), max(1, len(codes)), max(1, n[_LOWER] + n[_UPPER])
    sizes = np.fromiter(map(len, ws), dtype=np.float64, count=len(ws)) if ws else np.zeros(1)
    mean = float(sizes.mean())
    spread = math.sqrt(max(0.0, float((sizes * sizes).mean()) - mean * mean))
    stutter = sum(map(str.__eq__, ws, ws[1:]))
    root = math.sqrt
    return [
        math.log1p(len(codes)), math.log1p(len(ws)), math.log1p(mean), math.log1p(spread),
        root(n[_UPPER] / letters), root(n[_DIGIT] / chars), root(n[_SYMBOL] / many), root(n[_MARK] / many), root(n[_OTHER] / chars),
        root(letters / chars), math.log1p(len(ws) / max(1, len(lines))),
        math.log1p(len(set(ws))) / math.log1p(many), root(stutter / many), root((len(lines) - len(set(lines))) / max(1, len(lines))),
    ]
