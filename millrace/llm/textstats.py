"""Counts that the rules and the classifier use, one text at a time."""

from __future__ import annotations

import re
from collections import Counter

from millrace.llm.common import WORD, words_of

SYMBOLS = "#*$%&|<>"
_has_word = re.compile(WORD).search


def repeated_words(words: list[str], width: int = 3) -> int:
    """Words in windows of ``width`` words that the text has twice or more."""
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    covered = upto = 0
    for i, window in enumerate(windows):
        if found[window] > 1:
            covered += i + width - max(i, upto)
            upto = i + width
    return covered


def text_stats(text: str | None) -> dict[str, int]:
    """Linear in the text; NULL is a text without words."""
    text = text or ""
    words = words_of(text)
    lines = [line for line in text.split("\n") if _has_word(line)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
        "n_distinct_words": len(set(words)),
        "n_stops": text.count(".") + text.count(","),
        "n_after_itself": sum(a == b for a, b in zip(words, words[1:], strict=False)),
    }
