"""Fuzzy matching: the letters of a query in order within a text, scored by where they fall.

The score of a text is SCALE times the best sum over its letters' places, less its length. A place is worth LETTER
and, unless it directly follows the place before, what its start is worth: FIRST at the text's beginning, WORD
after a character that is no letter or digit, CAMEL at a capital after a small letter. Following directly is worth
RUN instead. The first letter loses a point for each character before it, up to MOST_LATE; a later one
loses SKIP and a point for each character that was skipped, up to MOST_GAP.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the score.
LETTER, FIRST, WORD, CAMEL, RUN, SKIP, MOST_LATE, MOST_GAP = 10, 16, 10, 8, 12, 2, 12, 8
SCALE, MOST_LENGTH = 4, 60
NONE = -(1 << 40)


def starts(text: str) -> np.ndarray:
    """What a match at each character is worth for being a start."""
    c = list(text)
    after_sign = np.array([False, *(not x.isalnum() for x in c[:-1])], bool)
    hump = np.array([False, *(a.islower() and b.isupper() for a, b in zip(c, c[1:], strict=False))], bool)
    out = np.where(after_sign, WORD, np.where(hump, CAMEL, 0))
    out[:1] = FIRST
    return out


def moved(row: np.ndarray, by: int) -> np.ndarray:
    """``row`` moved to the right, empty places first."""
    return np.concatenate((np.full(min(by, len(row)), NONE), row[: max(0, len(row) - by)]))


def score(query: str, text: str) -> int | None:
    """Best score of an alignment, or None if there is none; an empty query scores 0.

    All places of one letter are scored at once. ``far`` is the best place so far back that its gap costs the most,
    a running maximum; nearer ones are MOST_GAP moved copies of the row.
    """
    wanted = "".join(query.split()).lower()
    if not wanted:
        return 0
    if not text:
        return None
    low, worth = np.array([x.lower()[:1] or x for x in text]), starts(text)
    best = worth - np.minimum(np.arange(len(text)), MOST_LATE)
    for n, letter in enumerate(wanted):
        if n:
            far = moved(np.maximum.accumulate(best), MOST_GAP + 1) - MOST_GAP
            near = [moved(best, gap + 1) - gap for gap in range(1, MOST_GAP)]
            best = np.maximum(moved(best, 1) + RUN, np.maximum.reduce([far, *near]) - SKIP + worth)
        best = np.where(low == letter, best + LETTER, NONE)
    top = int(best.max())
    return top * SCALE - min(len(text), MOST_LENGTH) if top > NONE // 2 else None
