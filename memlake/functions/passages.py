"""The passage of a text that says most about a question."""

from __future__ import annotations

import bisect
import re

from memlake.functions.words import STOP, WORD, fold, stem

_EDGE = re.compile(r"(?<=[.!?])\s+|\n+")


def best_window(text: str, weights: dict[str, float], size: int = 400) -> tuple[int, int]:
    """(begin, end) of the window of at most size characters whose distinct terms (stems with weights) weigh most, the
    first of equal ones, moved out to the nearest ends of sentences that it has room for. A text without any of the
    terms gives its beginning; a word longer than the window is cut.

    Two ends move over the places of the terms, so the time grows with their number only.
    """
    hits = [(m.start(), m.end(), s) for m in WORD.finditer(fold(text).lower() if text.isascii() else text.lower()) if (s := stem(m[0])) in weights and m[0] not in STOP]
    begin, end = (hits[0][0], hits[0][1]) if hits else (0, 0)
    best, held, weight, left = -1.0, {}, 0.0, 0
    for start, stop, term in hits:
        held[term] = held.get(term, 0) + 1
        weight += weights[term] * (held[term] == 1)
        while hits[left][0] < start and stop - hits[left][0] > size:
            gone = hits[left][2]
            held[gone] -= 1
            weight -= weights[gone] * (held[gone] == 0)
            left += 1
        if weight > best + 1e-12:
            best, begin, end = weight, hits[left][0], stop
    end = min(end, begin + size)
    edges = [0, *(m.end() for m in _EDGE.finditer(text)), len(text)]
    first = edges[bisect.bisect_right(edges, begin) - 1]
    begin = first if end - first <= size else begin
    last = bisect.bisect_right(edges, begin + size) - 1
    return begin, max(end, edges[last]) if edges[last] > begin else min(begin + size, len(text))
