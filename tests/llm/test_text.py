import random

import numpy as np
import pyarrow as pa

from memlake.llm.text import spread, word_codes


def test_words_of_slices_nulls_and_all_white_space():
    rng = random.Random(1)
    alphabet = ["É", "a", "Z", " ", "\t", "\n", "\x0b", "\x0c", "\r", " ", " ", "日", "\x1c", "."]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(300)] + [None, "", "x" * 100_000]
    for kind in (pa.string(), pa.large_string()):
        col = pa.array(texts, kind)
        for start in (0, 7, 150):
            for lower in (False, True):
                offsets, codes, words = word_codes(col.slice(start), lower)
                got = [[words[c] for c in codes[a:b]] for a, b in zip(offsets, offsets[1:])]
                want = [[w.decode() for w in ((t or "").encode().lower() if lower else (t or "").encode()).split()] for t in texts[start:]]
                assert got == want
    offsets, codes, words = word_codes(pa.array([], pa.string()))
    assert list(offsets) == [0] and len(codes) == 0


def test_spread():
    assert spread(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    assert len(spread(np.array([], np.int64), np.array([], np.int64))) == 0
