"""Words of many texts at once, by Arrow's kernels."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def word_codes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(offsets, codes, words): text i has the words codes[offsets[i]:offsets[i + 1]].

    Words are runs of anything but ASCII white space; lower turns A-Z to a-z.
    A null text has none.
    """
    offsets, codes, words = coded_words(texts, lower)
    return offsets, codes, words.to_pylist()


def coded_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """word_codes with the words as an Arrow array."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:  # ascii_lower misreads offsets that do not begin at 0, as those of a slice: copy it first
        texts = texts.take(pa.array(np.arange(len(texts))))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.flatten().dictionary_encode()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)
    codes, words = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary
    if (blank := pc.index(words, "").as_py()) >= 0:
        real = codes != blank
        offsets = np.concatenate(([0], np.cumsum(real)))[offsets]
        codes = codes[real]
    return offsets, codes, words


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of runs of the given sizes, one after another."""
    ends = np.cumsum(sizes)
    out = np.repeat(starts - (ends - sizes), sizes)
    out += np.arange(len(out))
    return out


def slices(texts: pa.Array, most_bytes: int, most: int) -> Iterator[tuple[int, int]]:
    """(begin, length) of runs of at most so many texts, and of so many bytes unless one text alone has more."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(size):
        before = int(size[at - 1]) if at else 0
        end = min(max(at + 1, int(np.searchsorted(size, before + most_bytes, "right"))), at + most)
        yield at, end - at
        at = end


def tidy() -> None:
    """Gives freed memory back to the system: a worker lives on after its task, beside others."""
    gc.collect(0)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)
