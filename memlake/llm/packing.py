"""Hierarchical multi-length packing into windows of several context sizes.

Documents are tokenised once. Whole windows of the longest size come off long
documents; what is left is routed to the smallest tier that holds it. Each
group of documents packs its tiers from the longest down: a window opens with
a document of its tier, its gap is filled from shorter tiers by best fit and
closed with a piece cut to measure. What remains in the end is cut into
windows of powers of two. Steps take windows of all sizes in equal measure.
"""

from __future__ import annotations

import bisect
import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import table
from memlake.llm.text import coded_words, slices, spread, tidy

WINDOW, TIERS, END = 4096, (512, 1024, 2048, 4096), 2
VOCABULARY = "word_bpe_49k.json"
GROUP_DOCS, STEP_WINDOWS = 1024, 16
#: Words a worker remembers between batches; beyond, it keeps those of the last batch.
CACHE_WORDS = 100_000
#: Texts encoded at once, so that a word that several of them hold is looked up once.
BATCH_BYTES, BATCH_DOCS = 3 << 20, 2000
#: Texts whose ids are gathered at once.
GATHER_DOCS = 100
TOKENS = "doc_id long, doc_tokens long, whole array<long>, rest binary, base long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, grp long, seq long, offset long, tier int, step long"

_tokenizers: dict[str, tuple] = {}
_words: dict[str, dict[str, bytes]] = {}

#: Letters whose lower case and normal form do not depend on their neighbours: Latin without the dotted capital I.
LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
#: Marks that the tokenizer splits from a word of letters, as one piece each run (no apostrophe: it may contract).
MARKS = ".,!?:;|%$*&#"


def tokenizer(vocabulary: str):
    """The tokenizer of a vocabulary file, and the same one for lower-case letters parted by blanks, without the steps that change nothing there."""
    if vocabulary not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        full, plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        plain.normalizer = normalizers.Sequence([])
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        names = full.get_vocab()
        ends = np.zeros(max(names.values()) + 1, bool)
        ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        _tokenizers[vocabulary] = full, plain, ends
    return _tokenizers[vocabulary]


def encode_words(words: list[str], vocabulary: str) -> list[bytes]:
    """Ids of each word (32 bits each). Words of lower-case letters are encoded many in one text and told apart by word ends."""
    full, plain, ends = tokenizer(vocabulary)
    out: dict[str, bytes] = {}
    letters = [w for w in words if _PLAIN.fullmatch(w)]
    for i in range(0, len(letters), 200):
        part = letters[i : i + 200]
        ids = np.array(plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
        stop = np.flatnonzero(ends[ids]) + 1
        if len(stop) == len(part):
            data, stop = ids.astype("<u4").tobytes(), (stop * 4).tolist()
            out.update((w, data[a:b]) for w, a, b in zip(part, [0, *stop], stop, strict=False))
    rest = [w for w in words if w not in out]
    for i in range(0, len(rest), 1000):  # an encoding holds far more than its ids
        part = rest[i : i + 1000]
        out.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(part, full.encode_batch_fast(part, add_special_tokens=False), strict=True))
    return [out[w] for w in words]


_PLAIN = re.compile(f"[{LETTER}]+")


def parts_of(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Words of letters in lower case, and the marks after them; any other word as it is."""
    words = words.cast(pa.string())
    plain = pc.match_substring_regex(words, f"^[{LETTER}]+[{re.escape(MARKS)}]*$")
    core = pc.utf8_lower(pc.utf8_rtrim(words, characters=MARKS))
    marks = pc.replace_substring_regex(words, f"^[{LETTER}]+", "")
    return pc.if_else(plain, core, words), pc.if_else(plain, marks, "")


def encode(texts: pa.Array, vocabulary: str = VOCABULARY, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets): text i has ids[offsets[i]:offsets[i + 1]], its end id among them.

    Texts are cut at ASCII white space, which the tokenizer drops and never joins
    across; each distinct word of the texts is looked up, or encoded, once.
    """
    offsets, codes, words = coded_words(texts)
    known = _words.setdefault(vocabulary, {})
    flat, begin, sizes = [], [], []
    at = 0
    for part in parts_of(words):
        part = part.dictionary_encode()
        names = part.dictionary.to_pylist()
        new = [w for w in names if w not in known]
        if len(known) + len(new) > CACHE_WORDS:
            kept = {w: known[w] for w in names if w in known}
            known.clear()
            known.update(kept)
        known.update(zip(new, encode_words(new, vocabulary), strict=True))
        data = [known[w] for w in names]
        size = np.fromiter(map(len, data), np.int64, len(data)) // 4
        which = part.indices.to_numpy(zero_copy_only=False)
        begin.append((at + np.cumsum(size) - size)[which])
        sizes.append(size[which])
        flat += data
        at += int(size.sum())
    # Each distinct word is its letters and its marks; the word after the last is the end id.
    flat = np.frombuffer(b"".join([*flat, np.array([end], "<u4").tobytes()]), "<u4")
    begin, sizes = (np.append(np.stack(x, 1).ravel(), [last, 0]) for x, last in ((begin, at), (sizes, 1)))
    flat, sizes = flat[spread(begin, sizes)], sizes[::2] + sizes[1::2]
    codes, stop = np.insert(codes, offsets[1:], len(words)), offsets + np.arange(len(offsets))
    del texts, words, offsets
    begin = np.cumsum(sizes) - sizes
    at = np.concatenate(([0], np.cumsum([sizes[codes[a:z]].sum() for a, z in itertools.pairwise(stop.tolist())], dtype=np.int64)))
    ids = np.empty(at[-1], flat.dtype)
    for i in range(0, len(stop) - 1, GATHER_DOCS):  # places take more memory than ids
        k = min(i + GATHER_DOCS, len(stop) - 1)
        own = codes[stop[i] : stop[k]]
        ids[at[i] : at[k]] = flat[spread(begin[own], sizes[own])]
    return ids, at


def tokens(docs: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW, end: int = END) -> DataFrame:
    """doc_tokens, the checksums of the whole windows, and the ids that are left (16 bits each where they fit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()  # what earlier tasks of this worker have left
        for b in batches:
            for i, n in slices(b.column("text"), BATCH_BYTES, BATCH_DOCS):
                part = b.slice(i, n)
                ids, at = encode(part.column("text"), vocabulary, end)
                size = np.diff(at)
                full = size // window
                whole = [[zlib.crc32(ids[a + window * k : a + window * (k + 1)]) for k in range(m)] for a, m in zip(at.tolist(), full.tolist(), strict=False)]
                small = ids.astype("<u2") if ids.max() < 65_536 else ids
                rest = [small[a:z].tobytes() for a, z in zip((at[:-1] + full * window).tolist(), at[1:].tolist(), strict=True)]
                cols = [part.column("doc_id"), pa.array(size), pa.array(whole, pa.list_(pa.int64())), pa.array(rest, pa.binary()), pa.array(full * window)]
                del ids, small, rest
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "doc_tokens", "whole", "rest", "base"])
                tidy()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, TOKENS)


def plan(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows (tier, [(document, start, length)]) that hold every token of documents of these lengths once.

    All windows are full but for the last ones, which are powers of two.
    """
    pool = sorted((n, i, 0) for i, n in enumerate(lengths) if n > 0)  # (tokens left, document, start)
    windows = []

    def fill(parts: list[tuple[int, int, int]], gap: int) -> int:
        while gap and pool:
            at = bisect.bisect_right(pool, (gap, 1 << 60, 0)) - 1
            if at >= 0:  # best fit
                n, i, s = pool.pop(at)
                parts.append((i, s, n))
                gap -= n
            else:  # nothing fits whole: a piece of the shortest, made to measure
                n, i, s = pool.pop(0)
                parts.append((i, s, gap))
                bisect.insort(pool, (n - gap, i, s + gap))
                gap = 0
        return gap

    for k in range(len(tiers) - 1, -1, -1):
        tier, below = tiers[k], tiers[k - 1] if k else 0
        while pool and pool[-1][0] > below:
            n, i, s = pool.pop()
            take = min(n, tier)
            parts = [(i, s, take)]
            if n > take:
                bisect.insort(pool, (n - take, i, s + take))
            if gap := fill(parts, tier - take):
                windows += close(parts, tier - gap)
            else:
                windows.append((tier, parts))
    return windows


def close(parts: list[tuple[int, int, int]], total: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Cuts the parts of a window that no document can fill into windows of powers of two."""
    out, parts = [], list(parts)
    while total:
        size = 1 << (total.bit_length() - 1)
        own, left = [], size
        while left:
            i, s, n = parts.pop(0)
            k = min(n, left)
            own.append((i, s, k))
            if n > k:
                parts.insert(0, (i, s + k, n - k))
            left -= k
        out.append((size, own))
        total -= size
    return out


def steps(sizes: list[int], per_step: int = STEP_WINDOWS) -> list[int]:
    """A step for each window: sizes in order, dealt to and fro, so that steps have like tokens."""
    n = max(1, -(-len(sizes) // per_step))
    out = [0] * len(sizes)
    for turn, w in enumerate(sorted(range(len(sizes)), key=lambda i: -sizes[i])):
        lap, at = divmod(turn, n)
        out[w] = at if lap % 2 == 0 else n - 1 - at
    return out


def _pack(window: int, tiers: tuple[int, ...]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "doc_tokens", "rest"]).reset_index(drop=True)
        doc, total, base = pdf["doc_id"].to_list(), pdf["doc_tokens"].to_list(), pdf["base"].to_list()
        left = [int(t - b) for t, b in zip(total, base, strict=True)]
        ids = [np.frombuffer(r, "<u2" if len(r) == 2 * n else "<u4").astype("<u4") for r, n in zip(pdf["rest"], left, strict=True)]
        made = [(window, [(i, k * window, window, crc)]) for i, w in enumerate(pdf["whole"]) for k, crc in enumerate(w)]
        for tier, parts in plan(left, tiers):
            made.append((tier, [(i, base[i] + s, n, zlib.crc32(ids[i][s : s + n].tobytes())) for i, s, n in parts]))
        step = steps([t for t, _ in made])
        rows = []
        for q, (tier, parts) in enumerate(made):
            at = 0
            for i, s, n, crc in parts:
                rows.append((doc[i], s, n, crc, total[i], pdf["grp"].iloc[0], q, at, tier, step[q]))
                at += n
        return pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "grp", "seq", "offset", "tier", "step"])

    return run


def pack(docs: DataFrame, n_docs: int, vocabulary: str = VOCABULARY, window: int = WINDOW, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Pieces of all docs (doc_id, text) in windows; n_docs decides the number of groups.

    Groups are dealt by a hash of the document, so none holds many more than
    GROUP_DOCS; sequence_id and step are unique over groups. Repeated rows are
    packed each; a null or empty text is its end id alone; no rows give none.
    """
    groups = max(1, -(-n_docs // GROUP_DOCS))
    rows = tokens(docs, vocabulary, window).withColumn("grp", F.pmod(F.xxhash64("doc_id", "doc_tokens", "rest", F.monotonically_increasing_id() * F.col("doc_id").isNull().cast("long")), F.lit(groups)))
    packed = rows.groupBy("grp").applyInPandas(_pack(window, tiers), PIECES)
    base = F.col("grp") * F.lit(1 << 31)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (base + F.col("seq")).alias("sequence_id"), "offset", "tier", (base + F.col("step")).alias("step"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces: start, length, ids_crc32, doc_tokens, sequence_id, offset, and tier and step."""
    docs = table(spark, sf_dir, "documents")
    return pack(docs.select("doc_id", "text"), docs.count())
