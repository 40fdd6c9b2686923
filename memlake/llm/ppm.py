"""LM scoring by prediction by partial matching over bytes.

A text is its words (A-Z lower-cased), each followed by a space, and an end
mark. The trie of contexts of up to ORDER bytes is pretrained on the training
documents: a byte is coded in the longest context seen there, an escape
(method D: half a count for each distinct byte) leads to the next shorter one,
and bytes of the longer context are excluded from it.

The trie is never gathered in one place. Tasks count the (context, byte) grams
of parts of bounded size and send them to shards by a hash of the last three
bytes of the context, where all contexts from three bytes up are complete; those
of two bytes and fewer are one table of at most 2^24 numbers. A shard merges
what all parts sent, codes each distinct gram once and answers every part.

Parts do not write to all shards at once: routing goes in levels of at most FAN
branches. A node of a level merges the grams of up to about FAN nodes before it
and splits them among as many shards, so that a part's data stays as many rows
whatever the input, and the answers go back the same way.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.common import cut, table
from memlake.llm.text import spread, word_codes

ORDER = 5
PART_BYTES, PART_DOCS, SHARD_BYTES, FAN = 6 << 20, 50_000, 4 << 20, 256
#: Bytes whose grams are made at once.
BLOCK = 1 << 19
ROWS = "kind string, part long, shard int, grp long, a binary, b binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, raw double, score double"


def squeeze(x: np.ndarray) -> bytes:
    """An array's bytes by significance, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(data: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(width, -1).T).view(kind).ravel()


def squeeze_sorted(x: np.ndarray) -> bytes:
    return squeeze(np.diff(x, prepend=np.uint64(0)))


def unsqueeze_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data, np.uint64), dtype=np.uint64)


def place(kind: str, keys: np.ndarray) -> np.ndarray:
    """32 bits that say where a key goes: a word by its hash, a gram by a hash of the last three bytes of its context."""
    if kind == "w":
        return keys >> np.uint64(32)
    ctx = (keys >> np.uint64(8)) & np.uint64(0xFFFFFF)
    with np.errstate(over="ignore"):
        h = (ctx + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return h >> np.uint64(32)


def shard_of(kind: str, keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards of f * n are within those of n."""
    return ((place(kind, keys) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def levels(parts: int, shards: int) -> tuple[int, int, int]:
    """(levels, parts joined at a node, shards split at a node)."""
    depth = 1
    while FAN**depth < max(parts, shards):
        depth += 1
    root = lambda n: next(r for r in range(1, n + 1) if r**depth >= n)
    return depth, root(max(parts, 1)), root(max(shards, 1))


class Part:
    """Documents as word codes, and the grams of their bytes."""

    def __init__(self, doc_ids: list, held: np.ndarray, offsets: np.ndarray, codes: np.ndarray, words: list[str]) -> None:
        self.doc_ids, self.held, self.offsets, self.codes, self.words = doc_ids, held, offsets, codes, words

    def dump(self) -> bytes:
        ids = pickle.dumps((self.doc_ids, self.held, np.diff(self.offsets), self.words), 5)
        return pickle.dumps((zstandard.ZstdCompressor(1).compress(ids), squeeze(self.codes.astype(np.uint32))), 5)

    @staticmethod
    def load(data: bytes) -> Part:
        ids, codes = pickle.loads(data)
        doc_ids, held, sizes, words = pickle.loads(zstandard.ZstdDecompressor().decompress(ids))
        return Part(doc_ids, held, np.concatenate(([0], np.cumsum(sizes))), unsqueeze(codes, np.uint32).astype(np.int64), words)

    @staticmethod
    def read(doc_ids: list, held: np.ndarray, texts: pa.Array) -> tuple[Part, np.ndarray]:
        """With the words' hashes, by which they are sorted."""
        offsets, codes, words = word_codes(texts, lower=True)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        order = np.argsort(hashes)
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        return Part(doc_ids, held, offsets, rank[codes], [words[i] for i in order]), hashes[order]

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct grams, where each begins in the list of all, and the documents of that list."""
        n, w = len(self.doc_ids), len(self.words)
        pieces = [x.encode("utf-8") + b" " for x in self.words] + [b"\n" * ORDER, b"\n"]  # before the text, and its end
        size = np.fromiter(map(len, pieces), np.int64, w + 2)
        flat, place = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size
        inner = np.concatenate(([0], np.cumsum(size[self.codes])))[self.offsets]
        keys = np.empty(int(inner[-1]) + n, np.uint64)  # a text's bytes and its end
        doc = 0
        while doc < n:  # so many documents at a time as hold about BLOCK bytes
            last = max(doc + 1, int(np.searchsorted(inner, inner[doc] + BLOCK, "right")) - 1)
            codes = self.codes[self.offsets[doc] : self.offsets[last]]
            per_doc = np.diff(self.offsets[doc : last + 1]) + 2
            first = np.cumsum(per_doc) - per_doc
            token = np.empty(int(per_doc.sum()), np.int64)
            middle = np.ones(len(token), bool)
            middle[first] = middle[first + per_doc - 1] = False
            token[middle] = codes
            token[first], token[first + per_doc - 1] = w, w + 1
            sizes = size[token]
            stream = flat[spread(place[token], sizes)]
            doc_bytes = np.add.reduceat(sizes, first)
            g = stream.astype(np.uint64)
            for k in range(1, ORDER + 1):
                g[k:] |= stream[:-k].astype(np.uint64) << np.uint64(8 * k)
            g <<= np.uint64(16)
            g |= np.repeat(np.arange(doc, last, dtype=np.uint64), doc_bytes)
            keep = np.ones(len(g), bool)
            start = np.cumsum(doc_bytes) - doc_bytes
            for k in range(ORDER):
                keep[start + k] = False
            keys[int(inner[doc]) + doc : int(inner[last]) + last] = g[keep]
            doc = last
        keys.sort()
        of = keys.astype(np.uint16)
        keys >>= np.uint64(16)
        begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        return keys[begin], begin, of


class Short:
    """Contexts of two bytes and fewer, from the counts of all (two bytes, next byte) grams (sorted)."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray) -> None:
        self.grams, self.counts = grams.astype(np.uint64), counts.astype(float)
        self.ctx, self.of = np.unique(self.grams >> np.uint64(8), return_inverse=True)
        self.total, self.kinds = np.bincount(self.of, self.counts, len(self.ctx)), np.bincount(self.of, minlength=len(self.ctx)).astype(float)
        last = (self.grams & np.uint64(0xFFFF)).astype(np.int64)
        self.pairs = np.bincount(last, self.counts, 65_536)
        self.lower = np.bincount(self.of, self.pairs[last], len(self.ctx))  # counts one byte shorter of the bytes seen here
        own = self.pairs.reshape(256, 256)
        self.total1, self.kinds1, self.bytes = own.sum(axis=1), (own > 0).sum(axis=1), own.sum(axis=0)
        self.lower1 = ((own > 0) * self.bytes[None, :]).sum(axis=1)


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return i, keys[i] == wanted


def code_lengths(grams: np.ndarray, counts: np.ndarray, short: Short, q: np.ndarray) -> np.ndarray:
    """log10 of the probability of each gram of q (contexts of ORDER bytes), given the counts of a
    shard's training grams and the contexts of two bytes and fewer."""
    u8 = np.uint64(8)
    lp, done = np.zeros(len(q)), np.zeros(len(q), bool)
    zero = np.zeros(len(q))

    def step(hit, c, total, kinds):
        """Codes the hits and escapes with the rest; a context unseen or without bytes left is passed over."""
        nonlocal lp, done
        go = ~done & (total > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            lp = np.where(go & hit, lp + np.log10((c - 0.5) / total), np.where(go, lp + np.log10(kinds / 2 / total), lp))
        done |= go & hit

    def value(x, i, known):
        return np.where(known, x[i], 0) if len(x) else zero

    gram, count, longer = grams, counts.astype(float), None  # longer: (contexts one byte longer, of each gram, their kinds, their grams)
    out_n, out_kinds = zero, zero
    for j in range(ORDER, 2, -1):
        mask = np.uint64((1 << (8 * (j + 1))) - 1)
        if longer is not None:
            gram, inv = np.unique(gram & mask, return_inverse=True)
            count = np.bincount(inv, count, len(gram))
            i, known = find(longer[0], (q & np.uint64((1 << (8 * (j + 2))) - 1)) >> u8)
            out_n = value(np.bincount(longer[1], count[inv], len(longer[0])), i, known)
            out_kinds = value(longer[2], i, known)
        ctx, of = np.unique(gram >> u8, return_inverse=True)
        total, kinds = np.bincount(of, count, len(ctx)), np.bincount(of, minlength=len(ctx)).astype(float)
        qg = q & mask
        i, seen = find(ctx, qg >> u8)
        k, hit = find(gram, qg)
        step(hit, value(count, k, hit), value(total, i, seen) - out_n, value(kinds, i, seen) - out_kinds)
        longer = (ctx, of, kinds)
    # Two bytes: what three bytes have seen is left out; then one, and none.
    i, known = find(longer[0], (q & np.uint64(0xFFFFFFFF)) >> u8)
    k, _ = find(short.grams, gram & np.uint64(0xFFFFFF))
    out_n, out_kinds = value(np.bincount(longer[1], short.counts[k] if len(k) else None, len(longer[0])), i, known), value(longer[2], i, known)
    i, seen = find(short.ctx, (q & np.uint64(0xFFFFFF)) >> u8)
    k, hit = find(short.grams, q & np.uint64(0xFFFFFF))
    step(hit, value(short.counts, k, hit), value(short.total, i, seen) - out_n, value(short.kinds, i, seen) - out_kinds)
    pair = (q & np.uint64(0xFFFF)).astype(np.int64)
    ctx, sym = pair >> 8, pair & 255
    step(short.pairs[pair] > 0, short.pairs[pair], short.total1[ctx] - value(short.lower, i, seen), short.kinds1[ctx] - value(short.kinds, i, seen))
    step(short.bytes[sym] > 0, short.bytes[sym], short.bytes.sum() - short.lower1[ctx], (short.bytes > 0).sum() - short.kinds1[ctx])
    return np.where(done, lp, lp - np.log10(max(256 - int((short.bytes > 0).sum()), 1)))


def _row(kind: str, part: int, shard: int, a: bytes, b: bytes, grp: int = 0) -> tuple:
    return kind, part, shard, grp, a, b


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["kind", "part", "shard", "grp", "a", "b"])


def _split(kind: str, part: int, keys: np.ndarray, n: np.ndarray, shards: int) -> list[tuple]:
    """Rows of the sorted keys and their counts for each shard."""
    shard = shard_of(kind, keys, shards)
    order = np.argsort(shard, kind="stable")
    names, first = np.unique(shard[order], return_index=True)
    ends = [*first[1:], len(order)]
    return [_row(kind, part, int(s), squeeze_sorted(keys[order[a:b]]), squeeze(n[order[a:b]])) for s, a, b in zip(names, first, ends, strict=True)]


def _count(branches: int):
    """Parts (kind d); for each first shard their grams (g) and words (w) with training counts; and those of two bytes of context (p)."""

    def rows(part: int, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).combine_chunks()
        held = t.column("held_out").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        p, hashes = Part.read(t.column("doc_id").to_pylist(), held, t.column("text").combine_chunks() if t.num_rows else pa.array([], pa.string()))
        yield _batch([_row("d", part, 0, p.dump(), b"")])
        learn = ~held
        n = np.bincount(p.codes[np.repeat(learn, np.diff(p.offsets))], minlength=len(p.words)).astype(np.uint64)
        yield _batch(_split("w", part, hashes, n, branches))
        grams, begin, doc = p.grams()
        n = np.add.reduceat(learn[doc], begin).astype(np.uint64) if len(begin) else np.zeros(0, np.uint64)
        yield _batch(_split("g", part, grams, n, branches))
        low = ((grams[n > 0] & np.uint64(0xFFFFFF)) << np.uint64(40)) | n[n > 0]  # a part's counts are far below 2^40
        low.sort()
        at = np.flatnonzero(np.concatenate(([True], low[1:] >> np.uint64(40) != low[:-1] >> np.uint64(40)))) if len(low) else np.zeros(0, np.int64)
        if len(at):
            sums = np.add.reduceat(low & np.uint64((1 << 40) - 1), at)
            yield _batch([_row("p", part, 0, squeeze_sorted(low[at] >> np.uint64(40)), squeeze(sums))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, kept, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            for s in range(0, len(b), 500):
                piece = b.slice(s, 500)
                kept.append(piece)
                size += sum(len(x) for x in piece.column("text").to_pylist() if x is not None) if len(piece) else 0
                if size >= PART_BYTES or sum(map(len, kept)) >= PART_DOCS:
                    yield from rows((task << 24) + seq, kept)
                    seq, kept, size = seq + 1, [], 0
        if kept:
            yield from rows((task << 24) + seq, kept)

    return run


def _merged(t: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys of the rows, their summed counts, and where each row's keys are among them."""
    keys = [unsqueeze_sorted(x) for x in t.column("a").to_pylist()]
    n = [unsqueeze(x, np.uint64) for x in t.column("b").to_pylist()]
    ends = np.cumsum([len(k) for k in keys])[:-1]
    keys, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate(n), len(keys)).astype(np.uint64), np.split(inverse, ends)


def _forward(kind: str, shards: int):
    """A node's merged keys, split among the shards of the next level; the node goes by its group."""

    def run(t: pa.Table) -> pa.Table:
        keys, n, _ = _merged(t)
        return pa.Table.from_batches([_batch(_split(kind, t.column("grp")[0].as_py(), keys, n, shards))])

    return run


def _backward(kind: str, shards: int, dtype: type):
    """A node's answers to the rows that it merged, from the answers of the shards that it split them among."""

    def run(asked: pa.Table, told: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.Table.from_batches([_batch([])])
        keys, _, where = _merged(asked)
        values = np.empty(len(keys), dtype)
        got = dict(zip(told.column("shard").to_pylist(), told.column("a").to_pylist(), strict=True))
        values[np.argsort(shard_of(kind, keys, shards), kind="stable")] = np.concatenate([unsqueeze(got[s], dtype) for s in sorted(got)])
        return _told(asked, values, where)

    return run


def _told(asked: pa.Table, values: np.ndarray, where: list[np.ndarray]) -> pa.Table:
    rows = [_row("r", part, shard, squeeze(values[i]), b"") for part, shard, i in zip(asked.column("part").to_pylist(), asked.column("shard").to_pylist(), where, strict=True)]
    return pa.Table.from_batches([_batch(rows)])


_kept: list = [None, None]  # the contexts that this worker last worked with, and their trie


def _short(shared) -> Short:
    """The trie of the shared contexts, made once a worker and not for each shard."""
    if _kept[0] is not shared.value:
        _kept[:] = [shared.value, Short(*shared.value)]
    return _kept[1]


def _code(shared):
    """A shard's code lengths for the grams of each row."""

    def run(t: pa.Table) -> pa.Table:
        keys, n, where = _merged(t)
        lp = code_lengths(keys[n > 0], n[n > 0], _short(shared), keys)
        return _told(t, lp.astype(np.float32), where)

    return run


def _known(t: pa.Table) -> pa.Table:
    """The counts of the words of each row, and the shard's sums (kind t): tokens, distinct words."""
    keys, n, where = _merged(t)
    total = pa.Table.from_batches([_batch([_row("t", int(n.sum()), 0, b"", b"", int((n > 0).sum()))])])
    return pa.concat_tables([_told(t, n, where), total])


def answered(rows: DataFrame, kind: str, answer, dtype: type, depth: int, joined: int, branches: int) -> DataFrame:
    """Rows of kind r (and others that answer makes) for every row of rows, which parts wrote for the first shards.

    answer maps all rows of a last shard. Every level has about as many rows as the first.
    """
    far = joined ** (depth - 1)
    levels = [rows.withColumn("grp", F.shiftright(F.pmod(F.xxhash64("part"), F.lit(1 << 32)) * far, 32))]
    for level in range(1, depth):
        down = levels[-1].groupBy("grp", "shard").applyInArrow(_forward(kind, branches ** (level + 1)), ROWS)
        levels.append(cut(down).withColumn("grp", F.floor(F.col("part") / joined)))
    told = levels[-1].groupBy("shard").applyInArrow(answer, ROWS)
    other = None
    for level in range(depth - 1, 0, -1):
        told = cut(told)
        if other is None:
            other = told.filter("kind <> 'r'")
        back = told.filter("kind = 'r'").withColumn("grp", F.col("part")).withColumn("at", F.floor(F.col("shard") / branches).cast("int"))
        told = levels[level - 1].groupBy("grp", "shard").cogroup(back.groupBy("grp", "at")).applyInArrow(_backward(kind, branches ** (level + 1), dtype), ROWS)
    return told if other is None else told.unionByName(other)


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for keys, n in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(unsqueeze_sorted(keys).astype(np.int32)), pa.array(unsqueeze(n, np.uint64).astype(np.int64))], names=["gram", "n"])


def _joined(kind: str, keys: np.ndarray, got: dict[int, bytes], dtype: type, shards: int) -> np.ndarray:
    """A part's answers, shard by shard, in the order of its keys."""
    out = np.zeros(len(keys))
    if got:
        out[np.argsort(shard_of(kind, keys, shards), kind="stable")] = np.concatenate([unsqueeze(got[s], dtype) for s in sorted(got)])
    return out


def _score(branches: int, ends: int):
    def run(t: pa.Table) -> pa.Table:
        by = {k: {} for k in "dcr"}
        for kind, shard, a in zip(t.column("kind").to_pylist(), t.column("shard").to_pylist(), t.column("a").to_pylist(), strict=True):
            by[kind][shard] = a
        p = Part.load(by["d"][0])
        n, w = len(p.doc_ids), len(p.words)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, p.words), np.uint64, w)
        c = _joined("w", hashes, by["c"], np.uint64, branches)
        doc = np.repeat(np.arange(n), np.diff(p.offsets))
        raw = np.bincount(doc, np.log10(c + 0.5)[p.codes], n) + np.log10(ends + 0.5)
        known = np.bincount(doc, (c > 0)[p.codes], n).astype(np.int64) + (ends > 0)
        grams, begin, of = p.grams()
        lp = _joined("g", grams, by["r"], np.float32, branches)
        runs, score = np.diff(np.append(begin, len(of))), np.zeros(n)
        for a in range(0, len(begin), BLOCK):
            z = begin[a + BLOCK] if a + BLOCK < len(begin) else len(of)
            score += np.bincount(of[begin[a] : z], np.repeat(lp[a : a + BLOCK], runs[a : a + BLOCK]), n)
        return pa.table({"doc_id": pa.array(p.doc_ids, pa.int64()), "held_out": pa.array(p.held), "n_tokens": np.diff(p.offsets) + 1, "n_known": known, "raw": raw, "score": score})

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs
    (doc_id, text, held_out): base_score by training word counts, score by the byte model.

    A null or empty text is its end mark alone. Repeated rows count, and are
    scored, each. Without training documents every byte is equally likely. An
    empty table gives no rows. A byte's code length is kept to 24 bits on its way
    back to the part, the sums are doubles.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.sum((~F.col("held_out")).cast("long")), F.count("*")).first()
    ends = size[1] or 0
    depth, joined, branches = levels(-(-size[0] // PART_BYTES) + size[2] // PART_DOCS, -(-size[0] // SHARD_BYTES))
    rows = cut(docs.mapInArrow(_count(branches), ROWS))

    words = cut(answered(rows.filter("kind = 'w'"), "w", _known, np.uint64, depth, joined, branches))
    total = words.filter("kind = 't'").agg(F.coalesce(F.sum("part"), F.lit(0)), F.coalesce(F.sum("grp"), F.lit(0))).first()
    train, distinct = total[0] + ends, total[1] + (ends > 0)

    low = rows.filter("kind = 'p'").mapInArrow(_triples, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).orderBy("gram").toArrow()  # 2^24 rows at most
    shared = docs.sparkSession.sparkContext.broadcast((low.column("gram").to_numpy(), low.column("n").to_numpy()))
    answers = answered(rows.filter("kind = 'g'"), "g", _code(shared), np.float32, depth, joined, branches)
    every = rows.filter("kind = 'd'").unionByName(words.filter("kind = 'r'").withColumn("kind", F.lit("c"))).unionByName(answers)
    scored = every.groupBy("part").applyInArrow(_score(branches, ends), SCORES)
    base = F.col("raw") - F.col("n_tokens") * F.lit(float(np.log10(train + 0.5 * (distinct + 1))))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op8_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learning from those whose crc32 of the id as text leaves no 1 by 5 (a null id: of the empty text)."""
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    return score(docs.select("doc_id", "text", held.alias("held_out")))
