"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_WORDS words. Each passage is encoded
from what its bytes and words are like: shares of characters, pairs of kinds of
characters, repetition within the passage and of what the document said before,
and hashed words. A dense layer makes it a hidden vector; a gated attention
(a tanh branch times a sigmoid one) weighs the passages of a document against
each other; the weighted mean of their vectors gives the document's log-odds.
Only documents have labels: the weights of the passages are learnt from these.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.llm.common import seeded_unit, table
from memlake.llm.text import slices, tidy

PASSAGE_WORDS, HIDDEN, GATE, WORD_BUCKETS = 64, 24, 12, 64
#: The model is fitted on at most about so many labelled rows a class, drawn by a seeded hash of the id among those with
#: texts of at most so many bytes. Scoring reads every text whole.
SAMPLE_ROWS, SAMPLE_TEXT, SEED = 2500, 50_000, 13
EPOCHS, BATCH, RATE, DECAY = 40, 128, 0.004, 0.01
THRESHOLD = 0.7
#: Texts encoded at once: so many, and so many bytes unless one alone has more.
SLICE_ROWS, SLICE_BYTES = 400, 1 << 20

# Kinds of bytes: lower case, upper case, digits, line ends, other blanks, bytes of other characters, and each remaining
# ASCII character for itself; coarse kinds join the latter to what ends or parts a clause and to symbols.
_KIND, _COARSE = np.full(256, 5, np.int64), np.full(256, 5, np.int64)
for _lo, _hi, _k in ((97, 122, 0), (65, 90, 1), (48, 57, 2), (10, 10, 3)):
    _KIND[_lo : _hi + 1] = _COARSE[_lo : _hi + 1] = _k
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_KIND[[9, 11, 12, 13, 32]] = _COARSE[[9, 11, 12, 13, 32]] = 4
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
_KIND[_MARKS] = 6 + np.arange(len(_MARKS))
_COARSE[_MARKS] = [6 if chr(c) in ".,;:?!'\"()-" else 7 for c in _MARKS]
_KINDS, _COARSES = 6 + len(_MARKS), 8
FEATURES = _KINDS + _COARSES**2 + 9 + WORD_BUCKETS
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _seen(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the same key stands earlier in the same document."""
    with np.errstate(over="ignore"):
        mixed = (key ^ (key >> np.uint64(31))) * _MIX + doc.astype(np.uint64) * _STEP
    order = np.argsort(mixed, kind="stable")
    out = np.zeros(len(key), bool)
    out[order[1:]] = mixed[order[1:]] == mixed[order[:-1]]
    return out


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes: differences of one running sum, shifted back to the word's own powers."""
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(data) + 1, _STEP, np.uint64))
        back = np.cumprod(np.full(len(data) + 1, np.uint64(pow(int(_STEP), -1, 1 << 64)), np.uint64))
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1])))
        h = (run[end] - run[start]) * back[start]
        return (h ^ (h >> np.uint64(29))) * _MIX


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, bags, starts, sizes): bag i has the passages bags[i] to bags[i + 1], each with its first byte and bytes.

    A text without words, or null, has one passage of no bytes.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = texts.take(pa.array(np.arange(len(texts))))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[: offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8)
    word = ~_BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a word doesn't go on into the next text
    start = np.flatnonzero(word & (first[:-1] | ~np.concatenate(([False], word[:-1]))))
    end = np.flatnonzero(word & (first[1:] | ~np.concatenate((word[1:], [False])))) + 1
    begin = np.searchsorted(start, offsets)
    n_words = np.diff(begin)
    n_parts = np.maximum(-(-n_words // PASSAGE_WORDS), 1)
    bags = np.concatenate(([0], np.cumsum(n_parts)))
    total = int(bags[-1])
    doc = np.repeat(np.arange(len(texts)), n_words)
    part = bags[doc] + (np.arange(len(start)) - begin[doc]) // PASSAGE_WORDS
    # A passage's bytes go from its first word (or its text's beginning) to the next passage or the end of the text.
    doc_of = np.repeat(np.arange(len(texts)), n_parts)
    opens = np.flatnonzero(np.diff(part, prepend=-1))
    low = offsets[doc_of].copy()
    low[part[opens]] = start[opens]
    low[bags[:-1]] = offsets[:-1]
    high = np.append(low[1:], offsets[-1])
    size = high - low
    where = np.repeat(np.arange(total), size)
    out = np.zeros((total, FEATURES), np.float32)
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(np.bincount(part, minlength=total), 1)

    def shares(at: np.ndarray, kind: np.ndarray, kinds: int, scale: np.ndarray) -> np.ndarray:
        return np.bincount(at * kinds + kind, minlength=total * kinds).reshape(total, kinds) * scale[:, None]

    place = 0

    def put(block: np.ndarray) -> None:
        nonlocal place
        block = block.reshape(total, -1)
        out[:, place : place + block.shape[1]] = block
        place += block.shape[1]

    put(np.sqrt(shares(where, _KIND[data], _KINDS, per_byte)))
    coarse = _COARSE[data]
    pairs = np.flatnonzero(where[1:] == where[:-1])
    put(np.sqrt(shares(where[pairs], coarse[pairs] * _COARSES + coarse[pairs + 1], _COARSES**2, per_byte)))
    h, length = _word_hashes(data, start, end), end - start
    same = np.zeros((2, len(start)), bool)  # as the word before, and as the one before that
    for k in (1, 2):
        same[k - 1, k:] = (h[k:] == h[:-k]) & (doc[k:] == doc[:-k])
    four = np.flatnonzero(doc[3:] == doc[:-3]) if len(doc) > 3 else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        runs = ((h[four] * _STEP + h[four + 1]) * _STEP + h[four + 2]) * _STEP + h[four + 3]
    again = np.zeros(len(start), bool)
    again[four + 3] = _seen(doc[four], runs)
    told, within = _seen(doc, h), _seen(part, h)
    tail = _COARSE[data[end - 1]] if len(end) else np.zeros(0, np.int64)
    for flag in (same[0], same[1], again, told, within, tail == 7, _KIND[data[start]] == 1):
        put(np.bincount(part, flag, total) * per_word)
    put(np.bincount(part, np.minimum(length, 40), total) * per_word / 10)
    put(np.log1p(np.bincount(part, minlength=total)) / 4)
    put(np.sqrt(shares(part, (h % np.uint64(WORD_BUCKETS)).astype(np.int64), WORD_BUCKETS, per_word)))
    return out, bags, low - offsets[doc_of], size


@dataclass
class Attention:
    """The weights by name; shift and scale bring features to mean 0 and deviation 1. Without weights the score is the prior."""

    weights: dict[str, np.ndarray] | None
    shift: np.ndarray
    scale: np.ndarray
    prior: float

    def ready(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features.astype(np.float64) - self.shift) * self.scale, -8, 8)

    def score(self, features: np.ndarray, bags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The probability of each bag, and the share of each passage in it."""
        if self.weights is None:
            return np.full(len(bags) - 1, self.prior), np.repeat(1 / np.diff(bags), np.diff(bags))
        state = forward(self.weights, self.ready(features), bags)
        return state["p"], state["a"]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def forward(w: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray) -> dict[str, np.ndarray]:
    own, first = np.repeat(np.arange(len(bags) - 1), np.diff(bags)), bags[:-1]
    h = np.tanh(x @ w["dense"] + w["dense_bias"])
    tanh, gate = np.tanh(h @ w["tanh"]), sigmoid(h @ w["gate"])
    s = (tanh * gate) @ w["attend"]
    e = np.exp(s - np.maximum.reduceat(s, first)[own])
    a = e / np.add.reduceat(e, first)[own]
    z = np.add.reduceat(a[:, None] * h, first)
    return {"own": own, "h": h, "tanh": tanh, "gate": gate, "a": a, "z": z, "p": sigmoid(z @ w["out"] + w["out_bias"][0])}


def gradient(w: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Weighted mean log loss of the bags, and its derivative by each weight."""
    f = forward(w, x, bags)
    own, h, a, first, mass = f["own"], f["h"], f["a"], bags[:-1], weight.sum()
    p = np.clip(f["p"], 1e-12, 1 - 1e-12)
    loss = -float((weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mass)
    d_out = weight * (f["p"] - y) / mass
    d_z = (d_out[:, None] * w["out"])[own]
    d_a = (h * d_z).sum(axis=1)
    d_s = a * (d_a - np.add.reduceat(a * d_a, first)[own])
    d_both = d_s[:, None] * w["attend"]
    d_tanh, d_gate = d_both * f["gate"] * (1 - f["tanh"] ** 2), d_both * f["tanh"] * f["gate"] * (1 - f["gate"])
    d_h = (a[:, None] * d_z + d_tanh @ w["tanh"].T + d_gate @ w["gate"].T) * (1 - h**2)
    return loss, {
        "dense": x.T @ d_h, "dense_bias": d_h.sum(axis=0), "tanh": h.T @ d_tanh, "gate": h.T @ d_gate,
        "attend": (f["tanh"] * f["gate"]).T @ d_s, "out": f["z"].T @ d_out, "out_bias": np.array([d_out.sum()]),
    }


def train(features: list[np.ndarray], y: np.ndarray, weight: np.ndarray, seed: int = SEED) -> Attention:
    """Adam over seeded batches of bags; with one class only the score is the smoothed share of the labels."""
    prior = float((weight @ y + 1) / (weight.sum() + 2)) if len(y) else 0.5
    if not len(y) or not 0 < y.sum() < len(y):
        return Attention(None, np.zeros(FEATURES), np.ones(FEATURES), prior)
    every = np.concatenate(features)
    shift, deviation = every.mean(axis=0, dtype=np.float64), every.std(axis=0, dtype=np.float64)
    model = Attention({}, shift, 1 / np.maximum(deviation, 0.02), prior)
    bags = [model.ready(f) for f in features]
    rng = np.random.default_rng(seed)
    normal = lambda a, b: rng.normal(0, a**-0.5, (a, b))
    w = {"dense": normal(FEATURES, HIDDEN), "dense_bias": np.zeros(HIDDEN), "tanh": normal(HIDDEN, GATE), "gate": normal(HIDDEN, GATE), "attend": normal(GATE, 1)[:, 0], "out": normal(HIDDEN, 1)[:, 0], "out_bias": np.array([np.log(prior / (1 - prior))])}
    mean, square, turn = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            sizes = np.array([len(bags[r]) for r in rows])
            _, d = gradient(w, np.concatenate([bags[r] for r in rows]), np.concatenate(([0], np.cumsum(sizes))), y[rows], weight[rows])
            turn += 1
            for k in w:
                mean[k] = 0.9 * mean[k] + 0.1 * d[k]
                square[k] = 0.999 * square[k] + 0.001 * d[k] ** 2
                w[k] = w[k] * (1 - rate * DECAY * (w[k].ndim > 1)) - rate * (mean[k] / (1 - 0.9**turn)) / (np.sqrt(square[k] / (1 - 0.999**turn)) + 1e-8)
    model.weights = w
    return model


def _train(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("doc_id")
    features = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in pdf["bag"]]
    model = train(features, pdf["quality"].to_numpy(float), pdf["weight"].to_numpy(float))
    tidy()
    return pd.DataFrame({"model": [pickle.dumps(model, 5)]})


def held_out(doc_id: F.Column) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def bags_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with bag in place of text: the features of its passages as bytes, encoded where the rows are."""
    fields = [c for c in docs.columns if c not in (text, "bag")]
    schema = T.StructType([*(docs.schema[c] for c in fields), T.StructField("bag", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n in slices(b.column(len(fields)), SLICE_BYTES, SLICE_ROWS):
                part = b.slice(at, n)
                got, bags, _, _ = encode(part.column(len(fields)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([got[i:j].tobytes() for i, j in zip(bags[:-1], bags[1:], strict=True)], pa.binary())], names=[*fields, "bag"])
            tidy()

    return docs.select(*fields, text).mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = SEED) -> bytes:
    """The model, from labelled rows outside the held-out remainder.

    Labels other than 0 and 1, and null ids, teach nothing. Of repeated labels of an id the smaller counts; of texts
    that repeat an id, the one of the least hash. Passages are encoded where the texts are; one task, with about
    2 * sample_rows bags of bounded texts, fits the weights.
    """
    use = labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out(F.col("doc_id")))
    use = use.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = {r["quality"]: r["n"] for r in use.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    rate = {c: min(1.0, sample_rows / max(n.get(c, 0), 1)) for c in (0, 1)}
    of = lambda f: F.when(F.col("quality") == 1, F.lit(f(rate[1]))).otherwise(F.lit(f(rate[0])))
    drawn = use.filter(seeded_unit(seed, F.col("doc_id")) / F.lit(float(2**53)) < of(float)).withColumn("weight", of(lambda r: 1 / r))
    rows = docs.select("doc_id", "text").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_TEXT).join(F.broadcast(drawn), "doc_id")
    rows = bags_of(rows.withColumn("digest", F.xxhash64("text")).select("doc_id", "quality", "weight", "digest", "text"))
    rows = rows.groupBy("doc_id").agg(F.min_by(F.struct("quality", "weight", "bag"), "digest").alias("one")).select("doc_id", "one.*")
    got = rows.groupBy().applyInPandas(_train, "model binary").first()
    return bytes(got[0]) if got else pickle.dumps(train([], np.zeros(0), np.zeros(0)), 5)


def score(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """Adds score (double), n_passages (int) and the span in bytes of the passage that weighs most (focus_start,
    focus_bytes, long); they replace columns of these names.

    Only the text is looked at; a null text counts as empty. Batches are scored one after another, so memory doesn't
    grow with the table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [T.StructField("score", T.DoubleType()), T.StructField("n_passages", T.IntegerType()), T.StructField("focus_start", T.LongType()), T.StructField("focus_bytes", T.LongType())]
    fields = [c for c in docs.columns if c not in {a.name for a in added}]
    docs = docs.select(*fields)
    schema = T.StructType([*docs.schema.fields, *added])
    place = fields.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mil: Attention = pickle.loads(shared.value)
        for b in batches:
            for at, n in slices(b.column(place), SLICE_BYTES, SLICE_ROWS):
                part = b.slice(at, n)
                x, bags, low, size = encode(part.column(place))
                p, share = mil.score(x, bags)
                n_parts = np.diff(bags)
                best = np.maximum.reduceat(share, bags[:-1])[np.repeat(np.arange(n), n_parts)] == share
                focus = np.minimum.reduceat(np.where(best, np.arange(len(share)), len(share)), bags[:-1])
                got = [pa.array(p, pa.float64()), pa.array(n_parts, pa.int32()), pa.array(low[focus], pa.int64()), pa.array(size[focus], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *got], names=[f.name for f in schema])
            tidy()

    return docs.mapInArrow(run, schema)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; the score reads the text only."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
