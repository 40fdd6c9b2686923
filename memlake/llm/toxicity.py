"""Toxicity by class-conditional Kneser-Ney models over the letters of words.

A word is spelled letter by letter between a start and an end mark; the
context of a letter is all of the word before it. Each class (toxic, ordinary)
has its own discounted counts at that context; both back off to one
Kneser-Ney model of the last marks (ORDER at most, with the letter), whose
continuation counts they share. A letter in a context that neither class has
seen therefore counts the same for both, and an expression that one of them
uses much more often counts for that one.

Even a toxic document is ordinary text for the most part, so its model draws a
share MIX of the words from the toxic counts and the rest from the ordinary
ones. The score rests on one number, the difference of the length-normalised
log-likelihoods of the document under that model and the ordinary one; a
logistic curve fitted on labelled rows that the counts did not see turns it
into a probability.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.llm.common import seeded_unit, table
from memlake.llm.text import spread, tidy

ORDER, DISCOUNT = 9, 0.75
WORD = re.compile(r"\w+")
#: The share of toxic expressions among the words of a toxic document.
MIX = 0.01
#: The classifier is fitted on at most about so many labelled rows a class, drawn by a seeded hash of the id among
#: those with texts of at most so many bytes. Scoring reads every text whole.
SAMPLE_ROWS, SAMPLE_TEXT, SEED = 2000, 100_000, 7
#: Each of so many parts of them is scored by the counts of the others, for the curve.
PARTS = 8
THRESHOLD = 0.7
#: Words whose scores a worker remembers between batches.
CACHE_WORDS = 100_000
#: Documents split into words at once.
SLICE = 200
#: Words spelled at once, and the marks that they may have together.
CHUNK, MARKS = 20_000, 1 << 19
_A, _B, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def spell(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Marks (start 1, end 2, letters from 3) of each word as a row, and the lengths."""
    width = max(map(len, words))
    chars = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    marks = np.zeros((len(words), width + 2), np.uint64)
    marks[:, 0] = 1
    marks[:, 1:-1] = np.where(np.arange(width) < size[:, None], chars + np.uint64(3), 0)
    marks[np.arange(len(words)), size + 1] = 2
    return marks, size + 2


def spelled(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, marks, lengths) of bounded numbers of words of about the same length; a word may be of any length."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        widest = size[order[at : at + CHUNK]] + 2
        n = max(1, int(np.searchsorted(widest * np.arange(1, len(widest) + 1), MARKS, "right")))
        own = order[at : at + n]
        yield own, *spell([words[i] for i in own])
        at += n


def prefixes(marks: np.ndarray) -> np.ndarray:
    """A hash of all marks up to each place."""
    h = np.empty_like(marks)
    with np.errstate(over="ignore"):
        h[:, 0] = (marks[:, 0] + np.uint64(11)) * _B
        for j in range(1, marks.shape[1]):
            before = h[:, j - 1]
            h[:, j] = (before ^ (before >> np.uint64(29))) * _A + marks[:, j] * _M
    return h


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(wanted.shape, np.int64), np.zeros(wanted.shape, bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class KneserNey:
    """Log-likelihood ratios of letters, for those contexts and letters that were seen."""

    def __init__(self, order: int = ORDER, discount: float = DISCOUNT) -> None:
        self.order, self.discount = order, discount
        self.keys = self.ctx = np.zeros(0, np.uint64)
        self.value = self.ctx_value = np.zeros(0, np.float32)

    def fit(self, words: list[str], toxic: np.ndarray, ordinary: np.ndarray) -> KneserNey:
        return self.weighed(self.spelling(words), toxic, ordinary)

    def spelling(self, words: list[str]) -> dict[str, np.ndarray]:
        """What the words alone decide: their letters in context, and the shared model of these."""
        parts = []
        for own, marks, size in spelled(words):
            row, col = np.nonzero(np.arange(1, marks.shape[1])[None, :] < size[:, None])
            col += 1  # the start mark itself is given
            prefix = prefixes(marks)
            parts.append((prefix[row, col], prefix[row, col - 1], own[row].astype(np.int32), col.astype(np.int32)))
        if not parts:
            return {}
        key, ctx, row, col = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        keys, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        inverse, ctx, col = inverse.astype(np.int32), ctx[first], col[first]
        del key
        own_ctx, of_ctx = np.unique(ctx, return_inverse=True)
        at, inner = find(keys, ctx)
        prev = np.where(inner, at, len(keys)).astype(np.int32)  # the place of the mark before; the start mark comes after all places
        del ctx, at, inner
        return {"keys": keys, "inverse": inverse, "row": row, "ctx": own_ctx, "of_ctx": of_ctx, "shared": self._shared(words, row[first], col, prev)}

    def weighed(self, spelling: dict[str, np.ndarray], toxic: np.ndarray, ordinary: np.ndarray) -> KneserNey:
        """The model of words that were counted so often in the two classes; the larger class is scaled to the mass of
        the smaller, so that what neither has seen is no evidence for the one with fewer words."""
        model = KneserNey(self.order, self.discount)
        if not spelling or not toxic.sum() or not ordinary.sum():
            return model
        least = min(toxic.sum(), ordinary.sum())
        model.keys, model.ctx, of_ctx = spelling["keys"], spelling["ctx"], spelling["of_ctx"]
        value, ctx_value = np.zeros(len(model.keys)), np.zeros(len(model.ctx))
        for n, sign in ((toxic, 1), (ordinary, -1)):
            n = np.bincount(spelling["inverse"], (n * (least / n.sum()))[spelling["row"]], len(model.keys))
            total = np.bincount(of_ctx, n, len(model.ctx))
            taken = np.bincount(of_ctx, np.minimum(n, self.discount), len(model.ctx))
            left = np.where(total > 0, taken / np.maximum(total, 1e-300), 1.0)  # mass that goes to the shared model
            p = np.maximum(n - self.discount, 0) / np.maximum(total[of_ctx], 1e-300) + left[of_ctx] * spelling["shared"]
            value += sign * np.log(p)
            ctx_value += sign * np.log(left)
        model.value, model.ctx_value = value.astype(np.float32), ctx_value.astype(np.float32)
        return model

    def _shared(self, words: list[str], row: np.ndarray, col: np.ndarray, prev: np.ndarray) -> np.ndarray:
        """Interpolated Kneser-Ney over all distinct grams, whichever class they come from, at the
        given places of the words; grams grow by one mark a round, found by the place before."""
        n = len(row)
        by_row = np.argsort(row, kind="stable")
        begin = np.searchsorted(row[by_row], np.arange(len(words) + 1))
        letters: set[int] = set()
        mark = np.zeros(n + 2, np.uint64)
        mark[n] = 1  # the start; before it nothing
        for words_here, marks, _ in spelled(words):
            size = begin[words_here + 1] - begin[words_here]
            own = by_row[spread(begin[words_here], size)]
            letters.update(np.unique(marks).tolist())
            mark[own] = marks[np.repeat(np.arange(len(words_here)), size), col[own].astype(np.int64)]
        del by_row, begin
        prev = np.append(prev, np.array([n + 1, n + 1], np.int32))
        back = np.arange(n + 2, dtype=np.int32)
        p = np.full(n, 1.0 / max(len(letters), 2))
        with np.errstate(over="ignore"):
            h = (mark + np.uint64(11)) * _B
        longer = h ^ (h >> np.uint64(32))
        for k in range(self.order):
            last, back = longer, prev[back]
            far = mark[back]
            with np.errstate(over="ignore"):
                h = np.where(far > 0, (h ^ (h >> np.uint64(29))) * _A + far * _M, h)
            longer = h ^ (h >> np.uint64(32))
            _, one = np.unique(longer[:n], return_index=True)  # distinct left extensions of each gram
            g, cont = np.unique(last[one], return_counts=True)
            at = np.searchsorted(g, last[:n])
            lead = np.zeros(len(g), np.uint64)
            if k:
                lead[at] = before
            before = last[prev[:n]]
            c, of = np.unique(lead, return_inverse=True)
            total, kinds = np.bincount(of, cont, len(c)), np.bincount(of, minlength=len(c))
            i = of[at]
            p = (np.maximum(cont[at] - self.discount, 0) + self.discount * kinds[i] * p) / total[i]
        return p

    def ratios(self, words: list[str]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word."""
        out = np.zeros(len(words))
        if not len(self.keys) or not words:
            return out
        for own, marks, size in spelled(words):
            prefix = prefixes(marks)
            row, col = np.nonzero(np.arange(1, marks.shape[1])[None, :] < size[:, None])
            col = col + 1
            at, seen = find(self.keys, prefix[row, col])
            value = np.where(seen, self.value[at], 0.0)
            miss = np.flatnonzero(~seen)
            at, known = find(self.ctx, prefix[row[miss], col[miss] - 1])
            value[miss] = np.where(known, self.ctx_value[at], 0.0)
            out[own] = np.bincount(row, value, len(own))
        return out

    def gains(self, words: list[str]) -> np.ndarray:
        """What each word adds to the toxic document's log-likelihood over the ordinary one's."""
        return np.log1p(MIX * np.expm1(np.minimum(self.ratios(words), 50.0)))


def evidence(texts: list[str | None], gain: dict[str, float], model: KneserNey) -> np.ndarray:
    """The difference of the two log-likelihoods a word of each document; 0 for one without words."""
    return np.concatenate([np.zeros(0), *(_evidence(texts[i : i + SLICE], gain, model) for i in range(0, len(texts), SLICE))])


def _evidence(texts: list[str | None], gain: dict[str, float], model: KneserNey) -> np.ndarray:
    split = [words_of(t) for t in texts]
    new = list(set().union(*split).difference(gain)) if split else []
    if len(gain) + len(new) > CACHE_WORDS:
        gain.clear()
        new = list(set().union(*split))
    for i in range(0, len(new), CHUNK):
        gain.update(zip(new[i : i + CHUNK], model.gains(new[i : i + CHUNK]).tolist(), strict=True))
    return np.array([sum(map(gain.__getitem__, words)) / len(words) if words else 0.0 for words in split])


#: The curve before any row is seen: constant and slope. It holds where few labelled rows speak for another one.
PRIOR, PRIOR_ROWS = np.array([-8.0, 11.0]), 4.0


def logistic(x: np.ndarray, y: np.ndarray, turns: int = 50) -> np.ndarray:
    """Newton's method; constant and slope, held to PRIOR with a strength of PRIOR_ROWS."""
    x = np.column_stack([np.ones(len(x)), x])
    w = PRIOR.copy()
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + PRIOR_ROWS * np.eye(len(w)), x.T @ (p - y) + PRIOR_ROWS * (w - PRIOR))
        w -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


#: The difference is bounded before the curve, so that one odd document does not tilt it; it saturates at about MIX.
SQUASH = 1.5 / MIX


def bounded(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * SQUASH)


def score_of(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[0] + bounded(x) * w[1], -30, 30)))


def count_words(texts: list[str | None], group: np.ndarray, groups: int) -> tuple[list[str], np.ndarray]:
    """The words, and the documents of each group that hold them: one that repeats a word says no more."""
    counts = [Counter() for _ in range(groups)]
    for t, g in zip(texts, group.tolist(), strict=True):
        counts[g].update(set(words_of(t)))
    words = sorted(set().union(*counts))
    return words, np.stack([np.fromiter((c[w] for w in words), float, len(words)) for c in counts])


def train(texts: list[str | None], toxic: np.ndarray, part: np.ndarray) -> tuple[KneserNey, np.ndarray]:
    """Counts from all rows; the curve from rows scored by models that did not count their part (0 to PARTS - 1)."""
    base = KneserNey()
    words, n = count_words(texts, 2 * part + ~toxic, 2 * PARTS)
    tidy()
    spelling, n = base.spelling(words), n.reshape(PARTS, 2, len(words))
    every, x = n.sum(axis=0), np.zeros(len(texts))
    for k in range(PARTS):
        own = np.flatnonzero(part == k)
        if len(own):
            x[own] = evidence([texts[i] for i in own], {}, base.weighed(spelling, *(every - n[k])))
    w = logistic(bounded(x), toxic.astype(float)) if len(texts) and 0 < toxic.sum() < len(texts) else np.array([-2.0, 0.0])
    return base.weighed(spelling, *every), w


def _train(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("doc_id")
    model = train(pdf["text"].to_list(), pdf["toxic"].to_numpy() == 1, pdf["part"].to_numpy())
    tidy()
    return pd.DataFrame({"model": [pickle.dumps(model, 5)]})


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = SEED) -> bytes:
    """The model, from labelled rows outside the held-out remainder.

    Labels other than 0 and 1, and null ids, teach nothing. Of repeated labels of
    an id the larger counts. With one class only, every score is the prior.
    """
    use = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id")))
    use = use.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in use.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    u = seeded_unit(seed, F.col("doc_id")) / F.lit(float(2**53))
    drawn = use.filter(u < F.when(F.col("toxic") == 1, sample_rows / max(n.get(1, 0), 1)).otherwise(sample_rows / max(n.get(0, 0), 1)))
    rows = docs.select("doc_id", "text").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_TEXT).join(F.broadcast(drawn), "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int"))
    got = rows.groupBy().applyInPandas(_train, "model binary").first()
    return bytes(got[0]) if got else pickle.dumps((KneserNey(), np.array([-2.0, 0.0])), 5)


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """Adds score (double) to docs, from text alone; a null or empty text has no evidence.

    Other columns stay as they are; a score among them is replaced. Batches are scored one after another, so memory
    does not grow with the table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [c for c in docs.columns if c != "score"]
    docs = docs.select(*fields)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kn, w = pickle.loads(shared.value)
        gain: dict[str, float] = {}
        for b in batches:
            for s in range(0, len(b), SLICE):
                part = b.slice(s, SLICE)
                got = score_of(evidence(part.column("text").to_pylist(), gain, kn), w)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.float64())], names=[*fields, "score"])
            tidy()
        kn = gain = b = part = None
        tidy()  # the worker waits for other tasks

    return docs.mapInArrow(run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; the score reads the text only."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    slim = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = score(slim, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
