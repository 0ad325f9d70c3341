"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of itself and its character n-grams, hashed to buckets with an embedding
each; a window of words is the average of its words' bags; a linear softmax scores it.
Embeddings and softmax are trained jointly in numpy, so a misspelling that was never seen
shares most of its n-gram vectors with the word it comes from. A document is scored by its
most toxic window of WINDOW words, wherever it starts: one insult in a long text is not averaged away. Training
alternates: windows of a toxic document all count as toxic at first, then only its highest.
A last logistic step maps the highest window's logit to a probability.

At scoring time a word adds a single number (its bag's average times the softmax's
difference), which a worker keeps in a bounded cache.

Defined results: null texts, empty ones and those of white space and sentence marks alone are scored
like the cleanest document of the training rows; texts of any length are scored whole, runs without
spaces too; equal texts score alike and repeated rows stay repeated; of windows that tie the first
is trained on; without any label of one class the score is the share of the other, smoothed; an empty table
gives an empty result; other columns pass through ``keep_clean`` and are left out of the query,
whatever their names.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty, trim
from .labelled import held_out, training_rows

WINDOW = 4
BUCKETS, DIM = 1 << 17, 8
GRAMS = (3, 4, 5)
LEAST_DOCS = 4
CACHE_WORDS = 150_000
#: Tokens longer than this (text joined by marks, or prose without spaces) are cut into words at
#: JOINTS, and what is still longer into pieces of PIECE characters that overlap by half: every
#: n-gram is in a piece, and a word of up to nine characters stands whole in one.
LONGEST, PIECE = 64, 16
HELD_OUT_MOD, HELD_OUT_REMAINDER, THRESHOLD = 4, 2, 0.3
#: A token is a run without white space, less the sentence marks at its ends: symbols, marks within
#: it and characters of any script stay, so "$hit", "@ss" and "sh!t" keep the n-grams they are made of.
_TOKEN = re.compile(r"[^\s,;:.!?()\"|](?:\S*[^\s,;:.!?()\"|])?")
JOINTS = re.compile(r"[-_/+=#&~\u3001\u3002\uff0c\uff01\uff1f]+")


def pieces_of(token: str) -> list[str]:
    """The words of a token: itself unless it is longer than LONGEST."""
    if len(token) <= LONGEST:
        return [token]
    half = PIECE // 2
    out: list[str] = []
    for w in JOINTS.split(token):
        if len(w) > LONGEST:
            out += [w[i : i + PIECE] for i in range(0, len(w) - half, half)]
        elif w:
            out.append(w)
    return out


def words_of(text: str) -> list[str]:
    tokens = _TOKEN.findall(text.lower())
    return [w for t in tokens for w in pieces_of(t)] if max(map(len, tokens), default=0) > LONGEST else tokens


def buckets_of(word: str) -> list[int]:
    """The word's own bucket and those of its n-grams, with marks at both ends."""
    w = f"<{word}>".encode()
    crc, n = zlib.crc32, len(w)
    mask = BUCKETS - 1
    return [crc(w) & mask, *(crc(w[i : i + g]) & mask for g in GRAMS if g < n for i in range(n - g + 1))]


class Model:
    """v: a number for each bucket; bias; the logistic step's slope and offset; what a text
    without words has for its highest window: the least of any clean training document."""

    def __init__(self, v: np.ndarray, bias: float, slope: float, offset: float, empty: float = 0.0):
        self.v, self.bias, self.slope, self.offset, self.empty = v, bias, slope, offset, empty
        self.cache: dict[str, float] = {}

    def __reduce__(self):
        return Model, (self.v, self.bias, self.slope, self.offset, self.empty)

    def _word(self, w: str) -> float:
        b = buckets_of(w)
        s = float(self.v[b].sum()) / len(b)
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        self.cache[w] = s
        return s

    def score(self, text: str) -> float:
        get, slow = self.cache.get, self._word
        s = [x if (x := get(w)) is not None else slow(w) for w in words_of(text)]
        top = max_window(np.asarray(s)) if s else self.empty
        z = self.slope * (top + self.bias) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def window_starts(n: int) -> np.ndarray:
    return np.arange(max(1, n - WINDOW + 1))


def max_window(s: np.ndarray) -> float:
    """The highest average over the windows of a document's word numbers."""
    n = len(s)
    if not n:
        return 0.0
    if n <= WINDOW:
        return float(s.mean())
    c = np.concatenate([[0.0], np.cumsum(s)])
    return float((c[WINDOW:] - c[:-WINDOW]).max() / WINDOW)


def fit(texts: list[str], labels: list[int], seed: int = 0, epochs: int | None = None) -> Model:
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, float(np.log(p / (1 - p))))
    epochs = epochs or max(8, min(40, 16000 // len(texts)))
    rng = np.random.default_rng(seed)
    vocab: dict[str, int] = {}
    docs = [np.array([vocab.setdefault(w, len(vocab)) for w in words_of(t)], np.int32) for t in texts]
    flat_bags, sizes = array("i"), array("i")
    for w in vocab:
        bag = buckets_of(w)
        flat_bags.extend(bag)
        sizes.append(len(bag))
    size = np.array(sizes or [1], np.int64)
    ptr = np.concatenate([[0], np.cumsum(size)])
    sub = np.frombuffer(flat_bags, np.int32) if len(flat_bags) else np.zeros(1, np.int32)
    del flat_bags, sizes
    # A bucket of fewer than LEAST_DOCS training documents can only be learned by heart: it
    # stays zero, as do those that training never saw.
    seen = np.zeros(BUCKETS, np.int32)
    for d in docs:
        if len(d):
            u = np.unique(d)
            seen[np.unique(np.concatenate([sub[ptr[w] : ptr[w + 1]] for w in u]))] += 1
    sub = np.where(seen[sub] >= LEAST_DOCS, sub, BUCKETS).astype(np.int32)
    E = rng.normal(0, 0.05, (BUCKETS + 1, DIM)).astype(np.float32)
    E[:BUCKETS][seen < LEAST_DOCS] = 0
    E[BUCKETS] = 0
    W, b = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    gE, gW, gb = np.full(BUCKETS + 1, 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    starts = [window_starts(len(d)) for d in docs]

    def numbers() -> np.ndarray:
        v = E @ (W[:, 1] - W[:, 0])
        return np.add.reduceat(v[sub], ptr[:-1]) / size

    def best(d: np.ndarray, at: np.ndarray, s: np.ndarray) -> int:
        c = np.concatenate([[0.0], np.cumsum(s[d])])
        return int(at[np.argmax(c[np.minimum(at + WINDOW, len(d))] - c[at])])

    for epoch in range(epochs):
        s = numbers() if epoch > 1 and len(vocab) else None
        todo: list[tuple[int, int]] = []
        for i, (d, at) in enumerate(zip(docs, starts, strict=True)):
            if not len(d):
                continue
            if s is None:
                take = at if y[i] else rng.choice(at, min(4, len(at)), replace=False)
            else:
                take = {best(d, at, s)} | (set() if y[i] else set(rng.choice(at, min(2, len(at)), replace=False).tolist()))
            todo += [(i, int(a)) for a in take]
        rng.shuffle(todo)
        for k in range(0, len(todo), 256):
            batch = todo[k : k + 256]
            wins = [docs[i][a : a + WINDOW] for i, a in batch]
            n = np.array([len(w) for w in wins])
            flat, inv = np.unique(np.concatenate(wins), return_inverse=True)
            row = np.repeat(np.arange(len(wins)), n)
            ln = size[flat]
            off = np.concatenate([[0], np.cumsum(ln)])
            idx = sub[np.repeat(ptr[flat] - off[:-1], ln) + np.arange(off[-1])]
            vec = np.add.reduceat(E[idx], off[:-1], axis=0) / ln[:, None]
            h = np.add.reduceat(vec[inv], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0) / n[:, None]
            z = h @ W + b
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            t = y[[i for i, _ in batch]].astype(int)
            p[np.arange(len(t)), t] -= 1
            g = (p / len(t)).astype(np.float32)
            dW, db, dh = h.T @ g, g.sum(0), g @ W.T
            gW += dW**2
            gb += db**2
            W -= 0.2 * dW / np.sqrt(gW)
            b -= 0.2 * db / np.sqrt(gb)
            dword = np.zeros_like(vec)
            per = dh[row] / n[row][:, None]
            for j in range(DIM):
                dword[:, j] = np.bincount(inv, per[:, j], len(flat))
            dsub = np.repeat(dword / ln[:, None], ln, axis=0)
            ub, ui = np.unique(idx, return_inverse=True)
            dE = np.stack([np.bincount(ui, dsub[:, j], len(ub)) for j in range(DIM)], 1).astype(np.float32)
            gE[ub] += (dE**2).mean(1)
            E[ub] -= 0.2 * dE / np.sqrt(gE[ub])[:, None]
            E[BUCKETS] = 0
    s = numbers()
    bias = float(b[1] - b[0])
    top = np.array([max_window(s[d]) if len(d) else np.nan for d in docs])
    clean = top[(y == 0) & ~np.isnan(top)]
    empty = float(clean.min()) if len(clean) else 0.0
    top = np.where(np.isnan(top), empty, top) + bias
    slope, offset = 1.0, 0.0
    scale = max(1.0, float(np.abs(top).max()))
    x = top / scale
    for _ in range(400):  # logistic step, with a weak pull to the slope of a softmax
        q = 1 / (1 + np.exp(-np.clip(slope * scale * x + offset, -30, 30)))
        slope -= 2.0 * float(((q - y) * x).mean() + 1e-3 * (slope - 1)) / scale
        offset -= 2.0 * float((q - y).mean())
    return Model((E[:BUCKETS] @ (W[:, 1] - W[:, 0])).astype(np.float32), bias, slope, offset, empty)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(*training_rows(docs, labels, "toxic", HELD_OUT_MOD, HELD_OUT_REMAINDER))


def score_column(model: Model, text_col: str = "text"):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(model.score).astype(float)
        model.cache.clear()
        trim()

    return score(text_or_empty(text_col))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, all columns, whose text scores under the threshold."""
    return docs.where(score_column(train(docs, labels)) < threshold)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = docs.select("doc_id", held_out(HELD_OUT_MOD, HELD_OUT_REMAINDER).alias("held_out"), score_column(train(docs, labels)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
