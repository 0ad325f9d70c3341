"""Quality: a byte-level convolutional network in numpy.

The UTF-8 bytes of the whole text are cut into overlapping chunks. Learned filters (over
learned byte embeddings) slide over every byte; their outputs are max-pooled in each chunk;
the chunks' maxima are combined by their maximum and their mean, and a logistic unit turns
both into one probability. Gradients reach only the positions that won a pool.

At scoring time a filter over byte pairs is a table look-up, so a byte costs three look-ups
of all filters whatever the embedding's size. Long texts are scored in slabs of chunks, so
memory does not grow with a text.

Defined results: null and empty texts are scored as one empty chunk; repeated rows stay
repeated; without any label of one class the score is the share of the other, smoothed; an
empty table gives an empty result; of other columns only those named here are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty, trim
from .labelled import held_out, training_rows

CHUNK, OVERLAP, WIDTH = 512, 64, 6
EMBED, FILTERS = 8, 16
SLAB_ROWS = 256
SLAB = SLAB_ROWS * (CHUNK - OVERLAP)
HELD_OUT_MOD, HELD_OUT_REMAINDER, THRESHOLD = 3, 1, 0.5


def chunk_starts(n: int) -> np.ndarray:
    return np.arange(0, max(1, n - OVERLAP), CHUNK - OVERLAP)


class Model:
    def __init__(self, emb, filt, bias, head, head_bias):
        self.emb, self.filt, self.bias, self.head, self.head_bias = emb, filt, bias, head, head_bias
        self.pairs = None

    def __reduce__(self):
        return Model, (self.emb, self.filt, self.bias, self.head, self.head_bias)

    def _tables(self) -> list[np.ndarray]:
        """For each pair of filter taps, the outputs of every byte pair (first byte low)."""
        if self.pairs is None:
            one = [self.emb @ self.filt[j] for j in range(WIDTH)]
            self.pairs = [np.ascontiguousarray((one[j + 1][:, None, :] + one[j][None, :, :]).reshape(65536, FILTERS)) for j in range(0, WIDTH, 2)]
            self.pairs[0] = self.pairs[0] + self.bias
        return self.pairs

    def pooled(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(maximum, mean) over chunks of the filters' chunk maxima."""
        tables = self._tables()
        n = len(raw)
        x = np.zeros(max(n, 1) + WIDTH, np.uint8)
        x[:n] = np.frombuffer(raw, np.uint8)
        starts = chunk_starts(n)
        top, total = np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float64)
        per = SLAB // (CHUNK - OVERLAP)
        for k in range(0, len(starts), per):
            at = starts[k : k + per]
            lo, hi = int(at[0]), int(min(max(n, 1), at[-1] + CHUNK))
            pair = x[lo : hi + WIDTH - 1].astype(np.uint16)
            pair = pair[:-1] | (pair[1:] << 8)
            m = hi - lo
            out = tables[0][pair[:m]]
            for j in range(1, WIDTH // 2):
                out += tables[j][pair[2 * j : 2 * j + m]]
            # Each chunk is its own part and the head of the next: pool parts, then join them.
            own = np.maximum.reduceat(out, at - lo, axis=0)
            ends = np.minimum(at + CHUNK, hi) - lo
            nexts = np.minimum(at - lo + CHUNK - OVERLAP, m)
            tails = [out[a:b].max(0) if a < b else None for a, b in zip(nexts.tolist(), ends.tolist(), strict=True)]
            for i, t in enumerate(tails):
                if t is not None:
                    np.maximum(own[i], t, out=own[i])
            own = np.maximum(own, 0)
            top = np.maximum(top, own.max(0))
            total += own.sum(0)
        return top, (total / len(starts)).astype(np.float32)

    def score(self, text: str) -> float:
        top, mean = self.pooled(text.encode("utf-8", "replace"))
        z = float(self.head @ np.concatenate([top, mean])) + self.head_bias
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def _pool(P: dict[str, np.ndarray], rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(pool, taps): the filters' maxima in each chunk and the WIDTH bytes under each maximum."""
    span = CHUNK + WIDTH
    pool = np.empty((len(rows), FILTERS), np.float32)
    taps = np.empty((len(rows), FILTERS, WIDTH), np.uint8)
    one = [P["emb"] @ P["filt"][j] for j in range(WIDTH)]
    for k in range(0, len(rows), SLAB_ROWS):
        part = rows[k : k + SLAB_ROWS]
        x = np.zeros((len(part), span), np.uint8)
        live = np.zeros((len(part), CHUNK), bool)
        for r, raw in enumerate(part):
            x[r, : len(raw)] = np.frombuffer(raw, np.uint8)
            live[r, : max(1, min(CHUNK, len(raw)))] = True
        out = one[0][x[:, :CHUNK]] + P["bias"]
        for j in range(1, WIDTH):
            out += one[j][x[:, j : j + CHUNK]]
        out[~live] = -1e9
        arg = out.argmax(1)
        pool[k : k + len(part)] = np.take_along_axis(out, arg[:, None, :], 1)[:, 0]
        taps[k : k + len(part)] = x[np.arange(len(part))[:, None, None], arg[:, :, None] + np.arange(WIDTH)]
    return pool, taps


def fit(texts: list[str], labels: list[int], seed: int = 0, epochs: int = 12, batch: int = 32) -> Model:
    """Adam on minibatches of whole documents: every chunk of a text takes part in every epoch."""
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float32)
    P = {
        "emb": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), "filt": rng.normal(0, 0.15, (WIDTH, EMBED, FILTERS)).astype(np.float32),
        "bias": np.full(FILTERS, -0.1, np.float32), "head": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), "hb": np.zeros(1, np.float32),
    }
    p0 = float((y.sum() + 0.5) / (len(y) + 1))
    P["hb"][0] = np.log(p0 / (1 - p0))
    if len(y) == 0 or y.min() == y.max():
        P["head"][:] = 0
        return Model(P["emb"], P["filt"], P["bias"], P["head"], float(P["hb"][0]))
    M, V = ({k: np.zeros_like(v) for k, v in P.items()} for _ in range(2))
    raws = [t.encode("utf-8", "replace") for t in texts]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(raws))
        for k in range(0, len(order), batch):
            ids = order[k : k + batch]
            rows, owner = [], []
            for d, i in enumerate(ids):
                at = chunk_starts(len(raws[i])).tolist()
                rows += [raws[i][a : a + CHUNK + WIDTH - 1] for a in at]  # filters read on past a chunk, as in scoring
                owner += [d] * len(at)
            own = np.asarray(owner)
            pool, taps = _pool(P, rows)
            act = np.maximum(pool, 0)
            nd = len(ids)
            first = np.searchsorted(own, np.arange(nd))
            count = np.bincount(own, minlength=nd)[:, None]
            top = np.maximum.reduceat(act, first, axis=0)
            mean = np.add.reduceat(act, first, axis=0) / count
            h = np.concatenate([top, mean], 1)
            q = 1 / (1 + np.exp(-np.clip(h @ P["head"] + P["hb"][0], -30, 30)))
            dz = ((q - y[ids]) / nd).astype(np.float32)
            G = {"head": h.T @ dz + 1e-4 * P["head"], "hb": np.array([dz.sum()], np.float32)}
            dh = dz[:, None] * P["head"][None]
            win = act == top[own]
            dact = dh[own, :FILTERS] * win + (dh[:, FILTERS:] / count)[own]
            dact *= pool > 0
            G["bias"] = dact.sum(0)
            G["emb"], G["filt"] = np.zeros_like(P["emb"]), np.zeros_like(P["filt"])
            cell = np.arange(FILTERS)[None]
            for j in range(WIDTH):
                byte = taps[:, :, j].astype(np.int64)
                dT = np.bincount((byte * FILTERS + cell).ravel(), dact.ravel(), 256 * FILTERS).reshape(256, FILTERS).astype(np.float32)
                G["emb"] += dT @ P["filt"][j].T
                G["filt"][j] = P["emb"].T @ dT
            step += 1
            rate = 0.01 * (1 - epoch / epochs)
            for n in P:
                M[n] = 0.9 * M[n] + 0.1 * G[n]
                V[n] = 0.999 * V[n] + 0.001 * G[n] ** 2
                P[n] -= rate * (M[n] / (1 - 0.9**step)) / (np.sqrt(V[n] / (1 - 0.999**step)) + 1e-7)
    return Model(P["emb"], P["filt"], P["bias"], P["head"], float(P["hb"][0]))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(*training_rows(docs, labels, "quality", HELD_OUT_MOD, HELD_OUT_REMAINDER))


def score_column(model: Model, text_col: str = "text"):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(model.score).astype(float)
        model.pairs = None
        trim()

    return score(text_or_empty(text_col))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = docs.select("doc_id", held_out(HELD_OUT_MOD, HELD_OUT_REMAINDER).alias("held_out"), score_column(train(docs, labels)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
