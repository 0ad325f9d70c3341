"""Periodic run detection: stretches of words that repeat with a period three times or more.

Karp, Miller and Rosenberg's naming: the name of a window of 2^(k+1) words is the rank of the pair
of names of its halves, so two windows of one length are equal where their names are. Names are made
for all documents of a batch at once, with words numbered for each document apart; a window that
comes only once gets a name that nothing else has and takes no part in the next level, so the levels
end where no window of that length comes back within a document.

A run of period q and three times its length holds, whatever its start, two equal windows of 2^k
words, 2^k <= q < 2^(k+1), at neighbouring points of the grid of q: comparing the names of all
neighbouring points, n / q of each period, finds every run. What agrees is extended both ways: the
longest common extension of two places comes from descending the levels, one step each. Nothing is
hashed and no suffixes are sorted.

Defined results: null text counts as empty; a text of no words has no run and the empty text when
collapsed; runs may overlap, each of its smallest period; a word that some run drops is dropped;
repeated rows stay repeated; whole texts are searched whatever their length (levels take 4 bytes a word each, and
are as many as the longest repeat needs); a batch is bounded by bytes; an empty table gives an empty
result; other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, text_or_empty, trim

LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Points of the grid that are compared at a time.
CHUNK = 1 << 20


def word_names(docs: list[list[bytes]]) -> np.ndarray:
    """A number for each word of all documents; equal within a document where the words are."""
    nth = count()
    out = np.empty(sum(map(len, docs)), np.int32)
    at = 0
    for words in docs:
        numbers: dict[bytes, int] = defaultdict(nth.__next__)
        out[at : at + len(words)] = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
        at += len(words)
    return out


def _alone(n: int) -> np.ndarray:
    """Names that no two places share, one more than there are words."""
    return -1 - np.arange(n + 1, dtype=np.int32)


def name_levels(words: np.ndarray) -> list[np.ndarray]:
    """Names of the windows of 1, 2, 4, ... words at each place (and one past the end): negative
    for what comes once, or would pass the end. A level without any repeat is not made."""
    n = len(words)
    levels: list[np.ndarray] = []
    places, keys = np.arange(n), words.astype(np.int64)
    while len(places):
        _, rank, times = np.unique(keys, return_inverse=True, return_counts=True)
        again = times[rank] > 1
        if not again.any():
            break
        names = _alone(n)
        names[places[again]] = rank[again]
        levels.append(names)
        size = 1 << (len(levels) - 1)
        places = places[again]
        places = places[places < n - size]
        places = places[names[places + size] >= 0]
        keys = names[places].astype(np.int64) * len(times) + names[places + size]
    return levels


def forward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words agree from places i and j (i < j) on."""
    i, begin = i.copy(), i
    shift = j - i
    for k in range(len(levels) - 1, -1, -1):
        i += (levels[k][i] == levels[k][i + shift]).astype(i.dtype) << k
    return i - begin


def backward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words agree before places i and j (i < j)."""
    i, begin = i.copy(), i
    shift = j - i
    for k in range(len(levels) - 1, -1, -1):
        at = i - (1 << k)
        inside = np.maximum(at, 0)
        i -= ((at >= 0) & (levels[k][inside] == levels[k][inside + shift])).astype(i.dtype) << k
    return begin - i


def grid(starts: np.ndarray, lengths: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, place, period) of all neighbouring grid points of the periods from 2^k below
    2^(k+1) that three periods fit into, in chunks."""
    low, high = 1 << k, np.minimum((2 << k) - 1, lengths // LEAST_PERIODS)
    periods = np.maximum(high - low + 1, 0)
    doc = np.repeat(np.arange(len(lengths)), periods)
    q = low + np.arange(len(doc)) - np.repeat(np.cumsum(periods) - periods, periods)
    points = (lengths[doc] - 1) // q
    ends = np.cumsum(points)
    done = 0
    while done < len(doc):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + CHUNK, "right")))
        some = points[done:upto]
        each = np.repeat(np.arange(done, upto), some)
        nth = np.arange(len(each)) - np.repeat(np.cumsum(some) - some, some)
        yield doc[each], starts[doc[each]] + nth * q[each], q[each]
        done = upto


def find(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of all runs, by document, start and period."""
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    starts = np.cumsum(lengths) - lengths
    levels = name_levels(word_names(docs))
    of = np.repeat(np.arange(len(docs)), lengths)
    found: list[np.ndarray] = []
    for k, names in enumerate(levels):
        # Only documents with a window of this length that comes back.
        busy = np.flatnonzero(np.bincount(of[names[:-1] >= 0], minlength=len(docs)) * (lengths >= LEAST_WORDS))
        for d, i, q in grid(starts[busy], lengths[busy], k):
            same = names[i] == names[i + q]
            if not same.any():
                continue
            d, i, q = busy[d[same]], i[same], q[same]
            back = backward(levels, i, i + q)
            length = back + forward(levels, i, i + q) + q
            ok = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
            found.append(np.unique(np.column_stack([d, i - back - starts[d], length, q])[ok], axis=0))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    rows = np.unique(np.concatenate(found), axis=0)
    # A stretch that has a smaller period as well is that period's run, of the same ends.
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[first]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    return rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3]


def collapse(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not len(start):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return [w for w, dropped in zip(words, (np.cumsum(edge[:-1]) > 0).tolist(), strict=True) if not dropped]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, runs array<struct<start, length, period>> by start and period, collapsed) of each row;
    collapsed is the kept words joined by one space."""
    small_batches(docs.sparkSession)
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def run(batches):
        for batch in batches:
            words = [t.encode().split() for t in batch.column("text").to_pylist()]
            doc, start, length, period = find(words)
            ends = np.searchsorted(doc, np.arange(len(words) + 1))
            kept = [b" ".join(collapse(w, start[a:b], length[a:b], period[a:b])) for w, a, b in zip(words, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), runs.cast(_RUNS), pa.array(kept, pa.binary()).cast(pa.string(), safe=False)], [id_col, "runs", "collapsed"])
        trim()

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def longest(runs: str = "runs") -> str:
    """SQL of the run with the most periods, compared exactly; the first by start and period of
    several, null without any."""
    return f"aggregate({runs}, get({runs}, 0), (b, r) -> CASE WHEN r.length * b.period > b.length * r.period THEN r ELSE b END)"


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the words from place a on made periodic in about a tenth of the
    documents, chosen, like a and the period, by the checksum of their id (none for a null id)."""
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            out = []
            for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = text.encode()
                words = [] if h is None or h % 10 else raw.split()
                if not words:
                    out.append(raw)
                    continue
                g, n = h // 10, len(words)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                out.append(b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary()).cast(pa.string(), safe=False)], ["doc_id", "text"])
        trim()

    rows = docs.select("doc_id", text_or_empty().alias("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    return rows.mapInArrow(run, f"doc_id {kind}, text string")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_planted_runs(table(spark, sf_dir, "documents"))).withColumn("best", F.expr(longest()))
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
