"""Quality rules: counts within a text, and lines that many documents of a host share.

Within a text: words, their characters, symbols, repeated lines, and words in three-word windows
that come back. Across documents: every line is brought to a normal form (ASCII letters lower,
digits as 0, white space as one space) and hashed together with its host; the distinct documents
that hold each hash are counted, a host's copies of one text counting once; lines that more than
``limit`` documents of their host hold are removed; and a document that is left with less than
``least_left`` percent of its words is rejected as depleted. A host's limit is ``share`` of its
distinct documents, but at least ``least_docs``, so it means the same at every size.

A document is one narrow row with a number and a word count for each distinct line. Counts are
summed before they are shuffled; only lines that enough rows hold, copies included, are counted
again by distinct document; both times a line that a third of all documents hold is one row a
task. Texts never move.

Defined results: null text counts as empty and has no words, so the base rules reject it; a line
without words is no line; a line that is repeated within a document counts once for it, and all
its words go; rows of one id, and repeated rows, are judged each by itself, and copies of one text
alike; a null host is a host of its own; ties with a limit stay; an empty table gives an empty result;
other columns pass through ``clean_documents`` and are left out of the query, whatever their names.
Hashes have 64 bits: two rare lines that share one are still rare.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Shelf, hot_keys, spread_join, table, text_or_empty, trim

LEAST_WORDS, MOST_REPEATED = 50, 50
LEAST_DOCS, SHARE, LEAST_LEFT = 10, 0.01, 30
#: The symbols that are counted, the white space between words.
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"
_DIGITS = bytes(0x30 if 0x30 <= b <= 0x39 else b for b in range(256))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that are found twice or more, the first included."""
    n = len(words) - 2
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    nth = count()
    ids = np.fromiter((numbers[w] if w in numbers else numbers.setdefault(w, next(nth)) for w in words), np.int64, len(words))
    # Two words to one number, then the third: no product leaves 64 bits.
    _, two = np.unique(ids[:-2] * len(numbers) + ids[1:-1], return_inverse=True)
    _, three, times = np.unique(two * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    again = times[three] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + n] |= again
    return int(covered.sum())


def text_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    raw = text.encode()
    words = raw.split()  # bytes split at the same six characters
    seen: set[bytes] = set()
    twice = 0
    for line in raw.split(b"\n"):
        if line in seen:
            twice += 1
        elif line.strip():
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), twice, repeated_words(words)


def normal_form(line: bytes) -> bytes:
    return b" ".join(line.lower().translate(_DIGITS).split())


def line_hash(host: str | None, normal: bytes) -> int:
    """Signed 64 bits of a host and a line in normal form."""
    h = xxhash.xxh3_64_intdigest((b"-" if host is None else b"+" + host.encode()) + b"\n" + normal)
    return h - (1 << 64) if h >> 63 else h


def line_words(host: str | None, text: str) -> dict[int, int]:
    """Hash to words of the distinct lines of a text."""
    out: dict[int, int] = {}
    for line in text.encode().split(b"\n"):
        normal = normal_form(line)
        if normal:
            h = line_hash(host, normal)
            out[h] = out.get(h, 0) + normal.count(b" ") + 1
    return out


_LINES = pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int32())]))


def measure(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(id, host, d, counts..., lines array<struct<h, w>>) of each row; d stands for host and text."""
    kind = dict(docs.select(id_col).dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), text_or_empty(text_col).alias("text")).select("*", F.xxhash64("host", F.col("host").isNull(), "text").alias("d"))

    def run(batches):
        for batch in batches:
            counts, offsets, hashes, words = [], [0], [], []
            for host, text in zip(batch.column("host").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts.append(text_counts(text))
                got = line_words(host, text)
                hashes += got
                words += got.values()
                offsets.append(len(hashes))
            lines = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(hashes, pa.int64()), pa.array(words, pa.int32())], ["h", "w"]))
            made = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)] if counts else [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("host"), batch.column("d"), *made, lines.cast(_LINES)], ["id", "host", "d", *COUNTS, "lines"])
        trim()

    return rows.mapInArrow(run, f"id {kind}, host string, d long, {', '.join(f'{c} long' for c in COUNTS)}, lines array<struct<h: long, w: int>>")


def _matched(lines: DataFrame, few: DataFrame) -> DataFrame:
    """Lines whose hash is in a written table (h, n) of counts: by broadcast when its counted rows
    allow, else by a shuffle that deals hot hashes to several tasks."""
    rows = few.count()
    if rows <= BROADCAST_IDS:
        return lines.join(F.broadcast(few.select("h")), "h")
    total = few.agg(F.sum("n").alias("n")).first()["n"]
    return spread_join(lines, few.select("h"), ["h"], "d", hot_keys(few, ["h"], total))


def frequent_lines(measured: DataFrame, shelf: Shelf, share: float = SHARE, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(h, n), written: lines that n distinct documents of their host hold, n above its limit."""
    lines = measured.select("host", "d", F.explode("lines.h").alias("h"))
    # Rows are at least distinct documents, so nothing above a limit is left out here.
    often = shelf.put(lines.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > least_docs))
    exact = _matched(lines, often).select("h", "d", "host").distinct().groupBy("h").agg(F.count("*").alias("n"), F.max("host").alias("host"))
    hosts = measured.select("host", "d").distinct().groupBy("host").agg(F.greatest(F.lit(float(least_docs)), F.count("*") * share).alias("_limit"))
    found = exact.join(hosts.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host"))).where("n > _limit")
    out = shelf.put(found.select("h", "n"))
    shelf.drop(often)
    return out


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", share: float = SHARE, least_docs: int = LEAST_DOCS, least_left: int = LEAST_LEFT) -> DataFrame:
    """(id, counts..., removed_words, base_failed, kept) of each row."""
    shelf = Shelf(docs.sparkSession, "rules")
    measured = shelf.put(measure(docs, id_col, text_col, host_col).withColumn("row", F.monotonically_increasing_id()))
    frequent = frequent_lines(measured, shelf, share, least_docs)
    lines = measured.select("row", "d", F.explode("lines").alias("l")).select("row", "d", F.col("l.h").alias("h"), F.col("l.w").alias("w"))
    gone = _matched(lines, frequent).groupBy("row").agg(F.sum("w").alias("removed_words"))
    rows = measured.drop("lines").join(gone, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    left = 100 * (F.col("n_words") - F.col("removed_words")) >= least_left * F.col("n_words")
    return rows.select(F.col("id").alias(id_col), *COUNTS, "removed_words", failed.alias("base_failed"), (~failed & left).alias("kept"))


def without_lines(text: str, host: str | None, gone: set[int]) -> str:
    """The text without the lines whose hash is in a set."""
    kept = []
    for line in text.split("\n"):
        normal = normal_form(line.encode())
        if not normal or line_hash(host, normal) not in gone:
            kept.append(line)
    return "\n".join(kept)


def clean_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", share: float = SHARE, least_docs: int = LEAST_DOCS, least_left: int = LEAST_LEFT) -> DataFrame:
    """The rows that pass, with the columns they had and frequent lines removed from their text."""
    shelf = Shelf(docs.sparkSession, "rules")
    measured = shelf.put(measure(docs, id_col, text_col, host_col))
    frequent = frequent_lines(measured, shelf, share, least_docs)
    # What goes depends on host and text only: one row for all copies of a text.
    texts = measured.groupBy("d").agg(F.count("*").alias("n"), F.max("n_words").alias("n_words"), F.max("n_repeat_words").alias("n_repeat_words"), F.any_value("lines").alias("lines"))
    texts = shelf.put(texts)
    lines = texts.select("d", F.explode("lines").alias("l")).select("d", F.col("l.h").alias("h"), F.col("l.w").alias("w"))
    gone = _matched(lines, frequent).groupBy("d").agg(F.collect_list("h").alias("_gone"), F.sum("w").alias("w"))
    verdict = texts.drop("lines").join(gone, "d", "left")
    w = F.col("n_words") - F.coalesce("w", F.lit(0))
    passes = (F.col("n_words") >= LEAST_WORDS) & (100 * F.col("n_repeat_words") <= MOST_REPEATED * F.col("n_words")) & (100 * w >= least_left * F.col("n_words"))
    verdict = shelf.put(verdict.where(passes).select(F.col("d").alias("_d"), "n", "_gone"))
    shelf.drop(measured, texts)

    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, hosts, gone in batches:
            yield pd.Series([t if g is None or t is None else without_lines(t, h, set(g.tolist())) for t, h, g in zip(texts, hosts, gone, strict=True)], dtype=object)
        trim()

    host = F.col(f"`{host_col}`").cast("string")
    keyed = docs.withColumn("_d", F.xxhash64(host, host.isNull(), text_or_empty(text_col)))
    total = verdict.agg(F.sum("n").alias("n")).first()["n"] or 0
    joined = spread_join(keyed, verdict.drop("n"), ["_d"], id_col, hot_keys(verdict, ["_d"], total))
    return joined.withColumn(text_col, cut(F.col(f"`{text_col}`"), host, F.col("_gone"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept", "removed_words")


OP12_SQL = r"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
u AS (SELECT r, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM u),
g AS (SELECT r, i, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p AS g FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + o) AS n FROM again CROSS JOIN range(0, 3) x(o) GROUP BY r),
ln AS (SELECT r, source, l, CASE WHEN l <> '' THEN regexp_extract_all(l, '[^\x20\x09-\x0D]+') END AS ws FROM (SELECT r, source, unnest(string_split(text, chr(10))) AS l FROM u)),
li AS (SELECT r, source, l, len(ws) AS n, translate(regexp_replace(array_to_string(ws, ' '), '[0-9]', '0', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS z FROM ln WHERE len(ws) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM li GROUP BY r),
docs_of AS (SELECT source, count(DISTINCT text) AS n FROM u GROUP BY source),
freq AS (SELECT li.source, li.z FROM li JOIN u ON u.r = li.r GROUP BY li.source, li.z HAVING count(DISTINCT u.text) > (SELECT greatest(10, d.n * 0.01) FROM docs_of d WHERE d.source IS NOT DISTINCT FROM li.source)),
gone AS (SELECT li.r, sum(li.n) AS n FROM li JOIN freq f ON f.z = li.z AND f.source IS NOT DISTINCT FROM li.source GROUP BY li.r),
a AS (SELECT u.doc_id, len(u.ws) AS n_words, length(array_to_string(u.ws, '')) AS word_chars, length(regexp_replace(u.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS removed_words
  FROM u LEFT JOIN dup ON dup.r = u.r LEFT JOIN rep ON rep.r = u.r LEFT JOIN gone ON gone.r = u.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  base_failed, NOT base_failed AND 100 * (n_words - removed_words) >= 30 * n_words AS kept, CAST(removed_words AS BIGINT) AS removed_words FROM b"""
