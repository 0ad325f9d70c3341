"""The labelled rows that a classifier learns from, and its held-out rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc32_mod, text_or_empty

#: At most so many labelled rows, and bytes of their texts, go to the driver to fit a classifier.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 64 << 20


def held_out(mod: int, remainder: int, id_col: str = "doc_id"):
    return F.coalesce(crc32_mod(id_col, mod) == remainder, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, mod: int, remainder: int, most: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list[int]]:
    """Whole texts and labels of the first ``most`` labelled rows by a hash of their id, without
    the held-out ones; a row whose text would exceed ``most_bytes`` in all is passed over. The ids
    are chosen before any text is read. Null labels and ids are left out; of an id with several
    labels or texts the largest is taken."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL").where(~held_out(mod, remainder))
    ids = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    # Labelled ids without a document must not use up the bound.
    sizes = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.octet_length(text_or_empty())).alias("n"))
    first = ids.join(sizes, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    chosen, total = [], 0
    for r in first:
        if total + r["n"] <= most_bytes:
            total += r["n"]
            chosen.append((r["doc_id"], r["y"]))
    if not chosen:
        return [], []
    ids = docs.sparkSession.createDataFrame(chosen, T.StructType([docs.schema["doc_id"], T.StructField("y", T.IntegerType())]))
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(ids), "doc_id")
    got = texts.groupBy("doc_id").agg(F.max("text").alias("text"), F.first("y").alias("y")).collect()
    got.sort(key=lambda r: r["doc_id"])
    return [r["text"] for r in got], [r["y"] for r in got]
