"""Packing token sequences by best-fit decreasing.

Documents become token ids with an end id; overlong ones are first cut into full windows.
What is left of each goes, longest first, into the open window with the least sufficient
room, found by a segment tree indexed by remaining capacity; if none has room a new window
is opened. Only piece lengths are packed, never ids: a piece is 40 bytes whatever its text.

Pieces are dealt by hash to groups of about ``group_pieces`` and each group is packed on its
own, so no task holds more; the padding of a group is that of one or two open windows and
of what the fit leaves over. Equal pieces (of equal ids and texts) are counted, which takes no more
than one row of them from each task, and dealt in lots of ``lot`` copies that are spread over the
groups like any other piece. So the result depends on the rows only, not on partitions.

Defined results: null and empty texts are the end id alone; equal rows are exchangeable and
stay repeated; pieces of one length are packed by id (null first), start and checksum; an empty
table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shelf, table, text_or_empty, trim

WINDOW = 1024
END_ID = 0
PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def _byte_chars() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the other bytes, in order, for U+0100 onwards."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, those that the tokenizers
    library gives for the file.

    A byte-level vocabulary whose ids are in the order of its merges is run by tiktoken, which
    needs only these ranks and is about four times as fast; any other by tokenizers itself."""

    def __init__(self, path: str, fast: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ranks = self._ranks(spec) if fast else None
        if self.ranks:
            import public_tokenizers
            import tiktoken

            self.enc = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens=self.special)
        else:
            from tokenizers import Tokenizer

            self.tok = Tokenizer.from_file(path)

    def _ranks(self, spec: dict) -> dict[bytes, int] | None:
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        plain = plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        merged = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model.get("merges", ())]
        vocab = {t: i for t, i in model.get("vocab", {}).items() if t not in self.special}
        if not plain or sorted(merged, key=vocab.__getitem__) != merged or len(vocab) != len(merged) + 256:
            return None
        chars = _byte_chars()
        return {bytes(map(chars.__getitem__, t)): i for t, i in vocab.items()}

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.ranks:
            return self.enc.encode_to_numpy(text, allowed_special=set(self.special)).astype("<u4", copy=False).tobytes()
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


class CapacityTree:
    """A segment tree over remaining capacities 0..window: which have an open window."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.n = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, bin_: int) -> None:
        self.open[room].append(bin_)
        i = room + self.size
        while i:
            self.n[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, bin) of the tightest open window with at least that room."""
        n, i = self.n, least + self.size
        if not n[i]:
            while i > 1 and (i & 1 or not n[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if n[2 * i] else 2 * i + 1
        room = i - self.size
        while i:
            n[i] -= 1
            i >>= 1
        return room, self.open[room].pop()


def best_fit(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(bin, offset) for lengths that are given longest first."""
    tree, out, bins = CapacityTree(window), [], 0
    for n in lengths:
        got = tree.take(n) if n < window else None
        if got is None:
            room, b = window, bins
            bins += 1
        else:
            room, b = got
        out.append((b, window - room))
        if room > n:
            tree.add(room - n, b)
    return out


def token_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full windows, then what is left."""
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        encode = _encoder(tokenizer).encode
        for batch in batches:
            who, rows = [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                ids = encode(t) + end
                n = len(ids) // 4
                for s in range(0, n, window):
                    who.append(i)
                    rows.append((s, min(window, n - s), zlib.crc32(ids[4 * s : 4 * (s + window)]), n))
            made = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(who, pa.int32())), *made], PIECE)
        trim()

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer: str, *, window: int = WINDOW, end_id: int = END_ID, group_pieces: int = 16384, lot: int = 256) -> DataFrame:
    """The pieces with sequence_id and offset."""
    shelf = Shelf(docs.sparkSession, "packing")
    counted = token_pieces(docs, tokenizer, window, end_id).groupBy(*PIECE).agg(F.count("*").alias("copies"))
    pieces = shelf.put(counted)
    n = pieces.agg(F.sum("copies").alias("n")).first()["n"] or 0
    groups = max(1, -(-n // group_pieces))
    kind = dict(pieces.dtypes)["doc_id"]

    def run(key, rows):
        rows = rows.take(pa.array(np.repeat(np.arange(len(rows)), rows.column("copies").to_numpy()))).select(PIECE)
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending"), ("doc_tokens", "ascending")])
        at = best_fit(rows.column("length").to_pylist(), window)
        base = key[0].as_py() << 32
        rows = rows.append_column("sequence_id", pa.array([base + b for b, _ in at], pa.int64()))
        return rows.append_column("offset", pa.array([o for _, o in at], pa.int64()))

    lots = pieces.withColumn("l", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {lot}"))))
    lots = lots.withColumn("copies", F.least(F.lit(lot), F.col("copies") - F.col("l") * lot))
    dealt = lots.withColumn("g", F.pmod(F.xxhash64(*PIECE, "l"), F.lit(groups))).drop("l")
    return dealt.groupBy("g").applyInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
