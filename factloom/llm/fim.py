"""Fill-in-middle transformation: a text is cut in three and its middle moves to the end.

A batch is one kernel on its Arrow UTF-8 buffers, for all rows together. A table of 256 classes
looks each byte up; a unit (a line, or a character) starts where the byte before ends a line (or
where a byte is no continuation) and at the start of each document; a cumulative sum over the
batch, less its value at the document's start, numbers the units; and one searchsorted call for
all rows finds the bytes where the chosen units start. Nothing is decoded and no row is looped
over until the pieces, slices of the buffer, are joined.

Where to cut and which form to take follow from a hash of the seed and the id alone, so they do
not depend on partitions, order or reruns, and rows of one id are cut alike.

Defined results: null text counts as empty; an empty text, and one that holds a mark, stays plain
and is its own output; texts of any length are transformed whole; a null id is hashed as an empty
one; equal rows have equal outputs and stay repeated; an empty table gives an empty result;
columns that are not asked for are left out, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, text_or_empty, trim

#: The marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARK_RE = "<[PSM]>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

#: Byte classes.
OTHER, LINE_END, CONTINUATION = 0, 1, 2
BYTE_CLASS = np.zeros(256, np.uint8)
BYTE_CLASS[0x0A] = LINE_END
BYTE_CLASS[0x80:0xC0] = CONTINUATION
LINES, CHARS = "lines", "chars"


def unit_numbers(data: np.ndarray, starts: np.ndarray, units: str = LINES) -> tuple[np.ndarray, np.ndarray]:
    """(for each byte of the batch the number of units that started up to it, the class of each
    byte). ``starts`` holds the first byte of every document that is not empty."""
    kinds = BYTE_CLASS[data]
    first = np.zeros(len(data), bool)
    if units == LINES:
        np.equal(kinds[:-1], LINE_END, out=first[1:])
    else:
        np.not_equal(kinds, CONTINUATION, out=first)
    first[starts] = True
    return np.cumsum(first, dtype=np.int32 if len(data) < 1 << 31 else np.int64), kinds


def cuts(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, units: str = LINES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(units, first cut, second cut, characters before each cut as two columns) of every document
    of a batch; cuts are bytes of the batch. ``offsets`` are Arrow's, ``hashes`` has two columns;
    a cut lies after hash modulo units + 1 units, and the smaller comes first."""
    begin, end = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
    full = end > begin
    number, kinds = unit_numbers(data, begin[full], units)
    before = np.where(begin > 0, number[begin - 1], 0) if len(number) else np.zeros(len(begin), np.int64)
    n = np.where(full, number[end - 1] - before, 0).astype(np.int64) if len(number) else np.zeros(len(begin), np.int64)
    picked = np.sort(hashes % (n + 1)[:, None], axis=1)
    # The unit with number u (from 0) starts at the first byte whose count passes the document's base plus u.
    at = np.searchsorted(number, before[:, None] + picked + 1, "left")
    at = np.where(picked < n[:, None], at, end[:, None])
    chars = np.cumsum(kinds != CONTINUATION, dtype=number.dtype)
    up_to = lambda x: np.where(x > 0, chars[x - 1], 0) if len(chars) else np.zeros(x.shape, np.int64)
    return n, at[:, 0], at[:, 1], (up_to(at) - up_to(begin)[:, None]).astype(np.int64)


def _joined(buf: memoryview, begin: int, a: int, b: int, end: int, form: str) -> bytes:
    prefix, middle, suffix = buf[begin:a], buf[a:b], buf[b:end]
    if form == PSM:
        return b"".join([b"<P>", prefix, b"<S>", suffix, b"<M>", middle])
    return b"".join([b"<S>", suffix, b"<P>", prefix, b"<M>", middle])


def transform_batch(texts: pa.Array, hashes: np.ndarray, forms: list[str], units: str = LINES) -> list[pa.Array]:
    """[units, prefix characters, middle characters, output] of a batch of texts without nulls."""
    # A sliced array's offsets point into the whole buffer.
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    raw = texts.buffers()[2] or b""
    buf = memoryview(raw)[low:high]
    offsets = offsets - low
    n, a, b, chars = cuts(np.frombuffer(buf, np.uint8), offsets, hashes, units)
    ends = zip(offsets[:-1].tolist(), a.tolist(), b.tolist(), offsets[1:].tolist(), forms, strict=True)
    out = [bytes(buf[i:j]) if f == PLAIN else _joined(buf, i, x, y, j, f) for i, x, y, j, f in ends]
    plain = np.fromiter((f == PLAIN for f in forms), bool, len(forms))
    # The bytes are whole characters of a valid text and marks.
    made = pa.array(out, pa.binary()).cast(pa.string(), safe=False)
    return [pa.array(n), pa.array(chars[:, 0], mask=plain), pa.array(chars[:, 1] - chars[:, 0], mask=plain), made]


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, units: str = LINES) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of each row: n units; the form is psm or
    spm, or plain for a text that stays as it is (empty, with a mark, or not among the
    ``fim_percent`` of ids); characters of the parts, null where plain."""
    if units not in (LINES, CHARS):
        raise ValueError(f"units must be {LINES} or {CHARS}")
    small_batches(docs.sparkSession)
    kind = dict(docs.select(id_col).dtypes)[id_col]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring("_digest", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    text = F.col("text")
    stays = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (h[2] % 100 >= fim_percent)
    form = F.when(stays, PLAIN).when(h[3] % 100 < spm_percent, SPM).otherwise(PSM)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), digest.alias("_digest")).select("id", "text", h[0].alias("h1"), h[1].alias("h2"), form.alias("form"))

    def run(batches):
        for batch in batches:
            hashes = np.column_stack([batch.column(c).to_numpy() for c in ("h1", "h2")])
            n, before, middle, output = transform_batch(batch.column("text"), hashes, batch.column("form").to_pylist(), units)
            yield pa.RecordBatch.from_arrays([batch.column("id"), n, batch.column("form"), before, middle, output], [id_col, "n", "form", "prefix_chars", "middle_chars", "output"])
        trim()

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text that an output of a form was made of. Parts hold no mark, and none can arise where
    a part and a mark meet, so the marks cut the output into its parts."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    part = F.split(output, MARK_RE, -1)
    return F.when(form == PSM, F.concat(part[1], part[3], part[2])).when(form == SPM, F.concat(part[2], part[3], part[1])).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored()).alias("restored_sha256"))


OP11_SQL = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || CAST(doc_id AS VARCHAR)) AS s FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS l, CAST('0x' || substr(s, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(s, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (SELECT *, len(l) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(l[1:a], '') AS pre, array_to_string(l[a + 1:b], '') AS mid, array_to_string(l[b + 1:n], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
