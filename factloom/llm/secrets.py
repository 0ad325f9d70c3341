"""Secret scans: fixed patterns plus sliding-window entropy over candidate strings.

The base kinds are regular expressions, leftmost and non-overlapping per kind. The entropy
kind takes every maximal run of token characters as a candidate, assigns it the narrowest
character class that holds it, and slides a window over it: character counts and the sum of
c*log2(c) are updated by the one character that enters and the one that leaves, so a
candidate of n characters costs O(n) whatever the window. The span is the union of windows
at or above the class's threshold. What base spans cover of a candidate is taken out first,
and each part that remains is a candidate of its own. Candidates on the allow-list are
suppressed. Runs of letters are left to their class's threshold; of those with letters of both
cases or with / + = only spans that read like words are suppressed.

Defined results: null text counts as empty; empty text has no span; whole texts are scanned
whatever their length, in time proportional to it; spans that start together come in the order of
their kinds; repeated rows stay repeated; an empty table gives an empty result; other columns,
whatever their names, pass through ``redact_documents`` and are left out of the scan.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, text_or_empty, trim

# The base kinds in their order, pattern and least length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_RUN = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "entropy")

#: Candidate runs of the entropy kind.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
WINDOW = 24
#: Character classes from narrow to wide with the least bits a character in a window.
CLASSES = (
    ("digits", re.compile(r"[0-9]+"), 3.05),
    ("hex", re.compile(r"[0-9a-fA-F]+"), 3.4),
    ("lower", re.compile(r"[a-z_-]+"), 4.25),
    ("upper", re.compile(r"[A-Z_-]+"), 4.25),
    ("alnum", re.compile(r"[A-Za-z0-9]+"), 4.0),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 4.0),
)
#: Suppressed: dates and number lists, repeated units, UUIDs.
ALLOW = (
    re.compile(r"[0-9]{1,4}([-/_][0-9]{1,4})+"),
    re.compile(r"(.{1,8})\1{2,}.{0,8}"),
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
)
#: Words of a run of letters, between separators and changes of case: random letters of both cases
#: change at every second or third letter.
LETTERS = re.compile(r"[A-Za-z+/_=-]+")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
PART_LEAST, PART_MOST = 4, 20
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
_CLOG = [0.0] + [c * math.log2(c) for c in range(1, 4097)]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by start and then in the order of kinds."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    # A run of one class is maximal, so asking for its least length in the pattern finds the same runs.
    found += [(m.start(), m.end(), 2) for m in HEX_RUN.finditer(text)]
    found.sort(key=lambda s: (s[0], s[2]))
    return [(a, b, KINDS[k]) for a, b, k in found]


def window_entropy(s: str, window: int = WINDOW) -> Iterator[tuple[int, float]]:
    """(start, bits a character) of every window, by incremental counts."""
    counts: dict[str, int] = {}
    total = 0.0
    log_w = math.log2(window)
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        total += _CLOG[c + 1] - _CLOG[c]
        counts[ch] = c + 1
        if i >= window:
            out = s[i - window]
            c = counts[out]
            total -= _CLOG[c] - _CLOG[c - 1]
            counts[out] = c - 1
        if i >= window - 1:
            yield i - window + 1, log_w - total / window


def union(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """(start, end) of what spans, sorted by start, cover together: apart from each other and in order."""
    out: list[tuple[int, int]] = []
    for a, b, _ in spans:
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def candidates(text: str, covered: list[tuple[int, int, str]]) -> Iterator[tuple[int, str]]:
    """(start, characters) of what the base spans, sorted by start, leave of each candidate run.
    Runs and covered stretches are both in order, so each is passed once."""
    gone, k = union(covered), 0
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        while k < len(gone) and gone[k][1] <= at:
            k += 1
        while k < len(gone) and gone[k][0] < end:
            a, b = gone[k]
            if a - at >= WINDOW:
                yield at, text[at:a]
            at = max(at, b)
            if b > end:
                break
            k += 1
        if end - at >= WINDOW:
            yield at, text[at:end]


def word_like(s: str) -> bool:
    """Whether the letters stand in parts of the lengths of words: 4 on average, none over 20."""
    parts = [len(p) for p in PARTS.findall(s)]
    return bool(parts) and sum(parts) >= PART_LEAST * len(parts) and max(parts) <= PART_MOST


def entropy_spans(text: str, covered: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out = []
    for at, s in candidates(text, covered):
        if any(p.fullmatch(s) for p in ALLOW):
            continue
        name, least = next((c, t) for c, p, t in CLASSES if p.fullmatch(s))
        found, first, last = [], -1, -1
        for i, bits in window_entropy(s):
            if bits >= least:
                if first >= 0 and i > last:
                    found.append((first, last))
                    first = -1
                first = i if first < 0 else first
                last = i + WINDOW
        if first >= 0:
            found.append((first, last))
        if found and name not in ("lower", "upper") and LETTERS.fullmatch(s):
            found = [(a, b) for a, b in found if not word_like(s[a:b])]
        out += [(at + a, at + b, KINDS[3]) for a, b in found]
    return out


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans by start and then kind."""
    base = base_spans(text)
    more = entropy_spans(text, base)
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]))) if more else base


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with the union of its spans replaced by a mark each."""
    spans = scan(text)[1]
    if not spans:
        return text
    parts, at, open_end = [], 0, -1
    for a, b, _ in spans:
        if a < open_end:
            at = open_end = max(open_end, b)
            continue
        parts += [text[at:a], mark]
        at = open_end = b
    return "".join([*parts, text[at:]])


def digest(spans: Iterable[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<start, end, kind>>, base the same for base kinds) per row."""
    kind = dict(docs.select(id_col).dtypes)[id_col]
    span = "array<struct<start:int,end:int,kind:string>>"

    def run(batches):
        for batch in batches:
            both = [scan(t) for t in batch.column("text").to_pylist()]
            base, spans = (pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in x[i]] for x in both], SPANS) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), base, spans], [id_col, "base", "spans"])
        trim()

    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, base {span}, spans {span}")


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with every span of their text replaced; null stays null."""
    small_batches(docs.sparkSession)
    cols = [F.col(f"`{c}`") for c in docs.columns]

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else redact(t))
        trim()

    return docs.select(*cols).withColumn(text_col, clean(F.col(text_col)))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_documents(table(spark, sf_dir, "documents"))
    code = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(code(F.col("base")), 256).alias("base_sha256"), code(F.col("spans")).alias("spans"))
