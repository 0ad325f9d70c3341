"""Document fingerprints by order MinHash, in DataFrame functions only.

The k-mers (runs of k words; a word of more than 32 characters, as in text without spaces, counts
as its characters) of a text are numbered by occurrence, so the second "a b c" is another element
than the first. A coordinate takes the l elements that are least under its
permutation, puts them back into text order and hashes the tuple: two texts agree in a
coordinate only where they share these k-mers in the same order, which makes the share of
equal coordinates sensitive to edit distance and not only to the set of k-mers.

The permutations are rotations of one random order: every element has one hash on a circle,
and coordinate j takes the first l elements from the j-th of m equidistant points on. One
sort serves all coordinates. Hash and position share a long (34 and 30 bits: no string of
2 GB has more words), so both sorts are on primitive arrays.

Defined results: null text counts as empty; an empty text, or one of white space alone, has
all coordinates 0; a text of fewer than k words is one k-mer; a text of fewer than l k-mers
uses what it has; equal texts have equal fingerprints; whole texts are used whatever their
length. "Next" is by descending doc_id, null ids last, equal ids by hash and then text; after
the last comes the first; a single document is its own next; an empty table gives an empty result;
other columns are left out of the query, and pass through ``fingerprint`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

K, L, M = 3, 2, 32
#: Longer words are taken character by character, so many at a time.
LONG_WORD, BLOCK = 32, 4096
#: Rows a bucket holds at about; at most so many buckets.
BUCKET_ROWS, MOST_BUCKETS = 1024, 1 << 16
_LOW = (1 << 30) - 1


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _lower_bound(array: str, key: str, high: str) -> str:
    """First index of the sorted array, below ``high``, whose element is at least the key; else
    high. Descends by halving steps; the only state is an index."""
    top = f"CAST(floor(log2(greatest({high}, 1))) AS INT)"
    steps = f"transform(sequence(0, {top}), z -> shiftleft(1, {top} - z))"
    return f"aggregate({steps}, 0, (s, st) -> CASE WHEN s + st <= {high} AND {array}[s + st - 1] < {key} THEN s + st ELSE s END)"


def signature(text: str, k: int = K, l: int = L, m: int = M) -> str:  # noqa: E741
    """SQL of the m coordinates (array<bigint>, 32 bits each) of a text expression."""
    split = rf"filter(split({text}, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"
    # Long words go by blocks, so that no more than a block's characters are objects at a time.
    chars = rf"flatten(transform(regexp_extract_all(w, '(?s).{{1,{BLOCK}}}', 0), x -> transform(split(x, ''), c -> xxhash64(c))))"
    mixed = f"flatten(transform(ws, w -> CASE WHEN length(w) > {LONG_WORD} THEN {chars} ELSE array(xxhash64(w)) END))"
    words = _let(split, "ws", f"CASE WHEN exists(ws, w -> length(w) > {LONG_WORD}) THEN {mixed} ELSE transform(ws, w -> xxhash64(w)) END")
    tuple_ = ", ".join(f"wh[i + {j}]" for j in range(k))
    kmers = f"CASE WHEN size(wh) = 0 THEN CAST(array() AS array<bigint>) WHEN size(wh) < {k} THEN array(xxhash64(wh)) ELSE transform(sequence(0, size(wh) - {k}), i -> xxhash64({tuple_})) END"
    by_kmer = f"sort_array(transform(kh, (x, i) -> (x & {~_LOW}L) | (i & {_LOW})))"
    same = lambda d: f"i < {d} OR (a[i - {d}] & {~_LOW}L) <> (v & {~_LOW}L)"
    nth = "CASE " + " ".join(f"WHEN {same(d)} THEN {d - 1}" for d in range(1, 5)) + f" ELSE i - {_lower_bound('a', f'(v & {~_LOW}L)', 'i')} END"
    by_hash = f"sort_array(transform(a, (v, i) -> (xxhash64(v & {~_LOW}L, {nth}) & {~_LOW}L) | (v & {_LOW})))"
    points = "array(" + ", ".join(f"{-(1 << 63) + 1 + j * ((1 << 64) // m)}L" for j in range(m)) + ")"
    first = "aggregate(steps, 0, (s, st) -> CASE WHEN s + st <= size(b) AND b[s + st - 1] < p THEN s + st ELSE s END)"
    halves = "transform(sequence(0, CAST(floor(log2(size(b))) AS INT)), z -> shiftleft(1, CAST(floor(log2(size(b))) AS INT) - z))"
    picked = f"sort_array(transform(sequence(0, least({l}, size(b)) - 1), o -> b[CAST((f + o) % size(b) AS INT)] & {_LOW}))"
    hashed = f"xxhash64(transform({picked}, q -> kh[CAST(q AS INT)])) & 4294967295"
    each = f"transform({points}, p -> {_let(first, 'f', hashed)})"
    full = _let(by_kmer, "a", _let(by_hash, "b", _let(halves, "steps", each)))
    none = f"array_repeat(0L, {m})"
    return _let(words, "wh", _let(kmers, "kh", f"CASE WHEN size(kh) = 0 THEN {none} ELSE {full} END"))


def as_text(sig: str) -> Column:
    return F.expr(f"array_join(transform({sig}, x -> lpad(lower(hex(x)), 8, '0')), '')")


def likeness(a: str, b: str, m: int = M) -> Column:
    """The share of equal coordinates."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> CASE WHEN x = y THEN 1 ELSE 0 END), 0, (s, x) -> s + x)") / F.lit(float(m))


def fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """The rows with a fingerprint column."""
    return docs.withColumn("_sig", F.expr(signature(f"coalesce(`{text_col}`, '')"))).withColumn(out, as_text("_sig")).drop("_sig")


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """(doc_id, text, carried...) plus next_text and next_<carried> of the next document.

    Ids are cut into buckets at quantiles; the first document of a bucket is also a guest, at
    the end, of the bucket before it. So rows move once, whatever their number, and no window
    spans more than a bucket."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    n = ids.count()
    buckets = max(1, min(MOST_BUCKETS, -(-n // BUCKET_ROWS)))
    cuts: list[int] = []
    if buckets > 1:
        shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
        cuts = sorted(set(ids.agg(F.percentile_approx("doc_id", shares, F.lit(max(10_000, 8 * buckets))).alias("c")).first()["c"] or []))
    found = _lower_bound("c", "(doc_id + 1)", "size(c)")
    bucket = F.expr(_let("array(" + ", ".join(f"{c}L" for c in cuts) + ")", "c", f"CASE WHEN doc_id IS NULL THEN 0 ELSE {found} END")) if cuts else F.lit(0)
    # A row for each bucket that is not empty, at most MOST_BUCKETS.
    tops = sorted((r["b"], r["t"]) for r in ids.withColumn("b", bucket).groupBy("b").agg(F.max("doc_id").alias("t")).collect())
    hosts = [(t, tops[(i + 1) % len(tops)][0]) for i, (_, t) in enumerate(tops)]
    guests = docs.sparkSession.createDataFrame(hosts, "_top long, _host int") if hosts else docs.sparkSession.createDataFrame([], "_top long, _host int")

    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("_b", bucket.cast("int"))
    rows = rows.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("_top")), "left")
    own = F.struct(F.col("_b").alias("b"), F.lit(0).alias("g"))
    rows = rows.withColumn("_at", F.explode(F.when(F.col("_host").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("_host").alias("b"), F.lit(1).alias("g"))))))
    rows = rows.select("doc_id", "text", *carried, F.col("_at.b").alias("_b"), F.col("_at.g").alias("_g"))
    w = Window.partitionBy("_b").orderBy("_g", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")
    nexts = F.lead(F.struct("text", *carried), 1).over(w)
    return rows.withColumn("_next", nexts).where("_g = 0").select("doc_id", "text", *carried, F.col("_next.text").alias("next_text"), *[F.col(f"_next.{c}").alias(f"next_{c}") for c in carried])


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(docs.withColumn("sig", F.expr(signature("text"))), ["sig"])
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("_cut", F.expr("CAST(n_chars div 3 AS INT)"))
    rows = rows.withColumn("_edited", F.expr("concat(substring(text, 1, CAST(n_chars AS INT) - _cut), substring(next_text, 1, _cut))"))
    rows = rows.withColumn("_edited_sig", F.expr(signature("_edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("_edited"), 256).alias("edited_sha256"), as_text("sig").alias("fingerprint"), as_text("_edited_sig").alias("edited_fingerprint"),
        likeness("sig", "_edited_sig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"),
    )
