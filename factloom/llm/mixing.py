"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets: the sources share all words by weight; a target stops at a multiple of its source's
size and the excess is shared again by weight among the rest. The mix is counted in blocks
of equal size: blocks go to sources by highest quotients target/(2a+1), and each source's
blocks go to its shards in the same way by shard size, which gives an integer quota for
every shard. A shard lays its documents end to end in a seeded order, cuts that into blocks,
takes every block quota // n times and a seeded choice of quota % n blocks once more.

Only one row per source, and one per shard (at most ``max_shards`` and one more a source),
meets on the driver. A hot source has many shards, so no task holds more than a shard's
(id, size) rows.

Defined results: a null source is a source of its own, last in order; null and empty texts
have size 0 and are taken 0 times; equal rows are exchangeable and stay repeated; an empty
table gives an empty mix; the same rows give the same mix whatever their partitions.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Shelf, table

SOURCE_WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Tables of one row a source, or a shard, are broadcast up to so many rows (of about 100 bytes).
BROADCAST_ROWS = 100_000


def n_words(col: str = "text"):
    return F.coalesce(F.regexp_count(F.col(col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def capped_targets(sizes: Sequence[int], weights: Sequence[float], most: float = MOST_REPEATS) -> list[float]:
    """Shares of sum(sizes) by weight; none above most * its size, the excess shared again."""
    left, open_ = float(sum(sizes)), list(range(len(sizes)))
    target = [0.0] * len(sizes)
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > most * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = float(most * sizes[i])
        left -= sum(target[i] for i in over)
        gone = set(over)
        open_ = [i for i in open_ if i not in gone]
    return target


def sainte_lague(weights: Sequence[float], seats: int, most: Sequence[int] | None = None) -> list[int]:
    """Seats by highest quotients w/(2a+1), ties to the earlier; ``most`` bounds each.

    Starts from the rounded shares and moves single seats until no quotient that was given is
    below one that was not, which is the same allocation as giving seats one by one."""
    n, total = len(weights), float(sum(weights))
    most = list(most) if most is not None else [seats] * n
    got = [0] * n
    if total <= 0:
        return got
    got = [min(m, math.floor(w * seats / total + 0.5)) for w, m in zip(weights, most, strict=True)]
    have = sum(got)
    if have < seats:
        heap = [(-w / (2 * a + 1), i) for i, (w, a) in enumerate(zip(weights, got, strict=True)) if a < most[i] and w > 0]
        heapq.heapify(heap)
        while have < seats and heap:
            _, i = heapq.heappop(heap)
            got[i] += 1
            have += 1
            if got[i] < most[i]:
                heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    elif have > seats:
        heap = [(w / (2 * a - 1), -i) for i, (w, a) in enumerate(zip(weights, got, strict=True)) if a]
        heapq.heapify(heap)
        while have > seats and heap:
            _, i = heapq.heappop(heap)
            got[-i] -= 1
            have -= 1
            if got[-i]:
                heapq.heappush(heap, (weights[-i] / (2 * got[-i] - 1), i))
    return got


def _coprime(n: int, seed: int) -> int:
    """A seeded multiplier without a common factor with n, near n times the golden ratio."""
    a = max(1, int(n * 0.6180339887) + seed % 7)
    while math.gcd(a, n) != 1:
        a += 1
    return a


def plan_mix(rows: DataFrame, *, block_words: int = 64, seed: int = 0, weights: Sequence[float] = SOURCE_WEIGHTS, shard_words: int = 1 << 18, max_shards: int = 1 << 16) -> DataFrame:
    """``rows`` (with longs ``_size`` and ``_hash``, of the text, and a ``source``) plus _source_size, _target, _taken, and
    what a consumer needs to cut them out: _at (its first word in its shard), _n, _q, _a, _b."""
    spark = rows.sparkSession
    sizes = {r["source"]: int(r["s"] or 0) for r in rows.groupBy("source").agg(F.sum("_size").alias("s")).collect()}
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    words = [sizes[s] for s in names]
    target = capped_targets(words, [weights[i % len(weights)] for i in range(len(names))])
    width = max(shard_words, -(-sum(words) // max_shards))
    shards = [max(1, -(-w // width)) for w in words]
    key = "coalesce(concat('s', source), 'n')"
    made = spark.createDataFrame([("n" if s is None else "s" + s, n, w, t) for s, n, w, t in zip(names, shards, words, target, strict=True)], "_key string, _shards long, _source_size long, _target double")
    rows = rows.withColumn("_key", F.expr(key)).withColumn("_order", F.xxhash64(F.lit(seed).cast("long"), "doc_id", "_size", "_hash"))
    made = F.broadcast(made) if len(names) <= BROADCAST_ROWS else made
    rows = rows.join(made, "_key").withColumn("_shard", F.pmod("_order", "_shards"))

    held = rows.groupBy("_key", "_shard").agg(F.sum("_size").alias("s")).collect()
    by_key: dict[str, list[tuple[int, int]]] = {}
    for r in held:
        by_key.setdefault(r["_key"], []).append((r["_shard"], int(r["s"] or 0)))
    keys = ["n" if s is None else "s" + s for s in names]
    blocks = [sum(-(-s // block_words) for _, s in by_key[k]) for k in keys]
    quota = sainte_lague(target, round(sum(target) / block_words), [MOST_REPEATS * b for b in blocks])
    plan = []
    for k, q in zip(keys, quota, strict=True):
        mine = sorted(by_key[k])
        ns = [-(-s // block_words) for _, s in mine]
        got = sainte_lague([s for _, s in mine], q, [MOST_REPEATS * n for n in ns])
        for (shard, _), n, g in zip(mine, ns, got, strict=True):
            n1 = max(1, n)
            plan.append((k, shard, n1, g, _coprime(n1, seed), (seed * 7919 + shard * 104729) % n1))
    few = len(plan) <= BROADCAST_ROWS
    plan = spark.createDataFrame(plan, "_key string, _shard long, _n long, _q long, _a long, _b long")
    rows = rows.join(F.broadcast(plan) if few else plan, ["_key", "_shard"])
    laid = Window.partitionBy("_key", "_shard").orderBy("_order", "doc_id", "_size", "_hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_at", F.sum("_size").over(laid) - F.col("_size"))
    b = block_words
    part = F.expr(
        f"CASE WHEN _size = 0 OR _q % _n = 0 THEN 0L ELSE aggregate(sequence(_at div {b}, (_at + _size - 1) div {b}), 0L, (acc, i) -> "
        f"acc + CASE WHEN pmod(_a * i + _b, _n) < _q % _n THEN least((i + 1) * {b}, _at + _size) - greatest(i * {b}, _at) ELSE 0L END) END"
    )
    return rows.withColumn("_extra", part).withColumn("_taken", F.expr("(_q div _n) * _size") + F.col("_extra"))


def mix_plan(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row."""
    # The words are counted once; what is left to read three times are four narrow columns.
    rows = Shelf(docs.sparkSession, "sizes").put(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words().alias("_size"), F.xxhash64("text").alias("_hash")))
    out = plan_mix(rows, **how)
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def mix_documents(docs: DataFrame, *, block_words: int = 64, **how) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: a row for every full pass over a
    document, and one for the words of its extra blocks where these are fewer."""
    cols = docs.columns
    # The caller's columns travel in one struct, so none can clash with those of the plan.
    rest = [F.col(f"`{c}`") for c in cols if c not in ("text", "n_chars")]
    held = docs.select(F.struct(*rest).alias("_row"), "doc_id", F.col("source").cast("string").alias("source"), "text", n_words().alias("_size"), F.xxhash64("text").alias("_hash"))
    rows = plan_mix(held, block_words=block_words, **how)
    b = block_words
    words = rf"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"
    block = (
        f"CASE WHEN pmod(_a * i + _b, _n) < _q % _n THEN slice(ws, CAST(greatest(i * {b}, _at) - _at AS INT) + 1, CAST(least((i + 1) * {b}, _at + _size) - greatest(i * {b}, _at) AS INT)) "
        "ELSE CAST(array() AS array<string>) END"
    )
    # The words are split once: the lambda's variable holds them for all blocks.
    cut = F.expr(f"element_at(transform(array({words}), ws -> array_join(flatten(transform(sequence(_at div {b}, (_at + _size - 1) div {b}), i -> {block})), ' ')), 1)")
    rows = rows.where("_taken > 0").withColumn("_times", F.expr("_taken div _size")).withColumn("_rest", F.expr("_taken % _size"))
    passes = F.explode(F.expr("CASE WHEN _rest > 0 THEN sequence(0L, _times) ELSE sequence(1L, _times) END"))
    whole = rows.withColumn("_pass", passes)  # pass 0 is the one that holds only the extra blocks
    whole = whole.withColumn("_text", F.when(F.col("_pass") > 0, F.col("text")).otherwise(cut))
    made = {"text": F.col("_text"), "n_chars": F.length("_text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return whole.select(*[made.get(c, F.col(f"_row.`{c}`")).alias(c) for c in cols])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents"), block_words=16)
