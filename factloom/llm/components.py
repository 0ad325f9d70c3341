"""Connected components by alternating stars.

Edges are rewritten until they form one star around the least id of each component. A large
star links every greater neighbour of a node to the least node near it, a small star every
lesser one; both keep components, and the edge set reaches a fixed point in about
log^2(longest path) rounds. Minima are partially aggregated before any shuffle, and the
neighbours of a node that has many are dealt to several tasks, so no task gathers a
neighbourhood.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf, hot_keys, no_shuffle_left, spread_join


def _star(to_u: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """(u, v, m): each (u, v) with its u's row of least (u, m, n)."""
    return spread_join(to_u, least.select("u", "m"), ["u"], "v", hot_keys(least, ["u"], total))


def _large_star(e: DataFrame, total: int, shelf: Shelf) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = shelf.put(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")))
    out = shelf.put(_star(both.where("v > u"), least, total).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
    shelf.drop(least)
    return out


def _small_star(e: DataFrame, total: int, shelf: Shelf) -> DataFrame:
    least = shelf.put(e.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"), F.count("*").alias("n")))
    moved = _star(e.select(F.col("a").alias("u"), F.col("b").alias("v")), least, total).where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    out = shelf.put(moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
    shelf.drop(least)
    return out


def _round(e: DataFrame, total: int, shelf: Shelf) -> DataFrame:
    large = _large_star(e, total, shelf)
    out = _small_star(large, total, shelf)
    shelf.drop(large, e)
    return out


def components(edges: DataFrame, shelf: Shelf, most_rounds: int = 64, settle: bool = True) -> DataFrame:
    """(id, component) for every id that is not the least of its component, from edges a > b or
    a < b; the least id of a component stands for it and has no row. The result is written.

    Without ``settle`` one round is made and every id has the least neighbour that this left:
    ids with one label are in one component, but a component may still have several labels."""
    e = shelf.put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if not settle:
        e = _round(e, e.count(), shelf)
        out = shelf.put(e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")))
        shelf.drop(e)
        return out
    state = None
    for _ in range(most_rounds):
        with no_shuffle_left(shelf.spark):
            now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 40)).alias("h")).first()
        if now["n"] == 0 or (state is not None and (now["n"], now["h"]) == state):
            out = shelf.put(e.select(F.col("a").alias("id"), F.col("b").alias("component")))
            shelf.drop(e)
            return out
        state = (now["n"], now["h"])
        e = _round(e, now["n"], shelf)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
