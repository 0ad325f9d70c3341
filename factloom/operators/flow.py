"""Control-flow operators: one shuffle by function, then a kernel per function.

Edges are (fn, src, dst) with dst -1 for the virtual exit; entry is block 0 unless said.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K


def per_function(edges: DataFrame, kernel: Callable[[list[tuple[int, int]]], Iterable[tuple]], columns: str) -> DataFrame:
    """Rows (fn, *columns) that a kernel makes of each function's edges."""
    names = [c.split()[0] for c in columns.split(",")]

    def run(key, pdf):
        rows = list(kernel(list(zip(pdf["src"].tolist(), pdf["dst"].tolist(), strict=True))))
        out = pd.DataFrame(rows, columns=names) if rows else pd.DataFrame({n: [] for n in names})
        out.insert(0, "fn", key[0])
        return out

    return edges.select("fn", "src", "dst").groupBy("fn").applyInPandas(run, f"fn long, {columns}")


def predecessors(edges: DataFrame) -> DataFrame:
    return edges.groupBy("fn", F.col("dst").alias("block")).agg(F.collect_set("src").alias("preds"))


def successors(edges: DataFrame) -> DataFrame:
    return edges.groupBy("fn", F.col("src").alias("block")).agg(F.collect_set("dst").alias("succs"))


def reach(edges: DataFrame) -> DataFrame:
    """(fn, src, dst): dst on a path of an edge or more from src."""

    def kernel(e):
        suc, _ = K.adjacency(e)
        return ((s, d) for s in suc for d in K.reachable(suc, s))

    return per_function(edges, kernel, "src long, dst long")


def reachable_from_entry(edges: DataFrame, entry: int = 0) -> DataFrame:
    def kernel(e):
        suc, _ = K.adjacency(e)
        return ((x,) for x in {entry, *K.reachable(suc, entry)})

    return per_function(edges, kernel, "block long")


def _idoms(e, entry, post):
    suc, pre = K.adjacency(e)
    return K.immediate_dominators(pre, suc, K.EXIT) if post else K.immediate_dominators(suc, pre, entry)


def immediate_dominators(edges: DataFrame, entry: int = 0) -> DataFrame:
    """(fn, block, idom); the entry and unreachable blocks have no row."""
    return per_function(edges, lambda e: ((n, d) for n, d in _idoms(e, entry, False).items() if n != K.EXIT), "block long, idom long")


def immediate_postdominators(edges: DataFrame) -> DataFrame:
    """(fn, block, ipdom); none where only the virtual exit postdominates."""
    return per_function(edges, lambda e: ((n, d) for n, d in _idoms(e, 0, True).items() if d != K.EXIT), "block long, ipdom long")


def dominators(edges: DataFrame, entry: int = 0, post: bool = False) -> DataFrame:
    """(fn, block, dom, depth): strict (post)dominators, the nearest at depth 1."""

    def kernel(e):
        idom = _idoms(e, entry, post)
        return ((n, a, i) for n in idom if n != K.EXIT for i, a in enumerate(K.ancestors(idom, n), 1) if a != K.EXIT)

    return per_function(edges, kernel, "block long, dom long, depth long")


def dominates(edges: DataFrame, pairs: DataFrame, entry: int = 0, post: bool = False) -> DataFrame:
    """(fn, a, b) pairs plus whether a (post)dominates b, reflexively."""
    d = dominators(edges, entry, post).select("fn", F.col("dom").alias("a"), F.col("block").alias("b"), F.lit(True).alias("strict"))
    return pairs.join(d, ["fn", "a", "b"], "left").withColumn("dominates", F.coalesce("strict", F.col("a") == F.col("b"))).drop("strict")


def control_dependences(edges: DataFrame, transitive: bool = False, compat: bool = False) -> DataFrame:
    """(fn, block, dep): dep's terminator decides whether block runs."""

    def kernel(e):
        pairs = K.control_dependences(e, _idoms(e, 0, True), compat)
        if not transitive:
            return pairs
        suc, _ = K.adjacency(pairs)
        return ((s, d) for s in suc for d in K.reachable(suc, s))

    return per_function(edges, kernel, "block long, dep long")


def instruction_edges(ins: DataFrame, edges: DataFrame, per_block: int = 4) -> DataFrame:
    """(src, dst) between instructions: each to the next of its block, a terminator to the first
    of each successor, exits to -1. Without a column b, blocks are ``per_block`` instructions."""
    from pyspark.sql import Window

    w = Window.partitionBy("fn", "b").orderBy("ord")
    i = (ins if "b" in ins.columns else ins.withColumn("b", F.floor(F.col("ord") / per_block))).withColumn("next", F.lead("iid").over(w)).withColumn("first", F.first("iid").over(w))
    inner = i.where("next IS NOT NULL").select(F.col("iid").alias("src"), F.col("next").alias("dst"))
    last = i.where("next IS NULL").select("fn", F.col("b").alias("src"), F.col("iid").alias("term"))
    head = i.where("iid = first").select("fn", F.col("b").alias("dst"), F.col("iid").alias("head"))
    jumps = edges.join(last, ["fn", "src"]).join(head, ["fn", "dst"], "left")
    return inner.union(jumps.select(F.col("term").alias("src"), F.coalesce("head", F.lit(-1)).alias("dst")))


def instruction_immediate_dominators(ins: DataFrame, idom: DataFrame, column: str = "idom", post: bool = False) -> DataFrame:
    """(fn, iid, idom): the instruction before (after) it in its block, or the last (first) one of
    the block's immediate (post)dominator. ``ins`` is (fn, b, ord, iid), ``idom`` (fn, block,
    idom). The first of the entry, and what stands alone in unreachable blocks, have no row."""
    from pyspark.sql import Window

    w = Window.partitionBy("fn", "b").orderBy(F.col("ord").desc() if post else F.col("ord"))
    i = ins.select("fn", "b", "ord", "iid").withColumn("prev", F.lag("iid").over(w))
    inner = i.where("prev IS NOT NULL").select("fn", "iid", F.col("prev").alias("idom"))
    head = i.where("prev IS NULL").select("fn", F.col("b").alias("block"), "iid")
    pick = F.min_by if post else F.max_by
    last = ins.groupBy("fn", "b").agg(pick("iid", "ord").alias("last"))
    up = idom.select("fn", "block", F.col(column).alias("b")).join(last, ["fn", "b"])
    live = idom.select("fn", "block").distinct()
    # Within blocks that cannot be reached nothing dominates anything; the entry's own are kept.
    reach = live.unionByName(idom.select("fn", F.col(column).alias("block"))).distinct()
    inner = inner.join(i.select("iid", F.col("b").alias("block")), "iid").join(reach, ["fn", "block"], "left_semi").select("fn", "iid", "idom")
    return inner.unionByName(head.join(up, ["fn", "block"]).select("fn", "iid", F.col("last").alias("idom")))


def instruction_dominators(ins: DataFrame, dom: DataFrame, reachable: DataFrame) -> DataFrame:
    """(fn, iid, dom): all instructions before one in its block, and all of its strictly dominating
    blocks (fn, block, dom). ``reachable`` is (fn, block)."""
    i = ins.select("fn", "b", "ord", "iid")
    j = i.select("fn", F.col("b").alias("b2"), F.col("ord").alias("ord2"), F.col("iid").alias("dom"))
    own = i.join(j.withColumnRenamed("b2", "b"), ["fn", "b"]).where("ord2 < ord").join(reachable.withColumnRenamed("block", "b"), ["fn", "b"], "left_semi").select("fn", "iid", "dom")
    above = i.join(dom.select("fn", F.col("block").alias("b"), F.col("dom").alias("b2")), ["fn", "b"]).join(j, ["fn", "b2"]).select("fn", "iid", "dom")
    return own.unionByName(above)


def dataflow(edges: DataFrame, ins: DataFrame, analysis: Callable[[], K.Dataflow], emit: Callable, columns: str, entry: int = 0) -> DataFrame:
    """Runs an analysis in every function. ``ins`` has (fn, b, ord, ...); an instruction is a
    dict of its other columns. ``emit(analysis, blocks, facts, suc)`` gives the result rows."""
    names = [c.split()[0] for c in columns.split(",")]

    def run(key, left, right):
        suc, pre = K.adjacency(zip(left["src"].tolist(), left["dst"].tolist(), strict=True))
        blocks: dict[int, list] = {}
        for r in right.sort_values("ord").to_dict("records"):
            blocks.setdefault(int(r["b"]), []).append(r)
        a = analysis()
        rows = list(emit(a, blocks, a.solve(blocks, suc, pre, entry), suc))
        out = pd.DataFrame(rows, columns=names) if rows else pd.DataFrame({n: [] for n in names})
        out.insert(0, "fn", key[0])
        return out

    return edges.groupBy("fn").cogroup(ins.groupBy("fn")).applyInPandas(run, f"fn long, {columns}")


def dataflow_in(edges: DataFrame, ins: DataFrame, environment: DataFrame, analysis: Callable[[K.Environment], K.Dataflow], emit: Callable, columns: str, told: str, entry: int = 0) -> tuple[DataFrame, DataFrame]:
    """An analysis in every function whose transfers read a relation and write rows of their own.

    ``environment`` (fn, ...) has what the transfers of each function may ask for: summaries of its
    callees, say. ``analysis(env)`` makes the analysis around a K.Environment; transfers call
    ``env.ask(column=value)`` for rows and ``env.tell(*row)`` to write one. Gives the facts that
    ``emit`` picks, (fn, *columns), and the rows written once facts have settled, (fn, *told)."""
    import pyarrow as pa
    from pyspark.sql import types as T

    from ..plans.fixpoint import cut

    names, said = ([c.split()[0] for c in x.split(",")] for x in (columns, told))
    kinds = T.StructType.fromDDL(f"{columns}, {told}") if not set(names) & set(said) else None
    if kinds is None:
        raise ValueError("columns of facts and of told rows need names of their own")
    out = f"fn long, {columns}, {told}, _told boolean"
    arrow = pa.schema([("fn", pa.int64())] + [(f.name, pa.string() if isinstance(f.dataType, T.StringType) else pa.bool_() if isinstance(f.dataType, T.BooleanType) else pa.int64()) for f in kinds.fields] + [("_told", pa.bool_())])
    flagged = edges.select("fn", F.col("src").alias("_src"), F.col("dst").alias("_dst")).unionByName(environment, allowMissingColumns=True)

    def run(key, left, right):
        rows = left.to_pylist()
        suc, pre = K.adjacency((r["_src"], r["_dst"]) for r in rows if r["_src"] is not None)
        env = K.Environment([r for r in rows if r["_src"] is None])
        blocks: dict[int, list] = {}
        for r in right.sort_by("ord").to_pylist():
            blocks.setdefault(r["b"], []).append(r)
        a = analysis(env)
        facts = a.solve(blocks, suc, pre, entry)
        fn = key[0].as_py()
        made = [{"fn": fn, **dict(zip(names, row, strict=True)), "_told": False} for row in emit(a, blocks, facts, suc)]
        made += [{"fn": fn, **dict(zip(said, row, strict=True)), "_told": True} for row in env.settled(lambda: a.replay(blocks, facts, suc))]
        return pa.Table.from_pylist(made, schema=arrow)

    both = cut(flagged.groupBy("fn").cogroup(ins.groupBy("fn")).applyInArrow(run, out))
    return both.where("NOT _told").select("fn", *names), both.where("_told").select("fn", *said)
