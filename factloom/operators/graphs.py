"""The graphs of a program as text: each is (fn, line), to be written function by function."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dot
from ..sources.facts import Program
from . import ir
from .artefacts import Artefacts
from .callgraph import targets_asked
from .icfg import program_icfg


# Texts are a query's last statement, which broadcasts by the session's limit: relations with a row a block or more are merged instead.


def _nodes(program: Program) -> DataFrame:
    """(fn, b, ord, node, label, name) of instructions in blocks."""
    names = program.blocks.select("fn_id", "block_id", F.col("name").alias("name")).hint("merge")
    ins = program.instructions.drop("name").where("block_id IS NOT NULL").join(names, ["fn_id", "block_id"])
    return ins.select(F.col("fn_id").alias("fn"), F.col("block_id").alias("b"), "ord", F.col("inst_id").alias("node"), F.col("opcode").alias("label"), "name")


def _clusters(nodes: DataFrame) -> DataFrame:
    return dot.block_clusters(nodes).select("fn", F.concat(F.lit("  "), "body").alias("line"))


def flow_text(source: Artefacts | Program) -> DataFrame:
    """The flow of each function: instructions in their blocks' clusters; edges out of a terminator go
    to the first instruction of the block, with a label and a colour by their kind. Edges that
    leave the function are left out."""
    a = Artefacts.of(source)
    nodes = _nodes(a.program)
    ends = nodes.groupBy("fn", "b").agg(F.min_by("node", "ord").alias("head"), F.max_by("node", "ord").alias("last"))
    out = ends.select("fn", F.col("b").alias("src"), F.col("last").alias("_s"))
    into = ends.select("fn", F.col("b").alias("dst"), F.col("head").alias("_d"))
    jumps = ir.flow_edges(a.program).join(out.hint("merge"), ["fn", "src"]).join(into.hint("merge"), ["fn", "dst"])
    value = a.program.constants.where("ckind = 'int'").select(F.col("value_id").alias("case_value"), F.col("int_value").alias("_v"))
    jumps = jumps.join(value, "case_value", "left").select("fn", F.col("_s").alias("src"), F.col("_d").alias("dst"), "kind", F.col("_v").alias("case_value")).distinct()
    within = a["steps"].where("dst <> -1").join(nodes.select(F.col("node").alias("src"), "fn", "b").hint("merge"), "src").join(nodes.select(F.col("node").alias("dst"), F.col("fn").alias("_f"), F.col("b").alias("_b")).hint("merge"), "dst")
    last = ends.select(F.col("last").alias("src"))
    within = within.join(last.hint("merge"), "src", "left_anti").select("fn", "src", "dst", F.lit("other").alias("kind"), F.lit(None).cast("long").alias("case_value"))
    return dot.styled_lines(jumps.unionByName(within), dot.FLOW_STYLES, "fn").unionByName(dot.node_lines(nodes, "fn")).unionByName(_clusters(nodes))


def dominator_text(source: Artefacts | Program, post: bool = False) -> DataFrame:
    """The tree of immediate (post)dominators of instructions, each with an edge to its own."""
    a = Artefacts.of(source)
    edges = a["ipdom_inst" if post else "idom_inst"].select("fn", F.col("iid").alias("src"), F.col("idom").alias("dst"))
    return dot.edge_lines(edges, "fn").unionByName(dot.node_lines(_nodes(a.program), "fn"))


def control_text(source: Artefacts | Program) -> DataFrame:
    """Control dependence: every instruction has an edge to the terminator of each block that decides
    whether it runs."""
    a = Artefacts.of(source)
    nodes = _nodes(a.program)
    last = nodes.groupBy("fn", F.col("b").alias("dep")).agg(F.max_by("node", "ord").alias("dst"))
    decided = a["control"].hint("merge").join(last.hint("merge"), ["fn", "dep"])
    edges = nodes.select("fn", F.col("b").alias("block"), F.col("node").alias("src")).join(decided.hint("merge"), ["fn", "block"]).select("fn", "src", "dst")
    return dot.edge_lines(edges, "fn").unionByName(dot.node_lines(nodes, "fn")).unionByName(_clusters(nodes))


def icfg_text(source: Artefacts | Program, entries: DataFrame) -> DataFrame:
    """(line): the interprocedural graph, functions as clusters of their blocks' clusters; a call's return
    node, its number below zero, stands beside it. Functions without a body stand by themselves."""
    a = Artefacts.of(source)
    nodes = _nodes(a.program)
    points_to = targets_asked(a.program, lambda: a["points_to"])
    edges = dot.styled_lines(program_icfg(a.program, points_to, entries), dot.ICFG_STYLES)
    calls = a.program.instructions.where("opcode IN ('call', 'invoke')").select(F.col("inst_id").alias("node"))
    returns = nodes.join(calls.hint("merge"), "node", "left_semi").select("fn", "b", (F.col("ord") + 0.5).alias("ord"), (-F.col("node")).alias("node"), F.lit("return").alias("label"), "name")
    every = nodes.withColumn("ord", F.col("ord").cast("double")).unionByName(returns)
    names = a.program.functions.select(F.col("fn_id").alias("fn"), "name")
    outside = a.program.functions.where("is_external").select(F.col("fn_id").alias("node"), F.concat(F.lit("external "), "name").alias("label"))
    return edges.unionByName(dot.node_lines(every)).unionByName(dot.node_lines(outside)).unionByName(dot.function_clusters(dot.block_clusters(every), names).select("line"))
