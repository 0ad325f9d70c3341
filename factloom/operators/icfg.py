"""Interprocedural control flow: the functions' graphs joined by calls and returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.facts import Program
from . import flow, ir
from .callgraph import call_targets


def icfg(intra: DataFrame, calls: DataFrame, entries: DataFrame, exits: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """(src, dst, kind). ``intra`` is (src, dst) between instructions, ``calls`` (site, fn),
    ``entries`` (fn, node), ``exits`` (fn, node), all of them: every return is wired. ``sites``
    (site) names the calls where some have no callee.

    A call's local successors hang off its return node, the negated call."""
    sites = (calls if sites is None else sites).select("site").distinct()
    plain = intra.join(sites.withColumnRenamed("site", "src"), "src", "left_anti").select("src", "dst", F.lit("intra").alias("kind"))
    after = intra.join(sites.withColumnRenamed("site", "src"), "src", "left_semi").select((-F.col("src")).alias("src"), "dst", F.lit("intra").alias("kind"))
    enter = calls.join(entries, "fn").select(F.col("site").alias("src"), F.col("node").alias("dst"), F.lit("call_to_entry").alias("kind"))
    leave = calls.join(exits, "fn").select(F.col("node").alias("src"), (-F.col("site")).alias("dst"), F.lit("return_to_call").alias("kind"))
    past = sites.select(F.col("site").alias("src"), (-F.col("site")).alias("dst"), F.lit("call_to_return").alias("kind"))
    return plain.unionByName(after).unionByName(enter).unionByName(leave).unionByName(past)


def outside(program: Program, entry_points: DataFrame) -> DataFrame:
    """(node): the node of functions nobody knows, numbered past all instructions and functions;
    no row where the program is closed: one entry point (fn), and nothing that loads libraries."""
    entered = entry_points.agg(F.count_distinct("fn").alias("n"))
    named = program.functions.agg(F.max("fn_id").alias("f"), F.max(F.col("is_external") & (F.col("name") == "dlopen")).alias("loads"))
    last = program.instructions.agg(F.max("inst_id").alias("i"))
    one = entered.join(F.broadcast(named)).join(F.broadcast(last))  # a row each
    return one.where("n <> 1 OR loads").select((F.greatest("f", "i") + 1).alias("node"))


def program_icfg(program: Program, points_to: DataFrame, entry_points: DataFrame) -> DataFrame:
    """(src, dst, kind) of a program's instructions. An external function is one node, its id,
    entered and left by its calls. In an open program (see ``outside``) calls that name no
    function also go through the unknown node. A call without callees only goes to its return
    node; a function without a return is entered and not left."""
    ins = program.instructions.where("block_id IS NOT NULL").select(F.col("inst_id").alias("iid"), F.col("fn_id").alias("fn"), F.col("block_id").alias("b"), "ord")
    local = flow.instruction_edges(ins, ir.flow_edges(program).select("fn", "src", "dst").distinct()).where("dst <> -1").distinct()
    defined = program.functions.where("NOT is_external").select(F.col("fn_id").alias("fn")).distinct()
    extern = ir.function_nodes(program).join(defined, "fn", "left_anti").select("fn", F.col("fn").alias("node"))
    beyond = outside(program, entry_points).select(F.col("node").alias("fn"), "node")
    targets = call_targets(program, points_to).select(F.col("inst_id").alias("site"), F.col("dst").alias("fn"), "kind")
    known = targets.where("kind <> 'unknown'").select("site", "fn").distinct()
    unknown = targets.where("kind = 'unknown'").select("site").join(F.broadcast(beyond.select("fn")))  # a row at most
    alone = extern.unionByName(beyond)
    entries = ir.first_instructions(program, "true").withColumnRenamed("inst_id", "node").join(defined, "fn", "left_semi")
    exits = program.instructions.where("opcode = 'ret'").select(F.col("fn_id").alias("fn"), F.col("inst_id").alias("node"))
    return icfg(local, known.unionByName(unknown), entries.unionByName(alone), exits.unionByName(alone), targets.select("site"))
