"""Edits of programs as relations: what goes, what comes, and what stands for what. An edit is applied all at
once by anti-joins and unions; nothing is changed in place, and the program before it stays as it was.

Edits that contradict each other, or that no program could have, are not applied; they come back as rows
of (inst_id, error) or (fn_id, error).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import DidNotSettle, cut, drop
from ..sources.facts import Program
from ..sources.schema import TABLES
from .ir import terminators

#: Kinds of conflicts.
ABSENT, TWICE, TERMINATOR, AFTER_TERMINATOR, TAKEN, CIRCULAR, USED = "NoSuchInstruction", "AlreadyReplaced", "RemovedTerminator", "AfterTerminator", "IdTaken", "CircularReplacement", "StillUsed"
BEFORE, AFTER, INSTEAD = "before", "after", "instead"


def _with(program: Program, **tables: DataFrame) -> Program:
    return Program(program.spark, {t: tables.get(t, program._tables.get(t)) for t in TABLES if t in tables or t in program._tables})


def _final(pairs: DataFrame, most_rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """((old, new) where new is replaced by nothing, (old) of circles), by doubling."""
    at = cut(pairs.select("old", "new", F.lit(True).alias("open")))
    n = at.count()
    for _ in range(min(most_rounds, n.bit_length() + 1)):
        ahead = at.select(F.col("old").alias("new"), F.col("new").alias("then"))
        before, at = at, cut(at.join(ahead, "new", "left").select("old", F.coalesce("then", "new").alias("new"), F.col("then").isNotNull().alias("open")))
        drop(before)
        if at.where("open").isEmpty():
            return at.select("old", "new"), at.select("old").limit(0)
    inner = at.select(F.col("old").alias("new"))
    if n.bit_length() + 1 > most_rounds:
        raise DidNotSettle(f"{most_rounds} rounds")
    return at.join(inner, "new", "left_anti").select("old", "new"), at.join(inner, "new", "left_semi").select("old")


def rewrite(program: Program, removals: DataFrame | None = None, insertions: DataFrame | None = None, operands: DataFrame | None = None) -> tuple[Program, DataFrame]:
    """(the edited program, (inst_id, error) of what was not applied).

    ``removals`` (inst_id, value_id): the instruction goes and value_id stands for it wherever it was used.
    ``insertions`` (inst_id, target, place, opcode, type_id, pred): a new instruction before, after or instead
    of a target; instead, it stands for the target. ``operands`` (inst_id, role, pos, value_id, block_id) are those of the new ones.
    What stands for a value may be replaced itself; uses go to the last.

    Not applied: edits of an instruction that is not there; all edits of one that is removed or replaced by one
    and also removed, replaced or built upon by another; removals of a terminator, and insertions after
    one; insertions whose id is taken, by the program or by each other; removals that stand for
    each other in a circle. Places in edited blocks are numbered anew."""
    spark = program.spark
    removals = removals if removals is not None else spark.createDataFrame([], "inst_id long, value_id long")
    insertions = insertions if insertions is not None else spark.createDataFrame([], "inst_id long, target long, place string, opcode string, type_id long, pred string")
    operands = operands if operands is not None else spark.createDataFrame([], TABLES["operands"])
    edits = cut(
        removals.select(F.col("inst_id").alias("target"), F.lit("remove").alias("place"), F.lit(None).cast("long").alias("new"), "value_id").unionByName(
            insertions.select("target", "place", F.col("inst_id").alias("new"), F.when(F.col("place") == INSTEAD, F.col("inst_id")).alias("value_id"))
        )
    )
    here = program.instructions.select(F.col("inst_id").alias("target"), F.lit(True).alias("here"))
    last = terminators(program).select(F.col("inst_id").alias("target"), F.lit(True).alias("last"))
    taken = program.instructions.select(F.col("inst_id").alias("new"), F.lit(True).alias("taken"))
    per_target = edits.groupBy("target").agg(F.count("*").alias("n"), F.sum(F.col("place").isin("remove", INSTEAD).cast("int")).alias("gone"))
    per_new = edits.where("new IS NOT NULL").groupBy("new").agg(F.count("*").alias("same"))
    seen = edits.join(here, "target", "left").join(last, "target", "left").join(per_target, "target").join(taken, "new", "left").join(per_new, "new", "left")
    error = (
        F.when(F.col("here").isNull(), ABSENT).when((F.col("gone") > 0) & (F.col("n") > 1), TWICE).when((F.col("place") == "remove") & F.col("last"), TERMINATOR).when((F.col("place") == AFTER) & F.col("last"), AFTER_TERMINATOR)
        .when(F.col("taken") | (F.col("same") > 1), TAKEN)
    )
    judged = cut(seen.select("target", "place", "new", "value_id", error.alias("error")))
    ok = judged.where("error IS NULL").drop("error")
    stands, circles = _final(ok.where("value_id IS NOT NULL").select(F.col("target").alias("old"), F.col("value_id").alias("new")))
    ok = cut(ok.join(circles.withColumnRenamed("old", "target"), "target", "left_anti"))
    conflicts = judged.where("error IS NOT NULL").select(F.col("target").alias("inst_id"), "error").unionByName(circles.select(F.col("old").alias("inst_id"), F.lit(CIRCULAR).alias("error")))

    gone = ok.where(F.col("place").isin("remove", INSTEAD)).select(F.col("target").alias("inst_id"))
    at = program.instructions.select(F.col("inst_id").alias("target"), "fn_id", "block_id", "ord")
    step = F.when(F.col("place") == BEFORE, -1).when(F.col("place") == AFTER, 1).otherwise(0)
    come = insertions.join(ok.select(F.col("new").alias("inst_id"), "target", "place"), ["inst_id", "target", "place"], "left_semi").join(at, "target")
    come = come.select("inst_id", "fn_id", "block_id", F.col("ord").alias("ord"), step.alias("_s"), "opcode", "type_id", F.lit(None).cast("string").alias("name"), "pred")
    stay = program.instructions.join(gone, "inst_id", "left_anti").withColumn("_s", F.lit(0)).select(*come.columns)
    touched = ok.join(at, "target").select("fn_id", "block_id").distinct()
    every = stay.unionByName(come)
    moved = every.join(touched, ["fn_id", "block_id"], "left_semi")
    place = F.row_number().over(Window.partitionBy("fn_id", "block_id").orderBy("ord", "_s", "inst_id")) - 1
    columns = [c.split()[0] for c in TABLES["instructions"].split(", ")]
    instructions = cut(every.join(touched, ["fn_id", "block_id"], "left_anti").drop("_s").select(*columns).unionByName(moved.withColumn("ord", place).select(*columns)))
    mine = program.operands.join(gone, "inst_id", "left_anti").unionByName(operands.join(ok.select(F.col("new").alias("inst_id")), "inst_id", "left_semi").select(*program.operands.columns))
    renamed = mine.join(stands.select(F.col("old").alias("value_id"), F.col("new").alias("_new")), "value_id", "left").withColumn("value_id", F.coalesce("_new", "value_id"))
    return _with(program, instructions=instructions, operands=cut(renamed.select(*program.operands.columns))), conflicts


def copy_functions(program: Program, copies: DataFrame) -> tuple[Program, DataFrame]:
    """(the program with copies, (fn_id, error)). ``copies`` (fn_id, copy_id, shift, name): the copy's own values,
    its parameters and instructions, are the function's plus shift; whatever else it uses, itself
    when it calls itself among them, stays. Copies of functions that are not there, or whose ids
    the program has already, are not made."""
    fns = program.functions.select("fn_id", F.lit(True).alias("here"))
    ids = program.functions.select(F.col("fn_id").alias("id")).union(program.instructions.select("inst_id")).union(program.arguments.select("value_id")).union(program.globals.select("value_id")).distinct()
    local = program.instructions.select("fn_id", F.col("inst_id").alias("id")).union(program.arguments.select("fn_id", "value_id"))
    new = local.join(copies.select("fn_id", "copy_id", "shift"), "fn_id").select("copy_id", (F.col("id") + F.col("shift")).alias("id")).union(copies.select("copy_id", "copy_id"))
    clash = new.groupBy("id").agg(F.count("*").alias("n"), F.collect_set("copy_id").alias("of")).join(ids.withColumn("old", F.lit(True)), "id", "left").where("n > 1 OR old").select(F.explode("of").alias("copy_id")).distinct()
    judged = cut(copies.join(fns, "fn_id", "left").join(clash.withColumn("clash", F.lit(True)), "copy_id", "left").select("fn_id", "copy_id", "shift", "name", F.when(F.col("here").isNull(), ABSENT).when(F.col("clash"), TAKEN).alias("error")))
    ok = judged.where("error IS NULL").select("fn_id", "copy_id", "shift", F.col("name").alias("copy_name"))

    def shifted(table: DataFrame, *columns: str) -> DataFrame:
        out = table.join(ok, "fn_id")
        for c in columns:
            out = out.withColumn(c, F.col(c) + F.col("shift"))
        return out.withColumn("fn_id", F.col("copy_id")).select(*table.columns)

    functions = program.functions.join(ok, "fn_id").withColumn("fn_id", F.col("copy_id")).withColumn("name", F.col("copy_name")).select(*program.functions.columns)
    ops = program.operands.join(program.instructions.select("inst_id", "fn_id"), "inst_id").join(ok, "fn_id")
    own = local.select("fn_id", F.col("id").alias("value_id"), F.lit(True).alias("own"))
    ops = ops.join(own, ["fn_id", "value_id"], "left").withColumn("value_id", F.when(F.col("own"), F.col("value_id") + F.col("shift")).otherwise(F.col("value_id"))).withColumn("inst_id", F.col("inst_id") + F.col("shift"))
    more = {"functions": functions, "arguments": shifted(program.arguments, "value_id"), "blocks": shifted(program.blocks), "instructions": shifted(program.instructions, "inst_id"), "operands": ops.select(*program.operands.columns)}
    made = _with(program, **{t: cut(program._tables[t].unionByName(df)) for t, df in more.items()})
    return made, judged.where("error IS NOT NULL").select("fn_id", "error")


def remove_functions(program: Program, gone: DataFrame) -> tuple[Program, DataFrame]:
    """(the program without functions, (fn_id, error)). ``gone`` (fn_id); functions that are not there, and
    those that what stays still uses, in code or as an initial value, are reported; the latter stay, and
    so does whatever they use in turn."""
    asked = gone.select("fn_id").distinct()
    absent = asked.join(program.functions, "fn_id", "left_anti")
    uses = program.operands.join(program.instructions.select("inst_id", F.col("fn_id").alias("by")), "inst_id").select("by", F.col("value_id").alias("fn_id")).join(asked, "fn_id", "left_semi").where("by <> fn_id").distinct()
    held = program.globals.select(F.col("init_value_id").alias("fn_id")).union(program.constants.select(F.explode("elements"))).join(asked, "fn_id", "left_semi").distinct()
    uses = cut(uses)
    stays = cut(held.union(uses.join(asked.select(F.col("fn_id").alias("by")), "by", "left_anti").select("fn_id")).distinct())
    while True:
        more = uses.join(stays.select(F.col("fn_id").alias("by")), "by", "left_semi").select("fn_id").join(stays, "fn_id", "left_anti").distinct()
        more = cut(more)
        if more.isEmpty():
            break
        stays = cut(stays.union(more))
    out = cut(asked.join(stays, "fn_id", "left_anti"))
    dead = program.instructions.join(out, "fn_id", "left_semi").select("inst_id")
    kept = {t: cut(program._tables[t].join(out, "fn_id", "left_anti").select(*program._tables[t].columns)) for t in ("functions", "arguments", "blocks", "instructions")}
    kept["operands"] = cut(program.operands.join(dead, "inst_id", "left_anti"))
    errors = [absent.select("fn_id", F.lit(ABSENT).alias("error")), stays.select("fn_id", F.lit(USED).alias("error"))]
    return _with(program, **kept), reduce(DataFrame.unionByName, errors)
