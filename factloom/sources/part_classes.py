"""The table of parts as a C++ program: every part is a class under a third of its number.

A class has typeinfo that names its parent's, a vtable of three functions, a constructor, and the
three functions that it may override; every seventh has a function that calls one of its slots
through the table, by a call or an invoke, and the constructor directly. All names are mangled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalogue import shared
from ..plans.fixpoint import cut
from .facts import Program
from .schema import TABLES

SLOTS = 3
#: Ids by kind: functions and instructions have sixteen of a class, the rest their own.
FN, INST, ARG, INFO, TABLE, STRUCT, POINTER, CONST = (i * 10**9 for i in range(1, 9))
#: Classes written "struct" or "class", some with the number that a second definition gets.
STRUCT_NAME = "concat(CASE WHEN p % 2 = 0 THEN 'class.C' ELSE 'struct.C' END, CAST(p AS STRING), CASE WHEN p % 5 = 0 THEN '.17' ELSE '' END)"
MANGLED = "concat(CAST(length(CAST(p AS STRING)) + 1 AS STRING), 'C', CAST(p AS STRING))"
OWN = f"p % (s + 2) <> 0 OR p < {SLOTS}"


def facts(spark: SparkSession, sf_dir: str) -> Program:
    """The program, made once for all queries over the same table."""
    return shared(spark, "classes", f"{sf_dir}/part.parquet", lambda: make(spark, sf_dir), Program.drop)


def make(spark: SparkSession, sf_dir: str) -> Program:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("p")).distinct()
    above = parts.select(F.col("p").alias("parent"))
    c = cut(parts.join(above, (F.floor(F.col("p") / 3) == F.col("parent")) & (F.col("p") != F.col("parent")), "left"))
    slot = c.withColumn("s", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SLOTS)])))
    # A slot that a class does not override holds its parent's function, as far as there is one.
    calls = c.where("p % 7 = 0").withColumn("s", F.col("p") % SLOTS)

    def table(name: str, *frames: DataFrame) -> DataFrame:
        fields = spark.createDataFrame([], TABLES[name]).schema.fields
        out = None
        for df in frames:
            df = df.toDF(*[f.name for f in fields]).select(*[F.col(f.name).cast(f.dataType) for f in fields])
            out = df if out is None else out.unionByName(df)
        return out

    entry = f"CASE WHEN {OWN} THEN {FN} + p * 16 + s WHEN parent IS NOT NULL THEN {FN} + parent * 16 + s ELSE {FN} + p * 16 + s END"
    inst = lambda n: f"{INST} + p * 16 + {n}"
    # load of the object's table, by a cast; the slot's address unless it is the first; the function; the call.
    ins = [(0, "bitcast", "true"), (1, "load", "true"), (2, "getelementptr", "s > 0"), (3, "load", "true"), (4, "CASE WHEN p % 2 = 0 THEN 'call' ELSE 'invoke' END", "true"), (5, "call", "true"), (6, "ret", "true")]
    ops = [
        (0, "casted", 0, f"{ARG} + p * 2", "true"), (1, "address", 0, inst(0), "true"), (2, "base", 0, inst(1), "s > 0"), (2, "index", 0, f"{CONST} + s", "s > 0"), (3, "address", 0, f"CASE WHEN s > 0 THEN {inst(2)} ELSE {inst(1)} END", "true"),
        (4, "callee", 0, inst(3), "true"), (4, "arg", 0, f"{ARG} + p * 2", "true"), (5, "callee", 0, f"{FN} + p * 16 + 8", "true"), (5, "arg", 0, f"{ARG} + p * 2", "true"),
    ]
    up = c.where("parent IS NOT NULL")
    return Program(
        spark,
        {
            "functions": table(
                "functions", c.selectExpr("'parts'", f"{FN} + p * 16 + 8", f"concat('_ZN', {MANGLED}, 'C2Ev')", "false", "0"), c.where("p % 3 = 0").selectExpr("'parts'", f"{FN} + p * 16 + 9", f"concat('_ZN', {MANGLED}, 'C1Ev')", "false", "0"),
                slot.selectExpr("'parts'", f"{FN} + p * 16 + s", f"concat('_ZN', {MANGLED}, '2m', CAST(s AS STRING), 'Ev')", "false", "0"), calls.selectExpr("'parts'", f"{FN} + p * 16 + 10", "concat('use', p)", "false", "0"),
            ),
            "arguments": table("arguments", c.selectExpr(f"{FN} + p * 16 + 8", "0", f"{ARG} + p * 2 + 1", "'this'", f"{POINTER} + p"), calls.selectExpr(f"{FN} + p * 16 + 10", "0", f"{ARG} + p * 2", "'x'", f"{POINTER} + p")),
            "globals": table("globals", c.selectExpr(f"{INFO} + p", f"concat('_ZTI', {MANGLED})", "'global'", "0", f"{CONST} + 1000 + p * 32"), c.selectExpr(f"{TABLE} + p", f"concat('_ZTV', {MANGLED})", "'global'", "0", f"{CONST} + 1000 + p * 32 + 1")),
            "constants": table(
                "constants", spark.range(SLOTS).selectExpr(f"{CONST} + id", "'int'", "id", "NULL", "NULL"),
                c.selectExpr(f"{CONST} + 1000 + p * 32", "'struct'", "NULL", f"CASE WHEN parent IS NULL THEN array({CONST}) ELSE array({CONST}, {CONST} + 1000 + p * 32 + 2) END", "NULL"),
                up.selectExpr(f"{CONST} + 1000 + p * 32 + 2", "'expr'", "NULL", "NULL", f"{INST} + p * 16 + 12"),
                slot.withColumn("e", F.expr(entry)).groupBy("p").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("l")).selectExpr(f"{CONST} + 1000 + p * 32 + 1", "'array'", "NULL", f"concat(array({CONST}, {INFO} + p), transform(l, x -> x.e))", "NULL"),
            ),
            "operands": cut(table("operands", up.selectExpr(f"{INST} + p * 16 + 12", "'casted'", "0", f"{INFO} + parent", "NULL"), *[calls.where(w).selectExpr(inst(n), f"'{role}'", str(pos), v, "NULL") for n, role, pos, v, w in ops])),
            "instructions": cut(table("instructions", *[calls.where(w).selectExpr(inst(n), f"{FN} + p * 16 + 10", "0", str(n), op if op.startswith("CASE") else f"'{op}'", "0", "NULL", "NULL") for n, op, w in ins])),
            "types": table("types", c.selectExpr(f"{STRUCT} + p", "'struct'", "NULL", "NULL", STRUCT_NAME, "NULL", STRUCT_NAME), c.selectExpr(f"{POINTER} + p", "'pointer'", f"{STRUCT} + p", "NULL", "NULL", "NULL", f"concat('%', {STRUCT_NAME}, '*')")),
            "blocks": table("blocks", calls.selectExpr(f"{FN} + p * 16 + 10", "0", "0", "'entry'")),
            "values": spark.createDataFrame([], TABLES["values"]),
        },
    )
