"""The event program as instruction facts, so that queries over facts run on any event log.

A block of four events has three instructions and a terminator; what they are follows from the
numbers of its events. By k0 % 4: 0 loads a global, adds or subtracts and stores; 1 loads, compares
with null and changes memory atomically; 2 loads a structure pointer and stores to an address in
it; 3 loads a function pointer, calls, and stores a pointer. Shorter blocks have a terminator only.

Ids are dealt by kind: instructions as the log has them, then functions, arguments, globals (eight
a function) and constants, each from its own base.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.fixpoint import cut, drop
from .facts import EventProgram, Program
from .schema import TABLES

FN, ARG, GLOBAL, CONST = 10**9, 2 * 10**9, 3 * 10**9, 4 * 10**9
NULL = CONST
#: Type ids: number, pointer to it, two structures, an array, pointers to the first structure, a function.
INT, INT_P, STRUCT, INNER, ARRAY, STRUCT_P, STRUCT_PP, FUNCTION = range(1, 9)
TYPES = [
    (INT, "int", None, 32, None, None, "i32"), (INT_P, "pointer", INT, None, None, None, "i32*"), (STRUCT, "struct", None, None, "struct.S", [INT, INNER, INT, ARRAY], "%struct.S"),
    (INNER, "struct", None, None, "struct.In", [INT, INT_P, INT], "%struct.In"), (ARRAY, "array", INT, 10, None, None, "[10 x i32]"), (STRUCT_P, "pointer", STRUCT, None, None, None, "%struct.S*"),
    (STRUCT_PP, "pointer", STRUCT_P, None, None, None, "%struct.S**"), (FUNCTION, "function", INT, None, None, [STRUCT_PP], "i32 (%struct.S**)"),
]


def number(e: str) -> str:
    """The id of a constant between -9 and 89."""
    return f"({CONST + 10} + {e})"


def slot(e: str) -> str:
    """The id of a global of the function."""
    return f"({GLOBAL} + fn * 8 + ({e}) % 8)"


#: Whole blocks, in a text that Spark SQL and the SQL of the checks share.
QUAD = """SELECT z.fn, z.b, z.i0, z.i1, z.i2, z.i3, z.k0, z.k1, z.k2, z.k0 % 4 AS t, n.n FROM (
  SELECT fn, CAST(FLOOR(ord / 4.0) AS BIGINT) AS b, max(CASE WHEN ord % 4 = 0 THEN iid END) AS i0, max(CASE WHEN ord % 4 = 1 THEN iid END) AS i1, max(CASE WHEN ord % 4 = 2 THEN iid END) AS i2,
  max(CASE WHEN ord % 4 = 3 THEN iid END) AS i3, max(CASE WHEN ord % 4 = 0 THEN k END) AS k0, max(CASE WHEN ord % 4 = 1 THEN k END) AS k1, max(CASE WHEN ord % 4 = 2 THEN k END) AS k2
  FROM ins GROUP BY fn, CAST(FLOOR(ord / 4.0) AS BIGINT) HAVING count(*) = 4) z CROSS JOIN (SELECT max(fn) + 1 AS n FROM fns) n"""

#: What is added in a block of kind 0, and which global it goes to.
ADDED = "CASE k1 % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE -1 END"
STORED_TO = f"CASE WHEN k2 % 4 = 0 THEN {slot('k0 + 1')} ELSE {slot('k0')} END"
#: Kind 3: whom a direct call calls, and what is stored where.
CALLED, POINTED = f"({FN} + (fn * 7 + i1) % n)", f"CASE WHEN k2 % 3 = 0 THEN i0 WHEN k2 % 3 = 1 THEN {FN} + (fn + k2) % n ELSE {slot('k2')} END"

# (instruction, opcode, type, predicate, condition) of whole blocks.
_BODY = [
    ("i0", "'load'", str(STRUCT_P), "NULL", "true"),
    ("i1", "CASE WHEN k1 % 2 = 0 THEN 'add' ELSE 'sub' END", str(INT), "NULL", "t = 0"),
    ("i2", "'store'", "NULL", "NULL", "t <> 1"),
    ("i1", "'icmp'", str(INT), "CASE k1 % 3 WHEN 0 THEN 'eq' WHEN 1 THEN 'ne' ELSE 'slt' END", "t = 1"),
    ("i2", "'atomicrmw'", str(INT), "CASE WHEN k2 % 2 = 0 THEN 'add' ELSE 'sub' END", "t = 1"),
    ("i1", "'getelementptr'", str(INT_P), "NULL", "t = 2"),
    ("i1", "'call'", str(INT), "NULL", "t = 3"),
]
# (instruction, role, position, value, condition).
_OPERANDS = [
    ("i0", "address", 0, slot("k0"), "true"),
    ("i1", "lhs", 0, f"CASE WHEN k1 % 3 = 0 THEN {number(ADDED)} ELSE i0 END", "t = 0"), ("i1", "rhs", 0, f"CASE WHEN k1 % 3 = 0 THEN i0 ELSE {number(ADDED)} END", "t = 0"),
    ("i2", "value", 0, "i1", "t = 0"), ("i2", "address", 0, STORED_TO, "t = 0"),
    ("i1", "cmp1", 0, f"CASE WHEN k1 % 2 = 0 THEN {NULL} ELSE i0 END", "t = 1"), ("i1", "cmp2", 0, f"CASE WHEN k1 % 2 = 0 THEN i0 WHEN k1 % 5 = 0 THEN {number('1')} ELSE {NULL} END", "t = 1"),
    ("i2", "pointer", 0, slot("k2"), "t = 1"), ("i2", "value", 0, f"CASE WHEN k2 % 3 = 0 THEN {number('1')} ELSE {number('2')} END", "t = 1"),
    ("i1", "base", 0, "i0", "t = 2"), ("i1", "index", 0, f"CASE WHEN k1 % 3 = 0 THEN {number('1')} ELSE {number('0')} END", "t = 2"),
    ("i1", "index", 1, f"CASE WHEN k1 % 4 = 0 THEN {number('k2 % 4')} ELSE {number('1')} END", "t = 2 AND k1 % 4 < 3"), ("i1", "index", 2, number("k2 % 3"), "t = 2 AND k1 % 4 IN (1, 2)"),
    ("i2", "value", 0, slot("k2"), "t = 2"), ("i2", "address", 0, "i1", "t = 2"),
    ("i1", "callee", 0, f"CASE WHEN k1 % 2 = 0 THEN {CALLED} ELSE i0 END", "t = 3"), ("i1", "arg", 0, slot("k1"), "t = 3"),
    ("i2", "value", 0, POINTED, "t = 3"), ("i2", "address", 0, slot("k0 + k2"), "t = 3"),
]


def facts(p: EventProgram) -> Program:
    """The program, made once for all queries over the same log."""
    return p.once("instructions", lambda: make(p))


def make(p: EventProgram) -> Program:
    """The fact tables, each a few selections over the log's blocks."""
    spark: SparkSession = p.spark
    # Every table selects from these two several times: they are made once.
    p = p.written()
    blocks = cut(p.blk.withColumn("mb", F.max("b").over(_by_fn())))
    quad = cut(spark.sql(QUAD.replace("FROM ins", "FROM {ins}").replace("FROM fns", "FROM {fns}"), ins=p.ins, fns=p.blk.select("fn")))
    rows: dict[str, list[DataFrame]] = {t: [] for t in TABLES}

    def add(table: str, source: DataFrame, exprs: list[str], where: str = "true") -> None:
        rows[table].append(source.where(where).select(*[F.expr(e) for e in exprs]))

    fns = blocks.select("fn").distinct()
    add("functions", fns, ["'events'", f"{FN} + fn", "concat('f', fn)", "false", str(FUNCTION)])
    add("arguments", fns, [f"{FN} + fn", "0", f"{ARG} + fn", "'x'", str(STRUCT_PP)])
    add("globals", fns.withColumn("s", F.explode(F.array(*map(F.lit, range(8))))), [f"{GLOBAL} + fn * 8 + s", "concat('g', fn, '_', s)", "'global'", str(STRUCT_PP), "NULL"])
    add("blocks", blocks, [f"{FN} + fn", "b", "b", "concat('b', b)"])
    rows["types"].append(spark.createDataFrame(TYPES, TABLES["types"]))
    consts = [(NULL, "null", None, None, None)] + [(CONST + 10 + v, "int", v, None, None) for v in range(-1, 10)]
    rows["constants"].append(spark.createDataFrame(consts, TABLES["constants"]))
    for inst, opcode, type_, pred, where in _BODY:
        add("instructions", quad, [inst, f"{FN} + fn", "b", f"b * 4 + {inst[1]}", opcode, type_, "NULL", pred], where)
    for inst, role, pos, value, where in _OPERANDS:
        add("operands", quad, [inst, f"'{role}'", str(pos), value, "NULL"], where)
    # Terminators.
    end = "CASE WHEN term = 'purchase' THEN 'ret' WHEN b = mb THEN 'unreachable' WHEN term = 'error' THEN 'switch' ELSE 'br' END"
    add("instructions", blocks, ["tid", f"{FN} + fn", "b", "b * 4 + 3", end, "NULL", "NULL", "NULL"])
    goes = "b < mb AND term"
    for role, to, where in [("true_bb", "least(b + 2 + tid % 3, mb)", "= 'click'"), ("false_bb", "b + 1", "= 'click'"), ("default_bb", "b + 1", "= 'error'"), ("dest", "b + 1", "NOT IN ('click', 'error', 'purchase')")]:
        add("operands", blocks, ["tid", f"'{role}'", "0", "NULL", to], f"{goes} {where}")
    add("operands", blocks, ["tid", "'case'", "0", number("3"), "greatest(b - 2, 0L)"], f"{goes} = 'error'")
    tests = quad.where("t = 1").join(blocks.where("term = 'click' AND b < mb").select("fn", "b"), ["fn", "b"])
    add("operands", tests, ["i3", "'cond'", "0", "i1", "NULL"])

    def whole(t: str) -> DataFrame:
        cols = [F.col(f"_{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(spark.createDataFrame([], TABLES[t]).schema.fields)]
        parts = [x.toDF(*[f"_{i}" for i in range(len(x.columns))]).select(*cols) for x in rows[t]]
        out = parts[0] if parts else spark.createDataFrame([], TABLES[t])
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    tables = {t: cut(whole(t)) for t in TABLES if t not in ("values", "types", "constants")}
    p.release()
    drop(blocks, quad)
    return Program(spark, tables | {t: whole(t) for t in ("values", "types", "constants")})


def _by_fn():
    from pyspark.sql import Window

    return Window.partitionBy("fn")
