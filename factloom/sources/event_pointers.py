"""The event program once more, as a program of pointers: stack slots, shared globals, null, arguments,
calls with results, fields, null tests, returned values and phi nodes.

Every event that ends no block is one instruction: a view loads from a slot or a global, a click
stores null, the argument, a loaded pointer or a call's result, an error reads through a pointer, a
signup calls another function or one without a body, a purchase loads a field of the argument. What
ends a block is a test against null (click), a switch (error), a return (purchase) or a jump. Half of
the blocks that something leads to start with a phi node. Control flow is that of the event program.

``I`` and ``O`` are instructions and operands as texts that Spark SQL and the SQL of the checks share.
Ids are dealt by kind, each from its own base, and none is zero or negative.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import cut, drop
from .facts import EventProgram, Program
from .schema import TABLES

FN, ARG, GLOBAL, NULL, EXTERN = 10**9, 2 * 10**9, 3 * 10**9, 4 * 10**9, 5 * 10**9
SLOT, TEST, FIELD, PHI = 6 * 10**9, 7 * 10**9, 8 * 10**9, 9 * 10**9
GLOBALS, EXTERNS = 8, 3
ZERO = NULL + 10
#: Type ids: number, pointer to the structure, the structure, pointer to that pointer, a function.
INT, POINTER, STRUCT, DOUBLE, FUNCTION = range(1, 6)
TYPES = [
    (INT, "int", None, 32, None, None, "i32"), (POINTER, "pointer", STRUCT, None, None, None, "%struct.N*"), (STRUCT, "struct", None, None, "struct.N", [POINTER, POINTER], "%struct.N"),
    (DOUBLE, "pointer", POINTER, None, None, None, "%struct.N**"), (FUNCTION, "function", POINTER, None, None, [POINTER], "%struct.N* (%struct.N*)"),
]

_Q = "CAST(FLOOR(k / 4.0) AS BIGINT)"
_PLACE = f"CASE k % 4 WHEN 0 THEN {SLOT} + fn * 2 WHEN 1 THEN {SLOT} + fn * 2 + 1 ELSE {GLOBAL} + {_Q} % {GLOBALS} END"
_SEEN = f"COALESCE(seen + 1, {ARG} + fn)"

#: Events with what stands around them: x for the block's, p for blocks that have a phi.
EVENTS = {
    "xe": f"""SELECT i.fn, i.iid, i.op, i.k, i.ord, CAST(FLOOR(i.ord / 4.0) AS BIGINT) AS b, k.tid, k.term, f.mb, f.n, i.iid = k.tid AS ends,
  MAX(CASE WHEN i.op = 'view' AND i.iid <> k.tid THEN i.iid END) OVER (PARTITION BY i.fn, CAST(FLOOR(i.ord / 4.0) AS BIGINT) ORDER BY i.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen,
  MAX(CASE WHEN i.op = 'signup' AND i.iid <> k.tid THEN i.iid END) OVER (PARTITION BY i.fn, CAST(FLOOR(i.ord / 4.0) AS BIGINT) ORDER BY i.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS called
  FROM ins i JOIN blk k ON k.fn = i.fn AND k.b = CAST(FLOOR(i.ord / 4.0) AS BIGINT) JOIN (SELECT g.fn, g.mb, z.n FROM fns g CROSS JOIN (SELECT MAX(fn) + 1 AS n FROM fns) z) f ON f.fn = i.fn""",
    "xp": "SELECT DISTINCT k.fn, k.b, k.tid FROM blk k JOIN cfg c ON c.fn = k.fn AND c.dst = k.b WHERE k.b > 0 AND k.tid % 2 = 0",
    # One row a phi and block that leads to it.
    "xh": f"""SELECT p.fn, p.b, {PHI} + p.tid AS phi, c.src, CASE WHEN q.tid IS NOT NULL AND e.tid % 4 = 0 THEN {PHI} + q.tid WHEN e.iid % 3 = 0 THEN {NULL} WHEN e.iid % 3 = 1 THEN {ARG} + p.fn ELSE COALESCE(e.seen + 1, {ARG} + p.fn) END AS val
  FROM xp p JOIN cfg c ON c.fn = p.fn AND c.dst = p.b JOIN (SELECT * FROM xe WHERE ends) e ON e.fn = c.fn AND e.b = c.src LEFT JOIN xp q ON q.fn = c.fn AND q.b = c.src""",
}

#: (inst, fn, b, ord, op, ty, pred).
I = " UNION ALL ".join(
    f"SELECT {inst} AS inst, {FN} + fn AS fn, {b} AS b, {o} AS ord, {op} AS op, {ty} AS ty, {pred} AS pred FROM {src}"
    for inst, b, o, op, ty, pred, src in [
        (f"{SLOT} + fn * 2", "CAST(0 AS BIGINT)", "-2", "'alloca'", DOUBLE, "NULL", "fns"), (f"{SLOT} + fn * 2 + 1", "CAST(0 AS BIGINT)", "-1", "'alloca'", DOUBLE, "NULL", "fns"),
        ("iid + 1", "b", "ord * 4 + 2", "CASE op WHEN 'click' THEN 'store' WHEN 'signup' THEN 'call' ELSE 'load' END", f"CASE op WHEN 'click' THEN NULL WHEN 'error' THEN {INT} ELSE {POINTER} END", "NULL", "xe WHERE NOT ends"),
        (f"{FIELD} + iid", "b", "ord * 4 + 1", "'getelementptr'", DOUBLE, "NULL", "xe WHERE NOT ends AND op = 'purchase'"),
        ("iid + 1", "b", "ord * 4 + 2", "CASE WHEN term = 'purchase' THEN 'ret' WHEN b = mb THEN 'unreachable' WHEN term = 'error' THEN 'switch' ELSE 'br' END", "NULL", "NULL", "xe WHERE ends"),
        (f"{TEST} + iid", "b", "ord * 4 + 1", "'icmp'", INT, "CASE WHEN iid % 2 = 0 THEN 'eq' ELSE 'ne' END", "xe WHERE ends AND term = 'click' AND b < mb"),
        (f"{PHI} + tid", "b", "b * 16", "'phi'", POINTER, "NULL", "xp"),
    ]
)

#: (inst, role, pos, val, blk).
O = " UNION ALL ".join(
    f"SELECT {inst} AS inst, '{role}' AS role, {pos} AS pos, {val} AS val, {blk} AS blk FROM {src}"
    for inst, role, pos, val, blk, src in [
        ("iid + 1", "address", 0, _PLACE, "NULL", "xe WHERE NOT ends AND op IN ('view', 'click')"),
        ("iid + 1", "value", 0, f"CASE {_Q} % 4 WHEN 0 THEN {NULL} WHEN 1 THEN {ARG} + fn WHEN 2 THEN {_SEEN} ELSE COALESCE(called + 1, {NULL}) END", "NULL", "xe WHERE NOT ends AND op = 'click'"),
        ("iid + 1", "address", 0, f"CASE WHEN k % 2 = 0 THEN {ARG} + fn ELSE {_SEEN} END", "NULL", "xe WHERE NOT ends AND op = 'error'"),
        ("iid + 1", "callee", 0, f"CASE WHEN k % 4 = 3 THEN {EXTERN} + {_Q} % {EXTERNS} ELSE {FN} + (fn * 7 + iid) % n END", "NULL", "xe WHERE NOT ends AND op = 'signup'"),
        ("iid + 1", "arg", 0, f"CASE {_Q} % 3 WHEN 0 THEN {NULL} WHEN 1 THEN {ARG} + fn ELSE {_SEEN} END", "NULL", "xe WHERE NOT ends AND op = 'signup'"),
        ("iid + 1", "address", 0, f"{FIELD} + iid", "NULL", "xe WHERE NOT ends AND op = 'purchase'"),
        (f"{FIELD} + iid", "base", 0, f"{ARG} + fn", "NULL", "xe WHERE NOT ends AND op = 'purchase'"), (f"{FIELD} + iid", "index", 0, str(ZERO), "NULL", "xe WHERE NOT ends AND op = 'purchase'"),
        (f"{FIELD} + iid", "index", 1, f"{ZERO} + k % 2", "NULL", "xe WHERE NOT ends AND op = 'purchase'"),
        ("e.iid + 1", "retval", 0, f"CASE WHEN p.tid IS NOT NULL THEN {PHI} + p.tid WHEN e.k % 3 = 0 THEN {NULL} WHEN e.k % 3 = 1 THEN {ARG} + e.fn ELSE COALESCE(e.seen + 1, {ARG} + e.fn) END", "NULL",
         "xe e LEFT JOIN xp p ON p.fn = e.fn AND p.b = e.b WHERE e.ends AND e.term = 'purchase'"),
        ("iid + 1", "cond", 0, f"{TEST} + iid", "NULL", "xe WHERE ends AND term = 'click' AND b < mb"),
        (f"{TEST} + iid", "cmp1", 0, f"CASE WHEN k % 2 = 0 THEN {ARG} + fn ELSE {_SEEN} END", "NULL", "xe WHERE ends AND term = 'click' AND b < mb"), (f"{TEST} + iid", "cmp2", 0, str(NULL), "NULL", "xe WHERE ends AND term = 'click' AND b < mb"),
        ("iid + 1", "true_bb", 0, "NULL", "LEAST(b + 2 + iid % 3, mb)", "xe WHERE ends AND term = 'click' AND b < mb"), ("iid + 1", "false_bb", 0, "NULL", "b + 1", "xe WHERE ends AND term = 'click' AND b < mb"),
        ("iid + 1", "default_bb", 0, "NULL", "b + 1", "xe WHERE ends AND term = 'error' AND b < mb"), ("iid + 1", "case", 0, str(ZERO + 1), "GREATEST(b - 2, 0)", "xe WHERE ends AND term = 'error' AND b < mb"),
        ("iid + 1", "dest", 0, "NULL", "b + 1", "xe WHERE ends AND term IN ('view', 'signup') AND b < mb"),
        ("phi", "incoming", 0, "val", "src", "xh"),
    ]
)

#: The same as common table expressions, after those of the event program.
CTES = [*(f"{n} AS ({q})" for n, q in EVENTS.items()), f"xi AS ({I})", f"xo AS ({O})"]


def facts(p: EventProgram) -> Program:
    """The program, made once for all queries over the same log."""
    return p.once("pointers", lambda: make(p))


def make(p: EventProgram) -> Program:
    """The fact tables of the program of pointers."""
    spark = p.spark
    # Each text names the relations before it; those that others read several times are written.
    p = p.written()
    made: dict[str, DataFrame] = {"ins": p.ins, "blk": p.blk, "cfg": p.cfg}
    made["fns"] = made["blk"].groupBy("fn").agg(F.max("b").alias("mb"))

    def sql(text: str) -> DataFrame:
        used = [n for n in made if f" {n} " in f"{text} ".replace(")", " ")]
        for n in used:
            text = text.replace(f"FROM {n} ", f"FROM {{{n}}} ").replace(f"JOIN {n} ", f"JOIN {{{n}}} ")
            text = text.replace(f"FROM {n})", f"FROM {{{n}}})")
            if text.endswith(f"FROM {n}"):
                text = text[: -len(n)] + f"{{{n}}}"
        return spark.sql(text, **{n: made[n] for n in used if f"{{{n}}}" in text})

    for n, q in EVENTS.items():
        made[n] = cut(sql(q))

    def table(name: str, df: DataFrame) -> DataFrame:
        fields = spark.createDataFrame([], TABLES[name]).schema.fields
        return df.toDF(*[f.name for f in fields]).select(*[F.col(f.name).cast(f.dataType) for f in fields])

    fns = made["fns"]
    one = spark.range(1)
    tables = {
        "functions": cut(table("functions", fns.selectExpr("'events'", f"{FN} + fn", "concat('f', fn)", "false", str(FUNCTION)).union(spark.range(EXTERNS).selectExpr("'events'", f"{EXTERN} + id", "concat('e', id)", "true", str(FUNCTION))))),
        "arguments": cut(table("arguments", fns.selectExpr(f"{FN} + fn", "0", f"{ARG} + fn", "'x'", str(POINTER)))),
        # Even globals start as null, odd ones as the address of a function without a body.
        "globals": table("globals", spark.range(GLOBALS).selectExpr(f"{GLOBAL} + id", "concat('g', id)", "'global'", str(DOUBLE), f"CASE WHEN id % 2 = 0 THEN {NULL} ELSE {EXTERN} END")),
        "blocks": cut(table("blocks", made["blk"].selectExpr(f"{FN} + fn", "b", "b", "concat('b', b)"))),
        "instructions": cut(table("instructions", sql(I).selectExpr("inst", "fn", "b", "ord", "op", "ty", "CAST(NULL AS STRING)", "pred"))),
        "operands": cut(table("operands", sql(O))),
        "values": spark.createDataFrame([(NULL, "constant", POINTER, None)], TABLES["values"]),
        "constants": table("constants", one.selectExpr(str(NULL), "'null'", "NULL", "NULL", "NULL").union(spark.range(2).selectExpr(f"{ZERO} + id", "'int'", "id", "NULL", "NULL"))),
        "types": spark.createDataFrame(TYPES, TABLES["types"]),
    }
    p.release()
    drop(*[made[n] for n in EVENTS])
    return Program(spark, tables)
