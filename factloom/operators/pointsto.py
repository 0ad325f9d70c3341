"""Points-to analyses: by exact type, and inclusion constraints solved as recursive queries."""

from __future__ import annotations

from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import cut, drop, fixpoint
from ..sources.facts import Program
from .ir import address_indices


class PointsTo(Protocol):
    """What call graphs need of a points-to analysis."""

    def points_to(self) -> DataFrame:
        """(value_id, target)"""

    def may_alias(self, pairs: DataFrame) -> DataFrame:
        """(a, b) plus may_alias"""


#: Parts that the functions of a type are dealt into.
LOTS = 64


class TypePointsTo:
    """A pointer may hold every function of exactly its pointee type; a function holds itself, an
    alias what it stands for, and a cast what it casts. ``values`` is (value_id, type_id,
    pointee_type_id), ``functions`` (fn_id, type_id), ``same`` (value_id, root_id) of aliases and
    casts, as callgraph.canonical has them."""

    def __init__(self, values: DataFrame, functions: DataFrame, same: DataFrame | None = None):
        self.values, self.functions, self.same = values, functions, same

    @classmethod
    def of(cls, program: Program) -> TypePointsTo:
        from .callgraph import canonical
        from .ir import value_types

        points = program.types.where("kind = 'pointer'").select("type_id", F.col("elem_type_id").alias("pointee_type_id"))
        return cls(value_types(program).join(points, "type_id").select("value_id", "type_id", "pointee_type_id"), program.functions.select("fn_id", "type_id"), canonical(program))

    def by_type(self) -> DataFrame:
        """(value_id, target): functions of the pointee type alone. The pairs are as many as values times
        functions of a type, and types are few: functions are dealt into lots that meet every value of
        their type, so a type's pairs are not one task's. Values and functions have one type, so each
        pair comes once, and pairs are not shuffled."""
        f = self.functions.select(F.col("fn_id").alias("target"), F.col("type_id").alias("pointee_type_id")).distinct().withColumn("lot", F.pmod(F.xxhash64("target"), F.lit(LOTS)))
        v = self.values.where("pointee_type_id IS NOT NULL").select("value_id", "pointee_type_id").distinct()
        v = v.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(LOTS - 1)))).withColumn("lot", F.col("lot").cast("long"))
        # Values, of which there is a copy a lot, are not for a broadcast.
        return v.join(f.hint("shuffle_hash"), ["pointee_type_id", "lot"]).select("value_id", "target")

    def points_to(self) -> DataFrame:
        f = self.functions.select(F.col("fn_id").alias("target"), F.col("type_id").alias("pointee_type_id"))
        own = self.functions.select(F.col("fn_id").alias("value_id"), F.col("fn_id").alias("target"))
        values = self.values if self.same is None else self.values.join(self.same.select("value_id"), "value_id", "left_anti")
        out = values.where("pointee_type_id IS NOT NULL").join(f, "pointee_type_id").select("value_id", "target").unionByName(own)
        if self.same is not None:
            out = out.unionByName(self.same.join(out.withColumnRenamed("value_id", "root_id"), "root_id").select("value_id", "target"))
        return out.distinct()

    def may_alias(self, pairs: DataFrame) -> DataFrame:
        t = self.values.select("value_id", "type_id")
        a = pairs.join(t.select(F.col("value_id").alias("a"), F.col("type_id").alias("ta")), "a")
        return a.join(t.select(F.col("value_id").alias("b"), F.col("type_id").alias("tb")), "b").select("a", "b", (F.col("ta") == F.col("tb")).alias("may_alias"))


#: A location's cell is this far from the location.
CELL = 1 << 60


def andersen(addr: DataFrame, copy: DataFrame, load: DataFrame, store: DataFrame, actuals: DataFrame | None = None, formals: DataFrame | None = None) -> DataFrame:
    """(x, l): the locations a node may hold.

    addr(x, l): x holds l. copy(x, y): x holds what y holds. load(x, y): x holds what the cells
    of y's locations hold. store(x, y): the cells of x's locations hold what y holds.
    actuals(c, pos, y) and formals(f, pos, x), if given: where c may hold f, x holds what y
    holds. Every rule with two recursive parts takes the new rows on either side. The constraints
    are written first, as every round reads them."""
    given = [cut(df) for df in (copy, load, store)]
    copy, load, store = given
    if actuals is not None:
        actuals, formals = cut(actuals), cut(formals)

    def rules(p: DataFrame, q: DataFrame) -> DataFrame:
        """Rules with the location from p and the held value from q."""
        at, held = p.select(F.col("x").alias("m"), F.col("l").alias("cell")), q.select(F.col("x").alias("h"), F.col("l").alias("v"))
        ld = load.join(at, F.col("y") == F.col("m")).join(held, F.col("h") == F.col("cell") + CELL).select("x", F.col("v").alias("l"))
        st = store.join(at, F.col("x") == F.col("m")).join(held, F.col("y") == F.col("h")).select((F.col("cell") + CELL).alias("x"), F.col("v").alias("l"))
        out = ld.unionByName(st)
        if actuals is None:
            return out
        bound = actuals.join(at, F.col("c") == F.col("m")).join(formals, (F.col("cell") == F.col("f")) & (actuals["pos"] == formals["pos"]))
        return out.unionByName(bound.join(held, F.col("y") == F.col("h")).select("x", F.col("v").alias("l")))

    def step(delta: DataFrame, known: DataFrame) -> DataFrame:
        moved = copy.join(delta.select(F.col("x").alias("y"), "l"), "y").select("x", "l")
        return moved.unionByName(rules(delta, known)).unionByName(rules(known, delta))

    out = fixpoint(addr.select("x", "l"), step)
    drop(*given, *([] if actuals is None else [actuals, formals]))
    return out


#: Field locations are negative: one for each type and field.
FIELDS = 4096


def field_locations(program: Program) -> tuple[DataFrame, DataFrame]:
    """((inst_id, type_id, field) of address instructions that name a field, (inst_id, single) of
    those that stay within an array, and whether by one index). A single index, and indices into a pointer to an array that start with
    zero, are array accesses; of all others the innermost type and its index are the field,
    whatever comes before it. A last index that is not constant names nothing."""
    index = address_indices(program)
    first = index.where("pos = 1").select("inst_id", F.col("kind").alias("outer")).join(index.where("pos = 0").select("inst_id", F.col("value").alias("v0")), "inst_id")
    flat = first.where("outer = 'array' AND v0 = 0").select("inst_id")
    inner = index.where("pos = last AND last > 0 AND value IS NOT NULL").select("inst_id", F.col("in_type").alias("type_id"), F.col("value").alias("field"))
    two = flat.join(index.where("last = 1").select("inst_id").distinct(), "inst_id", "left_semi")
    array = index.where("last = 0").select("inst_id", F.lit(True).alias("single")).union(two.withColumn("single", F.lit(False)))
    return inner.join(flat, "inst_id", "left_anti"), array.distinct()


def _check(program: Program, fields: DataFrame) -> None:
    """Ids share a long with their kind; ids that would not fit are refused, never confused."""
    most = reduce(lambda a, b: a.union(b), [program.globals.select("value_id"), program.functions.select("fn_id"), program.instructions.select("inst_id"), program.arguments.select("value_id")]).toDF("i").agg(F.max("i"), F.min("i")).first()
    f = fields.agg(F.max("type_id"), F.min("type_id"), F.max("field"), F.min("field")).first()
    if (most[0] or 0) >= CELL // 2 or (most[1] or 0) < 0 or (f[0] or 0) >= CELL // 2 // FIELDS or (f[1] or 0) < 0 or (f[2] or 0) >= FIELDS - 1 or (f[3] or 0) < 0:
        raise ValueError(f"value ids must be below {CELL // 2}, type ids below {CELL // 2 // FIELDS}, field numbers below {FIELDS - 1}, and none negative")


def constraints(program: Program, ignore: DataFrame | None = None) -> dict[str, DataFrame]:
    """addr, copy, load, store, actuals and formals of a program; what touches a value of
    ``ignore`` (value_id) makes none.

    A value's node is its id. Globals, functions and stack slots are locations and their own
    addresses. An array element stands for its array; a structure field is one location for
    its type and index, whatever the object. Calls of other modules' functions bind nothing."""
    ops, ins = program.operands.select("inst_id", "role", "pos", "value_id"), program.instructions.select("inst_id", "opcode", "fn_id", "type_id")

    def role(opcode: str, name: str) -> DataFrame:
        return ins.where(F.col("opcode").isin(*opcode.split())).select("inst_id").join(ops.where(F.col("role") == name).select("inst_id", "pos", "value_id"), "inst_id")

    def two(opcode: str, a: str, b: str) -> DataFrame:
        return role(opcode, a).select("inst_id", F.col("value_id").alias("x")).join(role(opcode, b).select("inst_id", F.col("value_id").alias("y")), "inst_id").select("x", "y")

    places = program.globals.where("kind <> 'alias'").select("value_id").union(program.functions.select("fn_id")).union(ins.where("opcode = 'alloca'").select("inst_id")).toDF("x")
    named, arrays = field_locations(program)
    named, arrays = cut(named), cut(arrays)
    _check(program, named)
    fields = named.select(F.col("inst_id").alias("x"), (-(F.col("type_id") * FIELDS + F.col("field") + 1)).alias("l"))
    addr = places.select("x", F.col("x").alias("l")).union(fields)

    same = lambda df: df.select(F.col("inst_id").alias("x"), F.col("value_id").alias("y"))
    # A pointer that is indexed like an array stands for its elements: what is stored through
    # p[i] is held by the variable that p was loaded from.
    loaded = role("load", "address").select(F.col("inst_id").alias("value_id"), F.col("value_id").alias("from"))
    array_gep = role("getelementptr", "base").join(arrays, "inst_id").join(loaded, "value_id", "left").select("inst_id", F.when(F.col("single"), F.coalesce("from", "value_id")).otherwise(F.col("value_id")).alias("value_id"))
    inits = program.globals.where("kind = 'global' AND init_value_id IS NOT NULL").select((F.col("value_id") + CELL).alias("x"), F.col("init_value_id").alias("y"))
    copy = same(role("phi select", "incoming")).union(same(role("bitcast", "casted"))).union(same(array_gep)).union(inits)
    calls = role("call invoke", "callee").select("inst_id", F.col("value_id").alias("c"))
    actuals = calls.join(ops.where("role = 'arg'").select("inst_id", "pos", F.col("value_id").alias("y")), "inst_id").select("c", "pos", "y")
    formals = program.arguments.select(F.col("fn_id").alias("f"), "pos", F.col("value_id").alias("x"))
    # Only direct calls bind what they return, and only those that give a pointer (or an unknown type).
    flat = program.types.where("kind <> 'pointer'").select("type_id")
    pointers = ins.join(flat, "type_id", "left_anti").select("inst_id")
    returned = ins.where("opcode = 'ret'").join(ops.where("role = 'retval'").select("inst_id", F.col("value_id").alias("y")), "inst_id").select(F.col("fn_id").alias("c"), "y")
    copy = copy.union(calls.join(returned, "c").join(pointers, "inst_id", "left_semi").select(F.col("inst_id").alias("x"), "y"))
    made = {"addr": addr.distinct(), "copy": copy.distinct(), "load": same(role("load", "address")).distinct(), "store": two("store", "address", "value").distinct(), "actuals": actuals.distinct(), "formals": formals}
    if ignore is not None:
        for name, ends in {"copy": "xy", "load": "xy", "store": "xy", "actuals": "y"}.items():
            for c in ends:
                made[name] = made[name].join(ignore.select(F.col("value_id").alias("_i")), F.col(c) == F.col("_i"), "left_anti")
    return made


class Andersen:
    """Inclusion-based points-to of a program."""

    def __init__(self, program: Program, ignore: DataFrame | None = None):
        self.program, self.ignore = program, ignore

    def solve(self) -> DataFrame:
        return andersen(**constraints(self.program, self.ignore))

    def points_to(self) -> DataFrame:
        return self.solve().select(F.col("x").alias("value_id"), F.col("l").alias("target"))

    def held(self, solved: DataFrame) -> DataFrame:
        """(value_id, target): what the cells of locations, and what arguments, hold."""
        cells = solved.where(F.col("x") >= CELL // 2).select((F.col("x") - CELL).alias("value_id"), F.col("l").alias("target"))
        args = self.program.arguments.select("value_id").join(solved.select(F.col("x").alias("value_id"), F.col("l").alias("target")), "value_id")
        return cells.union(args).distinct()

    def may_alias(self, pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("may_alias", F.lit(True))
