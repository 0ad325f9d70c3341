"""From instruction facts to the relations that analyses work on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import demangled, strip_type_prefix
from ..plans.fixpoint import closure, cut, fixpoint
from ..sources.facts import Program
from ..sources.schema import EXIT

#: Opcodes that leave a function, and edge labels by operand role.
LEAVING = ("ret", "resume", "unreachable")
LABELS = {"true_bb": "true", "false_bb": "false", "case": "equality", "default_bb": "other", "target": "indirect", "normal_bb": "other", "unwind_bb": "unwind", "dest": "other"}


def terminators(program: Program) -> DataFrame:
    """(inst_id, fn, block): the last instruction of each block."""
    last = program.instructions.where("block_id IS NOT NULL").groupBy("fn_id", "block_id").agg(F.max_by("inst_id", "ord").alias("inst_id"))
    return last.select("inst_id", F.col("fn_id").alias("fn"), F.col("block_id").alias("block"))


def flow_edges(program: Program) -> DataFrame:
    """(fn, src, dst, kind, case_value): block edges by terminator; ones that leave go to -1."""
    t = terminators(program).join(program.instructions.select("inst_id", "opcode"), "inst_id")
    label = F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), F.col("role"))
    to = program.operands.where("block_id IS NOT NULL").select("inst_id", F.col("block_id").alias("dst"), label.alias("kind"), F.when(F.col("role") == "case", F.col("value_id")).alias("case_value"))
    inner = t.join(to.where("kind IS NOT NULL"), "inst_id").select("fn", F.col("block").alias("src"), "dst", "kind", "case_value")
    out = t.where(F.col("opcode").isin(*LEAVING)).select("fn", F.col("block").alias("src"), F.lit(EXIT).cast("long").alias("dst"), F.lit("other").alias("kind"), F.lit(None).cast("long").alias("case_value"))
    return inner.unionByName(out)


def branch_null_tests(program: Program) -> DataFrame:
    """(fn, b, value, null_block, other_block): conditional branches that compare a value with
    null by eq or ne; branches on anything else have no row."""
    ops = program.operands
    pick = lambda role, name, col="value_id": ops.where(F.col("role") == role).select("inst_id", F.col(col).alias(name))
    br = program.instructions.where("opcode = 'br'").select("inst_id", "fn_id", "block_id")
    br = br.join(pick("cond", "cmp"), "inst_id").join(pick("true_bb", "t", "block_id"), "inst_id").join(pick("false_bb", "f", "block_id"), "inst_id")
    cmp = program.instructions.where("opcode = 'icmp' AND pred IN ('eq', 'ne')").select("inst_id", "pred").join(pick("cmp1", "v1"), "inst_id").join(pick("cmp2", "v2"), "inst_id")
    null = program.constants.where("ckind = 'null'").select("value_id")
    n1, n2 = null.withColumnRenamed("value_id", "n1"), null.withColumnRenamed("value_id", "n2")
    cmp = cmp.join(n1, F.col("v1") == F.col("n1"), "left").join(n2, F.col("v2") == F.col("n2"), "left").where("n1 IS NOT NULL OR n2 IS NOT NULL")
    cmp = cmp.select(F.col("inst_id").alias("cmp"), "pred", F.when(F.col("n1").isNotNull(), F.col("v2")).otherwise(F.col("v1")).alias("value"))
    eq = F.col("pred") == "eq"
    return br.join(cmp, "cmp").select(F.col("fn_id").alias("fn"), F.col("block_id").alias("b"), "value", F.when(eq, F.col("t")).otherwise(F.col("f")).alias("null_block"), F.when(eq, F.col("f")).otherwise(F.col("t")).alias("other_block"))


def increments(program: Program) -> DataFrame:
    """(inst_id, address, effect): instructions that add 1 to, or take 1 from, what an address
    holds: atomic add or sub of 1, and stores of load + 1, 1 + load, load - -1 (and the mirror
    forms for -1) to the address that was loaded. -1 as the left operand of a sub is none."""
    ops = program.operands
    pick = lambda role, name: ops.where(F.col("role") == role).select("inst_id", F.col("value_id").alias(name))
    num = program.constants.where("ckind = 'int' AND int_value IN (1, -1)").select("value_id", F.col("int_value").alias("k"))
    ins = program.instructions.select("inst_id", "opcode", "pred")
    rmw = ins.where("opcode = 'atomicrmw' AND pred IN ('add', 'sub')").join(pick("pointer", "address"), "inst_id").join(pick("value", "value_id"), "inst_id").join(num, "value_id").where("k = 1")
    atomic = rmw.select("inst_id", "address", F.when(F.col("pred") == "add", 1).otherwise(-1).cast("long").alias("effect"))
    arith = ins.where("opcode IN ('add', 'sub')").join(pick("lhs", "l"), "inst_id").join(pick("rhs", "r"), "inst_id")
    right = arith.join(num.withColumnRenamed("value_id", "r"), "r").select("inst_id", F.col("l").alias("other"), F.when(F.col("opcode") == "add", F.col("k")).otherwise(-F.col("k")).alias("effect"))
    left = arith.where("opcode = 'add'").join(num.withColumnRenamed("value_id", "l"), "l").select("inst_id", F.col("r").alias("other"), F.col("k").alias("effect"))
    loads = ins.where("opcode = 'load'").join(pick("address", "address"), "inst_id").select(F.col("inst_id").alias("other"), "address")
    sums = right.unionByName(left).join(loads, "other").select(F.col("inst_id").alias("value"), F.col("address").alias("from"), "effect")
    stores = ins.where("opcode = 'store'").join(pick("address", "address"), "inst_id").join(pick("value", "value"), "inst_id")
    plain = stores.join(sums, "value").where("address = from").select("inst_id", "address", F.col("effect").cast("long").alias("effect"))
    return atomic.unionByName(plain).distinct()


def value_types(program: Program) -> DataFrame:
    """(value_id, type_id) of everything that can be an operand."""
    parts = [
        program.values.select("value_id", "type_id"),
        program.globals.select("value_id", "type_id"),
        program.arguments.select("value_id", "type_id"),
        program.functions.select(F.col("fn_id").alias("value_id"), "type_id"),
        program.instructions.select(F.col("inst_id").alias("value_id"), "type_id"),
    ]
    return reduce(DataFrame.unionByName, parts).where("type_id IS NOT NULL").distinct()


def address_indices(program: Program) -> DataFrame:
    """(inst_id, pos, in_type, kind, value, last): what each index of an address instruction
    indexes: the base's pointer type at position 0, then the type that the walk has come to.
    ``value`` is the index where it is constant. The walk takes a join for each position."""
    geps = program.instructions.where("opcode = 'getelementptr'").select("inst_id")
    const = program.constants.where("ckind = 'int'").select("value_id", F.col("int_value").alias("value"))
    index = cut(program.operands.where("role = 'index'").select("inst_id", "pos", "value_id").join(geps, "inst_id", "left_semi").join(const, "value_id", "left").select("inst_id", "pos", "value"))
    last = index.groupBy("inst_id").agg(F.max("pos").alias("last"))
    deepest = index.agg(F.max("pos")).first()[0]
    types = program.types.select(F.col("type_id").alias("in_type"), "kind", "elem_type_id", "fields")
    base = program.operands.where("role = 'base'").select("inst_id", "value_id").join(value_types(program), "value_id")
    at, out = base.select("inst_id", F.col("type_id").alias("in_type")), []
    for pos in range((deepest if deepest is not None else -1) + 1):
        here = cut(at.join(index.where(F.col("pos") == pos), "inst_id").join(types, "in_type"))
        out.append(here.select("inst_id", "pos", "in_type", "kind", "value"))
        inner = F.when(F.col("kind") == "struct", F.get("fields", F.col("value").cast("int"))).otherwise(F.col("elem_type_id"))
        at = here.select("inst_id", inner.alias("in_type"))
    if not out:
        return index.limit(0).select("inst_id", "pos", F.lit(0).cast("long").alias("in_type"), F.lit("").alias("kind"), "value", F.lit(0).alias("last"))
    return reduce(DataFrame.unionByName, out).join(last, "inst_id")


def path_steps(program: Program) -> DataFrame:
    """(fn, iid, base, comp) for ``analyses.access_paths``: what each address instruction adds.
    A one-index address is an Array step; others fold their indices in source order: a first
    index that is not zero and every sequential type add Array, a structure adds its Field. A cast
    from a union's pointer adds Union, any other nothing."""
    ops = program.operands
    ins = program.instructions.select("inst_id", "fn_id", "opcode")
    pick = lambda role: ops.where(F.col("role") == role).select("inst_id", F.col("value_id").alias("base"))
    load = ins.where("opcode = 'load'").join(pick("address"), "inst_id").withColumn("comp", F.lit("Deref"))
    unions = program.types.where("startswith(struct_name, 'union.')").select(F.col("type_id").alias("elem_type_id"))
    to_union = program.types.where("kind = 'pointer'").join(unions, "elem_type_id", "left_semi").select("type_id")
    of_union = value_types(program).join(to_union, "type_id", "left_semi").select(F.col("value_id").alias("base"), F.lit("Union").alias("comp"))
    cast = ins.where("opcode = 'bitcast'").join(pick("casted"), "inst_id").join(of_union, "base", "left")
    word = F.when(F.col("pos") == 0, F.when((F.col("last") == 0) | (F.coalesce("value", F.lit(-1)) != 0), "Array").otherwise("")).when(F.col("kind") == "struct", F.concat(F.lit("Field"), F.col("value").cast("string"))).otherwise("Array")
    each = F.struct("pos", word.alias("c"))
    folded = address_indices(program).groupBy("inst_id").agg(F.sort_array(F.collect_list(each)).alias("l")).select("inst_id", F.array_join(F.filter(F.transform("l", lambda x: x["c"]), lambda x: x != ""), ".").alias("comp"))
    gep = ins.where("opcode = 'getelementptr'").join(pick("base"), "inst_id").join(folded, "inst_id").withColumn("comp", F.when(F.col("comp") != "", F.col("comp")))
    cols = [F.col("fn_id").alias("fn"), F.col("inst_id").alias("iid"), "base", "comp"]
    return load.select(*cols).unionByName(cast.select(*cols)).unionByName(gep.select(*cols))


def memory_steps(program: Program) -> DataFrame:
    """(fn, iid, value) of memory instructions: the value whose path is the instruction's access
    path. Loads, stores, compare-and-exchange and read-modify-write describe what they touch, an
    address instruction what it computes, a cast what it casts where that is one of these. Other
    instructions have no path and no row."""
    ops, ins = program.operands, program.instructions.select("inst_id", "fn_id", "opcode")
    role = F.when(F.col("opcode").isin("load", "store"), "address").when(F.col("opcode").isin("cmpxchg", "atomicrmw"), "pointer")
    touch = ins.withColumn("role", role).join(ops.select("inst_id", "role", "value_id"), ["inst_id", "role"]).select("inst_id", "fn_id", "value_id")
    gep = ins.where("opcode = 'getelementptr'").select("inst_id", "fn_id", F.col("inst_id").alias("value_id"))
    own = touch.unionByName(gep)
    # A cast is seen through as far as it casts casts.
    hops = ins.where("opcode = 'bitcast'").join(ops.where("role = 'casted'").select("inst_id", "value_id"), "inst_id").select(F.col("inst_id").alias("src"), F.col("value_id").alias("dst"))
    seen = closure(hops).join(own.select(F.col("inst_id").alias("dst"), "value_id"), "dst").join(ins.select(F.col("inst_id").alias("src"), "fn_id"), "src").select(F.col("src").alias("inst_id"), "fn_id", "value_id")
    return own.unionByName(seen).select(F.col("fn_id").alias("fn"), F.col("inst_id").alias("iid"), F.col("value_id").alias("value"))


def memory_paths(program: Program) -> DataFrame:
    """(fn, iid, root, path, n) of every memory instruction."""
    from .analyses import access_paths

    steps, asked = path_steps(program), memory_steps(program)
    # Roots are asked for as values that take no step.
    roots = asked.select("fn", F.col("value").alias("iid")).distinct().join(steps.select("fn", "iid"), ["fn", "iid"], "left_anti").select("fn", "iid", F.lit(None).cast("long").alias("base"), F.lit(None).cast("string").alias("comp"))
    paths = access_paths(steps.unionByName(roots)).withColumnRenamed("iid", "value")
    return asked.join(paths, ["fn", "value"]).select("fn", "iid", "root", "path", "n")


def _special(program: Program, letters: str) -> DataFrame:
    """Globals whose names start like a kind of special name, dealt to as many tasks as the session shuffles into:
    taking names apart is work that the size of a table does not show."""
    n = int(program.spark.conf.get("spark.sql.shuffle.partitions"))
    return program.globals.where(F.col("name").rlike(f"^@*_Z{letters}")).repartition(n, "value_id")


def class_parents(program: Program) -> DataFrame:
    """(parent, child) names: typeinfo globals that another typeinfo's initializer names."""
    # Read as parent and as child; names are taken apart once.
    info = cut(_special(program, "TI").select("value_id", "init_value_id", demangled("name").alias("d")).where("d.kind = 'typeinfo'").select("value_id", "init_value_id", F.col("d.name").alias("name")))
    parts = program.constants.select(F.col("value_id").alias("init_value_id"), F.explode("elements").alias("e"))
    casts = program.operands.where("role = 'casted'").select(F.col("inst_id").alias("expr_inst_id"), F.col("value_id").alias("to"))
    through = program.constants.where("expr_inst_id IS NOT NULL").select(F.col("value_id").alias("e"), "expr_inst_id").join(casts, "expr_inst_id").select("e", "to")
    seen = info.join(parts, "init_value_id").join(through, "e", "left").select(F.col("name").alias("child"), F.coalesce("to", "e").alias("value_id"))
    return seen.join(info.select("value_id", F.col("name").alias("parent")), "value_id").select("parent", "child").distinct()


def vtables(program: Program) -> DataFrame:
    """(class, slot, fn): the first contiguous run of functions in a vtable's initializer."""
    tab = _special(program, "TV").select("init_value_id", demangled("name").alias("d")).where("d.kind = 'vtable' AND init_value_id IS NOT NULL").select("init_value_id", F.col("d.name").alias("class"))
    items = program.constants.select(F.col("value_id").alias("init_value_id"), F.posexplode("elements").alias("pos", "e"))
    casts = program.operands.where("role = 'casted'").select(F.col("inst_id").alias("expr_inst_id"), F.col("value_id").alias("to"))
    through = program.constants.where("expr_inst_id IS NOT NULL").select(F.col("value_id").alias("e"), "expr_inst_id").join(casts, "expr_inst_id").select("e", "to")
    fns = program.functions.select(F.col("fn_id").alias("fn"))
    rows = tab.join(items, "init_value_id").join(through, "e", "left").withColumn("v", F.coalesce("to", "e")).join(fns, F.col("v") == F.col("fn"), "left")
    w = Window.partitionBy("class").orderBy("pos")
    run = rows.withColumn("first", F.min(F.when(F.col("fn").isNotNull(), F.col("pos"))).over(Window.partitionBy("class"))).where("pos >= first")
    run = run.withColumn("gap", F.sum(F.when(F.col("fn").isNull(), 1).otherwise(0)).over(w)).where("gap = 0")
    return run.select("class", (F.col("pos") - F.col("first")).cast("long").alias("slot"), "fn")


def vtable_slots(program: Program, pointer_bits: int = 64) -> DataFrame:
    """(inst_id, this, slot): calls through a vtable whose table comes from the first argument.

    Four shapes of the address that the function pointer is loaded from: gep(load(bitcast this),
    k); load(bitcast this), slot 0; load(gep this 0 0), slot 0; and a byte offset
    bitcast(gep(bitcast(load(gep this 0 0)), off))."""
    ops = program.operands
    ins = program.instructions.select("inst_id", "opcode")
    const = program.constants.select("value_id", "int_value")

    def via(opcode: str, role: str, out: str, inn: str) -> DataFrame:
        return ins.where(F.col("opcode") == opcode).join(ops.where(F.col("role") == role), "inst_id").select(F.col("inst_id").alias(out), F.col("value_id").alias(inn))

    index = ops.where("role = 'index'").join(const, "value_id").groupBy("inst_id").agg(F.sort_array(F.collect_list(F.struct("pos", "int_value"))).alias("l"))
    gep = via("getelementptr", "base", "g", "gb").join(index.select(F.col("inst_id").alias("g"), F.transform("l", lambda x: x["int_value"]).alias("ix")), "g")
    zero = gep.where("ix = array(0L, 0L)")
    site = via("call", "callee", "inst_id", "fp").unionByName(via("invoke", "callee", "inst_id", "fp")).join(ops.where("role = 'arg' AND pos = 0").select("inst_id", F.col("value_id").alias("this")), "inst_id")
    site = site.join(via("load", "address", "fp", "la"), "fp")
    load, cast = via("load", "address", "lo", "lb"), via("bitcast", "casted", "bc", "bt")
    from_cast = load.join(cast, F.col("lb") == F.col("bc")).select(F.col("lo").alias("table"), F.col("bt").alias("obj"))
    from_gep = load.join(zero, F.col("lb") == F.col("g")).select(F.col("lo").alias("table"), F.col("gb").alias("obj"))
    one = gep.where("size(ix) = 1").select("g", "gb", F.col("ix")[0].alias("k"))
    s1 = site.join(one, F.col("la") == F.col("g")).join(from_cast, F.col("gb") == F.col("table")).where("obj = this").select("inst_id", "this", F.col("k").alias("slot"))
    s2 = site.join(from_cast, F.col("la") == F.col("table")).where("obj = this").select("inst_id", "this", F.lit(0).cast("long").alias("slot"))
    s3 = site.join(from_gep, F.col("la") == F.col("table")).where("obj = this").select("inst_id", "this", F.lit(0).cast("long").alias("slot"))
    inner = cast.select(F.col("bc").alias("c2"), F.col("bt").alias("ct"))
    s4 = site.join(cast, F.col("la") == F.col("bc")).join(one, F.col("bt") == F.col("g")).join(inner, F.col("gb") == F.col("c2")).join(from_gep, F.col("ct") == F.col("table")).where("obj = this")
    s4 = s4.select("inst_id", "this", F.expr(f"k * 8 div {pointer_bits}").alias("slot"))
    return s1.unionByName(s2).unionByName(s3).unionByName(s4).distinct()


def function_nodes(program: Program) -> DataFrame:
    """(fn): every function of the call graph, whether it is called or not."""
    return program.functions.select(F.col("fn_id").alias("fn")).distinct()


def loads_libraries(program: Program) -> DataFrame:
    """(module_id, uses_dlopen): whether a module names the function that loads libraries."""
    return program.functions.groupBy("module_id").agg(F.max(F.col("name") == "dlopen").alias("uses_dlopen"))


def load_time_functions(program: Program) -> DataFrame:
    """(fn): functions that run before main: the second member of each entry of the list of
    constructors, seen through a cast."""
    start = program.globals.where("name = 'llvm.global_ctors' AND init_value_id IS NOT NULL").select(F.col("init_value_id").alias("value_id"))
    parts = program.constants.select("value_id", "elements")
    entry = start.join(parts, "value_id").select(F.explode("elements").alias("value_id"))
    member = entry.join(parts, "value_id").select(F.get("elements", F.lit(1)).alias("value_id"))
    casts = program.operands.where("role = 'casted'").select(F.col("inst_id").alias("value_id"), F.col("value_id").alias("to"))
    return member.join(casts, "value_id", "left").select(F.coalesce("to", "value_id").alias("fn")).join(function_nodes(program), "fn", "left_semi").distinct()


def module_constructors(program: Program) -> DataFrame:
    """(fn): the defined functions that construct an object without its virtual bases (tag C2); these
    are made for every class, whatever else is."""
    fns = program.functions.where("NOT is_external").select(F.col("fn_id").alias("fn"), demangled("name").alias("d"))
    return fns.where("d.tag = 'C2'").select("fn")


def class_types(program: Program) -> DataFrame:
    """(fn, class, type_id, error): for each such constructor the class that it constructs, by the
    name of the structure that its first parameter points to; ExpectedClassType where that is no
    pointer to a named structure."""
    first = program.arguments.where("pos = 0").select(F.col("fn_id").alias("fn"), F.col("type_id").alias("p"))
    to = program.types.where("kind = 'pointer'").select(F.col("type_id").alias("p"), F.col("elem_type_id").alias("type_id"))
    named = program.types.where("kind = 'struct' AND struct_name IS NOT NULL").select("type_id", strip_type_prefix("struct_name").alias("class"))
    made = module_constructors(program).join(first, "fn", "left").join(to, "p", "left").join(named, "type_id", "left")
    ok = F.col("class").isNotNull()
    return made.select("fn", "class", F.when(ok, F.col("type_id")).alias("type_id"), F.when(~ok, F.lit("ExpectedClassType")).alias("error"))


def names_to_types(program: Program, names: DataFrame) -> DataFrame:
    """(class, type_id, error) of names (class); NoType for one that no constructor constructs."""
    known = class_types(program).where("error IS NULL").groupBy("class").agg(F.min("type_id").alias("type_id"))
    return names.select("class").join(known, "class", "left").withColumn("error", F.when(F.col("type_id").isNull(), F.lit("NoType")))


def types_to_names(program: Program) -> DataFrame:
    """(type_id, class, error) of all types; NoName for what is no named structure."""
    named = F.when((F.col("kind") == "struct") & F.col("struct_name").isNotNull(), strip_type_prefix("struct_name"))
    return program.types.select("type_id", named.alias("class"), F.when(named.isNull(), F.lit("NoName")).alias("error"))


def virtual_calls(program: Program, pointer_bits: int = 64) -> DataFrame:
    """(inst_id, target, kind) of calls and invokes: ``direct`` calls have the defined function that
    they name, seen through casts; ``virtual`` ones, of the shapes that vtable_slots knows, what
    stands in their slot in the vtables of the static class of their first argument and of all
    classes below it. Classes without a vtable, or with a shorter one, are passed over."""
    from .analyses import class_ancestors, virtual_targets
    from .callgraph import call_sites

    defined = program.functions.where("NOT is_external").select(F.col("fn_id").alias("callee"))
    direct = call_sites(program).join(defined, "callee", "left_semi").select("inst_id", F.col("callee").alias("target"), F.lit("direct").alias("kind"))
    to = program.types.where("kind = 'pointer'").select("type_id", F.col("elem_type_id").alias("of"))
    named = types_to_names(program).where("error IS NULL").select(F.col("type_id").alias("of"), "class")
    static = value_types(program).join(to, "type_id").join(named, "of").select(F.col("value_id").alias("this"), "class")
    calls = cut(vtable_slots(program, pointer_bits).join(static, "this").select(F.col("inst_id").alias("site"), "class", "slot"))
    above, tables = cut(class_parents(program)), cut(vtables(program))
    classes = tables.select("class").union(above.select("parent")).union(above.select("child")).union(calls.select("class")).distinct()
    found = virtual_targets(calls, class_ancestors(above, classes), tables)
    return direct.unionByName(found.select(F.col("site").alias("inst_id"), "target", F.lit("virtual").alias("kind")))


def function_types(program: Program) -> DataFrame:
    """(type_id, function_type_id): function types, and pointers to them through any number of pointers."""
    up = program.types.where("kind = 'pointer' AND elem_type_id IS NOT NULL").select(F.col("elem_type_id").alias("below"), F.col("type_id").alias("above"))
    own = program.types.where("kind = 'function'").select("type_id", F.col("type_id").alias("function_type_id"))
    return fixpoint(own, lambda delta, known: delta.join(up, F.col("type_id") == F.col("below")).select(F.col("above").alias("type_id"), "function_type_id"))


def function_parameters(program: Program) -> DataFrame:
    """(type_id, pos, parameter): parameter types of function types and of pointers to them."""
    own = program.types.where("kind = 'function'").select(F.col("type_id").alias("function_type_id"), "fields")
    return function_types(program).join(own, "function_type_id").select("type_id", F.posexplode("fields").alias("pos", "parameter"))


def function_pointers(program: Program) -> DataFrame:
    """(value_id): values whose type is a pointer, or a pointer to pointers, to a function."""
    pointers = program.types.where("kind = 'pointer'").select("type_id")
    return value_types(program).join(function_types(program).join(pointers, "type_id", "left_semi"), "type_id", "left_semi").select("value_id")


def first_instructions(program: Program, condition: str) -> DataFrame:
    """(fn, inst_id): the first instruction of each function, in the order of its blocks, that
    meets an SQL condition."""
    found = program.instructions.where("block_id IS NOT NULL").where(condition)
    return found.groupBy(F.col("fn_id").alias("fn")).agg(F.min_by("inst_id", F.struct("block_id", "ord")).alias("inst_id"))


def load_targets(program: Program) -> DataFrame:
    """(value_id, target): the address that a load loads from; other values have no row."""
    return program.instructions.where("opcode = 'load'").select("inst_id").join(program.operands.where("role = 'address'").select("inst_id", "value_id"), "inst_id").select(F.col("inst_id").alias("value_id"), F.col("value_id").alias("target"))


#: The allocators and the release of standard C.
C_ALLOCATORS, C_RELEASES = ("malloc", "calloc", "alloca"), ("free",)


def allocations(program: Program, allocators: tuple[str, ...] = C_ALLOCATORS, releases: tuple[str, ...] = C_RELEASES) -> DataFrame:
    """(inst_id, fn, kind): calls and invokes, seen through casts, of functions without a body that
    allocate, and of those that release memory. A program's own function of that name is none."""
    from .callgraph import call_sites

    named = program.functions.where("is_external").select(F.col("fn_id").alias("callee"), F.when(F.col("name").isin(*allocators), "allocates").when(F.col("name").isin(*releases), "releases").alias("kind")).where("kind IS NOT NULL")
    return call_sites(program).join(named, "callee").select("inst_id", F.col("src").alias("fn"), "kind")
