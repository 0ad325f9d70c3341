"""Programs written as assembly; expected answers follow from the programs by reading."""

import pytest

from factloom.operators import analyses as A
from factloom.operators import callgraph as C
from factloom.operators import flow, ir
from factloom.operators import pointsto as P
from factloom.operators.icfg import outside, program_icfg
from factloom.sources.facts import MissingTable
from factloom.sources.ll import ParseError, program_from_files, program_from_text

HEAD = """
%struct.Inner = type { i32*, i32* }
%struct.Outer = type { i32*, %struct.Inner }
%union.U = type { double }
@a = common global i32 0
@b = common global i32 0
@c = common global i32 0
@p = common global i32* null
@q = common global i32* null
@r = common global i32* null
@pp = common global i32** null
@pq = common global i32** null
@arr = common global [10 x i32] zeroinitializer
@ptrs = common global i32** null
@fp = common global void (i32**)* null
@table = common global void (i32**)** null
declare void @exit(i32)
"""


def named(program, solved):
    """Names of pointers and formals with the names of what they hold."""
    g = program.globals.select("value_id", "name").union(program.functions.select("fn_id", "name"))
    names = {r[0]: r[1] for r in g.collect()} | {r["value_id"]: "%" + r["name"] for r in program.arguments.collect()}
    names |= {r["inst_id"]: "%" + r["name"] for r in program.instructions.where("opcode = 'alloca'").collect()}
    out = {}
    for r in solved.collect():
        if r["value_id"] in names:
            out.setdefault(names[r["value_id"]], set()).add(names[r["target"]])
    return out


def points(spark, body, **how):
    program = program_from_text(spark, HEAD + body)
    a = P.Andersen(program, **how)
    return named(program, a.held(a.solve()))


COPY = """
define void @setup() {
entry:
  store i32* @a, i32** @q
  store i32* @b, i32** @q
  store i32* @c, i32** @r
  store i32** @p, i32*** @pp
  store i32** @q, i32*** @pq
  store i32** @r, i32*** @pq
  ret void
}
define void @copy() {
entry:
  %0 = load i32*** @pq
  %1 = load i32** %0
  %2 = load i32*** @pp
  store i32* %1, i32** %2
  ret void
}
"""

CASES = {
    "two levels": (COPY, {"q": {"a", "b"}, "r": {"c"}, "pp": {"p"}, "pq": {"q", "r"}, "p": {"a", "b", "c"}}),
    "an array element stands for its array": (
        "define void @f(i64 %i) {\nentry:\n  %0 = getelementptr [10 x i32]* @arr, i64 0, i64 %i\n  store i32* %0, i32** @p\n  store i32* @a, i32** @q\n  ret void\n}",
        {"p": {"arr"}, "q": {"a"}},
    ),
    "a pointer that is indexed stands for its elements": (
        """define void @f(i64 %i, i64 %j) {
entry:
  store i32* @a, i32** @p
  %0 = load i32** @p
  %1 = load i32*** @ptrs
  %2 = getelementptr inbounds i32** %1, i64 %i
  store i32* %0, i32** %2
  %3 = load i32*** @ptrs
  %4 = getelementptr inbounds i32** %3, i64 %j
  %5 = load i32** %4
  store i32* %5, i32** @r
  ret void
}""",
        {"p": {"a"}, "ptrs": {"a"}, "r": {"a"}},
    ),
    "fields of a nested structure are told apart": (
        """define void @f(%struct.Outer* %o) {
  %1 = getelementptr inbounds %struct.Outer* %o, i32 0, i32 1, i32 0
  store i32* @b, i32** %1
  %2 = getelementptr inbounds %struct.Outer* %o, i32 0, i32 1, i32 1
  store i32* @a, i32** %2
  %3 = getelementptr inbounds %struct.Outer* %o, i32 0, i32 0
  store i32* @c, i32** %3
  ret void
}
define void @g(%struct.Inner* %i) {
  %1 = getelementptr inbounds %struct.Inner* %i, i32 0, i32 1
  %2 = load i32** %1
  store i32* %2, i32** @p
  ret void
}""",
        {"p": {"a"}},
    ),
    "functions in a table": (
        """define void @f1(i32** %s1) {
  store i32* @a, i32** %s1
  ret void
}
define void @f2(i32** %s2) {
  store i32* @b, i32** %s2
  ret void
}
define void @f3(i32** %s3) {
  store i32* @c, i32** %s3
  ret void
}
define void @setup(i64 %i) {
  %1 = load void (i32**)*** @table
  %2 = getelementptr inbounds void (i32**)** %1, i64 %i
  store void (i32**)* @f1, void (i32**)** %2
  store void (i32**)* @f3, void (i32**)** %2
  ret void
}
define void @run(i64 %i) {
  %1 = load void (i32**)*** @table
  %2 = getelementptr inbounds void (i32**)** %1, i64 %i
  %3 = load void (i32**)** %2
  call void %3(i32** @p)
  ret void
}""",
        {"table": {"f1", "f3"}, "p": {"a", "c"}, "%s1": {"p"}, "%s3": {"p"}},
    ),
    "returned pointers, not numbers": (
        """define i32* @get(i32* %x) {
  ret i32* %x
}
define i32 @number(i32 %n) {
  ret i32 %n
}
define void @run() {
  %1 = call i32* @get(i32* @a)
  store i32* %1, i32** @p
  %2 = call i32 @number(i32 7)
  ret void
}""",
        {"%x": {"a"}, "p": {"a"}},
    ),
    "choices and slots": (
        """define void @f(i1 %k) {
entry:
  %slot = alloca i32*
  store i32* @c, i32** %slot
  br i1 %k, label %yes, label %no
yes:
  br label %no
no:
  %0 = phi i32* [ @a, %entry ], [ @b, %yes ]
  %1 = load i32** %slot
  %2 = select i1 %k, i32* %0, i32* %1
  store i32* %2, i32** @p
  ret void
}""",
        {"%slot": {"c"}, "p": {"a", "b", "c"}},
    ),
    "initial values, and an external call binds nothing": (
        "@start = global i32* @a\ndeclare i32* @far(i32*)\ndefine void @f() {\n  %1 = call i32* @far(i32* @b)\n  store i32* %1, i32** @p\n  ret void\n}",
        {"start": {"a"}},
    ),
}


@pytest.mark.parametrize("case", CASES)
def test_points_to(spark, case):
    body, want = CASES[case]
    assert points(spark, body) == want


def test_ignored_values_make_no_constraints(spark):
    program = program_from_text(spark, HEAD + COPY)
    skip = program.globals.where("name = 'r'").select("value_id")
    a = P.Andersen(program, ignore=skip)
    assert named(program, a.held(a.solve())) == {"q": {"a", "b"}, "pp": {"p"}, "pq": {"q"}, "p": {"a", "b"}}


def test_ids_that_do_not_fit_are_refused(spark):
    from factloom.sources.facts import Program

    with pytest.raises(ValueError):
        P.constraints(Program.from_rows(spark, globals=[(P.CELL, "x", "global", 0, None)]))


PATHS = {
    "store i32 1, i32* @a": ("a", "Deref"),
    "%1 = load i32** @p\n  store i32 1, i32* %1": ("p", "Deref.Deref"),
    "%1 = getelementptr [10 x i32]* @arr, i64 0, i64 1\n  store i32 5, i32* %1": ("arr", "Deref.Array"),
    "%1 = load i32** @p\n  %2 = getelementptr i32* %1, i64 3\n  store i32 5, i32* %2": ("p", "Deref.Deref.Array"),
    "%1 = getelementptr %struct.Outer* %o, i32 0, i32 1, i32 0\n  store i32* null, i32** %1": ("o", "Deref.Field1.Field0"),
    "%1 = getelementptr %struct.Outer* %o, i64 2, i32 1\n  %2 = getelementptr %struct.Inner* %1, i32 0, i32 1\n  %3 = load i32** %2\n  store i32 9, i32* %3": ("o", "Deref.Array.Field1.Field1.Deref"),
    "%1 = bitcast %union.U* %u to i32*\n  store i32 9, i32* %1": ("u", "Deref.Union"),
    "%1 = bitcast %struct.Inner* %in to i32**\n  store i32* null, i32** %1": ("in", "Deref"),
    "%1 = cmpxchg i32* @a, i32 1, i32 2 seq_cst": ("a", "Deref"),
    "%1 = atomicrmw add i32* @a, i32 1 seq_cst": ("a", "Deref"),
    "store i32 5, i32* getelementptr inbounds ([10 x i32]* @arr, i64 0, i64 1)": ("arr", "Deref.Array"),
}


@pytest.fixture(scope="module")
def paths(spark):
    """All of them as functions of one program: the last instruction before the return."""
    text = HEAD + "\n".join(f"define void @f{i}(%struct.Outer* %o, %union.U* %u, %struct.Inner* %in) {{\nentry:\n  {body}\n  ret void\n}}" for i, body in enumerate(PATHS))
    program = program_from_text(spark, text)
    names = {r["value_id"]: r["name"] for r in program.globals.union(program.arguments.select("value_id", "name", "name", "fn_id", "fn_id")).collect()}
    at = {r["fn_id"]: r["name"] for r in program.functions.collect()}
    last = {r["fn_id"]: r["i"] for r in program.instructions.where("opcode <> 'ret' AND block_id IS NOT NULL").groupBy("fn_id").agg({"inst_id": "max"}).toDF("fn_id", "i").collect()}
    return {at[r["fn"]]: (names[r["root"]], r["path"]) for r in ir.memory_paths(program).collect() if last[r["fn"]] == r["iid"]}


@pytest.mark.parametrize("i", range(len(PATHS)))
def test_access_paths(paths, i):
    assert paths[f"f{i}"] == list(PATHS.values())[i]


def test_a_cycle_of_bases_ends(spark):
    steps = spark.createDataFrame([(1, 5, 6, "Array"), (1, 6, 7, "Array"), (1, 7, 6, "Field1"), (1, 8, 5, None)], "fn long, iid long, base long, comp string")
    got = {r["iid"]: (r["root"], r["path"]) for r in A.access_paths(steps).collect()}
    assert got == {6: (6, "Deref"), 7: (6, "Deref.Field1"), 5: (6, "Deref.Array"), 8: (6, "Deref.Array")}


CALLS = """
declare void @far()
define void @leaf() {
  ret void
}
define void @even() {
  call void @odd()
  call void @leaf()
  ret void
}
define void @odd() {
  call void @even()
  ret void
}
@other = alias void ()* @leaf
define i32 @main(i32 %n, i8** %v) {
  call void @odd()
  call void @far()
  call void bitcast (void ()* @leaf to void (i32)*)(i32 1)
  call void @other()
  ret i32 0
}
"""


def test_order_of_components(spark):
    program = program_from_text(spark, CALLS)
    at = {r["fn_id"]: r["name"] for r in program.functions.collect()}
    edges = C.call_edges(program, P.TypePointsTo.of(program).points_to())
    assert {(at[r["fn"]], at[r["callee"]]) for r in C.callees(edges).collect()} == {("even", "odd"), ("even", "leaf"), ("odd", "even"), ("main", "odd"), ("main", "far"), ("main", "leaf")}
    own = program.functions.where("NOT is_external").select(program.functions["fn_id"].alias("fn"))
    inner = C.project_defined(edges, own)
    comp = C.scc(inner, own)
    level = {r["scc"]: r["level"] for r in C.levels(C.condense(inner, comp), comp).collect()}
    by = {}
    for r in comp.collect():
        by.setdefault(level[r["scc"]], set()).add(at[r["fn"]])
    assert by == {0: {"leaf"}, 1: {"even", "odd"}, 2: {"main"}}


def test_types_tell_what_a_pointer_may_call(spark):
    program = program_from_text(spark, HEAD + "define void @f(i32** %x) {\n  ret void\n}\ndefine void @g(i32* %x) {\n  ret void\n}\ndefine void @h() {\n  %1 = load void (i32**)** @fp\n  call void %1(i32** @p)\n  ret void\n}")
    at = {r["fn_id"]: r["name"] for r in program.functions.collect()}
    got = {at[r["dst"]] for r in C.call_targets(program, P.TypePointsTo.of(program).points_to()).where("kind = 'indirect'").collect()}
    assert got == {"f"}


RETURNS = {
    "spins": ("define i32 @spins() {\nentry:\n  br label %loop\nloop:\n  br label %loop\n}", True),
    "plain": ("define i32 @plain() {\n  ret i32 100\n}", False),
    "leaves": ("define void @leaves(i32 %x) {\n  call void @exit(i32 %x)\n  unreachable\n}", True),
    "may_leave": ("define void @may_leave(i1 %k) {\nentry:\n  br i1 %k, label %out, label %back\nout:\n  call void @exit(i32 1)\n  unreachable\nback:\n  ret void\n}", False),
    "switches": ("define void @switches(i32 %n) {\nentry:\n  switch i32 %n, label %d [\n    i32 1, label %one\n    i32 2, label %two\n  ]\none:\n  br label %one\ntwo:\n  unreachable\nd:\n  br label %one\n}", True),
}


def test_functions_that_never_return(spark):
    program = program_from_text(spark, HEAD + "\n".join(x for x, _ in RETURNS.values()))
    edges = ir.flow_edges(program).select("fn", "src", "dst")
    returns = program.instructions.where("opcode = 'ret'").selectExpr("fn_id AS fn", "CAST(block_id AS BIGINT) AS block")
    own = program.functions.where("NOT is_external").selectExpr("fn_id AS fn")
    at = {r["fn_id"]: r["name"] for r in program.functions.collect()}
    assert {at[r["fn"]]: r["noreturn"] for r in A.no_return(edges, returns, own).collect()} == {k: v for k, (_, v) in RETURNS.items()}
    kinds = sorted(r["kind"] for r in ir.flow_edges(program).where("src = 0").join(program.functions.where("name = 'switches'").selectExpr("fn_id AS fn"), "fn").collect())
    assert kinds == ["equality", "equality", "other"]


def test_blocks_that_must_return_one_value(spark):
    text = """define i32 @f(i1 %k, i1 %l) {
entry:
  br i1 %k, label %bad, label %good
bad:
  br label %fail
fail:
  ret i32 -30
good:
  br i1 %l, label %low, label %high
low:
  ret i32 1
high:
  ret i32 2
}"""
    program = program_from_text(spark, text)
    value = program.constants.selectExpr("value_id", "int_value AS value")
    ret = program.instructions.where("opcode = 'ret'").selectExpr("inst_id", "fn_id AS fn", "CAST(block_id AS BIGINT) AS block").join(program.operands.where("role = 'retval'").select("inst_id", "value_id"), "inst_id").join(value, "value_id").select("fn", "block", "value")
    names = {r["block_id"]: r["name"] for r in program.blocks.collect()}
    must, poisoned = A.block_returns(ir.flow_edges(program).select("fn", "src", "dst"), ret)
    assert {names[r["block"]]: r["value"] for r in must.collect()} == {"bad": -30, "fail": -30, "low": 1, "high": 2}
    assert {names[r["block"]] for r in poisoned.collect()} >= {"good"}


def test_files_are_modules_of_one_program(spark, tmp_path):
    (tmp_path / "one.ll").write_text("; a comment\ntarget triple = \"x\"\ndefine void @f() {\n  call void @g()\n  ret void\n}\ndeclare void @g()\n!0 = !{}\n")
    (tmp_path / "two.ll").write_text("define void @g() nounwind {\n  ret void\n}\nattributes #0 = { nounwind }\n")
    (tmp_path / "no.txt").write_text("nothing")
    program = program_from_files(spark, str(tmp_path), "*.ll")
    assert sorted((r["name"], r["is_external"]) for r in program.functions.collect()) == [("f", False), ("g", False), ("g", True)]
    assert program.instructions.count() == 3 and program.functions.select("fn_id").distinct().count() == 3
    assert flow.reachable_from_entry(ir.flow_edges(program).select("fn", "src", "dst")).count() == 4
    with pytest.raises(MissingTable):
        program_from_files(spark, str(tmp_path), "*.none")
    for bad in ("define void @f() {\n  store i32 %x, i32* %y\n  ret void\n}", "define void @f() {\n  ret void", "@x = global nonsense 1"):
        with pytest.raises((ParseError, IndexError)):
            program_from_text(spark, bad)


def test_what_a_module_names(spark):
    text = """
declare i8* @malloc(i64)
declare void @free(i8*)
declare i8* @dlopen(i8*, i32)
define internal void @init() {
  %1 = call i8* @malloc(i64 8)
  call void @free(i8* %1)
  ret void
}
@llvm.global_ctors = appending global [1 x { i32, void ()* }] [{ i32, void ()* } { i32 65535, void ()* @init }]
define void @run(void (i32)* %f, i32* %p) {
  %1 = load i32* %p
  call void %f(i32 %1)
  ret void
}
"""
    p = program_from_text(spark, text)
    at = {r["fn_id"]: r["name"] for r in p.functions.collect()}
    assert [at[r["fn"]] for r in ir.load_time_functions(p).collect()] == ["init"]
    assert ir.loads_libraries(p).first()["uses_dlopen"] and ir.function_nodes(p).count() == 5
    assert sorted((at[r["fn"]], r["kind"]) for r in ir.allocations(p).collect()) == [("init", "allocates"), ("init", "releases")]
    args = {r["value_id"]: r["name"] for r in p.arguments.collect()}
    assert [args.get(r["value_id"]) for r in ir.function_pointers(p).where(f"value_id IN ({', '.join(map(str, args))})").collect()] == ["f"]
    assert {(at[r["fn"]]) for r in ir.first_instructions(p, "opcode = 'load'").collect()} == {"run"}
    assert [args[r["target"]] for r in ir.load_targets(p).collect()] == ["p"]
    rendered = {r["type_id"]: r["rendered"] for r in p.types.collect()}
    got = {(rendered[r["type_id"]], r["pos"], rendered[r["parameter"]]) for r in ir.function_parameters(p).collect()}
    assert {("void (i32)", 0, "i32"), ("void (i32)*", 0, "i32"), ("i8* (i8*, i32)", 1, "i32")} <= got


FINDER_CALLS = """
declare void @puts(i8*)
@f = common global void (i8*)* null
define void @log(i8* %s) {
  call void @puts(i8* %s)
  ret void
}
define i32 @main(i8* %s) {
  call void @log(i8* %s)
  %1 = load void (i8*)** @f
  call void %1(i8* %s)
  ret i32 0
}
"""


@pytest.mark.parametrize("roots,head,opened", [(("main",), "", False), (("main", "log"), "", True), (("main",), "declare i8* @dlopen(i8*, i32)\n", True)])
def test_calls_into_the_open(spark, roots, head, opened):
    p = program_from_text(spark, head + FINDER_CALLS)
    fn = {r["name"]: r["fn_id"] for r in p.functions.collect()}
    entry = spark.createDataFrame([(fn[r],) for r in roots], "fn long")
    none = spark.createDataFrame([], "value_id long, target long")
    got = sorted((r["src"], r["dst"], r["kind"]) for r in program_icfg(p, none, entry).collect())
    at = {(r["fn_id"], r["ord"]): r["inst_id"] for r in p.instructions.collect()}
    log, main = ([at[k] for k in sorted(k for k in at if k[0] == fn[n])] for n in ("log", "main"))
    puts = fn["puts"]
    want = [(log[0], puts, "call_to_entry"), (puts, -log[0], "return_to_call"), (log[0], -log[0], "call_to_return"), (-log[0], log[1], "intra")]
    want += [(main[0], log[0], "call_to_entry"), (log[1], -main[0], "return_to_call"), (main[0], -main[0], "call_to_return"), (-main[0], main[1], "intra")]
    want += [(main[1], main[2], "intra"), (main[2], -main[2], "call_to_return"), (-main[2], main[3], "intra")]
    if opened:
        node = outside(p, entry).first()["node"]
        assert node not in set(at.values()) | set(fn.values())
        want += [(main[2], node, "call_to_entry"), (node, -main[2], "return_to_call")]
    assert got == sorted(want)
