"""Hand-encoded programs: expected answers follow from the sources by reading."""

from factloom.functions import names
from factloom.operators import analyses as A
from factloom.operators import callgraph as C
from factloom.operators import pointsto as P
from factloom.operators import ifds
from factloom.operators.ifds import Problem
from factloom.plans.fixpoint import closure
from factloom.sources.facts import Program, UnknownInput


def pairs(df):
    return sorted(map(tuple, df.collect()))


def test_call_graph_through_cast_alias_and_pointer(spark):
    # main (1) calls f (2) directly, g (3) through a bitcast, h (4) through an alias, and *p
    fns = [("m", i, n, i == 5, 0) for i, n in ((1, "main"), (2, "f"), (3, "g"), (4, "h"), (5, "puts"))]
    ins = [(10 + i, 1, 100, i, op, None, None, None) for i, op in enumerate(["call", "bitcast", "call", "invoke", "call", "call"])]
    ops = [(10, "callee", 0, 2, None), (11, "casted", 0, 3, None), (12, "callee", 0, 11, None), (13, "callee", 0, 50, None), (14, "callee", 0, 60, None), (15, "callee", 0, 5, None)]
    p = Program.from_rows(spark, functions=fns, instructions=ins, operands=ops, globals=[(50, "alias", "alias", 0, 4)])
    pts = spark.createDataFrame([(60, 2), (60, 3)], "value_id long, target long")
    assert pairs(C.call_edges(p, pts)) == [(1, -100, "unknown"), (1, 2, "direct"), (1, 2, "indirect"), (1, 3, "direct"), (1, 3, "indirect"), (1, 4, "direct"), (1, 5, "direct")]
    assert pairs(C.callees(C.call_edges(p, pts))) == [(1, 2), (1, 3), (1, 4), (1, 5)]


def test_unknown_tables_are_refused(spark):
    try:
        Program.from_rows(spark, nothing=[])
    except UnknownInput:
        return
    raise AssertionError


def test_bottom_up_order_of_a_small_cycle(spark):
    # main -> g <-> f -> h
    e = spark.createDataFrame([(1, 3), (3, 2), (2, 3), (2, 4)], "src long, dst long")
    n = spark.createDataFrame([(1,), (2,), (3,), (4,)], "fn long")
    comp = C.scc(e, n)
    assert pairs(comp) == [(1, 1), (2, 2), (3, 2), (4, 4)]
    assert pairs(C.levels(C.condense(e, comp), comp)) == [(1, 2), (2, 1), (4, 0)]


def test_copies_through_two_levels_of_pointers(spark):
    # q = &a; q = &b; r = &c; pq = &q; pq = &r; p = *pq  (variables hold locations; cells are offset)
    q, r, pq, p = 1, 2, 3, 4
    cell = P.CELL
    addr = spark.createDataFrame([(cell + q, 101), (cell + q, 102), (cell + r, 103), (pq, q), (pq, r)], "x long, l long")
    none = spark.createDataFrame([], "x long, y long")
    load = spark.createDataFrame([(p, pq)], "x long, y long")
    got = {(x, y) for x, y in pairs(P.andersen(addr, none, load, none)) if x == p}
    assert got == {(p, 101), (p, 102), (p, 103)}
    store = spark.createDataFrame([(pq, 9)], "x long, y long")
    more = addr.union(spark.createDataFrame([(9, 104)], "x long, l long"))
    assert (p, 104) in set(pairs(P.andersen(more, none, load, store)))


def test_no_return_modes(spark):
    e = spark.createDataFrame([(1, 0, 1), (1, 1, -1), (2, 0, 0)], "fn long, src long, dst long")
    ret, fns = spark.createDataFrame([(1, 1)], "fn long, block long"), spark.createDataFrame([(1,), (2,)], "fn long")
    never = spark.createDataFrame([(1, 0)], "fn long, block long")
    assert pairs(A.no_return(e, ret, fns)) == [(1, False), (2, True)]
    assert pairs(A.no_return(e, ret, fns, never, "sticky")) == [(1, True), (2, True)]


def test_virtual_dispatch_and_hierarchy(spark):
    # Base <- Middle1, Middle2 <- Derived; f1 overridden in Middle1 and Derived
    par = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4)], "parent long, child long")
    cl = spark.createDataFrame([(1,), (2,), (3,), (4,)], "class long")
    anc = A.class_ancestors(par, cl)
    assert pairs(anc.where("class = 4")) == [(4, 1), (4, 2), (4, 3), (4, 4)]
    vt = spark.createDataFrame([(1, 0, 10), (2, 0, 20), (3, 0, 10), (4, 0, 40)], "class long, slot long, fn long")
    call = spark.createDataFrame([(7, 1, 0)], "site long, class long, slot long")
    assert pairs(A.virtual_targets(call, anc, vt)) == [(7, 10), (7, 20), (7, 40)]


def test_closure_of_a_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src long, dst long")
    assert closure(e).count() == 9


def test_path_append_reduce_externalize(spark):
    schema = "id long, base_type string, end_type string, comps array<struct<type: string, op: string, idx: int>>"
    a = spark.createDataFrame([(1, "%struct.T.3", "i32", [("%struct.T.3", "Deref", None), ("T", "Field", 1)])], schema)
    b = spark.createDataFrame([(2, "i32", "i8", [("i32", "Array", None)]), (3, "i64", "i8", [])], schema)
    got = A.append_paths(a, b).collect()
    assert len(got) == 1 and (got[0]["b"], got[0]["end_type"], len(got[0]["comps"]), got[0]["error"]) == (2, "i8", 3, None)
    none = A.append_paths(b, a).collect()
    assert [(r["a"], r["b"], r["error"]) for r in sorted(none)] == [(2, None, "EndpointTypeMismatch"), (3, None, "EndpointTypeMismatch")]
    types = spark.createDataFrame([("%struct.T.3", "pointer", "T", None), ("T", "struct", None, ["i8", "i32"]), ("A", "array", "i64", None)], "type string, kind string, elem string, fields array<string>")
    more = spark.createDataFrame([(4, "T", "i32", [("T", "Field", 1)]), (5, "T", "i32", [("T", "Field", 2)]), (6, "A", "i64", [("A", "Array", None)]), (7, "A", "i64", []), (8, "i32", "i32", [("i32", "Deref", None)])], schema)
    red = {r["id"]: (r["base_type"], None if r["comps"] is None else len(r["comps"]), r["error"]) for r in A.reduce_path(a.union(more), types).collect()}
    bad = (None, None, "IrreducableAccessPath")
    assert red == {1: ("T", 1, None), 4: ("i32", 0, None), 5: bad, 6: ("i64", 0, None), 7: bad, 8: bad}
    assert A.externalize_path(a).first()["name"] == "T"
    assert A.abstract_paths(a).columns == ["id", "base_type", "end_type", "comps"]


def test_paths_are_followed_into_constants(spark):
    consts = spark.createDataFrame([(1, "struct", [2, 3]), (2, "int", None), (3, "struct", [2, 4]), (4, "null", None)], "value_id long, ckind string, elements array<long>")
    f, d = (lambda i: ("t", "Field", i)), ("t", "Deref", None)
    rows = [(10, 1, []), (11, 1, [f(0)]), (12, 1, [f(1), f(1)]), (13, 1, [f(2)]), (14, 1, [f(0), f(0)]), (15, 1, [f(1), d])]
    paths = spark.createDataFrame(rows, "id long, value_id long, comps array<struct<type: string, op: string, idx: int>>")
    got = {r["id"]: (r["value_id"], r["error"]) for r in A.follow_paths(paths, consts).collect()}
    bad = (None, "NonConstantInPath")
    assert got == {10: (1, None), 11: (2, None), 12: (4, None), 13: bad, 14: bad, 15: (None, "CannotFollowPath")}


def test_names_are_read_and_written(spark):
    for text in ("f", "a::b::c", "std::vector<int>"):
        assert names.parse_name(text).text() == text
    for text in ("", "a::", "::b", "a:b", "a::::b"):
        assert names.parse_name(text) is None
    assert names.demangle("_ZN3foo3BarD2Ev").text() == "foo::Bar::~Bar" and names.demangle("_ZNK3foo3Bar3getEv").text() == "foo::Bar::get"
    rows = spark.createDataFrame([(0, ["a", "b"]), (1, ["a:"]), (2, [""]), (3, []), (4, None), (5, ["a", None])], "i int, p array<string>")
    assert pairs(rows.select("i", names.joined_name("p").alias("t"))) == [(0, "a::b"), (1, None), (2, None), (3, None), (4, None), (5, None)]


def test_functions_without_a_body_in_problems(spark):
    # 1: call of 7 (external), 2: after it. Fact 0 enters; 7 gets it as 5 and gives 5 back as 3.
    d = lambda rows, cols: spark.createDataFrame(rows, ", ".join(f"{c} long" for c in cols.split()))
    flow = d([(1, -1, 2, 3, 3), (1, -1, 2, -1, -1)], "fn node succ d d2")
    edge = "node fn d d2"
    problem = Problem(d([(1, 1)], "fn node"), d([(1, 0), (1, -1)], "fn d"), flow, d([], edge), d([(2, 1)], "node fn"), d([], edge), d([(1, 1, -1, -1)], "fn node d d2"))
    assert pairs(Problem.facts(problem.solve())) == [(1, 0)]
    solved = problem.with_externs(d([(7, 70)], "fn node"), d([(1, 7, 0, 5)], edge), d([(1, 7, 5, 3)], edge)).solve()
    assert pairs(Problem.facts(solved)) == [(1, 0), (2, 3), (70, 5)]
    assert pairs(solved["summary"]) == [(1, 0, 3)]


def test_rounds_of_the_solver_are_one_statement(spark, monkeypatch):
    """Facts go down a chain of calls and come back up: a round writes one table, whatever it says."""
    d = lambda rows, cols: spark.createDataFrame(rows, ", ".join(f"{c} long" for c in cols.split()))
    n = 5
    nodes = range(1, n + 1)
    # Function i calls i + 1 at node 10 i and leaves at 10 i + 1; the last passes its fact through.
    entry, exits = d([(i, 10 * i) for i in nodes], "fn node"), d([(10 * i + 1, i) for i in nodes], "node fn")
    flow = d([(i, -10 * i, 10 * i + 1, 0, 0) for i in range(1, n)] + [(n, 10 * n, 10 * n + 1, 0, 0)], "fn node succ d d2")
    calls = [(10 * i, i + 1, 0, 0) for i in range(1, n)]
    past = d([(i, 10 * i, -1, -1) for i in range(1, n)], "fn node d d2")
    written, cut = [], ifds.cut
    monkeypatch.setattr(ifds, "cut", lambda df: written.append(1) or cut(df))
    solved = Problem(entry, d([(1, 0)], "fn d"), flow, d(calls, "node fn d d2"), exits, d(calls, "node fn d d2"), past).solve()
    assert pairs(solved["end"].select("fn", "d2")) == [(i, 0) for i in nodes]
    assert pairs(solved["summary"].select("node", "d5")) == [(10 * i, 0) for i in range(1, n)]
    assert pairs(solved["incoming"].select("fn", "node")) == [(i + 1, 10 * i) for i in range(1, n)]
    assert len(written) <= 22
