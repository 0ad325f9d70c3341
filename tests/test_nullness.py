"""Null pointers in one function and across functions, returned phi nodes, environments, and what a module's types say."""

import pytest

from factloom.operators import analyses as A
from factloom.operators import callgraph, ir, nullness
from factloom.operators import kernels as K
from factloom.operators.flow import dataflow_in
from factloom.operators import ifds
from factloom.operators.ifds import Problem
from factloom.sources.facts import Program

NULL, X = 90, 100
TYPES = [(1, "int", None, 32, None, None, "i32"), (2, "pointer", 1, None, None, None, "i32*"), (3, "function", 1, None, None, [2], "i32 (i32*)"), (4, "pointer", 3, None, None, None, "f*"), (5, "pointer", 4, None, None, None, "f**"), (6, "struct", None, None, "class.Base", None, "%class.Base"), (7, "pointer", 6, None, None, None, "%class.Base*")]


def pairs(df):
    return sorted(map(tuple, df.collect()))


class Code:
    """Instructions and operands of small functions; ids of a function are its number times a thousand."""

    def __init__(self):
        self.ins, self.ops, self.fns, self.args = [], [], [], []

    def fn(self, f, name="f", external=False):
        self.fns.append(("m", f, name, external, 3))
        self.args.append((f, 0, f * 1000 + X, "x", 2))
        self.f, self.n = f, 0
        return f * 1000 + X

    def add(self, block, op, pred=None, type_=None, **operands):
        self.n += 1
        i = self.f * 1000 + self.n
        self.ins.append((i, self.f, block, self.n, op, type_, None, pred))
        for role, v in operands.items():
            self.ops.append((i, role, 0, None if role.endswith(("_bb", "dest")) else v, v if role.endswith(("_bb", "dest")) else None))
        return i

    def test(self, block, value, null, other):
        c = self.add(block, "icmp", "eq", cmp1=value, cmp2=NULL)
        return self.add(block, "br", cond=c, true_bb=null, false_bb=other)

    def program(self, spark, **more):
        return Program.from_rows(spark, functions=self.fns, arguments=self.args, instructions=self.ins, operands=self.ops, types=TYPES, constants=[(NULL, "null", None, None, None)], **more)


def test_calls_tell_what_is_not_null(spark):
    c = Code()
    x = c.fn(1)
    c.test(0, x, 1, 2)
    bad = c.add(1, "call", callee=5, arg=x)
    c.add(1, "br", dest=3)
    c.add(2, "call", callee=5, arg=x)
    c.add(2, "br", dest=3)
    c.add(3, "br", dest=3)
    y = c.fn(2)
    first = c.add(0, "call", callee=5, arg=y)
    c.add(0, "call", callee=5, arg=y)
    c.add(0, "br", dest=0)
    p = c.program(spark)
    reads = spark.createDataFrame([(5, 0)], "callee long, pos int")
    facts, told = nullness.null_facts_in(p, reads)
    assert pairs(facts) == [(1, 1, x, 1), (1, 2, x, 0), (1, 3, x, 0)]
    # The loop of the second function is run until it settles, and writes once.
    assert pairs(told) == [(1, bad, x, "null"), (2, first, y, "unknown")]
    facts, told = nullness.null_facts_in(p, reads.limit(0))
    assert pairs(facts) == [(1, 1, x, 1), (1, 2, x, 0)] and told.isEmpty()


def test_environments_keep_and_index(spark):
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (1, 1, -1), (2, 0, -1)], "fn long, src long, dst long")
    ins = spark.createDataFrame([(1, 0, 0, 7), (1, 1, 1, 8), (2, 0, 0, 7)], "fn long, b long, ord long, k long")
    env = spark.createDataFrame([(1, 7, "a"), (1, 7, "b"), (1, 8, None), (2, 9, "c")], "fn long, key long, word string")

    def analysis(e):
        def transfer(f, i):
            e.kept["n"] = e.kept.get("n", 0) + 1
            for r in e.ask(key=i["k"]):
                e.tell(i["k"], r["word"])
            return f | {r["word"] for r in e.ask(key=i["k"])}

        return K.Dataflow(None, frozenset(), lambda a, b: b if a is None else a if b is None else a | b, transfer)

    facts, told = dataflow_in(edges, ins, env, analysis, lambda a, blocks, facts, suc: [(b, w) for b, f in facts.items() for w in f], "block long, word string", "at long, said string")
    assert pairs(told) == [(1, 7, "a"), (1, 7, "b"), (1, 8, None)]
    assert set(pairs(facts.where("word IS NOT NULL"))) == {(1, 1, "a"), (1, 1, "b"), (1, -1, "a"), (1, -1, "b")}


def test_what_functions_need(spark):
    c = Code()
    need = {}
    g = c.fn(1)  # reads through x
    c.add(0, "load", address=g)
    c.add(0, "ret")
    need[1] = g
    h = c.fn(2)  # hands x on to 1
    c.add(0, "call", callee=1, arg=h)
    c.add(0, "ret")
    need[2] = h
    s = c.fn(3)  # only where it is not null
    c.test(0, s, 1, 2)
    c.add(1, "ret")
    c.add(2, "call", callee=2, arg=s)
    c.add(2, "ret")
    e = c.fn(4)  # only where it is null
    c.test(0, e, 1, 2)
    c.add(1, "call", callee=2, arg=e)
    c.add(1, "ret")
    c.add(2, "ret")
    a = c.fn(5)  # 5 and 6 call each other; 6 reads in the end
    c.add(0, "call", callee=6, arg=a)
    c.add(0, "ret")
    b = c.fn(6)
    c.add(0, "call", callee=5, arg=b)
    c.add(0, "store", address=b, value=NULL)
    c.add(0, "ret")
    u = c.fn(7)  # null on one way only, so neither known to be null nor not null where the ways meet
    c.test(0, u, 1, 2)
    c.add(1, "br", dest=2)
    c.add(2, "load", address=u)
    c.add(2, "ret")
    need |= {5: a, 6: b, 7: u}
    none = spark.createDataFrame([], "value_id long, target long")
    got = pairs(nullness.nullability(c.program(spark), none))
    assert got == sorted([(f, "needs", v) for f, v in need.items()] + [(4, "error", e)])
    assert pairs(nullness.always_reads(c.program(spark))) == [(1, 0), (6, 0), (7, 0)]


def test_a_ring_of_functions_never_meets(spark, monkeypatch):
    """What functions need takes no components, whose functions would go to one task."""
    c = Code()
    n = 9
    need = {}
    for f in range(1, n + 1):
        need[f] = c.fn(f)
        c.add(0, "call", callee=f % n + 1, arg=need[f])
        if f == 4:
            c.add(0, "load", address=need[f])
        c.add(0, "ret")
    monkeypatch.setattr(callgraph, "scc", lambda *a, **b: pytest.fail("components are not needed"))
    got = pairs(nullness.nullability(c.program(spark), spark.createDataFrame([], "value_id long, target long")))
    assert got == [(f, "needs", v) for f, v in sorted(need.items())]


def test_null_by_slots_globals_arguments_and_results(spark):
    """main: *slot = null; y = load slot; r = f(y). f: if returned x, x may be null; the global stays null until f stores."""
    c = Code()
    c.fn(1, "main")
    c.args.pop()
    slot = c.add(0, "alloca", type_=8)
    c.add(0, "store", address=slot, value=NULL)
    y = c.add(0, "load", type_=2, address=slot)
    r = c.add(0, "call", type_=2, callee=2, arg=y)
    end = c.add(0, "ret")
    x = c.fn(2)
    st = c.add(0, "store", address=60, value=70)
    ret = c.add(0, "ret", retval=x)
    types = [*TYPES, (8, "pointer", 2, None, None, None, "i32**")]
    p = Program.from_rows(spark, functions=c.fns, arguments=c.args, instructions=c.ins, operands=c.ops, types=types, constants=[(NULL, "null", None, None, None)], globals=[(60, "g", "global", 8, NULL), (70, "h", "global", 2, None)])
    none = spark.createDataFrame([], "value_id long, target long")
    got = nullness.may_be_null(p, none, spark.createDataFrame([(1,)], "fn long")).collect()
    at = lambda n: {r["value_id"] for r in got if r["node"] == n}
    assert at(slot) == {60} and at(y) == {60, slot} and at(st) == {60, x} and at(ret) == {x} and at(end) == {slot, r}


def test_kept_and_lost_facts_are_those_of_listed_ones(spark):
    """A problem with steps and losses against the same with every fact listed."""
    df = spark.createDataFrame
    entry, exits = df([(1, 10), (2, 20)], "fn long, node long"), df([(13, 1), (22, 2)], "node long, fn long")
    start = df([(1, -1), (1, 5), (1, -7), (1, 6)], "fn long, d long")
    steps = df([(1, 10, 11), (1, -11, 12), (1, 11, -11), (1, 12, 13), (2, 20, 21), (2, 21, 22)], "fn long, node long, succ long")
    lost = df([(1, 12, 5), (2, 21, -7)], "fn long, node long, d long")
    gen = df([(1, 10, 11, 6, 8), (2, 21, 22, -1, 9)], "fn long, node long, succ long, d long, d2 long")
    pass_, back = df([(11, 2, -1, -1), (11, 2, 8, 3)], "node long, fn long, d long, d2 long"), df([(11, 2, -1, -1), (11, 2, 9, 4), (11, 2, 3, 2)], "node long, fn long, d long, d2 long")
    none = df([], "fn long, node long, d long, d2 long")
    calls = df([(11, 2)], "node long, fn long")
    short = Problem(entry, start, gen, pass_, exits, back, none, steps, lost, calls).solve()
    facts = range(-10, 10)
    gone = {(12, 5), (21, -7)}
    flow = [(f, n, s, d, d) for f, n, s in map(tuple, steps.collect()) if (n, s) != (11, -11) for d in facts if (n, d) not in gone]
    past = df([(1, 11, d, d) for d in facts if d >= -1], "fn long, node long, d long, d2 long")
    world = [(11, 2, d, d) for d in facts if d < -1]
    whole = Problem(entry, start, gen.union(df(flow, gen.schema)), pass_.union(df(world, pass_.schema)), exits, back.union(df(world, back.schema)), past).solve()
    for name in ("path", "incoming", "end", "summary"):
        assert pairs(short[name]) == pairs(whole[name]), name
    at_exit = {d for _, _, n, d in pairs(short["path"]) if n == 13}
    assert at_exit == {-1, 4, 6, 8, 2}


def test_returned_phi_nodes(spark):
    df = spark.createDataFrame
    # 0 -> 1, 2, 6; 1, 2 -> 3 -> 5; 6 -> 5. Block 3 has phi 31 of a and b, block 5 phi 51 of that and c.
    edges = [(1, 0, 1), (1, 0, 2), (1, 0, 6), (1, 1, 3), (1, 2, 3), (1, 3, 5), (1, 6, 5), (1, 5, -1)]
    # A loop that returns what it last had: 0 -> 1 -> 1, 2.
    edges += [(2, 0, 1), (2, 1, 1), (2, 1, 2), (2, 2, -1)]
    # Without phi nodes.
    edges += [(3, 0, 1), (3, 0, 2), (3, 1, -1), (3, 2, -1)]
    e = df(edges, "fn long, src long, dst long")
    phis = df([(1, 31, 3, 71, 1), (1, 31, 3, 72, 2), (1, 51, 5, 31, 3), (1, 51, 5, 73, 6), (2, 11, 1, 71, 0), (2, 11, 1, 72, 1)], "fn long, phi long, at long, value long, block long")
    ret = df([(1, 5, 51), (2, 2, 11), (3, 1, 71), (3, 2, 72)], "fn long, block long, value long")
    label, poisoned = A.block_returns(e, ret, phis)
    assert pairs(label) == [(1, 1, 71), (1, 2, 72), (1, 6, 73), (2, 1, 72), (3, 1, 71), (3, 2, 72)]
    assert pairs(poisoned) == [(1, 0), (2, 0), (3, 0)]
    may = pairs(A.may_return(e, ret, phis))
    assert [r[1:] for r in may if r[0] == 1] == [(0, 71), (0, 72), (0, 73), (1, 71), (2, 72), (3, 31), (5, 51), (6, 73)]
    assert [r[1:] for r in may if r[0] == 2] == [(0, 71), (0, 72), (1, 11), (1, 72), (2, 11)]


def test_backward_edge_facts_see_the_successor():
    suc, pre = K.adjacency([(0, 1), (0, 2), (1, -1), (2, -1)])
    union = lambda a, b: b if a is None else a if b is None else a | b
    d = K.Dataflow(None, frozenset(), union, lambda f, i: f | {i}, lambda f, i: [(1, f | {"to 1"})] if "one" in f else [], forward=False)
    blocks = {0: ["br"], 1: ["one"], 2: ["two"]}
    facts = d.solve(blocks, suc, pre, 0)
    assert facts[0] == {"br", "one", "two", "to 1"} and d.at(blocks, facts, suc, 0) == [facts[0]]


def test_function_types_behind_pointers_and_constructors(spark):
    fns = [("m", 1, "_ZN4BaseC2Ev", False, 3), ("m", 2, "_ZN4BaseC1Ev", False, 3), ("m", 3, "_ZN5OtherC2Ev", False, 3), ("m", 4, "_ZN4BaseC2Ev", True, 3), ("m", 5, "malloc", True, 3), ("m", 6, "calloc", False, 3), ("m", 7, "alloca", True, 3), ("m", 8, "main", False, 3)]
    ins = [(10, 8, 0, 0, "bitcast", 4, None, None), (11, 8, 0, 1, "call", 2, None, None), (12, 8, 0, 2, "call", 2, None, None), (13, 8, 0, 3, "invoke", 2, None, None)]
    ops = [(10, "casted", 0, 5, None), (11, "callee", 0, 10, None), (12, "callee", 0, 6, None), (13, "callee", 0, 7, None)]
    p = Program.from_rows(spark, functions=fns, instructions=ins, operands=ops, types=TYPES, arguments=[(1, 0, 20, "this", 7), (3, 0, 21, "this", 2)], globals=[(30, "t", "global", 5, None), (31, "n", "global", 2, None)])
    assert pairs(ir.module_constructors(p)) == [(1,), (3,)]
    assert sorted(map(str, pairs(ir.class_types(p)))) == sorted(["(1, 'Base', 6, None)", "(3, None, None, 'ExpectedClassType')"])
    names = spark.createDataFrame([("Base",), ("Nobody",)], "class string")
    assert [tuple(r) for r in ir.names_to_types(p, names).orderBy("class").collect()] == [("Base", 6, None), ("Nobody", None, "NoType")]
    assert [r["type_id"] for r in ir.types_to_names(p).where("error IS NULL").collect()] == [6]
    assert pairs(ir.function_types(p)) == [(3, 3), (4, 3), (5, 3)] and (5, 0, 2) in pairs(ir.function_parameters(p))
    assert {v for (v,) in pairs(ir.function_pointers(p))} == {10, 30}
    assert pairs(ir.allocations(p)) == [(11, 8, "allocates"), (13, 8, "allocates")]


def test_exits_are_told_by_name(spark):
    """A problem whose exits are told by name against the same by exit and fact: a function of the whole program's
    fact -7 and of its parameter, which leaves by two exits; its own fact 9 is nothing to callers."""
    df = spark.createDataFrame
    entry, exits = df([(1, 10), (2, 20)], "fn long, node long"), df([(13, 1), (22, 2), (23, 2)], "node long, fn long")
    start = df([(1, -1), (1, 5), (1, -7)], "fn long, d long")
    steps = df([(1, 10, 11), (1, -11, 12), (1, 11, -11), (1, 12, 13), (2, 20, 21), (2, 21, 22), (2, 21, 23)], "fn long, node long, succ long")
    lost, gen = df([(2, 20, -7)], "fn long, node long, d long"), df([(2, 20, 21, -1, 9), (2, 21, 23, -7, 8), (2, 20, 21, 3, -7)], "fn long, node long, succ long, d long, d2 long")
    pass_, none = df([(11, 2, -1, -1), (11, 2, 5, 3)], "node long, fn long, d long, d2 long"), df([], "fn long, node long, d long, d2 long")
    calls, kinds = df([(11, 2)], "node long, fn long"), "node long, fn long, exit long, d long, d2 long"
    back = df([(11, 2, 22, -1, -1), (11, 2, 23, -1, -1), (11, 2, 23, 8, 4), (11, 2, 22, -7, 4)], kinds)
    leaves = df([(2, 22, -1, -1), (2, 23, -1, -1), (2, 23, 8, 0), (2, 22, -7, 0)], "fn long, node long, d long, name long")
    by_exit = Problem(entry, start, gen, pass_, exits, back, none, steps, lost, calls)
    named = Problem(entry, start, gen, pass_, exits, df([(11, 2, -1, -1), (11, 2, 0, 4)], "node long, fn long, d long, d2 long"), none, steps, lost, calls, leaves)
    one, two = by_exit.solve(), named.solve()
    for name in ("path", "incoming", "end", "summary"):
        assert pairs(one[name]) == pairs(two[name]), name
    facts = {(n, d) for _, _, n, d in pairs(one["path"]) if n > 0 and d != -1}
    assert (13, 4) in facts and (13, -7) in facts and (13, 9) not in facts
    # Facts at nodes come without paths, and each once.
    assert pairs(named.at_nodes().select("node", "d2")) == sorted(facts)


def test_rounds_tabulate_nothing():
    """What a function says follows from its graph, which is made once, leaving each exploded node once where there is no loop."""
    n = 60  # calls, one after another, then a return
    rows = [(ifds.ENTRY, 1, 0, 0, 0, 0), (ifds.EXIT, 3 * n, 0, 0, 0, 0), (ifds.ENTERS, -1, 0, 0, 0, 0), (ifds.LEAVES, 3 * n, -1, -1, 0, 0)]
    for i in range(n):
        call = 3 * i + 1
        rows += [(ifds.EDGE, a, b, ifds.KEEPS, ifds.KEEPS, 0) for a, b in ((call, -call), (-call, call + 1), (call + 1, call + 2), (call + 2, call + 3 if i < n - 1 else 3 * n)) if a != b]
        rows += [(ifds.HOME, call, 0, 0, 0, 0), (ifds.PASS, call, 500, -1, -1, 0), (ifds.CALL, call, 500, 0, 0, 0), (ifds.BACK_ANY, call, 500, 0, -1, -1), (ifds.EDGE, call + 2, ifds.LOSES, -9, ifds.LOSES, 0)]
    f = ifds._Function(rows, True)
    left, step = [], f._next
    f._next = lambda *x: left.append(x) or step(*x)
    graph = f.graph(ifds.BY_NAME)
    assert len(left) == len(set(left)) <= 4 * n * 4
    told = ifds._News(ifds.pickle.dumps(graph), True)
    told.tell([(ifds.ENTER, -9, None, None, None), (ifds.ENTER, -1, None, None, None)])
    assert told.said == {(500, ifds.ENTER, -1, None, None), (500, ifds.ENTER, -9, None, None), (None, ifds.END, -1, 0, -1)}
    # Of the whole program: -9 is lost after the first call, -8, which is not mentioned, comes through all.
    told.tell([(ifds.END, 500, -9, -9, 0), (ifds.ENTER, -8, None, None, None), (ifds.END, 500, -8, -8, 0)])
    assert told.said - {(500, ifds.ENTER, -8, None, None)} == {(500, ifds.ENTER, -1, None, None), (500, ifds.ENTER, -9, None, None), (None, ifds.END, -1, 0, -1), (None, ifds.END, -8, 0, -8)}
