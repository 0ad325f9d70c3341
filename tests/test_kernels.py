"""Kernels against brute force on random graphs, and small programs with known answers."""

from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.functions.names import demangle, type_name
from factloom.operators import kernels as K

edges = st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=20)


def brute_reach(suc, start, without=None):
    seen, todo = set(), [start]
    while todo:
        for y in suc.get(todo.pop(), ()):
            if y not in seen and y != without:
                seen.add(y)
                todo.append(y)
    return seen


@given(edges)
@settings(max_examples=200, deadline=None)
def test_dominators_are_removal_reachability(e):
    suc, pre = K.adjacency(e)
    idom = K.immediate_dominators(suc, pre, 0)
    live = {0} | brute_reach(suc, 0)
    for n in live - {0}:
        want = {d for d in live - {n} if d == 0 or n not in brute_reach(suc, 0, d)}
        assert set(K.ancestors(idom, n)) == want
    assert set(idom) == live - {0}


@given(edges)
@settings(max_examples=200, deadline=None)
def test_control_dependence_definition(e):
    e = e + [(x, K.EXIT) for x in {a for p in e for a in p} if not any(a == x for a, _ in e)]
    suc, pre = K.adjacency(e)
    ipdom = K.immediate_dominators(pre, suc, K.EXIT)
    up = lambda n: set(K.ancestors(ipdom, n))
    want = {(x, m) for m, n in set(e) if n != K.EXIT for x in {n} | up(n) if x != K.EXIT and x not in up(m)}
    assert K.control_dependences(set(e), ipdom) == want


@given(edges, st.dictionaries(st.integers(0, 7), st.integers(0, 3), max_size=6))
@settings(max_examples=100, deadline=None)
def test_forward_and_backward_dataflow_reach_the_naive_fixpoint(e, gen):
    suc, pre = K.adjacency(e)
    blocks = {b: [gen[b]] if b in gen else [] for b in range(8)}
    union = lambda a, b: b if a is None else a if b is None else a | b
    fwd = K.Dataflow(None, frozenset(), union, lambda f, i: (f or frozenset()) | {i})
    got = fwd.solve(blocks, suc, pre, 0)
    live = {0} | brute_reach(suc, 0)
    assert set(got) == live
    for b in live:
        want = {gen[a] for a in live if a in gen and b in brute_reach(suc, a)}
        assert got[b] == want


def test_backward_edge_facts_are_used():
    suc, pre = K.adjacency([(0, 1), (0, 2), (1, -1), (2, -1)])
    union = lambda a, b: b if a is None else a if b is None else a | b
    d = K.Dataflow(None, frozenset(), union, lambda f, i: f, lambda f, i: [(1, frozenset({"e"}))], forward=False)
    assert d.solve({0: ["br"], 1: ["r"], 2: ["r"]}, suc, pre, 0)[0] == {"e"}


def test_unvisited_blocks_answer_top():
    suc, pre = K.adjacency([(0, -1), (5, -1)])
    d = K.Dataflow("top", "start", lambda a, b: a, lambda f, i: f)
    facts = d.solve({0: ["x"], 5: ["y"]}, suc, pre, 0)
    assert d.at({5: ["y"]}, facts, suc, 5) == ["top"]


def test_names():
    assert demangle("_ZN7DerivedC2Ev").tag == "C2"
    assert demangle("_ZTVN2ns4BaseE").parts == ("ns", "Base") and demangle("_ZTVN2ns4BaseE").kind == "vtable"
    assert demangle("_ZThn16_N1A1fEv").kind == "thunk"
    assert demangle("_ZTI4Base").kind == "typeinfo" and demangle("main") is None
    assert type_name("%struct.T.12") == "T" and type_name("class.a::B") == "a::B"
