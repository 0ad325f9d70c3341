"""Components, levels and bottom-up traversals of graphs against brute force."""

import random
import time

import pytest

from factloom.operators import callgraph as C
from factloom.plans import fixpoint


def frames(spark, edges, nodes):
    return spark.createDataFrame(edges or [], "src long, dst long"), spark.createDataFrame([(n,) for n in nodes], "fn long")


def reach(edges, nodes):
    suc = {n: {b for a, b in edges if a == n} for n in nodes}
    out = {}
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            for m in suc[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        out[n] = seen
    return out


def components(edges, nodes):
    r = reach(edges, nodes)
    return {n: min(m for m in r[n] if n in r[m]) for n in nodes}


def heights(edges, comp):
    below = {c: {comp[b] for a, b in edges if comp[a] == c} - {c} for c in comp.values()}
    done = {}

    def h(c):
        if c not in done:
            done[c] = 1 + max((h(x) for x in below[c]), default=-1)
        return done[c]

    return {c: h(c) for c in below}


def ring(a, n):
    return [(a + i, a + (i + 1) % n) for i in range(n)]


GRAPHS = {
    "empty": ([], range(3)),
    "ring": (ring(5, 7), range(5, 12)),
    "self": ([(1, 1), (1, 2)], (1, 2)),
    "two rings on one node": (ring(0, 4) + [(0, 10), (10, 11), (11, 0)], (0, 1, 2, 3, 10, 11)),
    "rings along a chain": (ring(0, 3) + [(2, 20)] + [(i, i + 1) for i in range(20, 30)] + ring(40, 5) + [(30, 42), (44, 50), (50, 51)], (0, 1, 2, *range(20, 31), *range(40, 45), 50, 51)),
    "chains that become chains": ([(0, 1), (1, 2), (0, 3), (3, 2), (2, 4), (4, 5), (5, 0), (5, 6), (6, 7)], range(8)),
    "ladder": ([(i, i + d) for i in range(30) for d in (1, 2) if i + d < 30], range(30)),
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components_and_levels(spark, name):
    edges, nodes = GRAPHS[name]
    e, n = frames(spark, edges, nodes)
    comp = C.scc(e, n)
    want = components(edges, nodes)
    assert {r["fn"]: r["scc"] for r in comp.collect()} == want
    assert {r["scc"]: r["level"] for r in C.levels(C.condense(e, comp), comp).collect()} == heights(edges, want)


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    nodes = list(range(120))
    edges = sorted({(rng.choice(nodes), rng.choice(nodes)) for _ in range(80 + 60 * seed)})
    e, n = frames(spark, edges, nodes)
    comp = C.scc(e, n)
    want = components(edges, nodes)
    assert {r["fn"]: r["scc"] for r in comp.collect()} == want
    assert {r["scc"]: r["level"] for r in C.levels(C.condense(e, comp), comp).collect()} == heights(edges, want)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(C, "cut", lambda df: written.append(1) or fixpoint.cut(df))
    e = spark.range(9_999).selectExpr("id AS src", "id + 1 AS dst")
    n = spark.range(10_000).selectExpr("id AS fn")
    comp = C.scc(e, n)
    assert comp.where("fn <> scc").isEmpty()
    first = len(written)
    lev = C.levels(C.condense(e, comp), comp)
    assert lev.where("level <> 9999 - scc").isEmpty() and lev.count() == 10_000
    # Sixteen doublings each, and what comes before and after them.
    assert first <= 26 and len(written) - first <= 20


def test_loops_have_a_limit(spark):
    e, n = frames(spark, ring(0, 4) + ring(2, 5), range(7))
    with pytest.raises(fixpoint.DidNotSettle):
        C.scc(e, n, most_rounds=1)


def test_summaries_go_when_their_last_caller_has_read_them(spark):
    """Forty functions in ten towers of four over one leaf: the leaf is read by all, and no more than
    two summaries of a tower are ever kept."""
    edges = [(10 * t + k, 10 * t + k + 1) for t in range(1, 11) for k in range(3)] + [(10 * t + 3, 0) for t in range(1, 11)]
    nodes = sorted({x for e in edges for x in e})
    e, n = frames(spark, edges, nodes)
    steps = [C.Step("names", lambda fns, now, earlier: {str(f) for f in fns})]
    stored: list[int] = []
    everything = {(r["scc"], r["summary"]) for r in C.bottom_up(e, n, steps, stored=stored).collect()}
    r = reach(edges, nodes)
    assert everything == {(a, str(b)) for a in nodes for b in r[a]}
    # Names kept after each round: the leaf's; then what each tower's highest function that is still read has.
    assert stored == [1, 20, 30, 40, 0]
    roots = {(r["scc"], r["summary"]) for r in C.bottom_up(e, n, steps, roots_only=True).collect()}
    assert roots == {(a, s) for a, s in everything if a % 10 == 0 and a}


def test_steps_read_bodies_and_keep_to_their_own(spark):
    # 1 calls the pair 2 <-> 3, which calls 4; each function's rows are its marks.
    e, n = frames(spark, [(1, 2), (2, 3), (3, 2), (3, 4)], (1, 2, 3, 4))
    bodies = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, None), (4, "d")], "fn long, mark string")

    def own(fns, now, earlier, rows):
        marks = {r["mark"] for f in fns for r in rows[f] if r["mark"]}
        return {f"{m}>{''.join(sorted(x for x in now if len(x) == 1))}" for m in marks} | marks

    got = C.bottom_up(e, n, [C.Step("own", own, bodies=True, inherits=False)], bodies).collect()
    by = {}
    for r in got:
        by.setdefault(r["scc"], set()).add(r["summary"])
    assert by[4] == {"d", "d>", "d>d"} and {"b", "c", "b>d", "b>bcd"} <= by[2] and "d" not in by[2] and {"a", "a>bc"} <= by[1]


def test_many_small_components_are_no_group_each(spark):
    """What a round costs goes by its rows: fifteen thousand functions that call nothing add seconds to what
    a hundred take, not milliseconds each."""

    def seconds(n):
        e, nodes = frames(spark, [(0, 1)], range(n))
        began = time.monotonic()
        made = C.bottom_up(e, nodes, [C.Step("own", lambda fns, now, earlier: {str(f) for f in fns})])
        assert made.count() == n + 1
        return time.monotonic() - began

    seconds(100)
    few = seconds(100)
    assert seconds(15_000) - few < 15
