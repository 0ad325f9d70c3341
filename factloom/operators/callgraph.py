"""Call graphs: edges, neighbours, closures, strongly connected components, bottom-up levels.

Functions are many, so these are relational: equi-joins and fixpoints, never a whole graph in
one task, whatever its size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import DidNotSettle, closure, cut, drop, fixpoint
from ..sources.facts import Program
from ..sources.schema import UNKNOWN


def canonical(program: Program) -> DataFrame:
    """(value_id, root_id): values seen through bitcasts and aliases."""
    casts = program.instructions.where("opcode = 'bitcast'").select("inst_id").join(program.operands.where("role = 'casted'").select("inst_id", "value_id"), "inst_id").select(F.col("inst_id").alias("src"), F.col("value_id").alias("dst"))
    alias = program.globals.where("kind = 'alias' AND init_value_id IS NOT NULL").select(F.col("value_id").alias("src"), F.col("init_value_id").alias("dst"))
    hops = casts.unionByName(alias)
    far = closure(hops)
    ends = far.join(hops.select(F.col("src").alias("dst")), "dst", "left_anti")
    return ends.select(F.col("src").alias("value_id"), F.col("dst").alias("root_id"))


def call_sites(program: Program) -> DataFrame:
    """(inst_id, src, callee): calls and invokes with the callee seen through casts."""
    calls = program.instructions.where("opcode IN ('call', 'invoke')").select("inst_id", F.col("fn_id").alias("src"))
    callee = program.operands.where("role = 'callee'").select("inst_id", "value_id")
    return calls.join(callee, "inst_id").join(canonical(program), "value_id", "left").select("inst_id", "src", F.coalesce("root_id", "value_id").alias("callee"))


def targets_asked(program: Program, points_to: Callable[[], DataFrame]) -> DataFrame:
    """(value_id, target) for call_targets: what ``points_to`` gives, which is asked only where a call names
    no function. Where all calls name one, no row, and nothing is solved."""
    fns = program.functions.select(F.col("fn_id").alias("callee"))
    if call_sites(program).join(fns, "callee", "left_anti").isEmpty():
        return program.spark.createDataFrame([], "value_id long, target long")
    return points_to()


def call_targets(program: Program, points_to: DataFrame) -> DataFrame:
    """(inst_id, src, dst, kind): a direct call has its function; any other has the unknown node
    and whatever the points-to relation (value_id, target) says, as indirect."""
    sites = call_sites(program)
    fns = program.functions.select(F.col("fn_id").alias("callee"))
    direct = sites.join(fns, "callee", "left_semi").select("inst_id", "src", F.col("callee").alias("dst"), F.lit("direct").alias("kind"))
    other = sites.join(fns, "callee", "left_anti")
    indirect = other.join(points_to.select(F.col("value_id").alias("callee"), F.col("target").alias("dst")), "callee").select("inst_id", "src", "dst", F.lit("indirect").alias("kind"))
    unknown = other.select("inst_id", "src", F.lit(UNKNOWN).cast("long").alias("dst"), F.lit("unknown").alias("kind"))
    return direct.unionByName(indirect).unionByName(unknown)


def call_edges(program: Program, points_to: DataFrame) -> DataFrame:
    return call_targets(program, points_to).select("src", "dst", "kind").distinct()


def callees(edges: DataFrame) -> DataFrame:
    """(fn, callee), without the unknown node; one row however many kinds of edge."""
    return edges.where(F.col("dst") != UNKNOWN).select(F.col("src").alias("fn"), F.col("dst").alias("callee")).distinct()


def callers(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("dst") != UNKNOWN).select(F.col("dst").alias("fn"), F.col("src").alias("caller")).distinct()


def reflexive_closure(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst) over ``nodes`` (fn) and whatever they reach."""
    same = nodes.select(F.col("fn").alias("src"), F.col("fn").alias("dst"))
    return closure(edges).unionByName(same).distinct()


def project_defined(edges: DataFrame, defined: DataFrame) -> DataFrame:
    """Edges whose ends are both defined functions (fn)."""
    return edges.join(defined.select(F.col("fn").alias("src")), "src", "left_semi").join(defined.select(F.col("fn").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()


#: No loop here runs longer; one that would raises DidNotSettle.
MOST_ROUNDS = 10_000


def _spread(values: DataFrame, edges: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(fn, c): the least c of what reaches a node along (src, dst), itself included. One row a
    node; a round moves only labels that changed."""
    best = cut(values.select("fn", "c", F.lit(True).alias("moved")))
    for _ in range(most_rounds):
        moved = best.where("moved").select(F.col("fn").alias("src"), "c")
        got = edges.join(moved, "src").groupBy(F.col("dst").alias("fn")).agg(F.min("c").alias("new"))
        less = F.coalesce(F.col("new") < F.col("c"), F.lit(False))
        before, best = best, cut(best.join(got, "fn", "left").select("fn", F.when(less, F.col("new")).otherwise(F.col("c")).alias("c"), less.alias("moved")))
        drop(before)
        if best.where("moved").isEmpty():
            return best.select("fn", "c")
    raise DidNotSettle(f"{most_rounds} rounds")


def _chains(left: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """((fn, u, w) of nodes between u and w with one way in and one way out all along, (fn, c) of
    nodes on a ring of such nodes); None without any. Both ends are found by doubling."""
    ins = left.groupBy(F.col("dst").alias("fn")).agg(F.count("*").alias("n_in"), F.min("src").alias("u"))
    outs = left.groupBy(F.col("src").alias("fn")).agg(F.count("*").alias("n_out"), F.min("dst").alias("w"))
    at = cut(ins.join(outs, "fn").where("n_in = 1 AND n_out = 1").select("fn", "u", "w", F.least("fn", "w").alias("c"), F.lit(True).alias("open")))
    n = at.count()
    if not n:
        drop(at)
        return None
    # After as many rounds a pointer that is still within has passed every node of its ring.
    for _ in range(n.bit_length() + 1):
        ahead = at.select(F.col("fn").alias("w"), F.col("w").alias("w2"), F.col("c").alias("c2"))
        back = at.select(F.col("fn").alias("u"), F.col("u").alias("u2"))
        step = at.join(ahead, "w", "left").join(back, "u", "left")
        before, at = at, cut(step.select("fn", F.coalesce("u2", "u").alias("u"), F.coalesce("w2", "w").alias("w"), F.least("c", "c2").alias("c"), (F.col("u2").isNotNull() | F.col("w2").isNotNull()).alias("open")))
        drop(before)
        if at.where("open").isEmpty():
            break
    inner = at.select(F.col("fn").alias("w"))
    return at.join(inner, "w", "left_anti").select("fn", "u", "w"), at.join(inner, "w", "left_semi").select("fn", "c")


def scc(edges: DataFrame, nodes: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(fn, scc): the least function of each strongly connected component.

    Three steps alternate until no edge is left. Nodes without an edge in, or out of, what is left
    are components of their own and go. Nodes with one way in and one way out go too, replaced by
    an edge past them: they belong to a component that holds both ends of their chain, else to
    none. Then every node takes the least of the random colours of what reaches it: a component
    has one colour, so edges between colours go, and what reaches a colour's own node within it is
    that node's component. Everything is one row a node and one an edge."""
    left = cut(edges.select("src", "dst").where("src <> dst").distinct())
    found: list[DataFrame] = []
    passed: list[DataFrame] = []
    n = left.count()
    for _ in range(most_rounds):
        while n:
            ins, outs = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
            before, left = left, cut(left.join(ins, "src", "left_semi").join(outs, "dst", "left_semi"))
            drop(before)
            m, n = n, left.count()
            if m - n <= m // 8:  # what is left of long tails goes with the chains
                break
        if not n:
            break
        if chain := _chains(left):
            between, ring = cut(chain[0]), cut(chain[1])
            passed.append(between)
            found.append(ring)
            gone = between.select("fn").union(ring.select("fn"))
            rest = left.join(gone.withColumnRenamed("fn", "src"), "src", "left_anti").join(gone.withColumnRenamed("fn", "dst"), "dst", "left_anti")
            before, left = left, cut(rest.select("src", "dst").union(between.where("u <> w").select("u", "w")).distinct())
            drop(before)
            m, n = n, left.count()
            if n <= m // 2:
                continue
        core = left.select(F.col("src").alias("fn")).union(left.select(F.col("dst"))).distinct()
        own = F.struct(F.xxhash64("fn").alias("h"), F.col("fn").alias("root"))
        colour = cut(_spread(core.withColumn("c", own), left, most_rounds).select("fn", F.col("c.root").alias("c")))
        c1, c2 = colour.select(F.col("fn").alias("src"), F.col("c").alias("cs")), colour.select(F.col("fn").alias("dst"), F.col("c").alias("cd"))
        within = cut(left.join(c1, "src").join(c2, "dst").where("cs = cd").select("src", "dst"))
        back = within.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        reach = _spread(colour.select("fn", F.when(F.col("fn") == F.col("c"), F.lit(0)).otherwise(F.lit(1)).alias("c")), back, most_rounds)
        got = cut(reach.where("c = 0").select("fn").join(colour, "fn"))
        found.append(got)
        gone = got.select("fn")
        before, left = left, cut(within.join(gone.withColumnRenamed("fn", "src"), "src", "left_anti").join(gone.withColumnRenamed("fn", "dst"), "dst", "left_anti"))
        drop(before, within, colour)
        n = left.count()
    else:
        raise DidNotSettle(f"{most_rounds} rounds")
    drop(left)
    if not found and not passed:
        return nodes.select("fn", F.col("fn").alias("scc"))
    one = reduce(DataFrame.unionByName, found) if found else nodes.select("fn", F.col("fn").alias("c")).limit(0)
    # Chains come back last in, first out: their ends may have been on chains of a later round.
    for between in reversed(passed):
        u, w = one.select(F.col("fn").alias("u"), F.col("c").alias("cu")), one.select(F.col("fn").alias("w"), F.col("c").alias("cw"))
        ends = between.join(u, "u", "left").join(w, "w", "left").select("fn", "u", F.coalesce("cu", "u").alias("cu"), F.coalesce("cw", "w").alias("cw")).where("cu = cw")
        inner = ends.select("fn", F.col("cu").alias("c"))
        # An end that was not found before is now in a component with its chain.
        outer = ends.where("u = cu").select(F.col("u").alias("fn"), F.col("cu").alias("c")).distinct()
        one = cut(one.unionByName(inner).unionByName(outer).distinct())
    least = one.groupBy("c").agg(F.min("fn").alias("scc"))
    named = one.join(least, "c").select("fn", "scc")
    return nodes.join(named, "fn", "left").select("fn", F.coalesce("scc", "fn").alias("scc"))


def condense(edges: DataFrame, comp: DataFrame) -> DataFrame:
    """(src, dst) between components, without self-edges."""
    a = edges.select("src", "dst").join(comp.select(F.col("fn").alias("src"), F.col("scc").alias("s")), "src")
    b = a.join(comp.select(F.col("fn").alias("dst"), F.col("scc").alias("d")), "dst")
    return b.where("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct()


def levels(condensed: DataFrame, comp: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(scc, level): 0 where nothing is called, else one more than the highest callee.

    Every component follows one callee; how far that leads is found by doubling, so the rounds are
    the logarithm of the longest chain. Components with a callee that leads further turn to it,
    until none has one. One row a component and one an edge, whatever the paths."""
    edges = cut(condensed.select("src", "dst").distinct())
    follow = cut(edges.groupBy("src").agg(F.min("dst").alias("to")))
    for _ in range(most_rounds):
        # (src, to, n): n calls lead to a component that calls nothing, or to one further on.
        far = cut(follow.select("src", "to", F.lit(1).cast("long").alias("n"), F.lit(True).alias("open")))
        for _ in range(64):
            ahead = far.select(F.col("src").alias("to"), F.col("to").alias("to2"), F.col("n").alias("n2"))
            before, far = far, cut(far.join(ahead, "to", "left").select("src", F.coalesce("to2", "to").alias("to"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), F.col("n2").isNotNull().alias("open")))
            drop(before)
            if far.where("open").isEmpty():
                break
        height = far.select(F.col("src").alias("dst"), F.col("n").alias("h"))
        best = edges.join(height, "dst", "left").groupBy("src").agg(F.max(F.struct(F.coalesce("h", F.lit(0)).alias("h"), F.col("dst").alias("to"))).alias("b"))
        turned = far.select("src", "n").join(follow, "src").join(best, "src").select("src", F.when(F.col("b.h") + 1 > F.col("n"), F.col("b.to")).otherwise(F.col("to")).alias("to"), (F.col("b.h") + 1 > F.col("n")).alias("turned"))
        before, follow = follow, cut(turned)
        drop(before)
        if follow.where("turned").isEmpty():
            got = cut(far.select(F.col("src").alias("scc"), F.col("n").alias("level")))
            drop(far, follow, edges)
            return comp.select("scc").distinct().join(got, "scc", "left").select("scc", F.coalesce("level", F.lit(0).cast("long")).alias("level"))
        drop(far)
    raise DidNotSettle(f"{most_rounds} rounds")


@dataclass
class Step:
    """One analysis of a composed bottom-up traversal. ``fn(members, callee_facts, earlier)``
    gives the component's summary from its functions, the summaries of what they call, and the
    summaries that earlier steps made for the component; it runs until nothing changes. A step
    with ``bodies`` gets a fourth argument, the rows of each member (function to list of dicts).
    Without ``inherits`` a component's summary does not take over those of its callees, and
    ``callee_facts`` holds them beside what the component has so far."""

    name: str
    fn: Callable
    depends_on: tuple[str, ...] = ()
    bodies: bool = False
    inherits: bool = True


def bottom_up(edges: DataFrame, nodes: DataFrame, steps: list[Step], bodies: DataFrame | None = None, roots_only: bool = False, stored: list[int] | None = None) -> DataFrame:
    """(scc, step, summary): summaries of all components, or of those that nothing calls.

    A relation counts, for each component, the callees that are still open and the callers that
    have still to read it. A round takes all components without an open callee, a row each, with
    the summaries of what they call; then their callers wait for less, and summaries that the
    last caller has read are dropped. ``stored``, if given, gets the number of summaries that each
    round left to be read. ``bodies`` (fn, ...) are rows that steps may read of each function.

    Summaries are strings, merged as sets, so the order of merging does not matter. A step's
    dependencies must precede it. A component's functions, and their rows, go to one task."""
    done: set[str] = set()
    for s in steps:
        if not set(s.depends_on) <= done:
            raise ValueError(f"{s.name} depends on steps that do not precede it")
        done.add(s.name)
    comp = cut(scc(edges, nodes))
    cond = cut(condense(edges, comp))
    out_of, into = cond.groupBy(F.col("src").alias("scc")).agg(F.count("*").alias("waits")), cond.groupBy(F.col("dst").alias("scc")).agg(F.count("*").alias("readers"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    # top: nothing calls it.
    state = cut(comp.select("scc").distinct().join(out_of, "scc", "left").join(into, "scc", "left").select("scc", zero("waits"), zero("readers"), F.col("readers").isNull().alias("top")))
    read = bodies is not None
    of = comp.join(bodies, "fn", "left") if read else comp
    # One row a component: most rounds have many small ones, and a task takes them in batches, not as a group each.
    members = cut(of.groupBy("scc").agg(F.collect_list(F.struct("fn", *([c for c in bodies.columns if c != "fn"] if read else []))).alias("members")))

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("scc", pa.int64()), ("step", pa.string()), ("summary", pa.string())])
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                rows: dict[int, list[dict]] = {}
                for m in r["members"]:
                    rows.setdefault(m.pop("fn"), []).append(m)
                fns = sorted(rows)
                callee: dict[str, set[str]] = {}
                for x in r["below"] or ():
                    callee.setdefault(x["step"], set()).add(x["summary"])
                mine: dict[str, set[str]] = {}
                for s in steps:
                    below = set(callee.get(s.name, ()))
                    now = below if s.inherits else set()
                    while True:
                        new = now | set(s.fn(fns, now | below, mine, *([rows] if s.bodies else [])))
                        if new == now:
                            break
                        now = new
                    mine[s.name] = now
                out += [{"scc": r["scc"], "step": n, "summary": v} for n, vs in mine.items() for v in sorted(vs)]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    empty = cond.sparkSession.createDataFrame([], "scc long, step string, summary string")
    held, kept = empty, []
    while not (ready := state.where("waits = 0")).isEmpty():
        here = members.join(ready.select("scc"), "scc", "left_semi")
        calls = cond.join(ready.select(F.col("scc").alias("src")), "src", "left_semi")
        below = calls.join(held.withColumnRenamed("scc", "dst"), "dst").select(F.col("src").alias("scc"), "step", "summary").distinct()
        told = below.groupBy("scc").agg(F.collect_list(F.struct("step", "summary")).alias("below"))
        made = cut(here.join(told, "scc", "left").select("scc", "members", "below").mapInArrow(run, "scc long, step string, summary string"))
        closed = cond.join(ready.select(F.col("scc").alias("dst")), "dst", "left_semi").groupBy(F.col("src").alias("scc")).agg(F.count("*").alias("closed"))
        heard = calls.groupBy(F.col("dst").alias("scc")).agg(F.count("*").alias("heard"))
        # Components that are done stay as long as they are read, with a negative wait.
        left = F.when(F.col("waits") == 0, F.lit(-1)).otherwise(F.col("waits") - F.coalesce("closed", F.lit(0))).cast("long")
        then = cut(state.join(closed, "scc", "left").join(heard, "scc", "left").select("scc", left.alias("waits"), (F.col("readers") - F.coalesce("heard", F.lit(0))).alias("readers"), "top").where("waits >= 0 OR readers > 0"))
        wanted = then.where("waits < 0 AND readers > 0").select("scc")
        before, held = held, cut(held.unionByName(made).join(wanted, "scc", "left_semi"))
        if stored is not None:
            stored.append(held.count())
        if roots_only:
            kept.append(cut(made.join(ready.where("top").select("scc"), "scc", "left_semi")))
            drop(made)
        else:
            kept.append(made)
        if len(kept) > 8:
            merged = cut(reduce(DataFrame.unionByName, kept))
            drop(*kept)
            kept = [merged]
        drop(before, state)
        state = then
    drop(held, state, comp, cond, members)
    return reduce(DataFrame.unionByName, kept) if kept else empty


def reaching_maximum(edges: DataFrame, values: DataFrame) -> DataFrame:
    """(fn, best): the greatest value (fn, value) of what a function reaches, itself included. A
    bottom-up summary with an idempotent merge, as a fixpoint that carries one row a function."""
    best = cut(values.groupBy("fn").agg(F.max("value").alias("best")))
    e = cut(edges.select("src", "dst").distinct())
    changed = best
    for _ in range(MOST_ROUNDS):
        if changed.isEmpty():
            return best
        got = e.join(changed.withColumnRenamed("fn", "dst"), "dst").groupBy(F.col("src").alias("fn")).agg(F.max("best").alias("new"))
        up = best.join(got, "fn", "full_outer")
        changed = cut(up.where("new IS NOT NULL AND (best IS NULL OR new > best)").select("fn", F.col("new").alias("best")))
        best = cut(best.join(changed.withColumnRenamed("best", "new"), "fn", "full_outer").select("fn", F.coalesce("new", "best").alias("best")))
    raise DidNotSettle(f"{MOST_ROUNDS} rounds")


__all__ = ["Step", "bottom_up", "call_edges", "call_sites", "call_targets", "callees", "callers", "canonical", "condense", "fixpoint", "levels", "project_defined", "reaching_maximum", "reflexive_closure", "scc", "targets_asked"]
