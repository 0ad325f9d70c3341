"""Concrete analyses over flow graphs and operand relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import closure
from ..sources.facts import Program
from . import kernels as K
from .flow import dataflow, reachable_from_entry


def uses_of(operands: DataFrame) -> DataFrame:
    """(value_id, users): the instructions that use a value, not seen through casts."""
    return operands.groupBy("value_id").agg(F.collect_set("inst_id").alias("users"))


def used_by(values: DataFrame, uses: DataFrame) -> DataFrame:
    """(value_id, users) of the given values; none is an empty list, not a missing row."""
    return values.join(uses, "value_id", "left").withColumn("users", F.coalesce("users", F.array().cast("array<bigint>")))


def no_return(edges: DataFrame, returns: DataFrame, functions: DataFrame, never: DataFrame | None = None, mode: str = "reference") -> DataFrame:
    """(fn, noreturn): whether no return block is reachable from the entry.

    ``never`` (fn, block) holds blocks with a call that never returns; by default a return after
    it still counts, ``sticky`` cuts the paths there."""
    if mode == "sticky" and never is not None:
        edges = edges.join(never.withColumnRenamed("block", "src"), ["fn", "src"], "left_anti")
        returns = returns.join(never, ["fn", "block"], "left_anti")
    live = reachable_from_entry(edges)
    can = returns.join(live, ["fn", "block"], "left_semi").select("fn", F.lit(False).alias("x")).distinct()
    return functions.select("fn").join(can, "fn", "left").select("fn", F.coalesce("x", F.lit(True)).alias("noreturn"))


def null_facts(edges: DataFrame, tests: DataFrame) -> DataFrame:
    """(fn, block, value, polarity): values that must be null (1) or not null (0) at a block's
    entry. ``tests`` is (fn, b, value, null_block, other_block): a block's branch that compares
    a value to null; facts are made on the edges only and met by intersection."""

    def meet(a, b):
        return b if a is None else a if b is None else a & b

    def edge(fact, i):
        if i.get("value") is None or i["value"] != i["value"]:
            return []
        v = int(i["value"])
        return [(int(i["null_block"]), fact | {(v, 1)}), (int(i["other_block"]), fact | {(v, 0)})]

    def emit(a, blocks, facts, suc):
        return ((b, v, p) for b, f in facts.items() if f and b != K.EXIT for v, p in f)

    ins = tests.withColumn("ord", F.lit(0))
    return dataflow(edges, ins, lambda: K.Dataflow(None, frozenset(), meet, lambda f, i: f, edge), emit, "block long, value long, polarity long")


def phi_edges(program: Program) -> DataFrame:
    """(fn, phi, at, value, block): what a phi node of block ``at`` is when it is reached from ``block``."""
    phi = program.instructions.where("opcode = 'phi'").select(F.col("inst_id").alias("phi"), F.col("fn_id").alias("fn"), F.col("block_id").alias("at"))
    return phi.join(program.operands.where("role = 'incoming'").select(F.col("inst_id").alias("phi"), F.col("value_id").alias("value"), F.col("block_id").alias("block")), "phi").select("fn", "phi", "at", "value", "block")


def returned_values(program: Program) -> DataFrame:
    """(fn, block, value): what the return of a block returns."""
    ret = program.instructions.where("opcode = 'ret'").select("inst_id", F.col("fn_id").alias("fn"), F.col("block_id").alias("block"))
    return ret.join(program.operands.where("role = 'retval'").select("inst_id", F.col("value_id").alias("value")), "inst_id").select("fn", "block", "value")


def _with_phis(returned: DataFrame, phis: DataFrame | None) -> DataFrame:
    """Returns and, marked by a phi, what phi nodes are; no column is null, so that ids stay whole."""
    none = F.lit(_NO_PHI)
    rows = returned.select("fn", "block", "value", none.alias("phi"), F.lit(0).cast("long").alias("at"))
    return rows if phis is None else rows.unionByName(phis.select("fn", "block", "value", "phi", "at"))


_NO_PHI = -(1 << 62)


def _split(right) -> tuple[list[tuple[int, int]], dict[int, list[tuple[int, int]]], dict[int, int]]:
    """(returns, phi to its (value, block) pairs, phi to its block) of a function's rows."""
    returns, phis, at = [], {}, {}
    for b, v, phi, a in zip(right["block"].tolist(), right["value"].tolist(), right["phi"].tolist(), right["at"].tolist(), strict=True):
        if phi == _NO_PHI:
            returns.append((b, v))
        else:
            phis.setdefault(phi, []).append((v, b))
            at[phi] = a
    return returns, phis, at


def block_returns(edges: DataFrame, returned: DataFrame, phis: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((fn, block, value) that a block must return, (fn, block) poisoned).

    From each return block (fn, block, value) the value goes to a predecessor when the block
    postdominates it; a block that is reached only otherwise is poisoned. A returned phi node, of
    ``phis`` (as phi_edges has them), labels no block: each of its values goes to the block that
    it comes from instead, if that is postdominated, and so on for phi nodes of phi nodes.
    Independent of the order of visits: any postdominating derivation wins, and a block with two
    values, as in a loop that returns what it last had, is poisoned."""
    import pandas as pd

    def run(key, left, right):
        e = list(zip(left["src"].tolist(), left["dst"].tolist(), strict=True))
        suc, pre = K.adjacency(e)
        ipdom = K.immediate_dominators(pre, suc, K.EXIT)
        todo, of, _ = _split(right)
        over = {b: set(K.ancestors(ipdom, b)) for b in {*pre, *suc, *(b for x in of.values() for _, b in x)}}
        label, tried, seen = {}, set(), set()
        while todo:
            b, v = todo.pop()
            if (b, v) in seen:
                continue
            seen.add((b, v))
            if v in of:
                above = of[v]
            else:
                label.setdefault(b, set()).add(v)
                above = [(v, p) for p in pre.get(b, ())]
            for w, p in above:
                if b in over[p]:
                    todo.append((p, w))
                else:
                    tried.add(p)
        rows = [(b, *vs, False) for b, vs in label.items() if len(vs) == 1]
        rows += [(p, None, True) for p in (tried - set(label)) | {b for b, vs in label.items() if len(vs) > 1}]
        out = pd.DataFrame(rows, columns=["block", "value", "poisoned"]).astype({"value": "Int64"})
        out.insert(0, "fn", key[0])
        return out

    both = edges.groupBy("fn").cogroup(_with_phis(returned, phis).groupBy("fn")).applyInPandas(run, "fn long, block long, value long, poisoned boolean")
    return both.where("NOT poisoned").select("fn", "block", "value"), both.where("poisoned").select("fn", "block")


def instruction_returns(ins: DataFrame, returns: DataFrame) -> DataFrame:
    """(fn, iid, value): the one value that a function returns once an instruction has run, where
    its block must return one. ``ins`` is (fn, b, iid), ``returns`` (fn, block, value)."""
    return ins.select("fn", F.col("b").alias("block"), "iid").join(returns, ["fn", "block"]).select("fn", "iid", "value")


def may_return(edges: DataFrame, returned: DataFrame, phis: DataFrame | None = None) -> DataFrame:
    """(fn, block, value): every value that some path from a block returns. A phi node of ``phis``
    is the value from its own block on; before that, each path has the value that comes by it."""
    import pandas as pd

    def run(key, left, right):
        _, pre = K.adjacency(zip(left["src"].tolist(), left["dst"].tolist(), strict=True))
        todo, of, at = _split(right)
        rows: set[tuple[int, int]] = set()
        while todo:
            b, v = todo.pop()
            if (b, v) in rows:
                continue
            rows.add((b, v))
            todo += [(p, w) for w, p in of[v]] if at.get(v) == b else [(p, v) for p in pre.get(b, ())]
        out = pd.DataFrame(sorted(rows), columns=["block", "value"])
        out.insert(0, "fn", key[0])
        return out

    return edges.groupBy("fn").cogroup(_with_phis(returned, phis).groupBy("fn")).applyInPandas(run, "fn long, block long, value long")


def at_instructions(facts: DataFrame, ins: DataFrame) -> DataFrame:
    """Facts of a block's entry, (fn, block, ...), at each of its instructions: for analyses whose
    facts change on edges only."""
    return ins.select("fn", F.col("b").alias("block"), "iid").join(facts, ["fn", "block"])


def scalar_effects(edges: DataFrame, ins: DataFrame, compat: bool = False) -> DataFrame:
    """(fn, arg, effect): arguments whose memory every path to the exit changes by +1 or -1
    (the last change counts). ``ins`` has arg and effect, null where an instruction has none.
    ``compat`` keeps an effect that only some paths have."""

    def meet(a, b):
        if a is None or b is None:
            return b if a is None else a
        if compat:
            return {**b, **a}
        return {k: v for k, v in a.items() if b.get(k) == v}

    def transfer(f, i):
        return f if i["effect"] is None or i["effect"] != i["effect"] else {**f, int(i["arg"]): int(i["effect"])}

    def emit(a, blocks, facts, suc):
        return list((facts.get(K.EXIT) or {}).items())

    return dataflow(edges, ins, lambda: K.Dataflow(None, {}, meet, transfer), emit, "arg long, effect long")


def _union(a, b):
    return b if a is None else a if b is None else a | b


def _live() -> K.Dataflow:
    def transfer(f, i):
        f = f or frozenset()
        if i["def_var"] == i["def_var"] and i["def_var"] is not None:
            f = f - {int(i["def_var"])}
        if i["use_var"] == i["use_var"] and i["use_var"] is not None:
            f = f | {int(i["use_var"])}
        return f

    return K.Dataflow(None, frozenset(), _union, transfer, forward=False)


def liveness(edges: DataFrame, ins: DataFrame) -> DataFrame:
    """(fn, block, var) live where the block starts. ``ins`` has use_var and def_var or null."""

    def emit(a, blocks, facts, suc):
        return ((b, v) for b, f in facts.items() if f and b != K.EXIT for v in f)

    return dataflow(edges, ins, _live, emit, "block long, var long")


def live_at(edges: DataFrame, ins: DataFrame) -> DataFrame:
    """(fn, iid, n_live): variables live at the point before each instruction; none in blocks from
    which no path leaves the function."""

    def emit(a, blocks, facts, suc):
        return ((int(i["iid"]), len(f or ())) for b, body in blocks.items() for i, f in zip(body, a.at(blocks, facts, suc, b), strict=True))

    return dataflow(edges, ins, _live, emit, "iid long, n_live long")


def _reaching() -> K.Dataflow:
    def transfer(f, i):
        if i["def_var"] is None or i["def_var"] != i["def_var"]:
            return f
        v = int(i["def_var"])
        return frozenset(x for x in f if x[0] != v) | {(v, int(i["iid"]))}

    return K.Dataflow(None, frozenset(), _union, transfer)


def reaching_definitions(edges: DataFrame, ins: DataFrame) -> DataFrame:
    """(fn, block, var, def_iid) that reach a block's entry."""
    return dataflow(edges, ins, _reaching, lambda a, blocks, facts, suc: ((b, v, d) for b, f in facts.items() if f and b != K.EXIT for v, d in f), "block long, var long, def_iid long")


def reaching_definitions_at(edges: DataFrame, ins: DataFrame) -> DataFrame:
    """(fn, iid, n_defs): definitions that reach the point after each instruction."""

    def emit(a, blocks, facts, suc):
        return ((int(i["iid"]), len(f or ())) for b, body in blocks.items() for i, f in zip(body, a.at(blocks, facts, suc, b), strict=True))

    return dataflow(edges, ins, _reaching, emit, "iid long, n_defs long")


def access_paths(steps: DataFrame) -> DataFrame:
    """(iid, root, path, n): components from the root to an instruction, first a Deref of the
    root. ``steps`` is (fn, iid, base, comp): what an instruction adds to its base's path, null for
    nothing; a null base ends the walk. A function's chains are walked together, each suffix once."""
    import pandas as pd

    none = -(1 << 63)  # a null would turn ids into floats

    def run(key, pdf):
        base = dict(zip(pdf["iid"].tolist(), [None if b == none else b for b in pdf["base"].tolist()], strict=True))
        comp = dict(zip(pdf["iid"].tolist(), pdf["comp"].tolist(), strict=True))
        done: dict[int, tuple] = {}
        on: set[int] = set()
        for start in base:
            chain, i = [], start
            while i not in done and base.get(i) is not None:
                chain.append(i)
                i = base[i]
                if i in on:  # a cycle, as unreachable code may have: its least member is its root
                    done[min(chain[chain.index(i) :])] = (min(chain[chain.index(i) :]), ("Deref",))
                    on.clear()
                    chain, i = [], start
                    continue
                on.add(i)
            on.clear()
            if i not in done:
                done[i] = (i, ("Deref",))
            for c in reversed(chain):
                root, path = done[base[c]]
                done[c] = (root, path if comp[c] is None else (*path, comp[c]))
        rows = [(i, *done[i][:1], ".".join(done[i][1]), len(done[i][1])) for i in base]
        out = pd.DataFrame(rows, columns=["iid", "root", "path", "n"])
        out.insert(0, "fn", key[0])
        return out

    return steps.withColumn("base", F.coalesce("base", F.lit(none))).groupBy("fn").applyInPandas(run, "fn long, iid long, root long, path string, n long")


def append_paths(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, base_type, end_type, comps, error) of all pairs whose base types are asked for: comps
    joined where a ends at b's base type. Paths that fit nothing have one row with the error
    EndpointTypeMismatch and no partner."""
    x = a.select(F.col("id").alias("a"), F.col("base_type"), F.col("end_type").alias("mid"), F.col("comps").alias("c1"))
    y = b.select(F.col("id").alias("b"), F.col("base_type").alias("mid"), "end_type", F.col("comps").alias("c2"))
    error = F.when(F.col("b").isNull(), F.lit("EndpointTypeMismatch"))
    return x.join(y, "mid", "left").select("a", "b", "base_type", "end_type", F.when(F.col("b").isNotNull(), F.concat("c1", "c2")).alias("comps"), error.alias("error"))


def reduce_path(paths: DataFrame, types: DataFrame) -> DataFrame:
    """(id, base_type, end_type, comps, error): without the leading component. ``types`` is (type,
    kind, elem, fields) by name: a Deref takes a pointer's element as the new base type, a Field
    that of a structure's fields, an Array an array's element. Anything else is irreducible."""
    t = types.select(F.col("type").alias("base_type"), "kind", "elem", "fields")
    op, at = F.try_element_at("comps", F.lit(1))["op"], F.try_element_at("comps", F.lit(1))["idx"]
    new = F.when((F.col("kind") == "pointer") & (op == "Deref"), F.col("elem")).when((F.col("kind") == "struct") & (op == "Field"), F.get("fields", at)).when((F.col("kind") == "array") & (op == "Array"), F.col("elem"))
    out = paths.join(t, "base_type", "left").select("id", new.alias("base_type"), "end_type", "comps")
    ok = F.col("base_type").isNotNull()
    rest = F.when(F.size("comps") > 1, F.slice("comps", 2, F.greatest(F.size("comps") - 1, F.lit(1)))).otherwise(F.slice("comps", 1, 0))
    return out.select("id", "base_type", "end_type", F.when(ok, rest).alias("comps"), F.when(~ok, F.lit("IrreducableAccessPath")).alias("error"))


def abstract_paths(paths: DataFrame) -> DataFrame:
    """(id, base_type, end_type, comps): concrete paths without their base value."""
    return paths.select("id", "base_type", "end_type", "comps")


def follow_paths(paths: DataFrame, constants: DataFrame, most_steps: int = 64) -> DataFrame:
    """(id, value_id, error): the constant that a path of fields leads to. ``paths`` is (id,
    value_id, comps), ``constants`` (value_id, ckind, elements). All but constant structures, and
    fields out of their range, end with NonConstantInPath; components other than fields with
    CannotFollowPath. Paths of one length take one step, a join, together."""
    from ..plans.fixpoint import cut

    c = constants.where("ckind = 'struct'").select(F.col("value_id").alias("at"), "elements")
    todo, out = cut(paths.select("id", F.col("value_id").alias("at"), "comps")), []
    for _ in range(most_steps):
        out.append(todo.where("size(comps) = 0").select("id", F.col("at").alias("value_id"), F.lit(None).cast("string").alias("error")))
        todo = todo.where("size(comps) > 0")
        other = F.col("comps")[0]["op"] != "Field"
        step = cut(todo.join(c, "at", "left").withColumn("to", F.when(~other, F.get("elements", F.col("comps")[0]["idx"]))))
        error = F.when(other, F.lit("CannotFollowPath")).otherwise(F.lit("NonConstantInPath"))
        out.append(step.where("to IS NULL").select("id", F.lit(None).cast("long").alias("value_id"), error.alias("error")))
        todo = step.where("to IS NOT NULL").select("id", F.col("to").alias("at"), F.expr("filter(comps, (x, i) -> i > 0)").alias("comps"))
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, out)
    raise ValueError(f"a path has more than {most_steps} components")


def externalize_path(paths: DataFrame) -> DataFrame:
    """(id, name, comps) as text that other modules understand."""
    from ..functions.names import strip_type_prefix

    return paths.select("id", strip_type_prefix("base_type").alias("name"), F.to_json("comps").alias("comps"))


def class_ancestors(parents: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, ancestor), reflexive, of (parent, child) edges."""
    up = closure(parents.select(F.col("child").alias("src"), F.col("parent").alias("dst")))
    same = classes.select(F.col("class").alias("src"), F.col("class").alias("dst"))
    return up.unionByName(same).select(F.col("src").alias("class"), F.col("dst").alias("ancestor"))


def virtual_targets(calls: DataFrame, ancestors: DataFrame, vtable: DataFrame) -> DataFrame:
    """(site, target) of (site, class, slot): the slot in the vtable of the static type and of
    every subtype; classes without a vtable, or with a short one, are passed over."""
    sub = ancestors.select(F.col("class").alias("sub"), F.col("ancestor").alias("class"))
    v = vtable.select(F.col("class").alias("sub"), "slot", F.col("fn").alias("target"))
    return calls.join(sub, "class").join(v, ["sub", "slot"]).select("site", "target").distinct()
