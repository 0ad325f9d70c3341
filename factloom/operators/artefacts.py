"""The artefacts of a program behind one facade: flow, dominance, control dependence, returns, null
facts, points-to and calls, each made once from what it is made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalogue import Catalogue
from ..sources.facts import Program
from . import analyses, callgraph, flow, ir
from .pointsto import Andersen, PointsTo


class Artefacts:
    """Relations by name; ``names`` lists them. Anything that takes an Artefacts takes a program as
    well, by ``Artefacts.of``, and two callers with one program share what was made.

    flow (fn, src, dst), body (fn, b, ord, iid), steps (src, dst) between instructions, live and
    idom, ipdom, dominators, postdominators of blocks, idom_inst and ipdom_inst of instructions,
    control, tests and null_facts, returned, phis, returns and poisoned, may_return, points_to
    (the functions that values may hold; by inclusion constraints unless another analysis is given,
    whose solution is solved and held), calls, components."""

    def __init__(self, program: Program, points_to: PointsTo | None = None):
        self.program = program
        c = self._catalogue = Catalogue()
        add = c.add
        add("flow", lambda: ir.flow_edges(program).select("fn", "src", "dst").distinct())
        add("body", lambda: program.instructions.where("block_id IS NOT NULL").select(F.col("fn_id").alias("fn"), F.col("block_id").alias("b"), "ord", F.col("inst_id").alias("iid")))
        add("steps", lambda b, e: flow.instruction_edges(b, e), "body", "flow")
        add("live", flow.reachable_from_entry, "flow")
        add("idom", flow.immediate_dominators, "flow")
        add("ipdom", flow.immediate_postdominators, "flow")
        add("dominators", flow.dominators, "flow")
        add("postdominators", lambda e: flow.dominators(e, post=True), "flow")
        add("idom_inst", flow.instruction_immediate_dominators, "body", "idom")
        add("ipdom_inst", lambda b, d: flow.instruction_immediate_dominators(b, d, "ipdom", post=True), "body", "ipdom")
        add("control", flow.control_dependences, "flow")
        add("tests", lambda: ir.branch_null_tests(program))
        add("null_facts", analyses.null_facts, "flow", "tests")
        add("returned", lambda: analyses.returned_values(program))
        add("phis", lambda: analyses.phi_edges(program))
        add("returns", lambda e, r, p: analyses.block_returns(e, r, p)[0], "flow", "returned", "phis")
        add("poisoned", lambda e, r, p: analyses.block_returns(e, r, p)[1], "flow", "returned", "phis")
        add("may_return", analyses.may_return, "flow", "returned", "phis")
        pts = points_to or Andersen(program)
        functions = program.functions.select(F.col("fn_id").alias("target"))
        only = lambda p: p.join(functions, "target", "left_semi").select("value_id", "target")
        if isinstance(pts, Andersen):
            add("solved", pts.solve)
            add("points_to", lambda s: only(s.select(F.col("x").alias("value_id"), F.col("l").alias("target"))), "solved")
            add("held", pts.held, "solved")
        else:
            add("points_to", lambda: only(pts.points_to()))
        add("calls", lambda p: callgraph.call_edges(program, p), "points_to")
        add("components", lambda e: callgraph.scc(callgraph.project_defined(e, self._defined()), self._defined()), "calls")

    def _defined(self) -> DataFrame:
        return self.program.functions.where("NOT is_external").select(F.col("fn_id").alias("fn"))

    @classmethod
    def of(cls, source: Artefacts | Program) -> Artefacts:
        """The artefacts of a program, the same for every caller; of artefacts, themselves."""
        if isinstance(source, cls):
            return source
        held = source.__dict__.get("_artefacts")
        if held is None:
            held = source.__dict__["_artefacts"] = cls(source)
        return held

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(self._catalogue._makers)

    @property
    def made(self) -> tuple[str, ...]:
        return self._catalogue.made

    def __getitem__(self, name: str) -> DataFrame:
        return self._catalogue.get(name)

    def release(self, *names: str) -> None:
        """Deletes the tables of the named artefacts, or of all, and of what was made of them."""
        self._catalogue.release(*names)
