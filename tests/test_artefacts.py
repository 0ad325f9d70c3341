"""Relations that are made once, and go with what they were made of."""

import os

import pytest

from factloom.operators import ir
from factloom.operators.artefacts import Artefacts
from factloom.plans import fixpoint
from factloom.plans.catalogue import Catalogue, release_shared
from factloom.sources import event_pointers
from factloom.sources.facts import EventProgram, Program


def folders(spark):
    root = fixpoint.shared_folder(spark).removeprefix("file:")
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_catalogue(spark):
    made = []
    c = Catalogue()
    c.add("a", lambda: made.append("a") or spark.range(3))
    c.add("b", lambda a: made.append("b") or a.selectExpr("id + 1 AS id"), "a")
    c.add("c", lambda a, b: made.append("c") or a.join(b, "id"), "a", "b")
    before = folders(spark)
    assert c.get("c").count() == 2 and c.get("b").count() == 3 and made == ["a", "b", "c"] and "c" in c
    assert len(folders(spark) - before) == 3
    c.release("b")
    assert c.made == ("a",) and len(folders(spark) - before) == 1
    assert c.get("c").count() == 2 and made == ["a", "b", "c", "b", "c"]
    c.release()
    assert folders(spark) == before and c.made == ()
    with pytest.raises(KeyError):
        c.add("d", lambda: None, "nothing")
    with pytest.raises(KeyError):
        c.add("a", lambda: None)


def test_a_program_has_one_set_of_artefacts(spark, monkeypatch):
    p = Program.from_rows(spark, instructions=[(10, 1, 0, 0, "br", None, None, None), (11, 1, 1, 0, "ret", None, None, None)], operands=[(10, "dest", 0, None, 1)], functions=[("m", 1, "f", False, 0)])
    calls = []
    monkeypatch.setattr(ir, "flow_edges", lambda program, f=ir.flow_edges: calls.append(1) or f(program))
    a = Artefacts.of(p)
    assert Artefacts.of(p) is a and Artefacts.of(a) is a
    assert sorted(map(tuple, a["idom"].collect())) == [(1, 1, 0)] and sorted(map(tuple, a["ipdom"].collect())) == [(1, 0, 1)]
    assert sorted(map(tuple, a["steps"].collect())) == [(10, 11), (11, -1)] and len(calls) == 1
    assert a["calls"].isEmpty() and a["components"].collect()[0]["scc"] == 1
    assert {"flow", "idom", "ipdom", "body", "steps", "solved", "points_to", "calls", "components"} == set(a.made)
    a.release("flow")
    assert set(a.made) == {"body", "solved", "points_to", "calls", "components"}
    p.drop()
    assert a.made == ()


def test_queries_share_the_facts_of_a_log_until_it_changes(spark, tmp_path):
    def log(n):
        rows = [(i, i % 3, ("view", "click", "signup", "purchase", "error")[(i * 7 + i // 5) % 5], i, f'{{"k": {i * 13 % 40}}}') for i in range(n)]
        spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts long, props string").write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")

    log(60)
    first = event_pointers.facts(EventProgram.read(spark, str(tmp_path)))
    n = first.instructions.count()
    assert event_pointers.facts(EventProgram.read(spark, str(tmp_path))) is first
    flow = Artefacts.of(first)["flow"]
    assert flow.count() > 0
    log(90)
    second = event_pointers.facts(EventProgram.read(spark, str(tmp_path)))
    assert second is not first and second.instructions.count() > n and Artefacts.of(first).made == ()
    held = folders(spark)
    release_shared(spark, Program.drop)
    assert len(folders(spark)) < len(held)
    assert event_pointers.facts(EventProgram(spark.read.parquet(f"{tmp_path}/events.parquet"))) is not second
