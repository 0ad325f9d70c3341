"""Programs edited by relations of what goes and what comes."""

from factloom.operators import edits as E
from factloom.sources.facts import Program

I = "inst_id long, target long, place string, opcode string, type_id long, pred string"
R = "inst_id long, value_id long"
O = "inst_id long, role string, pos int, value_id long, block_id long"


def program(spark):
    """1: a = load x; b = add a, a; store b; ret b. 2 calls 1 and is called by 3; 4 is alone."""
    ins = [(11, 1, 0, 0, "load", 1, None, None), (12, 1, 0, 1, "add", 1, None, None), (13, 1, 0, 2, "store", None, None, None), (14, 1, 0, 3, "ret", None, None, None), (21, 2, 0, 0, "call", 1, None, None), (31, 3, 0, 0, "call", 1, None, None)]
    ops = [(11, "address", 0, 90, None), (12, "lhs", 0, 11, None), (12, "rhs", 0, 11, None), (13, "value", 0, 12, None), (13, "address", 0, 90, None), (14, "retval", 0, 12, None), (21, "callee", 0, 1, None), (21, "arg", 0, 92, None), (31, "callee", 0, 2, None)]
    fns = [("m", i, f"f{i}", False, 0) for i in (1, 2, 3, 4)]
    return Program.from_rows(spark, functions=fns, instructions=ins, operands=ops, arguments=[(1, 0, 90, "x", 2), (2, 0, 92, "y", 2)], blocks=[(i, 0, 0, "b") for i in (1, 2, 3)], globals=[(95, "g", "global", 2, 4)])


def code(p, fn=1):
    return [(r["inst_id"], r["opcode"]) for r in sorted(p.instructions.where(f"fn_id = {fn}").collect(), key=lambda r: r["ord"])]


def operands(p):
    return {(r["inst_id"], r["role"]): r["value_id"] for r in p.operands.collect()}


def test_replace_remove_and_insert(spark):
    p = program(spark)
    new = spark.createDataFrame([(51, 12, "instead", "mul", 1, None), (52, 13, "before", "sub", 1, None), (53, 13, "before", "xor", 1, None), (54, 13, "after", "fence", None, None)], I)
    ops = spark.createDataFrame([(51, "lhs", 0, 11, None), (52, "lhs", 0, 12, None)], O)
    done, bad = E.rewrite(p, spark.createDataFrame([(11, 90)], R), new, ops)
    assert bad.isEmpty()
    assert code(done) == [(51, "mul"), (52, "sub"), (53, "xor"), (13, "store"), (54, "fence"), (14, "ret")] and code(done, 2) == [(21, "call")]
    # Uses of what went go to what stands for it, in new instructions as well.
    got = operands(done)
    assert (got[51, "lhs"], got[52, "lhs"], got[13, "value"], got[14, "retval"]) == (90, 51, 51, 51) and (11, "address") not in got and (12, "lhs") not in got
    assert code(p) == [(11, "load"), (12, "add"), (13, "store"), (14, "ret")]


def test_values_that_are_replaced_in_turn(spark):
    done, bad = E.rewrite(program(spark), spark.createDataFrame([(12, 11), (11, 90)], R))
    assert bad.isEmpty() and operands(done)[14, "retval"] == 90 and code(done) == [(13, "store"), (14, "ret")]


def test_contradictions_are_reported_and_left_out(spark):
    gone = [(99, 90), (14, 90), (21, 90), (21, 92)]
    new = [(51, 12, "instead", "mul", 1, None), (52, 12, "before", "sub", 1, None), (53, 31, "after", "nop", 1, None), (13, 13, "before", "nop", 1, None), (54, 13, "before", "nop", 1, None), (54, 13, "after", "nop", 1, None), (55, 13, "after", "ok", 1, None)]
    done, bad = E.rewrite(program(spark), spark.createDataFrame(gone, R), spark.createDataFrame(new, I))
    assert sorted(map(tuple, bad.collect())) == [(12, E.TWICE), (12, E.TWICE), (13, E.TAKEN), (13, E.TAKEN), (13, E.TAKEN), (14, E.TERMINATOR), (21, E.TWICE), (21, E.TWICE), (31, E.AFTER_TERMINATOR), (99, E.ABSENT)]
    assert code(done) == [(11, "load"), (12, "add"), (13, "store"), (55, "ok"), (14, "ret")] and code(done, 2) == [(21, "call")]
    done, bad = E.rewrite(program(spark), spark.createDataFrame([(11, 12), (12, 11), (13, 90)], R))
    assert sorted(map(tuple, bad.collect())) == [(11, E.CIRCULAR), (12, E.CIRCULAR)] and code(done) == [(11, "load"), (12, "add"), (14, "ret")]


def test_copies(spark):
    copies = spark.createDataFrame([(1, 101, 1000, "g1"), (2, 4, 1000, "taken"), (9, 109, 1000, "none"), (3, 103, -10, "clash")], "fn_id long, copy_id long, shift long, name string")
    done, bad = E.copy_functions(program(spark), copies)
    assert sorted(map(tuple, bad.collect())) == [(2, E.TAKEN), (3, E.TAKEN), (9, E.ABSENT)]
    assert code(done, 101) == [(1011, "load"), (1012, "add"), (1013, "store"), (1014, "ret")] and len(code(done)) == 4
    got = operands(done)
    assert got[1012, "lhs"] == 1011 and got[1011, "address"] == 1090 and got[1014, "retval"] == 1012 and got[12, "lhs"] == 11
    assert {r["name"] for r in done.functions.collect()} == {"f1", "f2", "f3", "f4", "g1"} and done.blocks.where("fn_id = 101").count() == 1


def test_removed_functions(spark):
    ask = lambda *ids: spark.createDataFrame([(i,) for i in ids], "fn_id long")
    done, bad = E.remove_functions(program(spark), ask(1, 2, 4, 7))
    # 3 stays and calls 2, which calls 1; a global starts as 4.
    assert sorted(map(tuple, bad.collect())) == [(1, E.USED), (2, E.USED), (4, E.USED), (7, E.ABSENT)] and done.functions.count() == 4
    done, bad = E.remove_functions(program(spark), ask(1, 2, 3))
    assert bad.isEmpty() and [r["fn_id"] for r in done.functions.collect()] == [4] and done.instructions.isEmpty() and done.operands.isEmpty()
