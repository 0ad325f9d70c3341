"""Small hand-encoded instruction facts."""

from factloom.operators import ir
from factloom.sources.facts import Program


def inst(i, op, fn=1, block=10, ord=None, pred=None, type_id=0):
    return (i, fn, block, i if ord is None else ord, op, type_id, None, pred)


def pairs(df):
    return sorted(map(tuple, df.collect()))


def test_flow_edges_and_null_tests(spark):
    # b10: c = icmp eq v, null; br c, b11, b12   b11: ret   b12: invoke ... b13 unwind b14
    p = Program.from_rows(
        spark,
        instructions=[inst(1, "icmp", pred="eq"), inst(2, "br"), inst(3, "ret", block=11), inst(4, "invoke", block=12), inst(5, "unreachable", block=13), inst(6, "resume", block=14), inst(7, "icmp", pred="ne", ord=0), inst(8, "icmp", pred="slt", ord=0)],
        operands=[
            (1, "cmp1", 0, 90, None), (1, "cmp2", 0, 99, None), (2, "cond", 0, 1, None), (2, "true_bb", 0, None, 11), (2, "false_bb", 0, None, 12),
            (4, "normal_bb", 0, None, 13), (4, "unwind_bb", 0, None, 14),
        ],
        constants=[(99, "null", None, None, None)],
    )
    assert [tuple(r)[:4] for r in sorted(ir.flow_edges(p).collect(), key=str)] == sorted(
        [(1, 10, 11, "true"), (1, 10, 12, "false"), (1, 11, -1, "other"), (1, 12, 13, "other"), (1, 12, 14, "unwind"), (1, 13, -1, "other"), (1, 14, -1, "other")], key=str
    )
    assert pairs(ir.branch_null_tests(p)) == [(1, 10, 90, 11, 12)]
    tests = spark.createDataFrame([(1, 10, 90, 11, 12), (1, 11, None, None, None), (1, 12, None, None, None)], "fn long, b long, value long, null_block long, other_block long")
    e = ir.flow_edges(p).select("fn", "src", "dst")
    from factloom.operators import flow  # entry is block 10 here

    assert flow.reachable_from_entry(e, 10).count() >= 4 and tests.count() == 3


def test_increments(spark):
    # x + 1, 1 + x, x - -1 stored back; x - 1; atomic sub; a store elsewhere does not count
    ops, ins, i = [], [], 10
    for op, left, right, to in (("add", "L", 1, "a"), ("add", 1, "L", "a"), ("sub", "L", -1, "a"), ("sub", "L", 1, "a"), ("sub", -1, "L", "a"), ("add", "L", 1, "b")):
        ids = {1: 91, -1: 92, "L": i}
        addr = {"a": 80, "b": 81}
        ins += [inst(i, "load"), inst(i + 1, op), inst(i + 2, "store")]
        ops += [(i, "address", 0, 80, None), (i + 1, "lhs", 0, ids[left], None), (i + 1, "rhs", 0, ids[right], None), (i + 2, "address", 0, addr[to], None), (i + 2, "value", 0, i + 1, None)]
        i += 3
    ins.append(inst(i, "atomicrmw", pred="sub"))
    ops += [(i, "pointer", 0, 81, None), (i, "value", 0, 91, None)]
    p = Program.from_rows(spark, instructions=ins, operands=ops, constants=[(91, "int", 1, None, None), (92, "int", -1, None, None)])
    assert pairs(ir.increments(p)) == [(12, 80, 1), (15, 80, 1), (18, 80, 1), (21, 80, -1), (28, 81, -1)]


def test_classes_from_globals(spark):
    p = Program.from_rows(
        spark,
        globals=[(1, "_ZTI4Base", "global", 0, 11), (2, "_ZTI7Derived", "global", 0, 12), (3, "_ZTV7Derived", "global", 0, 13), (4, "other", "global", 0, None)],
        constants=[(11, "struct", None, [90], None), (12, "struct", None, [90, 21], None), (21, "value", None, None, 31), (13, "array", None, [90, 2, 41, 42, 90, 43], None), (90, "null", None, None, None)],
        operands=[(31, "casted", 0, 1, None)],
        functions=[("m", 41, "f", False, 0), ("m", 42, "g", False, 0), ("m", 43, "h", False, 0)],
    )
    assert pairs(ir.class_parents(p)) == [("Base", "Derived")]
    assert pairs(ir.vtables(p)) == [("Derived", 0, 41), ("Derived", 1, 42)]


def test_vtable_slot_shapes(spark):
    ins = [inst(1, "bitcast"), inst(2, "load"), inst(3, "getelementptr"), inst(4, "load"), inst(5, "call")]
    ops = [(1, "casted", 0, 60, None), (2, "address", 0, 1, None), (3, "base", 0, 2, None), (3, "index", 0, 93, None), (4, "address", 0, 3, None), (5, "callee", 0, 4, None), (5, "arg", 0, 60, None)]
    ins += [inst(6, "load"), inst(7, "call")]  # slot 0: load(load(bitcast this))
    ops += [(6, "address", 0, 2, None), (7, "callee", 0, 6, None), (7, "arg", 0, 60, None)]
    ins += [inst(8, "getelementptr"), inst(9, "load"), inst(10, "load"), inst(11, "call")]
    ops += [(8, "base", 0, 60, None), (8, "index", 0, 90, None), (8, "index", 1, 90, None), (9, "address", 0, 8, None), (10, "address", 0, 9, None), (11, "callee", 0, 10, None), (11, "arg", 0, 60, None)]
    ins += [inst(12, "bitcast"), inst(13, "getelementptr"), inst(14, "bitcast"), inst(15, "load"), inst(16, "call")]
    ops += [(12, "casted", 0, 9, None), (13, "base", 0, 12, None), (13, "index", 0, 96, None), (14, "casted", 0, 13, None), (15, "address", 0, 14, None), (16, "callee", 0, 15, None), (16, "arg", 0, 60, None)]
    p = Program.from_rows(spark, instructions=ins, operands=ops, constants=[(90, "int", 0, None, None), (93, "int", 3, None, None), (96, "int", 16, None, None)])
    assert pairs(ir.vtable_slots(p)) == [(5, 60, 3), (7, 60, 0), (11, 60, 0), (16, 60, 2)]
