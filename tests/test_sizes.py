"""What the planner and the driver are told of a table's size."""

from pyspark.sql import functions as F

from factloom.operators.artefacts import Artefacts
from factloom.operators.graphs import control_text, icfg_text
from factloom.operators.ir import _special, function_nodes
from factloom.operators.pointsto import TypePointsTo, andersen
from factloom.plans.fixpoint import _during, cut, drop
from factloom.sources.facts import EventProgram, Program


def test_written_tables_are_as_large_as_their_rows(spark):
    """Rows of few distinct values pack to a hundredth of their size; as a broadcast they would not."""
    n = 2_000_000
    t = cut(spark.range(n).select(F.floor(F.col("id") / 1000).alias("fn"), (F.col("id") % 7).alias("b"), F.lit("br").alias("op")))
    assert int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= 16 * n
    joined = spark.range(n).join(t.where("op = 'br'").select("fn"), F.col("id") == F.col("fn"))
    assert "Broadcast" not in joined._jdf.queryExecution().sparkPlan().toString()
    drop(t)


def test_pairs_of_one_type_go_to_many_tasks(spark):
    """A type that all values and functions have is not one task's, and pairs are not shuffled again."""
    values = spark.range(300).select(F.col("id").alias("value_id"), F.lit("t").alias("type_id"), F.lit("f").alias("pointee_type_id"))
    fns = spark.range(500).select((F.col("id") + 1000).alias("fn_id"), F.lit("f").alias("type_id"))
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    old = [spark.conf.get(k) for k in keys]
    try:
        for k, v in zip(keys, ("-1", "false", "8"), strict=True):
            spark.conf.set(k, v)
        made = TypePointsTo(values, fns).by_type()
        sizes = [n for n, in made.groupBy(F.spark_partition_id()).agg(F.count("*")).select("count(1)").collect()]
        assert sum(sizes) == 150_000 and max(sizes) < 75_000
        assert made.distinct().count() == 150_000
    finally:
        for k, v in zip(keys, old, strict=True):
            spark.conf.set(k, v)


def test_written_instructions_are_not_broadcast(spark, tmp_path):
    """A log packs to less than a broadcast may have while its instructions do not."""
    n = 400_000
    rows = spark.range(n).selectExpr("id AS event_id", "id % 100 AS user_id", "timestamp_seconds(id) AS ts", "'view' AS event_type", "0D AS value", "'{\"k\": 1}' AS props")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    p = EventProgram.read(spark, str(tmp_path))
    held = p.written()
    assert held.ins.count() == n and held.blk.count() == n // 4
    left = spark.range(10 * n).select(F.col("id").alias("iid"))
    plan = lambda ins: left.join(ins, "iid")._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" in plan(p.ins) and "Broadcast" not in plan(held.ins)
    held.release()


def test_statements_that_write_broadcast_little(spark):
    """What a session would broadcast is shuffled by a statement of a loop, and the session's setting comes back."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    with _during(spark):
        assert int(spark.conf.get(key).removesuffix("b")) <= 1 << 20
    assert spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() == 10 << 20


def test_calls_that_name_functions_solve_nothing(spark):
    """The graph's text asks what pointers hold only where a call goes through one."""
    direct = Program.from_rows(
        spark, functions=[("m", 1, "f", False, 5), ("m", 2, "g", False, 5)], blocks=[(1, 0, 0, "b0"), (2, 0, 0, "b0")],
        instructions=[(10, 1, 0, 0, "call", None, None, None), (11, 1, 0, 1, "ret", None, None, None), (20, 2, 0, 0, "ret", None, None, None)], operands=[(10, "callee", 0, 2, None)],
    )
    a = Artefacts.of(direct)
    lines = {r["line"] for r in icfg_text(a, function_nodes(direct)).collect()}
    assert any(x.startswith("  10 -> 20 ") for x in lines) and any(x.startswith("  20 -> -10 ") for x in lines)
    assert "solved" not in a.made
    a.release()


def test_constraints_are_made_once(spark):
    """Rounds read the constraints; they do not make them again."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(x):
        made.add(1)
        return x

    none = spark.createDataFrame([], "x long, y long")
    copy = spark.range(6).repartition(2).select((F.col("id") + 1).alias("x"), seen("id").alias("y"))
    got = andersen(spark.createDataFrame([(0, 100)], "x long, l long"), copy, none, none)
    assert sorted(tuple(r) for r in got.collect()) == [(i, 100) for i in range(7)]
    assert made.value == 6


def test_names_are_taken_apart_in_many_tasks(spark):
    """A small table of names is work for more than one task; other kinds of names are not looked at, and a mark
    before a name stays allowed."""
    names = ["_ZTI1C", "@_ZTI1D", "_ZTV1C", "main", None] * 40
    p = Program.from_rows(spark, globals=[(i, n, "global", 0, None) for i, n in enumerate(names)])
    p._tables["globals"] = p.globals.coalesce(1)
    got = _special(p, "TI")
    assert sorted({r["name"] for r in got.collect()}) == ["@_ZTI1D", "_ZTI1C"] and got.count() == 80
    assert got.select(F.spark_partition_id()).distinct().count() > 1


def test_statements_that_write_heed_no_limit_of_running_joins(spark):
    """A session's own limit for joins that are planned again as they run does not stand above that of a loop."""
    key = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    spark.conf.set(key, str(100 << 20))
    try:
        with _during(spark):
            assert int(spark.conf.get(key).removesuffix("b")) <= 1 << 20
        assert int(spark.conf.get(key).removesuffix("b")) == 100 << 20
    finally:
        spark.conf.unset(key)


def test_texts_of_graphs_are_not_broadcast(spark):
    """A graph's text is a query's last statement: by the session's limit small tables of blocks and of control
    dependences would go through the driver."""
    p = Program.from_rows(
        spark, functions=[("m", 1, "f", False, 5)], blocks=[(1, 0, 0, "b0"), (1, 1, 1, "b1"), (1, 2, 2, "b2")],
        instructions=[(10, 1, 0, 0, "br", None, None, None), (11, 1, 1, 0, "br", None, None, None), (12, 1, 2, 0, "ret", None, None, None)],
        operands=[(10, "true_bb", 0, None, 1), (10, "false_bb", 0, None, 2), (11, "dest", 0, None, 2)],
    )
    a = Artefacts.of(p)
    text = control_text(a)
    assert "Broadcast" not in text._jdf.queryExecution().sparkPlan().toString()
    lines = [r["line"] for r in text.collect()]
    assert [x for x in lines if "->" in x] == ["  11 -> 10;"] and len(lines) == 7
    a.release()
