from factloom.sources.schema import TABLES
from factloom.streaming import facts


def test_counts_follow_the_files(spark, tmp_path):
    rows = [(1, "arg", 0, 7, None), (2, "arg", 0, 7, None), (2, "arg", 1, 8, None)]
    for i, part in enumerate((rows[:1], rows[1:])):
        spark.createDataFrame(part, TABLES["operands"]).write.mode("append").parquet(f"{tmp_path}/operands")
        q = facts.use_counts(facts.read_table(spark, f"{tmp_path}/operands", "operands")).writeStream.outputMode("complete").format("memory").queryName(f"uses{i}")
        q = q.option("checkpointLocation", f"{tmp_path}/state{i}").trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("uses1").collect())) == [(7, 2), (8, 1)]


def test_calls_are_stateless(spark, tmp_path):
    spark.createDataFrame([(1, 5, 0, 0, "call", None, None, None), (2, 5, 0, 1, "add", None, None, None)], TABLES["instructions"]).write.parquet(f"{tmp_path}/i")
    q = facts.calls(facts.read_table(spark, f"{tmp_path}/i", "instructions")).writeStream.format("memory").queryName("calls").option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert list(map(tuple, spark.table("calls").collect())) == [(1, 5)]
