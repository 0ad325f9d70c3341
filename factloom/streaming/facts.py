"""Fact tables that arrive as files, read as streams: counts that follow the facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.schema import TABLES


def read_table(spark: SparkSession, path: str, table: str, files_per_batch: int = 100) -> DataFrame:
    """A fact table as a stream of the Parquet files under ``path``, with its explicit schema."""
    return spark.readStream.schema(TABLES[table]).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def use_counts(operands: DataFrame) -> DataFrame:
    """(value_id, n_uses): a running aggregate, for update or complete output. State is one row
    a value."""
    return operands.groupBy("value_id").agg(F.count("*").alias("n_uses"))


def calls(instructions: DataFrame) -> DataFrame:
    """(inst_id, fn_id) of calls as they arrive; stateless, for append output."""
    return instructions.where("opcode IN ('call', 'invoke')").select("inst_id", "fn_id")
