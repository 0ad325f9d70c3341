"""Programs as DataFrames: from written fact tables, from rows, or from an event log.

``Program`` reads lazily and Catalyst prunes what an analysis does not use: debug metadata, for
instance, is just columns that no query selects.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..plans.catalogue import shared
from ..plans.fixpoint import cut, drop
from .schema import TABLES


class BuildError(Exception):
    """A program cannot be put together."""


class MissingTable(BuildError):
    pass


class UnknownInput(BuildError):
    pass


class Program:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame]):
        self.spark, self._tables = spark, tables

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str, pattern: str | None = None) -> Program:
        """Fact tables under ``path``; ``pattern`` picks input files by name."""
        reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
        return cls(spark, {t: reader.schema(s).parquet(f"{path}/{t}.parquet") for t, s in TABLES.items()})

    @classmethod
    def from_rows(cls, spark: SparkSession, **rows: list[tuple]) -> Program:
        """Small programs (tests): rows in the columns' order; tables not named are empty."""
        unknown = set(rows) - set(TABLES)
        if unknown:
            raise UnknownInput(f"no such tables: {sorted(unknown)}")
        return cls(spark, {t: spark.createDataFrame(rows.get(t, []), s) for t, s in TABLES.items()})

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES:
            raise AttributeError(name)
        if name not in self._tables:
            raise MissingTable(name)
        return self._tables[name]

    def drop(self) -> None:
        """Deletes the tables that were written for this program, and its artefacts."""
        held = self.__dict__.get("_artefacts")
        if held is not None:
            held.release()
        drop(*self._tables.values())

    def write(self, path: str) -> None:
        for t, df in self._tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{t}.parquet")


#: The event log read as a program: a user is a function, its events are instructions in order
#: of time, four make a block, and the last of a block is its terminator. click is a
#: conditional branch, error a branch back, purchase a return, signup a call, view plain. The
#: text is the same in Spark SQL and in the SQL of the checks.
PROXY = {
    "ins": """SELECT event_id AS iid, user_id AS fn, event_type AS op, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS ord FROM events""",
    "blk": """SELECT fn, CAST(FLOOR(ord / 4.0) AS BIGINT) AS b, max_by(op, ord) AS term, max_by(iid, ord) AS tid
  FROM ins GROUP BY fn, CAST(FLOOR(ord / 4.0) AS BIGINT)""",
    "fns": "SELECT fn, MAX(b) AS mb FROM blk GROUP BY fn",
    "cfg": """SELECT k.fn, k.b AS src, k.b + 1 AS dst FROM blk k JOIN fns f ON k.fn = f.fn WHERE k.term <> 'purchase' AND k.b < f.mb
  UNION SELECT k.fn, k.b, LEAST(k.b + 2 + k.tid % 3, f.mb) FROM blk k JOIN fns f ON k.fn = f.fn WHERE k.term = 'click' AND k.b < f.mb
  UNION SELECT k.fn, k.b, GREATEST(k.b - 2, 0) FROM blk k JOIN fns f ON k.fn = f.fn WHERE k.term = 'error' AND k.b < f.mb""",
    "cfg_exit": "SELECT k.fn, k.b AS src, CAST(-1 AS BIGINT) AS dst FROM blk k WHERE NOT EXISTS (SELECT 1 FROM cfg c WHERE c.fn = k.fn AND c.src = k.b)",
    "cg": """SELECT DISTINCT i.fn AS src, (i.fn * 7 + i.iid) % n.n AS dst FROM ins i CROSS JOIN (SELECT MAX(user_id) + 1 AS n FROM events) n
  WHERE i.op = 'signup' AND i.k % 16 = 0""",
}


def proxy_ctes(*more: str) -> str:
    """The proxy relations as the head of one SQL statement."""
    return "WITH RECURSIVE " + ",\n".join([*(f"{n} AS ({q})" for n, q in PROXY.items()), *more])


class EventProgram:
    """The proxy relations over an events table, in the DataFrame API."""

    def __init__(self, events: DataFrame, path: str | None = None):
        self.spark = events.sparkSession
        self.events, self.path = events, path

    @classmethod
    def read(cls, spark: SparkSession, sf_dir: str) -> EventProgram:
        path = f"{sf_dir}/events.parquet"
        return cls(spark.read.parquet(path), path)

    def once(self, kind: str, make: Callable[[], Program]) -> Program:
        """What ``make`` gives, once for all queries of the application over this log; without a path
        it is made each time."""
        return make() if self.path is None else shared(self.spark, kind, self.path, make, Program.drop)

    def written(self) -> EventProgram:
        """The same program with its instructions, blocks and edges written, for what reads them several
        times: the log is put in order once, and the planner sees tables of their size, where by the
        log's packed files it would send all instructions through the driver. ``release`` deletes them."""
        out = EventProgram(self.events, self.path)
        for name in ("ins", "blk", "cfg"):
            out.__dict__[name] = cut(getattr(out, name))
        return out

    def release(self) -> None:
        """Deletes what ``written`` wrote."""
        drop(*[self.__dict__.get(name) for name in ("ins", "blk", "cfg")])

    def _sql(self, name: str, **needs: DataFrame) -> DataFrame:
        return self.spark.sql(PROXY[name].replace("FROM events", "FROM {events}") if "events" in needs else PROXY[name], **needs)

    @cached_property
    def ins(self) -> DataFrame:
        from pyspark.sql import Window
        from pyspark.sql import functions as F

        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return self.events.select(
            F.col("event_id").alias("iid"), F.col("user_id").alias("fn"), F.col("event_type").alias("op"),
            F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"), (F.row_number().over(w) - 1).cast("long").alias("ord"),
        )

    @cached_property
    def blk(self) -> DataFrame:
        from pyspark.sql import functions as F

        return self.ins.withColumn("b", F.floor(F.col("ord") / 4)).groupBy("fn", "b").agg(F.max_by("op", "ord").alias("term"), F.max_by("iid", "ord").alias("tid"))

    @cached_property
    def cfg(self) -> DataFrame:
        """Edges between blocks: every block's successors from its terminator alone. The number
        of blocks is a window over the function, so building them takes one shuffle by fn."""
        from pyspark.sql import Window
        from pyspark.sql import functions as F

        b = self.blk.withColumn("mb", F.max("b").over(Window.partitionBy("fn"))).where("b < mb")
        to = F.expr(
            "array_distinct(filter(array(CASE WHEN term <> 'purchase' THEN b + 1 END, CASE WHEN term = 'click' THEN least(b + 2 + tid % 3, mb) END, "
            "CASE WHEN term = 'error' THEN greatest(b - 2, 0L) END), x -> x IS NOT NULL))"
        )
        return b.select("fn", F.col("b").alias("src"), F.explode(to).alias("dst"))

    @cached_property
    def cfg_exit(self) -> DataFrame:
        """Blocks without a successor leave the function: purchases, and each function's last."""
        from pyspark.sql import Window
        from pyspark.sql import functions as F

        b = self.blk.withColumn("mb", F.max("b").over(Window.partitionBy("fn")))
        return b.where("term = 'purchase' OR b = mb").select("fn", F.col("b").alias("src"), F.lit(-1).cast("long").alias("dst"))

    @cached_property
    def flow(self) -> DataFrame:
        """Edges with those to the virtual exit."""
        return self.cfg.unionByName(self.cfg_exit)

    @cached_property
    def calls(self) -> DataFrame:
        """Call edges between functions."""
        from pyspark.sql import functions as F

        # One row: the number of functions.
        n = self.events.agg((F.max("user_id") + 1).alias("n"))
        site = self.ins.where("op = 'signup' AND k % 16 = 0")
        return site.join(F.broadcast(n)).select(F.col("fn").alias("src"), F.expr("(fn * 7 + iid) % n").alias("dst")).distinct()
