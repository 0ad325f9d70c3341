"""Semi-naive least fixpoints over DataFrames.

Each round joins only the last round's new rows and is written to the checkpoint folder, which
executors share: lineage stays short and a lost executor costs one round, not all. Rounds are
written as Parquet without compression or dictionaries: their files are as large as their rows, so
that the planner broadcasts what is small, and not what only packs well.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_roots: dict[str, str] = {}

#: Ids in order take a hundredth of their size in packed files; the planner goes by files, a broadcast takes the rows.
AS_LARGE_AS_ROWS = {"compression": "uncompressed", "parquet.enable.dictionary": "false"}


#: Statements that write a table broadcast no more than this: loops have many, each with some, and all go through the driver.
BROADCAST_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in the session's spark.checkpoint.dir; one of our own only in
    local mode, where the session names none (executors of a cluster would not share it)."""
    sc = spark.sparkContext
    if sc.applicationId not in _roots:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            held = sc._jsc.sc().getCheckpointDir()
            named = held.get() if held.isDefined() else None
        if not named:
            if not re.match(r"local(\[|$)", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="factloom-checkpoint-")
        root = _roots[sc.applicationId] = f"{named}/rounds-{uuid.uuid4().hex[:12]}"

        def remove() -> None:
            with contextlib.suppress(Exception):  # the session has ended; its folder goes with the application
                path = sc._jvm.org.apache.hadoop.fs.Path(root)
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

        atexit.register(remove)
    return _roots[sc.applicationId]


@contextlib.contextmanager
def _during(spark: SparkSession) -> Iterator[None]:
    """Settings of a statement that writes a table: its shuffle files go with it, and its broadcasts are small."""
    most = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    # A session may have a limit of its own for joins planned again as they run, which would stand above ours.
    small = str(min(most, BROADCAST_BYTES))
    with_ = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.autoBroadcastJoinThreshold": small, "spark.sql.adaptive.autoBroadcastJoinThreshold": small}
    old = {k: spark.conf.get(k, None) for k in with_}
    for k, v in with_.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """The rows, written: computed once, without lineage, of known size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    with _during(spark):
        df.write.options(**AS_LARGE_AS_ROWS).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*frames: DataFrame | None) -> None:
    """Deletes written tables that nothing reads again; other frames, and None, are passed over."""
    for f in frames:
        path = getattr(f, "_cut_path", None) if f is not None else None
        if path:
            sc = f.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


class DidNotSettle(RuntimeError):
    """A fixpoint needs more rounds than were allowed; never a silent cut."""


def fixpoint(seed: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], most_rounds: int = 1000) -> DataFrame:
    """The least relation that holds the seed and is closed under ``step(delta, known)``, which
    gives rows that follow from at least one row of delta. All columns are keys, none null."""
    keys = seed.columns
    known = cut(seed.distinct())
    delta = known
    parts = [known]
    for _ in range(most_rounds):
        delta = cut(step(delta, known).select(*keys).distinct().join(known, keys, "left_anti"))
        if delta.isEmpty():
            return known
        parts.append(delta)
        if len(parts) > 8:
            merged = cut(reduce(DataFrame.unionByName, parts))
            drop(*parts[:-1])  # the last is read once more, as the delta
            parts = [merged]
        known = reduce(DataFrame.unionByName, parts)
    raise DidNotSettle(f"{most_rounds} rounds")


def closure(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Transitive closure of (by..., src, dst) by path doubling: the rounds are the logarithm of
    the longest shortest path."""
    e = edges.select(*by, "src", "dst")

    def step(delta: DataFrame, known: DataFrame) -> DataFrame:
        def join(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("src").alias("_mid"), F.col("dst").alias("_end"))
            on = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"_{c}") for c in by], F.col("dst") == F.col("_mid"))
            return a.join(b, on).select(*by, "src", F.col("_end").alias("dst"))

        return join(delta, known).unionByName(join(known, delta))

    return fixpoint(e, step)
