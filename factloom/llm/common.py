"""What the training-data operators share: table access, written tables in the shared
folder, and the definition of a word."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a maximal run of characters other than these (space and \x09-\x0D).
WORD_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: The same as a Java regular expression.
WORD_SPACE_RE = r"[\x20\x09-\x0D]+"


#: Bytes of a batch that goes to a Python worker. Rows alone do not bound it: texts differ in
#: length by five orders of magnitude.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the batches that this session sends to Python workers by bytes, unless the
    session has a lower bound already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key)).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def trim() -> None:
    """Gives a Python worker's freed memory back. Workers idle between stages, and would keep the
    most that any stage needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. A
    folder of our own is set only in local mode, where the session names none (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = sc._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="factloom-shared-")
        sc.setCheckpointDir(named)
    return named


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


@contextlib.contextmanager
def no_shuffle_left(spark: SparkSession):
    """Shuffle files of the statements within go as soon as a statement ends, not when the driver
    happens to collect its plan. Only for statements whose result is written or collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


class Shelf:
    """Tables of one operator run, written to the shared folder. A written table cuts lineage
    and survives lost executors. ``drop`` frees a table as soon as nothing reads it again; the
    rest, which the returned frame may still read, goes at the end of the application."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        small_batches(spark)
        atexit.register(self.close)

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        with no_shuffle_left(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._shelf_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for f in frames:
            path = getattr(f, "_shelf_path", None)
            if path:
                fs, p = _fs(self.spark, path)
                fs.delete(p, True)

    def close(self) -> None:
        try:
            fs, p = _fs(self.spark, self.root)
            fs.delete(p, True)
        except Exception:  # the session has ended; its folder goes with the application
            pass


#: A table of ids is broadcast up to so many rows, counted, not estimated (16 bytes a row).
BROADCAST_IDS = 1 << 21
#: A key with more rows than this, and than a hundred-thousandth of all, is dealt to several tasks.
HOT_ROWS, HOT_KEYS = 256, 100_000


def few_ids(written: DataFrame) -> DataFrame:
    """A written table of a few narrow columns, marked for broadcast when its count allows."""
    return F.broadcast(written) if written.count() <= BROADCAST_IDS else written


def hot_keys(counts: DataFrame, keys: list[str], total: int, n: str = "n") -> DataFrame | None:
    """(keys, _parts) of the keys that hold many of ``total`` rows, from their counts: at most
    HOT_KEYS rows by construction. None where there are none."""
    limit = max(HOT_ROWS, total // HOT_KEYS)
    hot = counts.where(F.col(n) > limit).select(*keys, F.ceil(F.col(n) / F.lit(limit)).cast("int").alias("_parts"))
    return None if hot.isEmpty() else hot


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], by: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one`` (few rows a key) on equal keys. Rows of a hot key are dealt to
    tasks by a hash of column ``by``, and the key's rows of ``one`` are repeated for each part; so
    no task gets more than about the limit of hot_keys of any key."""
    if hot is None:
        return many.join(one, keys, how)
    left = many.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(by), F.col("_parts")).cast("int"))).drop("_parts")
    right = one.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def text_or_empty(col="text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def crc32_mod(col: str, mod: int):
    """crc32 of the id as decimal text, modulo."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(mod)


def only(df: DataFrame, **cols: str) -> DataFrame:
    """Just the named columns, cast; extra columns, whatever their names, are left out."""
    return df.select(*[df[c].cast(t).alias(c) for c, t in cols.items()])


LONG, STRING, BINARY = T.LongType(), T.StringType(), T.BinaryType()
