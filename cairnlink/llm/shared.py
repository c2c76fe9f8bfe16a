"""What several operators need: the shared folder, cut lineage, global row numbers and a keyed permutation.

Everything here is plain DataFrame code; the native operators use it on their main path.
"""

from __future__ import annotations

import gc
import math
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it names none, a new local one, on a local master only."""
    context = spark.sparkContext
    named = context.getConf().get(CHECKPOINT_SETTING) or spark.conf.get(CHECKPOINT_SETTING, None)
    if not named and context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_SETTING} must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="cairnlink-")
        spark.conf.set(CHECKPOINT_SETTING, named)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return (named or context.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, stem: str) -> str:
    return f"{shared_dir(spark)}/{stem}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete what an operator has stored and nobody reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, stem: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder."""
    path = new_folder(df.sparkSession, stem)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


HOT_KEYS = 10_000


def spread_join(left: DataFrame, facts: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join with ``facts``, one row for each ``key``, where a key may have a large part of the ``total`` rows of ``left``.

    ``weight`` says how many rows of ``left`` a key has. Keys with at least 1,000 rows and a ``HOT_KEYS``-th of all are at
    most ``HOT_KEYS``; these are broadcast, and their rows not dealt by key. All others are joined as usual.
    """
    many = max(1000, -(-total // HOT_KEYS))
    columns = [c for c in facts.columns if c != key]
    hot = facts.where(F.col(weight) >= many).select(F.col(key).alias("_hot"), F.struct(*columns).alias("_of_hot"))
    marked = left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    at = F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.xxhash64(F.monotonically_increasing_id()))
    marked = marked.withColumns({"_at": at, "_cold": F.col("_hot").isNull()})
    cold = facts.where(F.col(weight) < many).select(F.col(key).alias("_k"), F.lit(True).alias("_is"), F.struct(*columns).alias("_of_cold"))
    joined = marked.join(cold, (F.col("_at") == F.col("_k")) & (F.col("_cold") == F.col("_is")), "left").withColumn("_of", F.coalesce("_of_hot", "_of_cold"))
    return joined.where(F.col("_of").isNotNull()).select(*left.columns, "_of.*")


def let_go(spark: SparkSession) -> None:
    """Free what the driver still holds of finished steps: plans that Python refers to in cycles, and the shuffles behind them.

    What the driver's JVM has freed outside its heap (compiler work, above all) goes back to the system, where the JVM has a
    command for that.
    """
    gc.collect()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    jvm.System.gc()
    kind, server = jvm.java.lang.Class.forName, jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    parts = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    kinds, values = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
    for i, part in enumerate(parts):
        kinds[i] = kind(part)
    values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        kind("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, values)
    except Py4JJavaError:
        pass  # a JVM without that command


def number_rows(df: DataFrame, keys: list[Column], name: str = "row_no") -> DataFrame:
    """Add the 0-based position of each row in the order of ``keys``, without a single-task sort.

    Rows are range-partitioned by the keys and, among equal keys, by where they were read, so that a third of all
    rows under one key still spreads out; equal rows are interchangeable, so the result depends on the content alone.
    Each partition then numbers its own rows and adds the row counts of the partitions before it. What is
    broadcast has one row for each partition. The result is cut (it lies in the shared folder).
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = [f"_key{i}" for i in range(len(keys))]
    keyed = df.withColumns(dict(zip(named, keys)) | {"_tie": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(parts, *named, "_tie").sortWithinPartitions(*named, "_tie")
    placed = cut(dealt.drop(*named, "_tie").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    within = F.col("_at").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + within).drop("_part", "_start", "_at")


def _domain(n: int) -> tuple[int, int]:
    """Sides a, b of the smallest near-square grid with at least n cells."""
    a = max(1, math.isqrt(max(n, 1)))
    return a, -(-max(n, 1) // a)


def _round(key: int, i: int, value: Column, modulus: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(key), F.lit(i), value), F.lit(modulus))


ROUNDS = 6


def _feistel(x: Column, n: int, key: int, inverse: bool = False) -> Column:
    """One pass of the Feistel network over the grid as a single expression."""
    a, b = _domain(n)
    right = F.pmod(x, F.lit(b))
    left = F.floor((x - right) / b).cast("long")
    for i in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        sign = -1 if inverse else 1
        if i % 2 == 0:
            left = F.pmod(left + sign * _round(key, i, right, a), F.lit(a))
        else:
            right = F.pmod(right + sign * _round(key, i, left, b), F.lit(b))
    return left * b + right


def with_permuted(df: DataFrame, column: str, n: int, key: int, name: str, inverse: bool = False) -> DataFrame:
    """Add ``name``: the keyed permutation of 0..n-1 applied to the long ``column`` (a value of that range).

    A Feistel network permutes the cells of a grid of at least n cells, one side added to by a keyed hash of
    the other in each round; while a value falls outside 0..n-1 the network is applied again (cycle walking). The
    grid has fewer than sqrt(n)+1 cells too many, so almost no row walks. A walk ends after at most that many
    steps; beyond 4,096 rows 64 steps are planned. A row still outside then (odds of 1 in 10**115) raises.
    """
    a, b = _domain(n)
    value = F.col(column)
    frame = df.withColumns({"_r": F.pmod(value, F.lit(b))}).withColumn("_l", F.expr(f"({column} - _r) div {b}"))
    sign = -1 if inverse else 1
    for i in reversed(range(ROUNDS)) if inverse else range(ROUNDS):  # a projection each: no expression is repeated
        if i % 2 == 0:
            frame = frame.withColumn("_l", F.pmod(F.col("_l") + sign * _round(key, i, F.col("_r"), a), F.lit(a)))
        else:
            frame = frame.withColumn("_r", F.pmod(F.col("_r") + sign * _round(key, i, F.col("_l"), b), F.lit(b)))
    frame = frame.withColumn("_x", F.col("_l") * b + F.col("_r"))
    if a * b > n:
        steps = min(a * b - n + 1, 64)
        walked = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("_x"), lambda x, _: F.when(x < n, x).otherwise(_feistel(x, n, key, inverse)))
        lost = F.raise_error(F.lit("a walk of the permutation did not end")).cast("long")
        frame = frame.withColumn("_x", F.when(F.col("_x") < n, F.col("_x")).otherwise(walked))
        frame = frame.withColumn("_x", F.when(F.col("_x") < n, F.col("_x")).otherwise(lost))
    return frame.withColumn(name, F.col("_x")).drop("_x", "_l", "_r")
