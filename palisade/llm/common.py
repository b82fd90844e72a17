"""Session, storage and schema helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows up to which a driver-checked relation may be broadcast or inlined as literals.
INLINE_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a fresh
    temporary folder when it is unset and the master is local (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="palisade-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def _at(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing = threading.Lock()
_writers: dict[SparkSession, list] = {}  # per session: writes under way, and the setting before the first


def _cleanup(spark: SparkSession, step: int) -> None:
    """Count writes under way in ``spark``; the setting is on from the first to the last of them."""
    with _writing:
        held = _writers.setdefault(spark, [0, None])
        if held[0] == 0:
            held[1] = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        held[0] += step
        if held[0] == 0:
            spark.conf.unset(_CLEANUP) if held[1] is None else spark.conf.set(_CLEANUP, held[1])
            del _writers[spark]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    Columnar files keep later column pruning and cost less disk than RDD
    checkpoints; they outlive any executor. They go when ``release`` says so, or
    as the driver's JVM ends, after ``spark.stop()`` too. What is written needs
    its query's shuffle files no more, so they go as it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palisade-{name}-{uuid.uuid4().hex}"
    files, target = _at(spark, path)
    _cleanup(spark, 1)
    try:
        df.write.parquet(path)
    finally:
        _cleanup(spark, -1)
    files.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(df: DataFrame | None) -> None:
    """Remove the files of a materialised ``df`` that nothing will read again."""
    if df is not None and getattr(df, "_written", None):
        files, target = _at(df.sparkSession, df._written)
        files.delete(target, True)
        files.cancelDeleteOnExit(target)


#: Bits of a hash by which ``least_hashed`` narrows its bound in one aggregate.
_STEP = 12


def least_hashed(df: DataFrame, order: Column, n: int) -> DataFrame:
    """The ``n`` rows of least ``order`` (a 64-bit hash), by reading all.

    The bound comes from exact counts of hash prefixes, narrowed until no more
    than n rows share the last prefix; so whatever is sorted is 2n rows at most,
    however many partitions there are. Rows of one and the same hash are counted
    before they are gathered, and stand for each other if they are equal.
    """
    if n <= 0:
        return df.limit(0)
    spread = order.bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))  # unsigned order
    low, bits, wanted = 0, 0, n  # rows under the prefix ``low`` of ``bits`` bits: n - wanted
    while bits < 64:
        step = min(_STEP, 64 - bits)
        prefix = F.shiftrightunsigned(spread, 64 - bits - step)
        within = df if not bits else df.where(F.shiftrightunsigned(spread, 64 - bits) == low)
        counts = {r[0] & ((1 << step) - 1): r[1] for r in within.groupBy(prefix.alias("p")).count().collect()}
        bits += step
        for p in sorted(counts):
            if wanted <= counts[p]:
                break
            wanted -= counts[p]
        else:
            return df.orderBy(order).limit(n)  # fewer than n rows
        low = low << step | p
        if counts[p] <= n:
            upto = ((low + 1) << (64 - bits)) - 1 - (1 << 63)
            return df.where(order <= F.lit(upto).cast("bigint")).orderBy(order).limit(n)
    bound = F.lit(low - (1 << 63)).cast("bigint")
    ties = df.where(order == bound).groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias(count := fresh(df, "times")))
    again = ties.withColumn(count, F.explode(F.array_repeat(F.lit(1), F.least(F.col(count), F.lit(wanted)).cast("int")))).drop(count).limit(wanted)
    return df.where(order < bound).unionByName(again)


def pick(df: DataFrame, **wanted: str) -> list:
    """Columns for ``select``: each keyword names the output, its value the input
    column (exact name, else case-insensitive); a missing column is a null."""
    kinds = {"doc_id": "bigint", "page_id": "bigint", "quality": "int", "toxic": "int"}
    out = []
    for alias, name in wanted.items():
        match = [c for c in df.columns if c == name] or [c for c in df.columns if c.lower() == name.lower()]
        kind = kinds.get(alias, "string")
        column = F.col(f"`{match[0]}`").cast(kind) if match else F.lit(None).cast(kind)
        out.append(column.alias(alias))
    return out


def fresh(df: DataFrame, name: str) -> str:
    """``name``, prefixed until it clashes with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
