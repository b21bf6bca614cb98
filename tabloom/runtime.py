"""Where intermediate tables live, and how large a table is.

Statistics that are read more than once are written to the folder the cluster
names in ``spark.checkpoint.dir``. A written table survives lost executors,
keeps column pruning, and is computed once.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool
from operator import add
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Result = TypeVar("Result")

BROADCAST_BYTES = 64 * 1024 * 1024
# Partitions that a fit sees at least, and rows in one of more.
FIT_PARTITIONS, FIT_ROWS = 16, 1 << 17


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="tabloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder which no other call gets."""
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/tabloom-{app}/{label}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_table(table: DataFrame) -> None:
    """Delete a written intermediate table that nothing reads any more."""
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        drop_path(table.sparkSession, folder)


def drop_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, when no result needs them any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "any")).getParent()
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(
    df: DataFrame, label: str = "table", partition_by: Sequence[str] = (), spread: bool = False
) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    Later filters on a ``partition_by`` column read the matching files only.
    ``spread`` is for tables that are scanned many times, as by a fit: one that
    came out in fewer partitions than there are cores is dealt over all cores.
    """
    table = _write(df, label, partition_by)
    dealt = deal(table) if spread else table
    return table if dealt is table else _write(dealt, label, partition_by)


def deal(scan: DataFrame) -> DataFrame:
    """A scan of fewer partitions than cores dealt over all cores; a larger one unchanged."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def in_fixed_order(df: DataFrame, id_col: str) -> DataFrame:
    """The layout every fit sees: rows dealt by id over a set number of partitions and sorted in each.

    Row sampling of forests goes by partition and place, so a fitted model depends
    on the layout. The number is ``spark.tabloom.fit.partitions``, else 16, and more
    beyond 16 times ``FIT_ROWS`` rows; never that of the cores or files.
    """
    given = df.sparkSession.conf.get("spark.tabloom.fit.partitions", "")
    parts = int(given) if given else max(FIT_PARTITIONS, -(-df.count() // FIT_ROWS))
    return df.repartition(parts, F.col(f"`{id_col}`")).sortWithinPartitions(F.col(f"`{id_col}`"))


def _write(df: DataFrame, label: str, partition_by: Sequence[str]) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(spark: SparkSession, tasks: Sequence[Callable[[], Result]], at_once: int = 8) -> list[Result]:
    """Run independent Spark jobs side by side and return their results in order."""
    if not tasks:
        return []
    with ThreadPool(min(len(tasks), at_once)) as pool:
        return pool.map(lambda task: task(), [inheritable_thread_target(spark)(t) for t in tasks], chunksize=1)


def _width(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value in memory, nested ones included."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, VectorUDT):
        return F.coalesce(F.size(vector_to_array(value)), F.lit(0)) * 8 + 32
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.AtomicType) and not isinstance(kind.elementType, (T.StringType, T.BinaryType)):
            return F.greatest(F.coalesce(F.size(value), F.lit(0)), F.lit(0)) * 16 + 16
        each = F.transform(value, lambda x: _width(x, kind.elementType).cast("long"))
        return F.coalesce(F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)) + 16
    if isinstance(kind, T.MapType):
        keys, values = T.ArrayType(kind.keyType), T.ArrayType(kind.valueType)
        return _width(F.map_keys(value), keys) + _width(F.map_values(value), values)
    if isinstance(kind, T.StructType):
        return reduce(add, [_width(value.getField(f.name), f.dataType) for f in kind.fields], F.lit(16))
    return F.lit(16)


def table_bytes(df: DataFrame) -> int:
    """Estimated in-memory bytes of a table, from one aggregate over its rows."""
    width = reduce(add, [_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields], F.lit(16))
    return df.agg(F.sum(width.cast("long")).alias("bytes")).first()["bytes"] or 0


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a (written) table is small enough to send to every executor."""
    return table_bytes(df) <= limit
