"""What the text operators share: Arrow batches cut to a bounded size, and words as codes.

``with_arrow`` runs a vectorised function over a column inside Spark tasks. It
adds columns row by row: no shuffle, and nothing is kept between batches but
the model. Memory is bounded by ``limit`` bytes of text, or one text if longer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CUT_BYTES = 2 << 20

Columns = Callable[[pa.Array], list[pa.Array]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(batch: pa.RecordBatch, column: int, limit: int = CUT_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose values in ``column`` hold at most ``limit`` bytes, or one row.

    Of a struct, the first field counts.
    """
    values = batch.column(column)
    values = values.field(0) if pa.types.is_struct(values.type) else values
    sizes = pc.multiply(pc.list_value_length(values), 4) if pa.types.is_list(values.type) else pc.binary_length(values)
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


BATCH_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES`` for this session, unless it asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def release() -> None:
    """Give memory that Arrow and NumPy have freed back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def tidy(of_group: Callable) -> Callable:
    """A function of a group that releases memory afterwards."""

    def run(group: pa.Table) -> pa.Table:
        out = of_group(group)
        release()
        return out

    return run


def with_arrow(
    df: DataFrame, column: str, fields: list[T.StructField], prepare: Callable[[], Columns], limit: int = CUT_BYTES,
    keep: list[str] | None = None,
) -> DataFrame:
    """``df`` with ``fields`` computed from ``column`` by an Arrow function.

    ``prepare`` runs once per task and returns that function. A column of ``df``
    with the name of a new field is replaced. ``keep`` limits the columns kept.
    """
    bounded_batches(df.sparkSession)
    names = {f.name for f in fields}
    kept = [f for f in df.schema.fields if f.name not in names and (keep is None or f.name in keep)]
    source = df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{column}`").alias("__value"))
    schema = T.StructType([*kept, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = prepare()
        for batch in batches:
            for piece in cut(batch, len(kept), limit):
                new = make(piece.column(len(kept)))
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(kept)], *new], names=schema.names)
                del piece, new
            # Before the next batch comes, and before the worker waits for its next task, nothing of this one is held.
            del batch
            release()
        del make
        release()

    return source.mapInArrow(run, schema)


def flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The values of a list column and the row of each; a null row has none."""
    return pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)


def split_words(texts: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of all texts in order, and the row of each. Null has none."""
    texts = pc.fill_null(texts, "")
    words, rows = flat(pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts))
    full = pc.greater(pc.binary_length(words), 0)
    return words.filter(full), rows[full.to_numpy(zero_copy_only=False)]


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words as codes into an array of distinct words."""
    if not len(words):
        return np.zeros(0, np.int32), words
    encoded = words.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary


def per_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Counts (or sums of integer weights) per row."""
    return np.bincount(rows, weights, n).astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def planes(values: np.ndarray) -> bytes:
    """Integers by byte planes: the high bytes of small numbers lie together and compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def unplaned(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def bucketed(hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``n`` even ranges each 64-bit hash lies in, and the next 32 bits; both keep the order."""
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    high = (hashes >> half) * np.uint64(n)
    mid = (high & low) + (((hashes & low) * np.uint64(n)) >> half)
    return ((high >> half) + (mid >> half)).astype(np.int64), (mid & low).astype(np.uint32)
