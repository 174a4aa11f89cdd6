"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules here: the six ASCII characters, whatever the engine's locale.
BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = str.maketrans(_UPPER, _LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Rows go to Python in batches of about ``size`` bytes (or the limit of rows), so a task's buffers do not grow with the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only in a local session that has none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="llm-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there: lineage ends, losses of executors do not matter."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def kept_table(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as a table in the shared folder, compressed, for as long as the block runs."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        removed(spark, path)


def removed(spark: SparkSession, path: str) -> None:
    """Remove a table that was written to the shared folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` does not have yet."""
    taken, names = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = f"_{stem}"
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        names.append(name)
    return names


def fingerprint(*cols: Column) -> tuple[Column, Column]:
    """128 bits over the columns, as two longs; nulls count as a value of their own."""
    parts = [x for c in cols for x in (c.isNull(), c)]
    return F.xxhash64(F.lit(17), *parts), F.xxhash64(F.lit(40_503), *parts)


def lowered(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def words_of(text: str | None) -> list[str]:
    """Words of a text: maximal runs without ASCII white space, A-Z lower-cased."""
    # bytes know just the ASCII letters and blanks, and UTF-8 never hides one in another character
    return [w.decode("utf-8", "surrogatepass") for w in (text or "").encode("utf-8", "surrogatepass").lower().split()]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` that gives memory back when a task ends: Spark keeps its Python workers, and what their allocators hold counts against the executor."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return out


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` over Arrow batches; a batch it answers with ``None`` yields nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield out

    return df.mapInArrow(tidy(run), schema)


def columns_of(df: DataFrame) -> str:
    """The frame's schema as DDL."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def summed(df: DataFrame, ways: int = 64) -> DataFrame:
    """Element-wise sums by ``key`` of the arrays in ``data`` (binary, float64), in two steps.

    Arrays of one key have one length. A task adds them as they stream in and holds one
    array per key, so ``df`` may have any number of rows.
    """
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = np.frombuffer(data.as_buffer(), np.float64)
                if key in held:
                    held[key] += values
                else:
                    held[key] = values.copy()
        for key, values in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([values.tobytes()], pa.binary())], names=["key", "data"])

    schema = "key int, data binary"
    return df.select("key", "data").repartition(ways).mapInArrow(tidy(run), schema).repartition("key").mapInArrow(tidy(run), schema)
