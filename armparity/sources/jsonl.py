"""JSON-lines logs: strict reads with a reject table, canonical and appending writes.

A reject says where it is: file, line and byte. Spark cuts a large file into ranges of
bytes, and a task that reads one knows neither how many lines nor how many bytes its lines
come after. Within a range both are running counts; the ranges' totals, added up per file,
give where each range starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armparity import schemas
from armparity.functions import payload
from armparity.session import checkpointed


def read_all_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its ``file``, the start of the ``range`` of bytes it was read in, and its ``size`` with the line end.

    Lines end in a newline; a carriage return before it is not part of ``line``.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"))
    return raw.select(F.regexp_replace("value", "\r$", "").alias("line"), "file", "range", (F.octet_length("value") + 1).alias("size"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with their file; large files are split over tasks."""
    return read_all_lines(spark, path).filter(F.trim("line") != "")


def located(lines: DataFrame, every: DataFrame, kept: str) -> DataFrame:
    """The rows of ``lines`` in which ``kept`` is not null, with ``file``, ``line_no`` (from 1), ``offset`` (bytes before the line), ``line`` and ``kept``.

    ``lines`` are the rows of :func:`read_all_lines` with a column more, in the order they
    were read; ``every`` are the plain ones. Counting goes on within each task as its
    ranges are read, and only the kept rows and one total per range are shuffled.
    """
    marked = lines.select("file", "range", "size", F.when(F.col(kept).isNotNull(), F.col("line")).alias("line"), kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, no, at = None, 0, 0
        for batch in batches:
            file, start = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            size = batch.column(2).to_numpy().astype(np.int64)
            new = np.array([True, *((start[1:] != start[:-1]) | np.array([p != q for p, q in zip(file, file[1:])], bool))]) if len(file) else np.zeros(0, bool)
            if len(file) and (file[0], start[0]) == where:
                new[0] = False
            # running counts that begin anew with each range
            first = np.flatnonzero(new)
            base_no, base_at = np.arange(len(size)), np.cumsum(size) - size
            if len(first):
                of = np.searchsorted(first, np.arange(len(size)), side="right") - 1
                lead = of < 0
                line_no = np.where(lead, no + base_no, base_no - base_no[first[of]])
                offset = np.where(lead, at + base_at, base_at - base_at[first[of]])
            else:
                line_no, offset = no + base_no, at + base_at
            if len(file):
                where, no, at = (file[-1], start[-1]), int(line_no[-1]) + 1, int(offset[-1] + size[-1])
            hits = np.flatnonzero(batch.column(4).is_valid().to_numpy(zero_copy_only=False))
            if len(hits):
                take = pa.array(hits)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(line_no[hits]), pa.array(offset[hits]), batch.column(3).take(take), batch.column(4).take(take)],
                                                 names=["file", "range", "no", "at", "line", kept])

    hits = marked.mapInArrow(run, f"file string, range bigint, no bigint, at bigint, line string, {kept} string")
    totals = every.groupBy("file", "range").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("file", "range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "bytes")])
    return hits.join(starts, ["file", "range"]).select(
        "file", (F.col("n_before") + F.col("no") + 1).alias("line_no"), (F.col("bytes_before") + F.col("at")).alias("offset"), "line", kept)


def parse_strict(lines: DataFrame, schema: str, required: tuple[str, ...] = (), allowed: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Adds ``rec`` and ``reject``: bad JSON, unknown keys at the top or in a nested record, missing or mistyped required fields, values outside a fixed list."""
    fields = lines.sparkSession.createDataFrame([], schema).schema.fields
    nested = {f.name: [n.name for n in f.dataType.fields] for f in fields if isinstance(f.dataType, T.StructType)}
    keys = {"_keys": F.json_object_keys("line"), **{f"_keys_{n}": F.json_object_keys(F.get_json_object("line", f"$.{n}")) for n in nested}}
    staged = lines.withColumns({**keys, "rec": F.from_json("line", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})})

    def beyond(found: Column, known: list[str], prefix: str = "") -> Column:
        extra = F.array_sort(F.array_except(F.coalesce(found, F.array().cast("array<string>")), F.array(*[F.lit(n) for n in known])))
        return F.transform(extra, lambda x: F.concat(F.lit(prefix), x))

    unknown = F.concat(beyond(F.col("_keys"), [f.name for f in fields]), *[beyond(F.col(f"_keys_{n}"), names, f"{n}.") for n, names in nested.items()])
    missing = F.filter(F.array(*[F.when(F.col(f"rec.{n}").isNull(), F.lit(n)) for n in required] or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
    reject = (
        F.when(F.col("_keys").isNull() | F.col("rec._bad").isNotNull(), F.lit("not a valid record"))
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown keys: "), F.array_join(unknown, ", ")))
        .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))))
    for name, values in (allowed or {}).items():
        value = F.col(f"rec.{name}")
        reject = reject.when(value.isNotNull() & ~value.isin(*values), F.concat(F.lit(f"not a {name}: "), value))
    return staged.withColumn("reject", reject).drop(*keys)


def read_calls(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(calls, rejects)``; a reject has its ``file``, ``line_no``, ``offset``, the ``line`` and why."""
    return _split(parse_strict(read_all_lines(spark, path), schemas.CALL, schemas.CALL_REQUIRED, schemas.CALL_ALLOWED))


def read_items(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same for gold items, whose gold answer has to satisfy its task's schema and whose rubric has to have three to five criteria, each once."""
    parsed = parse_strict(read_all_lines(spark, path), schemas.ITEM, schemas.ITEM_REQUIRED)
    ids = F.transform("rec.rubric", lambda x: x["id"])
    broken = F.concat(
        payload.gold_defects(F.col("rec.subagent"), F.col("rec.gold")),
        F.when(F.size(F.array_distinct(ids)) != F.size(ids), F.array(F.lit("duplicate rubric id"))).otherwise(F.array().cast("array<string>")),
        F.when(~F.coalesce(F.size(ids).between(3, 5), F.lit(False)), F.array(F.lit("rubric needs three to five criteria"))).otherwise(F.array().cast("array<string>")))
    staged = parsed.withColumn("_defects", F.when(F.col("reject").isNull() & (F.trim("line") != ""), F.array_join(broken, "; ")))
    return _split(staged.withColumn("reject", F.coalesce("reject", F.nullif("_defects", F.lit("")))).drop("_defects"))


def _split(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and rejects of lines that are parsed once, for both."""
    # a blank line is no record and no reject, but it counts
    blank = F.trim("line") == ""
    good = F.col("reject").isNull() & ~blank
    kept = checkpointed(parsed.select(
        "file", "range", "size", F.when(~good, F.col("line")).alias("line"), F.when(~blank, F.col("reject")).alias("reject"), F.when(good, F.col("rec").dropFields("_bad")).alias("rec")))
    return kept.filter("rec is not null").select("rec.*"), located(kept, kept, "reject")


def canonical(df: DataFrame) -> Column:
    """One canonical JSON object per row, members in alphabetical order, null members kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str, key: str, partitions: int | None = None) -> None:
    """Replace ``path`` with canonical lines in key order; range partitions keep every writer busy."""
    lines = df.select(F.col(key).alias("_k"), canonical(df).alias("value"))
    spread = lines.repartitionByRange(partitions, "_k") if partitions else lines.repartitionByRange("_k")
    spread.sortWithinPartitions("_k").select("value").write.mode("overwrite").text(path)


def append_calls(df: DataFrame, path: str, by: str = "task") -> None:
    """Append to the store, partitioned so a read of one task opens only its files."""
    df.write.mode("append").partitionBy(by).parquet(path)


def export_rows(calls: DataFrame, answer: Column) -> tuple[DataFrame, DataFrame]:
    """Evaluation rows of what was answered, and the census of what was not and why."""
    staged = calls.withColumn("_answer", answer)
    why = F.when(F.col("status") != "ok", F.lit("the call failed")).otherwise(F.lit("empty answer"))
    rows = staged.filter("_answer is not null").select(
        "call_id", "task", "arm", F.to_json(F.struct(F.col("prompt"), F.col("_answer").alias("response"), F.col("reference"))).alias("row"))
    dropped = staged.filter("_answer is null").groupBy("task", "arm", why.alias("reason")).agg(F.count("*").alias("n"))
    return rows, dropped
