"""Raw binary arrays: files of numbers without a header, read in ranges and written by partition."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ostinato.functions.dissonance import NODES

#: A task reads ranges of about so many bytes.
RANGE_BYTES = 32 << 20
KINDS = {"uint16": "int", "float16": "float", "float32": "float", "int32": "int", "float64": "double"}


def _listed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length")


def read_raw(spark: SparkSession, folder: str, pattern: str, kind: str, width: int) -> DataFrame:
    """(path, row, values): files of rows of ``width`` numbers. A file's last, incomplete row fails the job.

    Files are cut in ranges of whole rows, so a large one is read by many tasks and none holds more than a range.
    """
    row_bytes = np.dtype(kind).itemsize * width
    per_range = max(1, RANGE_BYTES // row_bytes)
    checked = F.when(F.col("length") % row_bytes == 0, F.col("length")).otherwise(F.raise_error(F.concat(F.col("path"), F.lit(f" isn't a multiple of {row_bytes} bytes"))))
    sized = _listed(spark, folder, pattern).withColumn("rows", (checked / row_bytes).cast("long")).where("rows > 0")
    ranges = sized.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(per_range).cast("long"))).alias("first"), "rows")
    ranges = ranges.select("path", "first", F.least(F.col("rows") - F.col("first"), F.lit(per_range)).alias("n"))
    to = pa.schema([("path", pa.string()), ("row", pa.int64()), ("values", pa.list_(pa.from_numpy_dtype(np.dtype({"int": "int32", "float": "float32", "double": "float64"}[KINDS[kind]]))))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, own = pafs.FileSystem.from_uri(path)
                with store.open_input_file(own) as source:
                    data = np.frombuffer(source.read_at(n * row_bytes, first * row_bytes), np.dtype(kind).newbyteorder("<"))
                values = pa.array(data.astype(to.field("values").type.value_type.to_pandas_dtype()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), values)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.arange(first, first + n)), lists], schema=to)

    return ranges.repartition(F.col("path"), F.col("first")).mapInArrow(run, f"path string, row long, values array<{KINDS[kind]}>")


def write_raw(df: DataFrame, folder: str, column: str, kind: str, width: int) -> DataFrame:
    """(path, rows) of the files to which arrays of ``width`` numbers are written, one for each partition, when acted on.

    Arrays of another length, or with nulls, fail the job. Names are new on each attempt; only listed files count.
    """
    to = pa.schema([("path", pa.string()), ("rows", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        name, n = f"part-{uuid.uuid4().hex}.bin", 0
        with store.open_output_stream(f"{top}/{name}", compression=None) as out:
            for batch in batches:
                lists = batch.column(0)
                flat = lists.flatten()
                if lists.null_count or flat.null_count or len(flat) != len(lists) * width or any(x != width for x in lists.value_lengths().to_pylist()):
                    raise ValueError(f"arrays of {width} numbers are needed")
                out.write(flat.to_numpy(zero_copy_only=False).astype(np.dtype(kind).newbyteorder("<")).tobytes())
                n += len(lists)
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "rows": [n]}, schema=to)

    return df.select(column).mapInArrow(run, "path string, rows long")


def read_map(spark: SparkSession, folder: str, base: int = 220, nodes: int = NODES) -> DataFrame:
    """(i, j, k, d): a map of three ratios in chunks, in the order of their names; a chunk goes on where the last one ends."""
    pattern = f"harmonic-{base}Hz-{nodes}nodes-chunk*"
    rows = read_raw(spark, folder, pattern, "float32", 1)
    sizes = _listed(spark, folder, pattern).select(F.col("path").alias("p"), (F.col("length") / 4).cast("long").alias("n"))
    starts = sizes.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    at = rows.join(F.broadcast(starts), F.col("path") == F.col("p")).select((F.col("start") + F.col("row")).alias("at"), F.get("values", F.lit(0)).cast("double").alias("d"))
    index = lambda p: (F.expr(f"at div {nodes**p}") % nodes).cast("int")
    return at.select(index(2).alias("i"), index(1).alias("j"), index(0).alias("k"), "d")


def list_files(spark: SparkSession, folder: str, pattern: str, limit: int | None = None, exclude: str | None = None) -> DataFrame:
    """(path, length) of files by name, in its order; without those that match a regular expression, and the first ``limit``."""
    files = _listed(spark, folder, pattern)
    kept = (files if exclude is None else files.where(~F.col("path").rlike(exclude))).orderBy("path")
    return kept if limit is None else kept.limit(limit)
