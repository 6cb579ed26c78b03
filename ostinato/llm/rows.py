"""Arrow batches in, Arrow batches out: the one way in which the operators here call Python for texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BYTES_PER_BATCH = 32 << 20
#: Bytes, or characters, of texts that a task works on at once.
BLOCK_BYTES = 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """Limits the bytes of a batch for Python, whatever the texts' lengths, unless the session has a limit of its own."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key).rstrip("b") == str((1 << 31) - 1):
        conf.set(key, str(BYTES_PER_BATCH))
    return df


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def slices(batch: pa.RecordBatch, size: int | None) -> Iterator[pa.RecordBatch]:
    """A batch in parts of equally many rows that have about so many bytes, if there is such a bound."""
    rows = max(1, batch.num_rows * size // max(batch.nbytes, 1)) if size else max(1, batch.num_rows)
    for at in range(0, max(1, batch.num_rows), rows):
        yield batch.slice(at, rows)


def map_rows(df: DataFrame, step: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str, size: int | None = None) -> DataFrame:
    """Maps lists of column values to lists of column values, batch by batch, or by ``slices`` of batches of so many bytes.

    ``step`` is called once in each task and returns the function for its batches, so that tables and caches are made
    once. Rows may be fewer or more than those read. Text never leaves the task that read it.
    """
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = step()
        for batch in (part for whole in batches for part in slices(whole, size)):
            made = call({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in to], schema=to)

    return bounded_batches(df).mapInArrow(run, schema)


def blocks(texts: list[bytes | str | None], size: int = BLOCK_BYTES) -> Iterator[list[bytes | str | None]]:
    """Texts in order, as many together as have about so many bytes; a longer text stands alone."""
    part, held = [], 0
    for text in texts:
        own = len(text or b"")
        if part and held + own > size:
            yield part
            part, held = [], 0
        part.append(text)
        held += own
    if part:
        yield part
