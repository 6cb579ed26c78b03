"""Batches for Python, bounded by bytes as well as rows."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BYTES_PER_BATCH = 32 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df``, for which the session limits the bytes of a batch unless it has a limit of its own: rows may be large files."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key).rstrip("b") == str((1 << 31) - 1):
        conf.set(key, str(BYTES_PER_BATCH))
    return df


def plain(values: pa.Array) -> list:
    """``values.to_pylist()``, by whole columns: numbers through numpy, each different text once, structs as dictionaries."""
    kind = values.type
    if pa.types.is_list(kind):
        flat, ends = plain(values.flatten()), np.cumsum(values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
        made = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return made if not values.null_count else [m if known else None for m, known in zip(made, values.is_valid().to_pylist(), strict=True)]
    if pa.types.is_struct(kind) and not values.null_count:
        names = [f.name for f in kind]
        return [dict(zip(names, row, strict=True)) for row in zip(*map(plain, values.flatten()), strict=True)]
    if pa.types.is_string(kind) and not values.null_count:
        coded = values.dictionary_encode()
        texts = coded.dictionary.to_pylist()
        return [texts[i] for i in coded.indices.to_numpy().tolist()]
    if (pa.types.is_integer(kind) or pa.types.is_floating(kind)) and not values.null_count:
        return values.to_numpy().tolist()
    return values.to_pylist()


def arrow(values: list, kind: pa.DataType) -> pa.Array:
    """``pa.array(values, kind)``, with lists and structs put together of whole columns."""
    if pa.types.is_list(kind) and None not in values:
        ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), arrow(list(chain.from_iterable(values)), kind.value_type), type=kind)
    if pa.types.is_struct(kind) and None not in values:
        return pa.StructArray.from_arrays([arrow([v[f.name] for v in values], f.type) for f in kind], fields=list(kind))
    return pa.array(values, kind)
