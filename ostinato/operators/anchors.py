"""Groups of near-simultaneous onsets, for sequences of any length.

A group begins with the first onset that is beyond the tolerance of the group before, so where groups begin depends on
all that went before. Each onset points to the first one beyond its tolerance; the pointers are doubled until those of
the groups' first onsets are marked, in a logarithm of rounds. Within a part of a total order this is done at once. What
an earlier part leaves open can only be one of the onsets within a tolerance before a part, so each part says where it
would end for any of these: a short table of steps. Following it through the parts is all that is done one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ostinato.operators.ranges import laid_out


def beyond(onsets: np.ndarray, tolerance: float) -> np.ndarray:
    """For each of ascending onsets the place of the first one that is more than the tolerance later; the length if none."""
    at = np.searchsorted(onsets, onsets + tolerance, side="right")
    while True:  # a sum is rounded otherwise than the difference that decides
        low = (at < len(onsets)) & (onsets[np.minimum(at, len(onsets) - 1)] - onsets <= tolerance)
        high = ~low & (onsets[at - 1] - onsets > tolerance)
        if not low.any() and not high.any():
            return at
        at = at + low - high


def marked(jumps: np.ndarray, first: int) -> np.ndarray:
    """Which places are reached from ``first``. Each round marks what twice as many jumps reach."""
    n = len(jumps)
    mark, jump = np.zeros(n + 1, bool), np.append(jumps, n)
    mark[first] = True
    while True:
        reached = jump[np.flatnonzero(mark)]
        if mark[reached].all():
            return mark[:n]
        mark[reached] = True
        jump = jump[jump]


def last_reached(jumps: np.ndarray) -> np.ndarray:
    """The last place that is reached from each place."""
    n = len(jumps)
    jump = np.where(jumps == n, np.arange(n), jumps)
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            return jump
        jump = further


def steps_of_part(onsets: np.ndarray, tolerance: float) -> list[tuple]:
    """(up to, end): if the part's first group begins at an onset of up to the first number, its last one begins at the second.

    Ascending; only first groups that an onset before the part, or its first one, can lead to.
    """
    able = np.append(np.flatnonzero(onsets - onsets[0] <= tolerance), np.flatnonzero(onsets - onsets[0] > tolerance)[:1])
    ends = onsets[last_reached(beyond(onsets, tolerance))[able]]
    change = np.append(np.flatnonzero(ends[1:] != ends[:-1]), len(able) - 1)
    return [(onsets[able[i]].item(), ends[i].item()) for i in change]


def segments(table: pa.Table, key: list[str]) -> np.ndarray:
    """Where the rows of each key begin, and the number of rows; rows of a key stand together."""
    new = np.zeros(len(table), bool)
    if len(table):
        new[0] = True
    for k in key:
        codes = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.append(np.flatnonzero(new), len(table))


def anchor_groups(df: DataFrame, key: list[str], onset: str, tolerance: Column, others: list[str] = [], parts: int | None = None) -> DataFrame:  # noqa: B006
    """(key, anchor, onset, others): a row joins the group whose first onset is within the tolerance, else it begins one.

    Distances count from a group's first onset, not from its last, so session windows don't give this. The tolerance is
    the same for all rows of a key. A row without an onset is in no group: its anchor is null. An empty table gives none.
    """
    kind = df.schema[onset].dataType.simpleString()
    slim = df.select(*key, F.col(onset).alias("onset"), *others, tolerance.alias("_tolerance"))
    none = slim.where("onset is null").select(*key, F.lit(None).cast(kind).alias("anchor"), "onset", *others)
    rows = laid_out(slim.where("onset is not null"), [*key, "onset", *others], parts)

    ends_schema = f"part int, first string, last string, one boolean, opened {kind}, tolerance double, steps array<struct<upto: {kind}, ends: {kind}>>"
    ends_to = to_arrow_schema(StructType.fromDDL(ends_schema))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not len(table):
            return
        starts = segments(table, key)
        onsets = table.column("onset").to_numpy()
        name = lambda i: repr([table.column(k)[int(i)].as_py() for k in key])
        own = lambda k: onsets[starts[k] : starts[k + 1]]
        tolerances = [float(table.column("_tolerance")[int(starts[k])].as_py()) for k in (0, len(starts) - 2)]
        opened = own(len(starts) - 2)
        opened = opened[last_reached(beyond(opened, tolerances[1]))[0]].item()
        steps = [{"upto": a, "ends": b} for a, b in steps_of_part(own(0), tolerances[0])]
        part = table.column("_part")[0].as_py()
        yield pa.RecordBatch.from_pylist([{"part": part, "first": name(0), "last": name(len(table) - 1), "one": len(starts) == 2, "opened": opened, "tolerance": tolerances[0], "steps": steps}], schema=ends_to)

    open_before: dict[int, object] = {}
    state = before = None
    for part in sorted(rows.select("_part", *key, "onset", "_tolerance").mapInArrow(ends, ends_schema).collect()):  # a row for each part
        if before is not None and before == part["first"]:
            open_before[part["part"]] = state
            led = next((s["ends"] for s in part["steps"] if s["upto"] - state > part["tolerance"]), state)
            state = led if part["one"] else part["opened"]
        else:
            state = part["opened"]
        before = part["last"]

    wanted = [*key, "anchor", "onset", *others]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*key, F.col("onset").alias("anchor"), "onset", *others).schema)
    to = to_arrow_schema(StructType.fromDDL(schema))
    shared = rows.sparkSession.sparkContext.broadcast(open_before)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not len(table):
            return
        starts, onsets = segments(table, key), table.column("onset").to_numpy()
        anchors = np.empty_like(onsets)
        earlier = shared.value.get(table.column("_part")[0].as_py())
        for k, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            own, limit = onsets[a:b], float(table.column("_tolerance")[int(a)].as_py())
            first = int(np.argmax(own - earlier > limit)) if k == 0 and earlier is not None and (own - earlier > limit).any() else 0
            if k == 0 and earlier is not None and not (own - earlier > limit).any():
                anchors[a:b] = earlier
                continue
            mark = marked(beyond(own, limit), first)
            at = np.maximum.accumulate(np.where(mark, np.arange(len(own)), -1))
            anchors[a:b] = np.where(at >= 0, own[at], earlier if earlier is not None else own[0])
        made = table.append_column("anchor", pa.array(anchors)).select(wanted).cast(to)
        yield from made.to_batches(max_chunksize=1 << 16)

    return rows.select("_part", *key, "onset", "_tolerance", *others).mapInArrow(place, schema).unionByName(none)
