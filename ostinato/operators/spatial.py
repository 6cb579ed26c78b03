"""Nearest references by cells of a k-d tree: only cells that can hold a nearer reference are looked into.

References are cut at medians into cells of a few hundred, each with the box around its references. A row is compared
with the references of its own cell first; then with those of any cell whose box is no farther than what it found. The
result is that of comparing all pairs: the nearest, and of several as near the one with the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ostinato.functions.batches import bounded

#: References that tasks hold at once, those of a cell, and numbers of a matrix of distances.
REFERENCES_A_PASS, CELL, MATRIX = 1 << 20, 256, 1 << 22


class Cells:
    """References in cells; each cell keeps the order of ids."""

    def __init__(self, points: np.ndarray):
        self.points, self.members, self.low, self.high = points, [], [], []
        waiting = [np.arange(len(points))]
        while waiting:
            own = waiting.pop()
            low, high = points[own].min(axis=0), points[own].max(axis=0)
            axis = int(np.argmax(high - low))
            if len(own) <= CELL or high[axis] == low[axis]:
                self.members.append(own)
                self.low.append(low)
                self.high.append(high)
                continue
            middle = np.median(points[own, axis])
            left = points[own, axis] < middle
            if not left.any():
                left = points[own, axis] <= middle
            waiting += [own[left], own[~left]]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each row's nearest reference, and the square of its distance."""
        best, at = np.full(len(rows), np.inf), np.full(len(rows), len(self.points))
        step = max(1, MATRIX // len(self.members))
        for begin in range(0, len(rows), step):
            self._search(rows[begin : begin + step], best[begin : begin + step], at[begin : begin + step])
        return at, best

    def _search(self, rows: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        gaps = np.zeros((len(rows), len(self.members)))
        for k in range(rows.shape[1]):
            off = np.maximum(np.maximum(self.low[:, k] - rows[:, k, None], rows[:, k, None] - self.high[:, k]), 0)
            gaps += off * off
        gaps *= 1 - 1e-12  # rounding of a box's distance rules nothing out
        home = gaps.argmin(axis=1)
        for cell in np.unique(home):
            self._compare(rows, np.flatnonzero(home == cell), cell, best, at)
        gaps[np.arange(len(rows)), home] = np.inf
        for cell in np.flatnonzero((gaps <= best[:, None]).any(axis=0)):
            self._compare(rows, np.flatnonzero(gaps[:, cell] <= best), cell, best, at)

    def _compare(self, rows: np.ndarray, which: np.ndarray, cell: int, best: np.ndarray, at: np.ndarray) -> None:
        members = self.members[cell]
        step = max(1, MATRIX // len(members))
        for begin in range(0, len(which), step):
            own = which[begin : begin + step]
            squares = np.zeros((len(own), len(members)))
            for k in range(rows.shape[1]):
                off = rows[own, k, None] - self.points[members, k]
                squares += off * off
            first = squares.argmin(axis=1)  # members are in the order of ids
            found, place = squares[np.arange(len(own)), first], members[first]
            nearer = (found < best[own]) | ((found == best[own]) & (place < at[own]))
            best[own[nearer]], at[own[nearer]] = found[nearer], place[nearer]


def _coordinates(table: pa.Table, axes: list[str], vector: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The rows whose coordinates are all there and finite, and these coordinates."""
    if vector is None:
        made = np.column_stack([table.column(a).cast(pa.float64()).to_numpy() for a in axes]) if table.num_rows else np.zeros((0, len(axes)))
        good = np.flatnonzero(np.isfinite(made).all(axis=1))
        return good, made[good]
    lists = table.column(vector).to_pylist()
    width = max((len(v) for v in lists if v is not None), default=0)
    good = [i for i, v in enumerate(lists) if v is not None and len(v) == width and None not in v and np.isfinite(v).all()]
    return np.asarray(good, np.int64), np.asarray([lists[i] for i in good], np.float64).reshape(len(good), width)


def nearest_reference(df: DataFrame, references: DataFrame, axes: list[str] | str, id_column: str, name: str) -> DataFrame:
    """Adds ``nearest``, the name of the nearest reference, and ``distance``; of several as near that with the smallest id.

    ``axes`` are columns of both tables, or one array column of both. References, and rows, without all coordinates, or
    with ones that aren't finite, are near nothing: both results are null then. References are read when the plan is
    made, REFERENCES_A_PASS at a time; each pass goes over the rows once and keeps the nearer of two.
    """
    vector, axes = (axes, []) if isinstance(axes, str) else (None, axes)
    columns = [vector] if vector else axes
    wanted = references.select(F.col(id_column).alias("_id"), F.col(name).cast("string").alias("_name"), *columns)
    total = wanted.count()
    passes = max(1, -(-total // REFERENCES_A_PASS))
    out = df
    for k in range(passes):
        part = wanted if passes == 1 else wanted.where(F.pmod(F.xxhash64("_id"), F.lit(passes)) == k)
        table = part.toArrow().sort_by("_id")
        good, points = _coordinates(table, axes, vector)
        out = _one_pass(out, points, table.take(good), axes, vector, references.schema[id_column].dataType.simpleString(), k > 0)
    return out.drop("_at")


def _one_pass(df: DataFrame, points: np.ndarray, known: pa.Table, axes: list[str], vector: str | None, id_kind: str, again: bool) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast((Cells(points) if len(points) else None, known.column("_name").to_pylist(), known.column("_id").to_pylist()))
    before = [c for c in df.columns if c not in ("nearest", "distance", "_at")] if again else df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*before).schema) + f", nearest string, distance double, `_at` {id_kind}"
    to = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, names, ids = shared.value
        for batch in batches:
            nearest, distance, at = ([None] * batch.num_rows for _ in range(3))
            if again:
                nearest, distance, at = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("nearest", "distance", "_at"))
            rows, made = _coordinates(pa.Table.from_batches([batch]), axes, vector)
            if cells is not None and len(rows) and made.shape[1] == cells.points.shape[1]:
                place, squares = cells.nearest(made)
                for i, p, d in zip(rows.tolist(), place.tolist(), np.sqrt(squares).tolist(), strict=True):
                    if distance[i] is None or (d, ids[p]) < (distance[i], at[i]):
                        nearest[i], distance[i], at[i] = names[p], d, ids[p]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in before]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip([*kept, pa.array(nearest, pa.string()), pa.array(distance, pa.float64()), pa.array(at, to.field("_at").type)], to, strict=True)], schema=to)

    return bounded(df).mapInArrow(run, schema)
