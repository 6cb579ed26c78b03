"""Total orders that no single task holds: ordinals, and running values of sequences of any length.

Rows are dealt to ranges of their order and sorted there, so a long sequence stands in many parts and a part holds many
short ones. What a row needs from the parts before its own is a number for each part, or the end of one sequence for
each part; these few are added up on the driver and joined back.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ostinato.functions.shared import cut

#: Places within a part; Spark numbers the rows of a partition in the low 33 bits.
PLACE_BITS = 33


def laid_out(df: DataFrame, order: list, parts: int | None = None) -> DataFrame:
    """``df`` in as many ranges of ``order`` as the session shuffles, with ``_part`` and the place in it, ``_at``.

    The result is written once, so both numbers are the same wherever it is read. Rows that are equal in the whole order
    stay in one part; an order that tells all rows apart lets any number of them be split.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return cut(sorted_rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << PLACE_BITS) - 1)))


def numbered(df: DataFrame, order: list, name: str, parts: int | None = None) -> tuple[DataFrame, int]:
    """Adds each row's place in a total order, from 0, and says how many rows there are.

    A place is the rows of all parts before plus the place in the part: no task sees more than a part.
    """
    rows = laid_out(df, order, parts)
    starts, total = [], 0
    for row in rows.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # a number for each part
        starts.append((row["_part"], total))
        total += row["n"]
    before = rows.sparkSession.createDataFrame(starts, "_part int, _start long")
    return rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start"), total


#: What can run along a sequence: its aggregate, and how what came before joins what a part has so far.
RUNNING: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column], Callable[[Any, Any], Any]]] = {
    "sum": (F.sum, lambda before, now: F.when(before.isNull(), now).when(now.isNull(), before).otherwise(before + now), lambda a, b: b if a is None else a if b is None else a + b),
    "count": (F.count, lambda before, now: F.coalesce(before, F.lit(0)) + now, lambda a, b: (a or 0) + b),
    "max": (F.max, F.greatest, lambda a, b: b if a is None else a if b is None else max(a, b)),
    "min": (F.min, F.least, lambda a, b: b if a is None else a if b is None else min(a, b)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda before, now: F.coalesce(now, before), lambda a, b: a if b is None else b),
}


def running(df: DataFrame, key: list[str], order: list, values: dict[str, tuple[str, Column]], parts: int | None = None) -> DataFrame:
    """Adds what runs along each sequence up to a row itself: (kind, column) by name, kinds as in RUNNING.

    Windows run within a part only. A part's first sequence may have begun in parts before: what it brings is taken from
    the totals of the sequences at the edges of parts, two for each part at most. So one sequence with a third of all
    rows runs in a third of the tasks. Sums skip nulls and are null before the first value, as in a window.
    """
    rows = laid_out(df.withColumns({f"_v{i}": column for i, (_, column) in enumerate(values.values())}), [*key, *order], parts)
    kinds = {name: RUNNING[kind] for name, (kind, _) in values.items()}
    own = F.struct(*key) if key else F.struct(F.lit(1).alias("_all"))
    edges = rows.groupBy("_part").agg(F.min_by(own, "_at").alias("first"), F.max_by(own, "_at").alias("last"))
    edges = {r["_part"]: (r["first"], r["last"]) for r in edges.collect()}  # two keys for each part
    spans = [p for p in sorted(edges)]
    carried = []
    if any(edges[a][1] == edges[b][0] for a, b in zip(spans, spans[1:], strict=False)):
        ends = rows.sparkSession.createDataFrame([(p, *(k if key else ())) for p in spans for k in {edges[p][0], edges[p][1]}], _fields(rows, key))
        same = [F.col("_part") == F.col("_p"), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]]
        totals = rows.join(F.broadcast(ends), same).groupBy("_part", own.alias("_key")).agg(
            *[kinds[name][0](F.col(f"_v{i}")).alias(f"_t{i}") if values[name][0] != "last" else F.max_by(f"_v{i}", F.when(F.col(f"_v{i}").isNotNull(), F.col("_at"))).alias(f"_t{i}") for i, name in enumerate(values)]
        )
        total = {(r["_part"], r["_key"]): r for r in totals.collect()}
        state: list = []
        for a, b in zip(spans, spans[1:], strict=False):
            key_of = edges[a][1]
            if edges[a][0] != key_of or not state:
                state = [None] * len(values)
            if edges[b][0] != key_of:
                state = []
                continue
            state = [kinds[name][2](x, total[a, key_of][f"_t{i}"]) for i, (name, x) in enumerate(zip(values, state, strict=True))]
            carried.append((b, *(key_of if key else ()), *state))
    within = Window.partitionBy("_part", *key).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = rows.withColumns({name: kinds[name][0](F.col(f"_v{i}")).over(within) for i, name in enumerate(values)})
    if carried:
        kinds_of = made.select(*values).schema
        schema = _fields(rows, key) + "".join(f", _b{i} {f.dataType.simpleString()}" for i, f in enumerate(kinds_of))
        before = rows.sparkSession.createDataFrame(carried, schema)
        same = [F.col("_part") == F.col("_p"), *[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]]
        made = made.join(F.broadcast(before), same, "left")
        for i, name in enumerate(values):
            made = made.withColumn(name, kinds[name][1](F.col(f"_b{i}"), F.col(name)))
        made = made.drop("_p", *[f"_k{i}" for i in range(len(key))], *[f"_b{i}" for i in range(len(values))])
    return made.drop("_part", "_at", *[f"_v{i}" for i in range(len(values))])


def _fields(rows: DataFrame, key: list[str]) -> str:
    return "_p int" + "".join(f", _k{i} {rows.schema[k].dataType.simpleString()}" for i, k in enumerate(key))
