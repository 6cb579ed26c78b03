"""Moments of vectors and exact quantiles with small states, whatever the number of rows or of different values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ostinato.functions.batches import bounded
from ostinato.functions.shared import cut

#: Bins of a range of values in a pass, and ranges that may be broadcast.
BINS, SMALL_TABLE = 4096, 100_000
PARTIALS = "dim int, n long, mean double, m2 double"


def partial_moments(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(dim, count, mean, sum of squared deviations) of the values at each place of arrays; nulls don't count."""
    lists = lists.filter(lists.is_valid())
    lengths = np.asarray(lists.value_lengths(), np.int64)
    values = lists.flatten()
    dims = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    there = np.asarray(values.is_valid())
    dims, numbers = dims[there], values.drop_null().cast(pa.float64()).to_numpy()
    n = np.bincount(dims)
    means = np.bincount(dims, numbers, len(n)) / np.maximum(n, 1)
    m2 = np.bincount(dims, (numbers - means[dims]) ** 2, len(n))
    own = np.flatnonzero(n)
    return own, n[own], means[own], m2[own]


def array_moments(df: DataFrame, column: str) -> DataFrame:
    """(dim, n, mean, std) of each place of an array column, from 0; deviations are those of the population.

    Tasks reduce batches to a count, a mean and squared deviations for each place, which are merged pairwise by the
    exact formula for two parts; so neither the width nor the number of rows has to be known before.
    """
    to = to_arrow_schema(StructType.fromDDL(PARTIALS))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(partial_moments(batch.column(0)), to, strict=True)], schema=to)

    parts = bounded(df.select(column)).mapInArrow(reduce, PARTIALS)
    listed = parts.groupBy("dim").agg(F.collect_list(F.struct("n", "mean", "m2")).alias("parts"))  # one for each batch
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def merged(a: Column, b: Column) -> Column:
        n, gap = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + gap * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + gap * gap * a["n"] * b["n"] / n).alias("m2"))

    whole = listed.select("dim", F.aggregate("parts", none, merged).alias("m"))
    return whole.select("dim", "m.n", "m.mean", F.sqrt(F.col("m.m2") / F.col("m.n")).alias("std"))


def _share_of_range(value: Column, low: Column, high: Column) -> Column:
    """How far a value is from one end of a range to the other, never falling; by logarithms where these are far apart."""
    up = F.log(value / low) / F.log(high / low)
    down = 1 - F.log(value / high) / F.log(low / high)
    return F.when((low > 0) & (high > low * BINS), up).when((high < 0) & (low < high * BINS), down).otherwise((value - low) / (high - low))


def exact_quantiles(df: DataFrame, group: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """(group, a column for each share): exact quantiles, linear between the two values that a share lies between.

    Each value that is asked for is a rank. The range in which it lies begins with all values and is cut in BINS of
    equal width, or equal ratio; the counts of bins tell which one holds the rank, and the least and largest value in this bin are the
    next range, until both are the same. Only counts of bins are shuffled: a pass for about three decimal places, two or
    three in all for most data. Nulls, NaN and infinite values don't count; a group without values isn't there.
    """
    keys = [f"_g{i}" for i in range(len(group))]
    value = value.cast("double")
    rows = df.select(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)], value.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") < float("inf")))
    rows = rows.withColumn("_key", F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all")))
    base = rows.groupBy("_key").agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    place = lambda q: F.lit(q) * (F.col("n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(q)), F.ceil(place(q))) for q in shares.values()])))
    targets = cut(base.select("_key", "n", F.explode(ranks).alias("rank"), "low", "high", F.lit(0).cast("long").alias("before")))
    while pending := targets.where("low < high").count():
        ranges = targets.where("low < high").select("_key", "low", "high").distinct()
        ranges = F.broadcast(ranges) if pending <= SMALL_TABLE else ranges
        within = rows.select("_key", "_v").join(ranges, "_key").where("_v between low and high")
        bin_of = F.least(F.floor(_share_of_range(F.col("_v"), F.col("low"), F.col("high")) * BINS), F.lit(BINS - 1))
        bins = within.groupBy("_key", "low", "high", bin_of.alias("bin")).agg(F.count("*").alias("own"), F.min("_v").alias("least"), F.max("_v").alias("most"))
        upto = F.sum("own").over(Window.partitionBy("_key", "low", "high").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        counted = bins.withColumn("first", upto - F.col("own"))
        met = targets.where("low < high").join(counted, ["_key", "low", "high"]).where("before + first <= rank and rank < before + first + own")
        nearer = met.select("_key", "n", "rank", F.col("least").alias("low"), F.col("most").alias("high"), (F.col("before") + F.col("first")).alias("before"))
        targets = cut(targets.where("low = high").unionByName(nearer))
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("low")))
    made = targets.groupBy("_key", "n").agg(*[x for name, q in shares.items() for x in (at(F.floor(place(q))).alias(f"_lo_{name}"), at(F.ceil(place(q))).alias(f"_hi_{name}"))])
    between = [(F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (place(q) - F.floor(place(q)))).alias(name) for name, q in shares.items()]
    return made.select(*[F.col(f"_key.{k}").alias(g) for g, k in zip(group, keys, strict=True)], *between)
