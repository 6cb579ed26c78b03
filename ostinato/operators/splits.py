"""Splits, shuffles and samples that are the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ostinato.operators import ranges


def seeded(key: Column, seed: int) -> Column:
    """A number of 60 bits that depends on a key and a seed only, the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"))), 1, 15), 16, 10).cast("long")


def hashed_split(df: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """Adds ``split``: validation for about a share of the keys, train for the others; no shuffle, any size."""
    share = F.pmod(seeded(F.col(key), seed), F.lit(1_000_000)) < int(ratio * 1_000_000)
    return df.withColumn("split", F.when(share, "validation").otherwise("train"))


#: Hashes of 60 bits are counted in so many ranges.
RANGES = 1 << 14


def exact_split(df: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """As hashed_split, but with exactly max(1, floor(n * ratio)) validation keys, those with the smallest hashes.

    Keys are counted in ranges of their hashes; only the range in which the last validation key lies is put in order.
    """
    width = (1 << 60) // RANGES
    keys = df.select(key).distinct().withColumn("_h", seeded(F.col(key), seed)).withColumn("_range", F.expr(f"_h div {width}").cast("int"))
    counted = keys.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = counted.withColumn("_before", before).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    wanted = F.greatest(F.lit(1), F.floor(F.col("_all") * F.lit(ratio)))
    placed = keys.join(F.broadcast(sized.select("_range", "_before", "_n", wanted.alias("_wanted"))), "_range")
    whole = placed.where("_before + _n <= _wanted").select(F.col(key).alias("_k"))
    last = placed.where("_before < _wanted and _before + _n > _wanted")
    last = last.withColumn("_r", F.row_number().over(Window.partitionBy("_range").orderBy("_h", key)) + F.col("_before")).where("_r <= _wanted").select(F.col(key).alias("_k"))
    chosen = whole.unionByName(last)
    return df.join(chosen, F.col(key).eqNullSafe(F.col("_k")), "left").withColumn("split", F.when(F.col("_k").isNotNull(), "validation").otherwise("train")).drop("_k")


def positional_split(df: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each sequence, in a total order, are the first part.

    Only these are ranked, which Spark prunes before it deals them; the others are compared with the last of them.
    """
    place = F.struct(*order)
    ranked = df.select(*key, place.alias("_at")).withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("_at"))).where(F.col("_n") <= n)
    last = ranked.groupBy(*key).agg(F.max("_at").alias("_last"))
    return df.join(last, key).withColumn("split", F.when(place <= F.col("_last"), "first").otherwise("second")).drop("_last")


def windowed_shuffle(df: DataFrame, ordinal: str, width: int, seed: int = 42) -> DataFrame:
    """Adds ``shuffled``: rows ordered by it and their ordinal are shuffled in runs of ``width`` that stay together."""
    return df.withColumn("shuffled", seeded(F.floor(F.col(ordinal) / width).cast("long"), seed))


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 7) -> DataFrame:
    """n rows of each group, those with the smallest hashes."""
    w = Window.partitionBy(group).orderBy(seeded(F.col(key), seed), key)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def windowed_order(df: DataFrame, order: list[str], width: int, seed: int = 42, name: str = "place") -> DataFrame:
    """Adds ``place``: rows in an order are shuffled in runs of ``width`` that stay together; ordinals of two total orders."""
    numbered, _ = ranges.numbered(df, order, "_i")
    return ranges.numbered(windowed_shuffle(numbered, "_i", width, seed), ["shuffled", "_i"], name)[0].drop("shuffled", "_i")


def random_batch(df: DataFrame, ordinal: str, total: int, size: int, seed: int) -> DataFrame:
    """``size`` draws with replacement from ordinals below ``total``."""
    draws = df.sparkSession.range(size).select(F.col("id").alias("draw"), F.pmod(seeded(F.col("id"), seed), F.lit(total)).alias(ordinal))
    return draws.join(df, ordinal)


def drawn(df: DataFrame, order: list[str], size: int, seed: int) -> DataFrame:
    """``size`` draws with replacement from all rows, in a total order; none from an empty table."""
    numbered, total = ranges.numbered(df, order, "_i")
    return random_batch(numbered, "_i", max(1, total), size, seed).drop("_i")


def presentation_order(df: DataFrame, group: list[str], key: str, seed: int) -> DataFrame:
    """Adds ``place``: a shuffled order within each group, such as the clips of a listener. Groups may be of any size."""
    hashed = df.withColumn("_h", seeded(F.col(key), seed))
    placed = ranges.running(hashed, group, ["_h", key], {"place": ("count", F.lit(1))})
    return placed.withColumn("place", (F.col("place") - 1).cast("int")).drop("_h")


def top_k_filter(df: DataFrame, group: list[str], score: str, k: int) -> DataFrame:
    """Rows whose score is at least the k-th best of their group; ties at the threshold stay."""
    w = Window.partitionBy(*group).orderBy(F.col(score).desc())
    return df.withColumn("_r", F.rank().over(w)).where(F.col("_r") <= k).drop("_r")


def with_of_group(df: DataFrame, group: list[str], value: Column, name: str) -> DataFrame:
    """Adds an aggregate of each group, which is summed up before it is dealt: a group is never one task."""
    made = df.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]).agg(value.alias(name))
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    return df.join(made, same).drop(*[f"_g{i}" for i in range(len(group))])


def nucleus(df: DataFrame, group: list[str], score: str, order: list, share: float, shifted: bool = False) -> DataFrame:
    """Rows that reach a share of their group's softmax, from the best; the row that crosses it is the last to stay.

    With ``shifted`` a row that begins just at the share stays too. Running sums are rounded to 9 places before they are
    compared; they run over parts of a group, so a group may hold any share of all rows.
    """
    topped = with_of_group(df, group, F.max(score), "_top").withColumn("_e", F.exp(F.col(score) - F.col("_top")))
    weighted = with_of_group(topped, group, F.sum("_e"), "_sum").withColumn("prob", F.col("_e") / F.col("_sum")).withColumn("_down", -F.col(score))
    summed = ranges.running(weighted, group, ["_down", *order], {"_run": ("sum", F.col("prob"))})
    before = F.round(F.col("_run") - F.col("prob"), 9)
    keep = before <= share if shifted else before < share
    return summed.where(keep).drop("_top", "_e", "_sum", "_down", "_run")
