"""Sensory dissonance of sounds, chords and ratios, and the map of it over three ratios."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.functions import dims, music

HARMONICS, BASE_HERTZ = 6, 220.0
#: Nodes of the map along each of alpha, beta and gamma, from LOW to HIGH.
NODES, LOW, HIGH = 150, 1.0, 2.0


def roughness_of(partials: Column) -> Column:
    """The dissonance of an array of (f, a) in ascending order: a sum over all pairs, 0 with fewer than two.

    Partials of one sound are a few dozen; the sum over its pairs is an expression, no pair is a row.
    """
    c = dims.ROUGHNESS

    def pair(low: Column, high: Column) -> Column:
        x = F.lit(c["dstar"]) / (low["f"] * c["s1"] + c["s2"]) * (high["f"] - low["f"])
        return F.least(low["a"], high["a"]) * (F.lit(c["c1"]) * F.exp(x * c["a1"]) + F.lit(c["c2"]) * F.exp(x * c["a2"]))

    rows = F.transform(partials, lambda low, i: F.aggregate(F.slice(partials, i + 2, F.size(partials)), F.lit(0.0), lambda s, high: s + pair(low, high)))
    return F.aggregate(rows, F.lit(0.0), lambda s, x: s + x)


def partials_of(hertz: Column, harmonics: int = HARMONICS, decay: bool = False) -> Column:
    """The partials of an array of voices, ascending; with ``decay`` the h-th has an amplitude of 1/h, else of 1."""
    amplitude = lambda h: F.lit(1.0) / h if decay else F.lit(1.0)
    over = lambda f: F.transform(F.sequence(F.lit(1), F.lit(harmonics)), lambda h: F.struct((f * h).alias("f"), amplitude(h).alias("a")))
    return F.array_sort(F.flatten(F.transform(hertz, over)))


def bound(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, whatever it is used for."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def roughness_of_rows(voices: np.ndarray, harmonics: int = HARMONICS, decay: bool = False) -> np.ndarray:
    """roughness_of the partials of each row of voices; pairs are added in the same order, for all rows at once."""
    c, over = dims.ROUGHNESS, np.arange(1, harmonics + 1)
    hertz = (voices[:, :, None] * over).reshape(len(voices), -1)
    loud = np.broadcast_to(1.0 / over if decay else np.ones(harmonics), (voices.shape[1], harmonics)).reshape(-1)[None, :].repeat(len(voices), axis=0)
    order = np.lexsort((loud, hertz), axis=1)
    f, a = (np.ascontiguousarray(np.take_along_axis(x, order, axis=1).T) for x in (hertz, loud))
    total = np.zeros(len(voices))
    for i in range(len(f)):
        scale, row = c["dstar"] / (f[i] * c["s1"] + c["s2"]), np.zeros(len(voices))
        for j in range(i + 1, len(f)):
            x = scale * (f[j] - f[i])
            row += np.minimum(a[i], a[j]) * (c["c1"] * np.exp(x * c["a1"]) + c["c2"] * np.exp(x * c["a2"]))
        total += row
    return total


def dissonance_of_voices(hertz: Column, harmonics: int = HARMONICS, decay: bool = False) -> Column:
    """roughness_of the partials of an array of voices, in Arrow batches: for columns of tables, whose rows are many.

    As an expression each of some hundred pairs is interpreted for each row. Null where a voice is missing.
    """

    @F.arrow_udf("double")
    def of(rows: pa.Array) -> pa.Array:
        made, sizes = np.full(len(rows), np.nan), rows.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        known = np.ones(len(rows), bool)
        for n in np.unique(sizes):
            own = np.flatnonzero(sizes == n)
            if n <= 0:
                made[own], known[own] = 0.0, n == 0
                continue
            voices = rows.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            known[own] = ~np.isnan(voices).any(axis=1)
            made[own] = roughness_of_rows(voices, harmonics, decay)
        return pa.array(made, pa.float64(), mask=~known)

    return of(hertz)


def dissonance_of_steps(steps: Column, harmonics: int = HARMONICS) -> Column:
    """The dissonance of absolute steps at their own height, with fading partials; 0 for fewer than two notes."""
    found = dissonance_of_voices(F.transform(steps, music.hertz_of_step), harmonics, decay=True)
    return F.when(F.size(steps) >= 2, found).otherwise(F.lit(0.0))


def dissonance_of_ratios(alpha: Column, beta: Column, gamma: Column, base: Column | float = BASE_HERTZ, harmonics: int = HARMONICS) -> Column:
    """The dissonance of a root and three ratios above it, with equal partials."""
    base = base if isinstance(base, Column) else F.lit(base)
    return bound(partials_of(F.array(base, base * alpha, base * beta, base * gamma), harmonics), roughness_of)


# --- the map


def node_value(index: Column, nodes: int = NODES) -> Column:
    return F.lit(LOW) + index * ((HIGH - LOW) / (nodes - 1))


def dissonance_map(spark: SparkSession, nodes: int = NODES, base: float = BASE_HERTZ, harmonics: int = HARMONICS) -> DataFrame:
    """(i, j, k, d): the dissonance at every node of the map. Rows are made where they are used, none is stored."""
    grid = spark.range(nodes**3).select(*[(F.expr(f"id div {nodes**p}") % nodes).cast("int").alias(n) for n, p in (("i", 2), ("j", 1), ("k", 0))])
    return grid.withColumn("d", dissonance_of_ratios(*[node_value(F.col(n), nodes) for n in "ijk"], base, harmonics))


def map_stats(diss_map: DataFrame) -> DataFrame:
    """Mean, population deviation and extremes of the map where its ratios ascend."""
    return diss_map.where("i <= j and j <= k").agg(F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), F.min("d").alias("least"), F.max("d").alias("most"), F.count("*").alias("n"))


def bracket(value: Column, nodes: int = NODES) -> Column:
    """The node at or below a ratio, at most the last but one, and the share of the way to the next."""
    at = (value - LOW) * ((nodes - 1) / (HIGH - LOW))
    # A value on a node belongs to the bracket below it, but for the first.
    low = F.least(F.greatest(F.ceil(at).cast("int") - 1, F.lit(0)), F.lit(nodes - 2))
    return F.struct(low.alias("low"), (at - low).alias("share"))


def corners(alpha: Column, beta: Column, gamma: Column, nodes: int = NODES) -> Column:
    """The eight nodes around a point with their weights; null outside of the map."""
    sides = [bracket(v, nodes) for v in (alpha, beta, gamma)]
    made = []
    for bits in range(8):
        up = [bits >> p & 1 for p in (2, 1, 0)]
        weight = F.lit(1.0)
        for side, one in zip(sides, up, strict=True):
            weight = weight * (side["share"] if one else F.lit(1.0) - side["share"])
        made.append(F.struct(*[(side["low"] + one).alias(n) for side, one, n in zip(sides, up, "ijk", strict=True)], weight.alias("w")))
    inside = alpha.between(LOW, HIGH) & beta.between(LOW, HIGH) & gamma.between(LOW, HIGH)
    return F.when(inside, F.array(*made))


def interpolated(points: DataFrame, diss_map: DataFrame, key: list[str], nodes: int = NODES, default: float | None = None) -> DataFrame:
    """(key, d) of points (key, alpha, beta, gamma): the map's value between its nodes; ``default`` outside of it.

    A point meets eight nodes; where points repeat, give distinct ones.
    """
    around = F.explode_outer(corners(F.col("alpha"), F.col("beta"), F.col("gamma"), nodes)).alias("_c")
    spread = points.select(*key, around).select(*key, *[F.col(f"_c.{n}").alias(f"_{n}") for n in "ijkw"])
    own = diss_map.select(*[F.col(n).alias(f"_m{n}") for n in "ijk"], F.col("d").alias("_d"))
    joined = spread.join(own, [F.col(f"_{n}") == F.col(f"_m{n}") for n in "ijk"], "left")
    return joined.groupBy(*key).agg(F.coalesce(F.sum(F.col("_w") * F.col("_d")), F.lit(default).cast("double")).alias("d"))


def dissonance_dim(spark: SparkSession, nodes: int = NODES, base: float = BASE_HERTZ, harmonics: int = HARMONICS) -> DataFrame:
    """(third, fifth, seventh, d): the interpolated map for all that a chord can be told to be, 396 rows.

    A missing third or seventh is null. Only the nodes around these points are computed, the map itself isn't needed.
    """
    rows = [(t, f, s) for t in [None, *dims.THIRDS] for f in dims.FIFTHS for s in [None, *dims.SEVENTHS]]
    points = spark.createDataFrame(rows, "third int, fifth int, seventh int")
    alpha, beta = F.coalesce(music.ratio_of_step(F.col("third")), F.lit(1.0)), music.ratio_of_step(F.col("fifth"))
    around = points.withColumn("c", F.explode(corners(alpha, beta, F.coalesce(music.ratio_of_step(F.col("seventh")), beta), nodes)))
    value = dissonance_of_ratios(*[node_value(F.col(f"c.{n}"), nodes) for n in "ijk"], base, harmonics)
    return around.withColumn("v", value * F.col("c.w")).groupBy("third", "fifth", "seventh").agg(F.sum("v").alias("d"))


# --- reference chords


def reference_chords() -> list[tuple[str, float, float, float]]:
    """Names and ratios of the known chords of 53 steps: a third and a seventh on a perfect, lowered or raised fifth.

    Fixed values: the names. Regular ones are a third's sign and a seventh's.
    """
    sevenths = dict(zip(("SM7", "^M7", "maj7", "vM7", "N7", "n7", "^m7", "m7", "vm7", "sm7"), range(51, 41, -1), strict=True))
    thirds = dict(zip(("SM", "^M", "M", "vM", "N", "n", "^m", "m", "vm", "sm"), range(20, 10, -1), strict=True))
    short = {"Mmaj7": "maj7", "mm7": "m7", "vmm7": "vm7", "smm7": "sm7"}
    rows = [(short.get(t + s, t + s), third, 31, seventh) for t, third in thirds.items() for s, seventh in sevenths.items()]
    lowered = {
        14: ("øSM7", "ø^M7", "ømaj7", "øvM7", "øN7", "øn7", "ø^m7", "ø7", "øvm7", "øsm7"),
        13: ("øS7", "ø^M7-m", "ømaj7-m", "øvM7-m", "øNM7", "øn7-m", "øv7", "ø7-m", "øvm7-m", "øsm7-m"),
        12: ("vøS7", "vø^M7", "vømaj7", "vøvM7", "vøN7", "vøn7", "vø^m7", "vø7", "vøvm7", "vøsm7"),
        11: ("søS7", "sø^M7", "sømaj7", "søvM7", "søN7", "søn7", "sø^m7", "sø7", "søvm7", "søsm7"),
    }
    rows += [(name, third, 26, 51 - k) for third, names in lowered.items() for k, name in enumerate(names)]
    raised = ("S7", "^M7", "maj7", "vM7", "NM7", "N7", "n7", "m7", "vm7", "sm7")
    rows += [(sign + name, third, 35, 51 - k) for sign, third in (("M+", 18), ("SM+", 20), ("sus4+", 22)) for k, name in enumerate(raised)]
    rows += [("7sus4", 22, 31, 44), ("sus2", 9, 22, 31)]
    rows += [(f"{t}P", third, 31, 31) for t, third in reversed(thirds.items())] + [("sus4P", 22, 31, 31)]
    rows += [(f"{t}tri", third, 26, 26) for t, third in (("sø", 11), ("vø", 12), ("ø-m", 13), ("ø", 14))]
    rows += [(f"{t}tri", third, 35, 35) for t, third in (("M+", 18), ("SM+", 20), ("sus4+", 22))]
    return [(name, *(2 ** (step / dims.STEPS) for step in steps)) for name, *steps in rows]


def semitone_chords() -> list[tuple[str, float, float, float]]:
    """Names and ratios of ten known chords of twelve semitones. Names and semitones."""
    rows = [
        ("maj7", 4, 7, 11), ("min7", 3, 7, 10), ("dom7", 4, 7, 10), ("mM7", 3, 7, 11), ("ø7", 3, 6, 10),
        ("dim7", 3, 6, 9), ("aug7", 4, 8, 10), ("augM7", 4, 8, 11), ("7sus4", 5, 7, 10), ("sus2", 2, 5, 7),
    ]
    return [(name, *(2 ** (s / 12) for s in steps)) for name, *steps in rows]


def reference_table(spark: SparkSession) -> DataFrame:
    """(nth, name, system, alpha, beta, gamma, cents of each, dissonance, in_tetrahedron) of both lists, in their order."""
    rows = [(i, n, system, a, b, g) for system, chords in (("53-TET", reference_chords()), ("12-TET", semitone_chords())) for i, (n, a, b, g) in enumerate(chords)]
    table = spark.createDataFrame(rows, "nth int, name string, system string, alpha double, beta double, gamma double")
    cents = {f"{c}_cents": music.cents_of_ratio(F.col(c)) for c in ("alpha", "beta", "gamma")}
    return table.withColumns(cents).withColumn("dissonance", dissonance_of_ratios(F.col("alpha"), F.col("beta"), F.col("gamma"))).withColumn("in_tetrahedron", F.expr("alpha <= beta and beta <= gamma"))
