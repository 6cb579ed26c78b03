"""Statistics of tokens, lengths, vectors and pitches, and checks of token grammar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ostinato.functions import dissonance, music
from ostinato.operators import moments


def frequencies(df: DataFrame, token: str, top: int | None = None) -> DataFrame:
    """Counts, the most frequent first, equal ones by token."""
    counted = df.groupBy(token).agg(F.count("*").alias("n"))
    return counted if top is None else counted.orderBy(F.col("n").desc(), token).limit(top)


def top_with_share(df: DataFrame, token: str, top: int, ignore: Column) -> DataFrame:
    """The most frequent tokens that aren't ignored and their share of all such in percent."""
    counted = df.where(~ignore).groupBy(token).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("_all"))
    return counted.orderBy(F.col("n").desc(), token).limit(top).crossJoin(total).select(token, "n", F.round(F.col("n") * 100 / F.col("_all"), 6).alias("pct"))


def distribution(df: DataFrame, token: str, category: Column) -> DataFrame:
    """category, n, percent of all rows, and distinct tokens."""
    counted = df.groupBy(category.alias("category")).agg(F.count("*").alias("n"), F.countDistinct(token).alias("n_distinct"))
    share = F.col("n") * 100 / F.sum("n").over(Window.partitionBy())
    return counted.withColumn("pct", F.round(share, 6))


def length_stats(df: DataFrame, length: str) -> DataFrame:
    return df.agg(F.min(length).alias("shortest"), F.max(length).alias("longest"), F.round(F.avg(length), 1).alias("mean"))


def padding_stats(df: DataFrame, real: str, full: int) -> DataFrame:
    """Padding of sequences that are filled up to a length: mean, median, deviation, exact percentiles, and heavy cases."""
    pad = F.greatest(F.lit(full) - F.col(real), F.lit(0))
    rows = df.select(pad.alias("pad"))
    counted = rows.agg(
        F.count("*").alias("n"), F.round(F.avg("pad"), 6).alias("mean"), F.round(F.stddev_pop("pad"), 6).alias("std"),
        F.count_if(F.col("pad") > full * 0.5).alias("over_half"), F.count_if(F.col("pad") > full * 0.9).alias("over_nine_tenths"),
    )
    placed = moments.exact_quantiles(rows, [], F.col("pad"), {"p5": 0.05, "median": 0.5, "p95": 0.95})
    one = counted.join(placed, F.lit(True), "left")  # a row each
    return one.select("n", "mean", "std", *[F.round(c, 6).alias(c) for c in ("p5", "median", "p95")], "over_half", "over_nine_tenths")


def vector_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """dim, mean and population deviation of each column, one row each, in one pass."""
    sums = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])
    packed = F.array(*[F.struct(F.lit(c).alias("dim"), F.col(f"mean_{c}").alias("mean"), F.col(f"std_{c}").alias("std")) for c in columns])
    return sums.select(F.explode(packed).alias("_r")).select("_r.dim", F.round("_r.mean", 6).alias("mean"), F.round("_r.std", 6).alias("std"))


def describe_by(df: DataFrame, group: str, value: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles by group."""
    counted = df.groupBy(F.col(group).alias("_g")).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"))
    placed = moments.exact_quantiles(df, [group], F.col(value), {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    joined = counted.join(placed, F.col("_g").eqNullSafe(F.col(group)), "left")
    return joined.select(F.col("_g").alias(group), "n", "mean", "std", "least", *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p75")], "most")


def rest_folded(df: DataFrame, label: str, keep: int, other: str = "Other") -> DataFrame:
    """Counts of the most frequent labels, all others together. Labels are few: the ranking is over their counts."""
    counted = df.groupBy(label).agg(F.count("*").alias("n"))
    ranked = counted.withColumn("_r", F.row_number().over(Window.orderBy(F.col("n").desc(), label)))
    return ranked.groupBy(F.when(F.col("_r") <= keep, F.col(label)).otherwise(other).alias(label)).agg(F.sum("n").alias("n"))


def pitch_class_sets(df: DataFrame, key: list[str], step: str) -> DataFrame:
    """The set of pitch classes of each sequence, as text."""
    pcs = F.array_sort(F.collect_set(music.pitch_class(F.col(step))))
    return df.groupBy(*key).agg(F.array_join(F.transform(pcs, lambda x: x.cast("string")), " ").alias("signature"))


def microtonality(df: DataFrame, group: str, step: str, tolerance: float = 7.0) -> DataFrame:
    """Share of steps within a tolerance of a semitone, in percent, and the mean absolute deviation."""
    off = F.abs(music.cents_from_semitone(F.col(step)))
    return df.groupBy(group).agg(F.round(F.avg((off <= tolerance).cast("double")) * 100, 6).alias("pct_near"), F.round(F.avg(off), 6).alias("mean_cents"))


def accuracy(df: DataFrame, share: str) -> DataFrame:
    """Average, extremes and perfect cases of accuracies in percent."""
    return df.agg(F.round(F.avg(share), 6).alias("average"), F.min(share).alias("least"), F.max(share).alias("most"), F.round(F.avg((F.col(share) == 100).cast("double")) * 100, 6).alias("pct_perfect"))


def grammar_issues(df: DataFrame, key: list[str], pos: str = "pos", token: str = "tok", start: str = "CHORD_START", end: str = "CHORD_END") -> DataFrame:
    """(issue, n): how many sequences have each fault of token grammar; a sequence can have several."""
    w = Window.partitionBy(*key).orderBy(pos)
    tok = F.col(token)
    opened = F.sum(F.when(tok == start, 1).when(tok == end, -1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_open", F.coalesce(opened, F.lit(0))).withColumn("_block", F.sum((tok == start).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    blocks = rows.withColumn("_in", (F.col("_open") > 0) & (tok != end))
    each = blocks.groupBy(*key, "_block").agg(F.count_if(tok.startswith("DUR_")).alias("_dur"), F.count_if(tok.rlike("^(PV|P|H)_")).alias("_pv"), F.count_if(tok == start).alias("_s"), F.count_if(tok == end).alias("_e"), F.count_if((tok == start) & (F.col("_open") > 0)).alias("_nested"), F.count_if((tok == end) & (F.col("_open") <= 0)).alias("_orphan"), F.count_if(tok == "<start>").alias("_begin"), F.count_if(tok == "<end>").alias("_stop"), F.count("*").alias("_n"))
    whole = each.groupBy(*key).agg(
        (F.sum("_begin") == 0).alias("missing_start"), (F.sum("_stop") == 0).alias("missing_end"), (F.sum("_s") != F.sum("_e")).alias("pair_mismatch"), (F.sum("_nested") > 0).alias("nested_start"),
        (F.sum("_orphan") > 0).alias("orphan_end"), (F.count_if((F.col("_s") > 0) & (F.col("_dur") == 0)) > 0).alias("no_duration"), (F.count_if((F.col("_s") > 0) & (F.col("_pv") == 0)) > 0).alias("no_note"), (F.count_if((F.col("_s") > 0) & (F.col("_e") == 0)) > 0).alias("unclosed"),
    )
    names = ["missing_start", "missing_end", "pair_mismatch", "nested_start", "orphan_end", "no_duration", "no_note", "unclosed"]
    found = F.filter(F.array(*[F.when(F.col(n), F.lit(n)) for n in names]), lambda x: x.isNotNull())
    return whole.select(F.explode(found).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def in_tetrahedron(alpha: Column, beta: Column, gamma: Column, tolerance: float = 1e-6) -> Column:
    """Whether the ratios ascend."""
    return (alpha <= beta + tolerance) & (beta <= gamma + tolerance)


def coverage(used: DataFrame, vocabulary: DataFrame, token: str) -> DataFrame:
    """How much of a vocabulary occurs."""
    hits = vocabulary.select(token).distinct().join(used.select(token).distinct().withColumn("_u", F.lit(1)), token, "left")
    return hits.agg(F.count("*").alias("size"), F.count("_u").alias("used"), F.round(F.count("_u") * 100 / F.count("*"), 6).alias("pct"))


def roughness(df: DataFrame, key: list[str], frequency: str, amplitude: str) -> DataFrame:
    """(key, roughness): sensory dissonance summed over all pairs of a sound's partials; 0 with fewer than two."""
    sounds = df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(frequency).cast("double").alias("f"), F.col(amplitude).cast("double").alias("a")))).alias("_p"))
    return sounds.select(*key, dissonance.roughness_of(F.col("_p")).alias("roughness"))


def vocabulary_report(df: DataFrame, token: str) -> DataFrame:
    """(kind, tokens, n): how many different tokens of each kind there are, and how often they occur."""
    tok = F.col(token)
    kind = F.when(tok.isin("<start>", "<end>", "<pad>", "<unk>"), "special").when(tok.isin("CHORD_START", "CHORD_END", "BAR", "REST"), "structure")
    for prefix, name in (("DUR_", "duration"), ("TYPE_", "type"), ("PV_", "note"), ("H_", "note"), ("P_", "pitch"), ("V_", "velocity")):
        kind = kind.when(tok.startswith(prefix), name)
    return df.groupBy(kind.otherwise("other").alias("kind")).agg(F.countDistinct(token).alias("tokens"), F.count("*").alias("n"))


def share_counts(df: DataFrame, value: str) -> DataFrame:
    """(value, n, pct) of all values but null."""
    counted = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    return counted.withColumn("pct", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy()), 6))


def chord_histograms(chords: DataFrame) -> DataFrame:
    """(what, value, n, pct) of notes per chord, durations, qualities and roots of both_levels' chords."""
    rows = chords.select(F.explode(F.array(*[F.struct(F.lit(what).alias("what"), value.cast("string").alias("value")) for what, value in (("notes", F.size("pitches")), ("duration", F.col("duration")), ("quality", F.col("quality")), ("root", F.col("root")))])).alias("h"))
    counted = rows.select("h.*").where("value is not null").groupBy("what", "value").agg(F.count("*").alias("n"))
    return counted.withColumn("pct", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy("what")), 6))


def value_counts(df: DataFrame, value: str, top: int) -> DataFrame:
    """(value, n, n_distinct): the most frequent values, and how many different ones there are at all."""
    counted = df.groupBy(value).agg(F.count("*").alias("n"))
    return counted.orderBy(F.col("n").desc(), value).limit(top).crossJoin(counted.agg(F.count("*").alias("n_distinct")))


def axis_ranges(df: DataFrame, population: Column, axes: dict[str, tuple[float, float]], tolerance: float = 0.0) -> DataFrame:
    """(population, n, outside_<axis>): rows of each population whose value leaves an axis' range by more than a tolerance."""
    outside = [F.count_if((F.col(a) < low - tolerance) | (F.col(a) > high + tolerance)).alias(f"outside_{a}") for a, (low, high) in axes.items()]
    return df.groupBy(population.alias("population")).agg(F.count("*").alias("n"), *outside)


def stem_counts(df: DataFrame, stem: str, top: int = 10) -> DataFrame:
    """(what, value, n): the most frequent keys, types and last parts of file stems of at least four parts."""
    parts = F.split(stem, "_")
    rows = df.where(F.size(parts) >= 4)
    kind = F.get(F.filter(parts, lambda p: p.contains("type")), F.lit(0))
    pairs = F.array(*[F.struct(F.lit(w).alias("what"), v.alias("value")) for w, v in (("key", F.get(parts, F.lit(2))), ("type", kind), ("last", F.element_at(parts, -1)))])
    counted = rows.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null").groupBy("what", "value").agg(F.count("*").alias("n"))
    return counted.withColumn("_r", F.row_number().over(Window.partitionBy("what").orderBy(F.col("n").desc(), "value"))).where(F.col("_r") <= top).drop("_r")
