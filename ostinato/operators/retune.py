"""Retuning of message tables: every note gets a channel of its own and the bend that its pitch class has in a scale.

A message table has (file, track, seq, tick, type, channel, note, velocity) in any names of key columns; types are ``on``,
``off``, ``bend`` and whatever else a file holds. Ticks are absolute, so what is dropped or added leaves no gap to close.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ostinato.functions import dims, music
from ostinato.operators import sequence

# Steps of the semitones of an octave, moved steps of two intervals, and named patterns' white keys.
SEMITONE_STEPS = [0, 5, 9, 14, 17, 22, 27, 31, 36, 39, 44, 48]
PURE_INTERVALS = {4: -1, 10: -1}
WHITE_KEYS = [0, 2, 4, 5, 7, 9, 11]
INTERVAL_NAMES = ["C-D", "D-E", "E-F", "F-G", "G-A", "A-B", "B-C"]
MESSAGE_TYPE = "array<struct<type:string, channel:int, note:int, value:int>>"


# --- scales from patterns


def is_pattern(pattern: list[int]) -> bool:
    """Whether seven distances fill the octave."""
    return len(pattern) == len(WHITE_KEYS) and sum(pattern) == dims.STEPS


def pattern_scale(pattern: list[int], bias: float = 0.5) -> list[int]:
    """The steps of twelve pitch classes: white keys by the pattern, a black key at a share of the way between two.

    The share is rounded half to even. Raises ValueError unless seven distances fill the octave.
    """
    if not is_pattern(pattern):
        raise ValueError(f"seven distances that sum to {dims.STEPS} are needed: {pattern}")
    white = {pc: sum(pattern[:k]) for k, pc in enumerate(WHITE_KEYS)}
    black = {pc + 1: white[pc] + round(pattern[k] * bias) for k, pc in enumerate(WHITE_KEYS) if pc + 1 not in white and pc + 1 < 12}
    return [(white | black)[pc] for pc in range(12)]


def pattern_table(spark: SparkSession, patterns: dict[str, list[int]], bias: float = 0.5) -> DataFrame:
    """(pattern, pc, step, cents) of named patterns; cents are from the semitone."""
    rows = [(name, pc, step) for name, p in patterns.items() for pc, step in enumerate(pattern_scale(p, bias))]
    table = spark.createDataFrame(rows, "pattern string, pc int, step int")
    return table.withColumn("cents", F.col("step") * F.lit(1200.0) / dims.STEPS - F.col("pc") * 100)


def cents_table(patterns: DataFrame, names: list[str]) -> DataFrame:
    """A row for each pitch class, a column of cents for each pattern, to one place."""
    return patterns.groupBy("pc").pivot("pattern", names).agg(F.first(F.round("cents", 1)))


def pattern_report(df: DataFrame, pattern: str, key: list[str]) -> DataFrame:
    """(key, ok, missing, nth, interval, steps, cents): whether an array of distances is a pattern, and its intervals."""
    p = F.col(pattern)
    total = F.aggregate(p, F.lit(0), lambda s, x: s + x)
    ok = (F.size(p) == len(WHITE_KEYS)) & (total == dims.STEPS)
    names = F.array(*[F.lit(n) for n in INTERVAL_NAMES])
    rows = df.select(*key, ok.alias("ok"), (F.lit(dims.STEPS) - total).alias("missing"), F.posexplode_outer(F.when(ok, p)).alias("nth", "steps"))
    return rows.select(*key, "ok", "missing", "nth", F.get(names, F.col("nth")).alias("interval"), "steps", F.round(F.col("steps") * F.lit(1200.0) / dims.STEPS, 1).alias("cents"))


# --- scalar conversions


def steps_of_semitones(semitones: Column) -> Column:
    """The steps of a number of semitones, octave by octave."""
    table = F.array(*[F.lit(s) for s in SEMITONE_STEPS])
    return F.floor(semitones / 12).cast("int") * dims.STEPS + F.element_at(table, (F.pmod(semitones, F.lit(12)) + 1).cast("int"))


def steps_above(root_step: Column, step: Column) -> Column:
    """The distance from a root up to a step within the octave."""
    return F.pmod(step - root_step, F.lit(dims.STEPS))


def pure_offsets(notes: Column) -> Column:
    """By how many steps each note of a chord moves for purer thirds and sevenths above its lowest note."""
    moved = F.create_map(*[F.lit(x) for kv in PURE_INTERVALS.items() for x in kv])
    return F.transform(notes, lambda n: F.coalesce(moved[F.pmod(n - F.array_min(notes), F.lit(12)).cast("int")], F.lit(0)))


def bend_of_semitones(semitones: Column, reach: int = 2) -> Column:
    """A bend in a range of semitones: 8191 for the whole range up, 8192 down, truncated."""
    share = F.least(F.greatest(semitones / reach, F.lit(-1.0)), F.lit(1.0))
    return F.when(share >= 0, share * 8191).otherwise(share * 8192).cast("int")


def bend_of_pattern(note: Column, step: Column) -> Column:
    """The bend of a note whose pitch class has a step in a pattern."""
    return bend_of_semitones((step * F.lit(1200.0) / dims.STEPS - F.pmod(note, F.lit(12)) * 100) / 100)


def reference_of_note(notes: DataFrame, references: DataFrame, note: str = "note") -> DataFrame:
    """Adds ``reference``, of (reference, midi, bend) the one of the same note with the least bend; else an estimate."""
    best = references.groupBy("midi").agg(F.min_by("reference", F.struct(F.abs("bend"), "reference")).alias("_ref"))
    estimate = F.rint((F.col(note) - 69) * F.lit(dims.STEPS / 12)).cast("int") + 159
    return notes.join(best, F.col(note) == F.col("midi"), "left").withColumn("reference", F.coalesce("_ref", estimate)).drop("_ref", "midi")


def key_of_stem(stem: Column) -> Column:
    """(key, tonality) at the end of a file's stem, in any case; C major where there is none."""
    part = lambda k: F.regexp_extract(stem, r"(?i)_([a-z#]+)_(major|minor)$", k)
    name = F.concat(F.upper(F.substring(part(1), 1, 1)), F.lower(F.substr(part(1), F.lit(2))))
    found = part(1) != ""
    return F.struct(F.when(found, name).otherwise("C").alias("key"), F.when(found, F.lower(part(2))).otherwise("major").alias("tonality"))


# --- files


def _own_channels(df: DataFrame, file: list[str], note: list[str], order: list[str]) -> DataFrame:
    """Adds ``_channel``: channels 1 to 15 in turn for beginnings; an end takes that of the beginning just before it."""
    begins = F.col("type") == "on"
    turn = (F.sum(begins.cast("int")).over(sequence.before_and_now(file, order)) - 1) % 15 + 1
    numbered = df.withColumn("_turn", F.when(begins, turn).cast("int"))
    # Only beginnings and ends of the same note decide: what stands just before an end tells whether it has a beginning.
    pair = Window.partitionBy(*file, *note, F.col("type").isin("on", "off")).orderBy(*order)
    opened = F.lag("_turn").over(pair)
    return numbered.withColumn("_channel", F.coalesce("_turn", F.when(F.col("type") == "off", opened))).drop("_turn")


def _value(df: DataFrame) -> Column:
    """What a message that stays has: its velocity, or its bend where the table has bends."""
    return (F.coalesce("velocity", "bend") if "bend" in df.columns else F.col("velocity")).cast("int")


def _spread(df: DataFrame, parts: Column, file: list[str], order: list[str]) -> DataFrame:
    out = df.withColumn("_parts", parts).select(*file, *order, "tick", F.posexplode("_parts").alias("nth", "m"))
    return out.select(*file, *order, "nth", "tick", "m.type", "m.channel", "m.note", "m.value")


def retuned_by_scale(df: DataFrame, file: list[str], order: list[str], step: Column) -> DataFrame:
    """(file, order, nth, tick, type, channel, note, value): messages retuned by the ``step`` of each note's pitch class.

    A bend stands before a beginning unless it is 0, and one of 0 after each end; an end without a beginning keeps its
    channel; all other messages stay, with their velocity, or their ``bend`` if there are any, in ``value``. Velocity 0 ends
    a note.
    """
    rows = df.withColumn("type", F.when((F.col("type") == "on") & (F.col("velocity") == 0), "off").otherwise(F.col("type")))
    rows = _own_channels(rows, file, ["note"], order)
    cents = music.cents_between(music.retuned_hertz(F.col("note"), step), music.hertz_of_note(F.col("note")))
    # Rounded to nine places before it is truncated: a whole number of cents doesn't depend on the last bits.
    bend = F.least(F.greatest(F.round(cents / 200 * 8192, 9).cast("int"), F.lit(-8192)), F.lit(8191))
    message = lambda kind, channel, note, value: F.struct(F.lit(kind).alias("type"), channel.cast("int").alias("channel"), note.cast("int").alias("note"), value.cast("int").alias("value"))
    none, zero, own = F.lit(None), F.lit(0), F.coalesce("_channel", "channel")
    begin = message("on", own, F.col("note"), F.col("velocity"))
    bent = F.when(bend != 0, F.array(message("bend", own, none, bend), begin)).otherwise(F.array(begin))
    ended = F.array(message("off", own, F.col("note"), F.col("velocity")), message("bend", own, none, zero))
    same = F.array(F.struct("type", F.col("channel").cast("int").alias("channel"), F.col("note").cast("int").alias("note"), _value(df).alias("value")))
    parts = F.when(F.col("type") == "on", bent).when(F.col("type") == "off", ended).otherwise(same)
    return _spread(rows, parts.cast(MESSAGE_TYPE), file, order)


def retuned_by_pattern(df: DataFrame, file: list[str], order: list[str], step: Column) -> DataFrame:
    """As retuned_by_scale, by a pattern: each beginning has its bend, ends have none after them, source bends go.

    The time since the message before a bend that goes is lost, as its delta goes with it: all that follows in the track
    is earlier by it. ``order`` is the track and the place in it.
    """
    rows = df.withColumn("type", F.when((F.col("type") == "on") & (F.col("velocity") == 0), "off").otherwise(F.col("type")))
    track, place = [*file, order[0]], order[1:]
    delta = F.col("tick") - F.coalesce(F.lag("tick").over(sequence.ordered(track, place)), F.lit(0))
    rows = rows.withColumn("_lost", F.when(F.col("type") == "bend", delta).otherwise(F.lit(0)))
    rows = rows.withColumn("tick", F.col("tick") - F.sum("_lost").over(sequence.before_and_now(track, place))).where("type <> 'bend'")
    rows = _own_channels(rows, file, ["channel", "note"], order)
    bend = bend_of_pattern(F.col("note"), step)
    message = lambda kind, channel, note, value: F.struct(F.lit(kind).alias("type"), channel.cast("int").alias("channel"), note.cast("int").alias("note"), value.cast("int").alias("value"))
    own = F.coalesce("_channel", "channel")
    begin = F.array(message("bend", own, F.lit(None), bend), message("on", own, F.col("note"), F.col("velocity")))
    ended = F.array(message("off", own, F.col("note"), F.col("velocity")))
    same = F.array(F.struct("type", F.col("channel").cast("int").alias("channel"), F.col("note").cast("int").alias("note"), _value(df).alias("value")))
    return _spread(rows, F.when(F.col("type") == "on", begin).when(F.col("type") == "off", ended).otherwise(same).cast(MESSAGE_TYPE), file, order)


def all_patterns(messages: DataFrame, patterns: DataFrame, file: str, order: list[str], done: DataFrame | None = None) -> DataFrame:
    """Every file by every pattern of (pattern, pc, step), a small table, but for the (file, pattern) that are ``done``."""
    from ostinato.operators.joins import small

    work = messages.select(file).distinct().crossJoin(small(patterns.select("pattern").distinct()))
    if done is not None:
        work = work.join(done.select(file, "pattern").distinct(), [file, "pattern"], "left_anti")
    rows = messages.join(work, file).join(small(patterns.select(F.col("pattern").alias("_p"), F.col("pc").alias("_pc"), F.col("step").alias("_step"))), (F.col("pattern") == F.col("_p")) & (F.pmod(F.col("note"), F.lit(12)) == F.col("_pc")), "left")
    return retuned_by_pattern(rows, [file, "pattern"], order, F.col("_step"))


# --- checks


def bend_errors(df: DataFrame, file: list[str], order: list[str], step: Column) -> DataFrame:
    """(file, n, mismatches, most_cents, n_on, n_off, channels): bends before notes against those that the scale asks for.

    A note's bend is that of its channel since the channel's last note. One unit off is rounding.
    """
    channel = [*file, "channel"]
    before = F.count_if(F.col("type") == "on").over(sequence.ordered(channel, order).rowsBetween(Window.unboundedPreceding, -1))
    run = Window.partitionBy(*channel, "_before").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("_before", before).withColumn("_bend", F.coalesce(F.last(F.when(F.col("type") == "bend", F.col("value")), ignorenulls=True).over(run), F.lit(0)))
    off = step - F.pmod(F.col("note"), F.lit(12)) * dims.STEPS / 12
    wanted = F.least(F.greatest(F.round(off * 1200 / dims.STEPS / 200 * 8192, 9).cast("int"), F.lit(-8192)), F.lit(8191))
    error = F.when(F.col("type") == "on", F.abs(F.col("_bend") - wanted))
    return rows.withColumn("_error", error).groupBy(*file).agg(
        F.count("_error").alias("n"), F.count_if(F.col("_error") > 1).alias("mismatches"), F.round(F.max("_error") / 8192 * 200, 6).alias("most_cents"),
        F.count_if(F.col("type") == "on").alias("n_on"), F.count_if(F.col("type") == "off").alias("n_off"), F.countDistinct(F.when(F.col("type") == "on", F.col("channel"))).alias("channels"),
    )


def message_counts(df: DataFrame, file: list[str]) -> DataFrame:
    """(file, type, n, bends, lowest, highest): how many messages of each type, distinct bends and their range."""
    bend = F.when(F.col("type") == "bend", F.col("value"))
    return df.groupBy(*file, "type").agg(F.count("*").alias("n"), F.countDistinct(bend).alias("bends"), F.min(bend).alias("lowest"), F.max(bend).alias("highest"))


def stuck_files(df: DataFrame, file: list[str], note: list[str], order: list[str]) -> DataFrame:
    """(files, stuck, pct): files with a note whose last message of its own is a beginning."""
    last = df.where(F.col("type").isin("on", "off")).groupBy(*file, *note).agg(F.max_by("type", F.struct(*order)).alias("_last"))
    each = last.groupBy(*file).agg(F.max((F.col("_last") == "on").cast("int")).alias("_stuck"))
    return each.agg(F.count("*").alias("files"), F.sum("_stuck").alias("stuck"), F.round(F.avg("_stuck") * 100, 6).alias("pct"))


def extrapolated(stuck: DataFrame, total: int) -> DataFrame:
    """Adds what a share of a sample is of all files, rounded down."""
    return stuck.withColumn("estimate", F.floor(F.col("pct") / 100 * total))
