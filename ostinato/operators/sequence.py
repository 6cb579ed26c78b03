"""Operators on ordered events: positions, running states, grouping, chunks, encoding and decoding.

All of them are windows over one sequence key, or functions of arrays of one sequence. A caller that chains several should
``repartition`` by the key once: windows and groupings over the same key then share that one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ostinato.functions import dims, music
from ostinato.operators.anchors import anchor_groups as anchor_groups


def ordered(key: list[str], order: list) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(*order)


def before_and_now(key: list[str], order: list) -> WindowSpec:
    return ordered(key, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def with_position(df: DataFrame, key: list[str], order: list, name: str = "pos") -> DataFrame:
    """Numbers the rows of each sequence from 0."""
    return df.withColumn(name, F.row_number().over(ordered(key, order)) - 1)


def running_count(df: DataFrame, key: list[str], order: list, what: Column, name: str) -> DataFrame:
    """How many rows up to and with this one meet a condition."""
    return df.withColumn(name, F.sum(F.when(what, 1).otherwise(0)).over(before_and_now(key, order)))


def gathered(df: DataFrame, key: list[str], pos: str = "pos", token: str = "tok") -> DataFrame:
    """(key, toks): the tokens of each sequence as one array in their order, which costs one row in place of many."""
    rows = F.array_sort(F.collect_list(F.struct(pos, token)))
    return df.groupBy(*key).agg(F.transform(rows, lambda r: r[token]).alias("toks"))


def places(values: Column, what) -> Column:
    """Where in an array values meet a condition, from 1."""
    return F.filter(F.transform(values, lambda t, i: F.when(what(t), i + 1)), lambda i: i.isNotNull())


def blocks_of(tokens: Column, start: str = "CHORD_START", end: str = "CHORD_END") -> Column:
    """The blocks of block_spans in an array of tokens: structs of ``span``, ``at`` (from 1) and the block's ``toks``."""
    starts, ends, n = places(tokens, lambda t: t == start), places(tokens, lambda t: t == end), F.size(tokens)
    # The n-th block goes on to the n-th end, but not beyond the next start; an end that came before leaves nothing.
    bounds = F.zip_with(F.zip_with(starts, F.slice(starts, 2, F.size(starts)), lambda a, b: F.struct(a.alias("a"), F.coalesce(b - 1, n).alias("b"))), F.slice(ends, 1, F.size(starts)), lambda s, e: F.struct(s["a"].alias("a"), F.least(s["b"], F.coalesce(e, n)).alias("b")))
    made = F.transform(bounds, lambda s, k: F.struct(k.alias("span"), s["a"].alias("at"), s["b"].alias("to")))
    kept = F.filter(made, lambda s: s["to"] >= s["at"])
    return F.transform(kept, lambda s: F.struct(s["span"].alias("span"), s["at"].alias("at"), F.slice(tokens, s["at"], s["to"] - s["at"] + 1).alias("toks")))


def chords_of(tokens: Column, mark: str = ".") -> Column:
    """The chords of chord_spans in an array of tokens: an array for each, from its mark to before the next."""
    at = places(tokens, lambda t: t == mark)
    return F.zip_with(at, F.concat(F.slice(at, 2, F.size(at)), F.array(F.size(tokens) + 1)), lambda a, b: F.slice(tokens, a, F.coalesce(b, a) - a))


def chord_spans(df: DataFrame, key: list[str], order: list, token: str = "tok", mark: str = ".") -> DataFrame:
    """Adds ``span``: -1 before the first chord, then the number of the chord that is the last to have begun.

    What stands between two chords belongs to the one before.
    """
    return running_count(df, key, order, F.col(token) == mark, "span").withColumn("span", (F.col("span") - 1).cast("int"))


def block_spans(df: DataFrame, key: list[str], order: list, token: str = "tok", start: str = "CHORD_START", end: str = "CHORD_END") -> DataFrame:
    """Adds ``span``: the number of the block from its start to its end token, -1 outside of blocks."""
    begun = F.sum(F.when(F.col(token) == start, 1).otherwise(0)).over(before_and_now(key, order))
    ended = F.coalesce(F.sum(F.when(F.col(token) == end, 1).otherwise(0)).over(ordered(key, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("span", F.when(begun > ended, begun - 1).otherwise(-1).cast("int"))


def inside_blocks(df: DataFrame, key: list[str], order: list, **names) -> DataFrame:
    """Only tokens of blocks that end; what is outside of blocks, or in one without an end, goes."""
    spanned = block_spans(df, key, order, **names)
    done = Window.partitionBy(*key, "span")
    end = names.get("end", "CHORD_END")
    return spanned.withColumn("_done", F.max((F.col(names.get("token", "tok")) == end).cast("int")).over(done)).where("span >= 0 and _done = 1").drop("_done")


def local_positions(df: DataFrame, key: list[str], order: list, pos: str = "pos", token: str = "tok", start: str = "CHORD_START", end: str = "CHORD_END", most: int = 19) -> DataFrame:
    """Adds ``local``: how far a token is into its block, at most ``most``; 0 outside."""
    spanned = block_spans(df, key, order, token, start, end)
    at = F.last(F.when(F.col(token) == start, F.col(pos)), ignorenulls=True).over(before_and_now(key, order))
    return spanned.withColumn("local", F.when(F.col("span") >= 0, F.least(F.col(pos) - at, F.lit(most))).otherwise(0).cast("int"))


def onsets(df: DataFrame, key: list[str], order: list, duration: str, name: str = "onset") -> DataFrame:
    """The sum of all durations before a row."""
    return df.withColumn(name, F.sum(duration).over(before_and_now(key, order)) - F.col(duration))


def clip_to_next(df: DataFrame, key: list[str], order: list, onset: str, duration: str) -> DataFrame:
    """Durations end where the next onset is, if that is later than their own."""
    gap = F.lead(onset).over(ordered(key, order)) - F.col(onset)
    return df.withColumn(duration, F.when((gap > 0) & (F.col(duration) > gap), gap).otherwise(F.col(duration)))


def harmonic_rhythm(df: DataFrame, key: list[str], order: list, onset: str, duration: str, least: float = 0.5, name: str = "rhythm") -> DataFrame:
    """The time to the next onset, at least ``least``; the last row keeps its own duration."""
    gap = F.lead(onset).over(ordered(key, order)) - F.col(onset)
    return df.withColumn(name, F.when(gap.isNull(), F.col(duration)).otherwise(F.greatest(gap, F.lit(least))))


def bar_lines(df: DataFrame, key: list[str], order: list, onset: str, beats: float = 4.0) -> DataFrame:
    """One row for each bar that begins before a chord, with its number; none before the first chord."""
    bars = df.withColumn("_bar", F.floor(F.col(onset) / beats).cast("int"))
    bars = bars.withColumn("_last", F.max("_bar").over(ordered(key, order).rowsBetween(Window.unboundedPreceding, -1)))
    return bars.where(F.col("_bar") > F.col("_last")).withColumn("bar", F.explode(F.sequence(F.col("_last") + 1, F.col("_bar")))).drop("_bar", "_last")


def form_of_bars(df: DataFrame, key: list[str], order: list, pos: str = "pos", token: str = "tok", bar: str = "|") -> DataFrame:
    """(key, bar_no, form): a form marker belongs to the bar that follows; of several the last counts."""
    counted = running_count(df, key, order, F.col(token) == bar, "bar_no").withColumn("form", music.form_label(F.when(F.col(token).rlike("(?i)^form_"), F.col(token))))
    return counted.where("form is not null").groupBy(*key, "bar_no").agg(F.max_by("form", pos).alias("form"))


def rolling_mean(df: DataFrame, key: list[str], order: list, value: str, width: int = 5, name: str = "rolling") -> DataFrame:
    """The centred mean of an odd number of rows; null where some are missing."""
    around = ordered(key, order).rowsBetween(-(width // 2), width // 2)
    return df.withColumn(name, F.when(F.count(value).over(around) == width, F.avg(value).over(around)))


def round_robin(df: DataFrame, key: list[str], order: list, channels: int = 15, name: str = "channel") -> DataFrame:
    """Channels from 1, in turn."""
    return df.withColumn(name, (F.row_number().over(ordered(key, order)) - 1) % channels + 1)


def deltas(df: DataFrame, key: list[str], order: list, tick: str, name: str = "delta") -> DataFrame:
    """Ticks since the row before; the first row's own tick."""
    return df.withColumn(name, F.col(tick) - F.coalesce(F.lag(tick).over(ordered(key, order)), F.lit(0)))


def chords_from_notes(df: DataFrame, key: list[str], anchor: str = "anchor", offset: str = "offset", step: str = "step", velocity: str = "velocity", least: float = 0.25) -> DataFrame:
    """Notes of a group become a chord: from its anchor to the last offset, at least ``least`` long, notes low to high."""
    notes = F.array_sort(F.collect_list(F.struct(F.col(step).alias("step"), F.col(velocity).alias("velocity"))))
    made = df.groupBy(*key, anchor).agg(F.max(offset).alias("_end"), notes.alias("notes"))
    return made.select(*key, F.col(anchor).alias("onset"), F.greatest(F.col("_end") - F.col(anchor), F.lit(least)).alias("duration"), "notes")


def pair_notes(df: DataFrame, key: list[str], order: list, kind: str = "type", tick: str = "tick", value: str = "value", on: str = "on", off: str = "off", bend: str = "bend", note: list[str] | None = None) -> DataFrame:
    """Notes of a message table: each ``on`` whose next on or off of the same note is an ``off``, with the bend in force.

    A second on before the off takes the note over and the older one is lost, as is one without an end.
    """
    bent = df.withColumn("bend_now", F.coalesce(F.last(F.when(F.col(kind) == bend, F.col(value)), ignorenulls=True).over(before_and_now(key, order)), F.lit(0)))
    notes = bent.where(F.col(kind).isin(on, off))
    own = ordered([*key, *(note or [])], order)
    notes = notes.withColumn("_next", F.lead(kind).over(own)).withColumn("end", F.lead(tick).over(own))
    return notes.where((F.col(kind) == on) & (F.col("_next") == off)).drop("_next")


def notes_until_next(df: DataFrame, key: list[str], order: list, kind: str = "type", tick: str = "tick", on: str = "on", note: list[str] | None = None, least=0) -> DataFrame:
    """Notes that end with the next message of their own, be it an off or another on; shorter ones than ``least`` go."""
    own = ordered([*key, *(note or [])], order)
    ended = df.withColumn("end", F.lead(tick).over(own))
    return ended.where((F.col(kind) == on) & F.col("end").isNotNull() & (F.col("end") - F.col(tick) > least))


def encode_chords(df: DataFrame, key: list[str], onset: str = "onset", duration: str = "duration", notes: str = "notes", beats: float = 4.0, prefix: str = "PV") -> DataFrame:
    """(key, pos, tok): the token stream of chords with their bars, rhythm and notes, and a start and an end token.

    encoded_arrays as rows.
    """
    return encoded_arrays(df, key, onset, duration, notes, beats, prefix).select(*key, F.posexplode("toks").alias("pos", "tok"))


def encoded_arrays(df: DataFrame, key: list[str], onset: str = "onset", duration: str = "duration", notes: str = "notes", beats: float = 4.0, prefix: str = "PV") -> DataFrame:
    """(key, toks): the token stream of each sequence of chords as one array.

    A note is one token of step and velocity bin; at most eight, the lowest, are kept and steps are clamped to their range.
    """
    order = [onset]
    bars = df.withColumn("_bar", F.floor(F.col(onset) / beats).cast("int")).withColumn("_last", F.max(F.floor(F.col(onset) / beats).cast("int")).over(ordered(key, order).rowsBetween(Window.unboundedPreceding, -1)))
    timed = harmonic_rhythm(bars, key, order, onset, duration)
    low = F.slice(F.array_sort(F.col(notes)), 1, dims.MOST_NOTES)
    step = lambda n: F.least(F.greatest(n["step"], F.lit(dims.LOWEST_STEP)), F.lit(dims.HIGHEST_STEP))
    chord = F.concat(
        F.array_repeat(F.lit("BAR"), F.greatest(F.coalesce(F.col("_bar") - F.col("_last"), F.lit(0)), F.lit(0))),
        F.array(F.lit("CHORD_START"), F.concat(F.lit("DUR_"), music.quantised_duration(F.col("rhythm")).cast("string"))),
        F.transform(low, lambda n: F.concat_ws("_", F.lit(prefix), step(n).cast("string"), music.velocity_bin(n["velocity"]).cast("string"))),
        F.array(F.lit("CHORD_END")),
    )
    grouped = timed.select(*key, F.col(onset).alias("_at"), chord.alias("_toks")).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_at", "_toks"))).alias("_all"))
    stream = F.concat(F.array(F.lit("<start>")), F.flatten(F.transform("_all", lambda c: c["_toks"])), F.array(F.lit("<end>")))
    return grouped.select(*key, stream.alias("toks"))


def decode_stream(df: DataFrame, key: list[str], pos: str = "pos", token: str = "tok") -> DataFrame:
    """(key, chord, onset, duration, notes) of a token stream; compound and separate pitch and velocity tokens are read.

    Blocks without a note are dropped and don't advance the time.
    """
    return decoded_songs(gathered(df, key, pos, token), key)


def decoded_songs(songs: DataFrame, key: list[str], end: str = "CHORD_END") -> DataFrame:
    """decode_stream of (key, toks), a row for each song: only chords are rows of their own, tokens never are."""
    closed = F.filter(blocks_of(F.col("toks"), end=end), lambda b: F.coalesce(F.array_contains(b["toks"], end), F.lit(False)))
    rows = songs.select(*key, F.explode(closed).alias("_b")).select(*key, F.col("_b.span").cast("int").alias("span"), F.col("_b.toks").alias("_toks"))
    number = lambda t, pattern, group: F.nullif(F.regexp_extract(t, pattern, group), F.lit(""))

    def note(token: Column, i: Column) -> Column:
        level = F.coalesce(number(token, r"^(?:PV|H)_(\d+)_(\d+)$", 2), number(F.get("_toks", i + 1), r"^V_(\d+)$", 1), F.lit("4"))
        return F.struct(number(token, r"^(?:PV|H|P)_(\d+)(?:_(\d+))?$", 1).cast("int").alias("step"), music.velocity_of_bin(level.cast("int")).alias("velocity"))

    sounds = lambda t: t.rlike(r"^(?:PV|H|P)_(\d+)(?:_(\d+))?$")
    notes = F.filter(F.transform("_toks", lambda t, i: F.when(sounds(t), note(t, i))), lambda n: n.isNotNull())
    durations = F.filter(F.transform("_toks", lambda t: F.when(t.startswith("DUR_"), F.regexp_extract(t, "^DUR_(.+)$", 1).try_cast("double"))), lambda d: d.isNotNull())
    chords = rows.select(*key, "span", F.coalesce(F.try_element_at(durations, F.lit(-1)), F.lit(1.0)).alias("duration"), F.sort_array(notes).alias("notes"))
    return onsets(chords.where(F.size("notes") > 0), key, ["span"], "duration").select(*key, F.col("span").alias("chord"), "onset", "duration", "notes")


def chunks(df: DataFrame, key: list[str], pos: str, value: str, length: int, pad) -> DataFrame:
    """(key, chunk, values): sequences cut into pieces of one length, the last one padded. Empty sequences give none."""
    pieces = df.withColumn("chunk", F.floor(F.col(pos) / length).cast("int")).groupBy(*key, "chunk").agg(F.array_sort(F.collect_list(F.struct(pos, value))).alias("_rows"))
    values = F.transform("_rows", lambda r: r[value])
    return pieces.select(*key, "chunk", pad_or_cut(values, length, pad).alias("values"), F.size("_rows").alias("n_real"))


def pad_or_cut(values: Column, length: int, pad) -> Column:
    return F.slice(F.concat(values, F.array_repeat(F.lit(pad), length)), 1, length)


def wrapped(values: Column, start: str = "<start>", end: str = "<end>") -> Column:
    return F.concat(F.array(F.lit(start)), values, F.array(F.lit(end)))


def shifted_pairs(df: DataFrame, key: list[str], order: list, value: str) -> DataFrame:
    """Rows with their successor as ``target``; the last row of a sequence has none and goes."""
    return df.withColumn("target", F.lead(value).over(ordered(key, order))).where("target is not null")


def repeated_body(df: DataFrame, key: list[str], pos: str, header: Column, short: Column, times: int = 3) -> DataFrame:
    """Rows of sequences that are ``short`` stand ``times`` times in a row, but for those of the header; positions are new."""
    n = F.when(short & ~header, F.lit(times)).otherwise(F.lit(1))
    again = df.withColumn("_turn", F.explode(F.sequence(F.lit(1), n)))
    return again.withColumn(pos, F.row_number().over(Window.partitionBy(*key).orderBy(F.when(header, 0).otherwise(1), "_turn", pos)) - 1).drop("_turn")


def trim_to_window(df: DataFrame, onset: str, duration: str, start: Column, end: Column, clip_start: bool = True) -> DataFrame:
    """Events that overlap a window, cut to it, with times from its start. Without ``clip_start`` only ends are cut."""
    stop = F.col(onset) + F.col(duration)
    begin = F.greatest(F.col(onset), start) if clip_start else F.col(onset)
    kept = df.where((F.col(onset) < end) & (stop > start)).withColumn("_begin", begin).withColumn("_stop", F.least(stop, end))
    return kept.withColumn(duration, F.col("_stop") - F.col("_begin")).withColumn(onset, F.col("_begin") - start).drop("_begin", "_stop")
