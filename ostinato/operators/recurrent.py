"""Recurrences over one sequence, where each step depends on what the step before did.

Each sequence becomes one row with an array of its events, of which songs have some hundred, and batches of such rows go to
Python; a group of its own for every short song would cost more than its work. Everything that a window can say is in
``sequence``; only true recurrences are here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ostinato.functions.batches import arrow, bounded, plain

# Qualities and extensions that contradict each other, and the one to take out.
CONTRADICTIONS = {
    ("dom7", "sus7", "add b9"): "dom7", ("sus4", "add 7", "dom7"): "dom7", ("dom7", "sus4", "add b9"): "dom7", ("sus7", "add 13", "sus4"): "sus4",
    ("sus7", "add 9", "sus4"): "sus4", ("dom7", "add 13", "sus7"): "sus7", ("dom7", "add 13", "sus4"): "sus4", ("dom7", "add 9", "sus7"): "sus7",
    ("dom7", "add 9", "add #5", "add b9"): "add 9", ("m", "add 6", "add 9", "sus4"): "sus4", ("sus7", "add 13", "sus4", "add b9"): "sus4",
    ("dom7", "add 13", "sus4", "add b9"): "sus4",
}
REPAIR_ENDS = (".", "|", "||", ":|", "|:", "b||", "e||", "/")
NOTES_TYPE = "array<struct<step: int, velocity: int>>"


def per_sequence(df: DataFrame, key: str, columns: list[str], run: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """Calls ``run`` with the events of each sequence, sorted by ``columns``; it returns rows without the key."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {schema}"
    to = to_arrow_schema(StructType.fromDDL(schema))

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, events = (plain(batch.column(k)) for k in (0, 1))
            made = [(k, *row) for k, rows in zip(keys, events, strict=True) for row in run(rows)]
            yield pa.RecordBatch.from_arrays([arrow([r[i] for r in made], f.type) for i, f in enumerate(to)], schema=to)

    grouped = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_events"))
    return bounded(grouped).mapInArrow(call, schema)


def per_song(songs: DataFrame, key: str, run: Callable[[list], tuple], schema: str) -> DataFrame:
    """Calls ``run`` with the tokens of each row of (key, toks); it returns one row without the key."""
    schema = f"{key} {songs.schema[key].dataType.simpleString()}, {schema}"
    to = to_arrow_schema(StructType.fromDDL(schema))

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [run(tokens) for tokens in plain(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(to[0].type), *(arrow([r[i] for r in made], f.type) for i, f in enumerate(list(to)[1:]))], schema=to)

    return bounded(songs.select(key, "toks")).mapInArrow(call, schema)


def each_of_song(songs: DataFrame, key: str, place: str, run: Callable[[list], list[tuple]], schema: str) -> DataFrame:
    """Calls ``run`` with the array of each row of (key, array); it returns tuples that can be hashed, a row each.

    A row has the key, its place from 0 and the tuple's values. What repeats within a batch is made an Arrow value once.
    """
    schema = f"{key} {songs.schema[key].dataType.simpleString()}, {place} int, {schema}"
    to = to_arrow_schema(StructType.fromDDL(schema))

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple, int] = {}
            which: list[int] = []
            ends = [0]
            for events in plain(batch.column(1)):
                which += [known.setdefault(row, len(known)) for row in run(events)]
                ends.append(len(which))
            sizes, taken = np.diff(ends), pa.array(np.array(which, np.int32))
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))).cast(to[0].type)
            places = pa.array((np.arange(len(which)) - np.repeat(ends[:-1], sizes)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([keys, places, *(arrow([r[i] for r in known], f.type).take(taken) for i, f in enumerate(list(to)[2:]))], schema=to)

    return bounded(songs).mapInArrow(call, schema)


# --- cleaning


def merged_chords(chords: list[dict], least: int) -> list[dict]:
    """Chords with fewer notes than ``least`` give them to the neighbour that is nearer in time, the earlier one if both are."""
    chords, changed = [dict(c) for c in chords], True
    while changed:
        changed, at = False, 0
        while at < len(chords):
            if len(chords) == 1 or len(chords[at]["notes"]) >= least:
                at += 1
                continue
            gone = chords.pop(at)
            sides = [k for k in (at - 1, at) if 0 <= k < len(chords)]
            target = min(sides, key=lambda k: abs(gone["onset"] - chords[k]["onset"]))
            known = {n["step"] for n in chords[target]["notes"]}
            fresh = {n["step"]: n for n in reversed(gone["notes"]) if n["step"] not in known}
            chords[target]["notes"] = sorted([*chords[target]["notes"], *fresh.values()], key=lambda n: n["step"])
            changed = True
    return chords


def cut_tail(chords: list[dict], most: int) -> list[dict]:
    """At the end no chord stands more than ``most`` times in a row, nor a pair of chords in turn more than that."""
    sign = [tuple(sorted(n["step"] for n in c["notes"])) for c in chords]
    if len(chords) <= most:
        return chords
    run = 1
    while run < len(sign) and sign[-run - 1] == sign[-1]:
        run += 1
    if run > most:
        chords, sign = chords[: len(chords) - run + most], sign[: len(sign) - run + most]
    if len(chords) >= 2 * most + 2 and sign[-1] != sign[-2]:
        run = 2
        while run < len(sign) and sign[-run - 1] == sign[-run + 1]:
            run += 1
        if run > 2 * most:
            chords = chords[: len(chords) - run + 2 * most]
    return chords


def clean_chords(df: DataFrame, key: str, least: int = 3, most: int = 2, with_notes: bool = False) -> DataFrame:
    """(key, chord, onset, duration, n_notes, steps) of (key, onset, duration, notes) after merging and cutting.

    ``with_notes`` gives the notes themselves in place of the steps as text.
    """

    def clean(chords: list[dict]) -> list[tuple]:
        kept = cut_tail(merged_chords(chords, least), most)
        shown = lambda c: c["notes"] if with_notes else " ".join(str(n["step"]) for n in c["notes"])
        return [(i, c["onset"], c["duration"], len(c["notes"]), shown(c)) for i, c in enumerate(kept)]

    rows = df.select(key, F.col("onset").cast("double").alias("onset"), F.col("duration").cast("double").alias("duration"), F.col("notes").cast(NOTES_TYPE).alias("notes"))
    return per_sequence(rows, key, ["onset", "duration", "notes"], clean, "chord int, onset double, duration double, n_notes int, " + (f"notes {NOTES_TYPE}" if with_notes else "steps string"))


# --- form


def expand(tokens: list[str], most: int = 3000) -> list[int] | None:
    """Places of a chart's tokens in the order in which they are played, or None where that is longer than ``most``.

    A section between ``|:`` and ``:|`` is played twice; one without a beginning starts at the first token. Within it
    ``Repeat_1`` begins what is left out the second time, up to after its ``:|``. After all repeats ``b||`` goes back to
    the sign (or the last ``Form_A`` before it) once, and then ``e||`` goes on at ``b||``.
    """
    played: list[int] = []
    sign = next((i for i, t in enumerate(tokens) if t == "Form_Segno"), None)
    if sign is None:
        sign = next((i for i in range(len(tokens) - 1, -1, -1) if tokens[i] == "Form_A"), 0)
    coda = next((i for i in range(len(tokens) - 1, -1, -1) if tokens[i] == "b||"), None)
    begin, again, returned, at = 0, set(), False, 0
    while at < len(tokens):
        if len(played) > most:
            return None
        token = tokens[at]
        if token == "|:":
            begin = at
        elif token.startswith("Repeat") and begin in again and (end := _end_of_section(tokens, at)) is not None:
            if token in ("Repeat_1", "Repeat_0"):
                begin, at = end + 1, end + 1
                continue
        elif token == ":|":
            played.append(at)
            if begin not in again and not returned:
                again.add(begin)
                at = begin
            else:
                at += 1
                begin = at
            continue
        elif token == "e||" and returned and coda is not None and coda > at:
            played.append(at)
            at = coda + 1
            continue
        elif token == "b||" and not returned and "e||" in tokens[:at]:
            returned, at = True, sign
            continue
        played.append(at)
        at += 1
    return played


def _end_of_section(tokens: list[str], at: int) -> int | None:
    return next((i for i in range(at, len(tokens)) if tokens[i] == ":|"), None)


def expand_charts(df: DataFrame, key: str) -> DataFrame:
    """(key, pos, tok, source_pos, ok): charts played out, repeat signs as plain bar lines; a chart too long has one row with ok false."""

    def run(events: list[dict]) -> list[tuple]:
        tokens, places = [e["tok"] for e in events], [e["pos"] for e in events]
        played = expand(tokens)
        if played is None:
            return [(0, None, None, False)]
        return [(i, "|" if tokens[k] in ("|:", ":|") else tokens[k], places[k], True) for i, k in enumerate(played)]

    return per_sequence(df.select(key, F.col("pos").cast("int").alias("pos"), "tok"), key, ["pos", "tok"], run, "pos int, tok string, source_pos int, ok boolean")


def expanded_songs(songs: DataFrame, key: str) -> DataFrame:
    """expand_charts of (key, toks), a row for each song; ``source_pos`` is the place in the array."""

    def run(tokens: list[str]) -> tuple:
        played = expand(tokens)
        return (["|" if tokens[k] in ("|:", ":|") else tokens[k] for k in played], played, True) if played is not None else ([None], [None], False)

    made = per_song(songs, key, run, "toks array<string>, places array<int>, ok boolean")
    return made.select(key, "ok", F.posexplode(F.arrays_zip("toks", "places")).alias("pos", "_x")).select(key, "pos", F.col("_x.toks").alias("tok"), F.col("_x.places").alias("source_pos"), "ok")


def without_doubled(tokens: list[str]) -> list[str]:
    """A token list without immediate repeats of an extension such as ``add 9``."""
    return [b for a, b in pairwise(["", *tokens]) if not (a == b and b.split(" ")[0] in ("add", "alter", "subtract"))]


def without_contradictions(tokens: list[str], passes: int = 4) -> list[str]:
    """A token list with one quality of each contradicting pair taken out.

    Two places after a token that has a dot in it, distinct tokens are gathered up to a structural or form token. Where they
    are the start of CONTRADICTIONS' entries at a token, the one to take out goes: it is looked for as if three had been
    gathered, so of four it is its right neighbour that goes. Passes are repeated, as one can make way for the next.
    """
    tokens = list(tokens)
    for _ in range(passes):
        at, whole = 0, len(tokens)
        while at < len(tokens):
            if "." in tokens[at]:
                seen: list[str] = []
                here, last = at + 2, ""
                while here < len(tokens):
                    # The last token of a list is never looked at, the one before it stands for it.
                    last = tokens[here] if here < len(tokens) - 1 else last
                    if last in REPAIR_ENDS or last.startswith("Form_"):
                        break
                    if last not in seen:
                        seen.append(last)
                    gone = CONTRADICTIONS.get(tuple(seen)) if 3 <= len(seen) <= 4 else None
                    if gone is not None and (place := seen.index(gone) + here - 2) < len(tokens):
                        tokens.pop(place)
                    here += 1
            at += 1
        if len(tokens) == whole:
            break  # what changed nothing changes nothing again
    return tokens


def repaired_charts(df: DataFrame, key: str) -> DataFrame:
    """(key, pos, tok) of (key, pos, tok) without contradicting qualities."""
    rows = df.select(key, F.col("pos").cast("int").alias("pos"), F.coalesce("tok", F.lit("")).alias("tok"))
    return per_sequence(rows, key, ["pos", "tok"], lambda events: list(enumerate(without_contradictions([e["tok"] for e in events]))), "pos int, tok string")


def repaired_songs(songs: DataFrame, key: str) -> DataFrame:
    """(key, toks) of (key, toks), a row for each song, without contradicting qualities."""
    return per_song(songs, key, lambda tokens: (without_contradictions([t or "" for t in tokens]),), "toks array<string>")


# --- stuck notes, in windows


def close_stuck_notes(df: DataFrame, file: list[str], note: list[str], order: list, tick: str = "tick", kind: str = "type", tolerance: int = 20) -> DataFrame:
    """The missing ends of notes: (file, note, tick, reason).

    A note that is begun anew before it ended is closed then, or at the next onset in the file beyond the tolerance if that
    is earlier; one that never ends is closed at that onset, or at the file's last tick.
    """
    later = Window.partitionBy(*file).orderBy(tick).rangeBetween(tolerance + 1, Window.unboundedFollowing)
    own = Window.partitionBy(*file, *note).orderBy(*order)
    whole = Window.partitionBy(*file)
    rows = df.withColumn("_onset", F.min(F.when(F.col(kind) == "on", F.col(tick))).over(later)).withColumn("_last", F.max(tick).over(whole))
    rows = rows.where(F.col(kind).isin("on", "off")).withColumn("_kind", F.lead(kind).over(own)).withColumn("_tick", F.lead(tick).over(own))
    taken, orphan = (F.col(kind) == "on") & (F.col("_kind") == "on"), (F.col(kind) == "on") & F.col("_kind").isNull()
    closed = F.when(taken, F.least("_tick", "_onset")).when(orphan, F.coalesce("_onset", "_last"))
    return rows.where(taken | orphan).select(*file, *note, closed.alias(tick), F.when(taken, "taken over").otherwise("no end").alias("reason"))
