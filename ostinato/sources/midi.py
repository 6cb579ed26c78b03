"""Standard MIDI files: decoded to message rows by tasks that each read whole files, and encoded from message rows.

Only the bytes are read in Python. Pairing notes, bends in force, near-simultaneous onsets and chords are windows and folds
of ``operators.sequence`` over the rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ostinato.functions import music
from ostinato.functions.batches import bounded
from ostinato.operators import sequence

MESSAGES = "path string, track int, seq int, tick long, type string, channel int, note int, velocity int, bend int, ticks_per_beat int, error string"
# Message kinds by the high half of their status byte, and how many bytes of data they have.
DATA_BYTES = {0x8: 2, 0x9: 2, 0xA: 2, 0xB: 2, 0xC: 1, 0xD: 1, 0xE: 2}


class Malformed(ValueError):
    """Bytes that aren't a MIDI file."""


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A number of variable length and where it ends."""
    value = 0
    while True:
        if at >= len(data):
            raise Malformed("a number is cut off")
        value = value << 7 | data[at] & 127
        at += 1
        if data[at - 1] < 128:
            return value, at


def messages(data: bytes) -> Iterator[dict]:
    """Notes and bends of a file in order of track and place; each track's ticks start at 0."""
    if data[:4] != b"MThd" or len(data) < 14:
        raise Malformed("no header")
    size, _, _, per_beat = struct.unpack(">IHHH", data[4:14])
    at, track = 8 + size, 0
    while at + 8 <= len(data):
        kind, length = data[at : at + 4], struct.unpack(">I", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + length]
        if len(body) < length:
            raise Malformed("a track is cut off")
        if kind == b"MTrk":
            for seq, (tick, status, a, b) in enumerate(_track(body)):
                kind_of = {0x8: "off", 0x9: "on" if b else "off", 0xE: "bend"}[status >> 4]
                row = {"track": track, "seq": seq, "tick": tick, "type": kind_of, "channel": status & 15, "ticks_per_beat": per_beat}
                yield row | ({"bend": (b << 7 | a) - 8192} if kind_of == "bend" else {"note": a, "velocity": b})
            track += 1
        at += 8 + length


def _track(body: bytes) -> Iterator[tuple[int, int, int, int]]:
    at = tick = status = 0
    while at < len(body):
        wait, at = _number(body, at)
        tick += wait
        if at >= len(body):
            raise Malformed("a message is cut off")
        if body[at] >= 0x80:
            status = body[at]
            at += 1
        if status in (0xFF, 0xF0, 0xF7):
            length, at = _number(body, at + (status == 0xFF))
            at += length
            continue
        n = DATA_BYTES.get(status >> 4)
        if n is None or at + n > len(body):
            raise Malformed("a message is cut off or has no status")
        if status >> 4 in (0x8, 0x9, 0xE):
            yield tick, status, body[at], body[at + 1]
        at += n


def read_messages(spark: SparkSession, folder: str, pattern: str = "*.mid") -> DataFrame:
    """One row per note or bend message of all files below a folder; a file that can't be read has one row with ``error``."""
    to = to_arrow_schema(StructType.fromDDL(MESSAGES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = [row | {"path": path} for row in messages(content)]
                except Malformed as e:
                    rows = [{"path": path, "error": str(e)}]
                yield pa.RecordBatch.from_pylist([dict.fromkeys(to.names) | r for r in rows], schema=to)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return bounded(files.select("path", "content")).mapInArrow(run, MESSAGES)


def notes(rows: DataFrame, full_scale: int = 8191) -> DataFrame:
    """(path, onset, offset, step, velocity, ticks_per_beat): paired notes with the bend of their channel.

    Tracks are read one after another, bends and open notes carry over from one to the next.
    """
    order, key = ["track", "seq"], ["path", "channel"]
    paired = sequence.pair_notes(rows.where("error is null"), key, order, tick="tick", value="bend", note=["note"])
    return paired.select("path", F.col("tick").alias("onset"), F.col("end").alias("offset"), music.step_of_note(F.col("note"), F.col("bend_now"), full_scale).alias("step"), "velocity", "ticks_per_beat")


def chords(rows: DataFrame, speed: float = 1.0) -> DataFrame:
    """(path, onset, duration, notes) in beats: notes whose onsets are within a 48th of a beat of a group's first one.

    Durations are at least a quarter of a beat and end where the next chord begins; times are rounded to four places.
    """
    own = notes(rows)
    tolerance = F.greatest(F.lit(1), F.floor(F.col("ticks_per_beat") / 48).cast("int"))
    grouped = sequence.anchor_groups(own, ["path"], "onset", tolerance, ["offset", "step", "velocity", "ticks_per_beat"])
    beats = lambda c: F.col(c) / F.col("ticks_per_beat") * speed
    timed = grouped.select("path", beats("anchor").alias("anchor"), beats("offset").alias("offset"), "step", "velocity")
    made = sequence.chords_from_notes(timed, ["path"]).withColumn("onset", F.round("onset", 4)).withColumn("duration", F.round("duration", 4))
    return sequence.clip_to_next(made, ["path"], ["onset"], "onset", "duration")


def exact_chords(rows: DataFrame, track: int = 1, full_scale: int = 8192) -> DataFrame:
    """(path, tick, steps) of one track: the steps that begin at the same tick, with the bend of their channel."""
    order, key = ["seq"], ["path", "channel"]
    own = rows.where("error is null").where(F.col("track") == track)
    bent = own.withColumn("_bend", F.coalesce(F.last("bend", ignorenulls=True).over(sequence.before_and_now(key, order)), F.lit(0)))
    begins = bent.where("type = 'on'").withColumn("step", music.step_of_note(F.col("note"), F.col("_bend"), full_scale))
    return begins.groupBy("path", "tick").agg(F.array_sort(F.collect_set("step")).alias("steps"))


def bend_range_messages(channels: list[int] = list(range(1, 16)), semitones: int = 2) -> list[tuple[int, int, int]]:  # noqa: B006
    """(channel, controller, value) that set the bend range of channels."""
    return [(c, k, v) for c in channels for k, v in ((101, 0), (100, 0), (6, semitones), (38, 0), (101, 127), (100, 127))]


def with_random_velocity(chords: DataFrame, key: list[str], seed: int = 42, least: int = 55, most: int = 85) -> DataFrame:
    """Chords of (onset, duration, voicing) as (onset, duration, notes): velocities that are the same on each run.

    Voicings are MIDI notes, 0 where a slot is empty.
    """
    notes = F.filter("voicing", lambda n: n > 0)
    velocity = lambda n: (F.pmod(F.xxhash64(*[F.col(k) for k in key], F.col("onset"), n, F.lit(seed)), F.lit(most - least)) + least).cast("int")
    return chords.withColumn("notes", F.transform(notes, lambda n: F.struct(F.rint(n * 53 / 12).cast("int").alias("step"), velocity(n).alias("velocity"))))


def note_messages(df: DataFrame, key: list[str], ticks_per_beat: int = 480) -> DataFrame:
    """(key, nth, delta, type, channel, note, value) of chords (onset, duration, notes) in beats.

    Notes take channels 1 to 15 in turn; at equal ticks bends come first, then ends, then beginnings.
    """
    each = df.select(*key, "onset", "duration", F.posexplode("notes").alias("j", "n"))
    step = F.col("n.step")
    base = each.select(*key, "onset", "j", (F.col("onset") * ticks_per_beat).cast("long").alias("on"), ((F.col("onset") + F.col("duration")) * ticks_per_beat).cast("long").alias("off"), (F.col("j") % 15 + 1).alias("channel"), music.note_of_step(step).alias("note"), music.bend_of_step(step).alias("bend"), F.col("n.velocity").alias("velocity"))
    kinds = [("bend", "on", "bend", 0), ("off", "off", "velocity", 1), ("on", "on", "velocity", 2)]
    parts = F.array(*[F.struct(F.col(tick).alias("tick"), F.lit(rank).alias("rank"), F.lit(kind).alias("type"), F.col(value).cast("int").alias("value")) for kind, tick, value, rank in kinds])
    rows = base.select(*key, "onset", "j", "channel", "note", F.explode(parts).alias("m")).select(*key, "onset", "j", "channel", "note", "m.*")
    order = Window.partitionBy(*key).orderBy("tick", "rank", "onset", "j")
    return rows.select(*key, (F.row_number().over(order) - 1).alias("nth"), (F.col("tick") - F.coalesce(F.lag("tick").over(order), F.lit(0))).alias("delta"), "type", "channel", "note", "value")


def _written(value: int) -> bytes:
    out = [value & 127]
    while value := value >> 7:
        out.append(value & 127 | 128)
    return bytes(reversed(out))


def file_bytes(rows: list[dict], ticks_per_beat: int = 480, bpm: float = 120.0) -> bytes:
    """A file of a tempo track and a track of messages; all channels are set to a bend range of two semitones."""
    tempo = b"\x00\xff\x51\x03" + round(60_000_000 / bpm).to_bytes(3, "big")
    ranges = b"".join(b"\x00" + bytes([0xB0 | c, k, v]) for c in range(1, 16) for k, v in ((101, 0), (100, 0), (6, 2), (38, 0), (101, 127), (100, 127)))
    body = bytearray(ranges)
    for r in rows:
        data = (r["value"] + 8192 & 127, r["value"] + 8192 >> 7) if r["type"] == "bend" else (r["note"], r["value"])
        body += _written(r["delta"]) + bytes([{"bend": 0xE0, "off": 0x80, "on": 0x90}[r["type"]] | r["channel"], *data])
    end = b"\x00\xff\x2f\x00"
    track = lambda x: b"MTrk" + struct.pack(">I", len(x)) + x
    return b"MThd" + struct.pack(">IHHH", 6, 1, 2, ticks_per_beat) + track(tempo + end) + track(bytes(body) + end)


def as_files(df: DataFrame, key: str, ticks_per_beat: int = 480, bpm: float = 120.0) -> DataFrame:
    """(key, content): the bytes of a file for each sequence of chords."""
    return messages_as_files(note_messages(df, [key], ticks_per_beat), key, ticks_per_beat, bpm)


def _files(grouped: DataFrame, key: str, kind: str, ticks_per_beat: int, bpm: float) -> DataFrame:
    schema = f"{key} {kind}, content binary"
    to = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [file_bytes(rows, ticks_per_beat, bpm) for rows in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(to.field(0).type), pa.array(content, pa.binary())], schema=to)

    return bounded(grouped).mapInArrow(run, schema)


def messages_as_files(rows: DataFrame, key: str, ticks_per_beat: int = 480, bpm: float = 120.0) -> DataFrame:
    """(key, content): the bytes of a file for each sequence of messages (key, nth, delta, type, channel, note, value)."""
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("nth", "delta", "type", "channel", "note", "value"))).alias("rows"))
    return _files(grouped, key, rows.schema[key].dataType.simpleString(), ticks_per_beat, bpm)
