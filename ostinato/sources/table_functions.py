"""Table functions: decoders that return many rows for a file, called by name in SQL.

    SELECT * FROM midi_messages(TABLE(files), 'path, tick, note')
    SELECT * FROM midi_chords(TABLE(files) PARTITION BY (path), 1)

``files`` is any table or query with columns ``path`` and ``content``. What columns a call returns is decided when it is
analysed. ``register(spark)`` makes the functions known to a session.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, SelectedColumn, udtf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ostinato.functions import dims
from ostinato.sources import midi

#: Where calls are analysed there is no session that could read a schema as text.
KINDS = {"string": StringType(), "int": IntegerType(), "long": LongType()}
MESSAGES = StructType([StructField(name, KINDS[kind]) for name, kind in (field.split() for field in midi.MESSAGES.split(","))])
CHORDS = StructType([StructField("path", StringType()), StructField("tick", LongType()), StructField("steps", ArrayType(IntegerType()))])


def _needs(files: AnalyzeArgument) -> None:
    if not files.isTable:
        raise ValueError("the first argument must be TABLE(...)")
    names = {f.name for f in files.dataType.fields}
    if missing := {"path", "content"} - names:
        raise ValueError(f"the table needs a column {sorted(missing)[0]}")


class MidiMessages:
    """Note and bend messages of each file; a second argument names the columns that are wanted."""

    def __init__(self, analyzed: AnalyzeResult | None = None):
        self.wanted = [f.name for f in analyzed.schema.fields] if analyzed else []

    @staticmethod
    def analyze(files: AnalyzeArgument, columns: AnalyzeArgument | None = None) -> AnalyzeResult:
        _needs(files)
        every = MESSAGES
        if columns is None:
            return AnalyzeResult(schema=every, select=[SelectedColumn("path"), SelectedColumn("content")])
        if not columns.isConstantExpression or not isinstance(columns.value, str):
            raise ValueError("the names of columns must be one literal text")
        names = [c.strip() for c in columns.value.split(",")]
        if unknown := [n for n in names if n not in every.names]:
            raise ValueError(f"no such column: {unknown[0]}")
        return AnalyzeResult(schema=StructType([every[n] for n in names]), select=[SelectedColumn("path"), SelectedColumn("content")])

    def eval(self, row: Row, columns: str | None = None) -> Iterator[tuple]:
        try:
            made = [message | {"path": row["path"]} for message in midi.messages(row["content"] or b"")]
        except midi.Malformed as e:
            made = [{"path": row["path"], "error": str(e)}]
        for message in made:
            yield tuple(message.get(name) for name in self.wanted)


class MidiChords:
    """Steps that begin at the same tick of one track of a file, with the bend of their channel; files go by PARTITION BY path.

    A file that can't be read has none, as in ``midi.exact_chords``.
    """

    def __init__(self):
        self.path, self.begun = None, {}

    @staticmethod
    def analyze(files: AnalyzeArgument, track: AnalyzeArgument | None = None, full_scale: AnalyzeArgument | None = None) -> AnalyzeResult:
        _needs(files)
        for given in (track, full_scale):
            if given is not None and not isinstance(given.value, int):
                raise ValueError("a track and a scale are whole numbers")
        return AnalyzeResult(schema=CHORDS, select=[SelectedColumn("path"), SelectedColumn("content")])

    def eval(self, row: Row, track: int = 1, full_scale: int = 8192) -> None:
        self.path, bends = row["path"], {}
        try:
            made = list(midi.messages(row["content"] or b""))
        except midi.Malformed:
            return
        for m in made:
            if m["track"] != track:
                continue
            if m["type"] == "bend":
                bends[m["channel"]] = m["bend"]
            elif m["type"] == "on":
                step = round(m["note"] * dims.STEPS / 12 + bends.get(m["channel"], 0) / full_scale * 200 * dims.STEPS / 1200)
                self.begun.setdefault(m["tick"], set()).add(step)

    def terminate(self) -> Iterator[tuple]:
        for tick, steps in self.begun.items():
            yield self.path, tick, sorted(steps)


def register(spark: SparkSession) -> None:
    """``midi_messages`` and ``midi_chords`` in SQL."""
    spark.udtf.register("midi_messages", udtf(MidiMessages))
    spark.udtf.register("midi_chords", udtf(MidiChords))
