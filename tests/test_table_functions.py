"""Decoders called by name in SQL against the DataFrame functions."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ostinato.sources import midi, table_functions


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    table_functions.register(spark)
    rows = [(f"s{n}", float(k), 1.0, [(110 + 7 * n + k, 64), (160 + k, 70)]) for n in range(4) for k in range(5)]
    df = spark.createDataFrame(rows, "song string, onset double, duration double, notes array<struct<step: int, velocity: int>>")
    folder = tmp_path_factory.mktemp("songs")
    for r in midi.as_files(df, "song").collect():
        (folder / f"{r['song']}.mid").write_bytes(bytes(r["content"]))
    (folder / "broken.mid").write_bytes(b"MThd")
    made = spark.read.format("binaryFile").load(str(folder))  # with columns of its own between and after
    made.createOrReplaceTempView("files")
    return midi.read_messages(spark, str(folder))


def shown(df):
    return sorted(map(repr, df.collect()))


def test_chords_of_files(spark, files):
    made = spark.sql("SELECT * FROM midi_chords(TABLE(files) PARTITION BY path)")
    assert made.columns == ["path", "tick", "steps"] and made.count() == 20
    assert shown(made) == shown(midi.exact_chords(files))
    other = spark.sql("SELECT * FROM midi_chords(TABLE(SELECT content, path FROM files) PARTITION BY (path), 0, 8191)")
    assert shown(other) == shown(midi.exact_chords(files, 0, 8191))


def test_messages_have_the_columns_that_are_asked_for(spark, files):
    assert shown(spark.sql("SELECT * FROM midi_messages(TABLE(files))")) == shown(files)
    slim = spark.sql("SELECT * FROM midi_messages(TABLE(files), 'note, path, error')")
    assert slim.columns == ["note", "path", "error"] and shown(slim) == shown(files.select("note", "path", "error"))
    assert slim.where("error is not null").count() == 1
    assert spark.sql("SELECT * FROM midi_messages(TABLE(SELECT * FROM files WHERE false))").count() == 0


@pytest.mark.parametrize(("call", "says"), [
    ("midi_messages(TABLE(files), 'nothing')", "no such column"), ("midi_messages(TABLE(SELECT path FROM files))", "needs a column content"),
    ("midi_chords(TABLE(files) PARTITION BY (path), 'x')", "whole numbers"), ("midi_chords(3)", "must be TABLE"),
])
def test_calls_that_cannot_be(spark, files, call, says):
    with pytest.raises(PySparkException, match=says):
        spark.sql(f"SELECT * FROM {call}").collect()


def test_a_join_with_what_it_returns(spark, files):
    made = spark.sql("SELECT path, count(*) AS n FROM midi_chords(TABLE(files) PARTITION BY path) GROUP BY path")
    assert {r["n"] for r in made.collect()} == {5} and made.where(F.col("path").contains("broken")).count() == 0
