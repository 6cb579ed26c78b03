"""Vectors of a stream: any order, any batches, restarts and late notes give the rows of the whole songs."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from ostinato.functions import dissonance
from ostinato.operators import streams
from ostinato.streaming import vectors

SCHEMA = "song string, pos int, tok string"


def songs(n, seed):
    pick = random.Random(seed)
    out = []
    for k in range(n):
        tokens = ["<start>"]
        for _ in range(pick.randrange(1, 6)):
            notes = [f"{pick.choice(['PV', 'P', 'H'])}_{pick.randrange(106, 420)}_{pick.randrange(1, 9)}" for _ in range(pick.randrange(0, 5))]
            tokens += ["|", ".", "C", "CHORD_START", "DUR_1.0", *notes, "CHORD_END"]
        out += [(f"s{k}", i, t) for i, t in enumerate([*tokens, "<end>"])]
    return out


def write_batch(folder, number, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{number:03d}.json").write_text("".join(json.dumps(dict(zip(("song", "pos", "tok"), r, strict=True))) + "\n" for r in rows))


def run(spark, tmp_path, name):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = vectors.follow(stream, dissonance.dissonance_dim(spark), str(tmp_path / name), str(tmp_path / f"{name}-checkpoint"))
    query.awaitTermination(240)
    assert query.exception() is None and not query.isActive


@pytest.fixture
def prepared(spark):
    vectors.prepare(spark)
    yield
    for name in vectors.SETTINGS:
        spark.conf.unset(name)


def rounded(row):
    return tuple(round(v, 9) if isinstance(v, float) else v for v in row)


def test_out_of_order_batches_and_a_restart_equal_the_whole_songs(spark, tmp_path, prepared):
    rows = songs(6, 3)
    shuffled = rows + random.Random(9).sample(rows, 20)  # some come twice
    random.Random(4).shuffle(shuffled)
    third = len(shuffled) // 3
    write_batch(tmp_path / "in", 0, shuffled[:third])
    write_batch(tmp_path / "in", 1, shuffled[third : 2 * third])
    run(spark, tmp_path, "out")
    first = spark.read.parquet(str(tmp_path / "out")).count()
    write_batch(tmp_path / "in", 2, [*shuffled[2 * third :], ("s0", None, "x"), ("s0", 3, None)])
    run(spark, tmp_path, "out")  # begun again: it goes on from its checkpoint
    said = spark.read.parquet(str(tmp_path / "out"))
    assert first < said.count() and said.select(F.max("batch")).first()[0] == 2
    made = vectors.latest(said, ["song", "pos"]).select("song", "pos", "tok", "span", "alpha", "beta", "gamma", "d")
    whole = streams.token_vectors(spark.createDataFrame(rows, SCHEMA), ["song"], dissonance.dissonance_dim(spark)).select(*made.columns)
    assert sorted(map(rounded, made.collect()), key=repr) == sorted(map(rounded, whole.collect()), key=repr)


def test_a_late_note_corrects_its_chord_and_nothing_else(spark, tmp_path, prepared):
    tokens = ["<start>", "CHORD_START", "PV_200_3", "PV_217_3", "CHORD_END", "CHORD_START", "PV_231_3", "CHORD_END", "<end>"]
    rows = [("a", i, t) for i, t in enumerate(tokens)]
    write_batch(tmp_path / "in", 0, [r for r in rows if r[1] != 3])
    write_batch(tmp_path / "in", 1, [rows[3]])
    write_batch(tmp_path / "in", 2, rows)  # after the song is whole
    run(spark, tmp_path, "out")
    said = spark.read.parquet(str(tmp_path / "out"))
    later = said.where("batch = 1").orderBy("pos").collect()
    assert [r["pos"] for r in later] == [1, 2, 3, 4] and {r["correction"] for r in later} == {1} and {r["alpha"] for r in later} != {1.0}
    assert said.where("batch = 2").count() == 0


def test_what_tokens_stand_in():
    stand = vectors.standing(list(enumerate(["PV_1_1", "CHORD_START", "PV_5_1", "x", "P_3_1", "CHORD_END", "|", "CHORD_START", "H_9"])))
    assert stand == [(-1, []), (0, [3, 5]), (0, [3, 5]), (0, [3, 5]), (0, [3, 5]), (0, [3, 5]), (-1, []), (1, [9]), (1, [9])]
    assert vectors.standing([]) == [] and vectors.step_of("PV_x") is None
