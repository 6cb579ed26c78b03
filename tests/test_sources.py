"""Sources and sinks on small files, and the token stream."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from ostinato.functions import dims
from ostinato.plans import jobs
from ostinato.sources import arrays, charts, midi, sinks
from ostinato.streaming import spans

NOTES = "array<struct<step: int, velocity: int>>"


def test_chords_go_through_midi_files_and_back(spark, tmp_path):
    chords = [("a.mid", 0.0, 1.0, [(212, 80), (230, 64)]), ("a.mid", 1.0, 2.0, [(243, 100)]), ("b.mid", 0.5, 0.5, [(265, 1), (106, 127), (300, 60)])]
    df = spark.createDataFrame(chords, f"song string, onset double, duration double, notes {NOTES}")
    folder = f"file://{tmp_path}/midi"
    written = sinks.write_files(midi.as_files(df, "song"), folder, "song", "content").collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in written) == ["a.mid", "b.mid"]
    (tmp_path / "midi" / "broken.mid").write_bytes(b"MThd\0\0\0\6\0\1\0\1\1\xe0MTrk\0\0\0\xff\0")
    rows = midi.read_messages(spark, folder)
    assert [r["path"].rsplit("/", 1)[1] for r in rows.where("error is not null").collect()] == ["broken.mid"]
    back = sorted((r["path"].rsplit("/", 1)[1], r["onset"], r["duration"], [tuple(n) for n in r["notes"]]) for r in midi.chords(rows).collect())
    assert back == sorted((s, o, d, sorted(n)) for s, o, d, n in chords)


def test_messages_have_bends_before_ends_before_beginnings(spark):
    df = spark.createDataFrame([("s", 0.0, 1.0, [(212, 80)]), ("s", 1.0, 1.0, [(212, 80)])], f"song string, onset double, duration double, notes {NOTES}")
    rows = sorted((r["nth"], r["type"], r["delta"]) for r in midi.note_messages(df, ["song"]).collect())
    assert [(t, d) for _, t, d in rows] == [("bend", 0), ("on", 0), ("bend", 480), ("off", 0), ("on", 0), ("off", 480)]


def test_running_status_and_zero_velocity():
    body = b"\x00\x91\x3c\x40\x10\x3c\x00\x00\xff\x2f\x00"
    data = b"MThd\0\0\0\6\0\0\0\1\0\x60MTrk" + len(body).to_bytes(4, "big") + body
    assert [(r["tick"], r["type"], r["note"], r["channel"]) for r in midi.messages(data)] == [(0, "on", 60, 1), (16, "off", 60, 1)]
    with pytest.raises(midi.Malformed):
        list(midi.messages(b"RIFF"))


CHART = """<score-partwise xmlns="urn:x"><work><work-title>T</work-title></work><identification><creator type="composer">C</creator><creator type="lyricist">Bossa Nova</creator></identification><part>
<measure number="1"><attributes><divisions>2</divisions><key><fifths>-1</fifths></key></attributes><direction><direction-type><rehearsal>A</rehearsal></direction-type></direction><barline><repeat direction="forward"/></barline>
<harmony><root><root-step>B</root-step><root-alter>-1</root-alter></root><kind>dominant</kind><degree><degree-value>9</degree-value><degree-alter>1</degree-alter><degree-type>add</degree-type></degree><bass><bass-step>F</bass-step></bass></harmony><note><duration>4</duration></note>
<harmony><root><root-step>C</root-step></root><kind>minor</kind></harmony><note><duration>4</duration></note></measure>
<measure number="2"><harmony><root><root-step>D</root-step></root><kind>major</kind></harmony><note><duration>8</duration></note><barline><ending number="1"/><repeat direction="backward"/></barline></measure></part></score-partwise>"""


def test_charts(spark, tmp_path):
    (tmp_path / "song.xml").write_text(CHART)
    (tmp_path / "bad.xml").write_text("<open>")
    rows = charts.read_charts(spark, f"file://{tmp_path}")
    assert rows.where("error is not null").count() == 1
    tokens = [(r["token"], r["duration"]) for r in rows.where("error is null").orderBy("pos").collect()]
    assert tokens == [("Form_A", 0), ("|:", 0), ("Bbdominant add #9/F", 2), ("Cminor", 2), ("|", 0), ("Repeat_1", 0), ("Dmajor", 4), (":|", 0)]
    meta = charts.read_metadata(spark, f"file://{tmp_path}").where("error is null").first()
    assert (meta["song_name"], meta["composer"], meta["midi_key"], meta["bars"], meta["time_signature"]) == ("T", "C", -1, 2, "4/4")


def test_sidecars(spark, tmp_path):
    folder = tmp_path / "type_0_major"
    folder.mkdir()
    own = ["<style>", "Bossa Nova", "Form_A", "|:", ".", "4.0", "C", "maj7", "|", ".", "3.9", "A", "m7", "add 9", "/", "G", "Repeat_1", "what", ":|", ".", "1.0"]
    (folder / "00001_X_C_major_type_0_major.txt").write_text(repr(own))
    (folder / "00002_Y_D_minor_type_0_major.txt").write_text(repr([".", "1.0", "D", "|", ".", "2.0", "E", "."]))
    (folder / "00003_Z_C_major_type_0_major.txt").write_text("[1,")
    tokens = charts.read_sidecars(spark, f"file://{tmp_path}")
    assert tokens.where("error is not null").count() == 1
    first, second = (tokens.where(F.col("path").contains(s)) for s in ("_X_", "_Y_"))
    events = charts.sidecar_events(first).orderBy("event").collect()
    assert [(r["token"] if r["kind"] == "structure" else (r["duration"], r["root"], r["quality"], r["extensions"], r["slash_bass"])) for r in events] == [
        "FORM_A", "|:", (4.0, "C", "maj7", [], None), "|", (4.0, "A", "m7", ["add 9"], "G"), ":|",
    ]
    # The token after a root is the quality whatever it is.
    assert [(r["root"], r["quality"]) for r in charts.sidecar_events(second).orderBy("event").collect()] == [("D", "|"), ("E", ".")]
    header = charts.sidecar_headers(first).first()
    assert header["header"] == ["<style>", "STYLE_Bossa", "<tonality>", "TONALITY_C_major", "TYPE_0_major"] and header["style_raw"] == "Bossa Nova"


def test_json_dimensions(spark, tmp_path):
    (tmp_path / "alphabet.json").write_text(json.dumps({"roots": {"C": 3, "A": 1}, "qualities": {"": 9, "m": 2}, "extensions": {}, "slash_bases": {"G": 1}}, indent=1))
    rows = [tuple(r) for r in charts.read_alphabet(spark, f"{tmp_path}/alphabet.json").collect()]
    assert rows == [("qualities", "m"), ("roots", "A"), ("roots", "C"), ("slash_bases", "G")]
    vocabulary = spark.createDataFrame([("<pad>", 0), ("a", 1)], "tok string, id int")
    sinks.write_vocabulary(vocabulary, f"{tmp_path}/vocabulary", method="A")
    assert {tuple(r) for r in charts.read_vocabulary(spark, f"{tmp_path}/vocabulary").collect()} == {("<pad>", 0), ("a", 1)}
    (tmp_path / "songs").mkdir()
    (tmp_path / "songs" / "1.json").write_text(json.dumps({"file": "x", "token_ids": [1, 2], "n_tokens": 2}))
    (tmp_path / "songs" / "2.json").write_text("{")
    songs = charts.read_songs(spark, f"{tmp_path}/songs").cache()
    assert songs.where("file = 'x' and n_tokens = 2").count() == 1 and songs.where("_corrupt_record is not null").count() == 1


def test_sinks(spark, tmp_path):
    with pytest.raises(ValueError, match="belongs to"):
        sinks.refuse_foreign_folder("/data/method_a/out", "method_b", "method_a")
    sinks.refuse_foreign_folder("/data/method_b/out", "method_b", "method_a")
    packed = spark.createDataFrame([("train", [1, 2]), ("train", [3, 0]), ("val", [4, 5])], "split string, values array<int>")
    sinks.write_packed(packed, f"{tmp_path}/packed", by=["split"])
    assert spark.read.parquet(f"{tmp_path}/packed").where("split = 'train'").count() == 2
    vectors = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "alpha double, beta double")
    skipped = spark.createDataFrame([("no text",), ("no text",), ("count",)], "reason string")
    meta = sinks.packed_meta(vectors, packed, ["alpha", "beta"], skipped, seed=42)
    sinks.write_meta(meta, f"{tmp_path}/meta")
    (row,) = spark.read.json(f"{tmp_path}/meta").collect()
    assert (row["n_sequences"], row["n_tokens"], row["seed"]) == (3, 6, 42)
    assert row["skipped"].asDict() == {"no text": 2, "count": 1} and row["vector_stats"]["alpha"].asDict() == {"mean": 2.0, "std": 1.0}
    sinks.write_sidecars(spark.createDataFrame([("t1", "s", 1, "b"), ("t1", "s", 0, "a")], "type string, song string, pos int, tok string"), f"{tmp_path}/sidecars")
    assert json.loads(spark.read.text(f"{tmp_path}/sidecars").first()["value"]) == {"song": "s", "tokens": ["a", "b"]}


def test_chords_of_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    tokens = ["<start>", "CHORD_START", "DUR_1.0", "PV_212_3", "PV_106_2", "CHORD_END", "CHORD_START", "PV_300_1"]
    rows = [("s", i, t) for i, t in enumerate(tokens)]
    schema = "song string, pos int, tok string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source))
    stream = spans.finished_chords(spark.readStream.schema(schema).parquet(str(source)))
    query = stream.writeStream.format("memory").queryName("chords").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    assert [tuple(r) for r in spark.sql("SELECT * FROM chords").collect()] == [("s", 0, "106 212")]
    spark.createDataFrame([("s", 8, "CHORD_END"), ("s", 9, "CHORD_END")], schema).coalesce(1).write.mode("append").parquet(str(source))
    query.processAllAvailable()
    query.stop()
    assert sorted(tuple(r) for r in spark.sql("SELECT * FROM chords").collect()) == [("s", 0, "106 212"), ("s", 1, "300")]


def test_raw_arrays_go_out_and_in(spark, tmp_path, monkeypatch):
    rows = [(i, [i, 2 * i, 65535 - i]) for i in range(50)]
    df = spark.createDataFrame(rows, "i int, v array<int>").repartition(3)
    folder = f"file://{tmp_path}/raw"
    assert sum(r["rows"] for r in arrays.write_raw(df, folder, "v", "uint16", 3).collect()) == 50
    monkeypatch.setattr(arrays, "RANGE_BYTES", 24)
    back = arrays.read_raw(spark, folder, "*.bin", "uint16", 3)
    assert sorted(r["values"] for r in back.collect()) == sorted(v for _, v in rows)
    assert back.select("path", "row").distinct().count() == 50
    with pytest.raises(Exception, match="isn't a multiple"):
        arrays.read_raw(spark, folder, "*.bin", "float32", 17).collect()
    with pytest.raises(Exception, match="arrays of 2 numbers"):
        arrays.write_raw(df, folder, "v", "uint16", 2).collect()


def test_a_map_in_chunks(spark, tmp_path):
    import numpy as np

    values = np.arange(27, dtype=np.float32)
    for k, part in enumerate((values[:10], values[10:])):
        (tmp_path / f"harmonic-220Hz-3nodes-chunk{k}.bin").write_bytes(part.tobytes())
    (tmp_path / "other.bin").write_bytes(b"1234")
    rows = arrays.read_map(spark, f"file://{tmp_path}", 220, 3).collect()
    assert {(r["i"], r["j"], r["k"]): r["d"] for r in rows} == {(i, j, k): float(9 * i + 3 * j + k) for i in range(3) for j in range(3) for k in range(3)}
    listed = arrays.list_files(spark, f"file://{tmp_path}", "*.bin", limit=1, exclude="chunk0").collect()
    assert [r["path"].rsplit("/", 1)[1] for r in listed] == ["harmonic-220Hz-3nodes-chunk1.bin"]


def test_harmonies_alone_and_documents_with_entities(spark, tmp_path):
    (tmp_path / "song.xml").write_text(CHART)
    (tmp_path / "bomb.xml").write_text('<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>')
    rows = charts.read_harmonies(spark, f"file://{tmp_path}")
    assert ["entities" in r["error"] for r in rows.where("error is not null").collect()] == [True]
    assert [(r["root"], r["kind"], r["bass"]) for r in rows.where("error is null").orderBy("nth").collect()] == [("Bb", "dominant", "F"), ("C", "minor", None), ("D", "major", None)]


def test_deeply_nested_sidecars_are_errors(spark, tmp_path):
    (tmp_path / "deep.txt").write_text("[" * 100_000)
    (tmp_path / "good.txt").write_text("['a', 'b']")
    lists = {r["path"].rsplit("/", 1)[1]: r["tokens"] for r in charts.token_lists(charts.read_sidecars(spark, f"file://{tmp_path}")).collect()}
    assert lists == {"deep.txt": None, "good.txt": ["a", "b"]}


def test_song_metadata_and_parallel_sidecars(spark, tmp_path):
    rows = spark.createDataFrame([("My Song: 1", "Jazz"), ("B/side", "Rock")], "song_name string, style string")
    written = sinks.write_song_metadata(rows, "song_name", f"file://{tmp_path}/meta").collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in written) == ["Bside.json", "My_Song_1.json"]
    (tmp_path / "meta" / "bad.json").write_text("{")
    found = charts.read_song_metadata(spark, f"file://{tmp_path}/meta").cache()
    assert {tuple(r) for r in charts.style_map(found).collect()} == {("mysong1", "Jazz"), ("bside", "Rock")}
    files = spark.createDataFrame([("/x/midi/My_Song_1.mid",), ("/x/midi/none.mid",)], "path string")
    metadata = spark.createDataFrame([("/x/meta/My_Song_1.json", "Jazz")], "path string, style string")
    assert sorted(r["style"] for r in charts.with_parallel_metadata(files, metadata, "midi", "meta", style="unknown").collect()) == ["Jazz", "unknown"]


def test_exact_chords_and_random_velocities(spark):
    rows = [("f", 1, 0, 0, "bend", 1, 0, 4096), ("f", 1, 1, 0, "on", 1, 60, None), ("f", 1, 2, 0, "on", 2, 64, None), ("f", 1, 3, 9, "on", 1, 60, None), ("f", 0, 0, 0, "on", 3, 50, None)]
    df = spark.createDataFrame(rows, "path string, track int, seq int, tick long, type string, channel int, note int, bend int").withColumn("error", F.lit(None).cast("string"))
    made = {r["tick"]: r["steps"] for r in midi.exact_chords(df).collect()}
    assert made == {0: [round(60 * 53 / 12 + 53 / 12), round(64 * 53 / 12)], 9: [round(60 * 53 / 12 + 53 / 12)]}
    voiced = spark.createDataFrame([("s", 0.0, 1.0, [48, 0, 55])], "song string, onset double, duration double, voicing array<int>")
    notes = midi.with_random_velocity(voiced, ["song"]).first()["notes"]
    assert [n["step"] for n in notes] == [212, 243] and all(55 <= n["velocity"] < 85 for n in notes)
    assert notes == midi.with_random_velocity(voiced, ["song"]).first()["notes"]
    assert len(midi.bend_range_messages()) == 90


def test_stats_manifests_and_tables_that_go_on(spark, tmp_path):
    tokens = spark.createDataFrame([("s", "a"), ("s", "b"), ("t", "a")], "song string, tok string")
    (row,) = sinks.dataset_stats(tokens, "song", "tok").collect()
    assert (row["n_songs"], row["n_tokens"], row["n_distinct"], [tuple(t) for t in row["top"]]) == (2, 3, 2, [("a", 2), ("b", 1)])
    clips = spark.createDataFrame([("c1", "Jazz"), ("c2", "Jazz")], "clip string, style string")
    ratings = spark.createDataFrame([("c1", 7.0), ("c1", 3.0)], "clip string, harmony double")
    sinks.write_json(sinks.clip_manifest(clips, ratings, "clip", "style"), f"{tmp_path}/manifest")
    (line,) = spark.read.text(f"{tmp_path}/manifest").collect()
    assert json.loads(line["value"]) == {"style": "Jazz", "clips": [{"clip": "c1", "ratings": [{"harmony": 3.0}, {"harmony": 7.0}]}, {"clip": "c2"}]}
    vectors = spark.createDataFrame([("s", 0, 1.0, 1.2, 1.5, 3.0)], "song string, chord_idx int, alpha double, beta double, gamma double, d double")
    work = tokens.select("song").distinct()
    assert sinks.unwritten(work, f"{tmp_path}/vectors", "song").count() == 2
    sinks.write_vectors(vectors, f"{tmp_path}/vectors")
    assert [r["song"] for r in sinks.unwritten(work, f"{tmp_path}/vectors", "song").collect()] == ["t"]
    sinks.write_sidecars(spark.createDataFrame([("t1", "s", 1, "b"), ("t1", "s", 0, "a")], "type string, song string, pos int, tok string"), f"{tmp_path}/sidecars")
    assert sorted(tuple(r) for r in sinks.read_packed_sidecars(spark, f"{tmp_path}/sidecars").collect()) == [("t1", "s", 0, "a"), ("t1", "s", 1, "b")]


def test_whole_jobs_from_folders_to_tables(spark, tmp_path):
    stems = ["00001_A_C_major_type_0_major", "00002_B_D_minor_type_1_minor", "00003_C_C_major_type_0_major"]
    rows = [(s, float(4 * k), 4.0, [(212 + k, 64), (230 + k, 64), (243 + k, 64)]) for s in stems for k in range(2)]
    chords = spark.createDataFrame(rows, f"song string, onset double, duration double, notes {NOTES}")
    files = midi.as_files(chords, "song").withColumn("song", F.concat("song", F.lit(".mid")))
    sinks.write_files(files, f"file://{tmp_path}/midi", "song", "content").collect()
    (tmp_path / "text" / "type_0_major").mkdir(parents=True)
    own = ["<style>", "Bossa Nova", "|:", ".", "4.0", "C", "maj7", "|", ".", "4.0", "^C", "", "add 9", ":|"]
    for stem, tokens in ((stems[0], own), (stems[1], own[:7])):
        (tmp_path / "text" / "type_0_major" / f"{stem}.txt").write_text(repr(tokens))
    folders = (f"file://{tmp_path}/midi", f"file://{tmp_path}/text")
    odd = jobs.build_vectors(spark, *folders, f"{tmp_path}/vectors")
    assert {tuple(r) for r in odd.collect()} == {("counts differ", 1), ("no text", 1)}
    vectors = spark.read.parquet(f"{tmp_path}/vectors")
    assert sorted((r["song"], r["chord_idx"]) for r in vectors.collect()) == [(stems[0], 0), (stems[0], 1)]
    merged, differ = jobs.merged_songs(spark, *folders)
    assert [r["stem"] for r in differ.collect()] == [stems[1]]
    tokens = merged.orderBy("pos").collect()
    text = " ".join(r["tok"] for r in tokens)
    assert text.startswith("|: . DUR_4.0 R_C Q_maj7 CHORD_START DUR_4.0 PV_212_") and " . DUR_4.0 R_^C X_add 9 CHORD_START" in text and text.endswith("CHORD_END :|")
    assert [r["span"] for r in tokens][:2] == [-1, 0] and tokens[-1]["span"] == 1
    vocabulary = merged.select("tok").distinct().withColumn("id", F.lit(7))
    song_vectors = vectors.withColumnRenamed("song", "stem").withColumnRenamed("chord_idx", "span")
    (meta,) = jobs.pack(merged, song_vectors, vocabulary, f"{tmp_path}/packed", length=8).collect()
    packed = spark.read.parquet(f"{tmp_path}/packed").collect()
    assert meta["n_sequences"] == len(packed) == -(-len(tokens) // 8) and all(len(r["values"]) == len(r["vectors"]) == 8 for r in packed)
    assert sum(v == 7 for r in packed for v in r["values"]) == len(tokens) and {r["split"] for r in packed} == {"validation"}
    retuned = jobs.retune_corpus(spark, folders[0]).where("type = 'on'").groupBy("scale_type").count().collect()
    assert {r["scale_type"] for r in retuned} == set(dims.SCALES) and {r["count"] for r in retuned} == {18}
    (tmp_path / "twelve").mkdir()
    (tmp_path / "twelve" / "00001_A_C_major.txt").write_text(repr([".", "4.0", "C", "maj7", "/", "E"]))
    (tmp_path / "twelve" / "00002_B_D_minor.txt").write_text("[")
    made, report = jobs.relabel_corpus(spark, folders[0], f"file://{tmp_path}/twelve")
    assert {tuple(r) for r in report.collect()} == {("written", 1), ("bad_text", 1), ("missing_text", 1)}
    assert [r["tok"] for r in made.orderBy("pos").collect()] == [".", "4.0", "C", "maj7", "/", "E"]
