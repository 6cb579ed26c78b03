"""Small fixtures with results worked out by hand."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ostinato.functions import dims, dissonance, music, spelling
from ostinato.operators import joins, quality, recurrent, relabel, retune, sequence, splits, streams, voicing
from ostinato.plans import catalogue

# The scale of each type on C.
SCALES = {
    "type_0_major": "0 4 9 14 18 22 26 31 36 40 44 49", "type_0_minor": "0 4 9 13 18 22 26 31 35 40 44 48", "type_1_neutral": "0 4 8 15 18 22 26 31 35 39 46 50",
    "type_1_minor": "0 4 7 14 18 22 26 29 36 40 45 49", "type_2_subminor": "0 4 9 12 17 22 26 31 34 39 44 48", "type_2_minor": "0 5 10 14 19 24 28 31 36 41 46 50",
    "type_3_major": "0 4 9 13 17 22 26 31 35 39 44 48", "type_3_minor": "0 5 10 14 18 23 27 31 36 40 45 49", "type_4_upmajor": "0 5 10 14 19 22 26 31 36 41 46 50",
    "type_4_minor": "0 4 9 12 17 22 26 31 34 38 43 48", "type_5_major_v2": "0 4 9 14 18 23 27 31 35 39 44 48", "type_5_minor": "0 4 9 14 18 23 28 32 37 41 45 49",
    "type_6_neutral_n": "0 4 8 15 18 22 26 31 36 41 46 50", "type_6_minor": "0 5 10 14 17 21 25 32 36 39 44 48",
}


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def stream(spark, text):
    return spark.createDataFrame([("s", i, t) for i, t in enumerate(text.split())], "song string, pos int, tok string")


@pytest.mark.parametrize("kind", SCALES)
def test_scales(kind):
    assert " ".join(map(str, dims.chromatic_scale(kind))) == SCALES[kind]
    own = [int(x) for x in SCALES[kind].split()]
    assert dims.chromatic_scale(kind, 7) == tuple((31 + own[(j - 7) % 12]) % 53 for j in range(12))


def test_signatures_of_types_differ():
    assert len({dims.chromatic_scale(k) for k in dims.SCALES}) >= 13


def test_grids_and_bins(spark):
    assert column(spark, [2.5, 5.0, 0.0, -1.0, 20.0, 0.75], "double", music.quantised_duration) == [2.0, 4.0, 0.5, 0.5, 16.0, 0.5]
    assert column(spark, [0, 1, 16, 127, -3], "int", music.velocity_bin) == [1, 1, 2, 8, 1]
    assert column(spark, [1, 8], "int", music.velocity_of_bin) == [16, 127]
    assert column(spark, [6], "int", music.ratio_of_step) == [2 ** (6 / 53)]


def test_steps_go_to_notes_and_back(spark):
    df = spark.range(0, 560).select(F.col("id").cast("int").alias("s"))
    assert df.where(music.step_of_note(music.note_of_step(F.col("s")), music.bend_of_step(F.col("s"))) != F.col("s")).count() == 0


def test_chord_ratios(spark):
    def ratios(steps):
        return column(spark, [steps], "array<int>", lambda v: music.chord_ratios(music.intervals(v, F.lit(0))))[0]

    r = lambda s: 2 ** (s / 53)
    assert tuple(ratios([18, 31, 49])) == pytest.approx((r(18), r(31), r(49)))
    assert tuple(ratios([13, 31])) == pytest.approx((r(13), r(31), r(31)))
    assert tuple(ratios([])) == pytest.approx((1.0, r(31), r(31)))
    assert ratios([13, 22, 31])["alpha"] == pytest.approx(r(13))


def test_styles(spark):
    names = ["Medium Swing", "Bossa Nova", "Rock Pop", "Latin", "Ballad", "", "Unknown", None]
    assert column(spark, names, "string", music.style_label) == ["Jazz", "Bossa", "Rock", "Son", "Balad", None, None, None]


def test_spans(spark):
    df = stream(spark, "<start> STYLE_Jazz |: . DUR_4.0 R_C CHORD_START PV_212_3 CHORD_END | . R_A CHORD_START CHORD_END :| <end>")
    spans = [r["span"] for r in sequence.chord_spans(df, ["song"], ["pos"]).orderBy("pos").collect()]
    assert spans == [-1] * 3 + [0] * 7 + [1] * 6
    blocks = sequence.local_positions(df, ["song"], ["pos"]).orderBy("pos").collect()
    assert [r["span"] for r in blocks] == [-1] * 6 + [0] * 3 + [-1] * 3 + [1] * 2 + [-1] * 2
    assert [r["local"] for r in blocks] == [0] * 6 + [0, 1, 2] + [0] * 3 + [0, 1] + [0] * 2
    open_end = stream(spark, "CHORD_START a CHORD_END x CHORD_START b")
    assert [r["tok"] for r in sequence.inside_blocks(open_end, ["song"], ["pos"]).orderBy("pos").collect()] == ["CHORD_START", "a", "CHORD_END"]


def test_anchor_groups(spark):
    df = spark.createDataFrame([("s", t) for t in (45, 0, 100, 15, 30)], "song string, t int")
    assert sorted((r["onset"], r["anchor"]) for r in sequence.anchor_groups(df, ["song"], "t", F.lit(20)).collect()) == [(0, 0), (15, 0), (30, 30), (45, 30), (100, 100)]


def test_bar_lines(spark):
    df = spark.createDataFrame([("s", 0.0), ("s", 4.0), ("s", 12.0)], "song string, t double")
    assert sorted((r["t"], r["bar"]) for r in sequence.bar_lines(df, ["song"], ["t"], "t").collect()) == [(4.0, 1), (12.0, 2), (12.0, 3)]


def test_pairing_takes_a_note_over_and_the_viewer_does_not(spark):
    df = spark.createDataFrame([("f", 0, 60, "on"), ("f", 10, 60, "on"), ("f", 20, 60, "off")], "file string, tick int, note int, type string").withColumn("value", F.lit(0))
    assert [(r["tick"], r["end"]) for r in sequence.pair_notes(df, ["file"], ["tick"], note=["note"]).collect()] == [(10, 20)]
    assert sorted((r["tick"], r["end"]) for r in sequence.notes_until_next(df, ["file"], ["tick"], note=["note"]).collect()) == [(0, 10), (10, 20)]
    closed = recurrent.close_stuck_notes(df.where("tick < 20"), ["file"], ["note"], ["tick"], tolerance=2).collect()
    assert sorted((r["tick"], r["reason"]) for r in closed) == [(10, "no end"), (10, "taken over")]


def test_chunks(spark):
    df = spark.createDataFrame([("s", i, i + 1) for i in range(10)], "song string, pos int, id int")
    rows = sequence.chunks(df, ["song"], "pos", "id", 4, 0).orderBy("chunk").collect()
    assert [(r["values"], r["n_real"]) for r in rows] == [([1, 2, 3, 4], 4), ([5, 6, 7, 8], 4), ([9, 10, 0, 0], 2)]


def test_splits(spark):
    df = spark.range(10).withColumnRenamed("id", "song")
    made = splits.exact_split(df, "song", 0.02).collect()
    assert sum(r["split"] == "validation" for r in made) == 1
    assert sorted(map(tuple, made)) == sorted(map(tuple, splits.exact_split(df.repartition(3), "song", 0.02).collect()))
    many = splits.hashed_split(spark.range(20_000).withColumnRenamed("id", "song"), "song", 0.1)
    assert 1700 < many.where("split = 'validation'").count() < 2300


def test_encoding_goes_round(spark):
    notes = "array<struct<step: int, velocity: int>>"
    df = spark.createDataFrame([("s", 0.0, 1.0, [(50, 80), (212, 64)]), ("s", 4.0, 2.0, [(500, 127)]), ("s", 12.0, 3.0, [(110 + k, 10) for k in range(10)])], f"song string, onset double, duration double, notes {notes}")
    tokens = sequence.encode_chords(df, ["song"])
    text = " ".join(r["tok"] for r in tokens.orderBy("pos").collect())
    assert text.startswith("<start> CHORD_START DUR_4.0 PV_106_6 PV_212_5 CHORD_END BAR CHORD_START DUR_8.0 PV_424_8 CHORD_END BAR BAR CHORD_START DUR_3.0 PV_110_1 ") and text.endswith("PV_117_1 CHORD_END <end>")
    back = sequence.decode_stream(tokens, ["song"]).orderBy("chord").collect()
    assert [(r["onset"], r["duration"], [n["step"] for n in r["notes"]]) for r in back] == [(0.0, 4.0, [106, 212]), (4.0, 8.0, [424]), (12.0, 3.0, list(range(110, 118)))]
    legacy = sequence.decode_stream(stream(spark, "CHORD_START DUR_2.0 P_212 V_8 CHORD_END CHORD_START CHORD_END"), ["song"]).collect()
    assert [(r["duration"], [tuple(n) for n in r["notes"]]) for r in legacy] == [(2.0, [(212, 127)])]


@pytest.mark.parametrize(
    ("text", "issues"),
    [
        ("<start> CHORD_START DUR_1.0 PV_1_1 CHORD_END <end>", set()),
        ("CHORD_START DUR_1.0 PV_1_1 CHORD_END <end>", {"missing_start"}),
        ("<start> CHORD_START DUR_1.0 PV_1_1 CHORD_END", {"missing_end"}),
        ("<start> CHORD_START DUR_1.0 PV_1_1 CHORD_START DUR_1.0 PV_1_1 CHORD_END CHORD_END <end>", {"nested_start", "unclosed"}),
        ("<start> CHORD_END <end>", {"orphan_end", "pair_mismatch"}),
        ("<start> CHORD_START PV_1_1 CHORD_END <end>", {"no_duration"}),
        ("<start> CHORD_START DUR_1.0 CHORD_END <end>", {"no_note"}),
        ("<start> CHORD_START DUR_1.0 PV_1_1 <end>", {"pair_mismatch", "unclosed"}),
    ],
)
def test_grammar(spark, text, issues):
    assert {r["issue"] for r in quality.grammar_issues(stream(spark, text), ["song"]).collect()} == issues


def test_positional_join_sets_unequal_sequences_aside(spark):
    left = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("b", 0, 3)], "k string, pos int, x int")
    right = spark.createDataFrame([("a", 0, 9), ("a", 1, 8), ("b", 0, 7), ("b", 1, 6), ("c", 0, 5)], "k string, pos int, y int")
    both, odd = joins.positional(left, right, ["k"], "pos")
    assert sorted((r["x"], r["y"]) for r in both.collect()) == [(1, 9), (2, 8)]
    assert sorted((r["k"], r["n_left"], r["n_right"]) for r in odd.collect()) == [("b", 1, 2), ("c", 0, 1)]


def test_roughness_does_not_depend_on_order(spark):
    rows = [(1, 220.0, 1.0), (1, 233.0, 0.5), (1, 330.0, 0.25), (2, 330.0, 0.25), (2, 233.0, 0.5), (2, 220.0, 1.0), (3, 440.0, 1.0)]
    made = {r["k"]: r["roughness"] for r in quality.roughness(spark.createDataFrame(rows, "k int, f double, a double"), ["k"], "f", "a").collect()}
    assert made[1] == made[2] > 0 and made[3] == 0


def test_voices_take_the_nearest_voicing(spark):
    df = spark.createDataFrame([("s", i, r, q) for i, (r, q) in enumerate([(0, "maj7"), (9, "m7"), (2, "m7"), (7, "dom7")])], "song string, pos int, root int, quality string")
    made = [r["voicing"] for r in voicing.voice_lead(df, "song").orderBy("pos").collect()]
    assert all(len(v) == 8 for v in made)
    for v, root, quality_ in zip(made, (0, 9, 2, 7), ("maj7", "m7", "m7", "dom7"), strict=True):
        assert {n % 12 for n in v if n} == {(root + t) % 12 for t in voicing.CLOSED[quality_]}


def test_cleaning_merges_small_chords_and_cuts_tails(spark):
    big = [(1, 9), (2, 9), (3, 9)]
    rows = [("s", 0.0, 1.0, big), ("s", 1.0, 1.0, [(7, 9)]), *[("s", 4.0 + k, 1.0, [(4, 9), (5, 9), (6, 9)]) for k in range(4)]]
    df = spark.createDataFrame(rows, "song string, onset double, duration double, notes array<struct<step: int, velocity: int>>")
    assert [(r["onset"], r["steps"]) for r in recurrent.clean_chords(df, "song").orderBy("chord").collect()] == [(0.0, "1 2 3 7"), (4.0, "4 5 6"), (5.0, "4 5 6")]


def test_charts_are_played_out(spark):
    df = stream(spark, "|: a Repeat_1 b :| Repeat_2 c")
    assert [r["tok"] for r in recurrent.expand_charts(df, "song").orderBy("pos").collect()] == ["|", "a", "Repeat_1", "b", "|", "|", "a", "Repeat_2", "c"]
    assert recurrent.without_doubled(["add 9", "add 9", "x", "x"]) == ["add 9", "x", "x"]


def test_spelling(spark):
    assert column(spark, ["C", "F#", "Bb", "H"], "string", lambda v: spelling.transposed(v, F.lit("C"), F.lit("D"))) == ["D", "G#", "C", None]
    assert column(spark, ["C", "B#", "Db", "A"], "string", spelling.semitone) == [0, 0, 1, 9]
    assert column(spark, [["C add 9", "m", "G alter b5 x"]], "array<string>", spelling.split_compound) == [["C", "add 9", "m", "G", "alter b5 x"]]
    assert tuple(column(spark, ["00001_My_Song_C_major_type_0_major"], "string", spelling.stem_parts)[0]) == (1, "My_Song", "C", "major", "type_0_major")


def test_candidates_are_clear_and_hold_the_chord():
    for root in range(42, 57):
        for quality_, stack in voicing.CLOSED.items():
            for v in voicing.candidates(root, quality_):
                assert {n % 12 for n in v} == {(root + t) % 12 for t in stack} and voicing.is_clear(list(v)) and v[0] % 12 == root % 12 and min(v) == v[0]
    assert voicing.candidates(48, voicing.NO_CHORD) == ()
    assert not voicing.is_clear([20, 60]) and not voicing.is_clear([40, 44]) and voicing.is_clear([40, 45]) and voicing.is_clear([40, 40])


def test_movement_takes_each_voice_once():
    assert voicing.movement([48, 52, 55], [48, 52, 55]) == 0
    assert voicing.movement([48, 60], [49, 50]) == 1 + 10
    assert voicing.movement([48], [48, 50]) == float("inf")
    assert voicing.movement_by_octaves([48, 52], [60, 64]) == 0


def test_voiced_charts(spark):
    def voice(text):
        rows = voicing.voice_charts(spark.createDataFrame([("s", i, t) for i, t in enumerate(text.split("_"))], "song string, pos int, tok string"), "song").orderBy("chord").collect()
        return [(r["voicing"], r["duration"], r["label"]) for r in rows]

    (plain,) = voice("._4.0_C_maj7")
    assert plain == ([48, 55, 60, 64, 71, 0, 0, 0], 4.0, "maj7")
    (more,) = voice("._4.0_C_maj7_add 9_alter b5")
    assert more[0] == [48, 54, 60, 64, 71, 62, 0, 0]
    (slash,) = voice("._2.0_C_maj7_/_E")
    assert slash == ([40, 48, 55, 60, 71, 0, 0, 0], 2.0, "E")
    (root,) = voice("._1.0_G")
    assert root[0] == [43, 0, 0, 0, 0, 0, 0, 0]
    assert voice("|_Form_A_.") == []
    two = voice("._4.0_C_maj7_._4.0_C_maj7")
    assert two[0][0] == two[1][0]


def test_contradicting_qualities():
    assert recurrent.without_contradictions([".", "4.0", "C", "dom7", "sus7", "add b9", "|"]) == [".", "4.0", "C", "sus7", "add b9", "|"]
    assert recurrent.without_contradictions([".", "4.0", "C", "dom7", "add 9", "sus7", "|"]) == [".", "4.0", "C", "dom7", "add 9", "|"]
    # Of four it is the right neighbour that goes.
    assert recurrent.without_contradictions([".", "4.0", "C", "dom7", "add 9", "add #5", "add b9", "|"]) == [".", "4.0", "C", "dom7", "add 9", "add b9", "|"]
    assert recurrent.without_contradictions(["C", "dom7"]) == ["C", "dom7"]


def test_patterns():
    assert retune.pattern_scale([9, 9, 4, 9, 9, 9, 4]) == [0, 4, 9, 13, 18, 22, 26, 31, 35, 40, 44, 49]
    assert retune.pattern_scale([9, 9, 4, 9, 9, 9, 4], 1.0)[1] == 9
    for bad in ([9] * 7, [53]):
        with pytest.raises(ValueError, match="seven distances"):
            retune.pattern_scale(bad)


def test_patterns_that_are_done_are_left_out(spark):
    messages = spark.createDataFrame([("f", 0, 0, 0, "on", 0, 60, 9), ("f", 0, 1, 5, "off", 0, 60, 0)], "file string, track int, seq int, tick long, type string, channel int, note int, velocity int")
    patterns = retune.pattern_table(spark, {"a": [9, 9, 4, 9, 9, 9, 4], "b": [9, 8, 5, 9, 8, 9, 5]})
    done = spark.createDataFrame([("f", "a")], "file string, pattern string")
    made = retune.all_patterns(messages, patterns, "file", ["track", "seq"], done).collect()
    assert {r["pattern"] for r in made} == {"b"} and len(made) == 3


def test_an_end_takes_the_channel_of_its_own_beginning(spark):
    rows = [(0, "on", 60, 9), (1, "on", 64, 9), (2, "off", 60, 0), (3, "off", 60, 0), (4, "on", 64, 0)]
    df = spark.createDataFrame([("f", i, i, k, 7, n, v) for i, k, n, v in rows], "file string, seq int, tick int, type string, channel int, note int, velocity int")
    made = retune.retuned_by_scale(df, ["file"], ["seq"], F.lit(0) + F.when(F.col("note") == 64, 18).otherwise(0)).orderBy("seq", "nth").collect()
    assert [(r["seq"], r["type"], r["channel"], r["value"]) for r in made] == [
        (0, "on", 1, 9), (1, "bend", 2, 309), (1, "on", 2, 9), (2, "off", 1, 0), (2, "bend", 1, 0), (3, "off", 7, 0), (3, "bend", 7, 0), (4, "off", 2, 0), (4, "bend", 2, 0),
    ]


def test_relabelling_by_neighbours(spark):
    dim = relabel.name_dim(spark).cache()

    def run(text, f=relabel.relabelled, d=dim):
        df = stream(spark, text).withColumn("type", F.lit("type_0_major")).withColumn("tonic", F.lit(0))
        return " ".join(r["tok"] for r in f(df, ["song"], d).orderBy("pos").collect())

    assert run(". 4.0 C maj7 | . 4.0 G dom7 / G | . 4.0 C Form_A") == ". 4.0 C maj7 | . 4.0 G 7 / G | . 4.0 C Form_A"
    assert run(". 4.0 C |").startswith(". 4.0 C") and run("/ C C maj").startswith("/ C C")
    assert run("N.C. <style> x 2.0") == "N.C. <style> x 2.0"
    older = relabel.name_dim(spark, unnamed=True).cache()
    # Of roots in a row every second one is a quality and goes.
    assert [t for t in run("C G C |", relabel.relabelled_by_text, older).split(" ") if t in dims.NOTE_NAMES] == ["C", "C"]
    assert len({(r["type"], r["tonic"]) for r in dim.select("type", "tonic").distinct().collect()}) == 168


def test_dissonance_has_no_order_and_interpolates(spark):
    d = lambda a, b, g: spark.range(1).select(dissonance.dissonance_of_ratios(F.lit(a), F.lit(b), F.lit(g)).alias("d")).first()["d"]
    assert d(1.2, 1.5, 1.8) == pytest.approx(d(1.8, 1.2, 1.5)) == pytest.approx(d(1.5, 1.8, 1.2))
    dim = {(r["third"], r["fifth"], r["seventh"]): r["d"] for r in dissonance.dissonance_dim(spark).collect()}
    assert len(dim) == 396
    assert dim[18, 31, 49] == pytest.approx(d(2 ** (18 / 53), 2 ** (31 / 53), 2 ** (49 / 53)), abs=1.0)
    points = spark.createDataFrame([(0, 1.0, 1.5, 2.0), (1, 0.9, 1.0, 1.0)], "k int, alpha double, beta double, gamma double")
    found = {r["k"]: r["d"] for r in dissonance.interpolated(points, dissonance.dissonance_map(spark, 5), ["k"], 5, -1.0).collect()}
    assert found[0] == pytest.approx(d(1.0, 1.5, 2.0)) and found[1] == -1.0
    assert len(dissonance.reference_chords()) == 190 and len({n for n, *_ in dissonance.reference_chords()}) > 180


def test_songs_whose_counts_differ_are_set_aside(spark):
    symbols = spark.createDataFrame([("a", 0, "C"), ("b", 0, "C"), ("b", 1, "X")], "song string, chord_idx int, root string")
    chords = spark.createDataFrame([("a", 0, [106, 124]), ("a", 1, [106]), ("b", 0, [106, 124, 137]), ("b", 1, [110, 128])], "song string, chord_idx int, steps array<int>")
    made, odd = streams.sidecar_vectors(symbols, chords, ["song"], dims.note_table(spark), dissonance.dissonance_dim(spark))
    assert [r["song"] for r in odd.collect()] == ["a"]
    rows = {r["chord_idx"]: r["alpha"] for r in made.collect()}
    assert rows == {0: pytest.approx(2 ** (18 / 53)), 1: pytest.approx(2 ** (18 / 53))}


def test_vectors_of_a_stream_that_is_not_at_its_end(spark):
    dim = dissonance.dissonance_dim(spark)
    df = stream(spark, "<start> CHORD_START DUR_1.0 PV_106_3 PV_124_3 CHORD_END BAR CHORD_START PV_106_1")
    rows = streams.token_vectors(df, ["song"], dim).orderBy("pos").collect()
    assert [r["alpha"] > 1.1 for r in rows] == [False, True, True, True, True, True, False, False, False]
    assert (rows[0]["alpha"], rows[0]["beta"], rows[0]["gamma"], rows[0]["d"]) == streams.DEFAULT_VECTOR
    prior = streams.vector_prior(streams.token_vectors(df, ["song"], dim), "song", "tok", ["alpha", "beta"])
    assert prior.count() == 2 and streams.drawn_vectors(prior, ["song", "alpha"], 20).count() == 20


def test_two_levels_with_odd_streams(spark):
    df = stream(spark, "x . DUR_2.0 R_C CHORD_START PV_1_2 CHORD_END CHORD_START PV_9_9 CHORD_END | . R_D Q_m / R_A R_E")
    rows = streams.both_levels(df, ["song"]).orderBy("chord").collect()
    assert [(r["root"], r["quality"], r["bass"], r["duration"], r["pitches"]) for r in rows] == [("C", None, None, 2.0, [1]), ("D", "m", "A", None, [])]


def test_whole_songs(spark):
    notes = "array<struct<step: int, velocity: int>>"
    df = spark.createDataFrame([("s", float(4 * i), 4.0, [(110 + k + i, 80) for k in range(0, 60, 18)]) for i in range(3)], f"song string, onset double, duration double, notes {notes}")
    made, odd = streams.preprocessed_songs(df, "song", spark.createDataFrame([], "song string, type_label string, style_label string"), dissonance.dissonance_dim(spark))
    assert odd.count() == 0 and made.where("tok = 'CHORD_START'").count() == 3 and made.select("type_label").distinct().collect()[0][0] == "unknown"
    own, others = [(1, 9), (5, 9)], [(5, 1), (3, 1)]
    merged = spark.createDataFrame([(own, others)], f"a {notes}, b {notes}").select(streams.merged_steps(F.col("a"), F.col("b")).alias("m")).first()["m"]
    assert [tuple(n) for n in merged] == [(1, 9), (3, 1), (5, 9)]


def test_vocabularies(spark):
    vocabulary = spark.createDataFrame([("a", 1), ("b", 2)], "tok string, id int")
    df = stream(spark, "a b z")
    assert [r["id"] for r in joins.encoded(df, vocabulary).orderBy("pos").collect()] == [1, 2, 0]
    with pytest.raises(Exception, match="not in the vocabulary: z"):
        joins.encoded_strictly(df, vocabulary).collect()
    ids = spark.createDataFrame([(1,), (9,)], "id int")
    assert sorted(r["tok"] for r in joins.decoded(ids, vocabulary).collect()) == ["<pad>", "a"]
    kept, unknown = joins.known_tokens(df, vocabulary)
    assert kept.count() == 2 and [tuple(r) for r in unknown.collect()] == [("z", 1)]


def test_splits_are_exact_at_every_ratio(spark):
    df = spark.range(1000).withColumnRenamed("id", "song")
    for ratio in (0.0, 0.001, 0.1, 0.5, 1.0):
        assert splits.exact_split(df, "song", ratio).where("split = 'validation'").count() == max(1, int(1000 * ratio))
    made = splits.positional_split(spark.createDataFrame([("a", i) for i in range(5)] + [("b", 1)], "k string, i int"), ["k"], ["i"], 3)
    assert sorted(tuple(r) for r in made.collect()) == [("a", 0, "first"), ("a", 1, "first"), ("a", 2, "first"), ("a", 3, "second"), ("a", 4, "second"), ("b", 1, "first")]
    assert spark.range(10).select(splits.seeded(F.col("id"), 1).alias("h")).distinct().count() == 10


def test_fragments_that_all_begin_alike_are_found_by_their_rarest_piece(spark):
    names = spark.range(20_000).select(F.concat(F.lit("the same beginning "), F.conv(F.col("id"), 10, 16), F.lit(" end")).alias("name"))
    fragments = spark.range(100_000).select(F.concat(F.lit("the same beginning "), F.conv(F.col("id"), 10, 16), F.lit(" e")).alias("fragment"))
    made = joins.resolve_fragments(fragments, names, "fragment", "name")
    assert made.count() == 20_000 and made.where(F.concat("fragment", F.lit("nd")) != F.col("name")).count() == 0


def test_short_missing_and_odd_fragments(spark):
    names = spark.createDataFrame([("abcd",), ("bc",), ("xbc",), ("abc",), (None,), ("",)], "name string")
    fragments = spark.createDataFrame([("b",), ("bc",), ("abc",), ("abd",), ("",), (None,), ("zzz",), ("abcde",), ("bc",), ("ABC",)], "fragment string")
    assert {tuple(r) for r in joins.resolve_fragments(fragments, names, "fragment", "name").collect()} == {("b", "bc"), ("bc", "bc"), ("abc", "abc")}
    assert joins.resolve_fragments(fragments.where("false"), names, "fragment", "name").count() == 0
    assert joins.resolve_fragments(fragments, names.where("false"), "fragment", "name").count() == 0


def test_blocks_of_an_array_are_those_of_rows_also_where_ends_are_missing(spark):
    pick = random.Random(4)
    rows = [(song, i, pick.choice(["CHORD_START", "CHORD_END", "a", "b"])) for song in range(60) for i in range(pick.randrange(1, 25))]
    df = spark.createDataFrame(rows, "song int, pos int, tok string")
    want = {tuple(r) for r in sequence.block_spans(df, ["song"], ["pos"]).where("span >= 0").collect()}
    made = sequence.gathered(df, ["song"]).select("song", F.explode(sequence.blocks_of(F.col("toks"))).alias("b")).select("song", "b.*").collect()
    assert {(r["song"], r["at"] - 1 + i, t, r["span"]) for r in made for i, t in enumerate(r["toks"])} == want


@pytest.mark.parametrize("name", ["q_both_levels", "q_chord_histograms", "q_chord_summary", "q_readable", "q_twelve_tone_messages"])
def test_streams_of_both_levels_are_never_sorted_token_by_token(spark, data, name):
    plan = catalogue.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    # Windows stand over chords or over counted values, and nothing spreads tokens.
    assert plan.count("Window ") <= (2 if name == "q_twelve_tone_messages" else 1) and "Project" in plan
    assert "row_number" not in plan and plan.count("collect_list") == 1 and "posexplode(flatten" not in plan


@pytest.mark.parametrize("name", ["q_relabelled", "q_relabelled_by_text"])
def test_charts_are_relabelled_without_rows_of_tokens(spark, data, name):
    plan = catalogue.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window " not in plan and "posexplode" not in plan


@pytest.mark.parametrize("name", ["q_repaired_charts", "q_played_charts"])
def test_charts_go_to_python_as_arrays_without_rows_of_tokens(spark, data, name):
    plan = catalogue.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    python = plan[plan.index("MapInArrow"):]
    assert "Window " not in plan and "Generate" not in python and plan.count("collect_list") == 1


def test_songs_as_arrays_are_repaired_and_played_as_rows_are(spark):
    pick = random.Random(8)
    words = [".", "4.0", "C", "dom7", "sus4", "sus7", "add b9", "add 9", "add 13", "|", "|:", ":|", "Repeat_1", "Form_A", "e||", "b||"]
    rows = [(song, i, pick.choice(words)) for song in range(80) for i in range(pick.randrange(1, 40))]
    df = spark.createDataFrame([*rows, *((99, i, t) for i, t in enumerate(["|:", "x", ":|"] * 900))], "song int, pos int, tok string")
    songs = sequence.gathered(df, ["song"])
    played = lambda d: sorted(map(tuple, d.collect()))
    text = lambda made: {r["song"]: r["toks"] for r in made.collect()}
    assert played(recurrent.expanded_songs(songs, "song").na.fill("").na.fill(-1)) == played(recurrent.expand_charts(df, "song").na.fill("").na.fill(-1))
    assert text(recurrent.repaired_songs(songs, "song")) == text(sequence.gathered(recurrent.repaired_charts(df, "song"), ["song"]))


def test_dissonance_of_many_rows_goes_in_batches(spark):
    """What an expression interprets for each row and pair, batches give for all rows; missing voices stay null."""
    rows = [(1, [220.0, 277.5, 330.0]), (2, [440.0]), (3, [None, 220.0]), (4, None), (5, [330.0, 220.0, 277.5]), (6, []), (7, [100.0, 200.0, 300.0, 401.0])]
    df = spark.createDataFrame(rows, "id int, hz array<double>")
    for decay in (False, True):
        made = df.select("id", dissonance.dissonance_of_voices(F.col("hz"), decay=decay).alias("d"), dissonance.bound(dissonance.partials_of(F.col("hz"), decay=decay), dissonance.roughness_of).alias("e"))
        found = {r["id"]: (r["d"], r["e"]) for r in made.collect()}
        assert all((d is None and e is None) or abs(d - e) < 1e-9 for d, e in found.values()) and found[1][0] > 0 and found[3][0] is None and found[6][0] == 0
    plan = streams.described_chords(spark.createDataFrame([([200, 217, 231],)], "steps array<int>"), "steps").select("d_root", "d_220")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan


def test_voices_of_all_candidates_move_as_of_each(spark):
    import random

    rng = random.Random(3)
    for _ in range(300):
        before, root, quality = tuple(rng.choices(range(24, 90), k=rng.randint(1, 7))), rng.choice(list(voicing.ROOT_NOTES.values())), rng.choice([*voicing.CLOSED, "none"])
        options, centre = voicing.candidates(root, quality), sum(before) / len(before)
        best = min(options, key=lambda v: voicing.movement(before, v) + 0.1 * abs(sum(v) / len(v) - centre))  # noqa: B023
        assert voicing.following(before, root, quality) == (options[0] if voicing.movement(before, best) == float("inf") else best)


def test_charts_of_one_row_each_are_voiced_as_rows_of_tokens(spark):
    """A song is one array: no token is a row before or after a shuffle of tokens."""
    charts = ["x . 4.0 C maj7 add 9_x . 2.0 D m7 / E".replace("_", " "), ". 4.0 C N.C. . 4.0 G dom7", "", "| |", ". 1.0 F ø7 . 1.0 F ø7 . E m7 alter"]
    df = spark.createDataFrame([(f"s{k}", i, t) for k, c in enumerate(charts) for i, t in enumerate(c.split(" "))], "song string, pos int, tok string")
    songs = sequence.gathered(df, ["song"])
    rows = lambda made: sorted(map(repr, made.collect()))
    assert rows(voicing.voice_songs(songs, "song")) == rows(voicing.voice_charts(df, "song"))
    made = voicing.template_songs(songs, "song")
    assert rows(made.select("song", "pos", "tok", "slots")) == rows(voicing.template_voicings(df, "song").select("song", "pos", "tok", "slots"))
    want = {f"s{k}": [tuple(s) for s in voicing.template_slots(c.split(" "))] for k, c in enumerate(charts)}
    assert {k: [tuple(r["slots"]) for r in made.where(F.col("song") == k).orderBy("pos").collect()] for k in want} == want
