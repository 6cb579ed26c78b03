"""Queries of functions on names and symbols, whose SQL states the results by hand for the inputs that parts are dealt.

Every part takes one of the inputs by its key, so all rows go through the function; the SQL knows what must come out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ostinato.functions import music, spelling
from ostinato.operators import retune, streams, voicing
from ostinato.plans.common import query, table

GAP = " · "


def golden(name: str, kind: str, make: Callable[[Column], Column], cases: list[tuple], doc: str) -> None:
    """Registers a query of ``make`` over inputs of a type, with what each must give as text."""
    values = ", ".join(f"({i}, {'NULL' if want is None else chr(39) + str(want).replace(chr(39), chr(39) * 2) + chr(39)})" for i, (_, want) in enumerate(cases))
    sql = f"SELECT k.nth, v.made, k.n FROM (SELECT (p_partkey % {len(cases)})::INTEGER AS nth, count(*) AS n FROM part GROUP BY 1) k JOIN (VALUES {values}) v(nth, made) ON v.nth = k.nth"

    def run(spark, sf_dir):
        inputs = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], f"i int, x {kind}")
        counted = table(spark, sf_dir, "part").withColumn("nth", (F.col("p_partkey") % len(cases)).cast("int"))
        made = counted.join(F.broadcast(inputs), F.col("nth") == F.col("i")).select("nth", make(F.col("x")).alias("made"))
        return made.groupBy("nth", "made").agg(F.count("*").alias("n"))

    run.__doc__, run.__name__ = doc, name
    query(name, sql)(run)


def joined(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), GAP)


def several(*values: Column) -> Column:
    return F.concat_ws(GAP, *[F.coalesce(v.cast("string"), F.lit("-")) for v in values])


golden("q_chord_tokens", "array<string>", lambda x: joined(spelling.chord_tokens(x)), [
    (["|", "Cmaj7/E", "Form_A", "G"], "| · . · C · maj7 · / · E · Form_A · . · G"),
    (["F#m7b5", "Bb dom7 add 9"], ". · F# · m7b5 · . · Bb · dom7 add 9"),
    (["Cm7b5/Bb", "<end>"], ". · Cm · 7b5 · / · Bb · <end>"),
    ([], ""),
], "Symbols cut in parts after a dot; structural tokens pass.")

golden("q_timed_chord_tokens", "struct<s: array<string>, d: array<double>>", lambda x: joined(F.transform(spelling.timed_chord_tokens(x["s"], x["d"]), lambda p: F.concat_ws("@", p["token"], p["duration"].cast("string")))), [
    ((["|", "Cmaj7"], [0.0, 4.0]), "|@0.0 · .@4.0 · 4.0@4.0 · C@4.0 · maj7@4.0"),
    ((["D/F#"], [1.5]), ".@1.5 · 1.5@1.5 · D@1.5 · /@1.5 · F#@1.5"),
], "The same with a duration for each token.")

golden("q_split_compound", "array<string>", lambda x: joined(spelling.split_compound(x)), [
    (["C", "dom7 add 9"], "C · dom7 · add 9"), (["maj7 alter #11 alter b5"], "maj7 · alter #11"), (["dom7 alter b9 add 9"], "dom7 alter b9 · add 9"), (["add 9"], "add 9"),
], "Compound tokens in two; what follows a second separator is lost.")

golden("q_split_extensions", "array<string>", lambda x: joined(spelling.split_extensions(x)), [
    (["m7 add 9"], "m7 · add 9"), (["dom7 add 9 alter b5", "|"], "dom7 · add 9 · alter b5 · |"), (["add 9 alter b5"], "add 9 · alter b5"), (["add 9", "C"], "add 9 · C"),
], "Additions and alterations one by one.")

golden("q_plain_quality", "array<string>", lambda x: joined(spelling.with_plain_quality(x)), [
    ([".", "C", "|", ".", "D", "m7"], ". · C · maj · | · . · D · m7"), ([".", "G", "dom7", "/", "B"], ". · G · dom7 · / · B"),
    ([".", "A", "Form_A", ".", "E"], ". · A · maj · Form_A · . · E · maj"), (["C", "|", "/"], "C · | · /"),
], "Bare roots get a quality, basses don't.")

golden("q_literal_replacements", "array<string>", lambda x: joined(spelling.literal_replaced(x)), [
    (["C", "minor-seventh", "add b9 add b9"], "C · m7 · add b9"), (["6b5*", "13"], "G · dom7 · dom7 add 13"), (["dom7 add 9 add 9"], "dom7 add 9"), (["**", "x"], "maj · x"),
], "Whole tokens by a table; one in two; an extension once.")

golden("q_kind_symbols", "struct<root: string, kind: string, bass: string>", lambda x: several(spelling.kind_symbol(x["root"], x["kind"], x["bass"]), spelling.kind_symbol(x["root"], x["kind"], x["bass"], by_text=True)), [
    (("C", "major-seventh", None), "C maj7 · C maj7"), (("G", "Dominant", "B"), "G dom7 /B · G dom7 /B"), (("F", None, ""), "F maj · F maj"),
    (("D", "half-diminished", None), "D ø7 · D half-diminished"), (("A", "min7", None), "A min7 · A m7"),
], "Kinds by name and by what is printed.")

golden("q_scale_spelling", "string", lambda x: several(spelling.respelled(x, "major"), spelling.respelled(x, "minor"), spelling.respelled(x, "dominant")), [
    ("C", "C · C · C"), ("C#", "Db · C# · C#"), ("Gb", "Gb · F# · F#"), ("Bbb", "A · A · A"), ("D##", "E · E · E"), ("Cb", "B · B · B"), ("A#", "Bb · Bb · Bb"), ("Fb", "E · E · E"),
], "Tonics with fewer signs.")

golden("q_pure_offsets", "array<int>", lambda x: joined(retune.pure_offsets(x)), [([48, 52, 55, 58], "0 · -1 · 0 · -1"), ([60, 63, 67], "0 · 0 · 0"), ([72, 64], "0 · 0"), ([], "")], "Purer thirds and sevenths.")

golden("q_format_styles", "string", lambda x: several(music.format_style(x)), [
    ("Moderately", "Pop"), ("Even 8's", "Even 8ths"), ("Medium Swing", "Jazz"), ("Rock Pop", "Rock"), ("Beatles", "Rock"), ("Afoxe", "Afoxé"), ("Unknown", "Unknown"), ("R'n'B", "RnB"), ("Pop Folk", "Pop"),
], "Styles by the older rules.")

golden("q_coda_end", "array<string>", lambda x: joined(streams.coda_end_moved(x)), [
    (["a", "e||", "b", "|", "c"], "a · | · b · e|| · c"), (["e||", "b", ":|", "|"], "| · b · e|| · :| · |"), (["a", "|"], "a · |"), (["e||", "x"], "| · x"),
], "The end before the coda goes to the next bar.")

golden("q_near_octaves", "struct<a: array<int>, b: array<int>>", lambda x: joined(voicing.near_octaves(x["a"], x["b"])), [
    (([48, 64, 67, 0], [43, 71, 77, 0]), "43 · 71 · 65 · 0"), (([60], [73, 0]), "61 · 0"), (([0, 0], [50, 60]), "50 · 60"),
], "Notes in the octave nearest to the chord before.")

golden("q_octaves_over_root", "struct<a: array<int>, b: array<int>>", lambda x: joined(voicing.octaves_over_root(x["a"], x["b"])), [
    (([48, 52, 55, 59], [43, 71, 77, 81]), "43 · 53 · 57 · 59"), (([48], [50, 90]), "50 · 66"), (([0], [50, 90]), "50 · 90"),
], "Upper notes move by octaves, the root stays.")

golden("q_ninths", "struct<a: array<int>, b: array<int>, r: int>", lambda x: joined(voicing.with_ninth(x["a"], x["b"], x["r"])), [
    (([48, 72], [48, 52, 55], 48), "48 · 52 · 55 · 62"), (([48, 56], [48, 52, 55], 48), "48 · 52 · 55"), (([48, 72], [48, 52, 60], 48), "48 · 52 · 60"), (([48, 74], [50, 53, 60], 50), "50 · 53 · 60 · 64"),
], "A ninth where the top leaves a gap.")

golden("q_colours", "struct<v: array<int>, q: string>", lambda x: joined(voicing.with_colours(x["v"], x["q"])), [
    (([0, 4, 7, 11], "maj7"), "0 · 4 · 7 · 11 · 14 · 21"), (([0, 5, 7], "sus4"), "0 · 5 · 7 · 17"), (([0, 3, 7], "m"), "0 · 3 · 7"), (([0, 4, 7, 10, 14, 21], "dom7"), "0 · 4 · 7 · 10 · 14 · 21"),
], "Ninths, elevenths and thirteenths by quality.")

golden("q_twelve_tone", "array<int>", lambda x: joined(streams.twelve_tone_notes(x)), [([106, 124, 137], "36 · 40 · 43"), ([106, 107], "36"), ([], ""), ([424, 106], "36 · 108")], "Steps as distinct MIDI notes.")
