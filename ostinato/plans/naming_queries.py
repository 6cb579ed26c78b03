"""Queries of functions on names, symbols and numbers, on inputs that each part makes of its own columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ostinato.functions import spelling
from ostinato.operators import retune, voicing
from ostinato.plans.common import query, table

NAMES = spelling.SPELLINGS
NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
# The pitch class of each spelling, and the steps of semitones.
PITCHES_SQL = "[0, 1, 1, 2, 3, 3, 4, 5, 6, 6, 7, 8, 8, 9, 10, 10, 11]"
STEPS_SQL = "[0, 5, 9, 14, 17, 22, 27, 31, 36, 39, 44, 48]"


def chosen(options: list[str], place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in options]), (F.pmod(place, F.lit(len(options))) + 1).cast("int"))


def joined(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), " ")


def of_parts(name: str, sql: str, doc: str, /, **columns: Callable[[Column, Column], Column]) -> None:
    """Registers a query with the key of each part and columns made from its key and size."""

    def run(spark, sf_dir):
        key, size = F.col("p_partkey"), F.col("p_size")
        return table(spark, sf_dir, "part").select("p_partkey", *[make(key, size).alias(c) for c, make in columns.items()])

    run.__doc__, run.__name__ = doc, name
    query(name, sql)(run)


of_parts("q_semitone_steps", f"SELECT p_partkey, (floor(s / 12.0) * 53 + {STEPS_SQL}[((s % 12) + 12) % 12 + 1])::INTEGER AS step FROM (SELECT p_partkey, p_partkey % 61 - 30 AS s FROM part)",
    "Steps of semitones over octaves, below 0 too.", step=lambda key, size: retune.steps_of_semitones(key % 61 - 30).cast("int"))

of_parts("q_pattern_bends", """WITH x AS (SELECT p_partkey, greatest(least(((p_size % 53) * 1200.0::DOUBLE / 53 - (p_partkey % 128) % 12 * 100) / 100 / 2, 1.0), -1.0) AS share FROM part)
SELECT p_partkey, trunc(share * CASE WHEN share >= 0 THEN 8191 ELSE 8192 END)::INTEGER AS bend FROM x""",
    "Bends of notes whose pitch class has a step.", bend=lambda key, size: retune.bend_of_pattern(key % 128, size % 53))

of_parts("q_template_names", "SELECT p_partkey, 'v_' || (((p_partkey - 50) % 7 + 7) % 7) AS template FROM part", "Templates in turn.", template=lambda key, size: voicing.template_name(key - 50))

of_parts("q_plain_meter", "SELECT p_partkey, p_partkey % 7 + 1 IN (2, 4) AND p_size % 3 = 1 AS kept FROM part", "Meters that are kept: two or four quarters.",
    kept=lambda key, size: spelling.in_plain_meter(F.concat_ws("/", (key % 7 + 1).cast("string"), chosen(["2", "4", "8"], size))))

of_parts("q_sounding_slots", "SELECT p_partkey, array_to_string(list_filter(list_transform([0, 1, 2, 3], lambda i: (p_partkey * (i + 1) * 7 + p_size) % 5 * 12), lambda n: n > 0), ' ') AS notes FROM part",
    "Slots that aren't empty.", notes=lambda key, size: joined(spelling.sounding(F.array(*[(key * ((i + 1) * 7) + size) % 5 * 12 for i in range(4)]))))

of_parts("q_clean_lists", "SELECT p_partkey, array_to_string(list_filter(string_split(replace(p_name, ' ', ''), 'l'), lambda t: t <> ''), ' ') AS tokens FROM part",
    "Lists without empty tokens.", tokens=lambda key, size: joined(spelling.without_empty(F.split(F.replace("p_name", F.lit(" "), F.lit("")), "l"))))

of_parts("q_method_rewrite", "SELECT p_partkey, 'PV_' || p_size || '_1 BAR XH_' || p_partkey || ' PV_' || p_partkey % 9 AS tokens FROM part", "Notes under the usual prefix.",
    tokens=lambda key, size: joined(spelling.as_method_a(F.array(F.concat(F.lit("H_"), size.cast("string"), F.lit("_1")), F.lit("BAR"), F.concat(F.lit("XH_"), key.cast("string")), F.concat(F.lit("PV_"), (key % 9).cast("string"))))))

of_parts("q_chromatic_distance", f"SELECT p_partkey, (({PITCHES_SQL}[p_size % 18 + 1] - {PITCHES_SQL}[p_partkey % 17 + 1]) % 12 + 12)::INTEGER % 12 AS semitones FROM part",
    "Semitones up from one note to another; E# is none of the spellings.", semitones=lambda key, size: spelling.chromatic_distance(chosen(NAMES, key), chosen([*NAMES, "E#"], size)))


def _notes(key: Column, size: Column) -> Column:
    return F.slice(F.array(*[(key % 12 + n).cast("int") for n in (0, 4, 7, 11, 14)]), 1, (size % 4 + 2).cast("int"))


_lower = "list_sort(list_transform(notes, lambda n, i: CASE WHEN len(notes) > {0} AND i = len(notes) - {0} + 1 THEN n - 12 ELSE n END))"
of_parts("q_drop_voicings", f"WITH v AS (SELECT p_partkey, list_transform([0, 4, 7, 11, 14][:p_size % 4 + 2], lambda n: n + p_partkey % 12) AS notes FROM part) SELECT p_partkey, array_to_string({_lower.format(2)}, ' ') AS second, array_to_string({_lower.format(3)}, ' ') AS third FROM v",
    "A note from the top an octave lower.", second=lambda key, size: joined(voicing.dropped(_notes(key, size), 2)), third=lambda key, size: joined(voicing.dropped(_notes(key, size), 3)))


def _stem(key: Column, size: Column) -> Column:
    return F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), F.when(key % 2 == 0, F.lower(chosen(NAMES, size))).otherwise(chosen(NAMES, size)), chosen(["Major", "minor", "MINOR", "dorian"], key))


of_parts("q_key_of_stem", f"""WITH s AS (SELECT p_partkey, replace(p_name, ' ', '_') || '_' || CASE WHEN p_partkey % 2 = 0 THEN lower({NAMES_SQL}[p_size % 17 + 1]) ELSE {NAMES_SQL}[p_size % 17 + 1] END || '_' || (['Major', 'minor', 'MINOR', 'dorian'])[p_partkey % 4 + 1] AS stem FROM part),
f AS (SELECT p_partkey, stem, regexp_extract(stem, '(?i)_([a-z#]+)_(major|minor)$', 1) AS k, regexp_extract(stem, '(?i)_([a-z#]+)_(major|minor)$', 2) AS t FROM s)
SELECT p_partkey, CASE WHEN k = '' THEN 'C' ELSE upper(k[1]) || lower(k[2:]) END AS key, CASE WHEN k = '' THEN 'major' ELSE lower(t) END AS tonality FROM f""",
    "Keys at the end of stems.", key=lambda key, size: retune.key_of_stem(_stem(key, size))["key"], tonality=lambda key, size: retune.key_of_stem(_stem(key, size))["tonality"])

of_parts("q_key_names", """WITH k AS (SELECT p_partkey, p_partkey % 17 - 8 AS f, p_size % 3 AS m FROM part)
SELECT p_partkey, CASE WHEN abs(f) > 6 OR m = 2 THEN NULL WHEN m = 0 THEN (['Gb', 'Db', 'Ab', 'Eb', 'Bb', 'F', 'C', 'G', 'D', 'A', 'E', 'B', 'F#'])[f + 7] ELSE (['Eb', 'Bb', 'F', 'C', 'G', 'D', 'A', 'E', 'B', 'F#', 'C#', 'G#', 'D#'])[f + 7] END AS tonic FROM k""",
    "Keys on the circle of fifths.", tonic=lambda key, size: spelling.key_name((key % 17 - 8).cast("int"), chosen(["major", "minor", "dorian"], size)))


def _ticks(key: Column, size: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t, _, _ in spelling.DURATION_CLASSES]), (key % len(spelling.DURATION_CLASSES) + 1).cast("int")) + (size % 2).cast("int")


of_parts("q_duration_classes", "WITH c(ticks, name, length) AS (VALUES " + ", ".join(f"({t}, '{n}', {x}::DOUBLE)" for t, n, x in spelling.DURATION_CLASSES) + f"""), t AS (SELECT p_partkey, [{', '.join(str(t) for t, _, _ in spelling.DURATION_CLASSES)}][p_partkey % {len(spelling.DURATION_CLASSES)} + 1] + p_size % 2 AS ticks FROM part)
SELECT p_partkey, name, length FROM t LEFT JOIN c USING (ticks)""", "Names of durations in ticks; one tick more has none.", name=lambda key, size: spelling.duration_class(_ticks(key, size))["name"], length=lambda key, size: spelling.duration_class(_ticks(key, size))["length"])  # fmt: skip

of_parts("q_spellings", f"SELECT p_partkey, array_to_string(list_filter({NAMES_SQL}, lambda n, i: {PITCHES_SQL}[i] = p_partkey % 14), ' ') AS names FROM part",
    "Spellings of pitch classes.", names=lambda key, size: joined(spelling.notes_at_semitone((key % 14).cast("int"))))


def _scale(key: Column, size: Column) -> Column:
    return F.split(F.when(size % 2 == 0, "Eb F G Ab Bb C D").otherwise("D E F# G A B C#"), " ")


of_parts("q_scale_degrees", f"""WITH s AS (SELECT p_partkey, {NAMES_SQL}[p_partkey % 17 + 1] AS n, string_split(CASE WHEN p_size % 2 = 0 THEN 'Eb F G Ab Bb C D' ELSE 'D E F# G A B C#' END, ' ') AS scale FROM part)
SELECT p_partkey, coalesce(nullif(coalesce(list_position(scale, n), 0), 0), nullif(coalesce(list_position(scale, n || 'b'), 0), 0), nullif(coalesce(list_position(scale, n || '#'), 0), 0), CASE WHEN length(n) > 1 THEN nullif(coalesce(list_position(scale, n[1]), 0), 0) END, 0)::INTEGER - 1 AS degree FROM s""",
    "Where a note stands in a scale.", degree=lambda key, size: spelling.scale_degree(_scale(key, size), chosen(NAMES, key)))

of_parts("q_one_bar_line", "SELECT p_partkey, CASE WHEN p_partkey % 7 < 6 THEN '|' ELSE p_name END AS token FROM part", "Double bars and repeat signs as plain bar lines.",
    token=lambda key, size: spelling.one_bar_line(F.when(key % 7 == 6, F.col("p_name")).otherwise(chosen(["e||", "b||", "||", "|:", ":|", "|", "-"], key))))
