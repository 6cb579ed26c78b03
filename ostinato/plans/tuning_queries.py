"""Queries of the scalar functions: steps, bends, durations, velocities, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ostinato.functions import dims, music, spelling
from ostinato.operators import joins, quality
from ostinato.plans.common import LINES_SQL, lines, query, table

PART = "part"


@query("q_step53", "SELECT (l_partkey % 128)::INTEGER AS note, round_even((l_partkey % 128) * 53 / 12.0::DOUBLE + ((l_suppkey * 97) % 16383 - 8191) / 8191.0::DOUBLE * 200 * 53 / 1200, 0)::INTEGER AS step, count(*) AS n FROM lineitem GROUP BY 1, 2")
def step53(spark, sf_dir):
    note, bend = (F.col("l_partkey") % 128).cast("int"), (F.col("l_suppkey") * 97) % 16383 - 8191
    return table(spark, sf_dir, "lineitem").groupBy(note.alias("note"), music.step_of_note(note, bend).alias("step")).agg(F.count("*").alias("n"))


@query("q_step_to_midi", """WITH s AS (SELECT (p_partkey % 566)::INTEGER AS step FROM part), m AS (SELECT step, least(greatest(round_even(step * 12 / 53.0::DOUBLE, 0)::INTEGER, 0), 127) AS note FROM s)
SELECT step, note, least(greatest(round_even((step * 1200 / 53.0::DOUBLE - note * 100) / 200 * 8191, 0)::INTEGER, -8192), 8191) AS bend, count(*) AS n FROM m GROUP BY ALL""")
def step_to_midi(spark, sf_dir):
    step = (F.col("p_partkey") % 566).cast("int")
    return table(spark, sf_dir, "part").select(step.alias("step")).groupBy("step", music.note_of_step(F.col("step")).alias("note"), music.bend_of_step(F.col("step")).alias("bend")).agg(F.count("*").alias("n"))


@query("q_duration_quantise", """SELECT l_quantity, (CASE WHEN l_quantity / 3 <= 0.75 THEN 0.5 WHEN l_quantity / 3 <= 1.25 THEN 1.0 WHEN l_quantity / 3 <= 1.75 THEN 1.5 WHEN l_quantity / 3 <= 2.5 THEN 2.0 WHEN l_quantity / 3 <= 3.5 THEN 3.0
    WHEN l_quantity / 3 <= 5 THEN 4.0 WHEN l_quantity / 3 <= 7 THEN 6.0 WHEN l_quantity / 3 <= 10 THEN 8.0 WHEN l_quantity / 3 <= 14 THEN 12.0 ELSE 16.0 END)::DOUBLE AS duration, count(*) AS n FROM lineitem GROUP BY ALL""")
def duration_quantise(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_quantity", music.quantised_duration(F.col("l_quantity") / 3).alias("duration")).agg(F.count("*").alias("n"))


@query("q_velocity_bins", """WITH v AS (SELECT (l_partkey % 128)::INTEGER AS velocity, CASE WHEN l_partkey % 128 <= 0 THEN 1 ELSE least(greatest(ceil((l_partkey % 128) / 127.0::DOUBLE * 8), 1), 8) END::INTEGER AS bin FROM lineitem)
SELECT velocity, bin, least(greatest(round_even(bin / 8.0::DOUBLE * 127, 0), 1), 127)::INTEGER AS back, count(*) AS n FROM v GROUP BY ALL""")
def velocity_bins(spark, sf_dir):
    velocity = (F.col("l_partkey") % 128).cast("int")
    df = table(spark, sf_dir, "lineitem").select(velocity.alias("velocity"), music.velocity_bin(velocity).alias("bin"))
    return df.groupBy("velocity", "bin", music.velocity_of_bin(F.col("bin")).alias("back")).agg(F.count("*").alias("n"))


SCALE_ROWS_SQL = dims.values_sql([(k, t, pc, s) for k in dims.SCALES for t in range(12) for pc, s in enumerate(dims.chromatic_scale(k, t))], "type, tonic, pc, step")


@query("q_retune_bend", f"""WITH n AS (SELECT DISTINCT (l_partkey % 128)::INTEGER AS note FROM lineitem), d AS (
    SELECT type, tonic, note, step - (note % 12) * 53 / 12.0::DOUBLE AS off FROM n JOIN {SCALE_ROWS_SQL} ON pc = note % 12
), w AS (SELECT *, (CASE WHEN off > 26.5 THEN off - 53 WHEN off < -26.5 THEN off + 53 ELSE off END) * 1200 / 53 AS cents FROM d)
SELECT type, tonic, note, round(cents, 6) AS cents, least(greatest(trunc(round(cents / 200 * 8192, 6))::INTEGER, -8192), 8191) AS bend FROM w""")
def retune_bend(spark, sf_dir):
    notes = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 128).cast("int").alias("note")).distinct()
    df = notes.join(F.broadcast(dims.scale_table(spark)), F.col("pc") == F.col("note") % 12)
    cents = music.cents_between(music.retuned_hertz(F.col("note"), F.col("step")), music.hertz_of_note(F.col("note")))
    bend = F.least(F.greatest(F.round(cents / 200 * 8192, 6).cast("int"), F.lit(-8192)), F.lit(8191))
    return df.select("type", "tonic", "note", F.round(cents, 6).alias("cents"), bend.alias("bend"))


@query("q_microtonality", f"""WITH s AS (SELECT type, pc, step FROM {SCALE_ROWS_SQL} WHERE tonic = 0), u AS (
    SELECT s.type, abs(step * 1200 / 53.0::DOUBLE - round_even(step * 1200 / 53.0::DOUBLE / 100, 0) * 100) AS off FROM s JOIN part ON p_partkey % 12 = pc
) SELECT type, round(avg((off <= 7)::INT::DOUBLE) * 100, 6) AS pct_near, round(avg(off), 6) AS mean_cents FROM u GROUP BY 1""")
def microtonality(spark, sf_dir):
    """The pitch class of every part in each of the scale types."""
    scale = dims.scale_table(spark).where("tonic = 0").select("type", "pc", "step")
    df = table(spark, sf_dir, "part").join(F.broadcast(scale), F.col("p_partkey") % 12 == F.col("pc"))
    return quality.microtonality(df, "type", "step")


@query("q_cross_types", f"""SELECT type, count(*) AS n, count(DISTINCT o_orderkey) AS songs FROM orders, {dims.values_sql([(k,) for k in dims.SCALES], 'type')} GROUP BY 1""")
def cross_types(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey").crossJoin(F.broadcast(dims.type_table(spark).select("type")))
    return df.groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("songs"))


STYLE_ARRAY = ["Medium Swing", "Bossa Nova", "Rock Pop", "Latin", "Ballad", "Unknown", "R&B", "Afro 12/8", "Slow Blues Shuffle", "Waltz Song", "Even 8ths", "Hymn"]
STYLE_SQL = "CASE " + " ".join(f"WHEN name = '{k.replace(chr(39), chr(39) * 2)}' THEN '{v}'" for k, v in dims.STYLE_NAMES.items()) + " " + " ".join(
    ("WHEN lower(replace(replace(replace(name, '&', 'n'), ' and ', ' n '), ' ', '')) IN ('rnb', 'rhythmnblues', 'rhythmblues')" if w == dims.RNB else f"WHEN contains(name, '{w}')") + f" THEN '{v}'" for w, v in reversed(dims.STYLE_WORDS)
) + " END"


@query("q_style_classify", f"""WITH s AS (SELECT (['{"','".join(STYLE_ARRAY)}'])[(p_partkey % {len(STYLE_ARRAY)} + 1)::INTEGER] || CASE WHEN p_size % 3 = 0 THEN ' ' || p_type ELSE '' END AS name FROM part)
SELECT name, {STYLE_SQL} AS style, count(*) AS n FROM s GROUP BY 1, 2""")
def style_classify(spark, sf_dir):
    base = F.element_at(F.array(*[F.lit(s) for s in STYLE_ARRAY]), (F.col("p_partkey") % len(STYLE_ARRAY) + 1).cast("int"))
    name = F.when(F.col("p_size") % 3 == 0, F.concat(base, F.lit(" "), F.col("p_type"))).otherwise(base)
    return table(spark, sf_dir, "part").select(name.alias("name")).groupBy("name", music.style_label(F.col("name")).alias("style")).agg(F.count("*").alias("n"))


ZONES_SQL = """
    (SELECT min(x) FROM unnest(iv) AS u(x) WHERE x BETWEEN 10 AND 22) AS third, (SELECT min(x) FROM unnest(iv) AS u(x) WHERE x BETWEEN 24 AND 35) AS fifth, (SELECT min(x) FROM unnest(iv) AS u(x) WHERE x BETWEEN 42 AND 52) AS seventh"""


def _snap(column: str, grid: list[int]) -> str:
    cases = " ".join(f"WHEN {column} <= {(a + b) / 2} THEN {a}" for a, b in zip(grid, grid[1:], strict=False))
    return f"CASE WHEN {column} IS NULL THEN NULL {cases} ELSE {grid[-1]} END"


@query("q_interval_classify", f"""WITH p AS (SELECT [(l_partkey % 53), (l_suppkey * 7 % 53), (l_orderkey * 3 % 53), (l_linenumber * 11 % 53)] AS iv FROM lineitem), z AS (SELECT {ZONES_SQL} FROM p), s AS (
    SELECT {_snap('third', dims.THIRDS)} AS t, coalesce({_snap('fifth', dims.FIFTHS)}, 31) AS f, {_snap('seventh', dims.SEVENTHS)} AS v FROM z
) SELECT round(coalesce(pow(2, t / 53.0::DOUBLE), 1), 6) AS alpha, round(pow(2, f / 53.0::DOUBLE), 6) AS beta, round(coalesce(pow(2, v / 53.0::DOUBLE), pow(2, f / 53.0::DOUBLE)), 6) AS gamma, count(*) AS n FROM s GROUP BY ALL""")
def interval_classify(spark, sf_dir):
    steps = F.array(F.col("l_partkey") % 53, F.col("l_suppkey") * 7 % 53, F.col("l_orderkey") * 3 % 53, (F.col("l_linenumber") * 11 % 53).cast("bigint"))
    ratios = music.chord_ratios(music.intervals(steps, F.lit(0)))
    df = table(spark, sf_dir, "lineitem").select(ratios.alias("r")).select(*[F.round(f"r.{c}", 6).alias(c) for c in ("alpha", "beta", "gamma")])
    return df.groupBy("alpha", "beta", "gamma").agg(F.count("*").alias("n"))


@query("q_root_lookup", f"""SELECT coalesce(d.pc, -1)::INTEGER AS pc, count(*) AS n FROM (SELECT (['C', '^C', 'vD', 'F#', 'H', 'vC', 'Bb'])[(p_partkey % 7 + 1)::INTEGER] AS name FROM part) p LEFT JOIN
    (SELECT * FROM {dims.values_sql([(n, i) for n, i in {n: i for i, n in enumerate(dims.NOTE_NAMES)}.items()], 'name, pc')}) d ON d.name = p.name GROUP BY 1""")
def root_lookup(spark, sf_dir):
    names = F.element_at(F.array(*[F.lit(x) for x in ("C", "^C", "vD", "F#", "H", "vC", "Bb")]), (F.col("p_partkey") % 7 + 1).cast("int"))
    dim = dims.note_table(spark).withColumnRenamed("name", "dim_name")
    df = joins.looked_up(table(spark, sf_dir, "part").select(names.alias("name")), dim, F.col("name") == F.col("dim_name"), "pc", -1)
    return df.groupBy("pc").agg(F.count("*").alias("n"))


@query("q_semantic_steps", f"""SELECT coalesce(d.name, 'step' || (p_partkey % 53)) AS semantic, count(*) AS n FROM part LEFT JOIN (SELECT * FROM {dims.values_sql(list(dims.SEMANTIC_STEPS.items()), 'step, name')}) d ON d.step = p_partkey % 53 GROUP BY 1""")
def semantic_steps(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(music.semantic_step(F.col("p_partkey").cast("int")).alias("semantic")).agg(F.count("*").alias("n"))


_NAMES = list(dict.fromkeys(dims.SEMANTIC_STEPS.values()))


@query("q_chord_names", f"""WITH q AS (SELECT (['major', 'minor', 'neutral', 'upmajor', 'subminor'])[(p_partkey % 5 + 1)::INTEGER] AS third, (['perfect', 'diminished', 'augmented'])[(p_size % 3 + 1)::INTEGER] AS fifth,
    (['major', 'minor', 'neutral', 'subminor', NULL])[(p_partkey // 5 % 5 + 1)::INTEGER] AS seventh FROM part), n AS (
    SELECT q.*, d.name AS known, CASE q.third WHEN 'major' THEN '' WHEN 'minor' THEN 'm' WHEN 'neutral' THEN 'N' WHEN 'upmajor' THEN '^' ELSE 'sm' END AS base, CASE q.fifth WHEN 'perfect' THEN '' WHEN 'diminished' THEN 'dim' ELSE '+' END AS middle
    FROM q LEFT JOIN (SELECT * FROM {dims.values_sql([(*k, n) for k, n in dims.chord_names().items()], 'third, fifth, seventh, name')}) d ON q.third = d.third AND q.fifth = d.fifth AND q.seventh IS NOT DISTINCT FROM d.seventh
) SELECT third, fifth, seventh, coalesce(known, base || middle || CASE WHEN seventh IS NULL THEN '' WHEN seventh = 'major' THEN 'M7' WHEN seventh = 'neutral' THEN 'N7' WHEN seventh = 'subminor' THEN 'sm7'
    WHEN third = 'major' OR base LIKE '%m' THEN '7' ELSE 'm7' END) AS name, count(*) AS n FROM n GROUP BY ALL""")
def chord_names(spark, sf_dir):
    """Names from the table, and put together where the table has none."""
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))
    df = table(spark, sf_dir, "part").select(pick(["major", "minor", "neutral", "upmajor", "subminor"], F.col("p_partkey") % 5).alias("third"), pick(["perfect", "diminished", "augmented"], F.col("p_size") % 3).alias("fifth"), pick(["major", "minor", "neutral", "subminor", None], F.expr("p_partkey div 5") % 5).alias("seventh"))
    return df.groupBy("third", "fifth", "seventh", music.chord_name(F.col("third"), F.col("fifth"), F.col("seventh")).alias("name")).agg(F.count("*").alias("n"))


@query("q_pitch_arithmetic", """SELECT (p_partkey % 530)::INTEGER AS step, round(440.0::DOUBLE * pow(2, (p_partkey % 530) / 53.0::DOUBLE - 69 / 12.0::DOUBLE), 6) AS hz, round(pow(2, (p_partkey % 530) / 53.0::DOUBLE), 6) AS ratio,
    round((p_partkey % 530) * 1200 / 53.0::DOUBLE - round_even((p_partkey % 530) * 1200 / 53.0::DOUBLE / 100, 0) * 100, 6) AS off, (p_partkey % 53)::INTEGER AS pc, count(*) AS n FROM part GROUP BY ALL""")
def pitch_arithmetic(spark, sf_dir):
    step = (F.col("p_partkey") % 530).cast("int")
    df = table(spark, sf_dir, "part").select(step.alias("step"))
    s = F.col("step")
    return df.groupBy("step", F.round(music.hertz_of_step(s), 6).alias("hz"), F.round(music.ratio_of_step(s), 6).alias("ratio"), F.round(music.cents_from_semitone(s), 6).alias("off"), music.pitch_class(s).alias("pc")).agg(F.count("*").alias("n"))


LINE_SQL = "['" + "','".join(spelling.LINE) + "']"


@query("q_transposed_notes", f"""WITH n AS (SELECT ({LINE_SQL})[(p_partkey % 35 + 1)::INTEGER] AS note, (['C', 'Eb', 'F#'])[(p_size % 3 + 1)::INTEGER] AS key FROM part)
SELECT note, key, ({LINE_SQL})[(((list_position({LINE_SQL}, note) + list_position({LINE_SQL}, key) - 2 - 15) % 35 + 35) % 35 + 1)::INTEGER] AS moved,
    ((((list_position({LINE_SQL}, note) - 16) * 7) % 12 + 12) % 12)::INTEGER AS semitone, count(*) AS n FROM n GROUP BY ALL""")
def transposed_notes(spark, sf_dir):
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))
    df = table(spark, sf_dir, "part").select(pick(spelling.LINE, F.col("p_partkey") % 35).alias("note"), pick(["C", "Eb", "F#"], F.col("p_size") % 3).alias("key"))
    return df.groupBy("note", "key", spelling.transposed(F.col("note"), F.lit("C"), F.col("key")).alias("moved"), spelling.semitone(F.col("note")).alias("semitone")).agg(F.count("*").alias("n"))


SYMBOLS = ["Cmaj7/E", "F#m7b5", "Bbdom7", "Am7 add 9", "G", "D/F#", "Cm7b5", "Ebb maj7 add 9 alter b5", "Abbbm"]
ROOT_SIZE_SQL = "CASE WHEN contains(substr({0}, 2), '###') OR contains(substr({0}, 2), 'bbb') THEN 4 WHEN contains(substr({0}, 2), '##') OR contains(substr({0}, 2), 'bb') THEN 3 WHEN contains(substr({0}, 2), '#') OR contains(substr({0}, 2), 'b') THEN 2 ELSE 1 END"


@query("q_chord_symbols", f"""WITH s AS (SELECT ({SYMBOLS!r})[(p_partkey % {len(SYMBOLS)} + 1)::INTEGER] AS symbol, count(*) AS n FROM part GROUP BY 1), h AS (
    SELECT *, split_part(symbol, '/', 1) AS chord, nullif(split_part(symbol, '/', 2), '') AS bass, split_part(split_part(symbol, '/', 1), ' ', 1) AS head FROM s)
SELECT symbol, substr(head, 1, {ROOT_SIZE_SQL.format('head')}) AS root, substr(head, {ROOT_SIZE_SQL.format('head')} + 1) AS nature, substr(chord, length(head) + 2) AS extension, bass, n FROM h""")
def chord_symbols(spark, sf_dir):
    symbol = F.element_at(F.array(*[F.lit(x) for x in SYMBOLS]), (F.col("p_partkey") % len(SYMBOLS) + 1).cast("int"))
    df = table(spark, sf_dir, "part").select(symbol.alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))
    slash = spelling.split_slash(F.col("symbol"))
    c = spelling.split_chord(slash["chord"])
    return df.select("symbol", c["root"].alias("root"), c["nature"].alias("nature"), c["extension"].alias("extension"), slash["bass"].alias("bass"), "n")


@query("q_form_labels", """WITH s AS (SELECT (['Form_A', 'form_intro', 'IN', 'Outro', 'Form_X', 'segno', 'Form_Head'])[(p_partkey % 7 + 1)::INTEGER] AS raw FROM part)
SELECT raw, CASE WHEN u IN ('IN', 'INTR') THEN 'INTRO' WHEN u = 'OUTRO' THEN 'CODA' WHEN u IN ('INTRO', 'A', 'B', 'C', 'D', 'VERSE', 'HEAD', 'CODA', 'SEGNO') THEN u END AS form, count(*) AS n
FROM (SELECT raw, upper(regexp_replace(raw, '^form_', '', 'i')) AS u FROM s) GROUP BY 1, 2""")
def form_labels(spark, sf_dir):
    raw = F.element_at(F.array(*[F.lit(x) for x in ("Form_A", "form_intro", "IN", "Outro", "Form_X", "segno", "Form_Head")]), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(raw.alias("raw")).groupBy("raw", music.form_label(F.col("raw")).alias("form")).agg(F.count("*").alias("n"))


@query("q_roughness", f"""WITH {LINES_SQL}, p AS (SELECT l_orderkey, 100 + l_partkey % 900 AS f, 1 / (1 + pos)::DOUBLE AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY 100 + l_partkey % 900, 1 / (1 + pos)::DOUBLE) AS k FROM lines), d AS (
    SELECT x.l_orderkey, least(x.a, y.a) * (5 * exp(-3.51 * s) - 5 * exp(-5.75 * s)) AS v FROM p x JOIN p y ON x.l_orderkey = y.l_orderkey AND x.k < y.k, LATERAL (SELECT 0.24 / (0.0207 * x.f + 18.96) * (y.f - x.f) AS s)
) SELECT p.l_orderkey, round(coalesce(sum(v), 0), 6) AS roughness FROM (SELECT DISTINCT l_orderkey FROM p) p LEFT JOIN d USING (l_orderkey) GROUP BY 1""")
def roughness(spark, sf_dir):
    df = lines(spark, sf_dir).select("l_orderkey", (F.col("l_partkey") % 900 + 100).alias("f"), (F.lit(1.0) / (F.col("pos") + 1)).alias("a"))
    return quality.roughness(df, ["l_orderkey"], "f", "a").select("l_orderkey", F.round("roughness", 6).alias("roughness"))


@query("q_learning_rate", """SELECT (p_partkey % 3000)::INTEGER AS step, round(CASE WHEN p_partkey % 3000 < 200 THEN (p_partkey % 3000) * (0.0006 / 200) WHEN p_partkey % 3000 > 2500 THEN 0.00006
    ELSE 0.00006 + (1 + cos(((p_partkey % 3000) - 200) / 2300.0::DOUBLE * pi())) * 0.5 * 0.00054 END, 9)::DOUBLE AS rate, count(*) AS n FROM part GROUP BY 1, 2""")
def learning_rate(spark, sf_dir):
    step = (F.col("p_partkey") % 3000).cast("int")
    return table(spark, sf_dir, "part").groupBy(step.alias("step"), F.round(music.learning_rate(step, 6e-4, 6e-5, 200, 2500), 9).alias("rate")).agg(F.count("*").alias("n"))
