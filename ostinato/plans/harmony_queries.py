"""Queries of dissonance, vectors, retuning, relabelling and transposition."""

from __future__ import annotations

from pyspark.sql import functions as F

from ostinato.functions import dims, dissonance, music, spelling
from ostinato.operators import quality, recurrent, relabel, retune, sequence, streams
from ostinato.plans.common import LINES_SQL, lines, query, songs, table
from ostinato.plans.tuning_queries import SCALE_ROWS_SQL

# --- dissonance

PAIR_SQL = "least(x.a, y.a) * (5 * exp(-3.51 * (0.24 / (0.0207 * x.f + 18.96) * (y.f - x.f))) - 5 * exp(-5.75 * (0.24 / (0.0207 * x.f + 18.96) * (y.f - x.f))))"


def kernel_sql(points: str, key: str, hertz: str, amplitude: str = "1.0::DOUBLE", harmonics: int = 6) -> str:
    """CTEs ``kp`` and ``kd`` (key, d): the dissonance of each key's frequencies, an array, in ``points``."""
    return f"""kf AS (SELECT {key}, unnest({hertz}) AS f0 FROM {points}), kh AS (SELECT {key}, f0 * h AS f, {amplitude} AS a FROM kf, (SELECT unnest(range(1, {harmonics + 1})) AS h)),
kp AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY f, a) AS r FROM kh), kd AS (SELECT x.{key}, sum({PAIR_SQL}) AS d FROM kp x JOIN kp y ON x.{key} = y.{key} AND x.r < y.r GROUP BY 1)"""


NODES = 9


@query("q_dissonance_map", f"""WITH g AS (SELECT i.i, j.j, k.k, i.i * 10000 + j.j * 100 + k.k AS id FROM (SELECT unnest(range(0, {NODES})) AS i) i, (SELECT unnest(range(0, {NODES})) AS j) j, (SELECT unnest(range(0, {NODES})) AS k) k WHERE i <= j AND j <= k),
p AS (SELECT id, [220.0::DOUBLE, 220.0 * (1 + i / {NODES - 1}.0::DOUBLE), 220.0 * (1 + j / {NODES - 1}.0::DOUBLE), 220.0 * (1 + k / {NODES - 1}.0::DOUBLE)] AS hz FROM g), {kernel_sql('p', 'id', 'hz')}
SELECT round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, round(min(d), 6) AS least, round(max(d), 6) AS most, count(*) AS n FROM kd""")
def dissonance_map(spark, sf_dir):
    """Statistics of a coarse map where its ratios ascend."""
    made = dissonance.map_stats(dissonance.dissonance_map(spark, NODES))
    return made.select(*[F.round(c, 6).alias(c) for c in ("mean", "std", "least", "most")], "n")


TONES_SQL = "SELECT t.t AS third, f.f AS fifth, s.s AS seventh FROM (SELECT unnest({thirds}) AS t) t, (SELECT unnest({fifths}) AS f) f, (SELECT unnest({sevenths}) AS s) s".format(
    thirds=str([*dims.THIRDS, None]).replace("None", "NULL"), fifths=dims.FIFTHS, sevenths=str([*dims.SEVENTHS, None]).replace("None", "NULL")
)
DIM_SQL = f"""tones AS ({TONES_SQL}), ratio AS (SELECT third, fifth, seventh, row_number() OVER () AS id, coalesce(pow(2, third / 53.0::DOUBLE), 1.0) AS alpha, pow(2, fifth / 53.0::DOUBLE) AS beta, pow(2, coalesce(seventh, fifth) / 53.0::DOUBLE) AS gamma FROM tones),
at0 AS (SELECT *, greatest(ceil((alpha - 1) * 149) - 1, 0)::INTEGER AS ai, greatest(ceil((beta - 1) * 149) - 1, 0)::INTEGER AS bi, greatest(ceil((gamma - 1) * 149) - 1, 0)::INTEGER AS gi FROM ratio),
corner AS (SELECT id, id * 8 + x * 4 + y * 2 + z AS cid, ai + x AS i, bi + y AS j, gi + z AS k, abs(1 - x - ((alpha - 1) * 149 - ai)) * abs(1 - y - ((beta - 1) * 149 - bi)) * abs(1 - z - ((gamma - 1) * 149 - gi)) AS w
    FROM at0, (SELECT unnest([0, 1]) AS x) x, (SELECT unnest([0, 1]) AS y) y, (SELECT unnest([0, 1]) AS z) z),
cp AS (SELECT cid, [220.0::DOUBLE, 220.0 * (1 + i / 149.0::DOUBLE), 220.0 * (1 + j / 149.0::DOUBLE), 220.0 * (1 + k / 149.0::DOUBLE)] AS hz FROM corner), {kernel_sql('cp', 'cid', 'hz')},
dim AS (SELECT third, fifth, seventh, alpha, beta, gamma, sum(w * d) AS d FROM corner JOIN kd USING (cid) JOIN ratio USING (id) GROUP BY ALL)"""


@query("q_dissonance_dim", f"WITH {DIM_SQL} SELECT third, fifth, seventh, round(d, 6) AS d FROM dim")
def dissonance_dim(spark, sf_dir):
    """The map's value for all that a chord can be, from the nodes around it."""
    return dissonance.dissonance_dim(spark).select("third", "fifth", "seventh", F.round("d", 6).alias("d"))


@query("q_map_lookup", f"""WITH g AS (SELECT i.i, j.j, k.k, sin(i.i) + j.j * k.k AS d FROM (SELECT unnest(range(0, {NODES})) AS i) i, (SELECT unnest(range(0, {NODES})) AS j) j, (SELECT unnest(range(0, {NODES})) AS k) k),
p AS (SELECT p_partkey, (1 + p_partkey % 97 / 90.0::DOUBLE - 1) * {NODES - 1} AS a, (p_size / 50.0::DOUBLE) * {NODES - 1} AS b, (p_partkey % 13 / 13.0::DOUBLE) * {NODES - 1} AS c FROM part),
q AS (SELECT *, least(greatest(ceil(a) - 1, 0), {NODES - 2})::INTEGER AS ai, least(greatest(ceil(b) - 1, 0), {NODES - 2})::INTEGER AS bi, least(greatest(ceil(c) - 1, 0), {NODES - 2})::INTEGER AS ci FROM p),
w AS (SELECT p_partkey, ai + x AS i, bi + y AS j, ci + z AS k, abs(1 - x - (a - ai)) * abs(1 - y - (b - bi)) * abs(1 - z - (c - ci)) AS w FROM q, (SELECT unnest([0, 1]) AS x) x, (SELECT unnest([0, 1]) AS y) y, (SELECT unnest([0, 1]) AS z) z WHERE a <= {NODES - 1})
SELECT p_partkey, round(sum(w * d), 6) AS d FROM w JOIN g USING (i, j, k) GROUP BY 1 UNION ALL SELECT p_partkey, -1.0 FROM p WHERE a > {NODES - 1}""")
def map_lookup(spark, sf_dir):
    """Points of all parts looked up between the nodes of a map; -1 outside of it."""
    grid = spark.range(NODES**3).select(*[(F.expr(f"id div {NODES**p}") % NODES).cast("int").alias(n) for n, p in (("i", 2), ("j", 1), ("k", 0))])
    diss_map = grid.withColumn("d", F.sin("i") + F.col("j") * F.col("k"))
    points = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 97 / 90.0 + 1).alias("alpha"), (F.col("p_size") / 50.0 + 1).alias("beta"), (F.col("p_partkey") % 13 / 13.0 + 1).alias("gamma"))
    return dissonance.interpolated(points, diss_map, ["p_partkey"], NODES, -1.0).select("p_partkey", F.round("d", 6).alias("d"))


@query("q_chord_dissonance", f"""WITH c AS (SELECT p_partkey, [p_partkey % 200 + 106, p_partkey % 200 + 106 + p_size, p_partkey % 200 + 106 + p_size + 18] AS steps FROM part), p AS (
    SELECT p_partkey, list_transform(steps, lambda s: 440 * pow(2, s / 53.0::DOUBLE - 69 / 12.0::DOUBLE)) AS hz FROM c), {kernel_sql('p', 'p_partkey', 'hz', '1 / h::DOUBLE')}
SELECT p_partkey, round(d, 6) AS d FROM kd""")
def chord_dissonance(spark, sf_dir):
    """The dissonance of three notes for each part at their own height."""
    low = (F.col("p_partkey") % 200 + 106).cast("int")
    steps = F.array(low, low + F.col("p_size"), low + F.col("p_size") + 18)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(dissonance.dissonance_of_steps(steps), 6).alias("d"))


# --- vectors

STEPS_SQL = "[l_partkey % 53, l_suppkey * 7 % 53, l_orderkey * 3 % 53, l_linenumber * 11 % 53]"


def steps_of_lines():
    return F.array(F.col("l_partkey") % 53, F.col("l_suppkey") * 7 % 53, F.col("l_orderkey") * 3 % 53, (F.col("l_linenumber") * 11 % 53).cast("bigint"))


SIGNS_SQL = {n: "CASE {0} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in signs.items()) + " ELSE '–' END" for n, signs in (("third", dims.THIRD_SIGNS), ("fifth", dims.FIFTH_SIGNS), ("seventh", dims.SEVENTH_SIGNS))}
GRIDS_SQL = "(SELECT arg_min(g, (abs(g - {0}), g)) FROM unnest({1}) AS u(g))"


@query("q_chord_labels", f"""WITH p AS (SELECT DISTINCT list_sort(list_distinct(list_filter({STEPS_SQL}, lambda x: x <> 0))) AS iv FROM lineitem), z AS (SELECT iv, list_min(list_filter(iv, lambda x: x BETWEEN 10 AND 22)) AS t, list_min(list_filter(iv, lambda x: x BETWEEN 24 AND 35)) AS f, list_min(list_filter(iv, lambda x: x BETWEEN 42 AND 52)) AS s FROM p),
g AS (SELECT iv, t, f, s, CASE WHEN t IS NOT NULL THEN {GRIDS_SQL.format('t', dims.THIRDS)} END AS gt, coalesce(CASE WHEN f IS NOT NULL THEN {GRIDS_SQL.format('f', dims.FIFTHS)} END, 31) AS gf, CASE WHEN s IS NOT NULL THEN {GRIDS_SQL.format('s', dims.SEVENTHS)} END AS gs FROM z)
SELECT array_to_string(iv, ' ') AS intervals, {SIGNS_SQL['third'].format('gt')} || '-' || {SIGNS_SQL['fifth'].format('gf')} || '-' || {SIGNS_SQL['seventh'].format('gs')} AS label,
    array_to_string(list_filter(iv, lambda x: x IS DISTINCT FROM t AND x IS DISTINCT FROM f AND x IS DISTINCT FROM s), ' ') AS extras FROM g""")
def chord_labels(spark, sf_dir):
    """Signs and further notes of all different sets of intervals of the lines."""
    rows = table(spark, sf_dir, "lineitem").select(music.intervals(steps_of_lines(), F.lit(0)).alias("iv")).distinct()
    rows = rows.withColumn("tones", music.chord_tones(F.col("iv")))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return rows.select(text(F.col("iv")).alias("intervals"), music.chord_label(F.col("tones")).alias("label"), text(music.extra_intervals(F.col("iv"))).alias("extras"))


@query("q_chord_vectors", f"""WITH {DIM_SQL}, names AS (SELECT * FROM {dims.values_sql([(n, i) for n, i in {n: i for i, n in enumerate(dims.NOTE_NAMES)}.items()], 'name, pc')}),
o AS (SELECT l_orderkey, list_sort(list(106 + l_partkey % 319)) AS steps FROM lineitem GROUP BY 1), r AS (SELECT o.*, coalesce(pc, steps[1] % 53) AS root FROM o LEFT JOIN names ON name = (['C', '^C', 'vD', 'F#', 'H', 'Bb'])[(l_orderkey % 6 + 1)::INTEGER]),
v AS (SELECT l_orderkey, list_distinct(list_filter(list_transform(steps, lambda s: ((s - root) % 53 + 53) % 53), lambda x: x <> 0)) AS iv FROM r), z AS (SELECT l_orderkey, list_min(list_filter(iv, lambda x: x BETWEEN 10 AND 22)) AS t, list_min(list_filter(iv, lambda x: x BETWEEN 24 AND 35)) AS f, list_min(list_filter(iv, lambda x: x BETWEEN 42 AND 52)) AS s FROM v),
g AS (SELECT l_orderkey, CASE WHEN t IS NOT NULL THEN {GRIDS_SQL.format('t', dims.THIRDS)} END AS third, coalesce(CASE WHEN f IS NOT NULL THEN {GRIDS_SQL.format('f', dims.FIFTHS)} END, 31) AS fifth, CASE WHEN s IS NOT NULL THEN {GRIDS_SQL.format('s', dims.SEVENTHS)} END AS seventh FROM z)
SELECT l_orderkey, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(gamma, 6) AS gamma, round(d, 5) AS d FROM g JOIN dim ON g.third IS NOT DISTINCT FROM dim.third AND g.fifth = dim.fifth AND g.seventh IS NOT DISTINCT FROM dim.seventh""")
def chord_vectors(spark, sf_dir):
    """An order's notes above its named root, or above the lowest where the root has no known name."""
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list((F.col("l_partkey") % 319 + 106).cast("int"))).alias("steps"))
    root = F.element_at(F.array(*[F.lit(n) for n in ("C", "^C", "vD", "F#", "H", "Bb")]), (F.col("l_orderkey") % 6 + 1).cast("int"))
    symbols = orders.select("l_orderkey", F.lit(0).alias("chord_idx"), root.alias("root"))
    made, _ = streams.sidecar_vectors(symbols, orders.withColumn("chord_idx", F.lit(0)), ["l_orderkey"], dims.note_table(spark), dissonance.dissonance_dim(spark))
    return made.select("l_orderkey", *[F.round(c, 6).alias(c) for c in ("alpha", "beta", "gamma")], F.round("d", 5).alias("d"))


REFERENCE_SQL = dims.values_sql([(i, n, a, b, g) for i, (n, a, b, g) in enumerate(dissonance.reference_chords()) if a <= b <= g], "nth, name, ra, rb, rg")


@query("q_named_chords", f"""WITH c AS (SELECT p_partkey, [p_partkey % 100 + 150, p_partkey % 100 + 150 + p_partkey % 23, p_partkey % 100 + 150 + p_size, p_partkey % 100 + 150 + p_partkey % 53] AS steps FROM part), b AS (SELECT *, list_min(steps) AS root FROM c),
v AS (SELECT p_partkey, root, list_sort(list_distinct(list_filter(list_transform(steps, lambda s: ((s - root) % 53 + 53) % 53), lambda x: x <> 0))) AS iv FROM b), z AS (SELECT *, list_min(list_filter(iv, lambda x: x BETWEEN 10 AND 22)) AS t, list_min(list_filter(iv, lambda x: x BETWEEN 24 AND 35)) AS f, list_min(list_filter(iv, lambda x: x BETWEEN 42 AND 52)) AS s FROM v),
g AS (SELECT p_partkey, root, CASE WHEN t IS NOT NULL THEN {GRIDS_SQL.format('t', dims.THIRDS)} END AS third, coalesce(CASE WHEN f IS NOT NULL THEN {GRIDS_SQL.format('f', dims.FIFTHS)} END, 31) AS fifth, CASE WHEN s IS NOT NULL THEN {GRIDS_SQL.format('s', dims.SEVENTHS)} END AS seventh FROM z),
q AS (SELECT *, coalesce(pow(2, third / 53.0::DOUBLE), 1.0) AS alpha, pow(2, fifth / 53.0::DOUBLE) AS beta, pow(2, coalesce(seventh, fifth) / 53.0::DOUBLE) AS gamma, 440 * pow(2, root / 53.0::DOUBLE - 69 / 12.0::DOUBLE) AS hz0 FROM g), p AS (SELECT p_partkey, [hz0, hz0 * alpha, hz0 * beta, hz0 * gamma] AS hz FROM q), {kernel_sql('p', 'p_partkey', 'hz')},
n AS (SELECT p_partkey, arg_min(name, (round((alpha - ra) ** 2 + (beta - rb) ** 2 + (gamma - rg) ** 2, 12), nth)) AS name FROM q, (SELECT * FROM {REFERENCE_SQL}) r GROUP BY 1)
SELECT p_partkey, n.name AS matched_name, round(kd.d, 5) AS d_root, alpha <= beta AND beta <= gamma AS in_tetrahedron, q.seventh IS NULL AS is_triad FROM q JOIN n USING (p_partkey) JOIN kd USING (p_partkey)""")
def named_chords(spark, sf_dir):
    """Chords of all parts with their dissonance at the root and the nearest reference chord."""
    low = (F.col("p_partkey") % 100 + 150).cast("int")
    steps = F.array(low, low + (F.col("p_partkey") % 23).cast("int"), low + F.col("p_size").cast("int"), low + (F.col("p_partkey") % 53).cast("int"))
    made = streams.named_chords(spark, table(spark, sf_dir, "part").select("p_partkey", steps.alias("steps")), "steps")
    return made.select("p_partkey", "matched_name", F.round("d_root", 5).alias("d_root"), "in_tetrahedron", "is_triad")


@query("q_reference_chords", "SELECT s.system, count(*) AS n, count(*) FILTER (alpha <= beta AND beta <= gamma) AS inside, round(avg(1200 * log2(gamma)), 6) AS gamma_cents FROM (SELECT '53-TET' AS system, * FROM {a} UNION ALL SELECT '12-TET', * FROM {b}) s GROUP BY 1".format(
    a=dims.values_sql([(2 ** (t / 53), 2 ** (f / 53), 2 ** (s / 53)) for t, f, s in [*[(t, 31, s) for t in range(11, 21) for s in range(42, 52)], *[(t, 26, s) for t in range(11, 15) for s in range(42, 52)], *[(t, 35, s) for t in (18, 20, 22) for s in range(42, 52)], (22, 31, 44), (9, 22, 31), *[(t, 31, 31) for t in (*range(11, 21), 22)], *[(t, 26, 26) for t in range(11, 15)], *[(t, 35, 35) for t in (18, 20, 22)]]], "alpha, beta, gamma"),
    b=dims.values_sql([(2 ** (a / 12), 2 ** (b / 12), 2 ** (c / 12)) for a, b, c in ((4, 7, 11), (3, 7, 10), (4, 7, 10), (3, 7, 11), (3, 6, 10), (3, 6, 9), (4, 8, 10), (4, 8, 11), (5, 7, 10), (2, 5, 7))], "alpha, beta, gamma"),
))
def reference_chords(spark, sf_dir):
    """How many reference chords there are and how their sevenths lie."""
    rows = dissonance.reference_table(spark)
    return rows.groupBy("system").agg(F.count("*").alias("n"), F.count_if("in_tetrahedron").alias("inside"), F.round(F.avg("gamma_cents"), 6).alias("gamma_cents"))


# --- retuning

PATTERNS = {"pythagorean": [9, 9, 4, 9, 9, 9, 4], "just": [9, 8, 5, 9, 8, 9, 5], "even": [8, 8, 6, 8, 8, 8, 7], "wide": [10, 9, 3, 9, 10, 9, 3]}
PATTERN_SQL = "pat AS (SELECT * FROM {rows}), white AS (SELECT name, p, [0, p[1], p[1] + p[2], p[1] + p[2] + p[3], p[1] + p[2] + p[3] + p[4], p[1] + p[2] + p[3] + p[4] + p[5], p[1] + p[2] + p[3] + p[4] + p[5] + p[6]] AS w FROM pat), steps AS (SELECT name, [w[1], w[1] + round_even(p[1] * 0.5, 0), w[2], w[2] + round_even(p[2] * 0.5, 0), w[3], w[4], w[4] + round_even(p[4] * 0.5, 0), w[5], w[5] + round_even(p[5] * 0.5, 0), w[6], w[6] + round_even(p[6] * 0.5, 0), w[7]] AS st FROM white)".format(
    rows="(VALUES " + ", ".join(f"('{n}', {p})" for n, p in PATTERNS.items()) + ") AS v(name, p)"
)


@query("q_cents_table", f"""WITH {PATTERN_SQL}, c AS (SELECT name, pc, round(st[pc + 1] * 1200 / 53.0::DOUBLE - pc * 100, 1) AS cents FROM steps, (SELECT unnest(range(0, 12)) AS pc)), n AS (SELECT (p_partkey % 12)::INTEGER AS pc, count(*) AS n FROM part GROUP BY 1)
SELECT n.pc, n.n, {', '.join(f"max(cents) FILTER (name = '{k}') AS {k}" for k in PATTERNS)} FROM c JOIN n USING (pc) GROUP BY 1, 2""")
def cents_table(spark, sf_dir):
    """Cents from the semitones for each pitch class and pattern, and how many parts have that pitch class."""
    made = retune.cents_table(retune.pattern_table(spark, PATTERNS), list(PATTERNS))
    counted = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 12).cast("int").alias("pc")).agg(F.count("*").alias("n"))
    return counted.join(made, "pc").select("pc", "n", *PATTERNS)


@query("q_pattern_report", """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN [9, 9, 4, 9, 9, 9, 4] WHEN p_partkey % 3 = 1 THEN [9, 9, 4, 9, 9, 9, p_size] ELSE [53] END AS p FROM part), o AS (SELECT *, len(p) = 7 AND list_sum(p) = 53 AS ok FROM p)
SELECT p_partkey, ok, (53 - list_sum(p))::INTEGER AS missing, nth, (['C-D', 'D-E', 'E-F', 'F-G', 'G-A', 'A-B', 'B-C'])[nth + 1] AS "interval", p[nth + 1]::INTEGER AS steps, round(p[nth + 1] * 1200 / 53.0::DOUBLE, 1) AS cents FROM o, (SELECT unnest(range(0, 7))::INTEGER AS nth) WHERE ok
UNION ALL SELECT p_partkey, ok, (53 - list_sum(p))::INTEGER, NULL, NULL, NULL, NULL FROM o WHERE NOT ok""")
def pattern_report(spark, sf_dir):
    """Patterns of all parts, of which some don't fill the octave."""
    ints = lambda *v: F.array(*[x if not isinstance(x, int) else F.lit(x) for x in v])
    p = F.when(F.col("p_partkey") % 3 == 0, ints(9, 9, 4, 9, 9, 9, 4)).when(F.col("p_partkey") % 3 == 1, ints(9, 9, 4, 9, 9, 9, F.col("p_size").cast("int"))).otherwise(ints(53))
    return retune.pattern_report(table(spark, sf_dir, "part").select("p_partkey", p.alias("p")), "p", ["p_partkey"])


MESSAGE_SQL = """m AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, (epoch_us(ts) // 1000) AS tick, CASE event_type WHEN 'click' THEN 'on' WHEN 'view' THEN 'off' WHEN 'error' THEN 'bend' ELSE 'other' END AS type,
    (event_id % 16)::INTEGER AS channel, (event_id % 5 + 60)::INTEGER AS note, (event_id % 127 + 1)::INTEGER AS velocity FROM events)"""


def messages(spark, sf_dir):
    """Events as messages of five notes: users are files."""
    kind = F.when(F.col("event_type") == "click", "on").when(F.col("event_type") == "view", "off").when(F.col("event_type") == "error", "bend").otherwise("other")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.expr("unix_millis(CAST(ts AS TIMESTAMP))").alias("tick"), kind.alias("type"), (F.col("event_id") % 16).cast("int").alias("channel"), (F.col("event_id") % 5 + 60).cast("int").alias("note"), (F.col("event_id") % 127 + 1).cast("int").alias("velocity"))
    return rows.withColumn("seq", F.row_number().over(sequence.ordered(["user_id"], ["ts", "event_id"])).cast("long")).drop("ts")


GOLDEN_SCALE = dims.chromatic_scale("type_2_minor", 3)
OWN_CHANNEL_SQL = """t AS (SELECT *, (sum((type = 'on')::INT) OVER (PARTITION BY user_id ORDER BY seq) - 1) % 15 + 1 AS turn FROM m), w AS (
    SELECT *, CASE WHEN type = 'on' THEN turn WHEN type = 'off' THEN coalesce(lag(CASE WHEN type = 'on' THEN turn END) OVER (PARTITION BY user_id, {note}, type IN ('on', 'off') ORDER BY seq), channel) ELSE channel END::INTEGER AS own FROM t)"""


@query("q_retuned_messages", f"""WITH {MESSAGE_SQL}, {OWN_CHANNEL_SQL.format(note='note')}, b AS (SELECT *, ({list(GOLDEN_SCALE)})[(note % 12) + 1] - (note % 12) * 53 / 12.0::DOUBLE AS off FROM w),
c AS (SELECT *, least(greatest(trunc(round((CASE WHEN off > 26.5 THEN off - 53 WHEN off < -26.5 THEN off + 53 ELSE off END) * 1200 / 53 / 200 * 8192, 9))::INTEGER, -8192), 8191) AS bend FROM b),
o AS (SELECT user_id, seq, tick, unnest(CASE WHEN type = 'on' AND bend <> 0 THEN [{{'type': 'bend', 'channel': own, 'note': NULL, 'value': bend}}, {{'type': 'on', 'channel': own, 'note': note, 'value': velocity}}] WHEN type = 'on' THEN [{{'type': 'on', 'channel': own, 'note': note, 'value': velocity}}]
    WHEN type = 'off' THEN [{{'type': 'off', 'channel': own, 'note': note, 'value': velocity}}, {{'type': 'bend', 'channel': own, 'note': NULL, 'value': 0}}] ELSE [{{'type': type, 'channel': channel, 'note': note, 'value': velocity}}] END) AS x FROM c)
SELECT user_id, seq, tick, x.type AS type, x.channel AS channel, x.note AS note, x.value AS value FROM o""")
def retuned_messages(spark, sf_dir):
    """All messages retuned by a scale: channels in turn, bends before notes and back after them."""
    step = F.element_at(F.array(*[F.lit(s) for s in GOLDEN_SCALE]), F.col("note") % 12 + 1)
    made = retune.retuned_by_scale(messages(spark, sf_dir), ["user_id"], ["seq"], step)
    return made.select("user_id", "seq", "tick", "type", "channel", "note", "value")


@query("q_pattern_messages", f"""WITH {MESSAGE_SQL.replace('m AS (', 'm0 AS (', 1)}, d AS (SELECT *, tick - coalesce(lag(tick) OVER (PARTITION BY user_id ORDER BY seq), 0) AS delta FROM m0), l AS (SELECT * EXCLUDE (delta, tick), tick - sum(CASE WHEN type = 'bend' THEN delta ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq) AS tick FROM d),
m AS (SELECT * FROM l WHERE type <> 'bend'), {OWN_CHANNEL_SQL.format(note='channel, note')}, pp AS (SELECT unnest(['pythagorean', 'wide']) AS pattern), {PATTERN_SQL},
c AS (SELECT w.*, pattern, (st[note % 12 + 1] * 1200 / 53.0::DOUBLE - note % 12 * 100) / 200 AS share FROM w, pp JOIN steps ON steps.name = pattern),
b AS (SELECT *, trunc(CASE WHEN share >= 0 THEN least(share, 1) * 8191 ELSE greatest(share, -1) * 8192 END)::INTEGER AS bend FROM c)
SELECT pattern, user_id, seq, tick::BIGINT AS tick, unnest(CASE WHEN type = 'on' THEN ['bend:' || own || ':' || bend, 'on:' || own || ':' || velocity] WHEN type = 'off' THEN ['off:' || own || ':' || velocity] ELSE [type || ':' || channel || ':' || velocity] END) AS message FROM b""")
def pattern_messages(spark, sf_dir):
    """All files by two patterns; source bends go, with the time that their deltas held."""
    patterns = retune.pattern_table(spark, {k: PATTERNS[k] for k in ("pythagorean", "wide")})
    rows = messages(spark, sf_dir).withColumn("track", F.lit(0))
    made = retune.all_patterns(rows, patterns, "user_id", ["track", "seq"])
    return made.select("pattern", "user_id", "seq", "tick", F.concat_ws(":", "type", F.col("channel").cast("string"), F.col("value").cast("string")).alias("message"))


@query("q_bend_errors", f"""WITH {MESSAGE_SQL.replace('AS velocity FROM', 'AS velocity, (event_id % 400 - 200)::INTEGER AS value FROM')}, c AS (SELECT *, coalesce(sum((type = 'on')::INT) OVER (PARTITION BY user_id, channel ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM m),
b AS (SELECT *, coalesce(last_value(CASE WHEN type = 'bend' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id, channel, run ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS now FROM c),
e AS (SELECT *, abs(now - least(greatest(trunc(round((({list(GOLDEN_SCALE)})[(note % 12) + 1] - (note % 12) * 53 / 12.0::DOUBLE) * 1200 / 53 / 200 * 8192, 9))::INTEGER, -8192), 8191)) AS err FROM b)
SELECT user_id, count(*) FILTER (type = 'on') AS n, count(*) FILTER (type = 'on' AND err > 1) AS mismatches, round(max(err) FILTER (type = 'on') / 8192.0::DOUBLE * 200, 6) AS most_cents, count(*) FILTER (type = 'on') AS n_on, count(*) FILTER (type = 'off') AS n_off, count(DISTINCT channel) FILTER (type = 'on') AS channels FROM e GROUP BY 1""")
def bend_errors(spark, sf_dir):
    """Bends before notes against those of a scale."""
    step = F.element_at(F.array(*[F.lit(s) for s in GOLDEN_SCALE]), F.col("note") % 12 + 1)
    return retune.bend_errors(messages(spark, sf_dir).withColumn("value", (F.col("event_id") % 400 - 200).cast("int")), ["user_id"], ["seq"], step)


@query("q_message_counts", f"WITH {MESSAGE_SQL} SELECT user_id, type, count(*) AS n, count(DISTINCT CASE WHEN type = 'bend' THEN velocity END) AS bends, min(CASE WHEN type = 'bend' THEN velocity END) AS lowest, max(CASE WHEN type = 'bend' THEN velocity END) AS highest FROM m GROUP BY 1, 2")
def message_counts(spark, sf_dir):
    return retune.message_counts(messages(spark, sf_dir).withColumn("value", F.col("velocity")), ["user_id"])


@query("q_stuck_files", f"""WITH {MESSAGE_SQL}, l AS (SELECT user_id, note, arg_max(type, seq) AS last FROM m WHERE type IN ('on', 'off') GROUP BY 1, 2), f AS (SELECT user_id, bool_or(last = 'on') AS stuck FROM l GROUP BY 1), s AS (SELECT count(*) AS files, count(*) FILTER (stuck) AS stuck, round(count(*) FILTER (stuck) * 100.0::DOUBLE / count(*), 6) AS pct FROM f)
SELECT *, floor(pct / 100 * 5000)::BIGINT AS estimate FROM s""")
def stuck_files(spark, sf_dir):
    """Files with notes that never end, and what that is of five thousand."""
    return retune.extrapolated(retune.stuck_files(messages(spark, sf_dir), ["user_id"], ["note"], ["seq"]), 5000)


@query("q_missing_ends", f"""WITH {MESSAGE_SQL}, o AS (SELECT a.user_id, a.seq, min(b.tick) AS onset FROM m a LEFT JOIN m b ON b.user_id = a.user_id AND b.type = 'on' AND b.tick >= a.tick + 3600001 GROUP BY 1, 2),
n AS (SELECT m.*, o.onset, lead(type) OVER w AS nt, lead(tick) OVER w AS nk FROM m JOIN o USING (user_id, seq) WHERE type IN ('on', 'off') WINDOW w AS (PARTITION BY user_id, note ORDER BY seq)), z AS (SELECT user_id, max(tick) AS last FROM m GROUP BY 1)
SELECT user_id, note, least(nk, onset) AS tick, 'taken over' AS reason FROM n WHERE type = 'on' AND nt = 'on' UNION ALL SELECT user_id, note, coalesce(onset, last), 'no end' FROM n JOIN z USING (user_id) WHERE type = 'on' AND nt IS NULL""")
def missing_ends(spark, sf_dir):
    """Where notes that are taken over or never end are closed: within an hour of the next onset."""
    return recurrent.close_stuck_notes(messages(spark, sf_dir), ["user_id"], ["note"], ["seq"], tolerance=3600000)


# --- relabelling

QUALITY_LIST = ["maj7", "m", "dom7", "ø7", "power", "unknown", ""]
CHART_SQL = f"""{LINES_SQL}, ch AS (SELECT l_orderkey, pos, ({dims.TONICS})[(l_partkey % {len(dims.TONICS)} + 1)::INTEGER] AS root, ({QUALITY_LIST})[(l_suppkey % {len(QUALITY_LIST)} + 1)::INTEGER] AS quality, CASE WHEN l_partkey % 4 = 0 THEN ({dims.TONICS})[(l_suppkey % {len(dims.TONICS)} + 1)::INTEGER] END AS bass FROM lines)"""


def charts(spark, sf_dir):
    """Orders as charts (l_orderkey, toks, type, tonic): a dot, a duration, a root, a quality and a bass for each line."""
    pick = lambda values, c: F.element_at(F.array(*[F.lit(v) for v in values]), (c % len(values) + 1).cast("int"))

    def toks(col):
        bass = F.when(col("l_partkey") % 4 == 0, F.array(F.lit("/"), pick(dims.TONICS, col("l_suppkey")))).otherwise(F.array().cast("array<string>"))
        return F.filter(F.concat(F.array(F.lit("."), F.lit("4.0"), pick(dims.TONICS, col("l_partkey")), pick(QUALITY_LIST, col("l_suppkey"))), bass, F.array(F.lit("|"))), lambda t: t != "")

    kind = F.element_at(F.array(*[F.lit(k) for k in dims.SCALES]), (F.col("l_orderkey") % 14 + 1).cast("int"))
    return songs(spark, sf_dir, toks).select("l_orderkey", "toks", kind.alias("type"), (F.col("l_orderkey") % 12).cast("int").alias("tonic"))


PC_SQL = "(([0, 1, 1, 2, 3, 3, 4, 5, 6, 6, 7, 8, 8, 9, 10, 10, 11])[list_position({names}, {{0}})])".format(names=dims.TONICS)
NAMES_SQL = f"""sc AS (SELECT type, tonic, pc, step FROM {SCALE_ROWS_SQL}), nn AS (SELECT * FROM {dims.values_sql(list(enumerate(dims.NOTE_NAMES)), 'step, name')}), sem AS (SELECT * FROM {dims.values_sql(list(dims.SEMANTIC_STEPS.items()), 'step, name')}),
kn AS (SELECT * FROM {dims.values_sql([(*k, n) for k, n in dims.chord_names().items()], 'third, fifth, seventh, name')}), t3 AS (SELECT * FROM {dims.values_sql(list(dims.THIRD_PREFIXES.items()), 'q, name')}), t5 AS (SELECT * FROM {dims.values_sql(list(dims.FIFTH_SUFFIXES.items()), 'q, name')}), t7 AS (SELECT * FROM {dims.values_sql(list(dims.SEVENTH_SUFFIXES.items()), 'q, name')})"""


def named_sql(source: str) -> str:
    """CTEs that name chords of ``source`` (type, tonic, pc, i3, i5, i7 in semitones or null): ``named`` adds root_name and cn."""
    step = lambda i: f"(((SELECT step FROM sc s WHERE s.type = x.type AND s.tonic = x.tonic AND s.pc = (x.pc + {i}) % 12) - r.step) % 53 + 53) % 53"
    return f"""st AS (SELECT x.*, r.step AS rs, CASE WHEN i3 IS NOT NULL THEN {step('i3')} END AS s3, CASE WHEN i5 IS NOT NULL THEN {step('i5')} END AS s5, CASE WHEN i7 IS NOT NULL THEN {step('i7')} END AS s7 FROM {source} x JOIN sc r ON r.type = x.type AND r.tonic = x.tonic AND r.pc = x.pc),
qn AS (SELECT st.*, a.name AS q3, b.name AS q5, c.name AS q7, nn.name AS root_name FROM st LEFT JOIN sem a ON a.step = s3 LEFT JOIN sem b ON b.step = s5 LEFT JOIN sem c ON c.step = s7 JOIN nn ON nn.step = rs),
pn AS (SELECT qn.*, kn.name AS known, coalesce(t3.name, '(' || coalesce(q3, 'None') || ')') AS base, CASE WHEN q5 IS NULL THEN '' ELSE coalesce(t5.name, '(' || q5 || ')') END AS middle, coalesce(t7.name, '') AS plain FROM qn
    LEFT JOIN kn ON kn.third = q3 AND kn.fifth = CASE WHEN q5 = 'diminished-fifth' THEN 'diminished' ELSE q5 END AND kn.seventh IS NOT DISTINCT FROM replace(q7, '-', '') LEFT JOIN t3 ON t3.q = q3 LEFT JOIN t5 ON t5.q = q5 LEFT JOIN t7 ON t7.q = q7),
named AS (SELECT *, coalesce(known, CASE WHEN q7 = 'diminished-seventh' AND base = 'm' AND q5 IN ('diminished', 'diminished-fifth') THEN 'dim7' ELSE base || middle || CASE WHEN q7 IS NULL THEN '' WHEN q7 = 'minor' THEN CASE WHEN q3 = 'major' OR base LIKE '%m' THEN '7' ELSE 'm7' END
    WHEN q7 = 'diminished-seventh' AND (contains(middle, 'dim') OR middle = '(b5)') THEN '7' WHEN q7 = 'diminished-seventh' AND middle = '' THEN 'dim7' ELSE plain END END) AS cn FROM pn)"""


TYPES_SQL = str(list(dims.SCALES))


@query("q_relabelled", f"""WITH {CHART_SQL}, {NAMES_SQL}, src AS (SELECT DISTINCT ({TYPES_SQL})[(l_orderkey % 14 + 1)::INTEGER] AS type, (l_orderkey % 12)::INTEGER AS tonic, {PC_SQL.format('root')} AS pc, quality,
    CASE quality WHEN 'm' THEN 3 WHEN 'ø7' THEN 3 WHEN 'power' THEN NULL ELSE 4 END AS i3, CASE quality WHEN 'ø7' THEN 6 ELSE 7 END AS i5, CASE quality WHEN 'maj7' THEN 11 WHEN 'dom7' THEN 10 WHEN 'ø7' THEN 10 END AS i7 FROM ch), {named_sql('src')},
j AS (SELECT ch.*, n.root_name, n.cn, b.name AS bass_name FROM ch JOIN named n ON n.type = ({TYPES_SQL})[(l_orderkey % 14 + 1)::INTEGER] AND n.tonic = l_orderkey % 12 AND n.pc = {PC_SQL.format('root')} AND n.quality = ch.quality
    LEFT JOIN sc ON sc.type = ({TYPES_SQL})[(l_orderkey % 14 + 1)::INTEGER] AND sc.tonic = l_orderkey % 12 AND sc.pc = {PC_SQL.format('bass')} LEFT JOIN nn b ON b.step = sc.step)
SELECT l_orderkey, string_agg('. 4.0 ' || root_name || CASE WHEN cn <> '' THEN ' ' || cn WHEN quality <> '' THEN ' ' || quality ELSE '' END || coalesce(' / ' || bass_name, '') || ' |', ' ' ORDER BY pos) AS chart FROM j GROUP BY 1""")
def relabelled(spark, sf_dir):
    """Charts of all orders relabelled by their type and key, each as one line."""
    made = relabel.relabelled_of(charts(spark, sf_dir), ["l_orderkey"], relabel.name_dim(spark))
    return made.select("l_orderkey", F.array_join("toks", " ").alias("chart"))


def as_lines(df):
    return df.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda r: r["tok"]), " ").alias("chart"))


@query("q_relabelled_by_text", f"""WITH {CHART_SQL}, {NAMES_SQL.replace("sem AS (SELECT * FROM", "sem0 AS (SELECT * FROM", 1).replace("kn AS (", "sem AS (SELECT i.i AS step, coalesce(sem0.name, 'step' || i.i) AS name FROM (SELECT unnest(range(0, 53)) AS i) i LEFT JOIN sem0 ON sem0.step = i.i), kn AS (", 1)},
src AS (SELECT DISTINCT ({TYPES_SQL})[(l_orderkey % 14 + 1)::INTEGER] AS type, (l_orderkey % 12)::INTEGER AS tonic, {PC_SQL.format('root')} AS pc, quality,
    CASE quality WHEN 'm' THEN 3 WHEN 'ø7' THEN 3 ELSE 4 END AS i3, CASE quality WHEN 'ø7' THEN 6 ELSE 7 END AS i5, CASE quality WHEN 'maj7' THEN 11 WHEN 'dom7' THEN 10 WHEN 'ø7' THEN 10 END AS i7 FROM ch), {named_sql('src')},
j AS (SELECT ch.*, n.root_name, n.cn, b.name AS bass_name FROM ch JOIN named n ON n.type = ({TYPES_SQL})[(l_orderkey % 14 + 1)::INTEGER] AND n.tonic = l_orderkey % 12 AND n.pc = {PC_SQL.format('root')} AND n.quality = ch.quality
    LEFT JOIN sc ON sc.type = ({TYPES_SQL})[(l_orderkey % 14 + 1)::INTEGER] AND sc.tonic = l_orderkey % 12 AND sc.pc = {PC_SQL.format('bass')} LEFT JOIN nn b ON b.step = sc.step)
SELECT l_orderkey, string_agg('. 4.0 ' || root_name || ' ' || cn || coalesce(' / ' || bass_name, '') || ' |', ' ' ORDER BY pos) AS chart FROM j GROUP BY 1""")
def relabelled_by_text(spark, sf_dir):
    """The same by the older rule."""
    made = relabel.relabelled_by_text_of(charts(spark, sf_dir), ["l_orderkey"], relabel.name_dim(spark, unnamed=True))
    return made.select("l_orderkey", F.array_join("toks", " ").alias("chart"))


@query("q_corpus_pairs", """WITH f AS (SELECT page_id, CASE WHEN page_id % 5 = 4 THEN 'odd_' || page_id ELSE page_id || '_Song ' || (page_id % 3) || '_Db_major_type_' || (page_id % 7) || '_major' END AS stem FROM pages)
SELECT CASE WHEN page_id % 5 = 4 THEN 'bad_stem' WHEN page_id % 5 = 3 THEN 'missing_text' WHEN page_id % 5 = 2 THEN 'bad_text' ELSE 'written' END AS status, count(*) AS n FROM f GROUP BY 1""")
def corpus_pairs(spark, sf_dir):
    """Files of all pages with their texts, some of which are missing or unreadable."""
    n = F.col("page_id")
    base = F.concat(n.cast("string"), F.lit("_Song "), (n % 3).cast("string"), F.lit("_Db_major"))
    rows = table(spark, sf_dir, "pages").select("page_id")
    files = rows.select(F.when(n % 5 == 4, F.concat(F.lit("odd_"), n.cast("string"))).otherwise(F.concat(base, F.lit("_type_"), (n % 7).cast("string"), F.lit("_major"))).alias("stem"))
    texts = rows.where(n % 5 != 3).select(base.alias("base"), F.when(n % 5 != 2, F.array(F.lit("C"))).alias("tokens"))
    return relabel.pair_corpus(files, texts)[1]


SPELL_SQL = dims.values_sql([(n, spelling.spelled_scale(n, "minor")[0], spelling.spelled_scale(n, "major")[0]) for n in spelling.LINE], "note, minor, major")
LINE_SQL = "['" + "','".join(spelling.LINE) + "']"


@query("q_transposed_charts", f"""WITH {LINES_SQL}, c AS (SELECT l_orderkey, pos, ({spelling.NOTES})[(l_partkey % 20 + 1)::INTEGER] AS note, (['maj7', 'dom7', 'ø7'])[(l_suppkey % 3 + 1)::INTEGER] AS quality, list_position({LINE_SQL}, (['C', 'Eb', 'B'])[(l_orderkey % 3 + 1)::INTEGER]) - 16 AS shift FROM lines),
m AS (SELECT *, list_position({LINE_SQL}, note) AS p, ({LINE_SQL})[(((list_position({LINE_SQL}, note) - 1 + shift) % 35 + 35) % 35 + 1)::INTEGER] AS raw FROM c), s AS (SELECT m.*, CASE WHEN quality = 'maj7' THEN sp.minor ELSE raw END AS new FROM m JOIN (SELECT * FROM {SPELL_SQL}) sp ON sp.note = raw),
n AS (SELECT *, lead(p) OVER w - p AS step, lead(new) OVER w AS after FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY pos)), r AS (
    SELECT n.*, CASE WHEN step = -1 AND list_position({LINE_SQL}, after) - list_position({LINE_SQL}, new) = -13 THEN sp.major ELSE new END AS done FROM n LEFT JOIN (SELECT * FROM {SPELL_SQL}) sp ON sp.note = ({LINE_SQL})[(list_position({LINE_SQL}, after) % 35 + 1)::INTEGER])
SELECT l_orderkey, string_agg('. ' || done || ' ' || quality, ' ' ORDER BY pos) AS chart FROM r GROUP BY 1""")
def transposed_charts(spark, sf_dir):
    """Charts of all orders from C to the keys of three, with their notes respelled."""
    pick = lambda values, c: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(c) % len(values) + 1).cast("int"))
    toks = F.array(F.lit("."), pick(spelling.NOTES, "l_partkey"), pick(["maj7", "dom7", "ø7"], "l_suppkey"))
    rows = lines(spark, sf_dir).select("l_orderkey", F.col("pos").alias("line"), F.posexplode(toks).alias("at", "tok"))
    placed = rows.select("l_orderkey", (F.col("line") * 3 + F.col("at")).alias("pos"), "tok", F.lit("C").alias("old_key"), pick(["C", "Eb", "B"], "l_orderkey").alias("new_key"))
    return as_lines(spelling.transposed_songs(placed, ["l_orderkey"]))


SHARPS = "(strpos('FCGDAEB', {0}) - 1)"


@query("q_scales", f"""WITH t AS (SELECT DISTINCT ({LINE_SQL})[(p_partkey % 35 + 1)::INTEGER] AS tonic FROM part), m AS (SELECT tonic, mode, o FROM t, (VALUES ('major', 16), ('minor', 19), ('dominant', 17)) v(mode, o)),
a AS (SELECT *, CASE WHEN length(tonic) = 3 THEN ({LINE_SQL})[list_position({LINE_SQL}, tonic) + CASE WHEN contains(tonic, '#') THEN -12 ELSE 12 END] ELSE tonic END AS near FROM m),
e AS (SELECT *, map({list(spelling.ENHARMONIC)}, {list(spelling.ENHARMONIC.values())})[near] AS other FROM a), k AS (SELECT *, list_position({LINE_SQL}, near) - o AS own, list_position({LINE_SQL}, other) - o AS theirs FROM e),
c AS (SELECT *, other IS NOT NULL AND (abs(own) > 7 OR (abs(theirs) <= 7 AND abs(own) > abs(theirs))) AS moved FROM k), f AS (SELECT tonic, mode, CASE WHEN moved THEN other ELSE near END AS spelled, CASE WHEN moved THEN theirs ELSE own END AS raw FROM c),
g AS (SELECT *, CASE WHEN abs(raw) <= 7 THEN raw ELSE 0 END AS n FROM f), d AS (SELECT tonic, mode, spelled, nth, substr('CDEFGABCDEFGAB', strpos('CDEFGAB', substr(spelled, 1, 1)) + nth, 1) AS letter, n FROM g, (SELECT unnest(range(0, 7)) AS nth))
SELECT tonic, mode, spelled, string_agg(letter || CASE WHEN n > {SHARPS.format('letter')} THEN '#' WHEN n < 0 AND {SHARPS.format('letter')} >= 7 + n THEN 'b' ELSE '' END, ' ' ORDER BY nth) AS notes FROM d GROUP BY 1, 2, 3""")
def scales(spark, sf_dir):
    """The scales of all tonics that parts have, with the spelling that has fewer signs."""
    tonics = table(spark, sf_dir, "part").select(F.element_at(F.array(*[F.lit(n) for n in spelling.LINE]), (F.col("p_partkey") % 35 + 1).cast("int")).alias("tonic")).distinct()
    rows = tonics.join(F.broadcast(spelling.scale_table(spark)), "tonic")
    return rows.groupBy("tonic", "mode", "spelled").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "note"))), lambda r: r["note"]), " ").alias("notes"))


@query("q_axis_ranges", """SELECT CASE WHEN label % 3 = 0 THEN 'chord' ELSE 'other' END AS population, count(*) AS n, count(*) FILTER (embedding[1]::DOUBLE < -1.01 OR embedding[1]::DOUBLE > 1.01) AS outside_x, count(*) FILTER (embedding[2]::DOUBLE < -0.01 OR embedding[2]::DOUBLE > 2.01) AS outside_y FROM embeddings GROUP BY 1""")
def axis_ranges(spark, sf_dir):
    """Values that leave their ranges, by population."""
    e = table(spark, sf_dir, "embeddings").select("label", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    return quality.axis_ranges(e, F.when(F.col("label") % 3 == 0, "chord").otherwise("other"), {"x": (-1.0, 1.0), "y": (0.0, 2.0)}, 0.01)
