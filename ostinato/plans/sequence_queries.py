"""Queries of the sequence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ostinato.functions import music
from ostinato.operators import recurrent, sequence, voicing
from ostinato.plans.common import LINE_ORDER, LINES_SQL, MESSAGES_SQL, TOKENS_SQL, WORDS_SQL, line_arrays, lines, messages, query, table, token_songs, tokens, words

KEY = ["l_orderkey"]


@query("q_span_rule_b", f"""WITH {TOKENS_SQL}, spans AS (
    SELECT tok, sum(CASE WHEN tok = '.' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY pos) - 1 AS span FROM tokens
) SELECT CASE WHEN span < 0 THEN 'header' WHEN tok IN ('|', '<end>') THEN 'between' ELSE 'chord' END AS kind, count(*) AS n, sum(span)::BIGINT AS span_sum, max(span)::INTEGER AS last_span FROM spans GROUP BY 1""")
def span_rule_b(spark, sf_dir):
    spans = sequence.chord_spans(tokens(spark, sf_dir), KEY, ["pos"])
    kind = F.when(F.col("span") < 0, "header").when(F.col("tok").isin("|", "<end>"), "between").otherwise("chord")
    return spans.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("span").alias("span_sum"), F.max("span").alias("last_span"))


@query("q_chord_span", f"""WITH {TOKENS_SQL}, s AS (
    SELECT l_orderkey, pos, tok, sum((tok = 'CHORD_START')::INT) OVER (PARTITION BY l_orderkey ORDER BY pos) AS a,
        coalesce(sum((tok = 'CHORD_END')::INT) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM tokens
) SELECT l_orderkey, CASE WHEN a > b THEN a - 1 ELSE -1 END::INTEGER AS span, count(*) AS n FROM s GROUP BY 1, 2""")
def chord_span(spark, sf_dir):
    return sequence.block_spans(tokens(spark, sf_dir), KEY, ["pos"]).groupBy("l_orderkey", "span").agg(F.count("*").alias("n"))


@query("q_local_position", f"""WITH {TOKENS_SQL}, s AS (
    SELECT l_orderkey, pos, tok, sum((tok = 'CHORD_START')::INT) OVER (PARTITION BY l_orderkey ORDER BY pos) AS a,
        coalesce(sum((tok = 'CHORD_END')::INT) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
        max(CASE WHEN tok = 'CHORD_START' THEN pos END) OVER (PARTITION BY l_orderkey ORDER BY pos) AS begun FROM tokens
) SELECT CASE WHEN a > b THEN least(pos - begun, 19) ELSE 0 END::INTEGER AS local, count(*) AS n FROM s GROUP BY 1""")
def local_position(spark, sf_dir):
    return sequence.local_positions(tokens(spark, sf_dir), KEY, ["pos"]).groupBy("local").agg(F.count("*").alias("n"))


@query("q_inside_blocks", f"WITH {TOKENS_SQL} SELECT tok, count(*) AS n FROM tokens WHERE tok NOT IN ('<start>', '<end>', '|', '.') GROUP BY tok")
def inside_blocks(spark, sf_dir):
    return sequence.inside_blocks(tokens(spark, sf_dir), KEY, ["pos"]).groupBy("tok").agg(F.count("*").alias("n"))


ONSETS_SQL = f"""{LINES_SQL}, o AS (
    SELECT *, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS onset FROM lines
)"""


def with_onsets(spark, sf_dir):
    return sequence.onsets(lines(spark, sf_dir), KEY, ["pos"], "l_quantity")


@query("q_onset_running_sum", f"WITH {ONSETS_SQL} SELECT l_orderkey, pos, onset FROM o")
def onset_running_sum(spark, sf_dir):
    return with_onsets(spark, sf_dir).select("l_orderkey", "pos", "onset")


@query("q_bar_emission", f"""WITH {ONSETS_SQL}, b AS (
    SELECT l_orderkey, pos, floor(onset / 4)::INTEGER AS bar, max(floor(onset / 4)::INTEGER) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM o
) SELECT l_orderkey, pos, unnest(range(last + 1, bar + 1))::INTEGER AS bar FROM b WHERE bar > last""")
def bar_emission(spark, sf_dir):
    return sequence.bar_lines(with_onsets(spark, sf_dir), KEY, ["pos"], "onset").select("l_orderkey", "pos", "bar")


@query("q_bar_numbers", f"""WITH {TOKENS_SQL}, n AS (SELECT l_orderkey, tok, sum((tok = '|')::INT) OVER (PARTITION BY l_orderkey ORDER BY pos) AS bar FROM tokens)
SELECT l_orderkey, max(bar)::BIGINT AS bars, count(*) FILTER (tok = 'CHORD_START') AS chords FROM n GROUP BY 1""")
def bar_numbers(spark, sf_dir):
    counted = sequence.running_count(tokens(spark, sf_dir), KEY, ["pos"], F.col("tok") == "|", "bar")
    return counted.groupBy("l_orderkey").agg(F.max("bar").alias("bars"), F.count_if(F.col("tok") == "CHORD_START").alias("chords"))


EVENT_GAPS_SQL = "g AS (SELECT *, lead((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - (epoch_us(ts) // 1000) AS gap FROM events)"


def event_times(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("tick", F.expr("unix_millis(CAST(ts AS TIMESTAMP))"))


@query("q_harmonic_rhythm", f"""WITH {EVENT_GAPS_SQL}, r AS (SELECT CASE WHEN gap IS NULL THEN value ELSE greatest(gap / 3600000.0::DOUBLE, 0.5::DOUBLE) END AS rhythm FROM g)
SELECT CASE WHEN rhythm <= 0 THEN 0.5 WHEN rhythm <= 0.75 THEN 0.5 WHEN rhythm <= 1.25 THEN 1.0 WHEN rhythm <= 1.75 THEN 1.5 WHEN rhythm <= 2.5 THEN 2.0 WHEN rhythm <= 3.5 THEN 3.0 WHEN rhythm <= 5 THEN 4.0
    WHEN rhythm <= 7 THEN 6.0 WHEN rhythm <= 10 THEN 8.0 WHEN rhythm <= 14 THEN 12.0 ELSE 16.0 END::DOUBLE AS duration, count(*) AS n FROM r GROUP BY 1""")
def harmonic_rhythm(spark, sf_dir):
    hours = event_times(spark, sf_dir).withColumn("onset", F.col("tick") / 3600000.0)
    timed = hours.withColumn("gap", (F.lead("tick").over(sequence.ordered(["user_id"], ["ts", "event_id"])) - F.col("tick")) / 3600000.0)
    rhythm = F.when(F.col("gap").isNull(), F.col("value")).otherwise(F.greatest("gap", F.lit(0.5)))
    return timed.groupBy(music.quantised_duration(rhythm).alias("duration")).agg(F.count("*").alias("n"))


@query("q_clip_to_next", f"WITH {EVENT_GAPS_SQL} SELECT event_id, CASE WHEN gap > 0 AND (value * 3600000)::BIGINT > gap THEN gap ELSE (value * 3600000)::BIGINT END AS duration FROM g")
def clip_to_next(spark, sf_dir):
    df = event_times(spark, sf_dir).withColumn("duration", F.round(F.col("value") * 3600000).cast("bigint"))
    return sequence.clip_to_next(df, ["user_id"], ["ts", "event_id"], "tick", "duration").select("event_id", "duration")


@query("q_note_pairing", f"""WITH {MESSAGES_SQL}, b AS (
    SELECT *, coalesce(last_value(CASE WHEN type = 'bend' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS bend_now FROM messages
), n AS (
    SELECT *, lead(type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt, lead(tick) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stop FROM b WHERE type IN ('on', 'off')
) SELECT event_id, tick, stop AS "end", bend_now FROM n WHERE type = 'on' AND nxt = 'off'""")
def note_pairing(spark, sf_dir):
    return sequence.pair_notes(messages(spark, sf_dir), ["user_id"], ["ts", "event_id"]).select("event_id", "tick", "end", "bend_now")


@query("q_implicit_off", f"""WITH {MESSAGES_SQL}, n AS (SELECT *, lead(tick) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stop FROM messages WHERE type IN ('on', 'off'))
SELECT event_id, stop - tick AS length FROM n WHERE type = 'on' AND stop - tick > 5""")
def implicit_off(spark, sf_dir):
    notes = messages(spark, sf_dir).where(F.col("type").isin("on", "off"))
    return sequence.notes_until_next(notes, ["user_id"], ["ts", "event_id"], least=5).select("event_id", (F.col("end") - F.col("tick")).alias("length"))


@query("q_rolling_mean5", """SELECT event_id, round(CASE WHEN count(*) OVER w = 5 THEN avg(value) OVER w END, 6) AS rolling FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def rolling_mean5(spark, sf_dir):
    return sequence.rolling_mean(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", F.round("rolling", 6).alias("rolling"))


@query("q_round_robin_channel", f"WITH {LINES_SQL} SELECT (pos % 15 + 1)::INTEGER AS channel, count(*) AS n, sum(l_partkey)::BIGINT AS parts FROM lines GROUP BY 1")
def round_robin_channel(spark, sf_dir):
    return sequence.round_robin(table(spark, sf_dir, "lineitem"), KEY, LINE_ORDER).groupBy("channel").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("parts"))


@query("q_delta_time", "SELECT event_id, (epoch_us(ts) // 1000) - coalesce(lag((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS delta FROM events")
def delta_time(spark, sf_dir):
    return sequence.deltas(event_times(spark, sf_dir), ["user_id"], ["ts", "event_id"], "tick").select("event_id", "delta")


@query("q_anchor_groups", """WITH RECURSIVE e AS (
    SELECT user_id, (epoch_us(ts) // 1000) // 1000 AS s, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000) // 1000, event_id) AS n FROM events
), g AS (
    SELECT user_id, n, s, s AS anchor FROM e WHERE n = 1
    UNION ALL SELECT e.user_id, e.n, e.s, CASE WHEN e.s - g.anchor <= 7200 THEN g.anchor ELSE e.s END FROM g JOIN e ON e.user_id = g.user_id AND e.n = g.n + 1
) SELECT user_id, anchor, count(*) AS n_notes, max(s) AS last FROM g GROUP BY 1, 2""")
def anchor_groups(spark, sf_dir):
    df = event_times(spark, sf_dir).select("user_id", F.expr("tick div 1000").alias("s"), "event_id")
    return sequence.anchor_groups(df, ["user_id"], "s", F.lit(7200), ["event_id"]).groupBy("user_id", "anchor").agg(F.count("*").alias("n_notes"), F.max("onset").alias("last"))


@query("q_chords_from_notes", f"""WITH {LINES_SQL} SELECT l_orderkey, min(pos) AS onset, greatest(max(pos + l_quantity / 10) - min(pos), 0.25)::DOUBLE AS duration,
    string_agg((l_partkey % 319) || ':' || (l_suppkey % 128), ' ' ORDER BY l_partkey % 319, l_suppkey % 128) AS notes FROM (SELECT *, pos // 4 AS grp FROM lines) GROUP BY l_orderkey, grp""")
def chords_from_notes(spark, sf_dir):
    notes = lines(spark, sf_dir).select("l_orderkey", (F.col("pos") - F.col("pos") % 4).alias("anchor"), (F.col("pos") + F.col("l_quantity") / 10).alias("offset"), (F.col("l_partkey") % 319).alias("step"), (F.col("l_suppkey") % 128).alias("velocity"))
    made = sequence.chords_from_notes(notes, KEY)
    return made.select("l_orderkey", "onset", "duration", F.array_join(F.transform("notes", lambda n: F.concat_ws(":", n["step"].cast("string"), n["velocity"].cast("string"))), " ").alias("notes"))


@query("q_chunk_pad", f"""WITH {WORDS_SQL} SELECT doc_id, (pos // 64)::INTEGER AS chunk, count(*)::INTEGER AS n_real, (64 - count(*))::INTEGER AS n_pad, sum(length(word))::BIGINT AS chars, md5(string_agg(word, ' ' ORDER BY pos)) AS digest FROM w GROUP BY 1, 2""")
def chunk_pad(spark, sf_dir):
    made = sequence.chunks(words(spark, sf_dir), ["doc_id"], "pos", "word", 64, "<pad>")
    real = F.slice("values", 1, F.col("n_real"))
    return made.select("doc_id", "chunk", "n_real", (F.size("values") - F.col("n_real")).alias("n_pad"), F.aggregate(real, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("chars"), F.md5(F.array_join(real, " ")).alias("digest"))


@query("q_pad_or_cut", """SELECT conv_id, array_to_string(list_concat(list(turn ORDER BY turn), [-1, -1, -1, -1, -1, -1, -1, -1])[1:8], ',') AS turns FROM conversations GROUP BY 1""")
def pad_or_cut(spark, sf_dir):
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return grouped.select("conv_id", F.array_join(F.transform(sequence.pad_or_cut(F.col("turns"), 8, -1), lambda x: x.cast("string")), ",").alias("turns"))


@query("q_shift_pair", "SELECT * FROM (SELECT conv_id, turn, md5(text) AS x, md5(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS y FROM conversations) WHERE y IS NOT NULL")
def shift_pair(spark, sf_dir):
    made = sequence.shifted_pairs(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text")
    return made.select("conv_id", "turn", F.md5("text").alias("x"), F.md5("target").alias("y"))


@query("q_repeat_body", f"""WITH {LINES_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS total FROM lines), r AS (
    SELECT *, unnest(range(1, CASE WHEN total < 4 AND pos > 0 THEN 4 ELSE 2 END)) AS turn FROM n
) SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN pos = 0 THEN 0 ELSE 1 END, turn, pos) - 1)::INTEGER AS pos, l_partkey FROM r""")
def repeat_body(spark, sf_dir):
    df = lines(spark, sf_dir).withColumn("total", F.count("*").over(sequence.Window.partitionBy("l_orderkey")))
    return sequence.repeated_body(df, KEY, "pos", F.col("pos") == 0, F.col("total") < 4).select("l_orderkey", "pos", "l_partkey")


@query("q_trim_window", """WITH e AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) AS tick, (value * 60000)::BIGINT AS dur, min((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id) + 86400000 AS a FROM events)
SELECT event_id, greatest(tick, a) - a AS tick, least(tick + dur, a + 259200000) - greatest(tick, a) AS dur FROM e WHERE tick < a + 259200000 AND tick + dur > a""")
def trim_window(spark, sf_dir):
    df = event_times(spark, sf_dir).select("event_id", "user_id", "tick", F.round(F.col("value") * 60000).cast("bigint").alias("dur"))
    df = df.withColumn("a", F.min("tick").over(sequence.Window.partitionBy("user_id")) + 86400000)
    return sequence.trim_to_window(df, "tick", "dur", F.col("a"), F.col("a") + 259200000).select("event_id", "tick", "dur")


@query("q_trim_end", """WITH e AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) - min((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id) AS tick, (value * 60000)::BIGINT AS dur FROM events)
SELECT event_id, tick, least(tick + dur, 259200000) - tick AS dur FROM e WHERE tick < 259200000 AND tick + dur > 0""")
def trim_end(spark, sf_dir):
    df = event_times(spark, sf_dir).withColumn("tick", F.col("tick") - F.min("tick").over(sequence.Window.partitionBy("user_id")))
    df = df.select("event_id", "tick", F.round(F.col("value") * 60000).cast("bigint").alias("dur"))
    return sequence.trim_to_window(df, "tick", "dur", F.lit(0).cast("bigint"), F.lit(259200000).cast("bigint"), clip_start=False).select("event_id", "tick", "dur")


@query("q_encode_chords", f"""WITH {ONSETS_SQL}, c AS (
    SELECT l_orderkey, pos, onset, floor(onset / 4)::INTEGER AS bar, coalesce(max(floor(onset / 4)::INTEGER) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), floor(onset / 4)::INTEGER) AS last,
        CASE WHEN lead(onset) OVER (PARTITION BY l_orderkey ORDER BY pos) IS NULL THEN l_quantity ELSE greatest(lead(onset) OVER (PARTITION BY l_orderkey ORDER BY pos) - onset, 0.5) END AS d,
        least(greatest(l_partkey % 500, 106), 424) AS step, greatest(1, least(8, ceil((l_suppkey % 128) / 127.0::DOUBLE * 8)))::INTEGER AS vel FROM o
), t AS (
    SELECT l_orderkey, pos, repeat('BAR ', greatest(bar - last, 0)) || 'CHORD_START DUR_' || (CASE WHEN d <= 0.75 THEN '0.5' WHEN d <= 1.25 THEN '1.0' WHEN d <= 1.75 THEN '1.5' WHEN d <= 2.5 THEN '2.0' WHEN d <= 3.5 THEN '3.0'
        WHEN d <= 5 THEN '4.0' WHEN d <= 7 THEN '6.0' WHEN d <= 10 THEN '8.0' WHEN d <= 14 THEN '12.0' ELSE '16.0' END) || ' PV_' || step || '_' || vel || ' CHORD_END' AS part FROM c
) SELECT l_orderkey, md5('<start> ' || string_agg(part, ' ' ORDER BY pos) || ' <end>') AS digest FROM t GROUP BY 1""")
def encode_chords(spark, sf_dir):
    df = with_onsets(spark, sf_dir).select("l_orderkey", "onset", F.col("l_quantity").alias("duration"), F.array(F.struct((F.col("l_partkey") % 500).alias("step"), (F.col("l_suppkey") % 128).alias("velocity"))).alias("notes"))
    stream = sequence.encode_chords(df, KEY)
    return stream.groupBy("l_orderkey").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"]), " ")).alias("digest"))


@query("q_decode_stream", f"""WITH {TOKENS_SQL}, d AS (
    SELECT l_orderkey, pos, CASE WHEN l_quantity <= 0.75 THEN 0.5 WHEN l_quantity <= 1.25 THEN 1.0 WHEN l_quantity <= 1.75 THEN 1.5 WHEN l_quantity <= 2.5 THEN 2.0 WHEN l_quantity <= 3.5 THEN 3.0 WHEN l_quantity <= 5 THEN 4.0
        WHEN l_quantity <= 7 THEN 6.0 WHEN l_quantity <= 10 THEN 8.0 WHEN l_quantity <= 14 THEN 12.0 ELSE 16.0 END::DOUBLE AS duration, step, vel FROM chords
) SELECT l_orderkey, pos AS chord, sum(duration) OVER (PARTITION BY l_orderkey ORDER BY pos) - duration AS onset, duration, step::INTEGER AS step, least(greatest(round_even(vel / 8.0 * 127, 0), 1), 127)::INTEGER AS velocity FROM d""")
def decode_stream(spark, sf_dir):
    made = sequence.decoded_songs(token_songs(spark, sf_dir), KEY)
    return made.select("l_orderkey", "chord", "onset", "duration", F.col("notes")[0]["step"].alias("step"), F.col("notes")[0]["velocity"].alias("velocity"))


@query("q_element_counter", f"""WITH {TOKENS_SQL}, s AS (SELECT l_orderkey, pos, tok, sum((tok = '.')::INT) OVER (PARTITION BY l_orderkey ORDER BY pos) AS k FROM tokens),
n AS (SELECT (row_number() OVER (PARTITION BY l_orderkey, k ORDER BY pos) - 1)::INTEGER AS element FROM s WHERE k > 0) SELECT element, count(*) AS n FROM n GROUP BY 1""")
def element_counter(spark, sf_dir):
    places = F.transform(sequence.chords_of(F.col("toks")), lambda c: F.sequence(F.lit(0), F.size(c) - 1))
    return token_songs(spark, sf_dir).select(F.explode(F.flatten(places)).alias("element")).groupBy("element").agg(F.count("*").alias("n"))


@query("q_clean_chords")
def clean_chords(spark, sf_dir):
    """Undersized chords are merged into their nearest neighbours; orders are sequences."""
    df = sequence.onsets(table(spark, sf_dir, "lineitem"), KEY, LINE_ORDER, "l_quantity").select("l_orderkey", "onset", F.col("l_quantity").alias("duration"), F.transform(F.sequence(F.lit(0), (F.col("l_suppkey") % 4).cast("int")), lambda k: F.struct((F.col("l_partkey") % 200 + k * 13 + 110).cast("int").alias("step"), F.lit(64).alias("velocity"))).alias("notes"))
    return recurrent.clean_chords(df, "l_orderkey")


@query("q_voice_leading")
def voice_leading(spark, sf_dir):
    """Each chord takes the voicing that is nearest to the one chosen before it."""
    quality = lambda line: F.element_at(F.array(F.lit("maj7"), F.lit("m7"), F.lit("dom7"), F.lit("ø7")), (line["l_suppkey"] % 4 + 1).cast("int"))
    chord = lambda line: F.struct((line["l_partkey"] % 12 + 42).cast("int").alias("root"), quality(line).alias("quality"))
    return voicing.lead_songs(line_arrays(spark, sf_dir).select("l_orderkey", F.transform("lines", chord).alias("chords")), "l_orderkey")
