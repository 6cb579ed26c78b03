"""Queries of two-level token streams, vocabularies, prompts, files of messages and voicings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ostinato.functions import dims, dissonance, spelling
from ostinato.operators import joins, quality, recurrent, sequence, splits, streams, voicing
from ostinato.plans.common import LINES_SQL, TOKENS_SQL, WORDS_SQL, lines, query, songs, table, token_songs, tokens, words
from ostinato.plans.harmony_queries import DIM_SQL
from ostinato.sources import midi

KEY = ["l_orderkey"]
ROOTS, QUALITIES = ["C", "^C", "vD", "F#"], ["maj7", "m7", ""]


def pick(values, c):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (c % len(values) + 1).cast("int"))


#: Lines as chords of both levels: symbols, then a block of one or two notes; every fifth has a bass, every third an extension.
BOTH_SQL = f"""{LINES_SQL}, ch AS (SELECT l_orderkey, pos, ({ROOTS})[(l_partkey % 4 + 1)::INTEGER] AS root, nullif(({QUALITIES})[(l_suppkey % 3 + 1)::INTEGER], '') AS quality, CASE WHEN l_partkey % 5 = 0 THEN ({ROOTS})[(l_suppkey % 4 + 1)::INTEGER] END AS bass,
    CASE WHEN l_partkey % 3 = 0 THEN 'add 9' END AS ext, 1 + l_linenumber % 4 AS dur, 106 + l_partkey % 319 AS p1, CASE WHEN l_suppkey % 2 = 0 THEN 106 + l_suppkey % 319 END AS p2 FROM lines)"""


def both_levels(spark, sf_dir):
    """(l_orderkey, toks): orders as streams of both levels, with a bar line after each chord."""
    some = lambda c, *t: F.when(c, F.array(*t)).otherwise(F.array().cast("array<string>"))

    def toks(col):
        quality_ = pick(QUALITIES, col("l_suppkey"))
        note = lambda c: F.concat(F.lit("PV_"), (col(c) % 319 + 106).cast("string"), F.lit("_3"))
        return F.concat(
            F.array(F.lit("."), F.concat(F.lit("DUR_"), (col("l_linenumber") % 4 + 1).cast("string"), F.lit(".0")), F.concat(F.lit("R_"), pick(ROOTS, col("l_partkey")))), some(quality_ != "", F.concat(F.lit("Q_"), quality_)),
            some(col("l_partkey") % 3 == 0, F.lit("X_add 9")), some(col("l_partkey") % 5 == 0, F.lit("/"), F.concat(F.lit("R_"), pick(ROOTS, col("l_suppkey")))),
            F.array(F.lit("CHORD_START"), F.lit("DUR_8.0"), note("l_partkey")), some(col("l_suppkey") % 2 == 0, note("l_suppkey")), F.array(F.lit("CHORD_END"), F.lit("BAR")),
        )

    return songs(spark, sf_dir, toks)


@query("q_both_levels", f"WITH {BOTH_SQL} SELECT l_orderkey, pos AS chord, root, quality, coalesce(ext, '') AS extensions, bass, dur::DOUBLE AS duration, concat_ws(' ', p1, p2) AS pitches FROM ch")
def read_both_levels(spark, sf_dir):
    """The chords of streams of both levels, field by field."""
    made = streams.both_levels_of(both_levels(spark, sf_dir), KEY)
    return made.select("l_orderkey", "chord", "root", "quality", F.array_join("extensions", " ").alias("extensions"), "bass", "duration", F.array_join(F.transform("pitches", lambda p: p.cast("string")), " ").alias("pitches"))


@query("q_chord_histograms", f"""WITH {BOTH_SQL}, h AS (SELECT 'notes' AS what, (1 + (p2 IS NOT NULL)::INT)::VARCHAR AS value FROM ch UNION ALL SELECT 'duration', dur || '.0' FROM ch UNION ALL SELECT 'quality', quality FROM ch WHERE quality IS NOT NULL UNION ALL SELECT 'root', root FROM ch)
SELECT what, value, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (PARTITION BY what)::DOUBLE, 6) AS pct FROM h GROUP BY 1, 2""")
def chord_histograms(spark, sf_dir):
    """Notes, durations, qualities and roots of chords."""
    return quality.chord_histograms(streams.both_levels_of(both_levels(spark, sf_dir), KEY))


@query("q_chord_summary", f"WITH {BOTH_SQL} SELECT l_orderkey, pos AS chord, pos AS bar_number, 8.0::DOUBLE AS duration, concat_ws(' ', p1, p2) AS pitches, CASE WHEN p2 IS NULL THEN '3' ELSE '3 3' END AS velocities FROM ch")
def chord_summary(spark, sf_dir):
    """Blocks with the number of their bar."""
    text = lambda c: F.array_join(F.transform(c, lambda p: p.cast("string")), " ").alias(c)
    return streams.chord_summary_of(both_levels(spark, sf_dir), KEY).select("l_orderkey", "chord", F.col("bar_number").cast("int").alias("bar_number"), "duration", text("pitches"), text("velocities"))


@query("q_readable", f"""WITH {BOTH_SQL}, t AS (SELECT l_orderkey, pos * 2 AS line, '  [root=? | steps=' || concat_ws(',', p1, p2) || ' | dur=8.0]' AS text FROM ch UNION ALL SELECT l_orderkey, pos * 2 + 1, '  |' FROM ch)
SELECT l_orderkey, md5(string_agg(text, chr(10) ORDER BY line)) AS digest, count(*) AS n FROM t GROUP BY 1""")
def readable(spark, sf_dir):
    """Streams as lines to read."""
    made = streams.readable_of(both_levels(spark, sf_dir), KEY)
    return made.select("l_orderkey", F.md5(F.array_join("lines", "\n")).alias("digest"), F.size("lines").cast("long").alias("n"))


@query("q_twelve_tone_messages", f"""WITH {BOTH_SQL}, n AS (SELECT l_orderkey, pos, list_sort(list_distinct(list_transform(list_filter([p1, p2], lambda p: p IS NOT NULL), lambda p: least(greatest(round_even((p - 106) * 12 / 53.0::DOUBLE, 0)::INTEGER + 36, 0), 127)))) AS notes FROM ch),
m AS (SELECT l_orderkey, pos, 0 AS k, generate_subscripts(notes, 1) AS i, unnest(notes) AS note FROM n UNION ALL SELECT l_orderkey, pos, 1, generate_subscripts(notes, 1), unnest(notes) FROM n)
SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY pos, k, i) - 1)::INTEGER AS nth, CASE WHEN k = 1 AND i = 1 THEN 3840 ELSE 0 END::BIGINT AS delta, CASE k WHEN 0 THEN 'on' ELSE 'off' END AS type, note::INTEGER AS note FROM m""")
def twelve_tone_messages(spark, sf_dir):
    """Streams as messages of twelve tones."""
    made = streams.twelve_tone_messages(streams.chord_summary_of(both_levels(spark, sf_dir), KEY), KEY)
    return made.select("l_orderkey", "nth", "delta", "type", "note")


@query("q_token_vectors", f"""WITH {DIM_SQL}, {TOKENS_SQL}, s AS (SELECT tok, sum((tok = 'CHORD_START')::INT) OVER w - coalesce(sum((tok = 'CHORD_END')::INT) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside FROM tokens WINDOW w AS (PARTITION BY l_orderkey ORDER BY pos))
SELECT inside = 1 AS inside, count(*) AS n, CASE WHEN inside = 1 THEN (SELECT round(d, 5) FROM dim WHERE third IS NULL AND fifth = 31 AND seventh IS NULL) ELSE 0.0 END AS d, CASE WHEN inside = 1 THEN round(pow(2, 31 / 53.0::DOUBLE), 6) ELSE 1.0 END AS beta FROM s GROUP BY 1, 3, 4""")
def token_vectors(spark, sf_dir):
    """Every token of the orders' streams with its chord's vector: single notes are a bare fifth."""
    made = streams.token_vectors_of(token_songs(spark, sf_dir), KEY, dissonance.dissonance_dim(spark))
    return made.groupBy((F.col("span") >= 0).alias("inside"), F.round("d", 5).alias("d"), F.round("beta", 6).alias("beta")).agg(F.count("*").alias("n"))


@query("q_merged_levels", f"""WITH {LINES_SQL}, t AS (SELECT l_orderkey, pos, unnest(['|', '.', 'R_' || l_partkey % 9, 'CHORD_START', 'PV_' || l_suppkey % 9, 'CHORD_END']) AS tok, generate_subscripts([1, 2, 3, 4, 5, 6], 1) AS i FROM lines)
SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY pos, i) - 1)::INTEGER AS pos, tok, (CASE WHEN i = 1 THEN pos - 1 ELSE pos END)::INTEGER AS span FROM t""")
def merged_levels(spark, sf_dir):
    """Symbols and blocks of orders merged, with the chord that each token belongs to."""
    rows = lines(spark, sf_dir)
    lit = lambda *t: F.array(*[F.lit(x) if isinstance(x, str) else x for x in t])
    bars = rows.select("l_orderkey", (F.col("pos") * 2).alias("event"), F.lit(None).cast("int").alias("chord_idx"), lit("|").alias("toks"))
    chords = rows.select("l_orderkey", (F.col("pos") * 2 + 1).alias("event"), F.col("pos").alias("chord_idx"), lit(".", F.concat(F.lit("R_"), (F.col("l_partkey") % 9).cast("string"))).alias("toks"))
    blocks = rows.select("l_orderkey", F.col("pos").alias("chord_idx"), lit("CHORD_START", F.concat(F.lit("PV_"), (F.col("l_suppkey") % 9).cast("string")), "CHORD_END").alias("toks"))
    return streams.merged_levels(bars.unionByName(chords), blocks, KEY)[0].select("l_orderkey", F.col("pos").cast("int").alias("pos"), "tok", "span")


#: Orders as plain charts: a dot, a duration, a root, a quality, perhaps an extension, a bar.
PLAIN_SQL = f"{LINES_SQL}, ch AS (SELECT l_orderkey, pos, (['C', 'F#', 'Bb'])[(l_partkey % 3 + 1)::INTEGER] AS root, (['dom7', 'm7', 'maj'])[(l_suppkey % 3 + 1)::INTEGER] AS quality, CASE WHEN l_partkey % 4 = 0 THEN 'add 9' END AS ext FROM lines)"


def plain_songs(spark, sf_dir):
    def toks(col):
        ext = F.when(col("l_partkey") % 4 == 0, F.array(F.lit("add 9"))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(F.lit("."), F.lit("2.0"), pick(["C", "F#", "Bb"], col("l_partkey")), pick(["dom7", "m7", "maj"], col("l_suppkey"))), ext, F.array(F.lit("|")))

    return songs(spark, sf_dir, toks)


def plain_charts(spark, sf_dir):
    return plain_songs(spark, sf_dir).select("l_orderkey", F.posexplode("toks").alias("pos", "tok"))


@query("q_readable_chords", f"WITH {PLAIN_SQL} SELECT l_orderkey, pos AS chord, concat_ws(' ', root, quality, ext) AS text FROM ch")
def readable_chords(spark, sf_dir):
    return streams.readable_chords_of(plain_songs(spark, sf_dir), KEY)


@query("q_symbols_back", f"WITH {PLAIN_SQL} SELECT l_orderkey, pos AS nth, root || CASE quality WHEN 'dom7' THEN '7' ELSE quality END || coalesce(' ' || ext, '') AS symbol FROM ch")
def symbols_back(spark, sf_dir):
    """Tokens of charts as symbols again."""
    return streams.chord_symbols(plain_charts(spark, sf_dir), KEY, [t for t in spelling.NO_CHORDS if t not in (".", "|", ":|", "<end>")], header=0)


@query("q_refilled", f"""WITH {LINES_SQL}, n AS (SELECT l_orderkey, pos, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lines) SELECT l_orderkey, pos * 2 AS pos, '|' AS tok FROM n WHERE pos < greatest(c - 1, 1) UNION ALL SELECT l_orderkey, pos * 2 + 1, 'new' || pos FROM n WHERE pos < c - 1 UNION ALL SELECT l_orderkey, pos * 2, '|' FROM n WHERE pos = c - 1 AND c > 1""")
def refilled(spark, sf_dir):
    """Chord tokens of orders replaced in order by one fewer than there are, so that the stream ends early."""
    rows = lines(spark, sf_dir)
    reference = rows.select("l_orderkey", F.posexplode(F.array(F.lit("|"), F.lit("old"))).alias("i", "tok"), F.col("pos").alias("line")).select("l_orderkey", (F.col("line") * 2 + F.col("i")).alias("pos"), "tok")
    total = rows.withColumn("c", F.count("*").over(sequence.Window.partitionBy("l_orderkey"))).where("pos < c - 1")
    given = total.select("l_orderkey", "pos", F.concat(F.lit("new"), F.col("pos").cast("string")).alias("tok"))
    return streams.refilled(reference, given, KEY, F.col("tok") == "|")


@query("q_until_beats", f"WITH {LINES_SQL}, b AS (SELECT l_orderkey, pos, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lines) SELECT l_orderkey, pos FROM b WHERE before < 60")
def until_beats(spark, sf_dir):
    return streams.until_beats(lines(spark, sf_dir), KEY, ["pos"], "l_quantity", 60.0).select("l_orderkey", "pos")


@query("q_vector_ranges", "SELECT count(*) AS n, count(DISTINCT (l_discount, l_tax)) AS n_distinct, min(l_discount) AS least_l_discount, max(l_discount) AS most_l_discount, min(l_tax) AS least_l_tax, max(l_tax) AS most_l_tax FROM lineitem")
def vector_ranges(spark, sf_dir):
    return streams.vector_ranges(table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax"])


@query("q_vocab_report", f"""WITH {TOKENS_SQL} SELECT CASE WHEN tok IN ('<start>', '<end>') THEN 'special' WHEN tok IN ('CHORD_START', 'CHORD_END') THEN 'structure' WHEN tok LIKE 'DUR%' THEN 'duration' WHEN tok LIKE 'PV%' THEN 'note' ELSE 'other' END AS kind, count(DISTINCT tok) AS tokens, count(*) AS n FROM tokens GROUP BY 1""")
def vocab_report(spark, sf_dir):
    return quality.vocabulary_report(tokens(spark, sf_dir), "tok")


@query("q_ordered_vocab", """WITH g AS (SELECT 0 AS g, row_number() OVER (ORDER BY r_regionkey) AS nth, r_name AS tok FROM region UNION ALL SELECT 1, row_number() OVER (ORDER BY n_nationkey), n_name FROM nation UNION ALL SELECT 2, p_partkey, p_brand FROM part),
f AS (SELECT tok, min((g, nth)) AS a FROM g GROUP BY 1) SELECT tok, (row_number() OVER (ORDER BY a) - 1)::INTEGER AS id FROM f""")
def ordered_vocab(spark, sf_dir):
    """A vocabulary of groups, one after another, each token once."""
    named = lambda t, order, c: table(spark, sf_dir, t).select(F.col(order).alias("nth"), F.col(c).alias("tok"))
    return joins.ordered_vocabulary([named("region", "r_regionkey", "r_name"), named("nation", "n_nationkey", "n_name"), named("part", "p_partkey", "p_brand")])


LETTERS_SQL = "v AS (SELECT chr(97 + i) AS tok, i + 1 AS id FROM (SELECT unnest(range(0, 20))::INTEGER AS i))"


def letters(spark):
    return spark.range(20).select(F.char(F.col("id") + 97).alias("tok"), (F.col("id") + 1).cast("int").alias("id"))


@query("q_encoded_words", f"WITH {WORDS_SQL}, {LETTERS_SQL} SELECT coalesce(id, 0)::INTEGER AS id, count(*) AS n, count(DISTINCT w.word) AS words FROM w LEFT JOIN v ON v.tok = lower(substr(word, 1, 1)) GROUP BY 1")
def encoded_words(spark, sf_dir):
    """First letters of all words as ids; those of no letter in the vocabulary are padding."""
    rows = words(spark, sf_dir).withColumn("tok", F.lower(F.substring("word", 1, 1)))
    return joins.encoded(rows, letters(spark)).groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("word").alias("words"))


@query("q_decoded_ids", f"WITH {LETTERS_SQL} SELECT coalesce(tok, '<unk>') AS tok, count(*) AS n FROM part LEFT JOIN v ON v.id = p_partkey % 30 GROUP BY 1")
def decoded_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 30).alias("code"))
    return joins.decoded(rows, letters(spark), "code", "<unk>").groupBy("tok").agg(F.count("*").alias("n"))


@query("q_strict_ids", f"WITH {LETTERS_SQL} SELECT id, count(*) AS n FROM part JOIN v ON v.tok = chr((97 + p_partkey % 20)::INTEGER) GROUP BY 1")
def strict_ids(spark, sf_dir):
    """Tokens that must all be in the vocabulary."""
    rows = table(spark, sf_dir, "part").select(F.char(F.col("p_partkey") % 20 + 97).alias("tok"))
    return joins.encoded_strictly(rows, letters(spark)).groupBy("id").agg(F.count("*").alias("n"))


@query("q_unknown_tokens", f"WITH {WORDS_SQL}, {LETTERS_SQL} SELECT lower(substr(word, 1, 1)) AS tok, count(*) AS n FROM w WHERE lower(substr(word, 1, 1)) NOT IN (SELECT tok FROM v) GROUP BY 1")
def unknown_tokens(spark, sf_dir):
    """Tokens that are filtered out, with how often they occur."""
    rows = words(spark, sf_dir).select(F.lower(F.substring("word", 1, 1)).alias("tok"))
    return joins.known_tokens(rows, letters(spark))[1]


SEEDS = [("Jazz", "type_0_major", "maj7"), ("Bossa", "type_3_major", "vMvM7"), ("Rock", "type_9", "none")]


@query("q_prompts", f"""WITH s AS (SELECT * FROM {dims.values_sql(SEEDS, 'style, type, quality')}), t AS (SELECT style, type, unnest(['<start>', '<style>', 'STYLE_' || style, '<tonality>', 'TONALITY_C_major', 'TYPE_' || type, 'FORM_A', '|:', '.', 'DUR_4.0', 'R_E', 'Q_' || quality]) AS tok FROM s)
SELECT style, type, string_agg(tok, ' ') AS prompt, count(*) FILTER (tok IN ('TYPE_type_9', 'Q_none')) AS unknown FROM t GROUP BY 1, 2""")
def prompts(spark, sf_dir):
    """Headers and first chords by style and type, and how many of their tokens a vocabulary lacks."""
    wanted = spark.createDataFrame(SEEDS, "style string, type string, quality string")
    every = streams.prompts(wanted, spark.createDataFrame([], "tok string"))
    vocabulary = every.select("tok").distinct().where("tok not in ('TYPE_type_9', 'Q_none')")
    made = streams.prompts(wanted, vocabulary)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda r: r["tok"]), " ")
    return made.groupBy("style", "type").agg(text.alias("prompt"), F.count_if(~F.col("known")).alias("unknown"))


@query("q_cross_keys", "SELECT k AS tonality, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders, (SELECT unnest(['C', 'Db', 'D', 'Eb', 'E', 'F', 'Gb', 'G', 'Ab', 'A', 'Bb', 'B']) AS k) GROUP BY 1")
def cross_keys(spark, sf_dir):
    """Every order in twelve keys."""
    keys = spark.createDataFrame([(k,) for k in ("C", "Db", "D", "Eb", "E", "F", "Gb", "G", "Ab", "A", "Bb", "B")], "tonality string")
    return table(spark, sf_dir, "orders").select("o_orderkey").crossJoin(F.broadcast(keys)).groupBy("tonality").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("q_value_counts", "WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) SELECT p_brand, n, (SELECT count(*) FROM c) AS n_distinct FROM c ORDER BY n DESC, p_brand LIMIT 10")
def value_counts(spark, sf_dir):
    return quality.value_counts(table(spark, sf_dir, "part"), "p_brand", 10)


@query("q_accuracy", f"""WITH {LINES_SQL}, a AS (SELECT l_orderkey, count(*) FILTER (l_partkey % 2 = 0) * 100 / count(*)::DOUBLE AS share FROM lines GROUP BY 1) SELECT round(avg(share), 6) AS average, min(share) AS least, max(share) AS most, round(avg((share = 100)::INT::DOUBLE) * 100, 6) AS pct_perfect FROM a""")
def accuracy(spark, sf_dir):
    """Accuracies of orders summed up."""
    shares = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.count_if(F.col("l_partkey") % 2 == 0) / F.count("*") * 100).alias("share"))
    return quality.accuracy(shares, "share")


@query("q_stem_counts", """WITH s AS (SELECT page_id || '_Song_' || (['C', 'Db', 'F#'])[(page_id % 3 + 1)::INTEGER] || '_major_type_' || (page_id % 7) AS stem FROM pages WHERE page_id % 11 > 0), p AS (SELECT string_split(stem, '_') AS p FROM s),
c AS (SELECT 'key' AS what, p[3] AS value, count(*) AS n FROM p GROUP BY 2 UNION ALL SELECT 'type', 'type', count(*) FROM p UNION ALL SELECT 'last', p[-1], count(*) FROM p GROUP BY 2) SELECT what, value, n FROM (SELECT *, row_number() OVER (PARTITION BY what ORDER BY n DESC, value) AS r FROM c) WHERE r <= 10""")
def stem_counts(spark, sf_dir):
    """Keys, types and last parts of stems; short ones are left out."""
    n = F.col("page_id")
    stem = F.when(n % 11 == 0, F.lit("short_stem")).otherwise(F.concat(n.cast("string"), F.lit("_Song_"), pick(["C", "Db", "F#"], n), F.lit("_major_type_"), (n % 7).cast("string")))
    return quality.stem_counts(table(spark, sf_dir, "pages").select(stem.alias("stem")), "stem")


@query("q_form_of_bars", f"""WITH {LINES_SQL}, t AS (SELECT l_orderkey, pos, (['|', 'Form_A', 'Form_intro', 'x', 'Outro'])[(l_partkey % 5 + 1)::INTEGER] AS tok FROM lines), b AS (SELECT *, sum((tok = '|')::INT) OVER (PARTITION BY l_orderkey ORDER BY pos) AS bar_no FROM t)
SELECT l_orderkey, bar_no::BIGINT AS bar_no, arg_max(CASE tok WHEN 'Form_A' THEN 'A' ELSE 'INTRO' END, pos) AS form FROM b WHERE tok IN ('Form_A', 'Form_intro') GROUP BY 1, 2""")
def form_of_bars(spark, sf_dir):
    """Form marks of the bars that follow them."""
    df = lines(spark, sf_dir).select("l_orderkey", "pos", pick(["|", "Form_A", "Form_intro", "x", "Outro"], F.col("l_partkey")).alias("tok"))
    return sequence.form_of_bars(df, KEY, ["pos"])


@query("q_note_messages", f"""WITH {LINES_SQL}, e AS (SELECT l_orderkey, pos, pos * 2 AS onset, 106 + l_partkey % 319 AS step, 1 + l_suppkey % 127 AS velocity FROM lines), n AS (SELECT *, least(greatest(round_even(step * 12 / 53.0::DOUBLE, 0)::INTEGER, 0), 127) AS note FROM e),
m AS (SELECT l_orderkey, onset, onset * 480 AS tick, 0 AS rank, 'bend' AS type, note, least(greatest(round_even((step * 1200 / 53.0::DOUBLE - note * 100) / 200 * 8191, 0)::INTEGER, -8192), 8191) AS value FROM n
    UNION ALL SELECT l_orderkey, onset, onset * 480 + 480, 1, 'off', note, velocity FROM n UNION ALL SELECT l_orderkey, onset, onset * 480, 2, 'on', note, velocity FROM n)
SELECT l_orderkey, (row_number() OVER w - 1)::INTEGER AS nth, (tick - coalesce(lag(tick) OVER w, 0))::BIGINT AS delta, type, note, value::INTEGER AS value FROM m WINDOW w AS (PARTITION BY l_orderkey ORDER BY tick, rank, onset)""")
def note_messages(spark, sf_dir):
    """Orders as messages with bends, ends and beginnings by tick."""
    df = lines(spark, sf_dir).select("l_orderkey", (F.col("pos") * 2.0).alias("onset"), F.lit(1.0).alias("duration"), F.array(F.struct((F.col("l_partkey") % 319 + 106).cast("int").alias("step"), (F.col("l_suppkey") % 127 + 1).cast("int").alias("velocity"))).alias("notes"))
    return midi.note_messages(df, KEY).select("l_orderkey", "nth", "delta", "type", "note", "value")


@query("q_repaired_charts")
def repaired_charts(spark, sf_dir):
    """Charts of all orders without contradicting qualities."""
    toks = lambda col: F.concat(F.array(F.lit("."), F.lit("4.0"), F.lit("C")), F.when(col("l_partkey") % 2 == 0, F.array(F.lit("dom7"), F.lit("add 9"), F.lit("sus7"))).otherwise(F.array(F.lit("dom7"), F.lit("sus4"), F.lit("add b9"))), F.array(F.lit("|")))
    made = recurrent.repaired_songs(songs(spark, sf_dir, toks), "l_orderkey")
    return made.select("l_orderkey", F.array_join("toks", " ").alias("chart"))


@query("q_voiced_charts")
def voiced_charts(spark, sf_dir):
    """Charts of all orders voiced, with extensions and basses."""

    def toks(col):
        bass = F.when(col("l_partkey") % 3 == 0, F.array(F.lit("/"), pick(["E", "Bb"], col("l_partkey")))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(F.lit("."), F.lit("4.0"), pick(list("CDEFGAB"), col("l_partkey")), pick(["maj7", "m7", "dom7", "o7"], col("l_suppkey")), pick(["add 9", "alter b5", "|"], col("l_suppkey"))), bass)

    made = voicing.voice_songs(songs(spark, sf_dir, toks), "l_orderkey")
    return made.select("l_orderkey", "chord", F.array_join(F.transform("voicing", lambda n: n.cast("string")), " ").alias("voicing"), "duration", "label")


@query("q_template_voicings", f"""WITH {LINES_SQL}, c AS (SELECT l_orderkey, pos, ([48, 50, 52])[(l_partkey % 3 + 1)::INTEGER] AS root, pos * 4 + 3 AS a FROM lines)
SELECT l_orderkey, a::INTEGER AS pos, CASE (a % 3) WHEN 0 THEN root || ' ' || (root + 3) || ' ' || (root + 7) || ' ' || (root + 10) || ' 0 0 0 0' WHEN 1 THEN root || ' ' || (root + 10) || ' ' || (root + 14) || ' ' || (root + 15) || ' 0 0 0 0'
    ELSE root || ' ' || (root + 3) || ' ' || (root + 7) || ' ' || (root + 10) || ' ' || (root + 14) || ' 0 0 0' END AS slots FROM c""")
def template_voicings(spark, sf_dir):
    """Templates of a quality by their place, for all lines."""
    toks = lambda col: F.array(F.lit("."), F.lit("4.0"), pick(["C", "D", "E"], col("l_partkey")), F.lit("m7"))
    made = voicing.template_songs(songs(spark, sf_dir, toks), "l_orderkey").where("tok = 'm7'")
    return made.select("l_orderkey", "pos", F.array_join(F.transform("slots", lambda n: n.cast("string")), " ").alias("slots"))


@query("q_played_charts")
def played_charts(spark, sf_dir):
    """Orders as charts with repeats, played out."""
    toks = lambda col: F.array(F.lit("|:"), F.concat(F.lit("a"), col("l_partkey").cast("string")), F.lit("Repeat_1"), F.lit("b"), F.lit(":|"), F.lit("Repeat_2"), F.lit("c"))
    return recurrent.expanded_songs(songs(spark, sf_dir, toks), "l_orderkey")


@query("q_encoded_songs")
def encoded_songs(spark, sf_dir):
    """Orders cleaned and encoded."""
    df = lines(spark, sf_dir).select("l_orderkey", (F.col("pos") * 2.0).alias("onset"), F.lit(2.0).alias("duration"), F.transform(F.sequence(F.lit(0), (F.col("l_suppkey") % 4).cast("int")), lambda k: F.struct((F.col("l_partkey") % 200 + k * 13 + 110).cast("int").alias("step"), F.lit(64).alias("velocity"))).alias("notes"))
    return streams.encoded_arrays(df, "l_orderkey").select("l_orderkey", F.array_join("toks", " ").alias("chart"))


@query("q_corpus_rows", f"""WITH {LINES_SQL}, s AS (SELECT l_orderkey, string_agg('. ' || (['C maj7', 'F# m7'])[(l_partkey % 2 + 1)::INTEGER], ' ' ORDER BY pos) AS body, count(*) AS n FROM lines GROUP BY 1)
SELECT l_orderkey, '<start> <style> Jazz ' || body || ' <end>' || repeat(' <pad>', greatest(24 - 4 - 3 * n, 0)::INTEGER) AS line, 4 + 3 * n <= 24 AS fits FROM s WHERE 4 + 3 * n <= 24""")
def corpus_rows(spark, sf_dir):
    """Orders as padded rows of a corpus; all of them fit."""
    grouped = lines(spark, sf_dir).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", pick(["Cmaj7", "F#m7"], F.col("l_partkey")).alias("s")))), lambda r: r["s"]).alias("s"))
    made = streams.corpus_rows(grouped.select("l_orderkey", F.concat(F.array(F.lit("<style>"), F.lit("Jazz")), "s").alias("t")), KEY, "t", 24)
    return made.where("fits").select("l_orderkey", F.array_join("values", " ").alias("line"), "fits")


@query("q_windowed_shuffle", """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders), h AS (SELECT *, ('0x' || substr(md5('42|' || (i // 16)::BIGINT), 1, 15))::BIGINT AS h FROM r) SELECT o_orderkey, (row_number() OVER (ORDER BY h, i) - 1)::BIGINT AS place FROM h""")
def windowed_shuffle(spark, sf_dir):
    """Orders shuffled in runs of sixteen."""
    return splits.windowed_order(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 16)


@query("q_presentation", "SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY ('0x' || substr(md5('3|' || o_orderkey), 1, 15))::BIGINT, o_orderkey) - 1)::INTEGER AS place FROM orders")
def presentation(spark, sf_dir):
    """An order of presentation within each status."""
    return splits.presentation_order(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_orderkey", 3).select("o_orderkey", "place")


@query("q_random_batch", "WITH d AS (SELECT i AS draw, ('0x' || substr(md5('5|' || i), 1, 15))::BIGINT % (SELECT count(*) FROM part) AS nth FROM (SELECT unnest(range(0, 500)) AS i)), p AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey, p_name) - 1 AS nth FROM part) SELECT draw, p_partkey, p_name FROM d JOIN p USING (nth)")
def random_batch(spark, sf_dir):
    """Five hundred draws with replacement from all parts."""
    return splits.drawn(table(spark, sf_dir, "part").select("p_partkey", "p_name"), ["p_partkey", "p_name"], 500, 5)
