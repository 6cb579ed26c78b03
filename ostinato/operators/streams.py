"""Token streams of two levels: chord symbols and the notes that sound, joined, described and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ostinato.functions import dims, dissonance, music
from ostinato.operators import joins, recurrent, sequence, splits

START, END = "CHORD_START", "CHORD_END"
#: What a token outside of chords has for (alpha, beta, gamma, d).
DEFAULT_VECTOR = (1.0, 1.0, 2.0, 0.0)


# --- vectors


def chord_vectors(df: DataFrame, steps: str, root: Column | None, dim: DataFrame) -> DataFrame:
    """Adds alpha, beta, gamma and d of an array of steps above a root's pitch class, or above their lowest without one.

    ``dim`` is dissonance.dissonance_dim, which has a row for all that a chord can be.
    """
    base = F.coalesce(root, F.array_min(steps)) if root is not None else F.array_min(steps)
    toned = df.withColumn("_iv", music.intervals(F.col(steps), base)).withColumn("_t", music.chord_tones(F.col("_iv")))
    own = dim.select(*[F.coalesce(c, F.lit(-1)).alias(f"_d_{c}") for c in ("third", "fifth", "seventh")], "d")
    hit = None
    for c in ("third", "fifth", "seventh"):
        same = F.coalesce(F.col(f"_t.{c}"), F.lit(-1)) == F.col(f"_d_{c}")
        hit = same if hit is None else hit & same
    joined = toned.join(joins.small(own), hit, "left").withColumn("_r", music.tone_ratios(F.col("_t")))
    return joined.withColumns({c: F.col(f"_r.{c}") for c in ("alpha", "beta", "gamma")}).drop("_iv", "_t", "_r", "_d_third", "_d_fifth", "_d_seventh")


def sidecar_vectors(symbols: DataFrame, chords: DataFrame, key: list[str], notes: DataFrame, dim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, chord_idx, alpha, beta, gamma, d) of songs whose symbols (key, chord_idx, root) and chords (key, chord_idx,
    steps) are as many, and the songs where they aren't. A root without a name in ``notes`` is the lowest step.
    """
    fit, odd = joins.positional(symbols, chords, key, "chord_idx")
    names = notes.select(F.col("name").alias("_name"), F.col("pc").alias("_root_pc"))
    rooted = fit.join(joins.small(names), F.col("root") == F.col("_name"), "left").drop("_name")
    made = chord_vectors(rooted, "steps", F.col("_root_pc"), dim)
    return made.select(*key, "chord_idx", "alpha", "beta", "gamma", "d"), odd


def note_step(token: Column) -> Column:
    """The step of a note token of any vocabulary, null for others."""
    found = F.regexp_extract(token, r"^(?:PV|P|H)_(\d+)", 1)
    return F.when(found != "", found.cast("int"))


def token_vectors(df: DataFrame, key: list[str], dim: DataFrame, pos: str = "pos", token: str = "tok", default: tuple = DEFAULT_VECTOR) -> DataFrame:
    """Adds alpha, beta, gamma and d to each token: those of its block's notes above the lowest, else the default.

    A block without an end counts from its start on, so this also serves a stream that isn't at its end.
    """
    spanned = sequence.block_spans(df, key, [pos], token, START, END)
    blocks = spanned.where("span >= 0").groupBy(*key, "span").agg(F.array_sort(F.collect_set(note_step(F.col(token)))).alias("_steps"))
    vectors = chord_vectors(blocks, "_steps", None, dim).select(*key, "span", "alpha", "beta", "gamma", "d")
    return joins.on_spans(spanned, vectors, key, "span", dict(zip(("alpha", "beta", "gamma", "d"), default, strict=True)))


def token_vectors_of(songs: DataFrame, key: list[str], dim: DataFrame, default: tuple = DEFAULT_VECTOR) -> DataFrame:
    """token_vectors of (key, toks), a row for each song, as (key, pos, tok, span, alpha, beta, gamma, d).

    A stream is cut into its blocks and what is between them; each piece gets its vector before its tokens become rows.
    """
    names = ("alpha", "beta", "gamma", "d")
    found = songs.select(*key, "toks", sequence.blocks_of(F.col("toks"), START, END).alias("_blocks"))
    piece = lambda span, at, toks: F.struct(span.cast("int").alias("span"), at.cast("int").alias("at"), toks.alias("toks"))
    after = F.concat(F.array(F.lit(1)), F.transform("_blocks", lambda b: b["at"] + F.size(b["toks"])))
    until = F.concat(F.transform("_blocks", lambda b: b["at"]), F.array(F.size("toks") + 1))
    between = F.filter(F.zip_with(after, until, lambda a, b: piece(F.lit(-1), a, F.slice("toks", a, b - a))), lambda p: F.size(p["toks"]) > 0)
    pieces = F.concat(between, F.transform("_blocks", lambda b: piece(b["span"], b["at"], b["toks"])))
    rows = found.select(*key, F.explode(pieces).alias("_p")).select(*key, "_p.span", "_p.at", "_p.toks")
    steps = F.array_sort(F.array_distinct(F.filter(F.transform("toks", note_step), lambda s: s.isNotNull())))
    rows = chord_vectors(rows.withColumn("_steps", F.when(F.col("span") >= 0, steps).otherwise(F.array().cast("array<int>"))), "_steps", None, dim)
    values = [F.when(F.col("span") >= 0, F.coalesce(F.col(c), F.lit(v))).otherwise(F.lit(v)).alias(c) for c, v in zip(names, default, strict=True)]
    told = rows.select(*key, "span", "at", "toks", *values)
    return told.select(*key, "at", "span", *names, F.posexplode("toks").alias("_i", "tok")).select(*key, (F.col("at") - 1 + F.col("_i")).alias("pos"), "tok", "span", *names)


def vector_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n, n_distinct, least and most of each column): how much vectors differ."""
    ends = [f(c).alias(f"{name}_{c}") for c in columns for f, name in ((F.min, "least"), (F.max, "most"))]
    return df.agg(F.count("*").alias("n"), F.countDistinct(F.struct(*columns)).alias("n_distinct"), *ends)


def vector_prior(sequences: DataFrame, sequence_id: str, token: str, columns: list[str], most: int = 2000, seed: int = 0) -> DataFrame:
    """The vectors at chord starts of up to ``most`` sequences, those with the smallest hashes: a stated sample."""
    chosen = sequences.select(sequence_id).distinct().orderBy(F.xxhash64(sequence_id, F.lit(seed)), sequence_id).limit(most)
    return sequences.where(F.col(token) == START).join(chosen, sequence_id, "left_semi").select(sequence_id, *columns)


def drawn_vectors(prior: DataFrame, order: list[str], n: int, seed: int = 0) -> DataFrame:
    """``n`` draws with replacement from a prior, that are the same on each run."""
    return splits.drawn(prior, order, n, seed)


def described_chords(df: DataFrame, steps: str) -> DataFrame:
    """Adds what is known of absolute steps: root, intervals, label, ratios, extras, dissonances at the root and at 220 Hz."""
    root = F.array_min(steps)
    rows = df.withColumn("root_step", root).withColumn("root_hz", music.hertz_of_step(F.col("root_step"))).withColumn("intervals", music.intervals(F.col(steps), F.col("root_step")))
    rows = rows.withColumn("_t", music.chord_tones(F.col("intervals"))).withColumn("_r", music.tone_ratios(F.col("_t")))
    ratios = [F.col(f"_r.{c}") for c in ("alpha", "beta", "gamma")]
    above = lambda base: dissonance.dissonance_of_voices(F.array(base, *[base * r for r in ratios]))
    return rows.withColumns({
        "third": F.col("_t.third"), "fifth": F.col("_t.fifth"), "seventh": F.col("_t.seventh"), "chord_type": music.chord_label(F.col("_t")),
        "alpha": ratios[0], "beta": ratios[1], "gamma": ratios[2], "is_triad": F.col("_t.seventh").isNull(), "extras": music.extra_intervals(F.col("intervals")),
        "d_root": above(F.col("root_hz")), "d_220": above(F.lit(dissonance.BASE_HERTZ)),
        "in_tetrahedron": (ratios[0] <= ratios[1]) & (ratios[1] <= ratios[2]),
    }).drop("_t", "_r")


def named_chords(spark: SparkSession, df: DataFrame, steps: str) -> DataFrame:
    """described_chords with the nearest reference chord of 53 steps and its distance; ``?`` and null outside."""
    known = dissonance.reference_table(spark).where("system = '53-TET' and in_tetrahedron")
    made = joins.nearest_reference(described_chords(df, steps), known, ["alpha", "beta", "gamma"], "nth", "name")
    inside = F.col("in_tetrahedron")
    return made.withColumn("matched_name", F.when(inside, F.col("nearest")).otherwise("?")).withColumn("match_dist", F.when(inside, F.col("distance"))).drop("nearest", "distance")


# --- merging and reading


def merged_levels(events: DataFrame, blocks: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(key, pos, tok, span) of symbols and notes: after each chord's symbols stand the tokens of the block of its number.

    ``events`` has (key, event, chord_idx, toks), with a null chord_idx for what is no chord; ``blocks`` has (key,
    chord_idx, toks). Spans count chords as they begin. The second table has the songs whose counts differ.
    """
    chords = events.where("chord_idx is not null")
    fit, odd = joins.positional(chords.select(*key, "chord_idx", "event"), blocks.select(*key, "chord_idx", F.col("toks").alias("_block")), key, "chord_idx")
    whole = events.join(fit.select(*key, "event", "_block"), [*key, "event"], "left").join(odd.select(*key), key, "left_anti")
    rows = whole.select(*key, "event", F.posexplode(F.concat("toks", F.coalesce("_block", F.array().cast("array<string>")))).alias("_at", "tok"), "chord_idx")
    begun = F.max("chord_idx").over(sequence.before_and_now(key, ["event", "_at"]))
    order = sequence.ordered(key, ["event", "_at"])
    return rows.select(*key, (F.row_number().over(order) - 1).alias("pos"), "tok", F.coalesce(begun, F.lit(-1)).cast("int").alias("span")), odd


def both_levels(df: DataFrame, key: list[str], pos: str = "pos", token: str = "tok") -> DataFrame:
    """(key, chord, root, quality, extensions, bass, duration, pitches, velocities) of a stream of both levels.

    A chord begins at the first dot after the last block's end; its symbols stand before the block, its notes in it. A root
    after a slash is the bass. The symbols' duration counts, else the block's. A dot at the end counts without a block.
    """
    return both_levels_of(sequence.gathered(df, key, pos, token), key)


def _last(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def _after(prefix: str, values: Column) -> Column:
    """What follows a prefix in the values that have it."""
    return F.transform(F.filter(values, lambda t: t.startswith(prefix)), lambda t: F.substr(t, F.lit(len(prefix) + 1)))


def _numbers(values: Column, pattern: str, group: int) -> Column:
    """A group of a pattern as an integer, of the values that match."""
    return F.transform(F.filter(values, lambda t: t.rlike(pattern)), lambda t: F.regexp_extract(t, pattern, group).cast("int"))


def both_levels_of(songs: DataFrame, key: list[str]) -> DataFrame:
    """both_levels of (key, toks), a row for each song."""
    toks = F.col("toks")
    ends = sequence.places(toks, lambda t: t == END)
    pieces = F.zip_with(F.concat(F.array(F.lit(0)), ends), F.concat(ends, F.array(F.size(toks))), lambda a, b: F.slice(toks, a + 1, b - a))
    head = lambda b: F.slice(b, 1, F.when(F.array_position(b, START) > 0, F.array_position(b, START) - 1).otherwise(F.size(b)).cast("int"))
    dotted = F.filter(pieces, lambda b: F.array_position(head(b), ".") > 0)
    rows = songs.select(*key, F.posexplode(dotted).alias("chord", "_b"))
    rows = rows.withColumn("_head", head(F.col("_b")))
    inside = F.slice("_b", F.size("_head") + 1, F.size("_b"))
    rows = rows.select(*key, "chord", F.slice("_head", F.array_position("_head", ".").cast("int"), F.size("_head")).alias("_symbols"), inside.alias("_inside"))
    symbols, inside = F.col("_symbols"), F.col("_inside")
    slashed = lambda i: F.coalesce(F.get("_symbols", i - 1) == "/", F.lit(False))
    roots = F.filter(symbols, lambda t, i: t.startswith("R_") & ~slashed(i))
    basses = F.filter(symbols, lambda t, i: t.startswith("R_") & slashed(i))
    durations = lambda values: F.filter(F.transform(_after("DUR_", values), lambda t: t.try_cast("double")), lambda d: d.isNotNull())
    note = r"^(?:PV|H)_(\d+)_(\d+)$"
    return rows.select(
        *key, F.get(_after("R_", roots), F.lit(0)).alias("root"), _last(_after("Q_", symbols)).alias("quality"), _after("X_", symbols).alias("extensions"), _last(_after("R_", basses)).alias("bass"),
        F.coalesce(_last(durations(symbols)), F.get(durations(inside), F.lit(0))).alias("duration"), _numbers(inside, note, 1).alias("pitches"), _numbers(inside, note, 2).alias("velocities"), "chord",
    )


def chord_summary(df: DataFrame, key: list[str], pos: str = "pos", token: str = "tok", bar: str = "BAR") -> DataFrame:
    """(key, chord, bar_number, root, duration, pitches, velocities) of the blocks of a stream; bars count from the first."""
    return chord_summary_of(sequence.gathered(df, key, pos, token), key, bar)


def _block(toks: Column) -> dict[str, Column]:
    note = r"^PV_(\d+)_(\d+)$"
    return {"root": _last(_after("ROOT_", toks)).try_cast("int"), "duration": _last(_after("DUR_", toks)).try_cast("double"), "pitches": _numbers(toks, note, 1), "velocities": _numbers(toks, note, 2)}


def chord_summary_of(songs: DataFrame, key: list[str], bar: str = "BAR") -> DataFrame:
    """chord_summary of (key, toks), a row for each song."""
    blocks = songs.withColumn("_blocks", sequence.blocks_of(F.col("toks")))
    # Bars from the block before to this one; blocks are few beside tokens, so their running sum is a window.
    before = F.concat(F.array(F.lit(0)), F.transform("_blocks", lambda b: b["at"]))
    bars = F.zip_with("_blocks", F.slice(before, 1, F.size("_blocks")), lambda b, a: F.struct(b.alias("b"), F.size(F.filter(F.slice("toks", a + 1, b["at"] - a), lambda t: t.startswith(bar))).alias("bars")))
    rows = blocks.select(*key, F.explode(bars).alias("_x")).select(*key, F.col("_x.b.span").alias("chord"), F.col("_x.bars").alias("_bars"), F.col("_x.b.toks").alias("_toks"))
    made = _block(F.col("_toks"))
    rows = rows.select(*key, "chord", "_bars", *[made[c].alias(c) for c in made])
    return rows.select(*key, "chord", F.sum("_bars").over(sequence.before_and_now(key, ["chord"])).alias("bar_number"), *made)


def readable(df: DataFrame, key: list[str], pos: str = "pos", token: str = "tok") -> DataFrame:
    """(key, line, text): a stream as lines: its start and end, a line for each bar and one for the chords in it."""
    return readable_of(sequence.gathered(df, key, pos, token), key).select(*key, F.posexplode("lines").alias("line", "text"))


def readable_of(songs: DataFrame, key: list[str]) -> DataFrame:
    """(key, lines): readable of (key, toks), a row and an array of lines for each song."""
    mark = lambda t: F.when(t == "<start>", "── START ──").when(t == "<end>", "── END ──").when(t == "BAR", "  |").when(t.startswith("BAR"), F.concat(F.lit("  "), F.replace(t, F.lit("BAR_"), F.lit("Bar "))))
    value = lambda c: F.coalesce(c.cast("string"), F.lit("?"))

    def spoken(toks: Column) -> Column:
        own = _block(toks)
        steps = F.array_join(F.transform(own["pitches"], lambda p: p.cast("string")), ",")
        return F.concat(F.lit("  [root="), value(own["root"]), F.lit(" | steps="), F.coalesce(F.nullif(steps, F.lit("")), F.lit("—")), F.lit(" | dur="), value(own["duration"]), F.lit("]"))

    item = lambda at, text, marked: F.struct(at.cast("int").alias("at"), text.alias("text"), F.lit(marked).alias("mark"))
    marks = F.filter(F.transform("toks", lambda t, i: item(i + 1, mark(t), True)), lambda x: x["text"].isNotNull())
    rows = songs.withColumn("_blocks", sequence.blocks_of(F.col("toks"))).select(*key, marks.alias("_marks"), F.transform("_blocks", lambda b: item(b["at"], spoken(b["toks"]), False)).alias("_spoken"))
    rows = rows.select(*key, F.array_sort(F.concat("_marks", "_spoken")).alias("_items"))
    # A mark is a line, and so is what is spoken between two.
    own_line = lambda x, i: x["mark"] | (i == 0) | F.coalesce(F.get("_items", i - 1)["mark"], F.lit(False))
    rows = rows.withColumn("_at", F.filter(F.transform("_items", lambda x, i: F.when(own_line(x, i), i + 1)), lambda i: i.isNotNull()))
    text = lambda a, b: F.array_join(F.transform(F.slice("_items", a, F.coalesce(b, F.size("_items") + 1) - a), lambda x: x["text"]), "")
    return rows.select(*key, F.zip_with("_at", F.slice("_at", 2, F.size("_at")), text).alias("lines"))


def readable_chords(df: DataFrame, key: list[str], pos: str = "pos", token: str = "tok") -> DataFrame:
    """(key, chord, text): the tokens of each chord but its duration and numbers, joined by spaces, up to what ends it."""
    return readable_chords_of(sequence.gathered(df, key, pos, token), key)


def readable_chords_of(songs: DataFrame, key: list[str]) -> DataFrame:
    """readable_chords of (key, toks), a row for each song."""
    stops = (".", "|", ":|", "|:", "N.C.", "<end>")
    ends = lambda t: F.coalesce(t.isin(*stops) | t.startswith("Form_"), F.lit(False))
    bodies = F.transform(sequence.chords_of(F.col("toks")), lambda c: F.slice(c, 3, F.size(c)))
    whole = F.transform(bodies, lambda c: F.slice(c, 1, F.coalesce(F.array_min(sequence.places(c, ends)) - 1, F.size(c)).cast("int")))
    kept = F.filter(F.transform(whole, lambda c: F.filter(c, lambda t: ~music.is_duration(t))), lambda c: F.size(c) > 0)
    return songs.select(*key, F.posexplode(F.transform(kept, lambda c: F.array_join(c, " "))).alias("chord", "text"))


def chord_symbols(df: DataFrame, key: list[str], ignore: list[str], pos: str = "pos", token: str = "tok", header: int = 4) -> DataFrame:
    """(key, nth, symbol): chords of a stream in one word each, an extension after a space, ``dom7`` as ``7``.

    A chord ends at a dot, a bar or the end; durations, ignored tokens and the header's are left out.
    """
    ends = (".", "|", ":|", "<end>")
    tok = F.col(token)
    rows = df.where(F.col(pos) >= header).where(tok.isin(*ends) | ~(tok.isin(*ignore) | music.is_duration(tok)))
    rows = sequence.running_count(rows, key, [pos], tok.isin(*ends), "_g")
    # What begins after an end but isn't followed by one is not a chord yet.
    rows = rows.withColumn("_all", F.max("_g").over(Window.partitionBy(*key))).where(~tok.isin(*ends) & (F.col("_g") < F.col("_all")))
    part = F.when(tok == "dom7", "7").when(tok.contains("add") | tok.contains("subtract") | tok.contains("alter"), F.concat(F.lit(" "), tok)).otherwise(tok)
    made = rows.withColumn("_t", part).groupBy(*key, "_g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, "_t"))), lambda r: r["_t"]), "").alias("symbol"))
    return made.select(*key, (F.row_number().over(sequence.ordered(key, ["_g"])) - 1).alias("nth"), "symbol")


def refilled(reference: DataFrame, replacements: DataFrame, key: list[str], keep: Column, pos: str = "pos", token: str = "tok") -> DataFrame:
    """(key, pos, tok): a reference stream whose tokens, but those to ``keep``, are the replacements in their order.

    Where replacements run out the stream ends.
    """
    kept = reference.withColumn("_keep", keep)
    numbered = sequence.running_count(kept, key, [pos], ~F.col("_keep"), "_n")
    given = replacements.select(*key, (F.row_number().over(sequence.ordered(key, [pos]))).alias("_n"), F.col(token).alias("_given"))
    # A kept token has the number of the replacement before it, which tells whether the stream has ended.
    joined = numbered.join(given, [*key, "_n"], "left")
    return joined.where((F.col("_keep") & ((F.col("_n") == 0) | F.col("_given").isNotNull())) | F.col("_given").isNotNull()).select(*key, pos, F.when(F.col("_keep"), F.col(token)).otherwise(F.col("_given")).alias(token))


def coda_end_moved(tokens: Column) -> Column:
    """The first ``e||`` becomes a bar line, the next bar line ``e||``; before a closing repeat that comes first it is put in."""
    at = (F.array_position(tokens, "e||") - 1).cast("int")
    nxt = F.array_min(F.filter(F.transform(tokens, lambda t, i: F.when((i > at) & t.isin("|", ":|"), i)), lambda i: i.isNotNull()))
    one = lambda t, i: F.when(i == at, F.array(F.lit("|"))).when((i == nxt) & (t == "|"), F.array(F.lit("e||"))).when(i == nxt, F.array(F.lit("e||"), t)).otherwise(F.array(t))
    return F.when(F.array_contains(tokens, "e||"), F.flatten(F.transform(tokens, one))).otherwise(tokens)


def until_beats(df: DataFrame, key: list[str], order: list[str], duration: str, most: float) -> DataFrame:
    """Chords up to and with the one by which a number of beats is reached."""
    before = F.coalesce(F.sum(duration).over(sequence.ordered(key, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return df.withColumn("_before", before).where(F.col("_before") < most).drop("_before")


def prompts(wanted: DataFrame, vocabulary: DataFrame, tonality: str = "C_major", form: str = "A", root: str = "E", duration: str = "4.0") -> DataFrame:
    """(style, type, pos, tok, known) of (style, type, quality): a header and a first chord, and whether a vocabulary has each."""
    lit = F.lit
    parts = F.array(
        lit("<start>"), lit("<style>"), F.concat(lit("STYLE_"), "style"), lit("<tonality>"), lit(f"TONALITY_{tonality}"), F.concat(lit("TYPE_"), "type"), lit(f"FORM_{form}"), lit("|:"),
        lit("."), lit(f"DUR_{duration}"), lit(f"R_{root}"), F.concat(lit("Q_"), "quality"),
    )
    rows = wanted.select("style", "type", F.posexplode(parts).alias("pos", "tok"))
    known = joins.small(vocabulary.select(F.col("tok").alias("_tok"), lit(True).alias("known")))
    return rows.join(known, F.col("tok") == F.col("_tok"), "left").drop("_tok").withColumn("known", F.coalesce("known", lit(False)))


# --- whole songs


def encoded_songs(chords: DataFrame, key: str, least: int = 3, most: int = 2, prefix: str = "PV") -> DataFrame:
    """The token stream of each song's chords (key, onset, duration, notes) after they were cleaned."""
    return encoded_arrays(chords, key, least, most, prefix).select(key, F.posexplode("toks").alias("pos", "tok"))


def encoded_arrays(chords: DataFrame, key: str, least: int = 3, most: int = 2, prefix: str = "PV") -> DataFrame:
    """encoded_songs as (key, toks), a row for each song."""
    return sequence.encoded_arrays(recurrent.clean_chords(chords, key, least, most, with_notes=True), [key], prefix=prefix)


def preprocessed_songs(chords: DataFrame, key: str, metadata: DataFrame, dim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, pos, tok, span, vector columns, type_label, style_label), and the songs whose blocks aren't as many as chords.

    ``metadata`` has (key, type_label, style_label); songs without a row have ``unknown`` and null.
    """
    cleaned = recurrent.clean_chords(chords, key, with_notes=True)
    stream = token_vectors(sequence.encode_chords(cleaned, [key]), [key], dim)
    counts = cleaned.groupBy(key).agg(F.count("*").alias("n_chords")).join(stream.groupBy(key).agg((F.max("span") + 1).alias("n_blocks")), key, "full")
    labelled = stream.join(metadata.select(key, "type_label", "style_label"), key, "left").withColumn("type_label", F.coalesce("type_label", F.lit("unknown")))
    return labelled, counts.where(~F.col("n_chords").eqNullSafe(F.col("n_blocks")))


def packed(tokens: Column, length: int, pad) -> Column:
    """(values, fits): a token array filled up to a length, and whether it was no longer than that."""
    return F.struct(sequence.pad_or_cut(tokens, length, pad).alias("values"), (F.size(tokens) <= length).alias("fits"))


def corpus_rows(df: DataFrame, key: list[str], tokens: str, length: int, header: int = 2, start: str = "<start>", end: str = "<end>", pad: str = "<pad>") -> DataFrame:
    """(key, values, fits): header, then the parts of each chord symbol, wrapped in start and end and filled up."""
    from ostinato.functions import spelling

    body = spelling.chord_tokens(F.slice(F.col(tokens), header + 1, F.greatest(F.size(tokens) - header, F.lit(0))))
    whole = sequence.wrapped(F.concat(F.slice(F.col(tokens), 1, header), body), start, end)
    return df.select(*key, packed(whole, length, pad).alias("_p")).select(*key, "_p.values", "_p.fits")


def merged_steps(own: Column, others: Column) -> Column:
    """The notes of both by step, those of ``own`` where a step is in both; ascending."""
    known = F.transform(own, lambda n: n["step"])
    return F.array_sort(F.concat(own, F.filter(others, lambda n: ~F.array_contains(known, n["step"]))))


def twelve_tone_notes(pitches: Column, offset: int = dims.LOWEST_STEP, base: int = 36) -> Column:
    """The distinct MIDI notes nearest to steps above an offset, ascending."""
    note = lambda p: F.least(F.greatest(F.rint((p - offset) * 12 / dims.STEPS).cast("int") + base, F.lit(0)), F.lit(127))
    return F.array_sort(F.array_distinct(F.transform(pitches, note)))


def twelve_tone_messages(chords: DataFrame, key: list[str], ticks_per_beat: int = 480, velocity: int = 80) -> DataFrame:
    """(key, nth, delta, type, channel, note, value) of chord_summary: all notes of a chord at once, then their ends.

    The first end has the chord's length as its delta. Chords without notes or a duration are left out.
    """
    rows = chords.where((F.size("pitches") > 0) & F.col("duration").isNotNull()).withColumn("_notes", twelve_tone_notes(F.col("pitches")))
    ticks = (F.col("duration") * ticks_per_beat).cast("long")
    message = lambda kind, value, first: F.transform("_notes", lambda n, i: F.struct(F.when(i == 0, first).otherwise(F.lit(0)).cast("long").alias("delta"), F.lit(kind).alias("type"), F.lit(0).alias("channel"), n.alias("note"), F.lit(value).alias("value")))
    rows = rows.withColumn("_first", F.coalesce(F.sum(F.size("_notes") * 2).over(sequence.ordered(key, ["chord"]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    spread = rows.select(*key, "_first", F.posexplode(F.concat(message("on", velocity, F.lit(0)), message("off", 0, ticks))).alias("_i", "m"))
    return spread.select(*key, (F.col("_first") + F.col("_i")).cast("int").alias("nth"), "m.*")
