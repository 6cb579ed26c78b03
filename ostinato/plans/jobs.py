"""Whole jobs, from folders of files to written tables: vectors of a corpus, packed sequences, retuned files.

Each is a plan over all files at once. What can't be read or doesn't fit is counted by reason and left out; what is already
written is not done again. Every function takes options as arguments and can be called from a script of one line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.functions import dims, dissonance
from ostinato.operators import joins, relabel, retune, sequence, splits, streams
from ostinato.sources import charts, midi, sinks


def stem_of(path: Column) -> Column:
    """A file's name without folder and extension."""
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def event_tokens(events: DataFrame) -> DataFrame:
    """Sidecar events with ``toks``: a dot, duration, root, quality, extensions and bass of a chord, or the event's token."""
    some = lambda c, *t: F.when(c, F.array(*t)).otherwise(F.array().cast("array<string>"))
    chord = F.concat(
        F.array(F.lit("."), F.concat(F.lit("DUR_"), F.col("duration").cast("string")), F.concat(F.lit("R_"), "root")), some(F.coalesce(F.col("quality"), F.lit("")) != "", F.concat(F.lit("Q_"), "quality")),
        F.transform("extensions", lambda x: F.concat(F.lit("X_"), x)), some(F.col("slash_bass").isNotNull(), F.lit("/"), F.concat(F.lit("R_"), "slash_bass")),
    )
    return events.withColumn("toks", F.when(F.col("kind") == "chord", chord).otherwise(F.array("token")))


def symbols_of(spark: SparkSession, text_folder: str) -> DataFrame:
    """(stem, event, chord_idx, root, toks) of all sidecars; chord_idx is null for what is no chord."""
    events = event_tokens(charts.sidecar_events(charts.read_sidecars(spark, text_folder))).withColumn("stem", stem_of(F.col("path")))
    nth = F.sum((F.col("kind") == "chord").cast("int")).over(sequence.before_and_now(["stem"], ["event"])) - 1
    return events.select("stem", "event", F.when(F.col("kind") == "chord", nth).cast("int").alias("chord_idx"), "root", "toks")


def chords_of(spark: SparkSession, midi_folder: str) -> DataFrame:
    """(stem, chord_idx, onset, duration, notes) of all note files that can be read."""
    made = midi.chords(midi.read_messages(spark, midi_folder)).withColumn("stem", stem_of(F.col("path")))
    return made.select("stem", (F.row_number().over(sequence.ordered(["stem"], ["onset"])) - 1).alias("chord_idx"), "onset", "duration", "notes")


def build_vectors(spark: SparkSession, midi_folder: str, text_folder: str, out: str) -> DataFrame:
    """Writes the vectors of all songs that have both files and as many chords in each; (reason, n) of the others."""
    symbols = symbols_of(spark, text_folder).where("chord_idx is not null").select("stem", "chord_idx", "root")
    chords = chords_of(spark, midi_folder).select("stem", "chord_idx", F.transform("notes", lambda n: n["step"]).alias("steps"))
    chords = chords.join(sinks.unwritten(chords.select("stem").distinct().withColumnRenamed("stem", "song"), out, "song").withColumnRenamed("song", "stem"), "stem", "left_semi")
    symbols = symbols.join(chords.select("stem").distinct(), "stem", "left_semi")
    made, odd = streams.sidecar_vectors(symbols, chords, ["stem"], dims.note_table(spark), dissonance.dissonance_dim(spark))
    made.withColumnRenamed("stem", "song").select("song", "chord_idx", "alpha", "beta", "gamma", "d").write.mode("append").parquet(out)
    return odd.select(F.when(F.col("n_left") == 0, "no text").otherwise("counts differ").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def merged_songs(spark: SparkSession, midi_folder: str, text_folder: str) -> tuple[DataFrame, DataFrame]:
    """(stem, pos, tok, span) of all songs with both files, symbols and notes together; and those whose counts differ."""
    chords = chords_of(spark, midi_folder)
    encoded = sequence.encode_chords(chords, ["stem"])
    blocks = sequence.inside_blocks(encoded, ["stem"], ["pos"]).groupBy("stem", "span").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda r: r["tok"]).alias("toks"))
    symbols = symbols_of(spark, text_folder)
    both = symbols.select("stem").distinct().join(blocks.select("stem").distinct(), "stem", "left_semi")
    return streams.merged_levels(symbols.drop("root").join(both, "stem", "left_semi"), blocks.withColumnRenamed("span", "chord_idx").join(both, "stem", "left_semi"), ["stem"])


def pack(tokens: DataFrame, vectors: DataFrame, vocabulary: DataFrame, out: str, *, key: str = "stem", length: int = 4097, ratio: float = 0.02, seed: int = 42, skipped: DataFrame | None = None) -> DataFrame:
    """Writes songs (key, pos, tok, span) with their vectors (key, span, alpha, beta, gamma, d) as padded sequences by split.

    A song is for training or validation as a whole. The one row that is returned, and written beside, has counts, the mean
    and deviation of each axis over all positions with padding, and how many songs were skipped for which reason.
    """
    axes = ("alpha", "beta", "gamma", "d")
    rows = joins.encoded(joins.on_spans(tokens, vectors, [key], "span", dict(zip(axes, streams.DEFAULT_VECTOR, strict=True))), vocabulary)
    rows = rows.withColumn("_v", F.struct("id", *axes))
    pieces = rows.withColumn("chunk", F.floor(F.col("pos") / length).cast("int")).groupBy(key, "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "_v"))).alias("_rows"))
    pad = F.struct(F.lit(0).alias("id"), *[F.lit(float(v)).alias(a) for a, v in zip(axes, streams.DEFAULT_VECTOR, strict=True)])
    filled = F.slice(F.concat(F.transform("_rows", lambda r: r["_v"]), F.array_repeat(pad, length)), 1, length)
    split = splits.exact_split(tokens.select(key).distinct(), key, ratio, seed)
    packed = pieces.select(key, "chunk", filled.alias("_f")).join(split, key)
    packed = packed.select("split", key, "chunk", F.transform("_f", lambda x: x["id"]).alias("values"), F.transform("_f", lambda x: F.struct(*[x[a].alias(a) for a in axes])).alias("vectors"))
    sinks.write_packed(packed, out, by=["split"])
    written = tokens.sparkSession.read.parquet(out)
    positions = written.select(F.explode("vectors").alias("v")).select(*[F.col(f"v.{a}").alias(a) for a in axes])
    none = tokens.sparkSession.createDataFrame([], "reason string")
    meta = sinks.packed_meta(positions, written, list(axes), none if skipped is None else skipped, block=length, ratio=ratio, seed=seed)
    sinks.write_meta(meta, f"{out.rstrip('/')}_meta")
    return meta


def retune_corpus(spark: SparkSession, midi_folder: str) -> DataFrame:
    """(stem, scale_type, track, seq, nth, tick, type, channel, note, value) of all note files in every scale type, by the key in their stem."""
    rows = midi.read_messages(spark, midi_folder).where("error is null").withColumn("stem", stem_of(F.col("path")))
    keyed = rows.withColumn("tonic", F.coalesce(relabel.pitch_class_of(retune.key_of_stem(F.col("stem"))["key"]), F.lit(0)))
    scale = dims.scale_table(spark).select(F.col("type").alias("scale_type"), F.col("tonic").alias("_t"), F.col("pc").alias("_pc"), "step")
    types = dims.type_table(spark).select(F.col("type").alias("scale_type"))
    crossed = keyed.crossJoin(F.broadcast(types))
    joined = crossed.join(F.broadcast(scale.withColumnRenamed("scale_type", "_st")), (F.col("scale_type") == F.col("_st")) & (F.col("tonic") == F.col("_t")) & (F.pmod(F.col("note"), F.lit(12)) == F.col("_pc")), "left")
    return retune.retuned_by_scale(joined, ["stem", "scale_type"], ["track", "seq"], F.col("step"))


def relabel_corpus(spark: SparkSession, midi_folder: str, text_folder: str) -> tuple[DataFrame, DataFrame]:
    """(stem, pos, tok) of the charts that belong to note files of a type, relabelled; and (status, n) of all files."""
    files = midi.read_messages(spark, midi_folder).select(stem_of(F.col("path")).alias("stem")).distinct()
    texts = charts.token_lists(charts.read_sidecars(spark, text_folder)).select(stem_of(F.col("path")).alias("base"), "tokens")
    paired, report = relabel.pair_corpus(files, texts)
    rows = paired.select("stem", F.posexplode("tokens").alias("pos", "tok"), "type", relabel.pitch_class_of(F.col("key")).alias("tonic"))
    return relabel.relabelled(rows, ["stem"], relabel.name_dim(spark)), report
