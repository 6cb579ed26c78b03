"""Sinks: packed sequences, metadata, vocabularies, files per row, and a guard for folders of another method."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.operators import quality


def refuse_foreign_folder(folder: str, own: str, other: str) -> None:
    """Raises where an output folder belongs to another method."""
    parts = folder.rstrip("/").split("/")
    if other in parts and own not in parts:
        raise ValueError(f"{folder} belongs to {other}")


def write_packed(sequences: DataFrame, folder: str, rows_per_file: int = 1 << 16, by: list[str] = []) -> None:  # noqa: B006
    """Packed sequences as Parquet of bounded files, by split or type where wanted."""
    sequences.write.mode("error").option("maxRecordsPerFile", rows_per_file).partitionBy(*by).parquet(folder)


def packed_meta(vectors: DataFrame, sequences: DataFrame, columns: list[str], skipped: DataFrame, **settings) -> DataFrame:
    """One row: counts, mean and deviation of each vector column over all positions, skip counters and settings."""
    counted = sequences.agg(F.count("*").alias("n_sequences"), F.sum(F.size("values")).alias("n_tokens"))
    stats = quality.vector_stats(vectors, columns).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dim", F.struct("mean", "std"))))).alias("vector_stats"))
    skips = skipped.groupBy("reason").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("skipped"))
    return counted.crossJoin(stats).crossJoin(skips).withColumns({k: F.lit(v) for k, v in settings.items()})


def write_meta(meta: DataFrame, folder: str) -> None:
    meta.coalesce(1).write.mode("error").json(folder)


def write_vocabulary(vocabulary: DataFrame, folder: str, **config) -> None:
    """(tok, id), of some thousand rows, as one JSON document with its settings."""
    packed = vocabulary.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tok", "id")))).alias("token_to_id"))
    packed.withColumn("config", F.struct(*[F.lit(v).alias(k) for k, v in config.items()] or [F.lit(1).alias("version")])).coalesce(1).write.mode("error").json(folder)


def write_files(df: DataFrame, folder: str, name: str, content: str) -> DataFrame:
    """Writes a binary column to one file per row, named by another column, and returns (path, bytes) when it is acted on.

    Files go through Arrow's file systems into a shared store. A task that is run again writes the same names again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        for batch in batches:
            paths, sizes = [], []
            for own, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_output_stream(f"{top}/{own}", compression=None) as out:
                    out.write(data)
                paths.append(f"{folder}/{own}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_pydict({"path": paths, "bytes": sizes}, schema=pa.schema([("path", pa.string()), ("bytes", pa.int64())]))

    return df.select(F.col(name).cast("string"), F.col(content)).mapInArrow(run, "path string, bytes long")


def write_sidecars(tokens: DataFrame, folder: str) -> None:
    """(type, song, pos, tok) as a text table, a line of JSON for each song, in a folder for each type."""
    lines = tokens.groupBy("type", "song").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda r: r["tok"]).alias("tokens"))
    lines.select("type", F.to_json(F.struct("song", "tokens")).alias("value")).write.mode("error").partitionBy("type").text(folder)


def read_packed_sidecars(spark, folder: str) -> DataFrame:
    """(type, song, pos, tok) of write_sidecars."""
    lines = spark.read.option("basePath", folder).text(folder)
    parsed = lines.select("type", F.from_json("value", "song string, tokens array<string>").alias("r"))
    return parsed.select("type", "r.song", F.posexplode("r.tokens").alias("pos", "tok"))


def write_vectors(vectors: DataFrame, folder: str, by: list[str] = []) -> None:  # noqa: B006
    """(song, chord_idx, alpha, beta, gamma, d) as a table, in a folder for each value of ``by``; one write for all songs."""
    kept = [*by, *[c for c in ("song", "chord_idx", "alpha", "beta", "gamma", "d") if c not in by]]
    vectors.select(*kept).write.mode("error").partitionBy(*by).parquet(folder)


def unwritten(work: DataFrame, folder: str, key: str) -> DataFrame:
    """What of ``work`` is not in a table that was written before: a run that is begun again goes on from there."""
    try:
        done = work.sparkSession.read.parquet(folder).select(key).distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # the folder isn't there on the first run
            raise
        return work
    return work.join(done, key, "left_anti")


def song_metadata(rows: DataFrame, name: str) -> DataFrame:
    """(file, content): a JSON document for each row, in a file by its sanitised name."""
    from ostinato.functions.spelling import safe_file_name

    return rows.select(F.concat(safe_file_name(F.col(name)), F.lit(".json")).alias("file"), F.encode(F.to_json(F.struct(*rows.columns)), "utf-8").alias("content"))


def write_song_metadata(rows: DataFrame, name: str, folder: str) -> DataFrame:
    """(path, bytes) of the files to which song_metadata is written, when acted on; of equal names the last written stays."""
    return write_files(song_metadata(rows, name), folder, "file", "content")


def dataset_stats(tokens: DataFrame, key: str, token: str, top: int = 20) -> DataFrame:
    """One row: songs, tokens, length statistics, distinct tokens and the most frequent ones."""
    lengths = tokens.groupBy(key).agg(F.count("*").alias("n"))
    counted = lengths.agg(F.count("*").alias("n_songs"), F.sum("n").alias("n_tokens"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.round(F.avg("n"), 1).alias("mean"))
    distinct = tokens.agg(F.countDistinct(token).alias("n_distinct"))
    best = quality.frequencies(tokens, token, top).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), F.col(token).alias("tok")))).alias("_b"))
    return counted.crossJoin(distinct).crossJoin(best.select(F.transform("_b", lambda b: F.struct(b["tok"].alias("tok"), (-b["minus"]).alias("n"))).alias("top")))


def clip_manifest(clips: DataFrame, ratings: DataFrame, key: str, group: str) -> DataFrame:
    """(group, clips): nested clips with their ratings, by key, as one document for each group."""
    rated = ratings.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c for c in ratings.columns if c != key]))).alias("ratings"))
    rows = clips.join(rated, key, "left")
    return rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(key, *[c for c in rows.columns if c not in (key, group)]))).alias("clips"))


def write_json(df: DataFrame, folder: str) -> None:
    """Rows as lines of JSON: samples, manifests and indexes."""
    df.write.mode("error").json(folder)
