"""Spark data sources for note files and charts, and sinks that commit: ``spark.read.format("midi")`` and the like.

Readers deal whole files to tasks so that each gets about the same bytes, and make only the columns that are asked for.
Writers keep what a task writes in a staging folder; only after all tasks are done does the driver write down what is to
be moved, and move it. So a task that fails, or runs twice, leaves nothing in the folder itself (one that is stopped may
leave staged files, which readers skip), and a driver that stops while it moves leaves a list from which
``finish_commits`` goes on.

Files go through Arrow's file systems. ``register(spark)`` makes the formats known to a session.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ostinato.sources import charts, midi

#: Bytes of files that a task reads, rows of a batch, and moves that the driver has under way at once.
PARTITION_BYTES, BATCH_ROWS, MOVES = 16 << 20, 1 << 14, 16
STAGING = "_staging"


def store_of(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


# --- reading


@dataclass
class Files(InputPartition):
    """Files of one task."""

    paths: list[str]


def balanced(files: list[tuple[str, int]], most_bytes: int) -> list[list[str]]:
    """Files in as many parts as their bytes need, the largest file first, each to the part that has least; at least 1 KB each."""
    weighed = sorted(((max(size, 1024), path) for path, size in files), reverse=True)
    parts = max(1, -(-sum(size for size, _ in weighed) // most_bytes))
    heap: list[tuple[int, int]] = [(0, k) for k in range(min(parts, len(weighed)))]
    made: list[list[str]] = [[] for _ in heap]
    for size, path in weighed:
        total, k = heapq.heappop(heap)
        made[k].append(path)
        heapq.heappush(heap, (total + size, k))
    return [sorted(part) for part in made]


class FileRowsReader(DataSourceReader):
    """Rows of a function of a file's bytes, for all files below a folder whose name matches a pattern.

    Options: ``path``, ``pattern``, ``bytesPerPartition``, and ``mode``: permissive (a file that can't be read is a row
    with ``error``), dropmalformed or failfast. Filters on ``path`` choose files before any is opened.
    """

    def __init__(self, schema: StructType, options, rows: Callable[[bytes], Iterable[dict]], pattern: str):
        self.to, self.rows = to_arrow_schema(schema), rows
        self.folder, self.pattern = options["path"], options.get("pattern", pattern)
        self.most_bytes = int(options.get("bytesPerPartition", PARTITION_BYTES))
        self.mode = options.get("mode", "permissive").lower()
        if self.mode not in ("permissive", "dropmalformed", "failfast"):
            raise ValueError(f"no such mode: {self.mode}")
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith) and f.attribute == ("path",):
                self.wanted.append(f)
            yield f  # Spark still checks each row

    def chosen(self, path: str) -> bool:
        kept = {EqualTo: lambda f: path == f.value, In: lambda f: path in f.value, StringStartsWith: lambda f: path.startswith(f.value)}
        return all(kept[type(f)](f) for f in self.wanted)

    def partitions(self) -> list[Files]:
        store, top = store_of(self.folder)
        prefix = self.folder[: len(self.folder) - len(top)] if self.folder.endswith(top) else ""
        found = store.get_file_info(pafs.FileSelector(top, recursive=True))
        hidden = lambda path: any(p.startswith(("_", ".")) for p in path[len(top) :].split("/"))
        files = [(prefix + f.path, f.size or 0) for f in found if f.is_file and not hidden(f.path) and any(fnmatch(f.base_name, p) for p in self.pattern.split(","))]
        return [Files(p) for p in balanced([f for f in files if self.chosen(f[0])], self.most_bytes) or [[]]]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        names, rows = self.to.names, []
        for path in partition.paths:
            store, own = store_of(path)
            with store.open_input_stream(own, compression=None) as source:
                content = source.read()
            try:
                made = [{**row, "path": path} for row in self.rows(content)]
            except (ValueError, SyntaxError, AttributeError, RecursionError) as e:
                if self.mode == "failfast":
                    raise ValueError(f"{path}: {e}") from e
                made = [{"path": path, "error": f"{type(e).__name__}: {e}"[:200]}] if self.mode == "permissive" else []
            for row in made:
                rows.append({name: row.get(name) for name in names})
                if len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=self.to)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=self.to)


# --- writing


@dataclass
class Staged(WriterCommitMessage):
    """What a task has staged: (staged path, name) pairs, and rows."""

    moves: list[tuple[str, str]]
    rows: int


class StagedWriter(DataSourceArrowWriter):
    """Two phases: tasks stage files below ``_staging/<job>``, the driver moves them, or removes all of them."""

    def __init__(self, options, overwrite: bool):
        self.folder, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex

    def stage(self, batches: Iterator[pa.RecordBatch], store: pafs.FileSystem, top: str) -> Staged:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        store, top = store_of(self.folder)
        own = f"{top}/{STAGING}/{self.job}/{uuid.uuid4().hex}"  # another one for each attempt
        store.create_dir(own, recursive=True)
        return self.stage(iterator, store, own)

    def commit(self, messages: list[Staged | None]) -> None:
        store, top = store_of(self.folder)
        moves = [tuple(m) for message in messages if message for m in message.moves]
        names = [name for _, name in moves]
        if len(set(names)) < len(names):
            self.abort(messages)
            twice = next(n for k, n in enumerate(sorted(names)[1:]) if n == sorted(names)[k])
            raise ValueError(f"two rows have the name {twice}")
        there = {f.path[len(top) + 1 :] for f in store.get_file_info(pafs.FileSelector(top, recursive=True, allow_not_found=True)) if f.is_file}
        there = {name for name in there if not name.startswith("_")}
        old = sorted(there - set(names)) if self.overwrite else []
        if not self.overwrite and (clash := there & set(names)):
            self.abort(messages)
            raise ValueError(f"{sorted(clash)[0]} is there already")
        store.create_dir(f"{top}/{STAGING}", recursive=True)
        plan = f"{top}/{STAGING}/{self.job}.json"
        with store.open_output_stream(f"{plan}.part", compression=None) as out:
            out.write(json.dumps({"job": self.job, "moves": moves, "remove": old}).encode())
        store.move(f"{plan}.part", plan)
        _carry_out(store, top, plan)

    def abort(self, messages: list[Staged | None]) -> None:
        store, top = store_of(self.folder)
        _remove(store, f"{top}/{STAGING}/{self.job}")
        _tidy(store, top)


def _remove(store: pafs.FileSystem, folder: str) -> None:
    if store.get_file_info(folder).type == pafs.FileType.Directory:
        store.delete_dir(folder)


def _tidy(store: pafs.FileSystem, top: str) -> None:
    """Takes the staging folder away once no job uses it."""
    if store.get_file_info(f"{top}/{STAGING}").type == pafs.FileType.Directory and not store.get_file_info(pafs.FileSelector(f"{top}/{STAGING}")):
        store.delete_dir(f"{top}/{STAGING}")


def _carry_out(store: pafs.FileSystem, top: str, plan: str) -> int:
    """Moves what a plan lists and isn't moved yet; the plan goes last."""
    with store.open_input_stream(plan, compression=None) as source:
        listed = json.loads(source.read())
    for folder in sorted({f"{top}/{name}".rpartition("/")[0] for _, name in listed["moves"]}):
        store.create_dir(folder, recursive=True)

    def move(pair: tuple[str, str]) -> None:
        if store.get_file_info(pair[0]).is_file:
            store.move(pair[0], f"{top}/{pair[1]}")

    def remove(name: str) -> None:
        if store.get_file_info(f"{top}/{name}").is_file:
            store.delete_file(f"{top}/{name}")

    with ThreadPoolExecutor(MOVES) as pool:
        list(pool.map(move, listed["moves"]))
        list(pool.map(remove, listed["remove"]))
    _remove(store, f"{top}/{STAGING}/{listed['job']}")
    store.delete_file(plan)
    _tidy(store, top)
    return len(listed["moves"])


def finish_commits(folder: str) -> int:
    """Carries out what a driver had begun to move when it stopped, and drops what was only staged; the files it moved.

    Only for a folder that no job writes to at the time.
    """
    store, top = store_of(folder.rstrip("/"))
    found = store.get_file_info(pafs.FileSelector(f"{top}/{STAGING}", allow_not_found=True))
    moved = sum(_carry_out(store, top, f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith(".json"))
    _remove(store, f"{top}/{STAGING}")
    return moved


class NamedFilesWriter(StagedWriter):
    """A file for each row of (name, content)."""

    def stage(self, batches: Iterator[pa.RecordBatch], store: pafs.FileSystem, top: str) -> Staged:
        moves = []
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if not name or name.startswith(("/", "_", ".")) or ".." in name.split("/"):
                    raise ValueError(f"not a name for a file: {name!r}")
                staged = f"{top}/{len(moves)}"
                with store.open_output_stream(staged, compression=None) as out:
                    out.write(content or b"")
                moves.append((staged, name))
        return Staged(moves, len(moves))


class RawNumbersWriter(StagedWriter):
    """Arrays of ``width`` numbers of a ``kind``, one after another in a file for each task, without a header."""

    def __init__(self, options, overwrite: bool):
        super().__init__(options, overwrite)
        self.kind, self.width = options["kind"], int(options["width"])

    def stage(self, batches: Iterator[pa.RecordBatch], store: pafs.FileSystem, top: str) -> Staged:
        rows, staged = 0, f"{top}/0"
        with store.open_output_stream(staged, compression=None) as out:
            for batch in batches:
                lists = batch.column("values")
                flat = lists.flatten()
                if lists.null_count or flat.null_count or not (np.diff(lists.offsets.to_numpy()) == self.width).all():
                    raise ValueError(f"arrays of {self.width} numbers are needed")
                out.write(flat.to_numpy(zero_copy_only=False).astype(np.dtype(self.kind).newbyteorder("<")).tobytes())
                rows += len(lists)
        return Staged([(staged, f"part-{uuid.uuid4().hex}.bin")] if rows else [], rows)


# --- formats


class MidiSource(DataSource):
    """``midi``: note files as messages; rows of (name, content) are written as files."""

    @classmethod
    def name(cls) -> str:
        return "midi"

    def schema(self) -> str:
        return midi.MESSAGES

    def reader(self, schema: StructType) -> DataSourceReader:
        return FileRowsReader(schema, self.options, midi.messages, "*.mid")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return NamedFilesWriter(self.options, overwrite)


class ChartSource(DataSource):
    """``chart``: MusicXML files as tokens."""

    @classmethod
    def name(cls) -> str:
        return "chart"

    def schema(self) -> str:
        return charts.CHART_ROWS

    def reader(self, schema: StructType) -> DataSourceReader:
        return FileRowsReader(schema, self.options, charts.chart_rows, "*.xml,*.musicxml")


class HarmonySource(DataSource):
    """``harmony``: the harmonies of MusicXML files alone."""

    @classmethod
    def name(cls) -> str:
        return "harmony"

    def schema(self) -> str:
        return charts.HARMONY_ROWS

    def reader(self, schema: StructType) -> DataSourceReader:
        return FileRowsReader(schema, self.options, charts.harmony_rows, "*.xml,*.musicxml")


class NamedFilesSink(DataSource):
    """``namedfiles``: a file for each row of (name, content), such as one JSON document for each song."""

    @classmethod
    def name(cls) -> str:
        return "namedfiles"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return NamedFilesWriter(self.options, overwrite)


class RawNumbersSink(DataSource):
    """``rawnumbers``: arrays in a column ``values`` as binary files; options ``kind`` and ``width``."""

    @classmethod
    def name(cls) -> str:
        return "rawnumbers"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return RawNumbersWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Makes ``midi``, ``chart``, ``harmony``, ``namedfiles`` and ``rawnumbers`` formats of the session; filters on paths are pushed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (MidiSource, ChartSource, HarmonySource, NamedFilesSink, RawNumbersSink):
        spark.dataSource.register(source)
