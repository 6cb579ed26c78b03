"""Files as data sources, and sinks that commit: balance, pruning, broken files, tasks that fail and drivers that stop."""

from __future__ import annotations

import os
import subprocess
import sys
import textwrap
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringStartsWith
from pyspark.sql.types import StructType

from ostinato.sources import charts, datasources, midi


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    datasources.register(spark)


def song(n):
    return [(float(k), 1.0, [(100 + n + k, 64)]) for k in range(4)]


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(f"s{n:02d}", *chord) for n in range(12) for chord in song(n)]
    df = spark.createDataFrame(rows, "song string, onset double, duration double, notes array<struct<step: int, velocity: int>>")
    files = midi.as_files(df, "song").select(F.concat("song", F.lit(".mid")).alias("name"), "content")
    files.write.format("midi").mode("append").save(str(tmp_path / "notes"))
    return tmp_path / "notes"


def test_what_is_written_is_read_as_by_whole_files(spark, folder):
    assert sorted(p.name for p in folder.iterdir()) == [f"s{n:02d}.mid" for n in range(12)]
    plain = midi.read_messages(spark, str(folder)).drop("path")
    made = spark.read.format("midi").option("bytesPerPartition", 4096).load(str(folder))
    assert made.schema == StructType.fromDDL(midi.MESSAGES) and made.rdd.getNumPartitions() == 3
    assert sorted(map(repr, made.drop("path").collect())) == sorted(map(repr, plain.collect()))
    assert {r["path"] for r in made.select("path").distinct().collect()} == {str(p) for p in folder.iterdir()}
    slim = spark.read.format("midi").schema("path string, tick long").load(str(folder))
    assert slim.columns == ["path", "tick"] and slim.count() == made.count()


def test_files_are_dealt_by_bytes():
    parts = datasources.balanced([("a", 9000), ("b", 5000), ("c", 4000), ("d", 10), ("e", 0)], 10_000)
    assert sorted(x for p in parts for x in p) == list("abcde") and len(parts) == 3
    assert ["a"] in parts and datasources.balanced([], 10) == []


def test_a_filter_on_paths_chooses_files(spark, folder):
    first = str(folder / "s00.mid")
    for wanted, n in ((EqualTo(("path",), first), 1), (In(("path",), (first, "other")), 1), (StringStartsWith(("path",), str(folder / "s0")), 10), (EqualTo(("tick",), 3), 12)):
        reader = datasources.FileRowsReader(StructType.fromDDL(midi.MESSAGES), {"path": str(folder)}, midi.messages, "*.mid")
        assert list(reader.pushFilters([wanted])) == [wanted]
        assert sum(len(p.paths) for p in reader.partitions()) == n
    made = spark.read.format("midi").load(str(folder)).where(F.col("path") == first)
    assert made.count() == made.where(F.col("path") == first).count() > 0


def test_broken_files(spark, folder):
    (folder / "broken.mid").write_bytes(b"MThd")
    (folder / "_hidden.mid").write_bytes(b"MThd")
    read = lambda mode: spark.read.format("midi").option("mode", mode).load(str(folder))
    good = midi.read_messages(spark, str(folder), "s*.mid").count()
    assert read("permissive").where("error is not null").count() == 1 and read("permissive").count() == good + 1
    assert read("dropmalformed").count() == good
    with pytest.raises(PySparkException, match="broken.mid"):
        read("failfast").count()
    with pytest.raises(PySparkException, match="no such mode"):
        read("loose").count()


def test_no_files(spark, tmp_path):
    assert spark.read.format("midi").load(str(tmp_path)).count() == 0


def test_charts_and_harmonies(spark, tmp_path):
    text = """<score-partwise xmlns="x"><part><measure><attributes><divisions>2</divisions></attributes><harmony><root><root-step>C</root-step></root>
    <kind text="maj7">major-seventh</kind></harmony><note><duration>8</duration></note></measure></part></score-partwise>"""
    (tmp_path / "a.xml").write_text(text)
    (tmp_path / "b.musicxml").write_text("<broken")
    for name, plain in (("chart", charts.read_charts), ("harmony", charts.read_harmonies)):
        made, want = spark.read.format(name).load(str(tmp_path)), plain(spark, str(tmp_path))
        assert made.columns == want.columns
        assert sorted(map(repr, made.drop("path").collect())) == sorted(map(repr, want.drop("path").collect()))


def save(df, where, mode="append"):
    df.write.format("namedfiles").mode(mode).save(str(where))


def files(spark, rows):
    return spark.createDataFrame(rows, "name string, content binary")


def listed(where: Path):
    return {str(p.relative_to(where)): p.read_bytes() for p in where.rglob("*") if p.is_file() and datasources.STAGING not in p.parts} if where.exists() else {}


def test_names_stay_apart(spark, tmp_path):
    save(files(spark, [("a/x", b"1"), ("y", None), ("z", b"3")]), tmp_path)
    assert listed(tmp_path) == {"a/x": b"1", "y": b"", "z": b"3"}
    with pytest.raises(PySparkException, match="there already"):
        save(files(spark, [("z", b"4"), ("new", b"5")]), tmp_path)
    with pytest.raises(PySparkException, match="have the name n"):
        save(files(spark, [("n", b"4"), ("n", b"5")]).repartition(2), tmp_path)
    for name in ("../up", "/root", "_hidden", "", None):
        with pytest.raises(PySparkException, match="not a name"):
            save(files(spark, [("fine", b"1"), (name, b"4")]), tmp_path)
    assert listed(tmp_path) == {"a/x": b"1", "y": b"", "z": b"3"}
    save(files(spark, [("z", b"6"), ("q", b"7")]), tmp_path, "overwrite")
    assert listed(tmp_path) == {"z": b"6", "q": b"7"}
    save(files(spark, []), tmp_path)
    assert listed(tmp_path) == {"z": b"6", "q": b"7"}


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    rows = spark.range(0, 400, 1, 8).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") == 399, F.raise_error(F.lit("stop")).cast("binary")).otherwise(F.lit(b"x")).alias("content"))
    with pytest.raises(PySparkException):
        save(rows, tmp_path)
    assert listed(tmp_path) == {}
    datasources.finish_commits(str(tmp_path))  # also what tasks wrote while they were being stopped
    assert not (tmp_path / "_staging").exists()


def test_a_task_that_fails_once_is_written_once(tmp_path):
    program = textwrap.dedent("""
        import os, sys
        from collections.abc import Iterator
        import pyarrow as pa
        from pyspark.sql import SparkSession
        from ostinato.sources import datasources
        out, marker = sys.argv[1:]
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
        datasources.register(spark)

        def fails_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for k in range(0, len(ids), 10):
                    if 250 in ids[k : k + 10] and not os.path.exists(marker):
                        open(marker, "w").close()
                        raise RuntimeError("once")
                    part = ids[k : k + 10]
                    yield pa.RecordBatch.from_pydict({"name": [f"{i}" for i in part], "content": [f"text {i}".encode() for i in part]})

        spark.range(0, 300, 1, 3).mapInArrow(fails_once, "name string, content binary").write.format("namedfiles").mode("append").save(out)
    """)
    out, marker = tmp_path / "out", tmp_path / "failed"
    done = subprocess.run([sys.executable, "-c", program, str(out), str(marker)], capture_output=True, text=True, env=os.environ, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]
    assert marker.exists()
    assert listed(out) == {str(i): f"text {i}".encode() for i in range(300)} and not (out / "_staging").exists()


def test_a_driver_that_stops_while_it_moves(tmp_path, monkeypatch):
    import pyarrow as pa

    def staged(names):
        writer = datasources.NamedFilesWriter({"path": str(tmp_path)}, False)
        batch = pa.RecordBatch.from_pydict({"name": names, "content": [n.encode() for n in names]})
        return writer, [writer.write(iter([batch])), None]

    writer, messages = staged(["a", "b", "sub/c"])
    lost, _ = staged(["never committed"])

    def stops(store, top, plan):
        first = messages[0].moves[0]
        store.move(first[0], f"{top}/{first[1]}")
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(datasources, "_carry_out", stops)
        writer.commit(messages)
    assert (tmp_path / "a").exists() and not (tmp_path / "b").exists()
    assert datasources.finish_commits(str(tmp_path)) == 3
    assert listed(tmp_path) == {"a": b"a", "b": b"b", "sub/c": b"sub/c"}
    assert datasources.finish_commits(str(tmp_path)) == 0 and lost.job != writer.job


def test_numbers_without_a_header(spark, tmp_path):
    from ostinato.sources import arrays

    rows = spark.range(50).select(F.array(F.col("id").cast("float"), (F.col("id") * 2).cast("float")).alias("values"))
    rows.repartition(3).write.format("rawnumbers").option("kind", "float32").option("width", 2).mode("append").save(str(tmp_path / "n"))
    made = arrays.read_raw(spark, str(tmp_path / "n"), "*.bin", "float32", 2)
    assert sorted(tuple(r["values"]) for r in made.collect()) == [(float(k), 2.0 * k) for k in range(50)]
    with pytest.raises(PySparkException, match="arrays of 2 numbers"):
        spark.createDataFrame([([1.0],)], "values array<float>").write.format("rawnumbers").option("kind", "float32").option("width", 2).mode("append").save(str(tmp_path / "n"))
    assert len(listed(tmp_path / "n")) == 3
