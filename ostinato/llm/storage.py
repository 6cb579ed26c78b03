"""Where intermediate tables and files go: the shared folder that the session names, never a machine's own."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def local(spark: SparkSession) -> bool:
    """Whether driver and executors are processes of one machine."""
    return spark.conf.get("spark.master", "").startswith("local")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset, in a local session, a new temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="ostinato-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared folder, so that what follows neither recomputes it nor depends on an executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """The URI of a folder of its own below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once to a folder of its own in columns, which take less room than a checkpoint's rows, and read from there."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI, or of a plain path, and the path in it; works on the driver and in tasks."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Only the wanted columns, nulls for those that are missing: an operator's own names never clash with a table's."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in wanted])
