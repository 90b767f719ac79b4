"""Session helpers: table access and lineage cuts in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders that ``cut`` has written in this process and nobody has released.
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table (file or directory) of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_list(df: DataFrame, most: int, what: str) -> list:
    """All rows of a list held to be short; more than ``most`` are an error, none is dropped."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows of {what}")
    return rows


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none (tests, local mode) a local temporary
    folder is made and remembered in the session.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("folioforge.scratch", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="folioforge-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("folioforge.scratch", at)
    return at.rstrip("/")


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The lineage ends at the files, which outlive any executor; the columns keep
    their types. Used where several later passes read the same rows. The files
    stay until ``release`` or the end of a ``scratch`` block: the frames built on
    them are lazy and may be read at any time before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete what ``cut`` has written, once no frame built on it is needed any more."""
    hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    for path in list(_written if paths is None else paths):
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(hadoop).delete(place, True)
        _written.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A block whose intermediate files go when it ends: write or collect the results inside it."""
    before = set(_written)
    try:
        yield
    finally:
        release(spark, [p for p in _written if p not in before])
