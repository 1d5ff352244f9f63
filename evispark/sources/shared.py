"""Tables that outlive a query: where they lie, what they are made of, and how they appear whole or not at all."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The folders of local sessions that name none, by application.
_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; a local session without one gets its own, a cluster must set it."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        app = spark.sparkContext.applicationId
        known = _OWN[app] = _OWN.get(app) or tempfile.mkdtemp(prefix="evispark-")
    return known.rstrip("/")


def version(rows: DataFrame) -> str:
    """A digest of the files that rows (read from files) come from: path, length and time of each, added up without order."""
    m = F.col("_metadata")
    files = rows.select(m["file_path"].alias("p"), m["file_size"].alias("s"), m["file_modification_time"].alias("t")).distinct()
    whole = F.sum(F.conv(F.substring(F.sha2(F.concat_ws("\u0001", "p", "s", "t"), 256), 1, 15), 16, 10).cast("decimal(38, 0)"))
    return hashlib.sha256(repr(tuple(files.agg(F.count("*"), whole).first())).encode()).hexdigest()


def path_of(spark: SparkSession, kind: str, *parts: object) -> str:
    """Where what is made of the parts belongs: a name that another version or parameter changes."""
    return f"{folder(spark)}/evispark-tables/{kind}-{hashlib.sha256(repr(parts).encode()).hexdigest()[:24]}"


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    files, of = _files(spark, path)
    return files.exists(of(path))


def delete(spark: SparkSession, path: str) -> None:
    files, of = _files(spark, path)
    files.delete(of(path), True)


def names(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """The paths of a folder's entries that match the pattern, sorted."""
    files, of = _files(spark, path)
    return sorted(x.getPath().toString() for x in files.globStatus(of(f"{path}/{pattern}")) or [])


def touch(spark: SparkSession, path: str) -> None:
    """An empty file."""
    files, of = _files(spark, path)
    files.create(of(path)).close()


def move(spark: SparkSession, path: str, to: str) -> None:
    """Renames a folder, so that it appears at once; the folder above it is made."""
    files, of = _files(spark, to)
    files.mkdirs(of(to).getParent())
    if not files.rename(of(path), of(to)):
        raise OSError(f"{path} can't be renamed to {to}")


def made_once(spark: SparkSession, path: str, make: Callable[[str], None]) -> str:
    """path, made by make(temporary path) unless it is there: the whole folder is renamed when it is complete.

    Of two sessions that make it at once, the first to finish wins; the other drops its own. What a lost driver leaves
    has another name and is never read.
    """
    if not exists(spark, path):
        own = f"{path}.{uuid.uuid4().hex}"
        make(own)
        files, of = _files(spark, own)
        if exists(spark, path) or not files.rename(of(own), of(path)) or exists(spark, f"{path}/{own.rpartition('/')[2]}"):
            delete(spark, own)
            delete(spark, f"{path}/{own.rpartition('/')[2]}")
    return path
