"""The folder that the driver and all executors share: tables that cut lineage in loops, cached results, locks.

Everything an application writes for itself lies in one folder named after it, which cleanup() removes;
cached results and locks lie beside it and outlive it.
"""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset, as in tests, a temporary folder of one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        path = tempfile.mkdtemp(prefix="citegrain-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/run-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str) -> tuple:
    """(Hadoop file system, path) of a path, whatever store it is in."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return bool(fs.exists(p))


def remove(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return bool(fs.delete(p, True))


def cleanup(spark: SparkSession) -> bool:
    """Removes what this application has written for itself: intermediate graphs, hops and scores. Results
    that were returned as such tables must have been saved before."""
    return remove(spark, run_dir(spark))


def cached(spark: SparkSession, name: str, key: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """make()'s result, kept under name and key (which must name everything it depends on) beyond the
    application; made again only if it isn't there whole, or by force."""
    path = f"{shared_dir(spark)}/cache/{name}-{hashlib.sha256(key.encode()).hexdigest()[:24]}"
    if force or not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def version(spark: SparkSession, *paths: str) -> str:
    """What tells states of files apart: their paths, sizes and times of change."""
    out = []
    for path in paths:
        fs, p = file_system(spark, path)
        status = fs.getFileStatus(p)
        files = fs.listStatus(p) if status.isDirectory() else [status]
        out += sorted(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in files)
    return "\n".join(out)


class Locked(RuntimeError):
    """Another run holds the lock."""


@contextmanager
def single_run(spark: SparkSession, name: str) -> Iterator[None]:
    """Holds a lock in the shared folder; a second run of that name is refused, not queued."""
    fs, path = file_system(spark, f"{shared_dir(spark)}/locks/{name}")
    fs.mkdirs(path.getParent())
    try:
        held = fs.createNewFile(path)
    except Exception as e:  # noqa: BLE001  stores differ in how they say that a file exists
        raise Locked(f"{name}: {e}") from e
    if not held:
        raise Locked(f"{name} is running already; remove {path} if it isn't")
    try:
        yield
    finally:
        fs.delete(path, False)


def write_atomically(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file: under another name first, then renamed, so a reader never sees half of it."""
    fs, target = file_system(spark, path)
    _, temporary = file_system(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(temporary)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(temporary, target):
        raise OSError(f"{path} could not be written")
