"""Session helpers: table access, lineage cuts in the cluster's shared folder, shipping of this package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own: dict[str, str] = {}
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where a session in one process names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not (spark.conf.get("spark.master", "local") or "local").startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not named:
        named = _own.setdefault("dir", "") or tempfile.mkdtemp(prefix="quern-shared-")
        _own["dir"] = named
    return named.rstrip("/")


def clear() -> None:
    """Removes the tables this process has written so far, on whatever store; results that still read them are lost. Long
    sessions call it between jobs, and it is called at exit."""
    while _written:
        path = _written.pop()
        try:
            jvm = SparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(SparkContext._active_spark_context._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session is gone; a mounted folder can still be cleared
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def _leave() -> None:
    clear()
    if _own.get("dir"):
        shutil.rmtree(_own["dir"], ignore_errors=True)


atexit.register(_leave)


def cut(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: a lineage cut that outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}"
    _written.append(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, which may run elsewhere or without this folder on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quern-ship-")
    atexit.register(shutil.rmtree, folder, True)
    archive = os.path.join(folder, "quern_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def slices(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


