"""Spark session settings, input tables and durable cuts of the lineage."""

from __future__ import annotations

import atexit
import functools
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int = 8, shuffle: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session as tests and the benchmark use it."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyloom")
        .config("spark.sql.shuffle.partitions", str(shuffle or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.extraJavaOptions", "-XX:+UseParallelGC")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that tasks can import it there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tallyloom-code-")  # the driver serves the file; executors never read this folder
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "tallyloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as pack:
        for place, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(place, name)
                    pack.write(full, os.path.join("tallyloom", os.path.relpath(full, root)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


_shipped: set[str] = set()


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query``, which sends the package first."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent, a local session gets a folder of this process,
    removed at its end; a cluster a folder beside the tables of its warehouse,
    which all its executors reach.  A warehouse that lies on each machine's own
    disk is no such place: then the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        shared = spark.conf.get("spark.sql.warehouse.dir", "").rstrip("/")
        if ":" not in shared or shared.startswith("file:"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        return shared + "/tallyloom-cuts"
    global _own_root
    if _own_root is None or not os.path.isdir(_own_root):
        _own_root = tempfile.mkdtemp(prefix="tallyloom-")
        atexit.register(shutil.rmtree, _own_root, ignore_errors=True)
    return f"file://{_own_root}"


_own_root: str | None = None
_written: set[str] = set()


class Written:
    """A table written to the shared folder: reading it again never recomputes it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    @property
    def schema(self):
        return self._schema

    def drop(self) -> None:
        """Deletes the files; for tables that no later plan reads."""
        _delete(self.spark, self.path)
        _written.discard(self.path)


def write_cut(df: DataFrame, label: str = "cut") -> Written:
    """Writes ``df`` as Parquet into the shared folder, which cuts its lineage.

    The files survive the loss of any executor.  They are deleted by
    ``Written.drop`` or when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_drop_rest, spark)
    _written.add(path)
    out = Written(spark, path)
    out._schema = df.schema
    return out


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    return write_cut(df, label).read()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _drop_rest(spark: SparkSession) -> None:
    for path in list(_written):
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
            continue
        try:
            _delete(spark, path)
        except Exception:
            pass  # the session is gone; the folder's owner clears it
