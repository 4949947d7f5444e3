"""Session helpers: shared folder, shipping the package to workers, time literals."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_SCOPE = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without the setting gets a folder of its own; on a
    cluster a missing setting is an error, because a machine-local folder would
    not outlive the machine.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="presswork-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/presswork/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a written intermediate table."""
    scope = getattr(_SCOPE, "name", "tables")
    return f"{_scratch_root(spark)}/{scope}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch_scope(spark: SparkSession):
    """Intermediate tables made inside, in this thread, are deleted at the end.

    For work that has stored its results when the block ends, such as a micro-batch.
    """
    before = getattr(_SCOPE, "name", "tables")
    _SCOPE.name = f"scope-{uuid.uuid4().hex}"
    try:
        yield
    finally:
        remove_path(spark, f"{_scratch_root(spark)}/{_SCOPE.name}")
        _SCOPE.name = before


def cut_lineage(df):
    """Reliable checkpoint: survives lost executors and keeps looped plans short."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df, name: str):
    """Write a table to the shared folder and read it back.

    For steps that read an expensive or wide result more than once: it is computed once,
    outlives its executors, and later reads take only the columns they need.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; call it when their readers are done."""
    remove_path(spark, _scratch_root(spark))


def remove_path(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def ship_package(spark: SparkSession) -> None:
    """Make ``import presswork`` work inside Python workers (once per application)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="presswork-ship-"), "presswork.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("presswork", os.path.relpath(full, root)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def ntz(moment: datetime | str) -> Column:
    """A zone-free timestamp literal; every "now" in this package is passed in as one."""
    text = moment if isinstance(moment, str) else moment.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")
