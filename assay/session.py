"""What a session needs besides Spark's own settings."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_folders: dict[str, str] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        here = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{here.name}", "zip", here.parent, here.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a temporary one only in local sessions without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _folders.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="shared-"))


def cut(df: DataFrame) -> DataFrame:
    """df, written as a table to the shared folder and read from there, so that later plans begin at it.

    What is read as one partition is known to be one, so that small tables are not shuffled.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    return out.coalesce(1) if out.rdd.getNumPartitions() == 1 else out


def drop(df: DataFrame) -> None:
    """Forget a table that `cut` has written, and remove its folder; nothing may read it later."""
    df.unpersist()
    session = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = session._jvm.org.apache.hadoop.fs.Path(file)
        if path.getName().startswith("table-"):
            path.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
