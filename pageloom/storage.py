"""What driver and executors share: tables that cut lineage, and the library itself."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, else the one set on the context; a folder of our own only on a local master."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pageloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def in_place(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder that keeps each row in its partition; its size is still what was guessed.

    For tasks that take a partition as it is. Anything that is joined is ``checkpointed``: of rows that a generator makes,
    or that a union adds to, the guess is too low, and a table of any size is broadcast.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def checkpointed(df: DataFrame) -> DataFrame:
    """``written``: it cuts lineage, no lost executor makes it recompute, and joins see its true size."""
    return written(df)


def written(df: DataFrame) -> DataFrame:
    """The table written as Parquet in the shared folder and read again; later joins see its true size."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def remove(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing will read again: what was made of them has itself been written."""
    for df in tables:
        if path := df.__dict__.get("written_to"):
            spark = df.sparkSession
            file = spark._jvm.org.apache.hadoop.fs.Path(path)
            file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the library to the executors' Python, once an application: operators with Python tasks call it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="pageloom-"), f"{package.name}-core.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
