"""Tables and folders that the driver and all executors share."""

from __future__ import annotations

import math
import os
import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ID, TEXT = "_id", "_text"
#: Most bytes of an Arrow batch sent to a Python worker; a single longer row is a batch of its own.
BATCH_BYTES = 4 << 20
#: Rows of ids and numbers in a checkpoint's file.
FILE_ROWS = 50_000


def folder(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, or one of our own where that is unset (tests on one machine); unset on a cluster, it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not at:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = getattr(folder, "own", None) or f"file://{tempfile.mkdtemp(prefix='trialforge-')}"
        folder.own = at
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(at)
    return at


def new_path(spark: SparkSession, name: str) -> str:
    return os.path.join(folder(spark), f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """The frame, written once to the shared folder and read back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    _gathered(df, rows, False).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def cut(df: DataFrame, rows: int | None = None, apart: bool = False) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    folder(df.sparkSession)
    return _gathered(df, rows, apart).checkpoint(eager=True)


def _gathered(df: DataFrame, rows: int | None, apart: bool) -> DataFrame:
    """A table known to have ``rows`` rows at most is not spread over more files than these need; with ``apart`` the work before stays spread as it is."""
    n = partitions(df.sparkSession)
    if rows is None or rows > FILE_ROWS * (n - 1):
        return df
    own = max(1, math.ceil(rows / FILE_ROWS))
    return df.repartition(own) if apart else df.coalesce(own)


def texts(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Id and text under internal names, so that no other column of the table can clash.

    Arrow batches of the session are bounded in bytes from here on: by rows alone, a batch of long texts would be held twice, in the JVM and the worker.
    """
    conf = docs.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs.select(docs[id_col].alias(ID), docs[text_col].alias(TEXT), *more)


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores in front until no column is called so (Spark compares without case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """A-Z only; the fast path is taken where a text is ASCII throughout."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
