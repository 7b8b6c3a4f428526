"""Makes this package importable on local Python workers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ensure_workers(spark: SparkSession) -> SparkSession:
    """Adds the repository to the workers' module path (a cluster installs the package instead)."""
    own = spark.sparkContext.environment
    paths = [p for p in own.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        own["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset on one machine, below a temporary folder (on a cluster that is an error)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or getattr(shared_path, "own", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = shared_path.own = f"file://{tempfile.mkdtemp(prefix='trialforge-')}"
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
