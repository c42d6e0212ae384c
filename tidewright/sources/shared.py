"""The folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's ``spark.checkpoint.dir``; a temporary one only where that is unset and
    driver and executors are one process."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return f"{found.get()}/{name}-{uuid.uuid4().hex}"
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{named or os.path.join(tempfile.gettempdir(), 'tidewright')}/{name}-{uuid.uuid4().hex}"
