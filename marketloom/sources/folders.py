"""The folder that the driver and every executor share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new path in ``spark.checkpoint.dir``; the warehouse where that is unset, a temporary folder only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and spark.sparkContext.master.split("[")[0] == "local":
        base = tempfile.mkdtemp(prefix="marketloom-")
    return f"{(base or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{kind}/{uuid.uuid4().hex}"
