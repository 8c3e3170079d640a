"""Where written intermediates go: a folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``.

    Where that is unset, a session inside one machine gets a local folder (and
    the setting); a cluster's session is refused, as its executors would each
    write to a disk of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        root = "file://" + tempfile.mkdtemp(prefix="cohortwise-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/cohortwise-{uuid.uuid4().hex}"
