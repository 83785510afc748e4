"""Where checkpoints and written tables go."""

from __future__ import annotations

import tempfile
from functools import cache

from pyspark.sql import SparkSession


@cache
def _local_dir(app_id: str) -> str:
    return tempfile.mkdtemp(prefix="packetlens-")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the session names in `spark.checkpoint.dir`, set up for `checkpoint()`.

    A local session that names none gets a temporary folder; a cluster must name one.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = _local_dir(context.applicationId)
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named
