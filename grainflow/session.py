"""A session with the settings that the operators assume."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def session(name: str = "grainflow", **settings: str) -> SparkSession:
    """An adaptive session in UTC; `settings` are further Spark settings, with _ for the dots."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of reliable checkpoints: the session's spark.checkpoint.dir.

    Where that is unset, a local master gets a temporary folder. On a cluster that would be one machine's disk,
    so there it is an error.
    """
    context = spark.sparkContext
    folder = context._jsc.sc().getCheckpointDir()
    if folder.isDefined():
        return folder.get()
    chosen = spark.conf.get("spark.checkpoint.dir", None)
    if not chosen:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        chosen = tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(chosen)
    return context._jsc.sc().getCheckpointDir().get()
