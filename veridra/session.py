"""What a session needs before it runs this package."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

SOURCE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package.

    A deployment sends the package with ``--py-files``. On a machine or a shared
    file system this adds the source root to the workers' path.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if SOURCE_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([SOURCE_ROOT, *paths])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.

    Where none is named, a session on one machine, as in tests, gets a temporary folder;
    on a cluster that is an error, as its machines would not see each other's files.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="veridra-"))
    return named or context.getCheckpointDir()
