"""Cutting a plan's lineage so that a lost executor costs a read, not a recomputation."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset and the session runs in this one process (as in tests) it is a folder of this machine,
    which is removed when the process ends. On a cluster, ``spark.cleaner.referenceTracking.cleanCheckpoints`` removes
    checkpoints that no frame needs any more.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cairnfield-checkpoints-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
