"""Sending this package to the executors, so that their Python workers can import it from wherever a job is started."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Add the package to the session's files, once a context; not where the workers' path has it already."""
    context = spark.sparkContext
    root = os.path.dirname(PACKAGE)
    if getattr(context, "_cairnfield_shipped", False) or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    # Spark serves the archive to the executors itself; it only has to be where the driver can read it.
    folder = (context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://").removeprefix("file:")
    if not folder or "://" in folder:
        folder = tempfile.gettempdir()
    os.makedirs(folder, exist_ok=True)
    archive = os.path.join(folder, f"cairnfield-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for where, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(where, name)
                    z.write(path, os.path.relpath(path, root))
    context.addPyFile(archive)
    context._cairnfield_shipped = True
