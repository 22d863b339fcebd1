"""Shipping this package to executors, and the folder that they share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a single-machine session may leave it unset, and gets a temporary one."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="quillstream-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors' Python workers, once per application.

    Functions that run there refer to it by name, and a worker's search path needn't have it.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quillstream-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder) / "quillstream.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(here.rglob("*.py")):
            archive.write(source, source.relative_to(here.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
