"""Where queries put files of their own: below the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, tag: str) -> str:
    """A path that nothing uses yet. A temporary folder stands in where a single-machine session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="panelkit-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        named = f"file://{made}"
    return f"{named.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
