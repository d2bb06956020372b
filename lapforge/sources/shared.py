"""The folder that the driver and all executors share, as a local path."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as a path that Python can open.

    Where it is unset, a local session gets a temporary folder that goes with the
    process. On a cluster, or where the folder is in a store that isn't mounted, files
    that Python writes could not be read elsewhere, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.startswith("local"):
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="lapforge-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        return _OWN[0]
    path = (found or "").removeprefix("file://").removeprefix("file:")
    if not path or "://" in path:
        raise RuntimeError("spark.checkpoint.dir must name a mounted folder that the driver and all executors share")
    os.makedirs(path, exist_ok=True)
    return path.rstrip("/")
