"""Folders for intermediate tables, on storage every executor can reach."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

from docpress.errors import ScratchLocationError

SETTING = "spark.checkpoint.dir"


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="docpress-")


def release(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    if "/docpress/" not in path:
        raise ValueError(f"not a scratch path: {path}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder named in ``spark.checkpoint.dir``.

    Only a local session, where driver and executors are one process, may fall
    back to a temporary folder of the machine.
    """
    base = spark.conf.get(SETTING, None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ScratchLocationError(f"set {SETTING} to a folder shared by the cluster")
        base = _own_folder()
    return f"{base.rstrip('/')}/docpress/{label}-{uuid.uuid4().hex}"
