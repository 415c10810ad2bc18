"""Folder that every executor can reach, for tables a job has to materialise."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Only a local session may go without that setting: it then gets a temporary
    folder. On a cluster a machine-local folder would lose data with its machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        base = tempfile.mkdtemp(prefix="utterscale-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/utterscale/{purpose}-{uuid.uuid4().hex}"
