"""Intermediate and persisted tables in the folder that all nodes share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_IDS = 2_000_000  # 8 bytes each

_made: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new place for one run's tables; a temporary one only on a single machine without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all nodes share")
        if not _made:
            _made.append(tempfile.mkdtemp(prefix="palimpsest-tables-"))
            atexit.register(shutil.rmtree, _made[0], ignore_errors=True)
        base = _made[0]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """df as a table at path, read back with its own types."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(ids: DataFrame) -> DataFrame:
    """ids for the right side of a join: sent to all tasks if they are few enough, so that the left side is not shuffled."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
