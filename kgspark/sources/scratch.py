"""Intermediate tables on storage that all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where it is unset (local tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), f"kgspark-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written once and read back: the lineage ends, lost executors cost no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/kgspark/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
