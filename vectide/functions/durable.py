"""What has to outlive lost executors: the shared folder, and tables kept in it."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where a local session names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="vectide-"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, for what is read more than once and costs more than that."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
