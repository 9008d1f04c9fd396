"""Cut lineage: reliable checkpoints in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from it; a fresh local folder only where none is set and Spark runs in one process, as in tests."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if not folder and master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="sitegrain-"))
    return df.checkpoint()
