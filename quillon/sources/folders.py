"""The folder that the driver and all executors share."""

from __future__ import annotations

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see: ``spark.checkpoint.dir``. Where that is unset on
    one machine (tests, a laptop) a folder of this session is made and set; elsewhere it is an error,
    as executors would write where others cannot read."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        known = "file://" + tempfile.mkdtemp(prefix="quillon-shared-")
        spark.sparkContext.setCheckpointDir(known)
    return known
