"""The shared folder for what queries write on their way."""

from __future__ import annotations

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getConf().get("spark.sql.warehouse.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return folder.rstrip("/")
