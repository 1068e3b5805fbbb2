"""Where intermediate data go: the cluster's shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset, a folder in the warehouse is used, which every executor reaches.  A warehouse on the
    driver's own disk is only that on one machine; on a cluster it is an error to have nothing better.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rsplit("/", 1)[0]
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if is_local_path(warehouse) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{warehouse}/scratch"


def is_local_path(path: str) -> bool:
    """Whether a path names no file system, or that of the machine it is opened on."""
    scheme = path.partition(":")[0] if ":" in path else ""
    return scheme in ("", "file")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for a table in the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and restart the plan from there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
