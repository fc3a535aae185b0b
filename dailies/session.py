"""Session settings the operators are planned for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "dailies", **conf: str) -> SparkSession:
    """Get or create a session; every setting can be overridden by keyword-style conf."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k: str(v) for k, v in conf.items()},
    }
    builder = SparkSession.builder.appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; make a private one only where none is named."""
    if spark.sparkContext.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        spark.sparkContext.setCheckpointDir(shared)
    elif spark.sparkContext.master.startswith("local"):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="dailies-ckpt-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a shared folder")


def checkpoint_path(spark: SparkSession) -> str:
    """The shared folder for tables and files of a run."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write a result that several branches read to the shared checkpoint folder, and read it back.

    Computed once and columnar; a lost executor costs a re-read, not the lineage behind it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_path(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
