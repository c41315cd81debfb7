"""The Spark session for local work and tests, and the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | None = None, **conf: str) -> SparkSession:
    """A local session in UTC with few shuffle partitions and a small heap."""
    cores = cores or os.cpu_count() or 2
    build = SparkSession.builder.master(f"local[{cores}]").appName("loomery")
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for k, v in (base | conf).items():
        build = build.config(k, v)
    return build.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for shared files; one of our own only in a local session without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loomery-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, written once as Parquet to the shared folder and read from there.

    What follows reads files, so a lost executor costs no recomputation of df. The files
    stay for as long as plans may read them; the folder is the cluster's to clear.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/loomery-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
