"""Session defaults every job shares."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Only a
    local session, one process, may leave it unset: then it is a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "/tmp/tickloom-checkpoints"
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_folder(spark)}/tickloom/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def staged(df, name: str):
    """df written to the shared folder and read back: what several later plans read is
    made once and outlives any executor. Removed when the session's JVM ends."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def session(name: str = "tickloom", master: str | None = None, extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(name).config(map={**DEFAULTS, **(extra or {})})
    if master:
        b = b.master(master).config("spark.driver.memory", "8g")
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s
