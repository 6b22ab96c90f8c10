"""Session factory and checks at the boundary of an operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "covey", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; on a cluster, leave master to spark-submit."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.parquet.aggregatePushdown", "true")
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", os.environ.get("COVEY_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; checkpoints go there too.

    Only where the setting is absent and there is one machine (local mode, as in tests) is a folder made
    for the session; it goes when the session's JVM ends.
    """
    context = spark.sparkContext
    kept = context._jsc.sc().getCheckpointDir()
    where = spark.conf.get("spark.checkpoint.dir", None) or (kept.get() if kept.isDefined() else None)
    if where is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="covey-")
        delete_at_end(spark, where)
    if not kept.isDefined():
        context.setCheckpointDir(where)
    return where


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Have the folder, which is made if it is not there, go when the driver's JVM ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)


def delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table is there, whole: its writer has left its mark."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(done)


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the session's own part of the shared folder, which goes when the driver's JVM ends."""
    shared_folder(df.sparkSession)
    out = df.checkpoint()
    delete_at_end(df.sparkSession, df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get())
    return out


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df as Parquet in the shared folder, read back, and where: delete() it when nothing reads it any more, or it goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/covey-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """df, if it has all the columns."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df
