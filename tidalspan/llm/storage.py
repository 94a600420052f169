"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only by a local session that names no folder, as in tests.
LOCAL_FOLDER = "/tmp/checkpoints/tidalspan"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local session may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{LOCAL_FOLDER}"


def new_path(spark: SparkSession, tag: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/tidalspan-{app}/{tag}-{uuid.uuid4().hex}"


def new_folder(spark: SparkSession, tag: str) -> str:
    """A new, empty folder under the shared one."""
    path = new_path(spark, tag)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes df and reads it again: later stages start from files, whatever executors are lost."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidalspan_path = path
    return out


#: Rows that a table may have to be sent to every task.
MOST_BROADCAST = 1 << 20


def small(df: DataFrame, tag: str) -> DataFrame:
    """df, stored; marked for broadcast if it has at most MOST_BROADCAST rows (of a few numbers each)."""
    from pyspark.sql import functions as F

    out = stored(df, tag)
    return F.broadcast(out) if out.count() <= MOST_BROADCAST else out


def drop(df: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more."""
    path = getattr(df, "_tidalspan_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def delete_matching(spark: SparkSession, pattern: str) -> None:
    """Deletes the files whose paths match pattern."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in system.globStatus(path) or []:
        system.delete(status.getPath(), False)


def clear(spark: SparkSession) -> None:
    """Deletes every table that this application has stored."""
    delete(spark, f"{shared_dir(spark)}/tidalspan-{spark.sparkContext.applicationId}")
