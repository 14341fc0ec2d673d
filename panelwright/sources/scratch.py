"""Tables between the steps of a job, in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a local session takes
    a temporary folder and any other session a folder beside the warehouse.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            told = tempfile.mkdtemp(prefix="panelwright-")
        else:
            told = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", told)
    return told.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """The folder of this application's scratch tables in the shared folder."""
    return f"{shared_dir(spark)}/panelwright-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession) -> str:
    """A path in the session's folder that nothing else has."""
    return f"{session_dir(spark)}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the session's folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation. ``clean`` deletes these tables.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for ``path``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def clean(spark: SparkSession) -> bool:
    """Delete what this application has left in the shared folder, once the results that read it are written; others' tables stay."""
    files, folder = file_system(spark, session_dir(spark))
    return files.delete(folder, True)
