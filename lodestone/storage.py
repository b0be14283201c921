"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: The folders of this process's applications, which go when its JVM ends.
_FOLDERS: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under the session's checkpoint folder: the setting, or what setCheckpointDir() was
    given. Only a master on this machine may do without either; a cluster without one is an error."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "/tmp/lodestone-checkpoints"
    folder = f"{where.rstrip('/')}/lodestone-{sc.applicationId}"
    if folder not in _FOLDERS:
        path, files = _path(sc, folder)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _FOLDERS.add(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it back. The table goes with release(), or when
    the process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete what materialize() wrote for these frames, once nothing reads it any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/table-" in folder and "/lodestone-" in folder:
                path, files = _path(df.sparkSession.sparkContext, folder)
                files.delete(path, True)


def _path(sc: SparkContext, folder: str) -> tuple:
    """A folder and the file system that it is in."""
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(sc._jsc.hadoopConfiguration())
