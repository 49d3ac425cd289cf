"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir, or the session's checkpoint folder.

    Where neither is set, a folder of our own does on one machine (as in tests); executors elsewhere could not
    read it, so on a cluster that raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            folder = known.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            folder = tempfile.mkdtemp(prefix="corpusmill-")
            spark.sparkContext.setCheckpointDir(folder)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)
        except Exception:  # noqa: BLE001  the session ended first; the folder's own expiry takes it
            pass


atexit.register(_clean)


#: With this, Spark removes the shuffles of an execution as it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder (in folders by column ``by``) and read it again.

    A lost executor costs nothing that was written; the table goes when this process ends.  The shuffles
    behind it go as soon as it is written, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    _written.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def dropped(*frames: DataFrame) -> None:
    """Remove tables made by ``written`` that no later step reads."""
    for df in frames:
        if (path := getattr(df, "written_to", None)) and (df.sparkSession, path) in _written:
            _written.remove((df.sparkSession, path))
            _remove(df.sparkSession, path)
