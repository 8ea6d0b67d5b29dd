"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Only adaptive planning is switched on; sizes and parallelism stay with the cluster's own configuration.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


_private: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def build_session(app_name: str = "paperlake", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a private one only in local mode where that is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    application = spark.sparkContext.applicationId
    if shared is None and application not in _private:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _private[application] = tempfile.mkdtemp(prefix="paperlake-")
    return shared or _private[application]


def new_path(spark: SparkSession, name: str = "table") -> str:
    """An unused path in the shared folder; :func:`remove_stored` removes what was written there."""
    path = f"{work_dir(spark).rstrip('/')}/paperlake-{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _located(spark: SparkSession, path: str):
    """A path and its file system, of any kind that Spark knows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _located(spark, path)
    return bool(files.exists(place))


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none if it is not there."""
    place, files = _located(spark, path)
    return [x.getPath().getName() for x in files.listStatus(place)] if files.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    place, files = _located(spark, path)
    files.delete(place, True)


def remove_stored(spark: SparkSession) -> None:
    """Remove what this application wrote to the shared folder, when nothing is going to read it any more."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        remove(spark, path)


def stored(df: DataFrame, *folders: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder, with a folder for each value of ``folders``, and read it back.

    For results that are used several times, or that must not be computed twice: a lost executor then costs a re-read,
    never a different answer. A Parquet table keeps column pruning, filters and sizes for the plans that follow.
    """
    path = new_path(df.sparkSession)
    (df.write.partitionBy(*folders) if folders else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
