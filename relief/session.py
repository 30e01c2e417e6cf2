"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE re-plans joins from measured shuffle sizes, splits skewed join partitions
# and merges small ones. The library sets no broadcast hints on data that grows.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("relief")
    settings = dict(DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()})
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in settings.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


# temporary folders of local sessions, by application
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's part of the folder named by spark.checkpoint.dir.

    Every executor must reach it. A local run without the setting gets its own
    temporary folder.
    """
    context = spark.sparkContext
    application = context.applicationId
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or _LOCAL.get(application)
    if shared is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = _LOCAL.setdefault(application, tempfile.mkdtemp(prefix="relief-shared-"))
    return f"{shared.rstrip('/')}/relief-{application}"


def materialise(df: DataFrame) -> DataFrame:
    """Write a table once into the shared folder and read it back.

    Cuts lineage so that several readers do not recompute it, survives lost
    executors, and gives Spark the table's real size: a later join broadcasts
    it only when that size is under spark.sql.autoBroadcastJoinThreshold.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """Rows that must not be broadcast, however small their files are.

    Spark judges a table by the size of its files. Ids in sequence and repeated
    values shrink to a hundredth there, and a broadcast passes all rows through
    the driver.
    """
    return df.hint("merge")


def clear_shared(spark: SparkSession) -> None:
    """Delete what this application wrote; its results must have been stored."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
