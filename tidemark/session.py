"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Runtime settings the plans rely on; all can be changed on a live session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

# Spark's own values that are too large for tables of long texts, and ours; a session that has other ones keeps them.
TEXT_CONF = {
    # a few keys hold most of the text: their partitions are split from here on
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": ("256MB", "64MB"),
    # a Python worker holds several copies of a batch
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
}

# Static setting, only possible before a session starts: no stack capture for
# every column expression while plans are built; checkpoints are cleaned up.
STATIC_CONF = {
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # checkpoint files go when the plans that read them are gone
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


#: Session setting: the shuffle files of an execution go when it ends, not when the driver next collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **STATIC_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else created."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    for key, (default, value) in TEXT_CONF.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a local-mode session without the setting gets a fresh temporary folder;
    on a cluster the setting is required, a machine-local folder would not
    survive the loss of an executor.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder shared by all executors")
    configured = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set(CHECKPOINT_CONF, configured)
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: later plans start there, with its statistics.

    Nothing reads the shuffles of this write again, so that they need not lie beside those of the next one.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    was = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if was is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table made by ``stored`` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the plan restarts from files in the shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
