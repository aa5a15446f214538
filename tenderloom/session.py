"""Session settings and the reliable-checkpoint helper."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def get_session(app: str = "tenderloom", master: str | None = None, cores: int = 8,
                **conf: str) -> SparkSession:
    """A session with the settings every operator here assumes.

    Everything is UTC, AQE splits skewed joins and coalesces small shuffle
    partitions, and `spark.sql.shuffle.partitions` stays an upper bound.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = (builder.master(master).config("spark.sql.shuffle.partitions", str(cores))
                   .config("spark.tenderloom.spread", str(cores)))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The run's own folder below spark.checkpoint.dir, else below the warehouse; removed when the session ends.

    Both are shared by a cluster's machines, and the rule is the same on every
    master. Removal is left to the file system's own list of temporary paths.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    folder = f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the run's shared folder for one intermediate table."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    Used between rounds of iterative programs and where several branches fan
    out of one costly result. The table outlives lost executors, and unlike a
    checkpointed RDD it keeps column pruning and real sizes, so the planner can
    still choose a broadcast by measured size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
