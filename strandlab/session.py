"""Session settings and the shared folder used for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(app_name: str = "strandlab", cpus: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks. On a cluster the session is given, never built here."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach. Falls back to a temporary folder in local mode only."""
    folder = spark.conf.get(CHECKPOINT_CONF, "") or ""
    if not folder:
        folder = spark.sparkContext.getCheckpointDir() or ""
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="strandlab-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage and survives lost executors. The files carry their
    real size, so the planner broadcasts the result only when it is small.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    out = df if partitions is None else df.coalesce(partitions)
    out.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_to = path
    return written


def forget(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialise`` wrote, once nothing reads them any more. Other frames, and null, are left alone.

    Called after what was made of a table is itself written, so a failed job keeps its tables.
    """
    for table in tables:
        path = getattr(table, "written_to", None)
        if path:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
            table.written_to = None
