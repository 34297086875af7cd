"""Session defaults and the one place where intermediate tables are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Applied only where the session has no value of its own.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("spanloom")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; where unset, one beside the warehouse's tables.

    Only a session on one machine, as in tests, gets a temporary folder; a cluster whose warehouse is a
    machine's own folder must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
            if warehouse.startswith("file:") or "://" not in warehouse:
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            return f"{warehouse}/_spanloom"
        folder = tempfile.mkdtemp(prefix="spanloom-")
        spark.sparkContext.setCheckpointDir(folder)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder


#: Rows of text are wide: batches between Spark and Python of a few MB keep a task's memory small.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "4000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m"),
}


def small_batches(spark: SparkSession) -> None:
    """Lower the size of Arrow batches in this session, where it is still Spark's default."""
    for key, (default, value) in BATCHES.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)


class Workspace:
    """Written tables that cut lineage; a lost executor rereads them instead of recomputing."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_folder(spark).rstrip('/')}/spanloom-{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return the reread table."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Delete all of this workspace's tables: once nothing that was made from them is read any more."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, df: DataFrame) -> None:
        """Delete the files behind a table from :meth:`save` that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            if folder.toString().find(self.root.split("/")[-1]) >= 0:
                fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
                fs.delete(folder, True)
