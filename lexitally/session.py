"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

# A local session may ask for small tables of long texts to be dealt out over its cores,
# since a file with one row group is read by one task. Sessions on a cluster never do.
DEAL_OUT = "spark.lexitally.dealOut"


def local_session(cores: str = "8", **conf: str) -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    count = cores if cores.isdigit() else "8"
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lexitally")
        .config("spark.sql.shuffle.partitions", count)
        .config("spark.sql.session.timeZone", "UTC")
        # Stemming works hard on few bytes, so small shuffles stay in several pieces.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config(DEAL_OUT, count)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@lru_cache(maxsize=1)
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="lexitally-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, for tables and stream checkpoints.

    Only a local session may go without that setting; it gets a temporary folder, which
    goes when the program ends. What stands in a shared folder stays until `remove`.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The file system that a path belongs to, and the path in it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder that is no longer needed; false if there is none."""
    files, place = file_system(spark, path)
    return files.delete(place, True)


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, for plans that read them several times.

    This runs a job. The table stays there; `DataFrame.inputFiles` tells where.
    """
    spark = rows.sparkSession
    path = scratch_dir(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


class Scratch:
    """Tables of one job below a folder of their own, which go when they are not needed."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, scratch_dir(spark, name)
        self.count = 0
        self.tables: list[tuple[DataFrame, str]] = []

    def written(self, rows: DataFrame, name: str) -> DataFrame:
        """The rows as a table, as `written` has it."""
        self.count += 1
        path = f"{self.root}/{name}-{self.count}"
        rows.write.parquet(path)
        table = self.spark.read.schema(rows.schema).parquet(path)
        self.tables.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing will read again."""
        for table, path in self.tables:
            if any(table is other for other in tables):
                remove(self.spark, path)
        self.tables = [(t, path) for t, path in self.tables if not any(t is other for other in tables)]

    def keep(self, *tables: DataFrame) -> None:
        """Remove all tables but these, and the shuffle files of jobs that are done."""
        self.drop(*[t for t, _ in self.tables if not any(t is other for other in tables)])
        self.settle()

    def settle(self) -> None:
        """Let Spark remove shuffle files that nothing refers to: it finds out when the driver
        collects garbage, which by itself may be long after."""
        self.spark._jvm.System.gc()

    def close(self) -> None:
        """Remove all that is left."""
        remove(self.spark, self.root)


def dealt_out(table: DataFrame) -> DataFrame:
    """The table over as many tasks as the session asks for, if it does."""
    tasks = table.sparkSession.conf.get(DEAL_OUT, None)
    return table.repartition(int(tasks)) if tasks else table
