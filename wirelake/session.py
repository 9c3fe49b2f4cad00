"""Session helpers: lineage cuts and shared scratch space."""
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_DIR_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach. The cluster names it in spark.checkpoint.dir. Where that is unset, a temporary
    folder serves if driver and executors are one process (local mode: tests, bench); elsewhere it is an error."""
    found = spark.conf.get(_DIR_KEY, None) or spark.sparkContext.getConf().get(_DIR_KEY)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"{_DIR_KEY} has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(_DIR_KEY, found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends at a table that
    survives lost executors, and the planner knows its size."""
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over spark.sql.shuffle.partitions tasks, for work that takes long for its bytes: a table of a single row group would be one task,
    and adaptive execution merges small partitions of other shuffles into few."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


@contextmanager
def in_place(spark: SparkSession) -> Iterator[None]:
    """While it lasts, tables that spread() dealt by one key are joined on that key and others without another shuffle. What is to be planned so has to be written (cut)
    inside."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_dir(spark: SparkSession) -> str:
    """The folder of this application in the shared one; all intermediate tables lie in it."""
    return os.path.join(shared_dir(spark), f"run-{spark.sparkContext.applicationId}")


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(run_dir(spark), f"{name}-{uuid.uuid4().hex}")


def clean_up(spark: SparkSession) -> bool:
    """Delete the intermediate tables of this application. To be called when results have been written elsewhere: a DataFrame
    of this library may still read such tables. Tells whether there were any."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def local_session(cores: str = "*", app: str = "wirelake") -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(app)
             .config("spark.sql.shuffle.partitions", os.environ.get("WIRELAKE_PARTITIONS", "8"))
             .config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
