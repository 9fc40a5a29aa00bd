"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only in a local session that names none."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named and sc.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="voltrail-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


#: Rows of an Arrow batch, at most: whole texts travel in them, and each is held by both the JVM and Python.
BATCH_ROWS = 2_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Workspace:
    """Cuts lineage with Parquet tables, which survive the loss of executors.

    The session's Arrow batches are held to BATCH_ROWS rows, if they are larger.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
            spark.conf.set(_BATCH, BATCH_ROWS)
        self.root = f"{shared_dir(spark)}/voltrail-{uuid.uuid4().hex}"
        self.n = 0

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer files than there are cores is dealt over the cores."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def column(name: str) -> Column:
    """The column of that name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(name: str, taken: list[str]) -> str:
    """`name`, or one like it that no column has, in any case of letters."""
    while name.lower() in (x.lower() for x in taken):
        name += "_"
    return name
