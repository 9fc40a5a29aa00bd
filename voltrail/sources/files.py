"""Reading and writing tables by file type."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _kind(path: str) -> str:
    name = path.rstrip("/").rpartition("/")[2]
    return name.rpartition(".")[2].lower() if "." in name else ""


def _is_file(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(at) and fs.getFileStatus(at).isFile()


def load(spark: SparkSession, path: str, schema: StructType | str | None = None, kind: str | None = None) -> DataFrame:
    """A table of a csv, json, parquet or excel file, or a directory of parts.

    A missing path raises Spark's PATH_NOT_FOUND; an unknown type raises ValueError. Pickles are not read: they can
    run code, and are not split. Excel is read on the driver and is for small reference tables.
    """
    kind = kind or _kind(path)
    if kind in ("xls", "xlsx"):
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path), schema)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "csv":
        return reader.option("header", True).option("inferSchema", schema is None).csv(path)
    if kind == "json":
        # one file is a document of its own; parts, as `save` writes them, have a row a line
        return reader.option("multiLine", _is_file(spark, path)).json(path)
    if kind in ("parquet", ""):
        return reader.parquet(path)
    raise ValueError(f"{path}: no reader for .{kind}")


def save(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite", by: list[str] | None = None) -> None:
    """Writes a table as parquet, csv (numbers to four decimals), json or text (one string column)."""
    if not isinstance(df, DataFrame):
        raise TypeError("a DataFrame is needed")
    writer = lambda d: (d.write.partitionBy(*by) if by else d.write).mode(mode)
    if kind == "parquet":
        writer(df).parquet(path)
    elif kind == "csv":
        writer(df.select(*(F.format_string("%.4f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))).option("header", True).csv(path)
    elif kind == "json":
        writer(df).json(path)
    elif kind == "text":
        writer(df).text(path)
    else:
        raise ValueError(f"no writer for {kind}")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
