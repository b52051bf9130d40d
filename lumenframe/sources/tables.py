"""Sources and sinks: chunked files, materialised steps, chunk-wise functions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

FORMATS = ("csv", "parquet", "json", "orc")


def load_chunks(spark: SparkSession, path: str, pattern: str = "*", file_format: str = "parquet", **options) -> DataFrame:
    """All files of a folder that match a glob pattern, as one table."""
    if file_format not in FORMATS:
        raise ValueError(f"format {file_format!r} is not one of {FORMATS}")
    extra = {"header": True, "inferSchema": True} if file_format == "csv" else {}
    return spark.read.format(file_format).options(**{**extra, **options}).option("pathGlobFilter", pattern).load(path)


def save_chunks(df: DataFrame, path: str, chunk_size: int = 100_000, file_format: str = "parquet", mode: str = "errorifexists") -> None:
    """Files of at most ``chunk_size`` rows."""
    if file_format not in FORMATS:
        raise ValueError(f"format {file_format!r} is not one of {FORMATS}")
    writer = df.write.mode(mode).option("maxRecordsPerFile", chunk_size)
    (writer.option("header", True) if file_format == "csv" else writer).format(file_format).save(path)


def iterate_rows(df: DataFrame) -> Iterator[Row]:
    """Rows on the driver, a partition at a time."""
    return df.toLocalIterator(prefetchPartitions=True)


def iterate_chunks(df: DataFrame, chunk_size: int = 100_000) -> Iterator[pd.DataFrame]:
    """pandas frames of at most ``chunk_size`` rows, a partition at a time; the driver holds one chunk and one partition."""
    held: list[Row] = []
    for row in iterate_rows(df):
        held.append(row)
        if len(held) == chunk_size:
            yield pd.DataFrame(held, columns=df.columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=df.columns)


def process_chunks(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, combine: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``fn`` on every Arrow batch of rows, in parallel; ``combine`` turns the table of all results into the final one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    out = df.mapInPandas(run, schema)
    return combine(out) if combine else out


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or else the context's checkpoint folder.

    Only a local master gets a temporary folder where neither is set; on a cluster each executor would write to its own
    disk, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not hasattr(spark, "_lumenframe_folder"):
            spark._lumenframe_folder = "file://" + tempfile.mkdtemp(prefix="spark-tables-")
        found = spark._lumenframe_folder
    return found.rstrip("/")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write to the shared folder and read back, so that lineage ends and a lost executor costs nothing.

    The steps of an application lie in one folder named after it, to be removed when it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def estimate_bytes(df: DataFrame) -> DataFrame:
    """(column_name, bytes): fixed widths times rows, and the measured length of strings; one scan."""
    widths = {"tinyint": 1, "boolean": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}
    size = lambda c, t: F.sum(F.coalesce(F.octet_length(c), F.lit(0))) if t == "string" else F.count(F.lit(1)) * widths.get(t, 8)
    wide = df.agg(*[size(c, t).cast("long").alias(f"b{i}") for i, (c, t) in enumerate(df.dtypes)])
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"b{i}").alias("bytes")) for i, c in enumerate(df.columns)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def frame_kind(data) -> str:
    """spark, pandas, arrow or unknown."""
    if isinstance(data, DataFrame):
        return "spark"
    if isinstance(data, pd.DataFrame):
        return "pandas"
    return "arrow" if type(data).__module__.startswith("pyarrow") else "unknown"


def to_local(df: DataFrame, kind: str = "pandas", max_rows: int = 1_000_000):
    """A pandas or Arrow table on the driver; an error when there are more rows than ``max_rows``."""
    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows; use iterate_chunks")
    return {"pandas": df.toPandas, "arrow": df.toArrow}[kind]()


def to_spark(spark: SparkSession, data) -> DataFrame:
    """A Spark table from a Spark, pandas or Arrow one."""
    return data if isinstance(data, DataFrame) else spark.createDataFrame(data)
