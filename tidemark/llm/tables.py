"""Reading tables, and storing what a job reads more than once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import shared_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Bytes of an Arrow batch between Spark and Python.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let at most :data:`BATCH_BYTES` (or one row) of whole texts travel to Python at once, in this session.

    Spark's own bound is 10,000 rows or 64 MB, of which JVM and Python hold a copy each, for every core.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name).lower().removesuffix("b")
    if not held.isdigit() or int(held) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the folder all executors share and read it back.

    Cuts the lineage: lost executors cost no recomputation beyond this point.
    The folder belongs to the cluster, which also decides how long files stay.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
