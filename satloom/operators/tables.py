"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a partition where rows are small and grow into long arrays.
ROWS = 4000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of this machine for local masters alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="satloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/pieces-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Small rows that grow into long arrays, in partitions of about ``ROWS`` by their key.

    A file of a few MB is one split, whatever its rows grow into.  Operators that group or join by the key alone need
    no other exchange.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS))
    # The condition is always true, and is not to be moved as it isn't deterministic.  Without it conditions on what
    # grows from the rows, as every explode has one, would be computed below the exchange.
    return df.repartition(parts, key).where(F.spark_partition_id() >= 0)


def elements(df: DataFrame, column: str, name: str, *others: str) -> DataFrame:
    """A row of ``others``, ``i`` and ``name`` for every element of an array column.

    A plain explode adds a condition on its array, for which the expression of the array is computed once more.
    """
    return df.select(*others, F.posexplode_outer(column).alias("i", name)).where("i is not null")


def importable(spark: SparkSession) -> None:
    """Python workers of this machine find this package where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
