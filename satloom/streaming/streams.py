"""The same operators over streams of array files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import decompose as D

SCHEMA = "array_ord bigint, header string, seq string"


def read_array_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Arrays (array_ord, header, seq) from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def decompose_stream(arrays: DataFrame, depth: int = D.DEPTH, cutoff: int | None = None) -> DataFrame:
    """Every array decomposed on its own, with its own cutoff: there is no first array of a stream."""
    return D.decompose(arrays, depth, cutoff, compat=False)


def monomer_stream(pieces: DataFrame) -> DataFrame:
    """Running monomer counts, for the complete or update output mode."""
    counted = pieces.select(F.explode("pieces").alias("monomer")).groupBy("monomer").agg(F.count("*").alias("n"))
    return counted.select("n", F.length("monomer").alias("length"), "monomer")


def orient_stream(pieces: DataFrame, start: str) -> DataFrame:
    """Rotation to a given start k-mer; choosing one needs all arrays and is no streaming operation."""
    from ..operators.rotate import rotate

    return rotate(pieces, start)


def composition_stream(arrays: DataFrame) -> DataFrame:
    """Top base and GC share of arrays as they arrive."""
    return arrays.select("array_ord", S.top_base(F.col("seq")).alias("top"), S.gc_fraction(F.col("seq")).alias("gc"))
