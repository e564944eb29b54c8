"""Writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import records as R


def output_prefix(name: str) -> str:
    """The name without one trailing ``.fasta`` or ``.fa``."""
    for suffix in (".fasta", ".fa"):
        if name.endswith(suffix):
            return name[: -len(suffix)]
    return name


def write_lines(lines: DataFrame, path: str, single: bool = False) -> None:
    """Text of the column ``value``; ``single`` asks for one part, for programs that want one file."""
    (lines.coalesce(1) if single else lines).write.mode("overwrite").text(path)


def decomposed_lines(decomposed: DataFrame) -> DataFrame:
    name = F.concat_ws(" ", F.coalesce("header", F.lit("None")), F.col("period"))
    return decomposed.orderBy("array_ord").select(F.concat(F.lit(">"), name, F.lit("\n"), F.array_join("pieces", " ")).alias("value"))


def rotated_lines(rotated: DataFrame) -> DataFrame:
    return rotated.orderBy("array_ord").select(F.concat(F.lit(">"), F.coalesce("header", F.lit("None")), F.lit("\n"), F.array_join("pieces", " ")).alias("value"))


def monomer_lines(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc("n"), "first_ord", "first_pos").select(F.concat_ws("\t", "n", "length", "monomer").alias("value"))


def write_decomposed(decomposed: DataFrame, prefix: str, single: bool = False) -> str:
    path = f"{output_prefix(prefix)}.decomposed.fasta"
    write_lines(decomposed_lines(decomposed), path, single)
    return path


def write_rotated(rotated: DataFrame, path: str, single: bool = False) -> str:
    write_lines(rotated_lines(rotated), path, single)
    return path


def write_monomers(table: DataFrame, prefix: str, single: bool = False) -> str:
    path = f"{prefix}.monomers.tsv"
    write_lines(monomer_lines(table), path, single)
    return path


def model_header() -> str:
    return "#" + "\t".join(R.FIELDS)


def write_models(records: DataFrame, path: str, single: bool = False) -> None:
    """Tab-separated records in the model's order, without quotes; ``model_header`` is their comment line."""
    model = R.as_model(records)
    write_lines(model.select(F.concat_ws("\t", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in R.FIELDS]).alias("value")), path, single)


def write_cells(rows: DataFrame, path: str, column: str = "cells", single: bool = False) -> None:
    """Arrays of strings as tab-separated lines."""
    write_lines(rows.select(F.array_join(column, "\t").alias("value")), path, single)


def write_gff3(records: DataFrame, path: str, single: bool = False, **options) -> None:
    write_lines(R.gff3(records, **options), path, single)


def write_bed(records: DataFrame, path: str, single: bool = False) -> None:
    write_lines(R.bed(records), path, single)


def write_array_fasta(records: DataFrame, path: str, add_project: bool = False, single: bool = False) -> None:
    write_lines(R.fasta(records, add_project), path, single)
