"""Monomer table of a whole assembly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import elements, importable

DISTANCES = ("hd", "ed")
#: More than the places of an array.
PLACES = 1 << 31


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(monomer, n, a, i) of every distinct monomer of a batch of (array_ord, pieces): its count, and its first array and place."""
    for batch in batches:
        # In the order of arrays: the dictionary is then in the order of first places.
        batch = batch.sort_by("array_ord")
        pieces = batch.column("pieces")
        coded = pieces.flatten().dictionary_encode(null_encoding="encode")
        code = coded.indices.to_numpy()
        if not len(code):
            continue
        size = pc.list_value_length(pieces).to_numpy()
        begin = np.cumsum(size) - size
        first = np.empty(len(coded.dictionary), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        # The last array that begins at or before a place is the one that holds it; empty ones begin there too, but earlier.
        owner = np.searchsorted(begin, first, "right") - 1
        n = np.bincount(code, minlength=len(first))
        yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(n, pa.int64()), batch.column("array_ord").take(pa.array(owner)), pa.array(first - begin[owner], pa.int32())], ["monomer", "n", "a", "i"])


def monomer_table(arrays: DataFrame, distance: int = 0, function: str = "hd") -> DataFrame:
    """(n, length, monomer, first_ord, first_pos) of (array_ord, pieces), the commonest first.

    Equal counts go by first occurrence.  ``distance`` and ``function`` are checked and otherwise
    without effect.
    """
    if distance < 0:
        raise ValueError("distance must not be negative")
    if function not in DISTANCES:
        raise ValueError(f"function must be one of {', '.join(DISTANCES)}")
    importable(arrays.sparkSession)
    # A worker's batch gives each of its monomers once, with its first place, so that few rows go through the exchange.
    own = arrays.select(F.col("array_ord").cast("long").alias("array_ord"), "pieces").where("pieces is not null").mapInArrow(_counted, "monomer string, n long, a long, i int")
    # Array and place as one number, which a hash aggregate takes without a sort.
    both = (F.col("a").cast("decimal(20,0)") * PLACES + F.col("i")).cast("decimal(31,0)")
    counted = own.groupBy("monomer").agg(F.sum("n").alias("n"), F.min(both).alias("both"))
    first_pos = F.pmod(F.col("both"), F.lit(PLACES).cast("decimal(31,0)"))
    placed = counted.select("n", "monomer", "both", first_pos.cast("int").alias("first_pos"))
    first_ord = F.expr(f"(both - first_pos) div {PLACES}").cast("long")
    out = placed.select("n", F.length("monomer").alias("length"), "monomer", first_ord.alias("first_ord"), "first_pos")
    return out.orderBy(F.desc("n"), "first_ord", "first_pos")


def totals(arrays: DataFrame) -> DataFrame:
    """Distinct monomers, all monomers, and arrays."""
    counted = arrays.select(F.explode("pieces").alias("monomer")).groupBy("monomer").agg(F.count("*").alias("n"))
    sums = counted.agg(F.count("*").alias("n_distinct"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_monomers"))
    return sums.crossJoin(arrays.agg(F.count("*").alias("n_arrays")))  # one row by one row


def diagnostics(arrays: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """Every piece with the count of its first five bases in the array and its distance to the reference monomer.

    Without ``references`` the arrays have a column ``reference``, null where there is none.
    """
    known = arrays.where("reference is not null") if references is None else arrays.join(references.hint("merge"), "array_ord")  # never broadcast, whatever the plan takes its size for
    each = elements(known, "pieces", "monomer", "array_ord", "reference")
    n_head = F.count("*").over(Window.partitionBy("array_ord", F.expr("left(monomer, 5)")))
    return each.select("array_ord", "i", F.length("monomer").alias("length"), n_head.alias("n_head"), "monomer", F.levenshtein("monomer", "reference").alias("distance"))
