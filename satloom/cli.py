"""Command line: decompose, rotate and extract.

``python -m satloom.cli decompose -i arrays.fa -o out``
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from .operators import decompose as D
from .operators import extract as E
from .operators import rotate as O
from .sources import readers, writers


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="satloom")
    sub = top.add_subparsers(dest="program", required=True)
    d = sub.add_parser("decompose", help="arrays into monomers")
    d.add_argument("-i", "--input", required=True)
    d.add_argument("--format", default="fasta", choices=sorted(readers.FORMATS))
    d.add_argument("-o", "--output", required=True, help="prefix of the output")
    d.add_argument("-t", "--threads", default="*", help="local threads, where neither a session nor a master is given otherwise")
    d.add_argument("--depth", type=int, default=D.DEPTH)
    d.add_argument("--strict", action="store_true", help="own cutoff for every array, no added copies")
    r = sub.add_parser("rotate", help="one strand and one start k-mer")
    r.add_argument("-i", "--input", required=True)
    r.add_argument("-o", "--output", required=True)
    r.add_argument("-s", "--start", default=None)
    e = sub.add_parser("extract", help="monomer table")
    e.add_argument("-i", "--input", required=True)
    e.add_argument("-o", "--output", required=True, help="prefix of the output")
    e.add_argument("-f", "--function", default="hd")
    e.add_argument("-d", "--distance", type=int, default=0)
    for p in (d, r, e):
        p.add_argument("--parts", action="store_true", help="leave the output in parts, in their order, and not in one file: for results that one task shouldn't write")
    return top


def session(program: str, threads: str = "*") -> SparkSession:
    """The session that is there, or one with the master of the configuration, or a local one of so many threads."""
    builder = SparkSession.builder.appName(f"satloom {program}")
    if SparkSession.getActiveSession() is None and not any(k in os.environ for k in ("MASTER", "SPARK_MASTER", "PYSPARK_SUBMIT_ARGS", "SPARK_CONF_DIR")):
        builder = builder.master(f"local[{threads}]")
    return builder.getOrCreate()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    """Run one program; returns the path written."""
    args = parser().parse_args(argv)
    spark = spark or session(args.program, getattr(args, "threads", "*"))
    if args.program == "decompose":
        arrays = readers.read_arrays(spark, args.input, args.format)
        done = D.decompose(arrays, args.depth, compat=not args.strict, check=True)
        # Read twice by the check and the writer: kept in the shared folder.
        return writers.write_decomposed(D.require_decomposable(D.stored(done)) if not args.strict else done, args.output, single=not args.parts)
    arrays = readers.read_decomposed(spark, args.input)
    if args.program == "rotate":
        return writers.write_rotated(O.rotate(arrays, args.start, compat=True), args.output, single=not args.parts)
    return writers.write_monomers(E.monomer_table(arrays, args.distance, args.function), args.output, single=not args.parts)


if __name__ == "__main__":
    main()
