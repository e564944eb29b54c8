"""Readers of array files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import records as R

Lines = Callable[[DataFrame], DataFrame]
ARRAY_SCHEMA = "array_ord bigint, header string, seq string"


def _blocks(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    """Text between separators in file order: ``ord``, ``first`` and ``last`` of the file, ``value``.

    Only one small row a file split is ordered globally; the texts stay where they were read.
    """
    raw = spark.read.option("lineSep", separator).text(path)
    rows = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("rid"))
    splits = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("rid").alias("low"))
    order = Window.orderBy("file", "block")
    placed = splits.select("file", "block", "low", (F.sum("n").over(order) - F.col("n")).alias("before"), (F.lag("file").over(order).eqNullSafe(F.col("file"))).alias("inner"), (F.lead("file").over(order).eqNullSafe(F.col("file"))).alias("more"), "n")
    # Broadcast, or the texts would go through an exchange by file and split where these rows come from a large file.
    both = rows.join(F.broadcast(placed), ["file", "block"])
    return both.select("file", (F.col("before") + F.col("rid") - F.col("low")).alias("ord"), (~F.col("inner") & (F.col("rid") == F.col("low"))).alias("first"), (~F.col("more") & (F.col("rid") == F.col("low") + F.col("n") - 1)).alias("last"), "value")


def _trim(x: Column) -> Column:
    return F.regexp_replace(x, "^\\s+|\\s+$", "")


def read_fasta(spark: SparkSession, path: str | list[str], lower: bool = False) -> DataFrame:
    """(array_ord, header, seq) of FASTA files, plain or compressed by their suffix.

    Body lines are trimmed and joined, spaces inside them stay.  Text before the first header has a
    null header; a header of nothing without a body is no record.
    """
    rows = _blocks(spark, path, "\n>")
    headed = ~F.col("first") | F.col("value").startswith(">")
    text = F.when(F.col("first") & F.col("value").startswith(">"), F.expr("substring(value, 2)")).otherwise(F.col("value"))
    # The file's last line feed ends a line and begins none.
    text = F.when(F.col("last") & text.endswith("\n"), F.regexp_replace(text, "\n$", "")).otherwise(text)
    at = F.instr(text, "\n")
    has_body = F.when(headed, at > 0).otherwise(F.lit(True))
    head = F.when(headed, F.regexp_replace(F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text), "\\s+$", ""))
    body = F.when(headed, F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise("")).otherwise(text)
    seq = F.array_join(F.transform(F.split(body, "\n"), _trim), "")
    out = rows.select(F.col("ord").alias("array_ord"), head.alias("header"), (F.lower(seq) if lower else seq).alias("seq"), has_body.alias("b"))
    return out.where(F.col("b") | (F.coalesce("header", F.lit("")) != "")).drop("b")


def read_fasta_sequences(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_fasta(spark, path).select("array_ord", "seq")


def read_blocks(spark: SparkSession, path: str | list[str], token: str) -> DataFrame:
    """(block_ord, head, body): parts of a file that begin with a line starting with ``token``."""
    rows = _blocks(spark, path, "\n" + token)
    text = F.when(~F.col("first"), F.concat(F.lit(token), F.col("value"))).otherwise(F.col("value"))
    at = F.instr(text, "\n")
    parts = rows.where(text.startswith(token)).select(F.col("ord").alias("block_ord"), F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text).alias("head"), F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise("").alias("body"))
    return parts


def read_trf(spark: SparkSession, path: str | list[str], project: str | None = None) -> DataFrame:
    """Typed records of tandem-repeat-finder ``.dat`` files, in file order."""
    blocks = read_blocks(spark, path, "Sequence:")
    head = F.regexp_replace(F.translate("head", "\t", " "), "^Sequence: ?", "")
    lines = blocks.select("block_ord", head.alias("head"), F.posexplode(F.transform(F.split("body", "\n"), _trim)).alias("i", "line"))
    data = lines.where((F.col("line") != "") & ~F.col("line").startswith("Parameters") & ~F.col("line").startswith("Sequence"))
    # Index of a record: data lines of the blocks before it (one small row a block), then its line.
    sizes = data.groupBy("block_ord").agg(F.count("*").alias("n"), F.min("i").alias("low"))
    before = sizes.select("block_ord", (F.sum("n").over(Window.orderBy("block_ord")) - F.col("n")).alias("before"))
    ranked = data.join(before, "block_ord").withColumn("record_ord", F.col("before") + F.row_number().over(Window.partitionBy("block_ord").orderBy("i")) - 1)
    return R.from_lines(ranked.select("record_ord", "head", "line"), project)


def read_trf_arrays(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_trf(spark, path).select(F.col("record_ord").alias("array_ord"), F.col("trf_id").alias("header"), F.col("trf_array").alias("seq"))


def read_satellome(spark: SparkSession, path: str | list[str], skip_starting: list[str] = (), preprocess: Lines | None = None, check: Lines | None = None) -> DataFrame:
    """Records of the 37 fixed columns, with ``array_ord``; lines that begin with # are comments.

    Hooks work on the raw lines (``value``) in this order: drop by prefix, map, filter.
    """
    rows = _blocks(spark, path, "\n").select("ord", F.regexp_replace("value", "\r$", "").alias("value"))
    for prefix in skip_starting:
        rows = rows.where(~F.col("value").startswith(prefix))
    for hook in (preprocess, check):
        rows = hook(rows) if hook else rows
    part = F.split("value", "\t", -1)
    rows = rows.where((F.col("value") != "") & ~F.col("value").startswith("#"))
    typed = [F.get(F.col("p"), F.lit(i)).alias(f.name) for i, f in enumerate(R.SCHEMA)]
    cells = rows.select("ord", part.alias("p")).select("ord", *typed)
    return cells.select(F.col("ord").alias("array_ord"), *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in R.SCHEMA])


def read_satellome_arrays(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return read_satellome(spark, path).select("array_ord", F.col("trf_id").alias("header"), F.col("trf_array").alias("seq"))


def read_tab(spark: SparkSession, path: str | list[str], delimiter: str = "\t", skip_first: bool = False, skip_starting: str | None = None, transform: Lines | None = None, eager: bool = False) -> DataFrame:
    """(ord, cells) of delimited lines.

    ``skip_first`` drops the first line of each file.  With ``eager`` the comments are dropped before that, so the
    line is the first that is no comment; without it the line goes whatever it is.
    """
    rows = _blocks(spark, path, "\n").withColumn("value", F.regexp_replace("value", "\r$", ""))
    comment = F.col("value").startswith(skip_starting) if skip_starting else F.lit(False)
    if skip_first and eager:
        # The first line without comments of each file: one small row a file.
        heads = rows.where(~comment).groupBy("file").agg(F.min("ord").alias("head"))
        rows = rows.join(F.broadcast(heads), "file", "left").where(~F.col("ord").eqNullSafe(F.col("head")))
    elif skip_first:
        rows = rows.where(~F.col("first"))
    rows = rows.where(~comment).select("ord", "value")
    out = rows.select("ord", F.split("value", "\\Q" + delimiter + "\\E", -1).alias("cells"))
    return transform(out) if transform else out


def read_tab_dictionary(spark: SparkSession, path: str | list[str], value: Callable[[Column], Column] | None = None) -> DataFrame:
    """(key, value) of two-column lines; the last line of a key wins."""
    cells = read_tab(spark, path).where(F.size("cells") >= 2)
    last = cells.groupBy(F.col("cells")[0].alias("key")).agg(F.max_by(F.col("cells")[1], "ord").alias("value"))
    return last.select("key", (value(F.col("value")) if value else F.col("value")).alias("value"))


FORMATS = {"fasta": read_fasta, "trf": read_trf_arrays, "satellome": read_satellome_arrays}


def read_arrays(spark: SparkSession, path: str | list[str], kind: str = "fasta") -> DataFrame:
    """(array_ord, header, seq) of a file of one of ``FORMATS``."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}; known: {', '.join(FORMATS)}")
    return FORMATS[kind](spark, path)


def read_decomposed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(array_ord, header, pieces) of decomposed or rotated FASTA."""
    return read_fasta(spark, path).select("array_ord", "header", F.filter(F.split("seq", "\\s+"), lambda x: x != "").alias("pieces"))
