"""Queries over files: a table is written by a writer to the shared folder, read by a reader, and compared with SQL over the table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract as E
from ..operators import records as R
from ..operators.tables import shared_dir
from ..sources import readers, writers
from . import registry as Q
from . import views as V

#: Bases of a line of the FASTA files written here.
WIDTH = 60


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _text(lines: DataFrame, spark: SparkSession, name: str, **options) -> str:
    """Lines of the column ``value`` as a file of its own."""
    path = _path(spark, name)
    lines.write.options(**options).text(path)
    return path


def _fasta_lines(arrays: DataFrame) -> DataFrame:
    """Records with wrapped bodies and trailing blanks, as they come from databases."""
    body = F.regexp_replace("seq", f"(.{{{WIDTH}}})", "$1 \n")
    return arrays.select(F.concat(F.lit(">array "), F.col("array_ord"), F.lit("  \n"), body).alias("value"))


def _fasta(spark: SparkSession, d: str, **options) -> DataFrame:
    return readers.read_fasta(spark, _text(_fasta_lines(V.dna_tandem(spark, d)), spark, "fasta", **options))


_named = "SELECT concat('array ', array_ord) AS header, seq FROM dna_tandem"


@Q.query("fasta_scan", _named, "dna_tandem")
def fasta_scan(spark: SparkSession, d: str) -> DataFrame:
    return _fasta(spark, d).select("header", "seq")


@Q.query("fasta_scan_gzip", _named.replace("seq FROM", "lower(seq) AS seq FROM"), "dna_tandem")
def fasta_scan_gzip(spark: SparkSession, d: str) -> DataFrame:
    path = _text(_fasta_lines(V.dna_tandem(spark, d)), spark, "fasta", compression="gzip")
    return readers.read_fasta(spark, path, lower=True).select("header", "seq")


@Q.query("fasta_sequences", "SELECT seq FROM dna_tandem", "dna_tandem")
def fasta_sequences(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_fasta_sequences(spark, _text(_fasta_lines(V.dna_tandem(spark, d)), spark, "fasta")).select("seq")


@Q.query("block_scan", "SELECT concat('Sequence: ', record_ord) AS head, concat('x', record_ord, chr(10), 'Sequel', chr(10)) AS body FROM heads", "heads")
def block_scan(spark: SparkSession, d: str) -> DataFrame:
    lines = V.heads(spark, d).select(F.concat(F.lit("Sequence: "), "record_ord", F.lit("\nx"), "record_ord", F.lit("\nSequel")).alias("value"))
    blocks = readers.read_blocks(spark, _text(lines, spark, "blocks"), "Sequence:")
    # A block ends with the line feed before the next one, which only the last block of a file keeps.
    return blocks.select("head", F.concat(F.regexp_replace("body", "\n$", ""), F.lit("\n")).alias("body"))


def _finder_file(spark: SparkSession, d: str) -> str:
    """A finder's output: a block of a record each, with parameters and blank lines."""
    rows = Q._lines(spark, d).where(~F.col("head").contains("\t"))
    text = F.concat(F.lit("Sequence: "), F.col("head"), F.lit("\n\nParameters: 2 7 7 80 10 50 500\n\n"), F.col("line"), F.lit("\n"))
    return _text(rows.select(text.alias("value")), spark, "finder")


_untabbed = "(SELECT * FROM trf WHERE trf_head NOT LIKE '%' || chr(9) || '%')"
_finder_id = "concat_ws('_', string_split(trf_head, ' ')[1], trf_l_ind, trf_r_ind)"


@Q.query("finder_scan", f"WITH {Q._trf} SELECT trf_head, trf_gi, trf_chr, trf_l_ind, trf_r_ind, trf_period, trf_n_copy, trf_array, {_finder_id} AS trf_id, 'probe' AS project, 0::INT AS trf_param FROM {_untabbed}", "heads")
def finder_scan(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_trf(spark, _finder_file(spark, d), project="probe").select("trf_head", "trf_gi", "trf_chr", "trf_l_ind", "trf_r_ind", "trf_period", "trf_n_copy", "trf_array", "trf_id", "project", "trf_param")


@Q.query("finder_arrays", f"WITH {Q._trf} SELECT {_finder_id} AS header, trf_array AS seq FROM {_untabbed}", "heads")
def finder_arrays(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_trf_arrays(spark, _finder_file(spark, d)).select("header", "seq")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return R.from_lines(Q._lines(spark, d).where(~F.col("head").contains("\t")), "probe")


def _model_file(spark: SparkSession, d: str) -> str:
    path = _path(spark, "models")
    writers.write_models(_records(spark, d), path)
    return path


@Q.query("model_table", f"WITH {Q._trf} SELECT 'probe' AS project, {_finder_id} AS trf_id, trf_l_ind, trf_r_ind, trf_period, trf_n_copy, trf_pmatch, trf_array, trf_chr FROM {_untabbed}", "heads")
def model_table(spark: SparkSession, d: str) -> DataFrame:
    """The writer of model records, read by the reader of annotation tables."""
    rows = readers.read_satellome(spark, _model_file(spark, d))
    return rows.select("project", "trf_id", "trf_l_ind", "trf_r_ind", "trf_period", "trf_n_copy", "trf_pmatch", F.coalesce("trf_array", F.lit("")).alias("trf_array"), "trf_chr")


@Q.query("model_hooks", f"WITH {Q._trf} SELECT 'tuned' AS project, {_finder_id} AS trf_id FROM {_untabbed} WHERE {_finder_id} NOT LIKE '%7'", "heads")
def model_hooks(spark: SparkSession, d: str) -> DataFrame:
    """Hooks on raw lines: drop by prefix, map, filter."""
    tagged = _records(spark, d).withColumn("project", F.lit("probe"))
    path = _path(spark, "models")
    lines = R.as_model(tagged).select(F.concat_ws("\t", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in R.FIELDS]).alias("value"))
    lines.unionByName(lines.select(F.concat(F.lit("skip\t"), "value").alias("value"))).unionByName(lines.select(F.concat(F.lit("#"), "value").alias("value"))).write.text(path)
    rows = readers.read_satellome(spark, path, ["skip"], lambda x: x.select("ord", F.regexp_replace("value", "^probe\t", "tuned\t").alias("value")), lambda x: x.where(~F.split("value", "\t")[2].endswith("7")))
    return rows.select("project", "trf_id")


@Q.query("model_arrays", f"WITH {Q._trf} SELECT {_finder_id} AS header, trf_array AS seq FROM {_untabbed}", "heads")
def model_arrays(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_arrays(spark, _model_file(spark, d), "satellome").select("header", F.coalesce("seq", F.lit("")).alias("seq"))


@Q.query("array_fasta", f"WITH {Q._trf} SELECT concat({_finder_id}, '_probe') AS header, trf_array AS seq FROM {_untabbed}", "heads")
def array_fasta(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "arrays")
    writers.write_array_fasta(_records(spark, d), path, add_project=True)
    return readers.read_arrays(spark, path).select("header", "seq")


@Q.query("gff3_prefixed", f"WITH {Q._trf} SELECT concat_ws(chr(9), concat('p|', CASE WHEN trf_gi <> 'Unknown' THEN trf_gi ELSE trf_head END), 'probe', 'repeat', least(trf_l_ind, trf_r_ind), greatest(trf_l_ind, trf_r_ind), 7, CASE WHEN trf_l_ind < trf_r_ind THEN '+' ELSE '-' END, '.', '') AS value FROM {_untabbed}", "heads")
def gff3_prefixed(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark, "gff3")
    writers.write_gff3(_records(spark, d), path, chromosome=False, kind="repeat", probability=7, tool="probe", prefix="p|")
    return spark.read.text(path)


@Q.query("gff3_headed", f"WITH {Q._trf} SELECT concat_ws(chr(9), trf_head, 'PySatDNA', 'complex_tandem_repeat', least(trf_l_ind, trf_r_ind), greatest(trf_l_ind, trf_r_ind), 1000, CASE WHEN trf_l_ind < trf_r_ind THEN '+' ELSE '-' END, '.', '') AS value FROM {_untabbed}", "heads")
def gff3_headed(spark: SparkSession, d: str) -> DataFrame:
    return R.gff3(_records(spark, d), force_header=True)


@Q.query("decomposed_file", "SELECT concat('u', array_ord, ' ', 11) AS header, pieces FROM tandem_units", "tandem_units")
def decomposed_file(spark: SparkSession, d: str) -> DataFrame:
    units = V.tandem_units(spark, d).select("array_ord", F.concat(F.lit("u"), "array_ord").alias("header"), F.lit(11).alias("period"), "pieces")
    path = writers.write_decomposed(units, _path(spark, "units") + ".fa")
    return readers.read_decomposed(spark, path).select("header", "pieces")


@Q.query("rotated_file", "SELECT concat('u', array_ord) AS header, pieces FROM tandem_units", "tandem_units")
def rotated_file(spark: SparkSession, d: str) -> DataFrame:
    units = V.tandem_units(spark, d).select("array_ord", F.concat(F.lit("u"), "array_ord").alias("header"), "pieces")
    return readers.read_decomposed(spark, writers.write_rotated(units, _path(spark, "rotated"))).select("header", "pieces")


@Q.query("monomer_file", "WITH e AS (SELECT unnest(pieces) AS monomer FROM tandem_units) SELECT [count(*)::VARCHAR, length(monomer)::VARCHAR, monomer] AS cells FROM e GROUP BY monomer", "tandem_units")
def monomer_file(spark: SparkSession, d: str) -> DataFrame:
    path = writers.write_monomers(E.monomer_table(V.tandem_units(spark, d)), _path(spark, "table"))
    return readers.read_tab(spark, path).select("cells")


def _cells_file(spark: SparkSession, d: str) -> str:
    """Comments, a header line, then key and value of every part, keys twice."""
    cells = V._table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.array(F.concat(F.lit("k"), F.col("p_partkey") % 97), F.concat("p_name", F.lit("|"), "p_partkey")).alias("cells"))
    heads = spark.createDataFrame([(-3, ["# a comment"]), (-2, ["key", "value"]), (-1, ["# another"])], "k long, cells array<string>")
    path = _path(spark, "cells")
    writers.write_cells(heads.unionByName(cells.select(F.col("k").cast("long"), "cells")).orderBy("k"), path, single=True)
    return path


_cells = "[concat('k', p_partkey % 97), concat(p_name, '|', p_partkey)]"


@Q.query("tab_scan", f"SELECT {_cells} AS cells FROM part")
def tab_scan(spark: SparkSession, d: str) -> DataFrame:
    """The first line that is no comment is the header."""
    return readers.read_tab(spark, _cells_file(spark, d), skip_first=True, skip_starting="#", eager=True).select("cells")


@Q.query("tab_scan_lazy", f"SELECT {_cells} AS cells FROM part UNION ALL SELECT ['key', 'value']")
def tab_scan_lazy(spark: SparkSession, d: str) -> DataFrame:
    """The file's first line goes, here a comment, and the header stays."""
    return readers.read_tab(spark, _cells_file(spark, d), skip_first=True, skip_starting="#").select("cells")


@Q.query("tab_dictionary", "SELECT 'key' AS key, 'VALUE' AS value UNION ALL SELECT concat('k', p_partkey % 97), upper(arg_max(concat(p_name, '|', p_partkey), p_partkey)) FROM part GROUP BY p_partkey % 97")
def tab_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_tab_dictionary(spark, _cells_file(spark, d), value=F.upper)
