"""Typed tandem-repeat records from finder output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sequence as S

_INTEGERS = set("trf_l_ind trf_r_ind trf_period trf_array_length trf_joined trf_n_chrun trf_hor".split())
_DOUBLES = set("trf_family_prob trf_n_copy trf_pmatch trf_pvar trf_entropy trf_array_gc trf_consensus_gc".split())
FIELDS = (
    "project id trf_id trf_type trf_family trf_family_prob trf_l_ind trf_r_ind trf_period trf_n_copy trf_pmatch trf_pvar trf_entropy trf_consensus trf_array trf_array_gc trf_consensus_gc "
    "trf_gi trf_head trf_param trf_array_length trf_chr trf_joined trf_superfamily trf_superfamily_ref trf_superfamily_self trf_subfamily trf_subsubfamily trf_family_network "
    "trf_family_self trf_family_ref trf_hor trf_n_chrun trf_ref_annotation trf_bands_refgenome trf_repbase trf_strand"
).split()
SCHEMA = T.StructType([T.StructField(f, T.IntegerType() if f in _INTEGERS else T.DoubleType() if f in _DOUBLES else T.StringType()) for f in FIELDS])
#: Fields of one data line of the finder, in order.
LINE = "l_ind r_ind period n_copy l_cons pmatch indels score n_a n_c n_g n_t entropy consensus array".split()


def from_lines(lines: DataFrame, project: str | None = None) -> DataFrame:
    """Records of (record_ord, head, line); a line without fifteen fields is kept with zeros and ``bad``."""
    part = F.split(F.trim("line"), "\\s", -1)
    whole = F.size(part) == len(LINE)
    value = lambda k: F.when(whole, part[LINE.index(k)]).otherwise("0")
    head = F.coalesce(F.trim("head"), F.lit(""))
    array, consensus = S.clear_sequence(value("array")), S.clear_sequence(value("consensus"))
    rows = lines.select(
        "record_ord", head.alias("trf_head"), S.fasta_head(head)[0].alias("trf_gi"), S.chromosome_name(head).alias("trf_chr"), *[value(f"{k}").cast("int").alias(f"trf_{k}") for k in ("l_ind", "r_ind", "period")],
        value("n_copy").cast("double").alias("trf_n_copy"), value("pmatch").cast("double").alias("trf_pmatch"), (100 - value("pmatch").cast("double")).cast("int").alias("trf_pvar"),
        *[value(k).alias(f"trf_{k}") for k in ("l_cons", "indels", "score", "n_a", "n_c", "n_g", "n_t", "entropy")],
        consensus.alias("trf_consensus"), array.alias("trf_array"), S.gc_fraction(array).alias("trf_array_gc"), S.gc_fraction(consensus).alias("trf_consensus_gc"),
        F.length(array).alias("trf_array_length"), F.lit(0).alias("trf_param"), (~whole).alias("bad"),
    )
    named = rows.withColumn("trf_id", S.repeat_id(F.col("trf_head"), F.col("trf_l_ind"), F.col("trf_r_ind"))).withColumn("id", S.record_id(F.col("record_ord")))
    return named.withColumn("project", F.lit(project).cast("string"))


def as_model(records: DataFrame) -> DataFrame:
    """The fixed fields in their order, null where a record has none."""
    return records.select(*[(F.col(f.name) if f.name in records.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA])


def gff3(records: DataFrame, chromosome: bool = True, kind: str = "complex_tandem_repeat", probability: int = 1000, tool: str = "PySatDNA", prefix: str | None = None, properties: dict[str, str] | None = None, force_header: bool = False) -> DataFrame:
    """One GFF3 line a record, as ``value``."""
    seqid = F.when(F.coalesce(F.col("trf_gi"), F.lit("")).isin("", "Unknown"), F.col("trf_head")).otherwise(F.col("trf_gi"))
    if chromosome:
        seqid = F.when(F.coalesce(F.col("trf_chr"), F.lit("")).isin("", "?"), seqid).otherwise(F.col("trf_chr"))
    if prefix:
        seqid = F.concat(F.lit(prefix), seqid)
    if force_header:
        seqid = F.col("trf_head")
    left, right = F.col("trf_l_ind"), F.col("trf_r_ind")
    features = F.concat_ws(";", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(v).cast("string"), F.lit("None"))) for k, v in (properties or {}).items()])
    return records.select(F.concat_ws("\t", seqid, F.lit(tool), F.lit(kind), F.least(left, right), F.greatest(left, right), F.lit(probability), F.when(left < right, "+").otherwise("-"), F.lit("."), features).alias("value"))


def bed(records: DataFrame) -> DataFrame:
    """One BED line a record, ends in ascending order and not shifted."""
    return records.select(F.concat_ws("\t", "trf_head", F.least("trf_l_ind", "trf_r_ind"), F.greatest("trf_l_ind", "trf_r_ind")).alias("value"))


def fasta(records: DataFrame, add_project: bool = False) -> DataFrame:
    """Two lines a record: the id, with the project if asked for, and the array."""
    name = F.concat_ws("_", "trf_id", "project") if add_project else F.col("trf_id")
    return records.select(F.concat(F.lit(">"), name, F.lit("\n"), F.col("trf_array")).alias("value"))
