"""Column functions against hand traces."""

import pytest
from pyspark.sql import functions as F

from satloom.functions import sequence as S


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("seq,rc", [("AT CG", "CG AT"), ("ACGTRY-n[x]", "[]nACGT"), ("", ""), ("acgt", "acgt")])
def test_reverse_complement(spark, seq, rc):
    assert value(spark, S.reverse_complement(F.lit(seq))) == rc


def test_orientation(spark):
    assert value(spark, S.orient_by_bases(F.lit("AATTTC"))) == "AATTTC"
    assert value(spark, S.orient_by_bases(F.lit("AAATTC"))) == "GAATTT"
    assert value(spark, S.orient_by_kmer(F.lit("ACGTA"), F.lit("ACGT"))) == "TACGT"
    assert value(spark, S.orient_by_kmer(F.lit("TTAGG TTAGG"), F.lit("TAGG"))) == "TTAGG TTAGG"


@pytest.mark.parametrize("seq,top", [("ACGT", "A"), ("TTCC", "C"), ("GGT", "G"), ("", "A"), ("acgtT", "T")])
def test_top_base(spark, seq, top):
    assert value(spark, S.top_base(F.lit(seq))) == top


def test_even_parts(spark):
    assert value(spark, S.even_parts(F.lit("ACGACGACG"), F.lit(3))) == ["ACG"] * 3
    assert value(spark, S.even_parts(F.lit("ACGA"), F.lit(3))) == ["ACGA"]
    assert value(spark, S.even_parts(F.lit(""), F.lit(3))) == [""]


@pytest.mark.parametrize("n,cutoff", [(10_000, 3), (10_001, 10), (100_000, 10), (100_001, 250), (1_000_000, 250), (1_000_001, 1000)])
def test_cutoffs(spark, n, cutoff):
    assert value(spark, S.length_cutoff(F.lit(n))) == cutoff


def test_names(spark):
    assert value(spark, S.chromosome_name(F.lit("Mus musculus chromosome Un, x"))) == "Un"
    assert value(spark, S.chromosome_name(F.lit("a mitochondrion b"))) == "MT"
    assert value(spark, S.fasta_head(F.lit(">gi|20928815|ref|NW_003237.1|MmUn"))) == ["20928815", "NW_003237.1", "MmUn"]
    assert value(spark, S.record_id(F.lit(0))) == "AGT0000000000100"
    assert value(spark, S.clear_sequence(F.lit("ac g\t*t-0"))) == "ACGT-"
    assert value(spark, S.trf_parameters(F.lit("Parameters: 2 7 7 80"))) == "2 7 7 80"
    assert value(spark, S.trf_head(F.lit("Sequence: chr1 x\nmore"))) == "chr1 x"
    assert value(spark, S.gc_fraction(F.lit("acGt"))) == 0.5
    assert value(spark, S.literal_split(F.lit("aXbX"), F.lit("X"))) == ["a", "b", ""]
