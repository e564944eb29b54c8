"""Readers, writers and the command line."""

import gzip

import pytest

from satloom import cli
from satloom.operators import records as R
from satloom.sources import readers, writers

TRF = """Sequence: chr1 test chromosome 1, x

Parameters: 2 7 7 80 10 50 500

1 24 4 6.0 4 100 0 48 25 25 25 25 2.00 ACGT ACGTACGTACGTACGTACGTACGT
bad line

Sequence: other
Parameters: 2 7 7 80 10 50 500
90 60 4 1.0 4 99 0 48 25 25 25 25 2.00 ACGT ACGT
"""


def fasta(spark, path, **kw):
    return [(r["header"], r["seq"]) for r in readers.read_fasta(spark, str(path), **kw).orderBy("array_ord").collect()]


def test_fasta(spark, tmp_path):
    text = "junk\n>h1 a>b\nACG\nTTA\n\n>h2\nA C\n>\n>h3\n"
    (tmp_path / "a.fa").write_text(text)
    want = [(None, "junk"), ("h1 a>b", "ACGTTA"), ("h2", "A C"), ("h3", "")]
    assert fasta(spark, tmp_path / "a.fa") == want
    with gzip.open(tmp_path / "a.fa.gz", "wt") as f:
        f.write(text)
    assert fasta(spark, tmp_path / "a.fa.gz") == want
    (tmp_path / "b.fa").write_text(">x\r\nAC\r\nGT\r\n>\n\n>y\nA")
    assert fasta(spark, tmp_path / "b.fa") == [("x", "ACGT"), ("", ""), ("y", "A")]
    assert fasta(spark, tmp_path / "b.fa", lower=True)[0] == ("x", "acgt")
    (tmp_path / "c.fa").write_text("")
    assert fasta(spark, tmp_path / "c.fa") == []


def test_trf(spark, tmp_path):
    (tmp_path / "a.dat").write_text(TRF)
    rows = readers.read_trf(spark, str(tmp_path / "a.dat")).orderBy("record_ord").collect()
    a, bad, b = rows
    assert (a["trf_l_ind"], a["trf_r_ind"], a["trf_period"], a["trf_n_copy"], a["trf_pvar"], a["trf_array_gc"], a["trf_array_length"], a["trf_chr"], a["trf_gi"]) == (1, 24, 4, 6.0, 0, 0.5, 24, "1", "Unknown")
    assert a["trf_id"] == "chr1_1_24" and a["id"] == "AGT0000000000100" and bad["bad"] and bad["trf_array"] == ""
    df = readers.read_trf(spark, str(tmp_path / "a.dat")).orderBy("record_ord")
    assert R.gff3(df).first()["value"] == "1\tPySatDNA\tcomplex_tandem_repeat\t1\t24\t1000\t+\t.\t"
    assert [r["value"] for r in R.bed(df).collect()][2] == "other\t60\t90" and b["trf_l_ind"] == 90
    assert R.fasta(df).first()["value"] == ">chr1_1_24\nACGTACGTACGTACGTACGTACGT"
    writers.write_models(df, str(tmp_path / "m"), single=True)
    back = readers.read_satellome(spark, str(tmp_path / "m")).orderBy("array_ord").collect()
    assert [r["trf_id"] for r in back] == [r["trf_id"] for r in rows] and back[0]["trf_period"] == 4
    assert writers.model_header().startswith("#project\tid\ttrf_id") and len(R.FIELDS) == 37


def test_tab(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("#c\nk\t1\nl\t2\nk\t3\n")
    got = {r["key"]: r["value"] for r in readers.read_tab_dictionary(spark, str(tmp_path / "t.tsv")).collect()}
    assert got == {"k": "3", "l": "2"}
    rows = readers.read_tab(spark, str(tmp_path / "t.tsv"), skip_starting="#").orderBy("ord").collect()
    assert [r["cells"] for r in rows] == [["k", "1"], ["l", "2"], ["k", "3"]]
    assert readers.read_tab(spark, str(tmp_path / "t.tsv"), skip_first=True).count() == 3


def test_command_line(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">a\n" + "ACGT" * 6 + "\n>b\n" + "ACGTT" * 8 + "\n")
    path = cli.main(["decompose", "-i", str(tmp_path / "a.fa"), "-o", str(tmp_path / "out.fa")], spark)
    assert path.endswith("out.decomposed.fasta")
    first = readers.read_decomposed(spark, path).orderBy("array_ord").first()
    assert first["header"] == "a 8" and first["pieces"] == ["ACGTACGT"] * 4
    rotated = cli.main(["rotate", "-i", path, "-o", str(tmp_path / "rot"), "-s", "CGTAC"], spark)
    table = cli.main(["extract", "-i", rotated, "-o", str(tmp_path / "x")], spark)
    lines = [r["value"] for r in spark.read.text(table).collect()]
    assert sum(int(x.split("\t")[0]) * int(x.split("\t")[1]) for x in lines) == sum(len(p) for r in readers.read_decomposed(spark, path).collect() for p in r["pieces"])
    with pytest.raises(ValueError):
        readers.read_arrays(spark, path, "bam")
    assert writers.output_prefix("x.fasta") == "x" and writers.output_prefix("x.fa.fasta") == "x.fa"
