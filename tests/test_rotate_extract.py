import pytest

from satloom.operators import extract as E
from satloom.operators import rotate as O


def frame(spark, *rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "array_ord bigint, pieces array<string>")


def test_rotate_given(spark):
    assert O.rotate(frame(spark, ["TTAGG", "TTAGG"]), "TAGG").first()["pieces"] == ["T", "TAGGT", "TAGG"]
    assert O.rotate(frame(spark, ["AAAAAAA"]), "AAAAA").first()["pieces"] == ["A", "A", "AAAAA"]
    assert O.rotate(frame(spark, []), "AAAAA").first()["pieces"] == []


def test_rotate_auto(spark):
    df = frame(spark, ["AATTTC"] * 3)
    census = {r["kmer"]: r["n"] for r in O.kmer_census(O.oriented(df)).collect()}
    assert census == {"AATTT": 3, "ATTTC": 3, "TTTCA": 2, "TTCAA": 2, "TCAAT": 2, "CAATT": 2}
    assert O.start_kmer(df).first()["kmer"] == "AATTT"
    assert O.rotate(df).first()["pieces"] == ["AATTTC"] * 3


def test_rotation_keeps_the_text(spark):
    df = frame(spark, ["ACGTT", "ACGAT", "ACG"], ["TTTT", "TACG"])
    for r in O.rotate(df, "ACG").collect():
        text = {0: "ACGTTACGATACG", 1: "TTTTTACG"}[r["array_ord"]]
        assert "".join(r["pieces"]) == text or r["reversed"]


def test_no_start(spark):
    with pytest.raises(O.NoStartKmer):
        O.rotate(frame(spark, ["AC", "GT"]), compat=True)
    assert O.rotate(frame(spark, ["AC", "GT"])).count() == 1


def test_extract(spark):
    got = [(r["n"], r["length"], r["monomer"]) for r in E.monomer_table(frame(spark, ["AC", "AC", "ACG"])).collect()]
    assert got == [(2, 2, "AC"), (1, 3, "ACG")]
    with pytest.raises(ValueError):
        E.monomer_table(frame(spark, ["A"]), distance=-1)
    with pytest.raises(ValueError):
        E.monomer_table(frame(spark, ["A"]), function="x")
    assert tuple(E.totals(frame(spark, ["A", "A"], ["C"])).first()) == (2, 3, 2)
