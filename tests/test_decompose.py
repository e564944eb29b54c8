"""Decomposition against hand traces, and the native path against the bulk path."""

import random

import numpy as np
import pytest

from satloom.operators import decompose as D
from satloom.operators import kmers as K


def arrays(spark, *seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "array_ord bigint, seq string")


def result(df):
    return {r["array_ord"]: (r["cut"], round(r["score"], 6), r["period"], r["pieces"]) for r in df.collect()}


COMPAT = {
    "ACGT" * 6: ("ACGTACGT", 1.0, 8, ["ACGTACGT"] * 4),
    "ACGT": ("ACGT", 0.0, 4, ["ACGT", "ACGT"]),
    "AAAAA": ("AA", round(2 / 3, 6), 2, ["AA", "AA", "AA", "A"]),
    "NACACNNACNNNACNNNNN": ("AC", 0.2, 3, ["N", "AC", "ACNN", "ACNNN", "ACNNNNN"]),
    "": ("", 0.0, 0, []),
}
STRICT = {"ACGT" * 6: ["ACGTACGT"] * 3, "ACGT": ["ACGT"], "AAAAA": ["AA", "AA", "A"], "": []}


def test_hand_traces(spark):
    seqs = list(COMPAT)
    for fn in (D.decompose, D.decompose_native):
        got = result(fn(arrays(spark, *seqs), 100, 3))
        assert [got[i] for i in range(len(seqs))] == list(COMPAT.values())
    got = result(D.decompose(arrays(spark, *STRICT), 100, compat=False))
    assert [got[i][3] for i in range(len(STRICT))] == list(STRICT.values())


def test_native_path_equals_bulk_path(spark):
    rng = random.Random(5)
    seqs = []
    for _ in range(25):
        unit = "".join(rng.choice("ACGT") for _ in range(rng.randint(3, 14)))
        seq = list(unit * rng.randint(5, 20))
        for _ in range(rng.randint(0, 4)):
            seq.insert(rng.randrange(len(seq)), rng.choice("ACGTN"))
        seqs.append("".join(seq))
    for compat in (True, False):
        assert result(D.decompose_native(arrays(spark, *seqs), 20, 3, compat)) == result(D.decompose(arrays(spark, *seqs), 20, 3, compat))


def test_strict_keeps_the_text():
    rng = random.Random(2)
    for _ in range(50):
        seq = "".join(rng.choice("ACG") for _ in range(rng.randint(1, 60))) * rng.randint(1, 6)
        assert "".join(D.decompose_text(seq, 50, 3, compat=False)[3]) == seq
        cut, _, _, pieces = D.decompose_text(seq, 50, 3)
        assert "".join(pieces) in (seq, cut + seq)


def test_bands_equal_one_band(spark):
    df = arrays(spark, "ACGTAACGTTACG" * 12, "ACNAC" * 9, "", "A")
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(K.kmer_tree(df, 20, 2, bands=(4, 7, 11))) == key(K.kmer_tree(df, 20, 2, bands=()))


def test_partitions_do_not_matter(spark):
    df = arrays(spark, *["ACGTACCGT" * n for n in range(4, 20)])
    assert result(D.decompose_native(df.repartition(7), 12, 3)) == result(D.decompose_native(df.coalesce(1), 12, 3))


def test_sticky_cutoff(spark):
    df = arrays(spark, "A" * 15000, "A" * 500, "A" * 200000)
    got = lambda d: [r["cutoff"] for r in d.orderBy("array_ord").collect()]
    assert got(D.with_cutoff(df)) == [10, 10, 10]
    assert got(D.with_cutoff(df, sticky=False)) == [10, 3, 250]


def test_problems_raise(spark):
    done = D.decompose(arrays(spark, "NACACNNACNNNACNNNNN"), 100, 3, check=True)
    with pytest.raises(D.NoReferenceMonomer):
        D.require_decomposable(done)


def test_distance():
    assert [D.distance(*x) for x in (("", "ab"), ("ab", ""), ("kitten", "sitting"), ("ACGT", "ACGT"))] == [2, 2, 3, 0]


def test_distances_of_a_matrix():
    rng = random.Random(3)
    for n in (1, 5, 63, 64, 70):
        a = "".join(rng.choice("ACGT") for _ in range(n))
        others = ["".join(rng.choice("ACGTN") if rng.random() < 0.3 else c for c in a) for _ in range(12)]
        assert D.distances(a, np.stack([D._codes(x) for x in others])).tolist() == [D.distance(a, x) for x in others]


def test_plan_of_a_deep_tree_is_linear_in_its_bands(spark):
    arrays = spark.createDataFrame([(1, "ACGT" * 60)], "array_ord long, seq string")
    plan = lambda depth: K.kmer_tree(arrays, depth, 3)._jdf.queryExecution().optimizedPlan().toString().count("Aggregate")
    assert plan(100) <= 5 and plan(6) == 1
    assert {(r["length"], r["n"]) for r in K.kmer_tree(arrays, 100, 3).where("kmer like 'A%'").groupBy("length").agg({"n": "max"}).withColumnRenamed("max(n)", "n").collect()} == {(k, (240 - k) // 4 + 1) for k in range(2, 101)}
