"""Plans and kernels that must bear tables of many times the size."""

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from pyspark.sql import functions as F

from satloom.operators import decompose as D
from satloom.operators import extract as E
from satloom.operators import growth as G
from satloom.operators import rotate as O
from satloom.plans import files, registry  # noqa: F401
from satloom.plans import views as V
from satloom.sources import readers

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@tables
@pytest.mark.parametrize("name", ["reference_monomer", "second_pass_once", "diagnostics", "best_cut", "first_pass", "hint_periods", "monomer_counts", "hints", "kmer_census", "kmer_tree_deep", "kmer_tree"])
def test_arrays_grow_after_the_exchange_and_are_not_joined(spark, name):
    """A join would be taken for small, by the small file, and broadcast; one split of the file would do all the work."""
    got = plan(registry.QUERIES[name](spark, DATA))
    above, below = got.split("RepartitionByExpression", 1)
    assert "Join" not in above
    assert "Filter" not in below and "repeat" not in below


@tables
@pytest.mark.parametrize("view", ["tandem_units", "tandem_monomers", "heads", "dna_tandem"])
def test_views_are_spread(spark, view):
    """A table of parts is one split of a file."""
    assert getattr(V, view)(spark, DATA).rdd.getNumPartitions() >= 4


@pytest.mark.parametrize("k", [1, 5, 40])
def test_census_of_many_texts(k):
    rng = random.Random(k)
    for letters in ("ACGT", "A", "ACGTN\u00e9\U0001f600", "".join(map(chr, range(32, 400)))):
        texts = [x for x in ("".join(rng.choice(letters) for _ in range(rng.choice([k, k + 1, 60]))) * rng.randint(1, 2) for _ in range(9)) if len(x) >= k]
        want = {}
        for i, t in enumerate(texts):
            for p in range(len(t) - k + 1):
                if p == 0 or t[p : p + k] != t[p - 1 : p - 1 + k]:
                    want.setdefault(t[p : p + k], [0, i, p])[0] += 1
        assert {texts[i][p : p + k]: [n, i, p] for i, n, p in zip(*map(np.ndarray.tolist, G.census(texts, k)), strict=True)} == want


def test_census_keeps_the_first_place_over_batches(spark):
    df = spark.createDataFrame([(9, ["AACCG"]), (2, ["TT", "AACCG"]), (5, ["AACCG"] * 2), (7, ["AC"]), (8, [])], "array_ord long, pieces array<string>").repartition(5)
    assert {(r["kmer"], r["n"], r["first_ord"], r["first_pos"]) for r in O.kmer_census(df).collect()} >= {("AACCG", 4, 2, 2), ("TTAAC", 1, 2, 0), ("CCGAA", 1, 5, 2)}


@pytest.mark.parametrize("reader", ["read_tab", "read_satellome", "read_decomposed"])
def test_texts_stay_where_they_were_read(spark, tmp_path, reader):
    """The rows of splits are broadcast whatever the size of the file, so that no text goes through an exchange."""
    (tmp_path / "x").write_text(">a\tb\nc\td\n")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in getattr(readers, reader)(spark, str(tmp_path / "x"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def cut_of(seq, depth, cutoff):
    """The rules for one text, step by step."""
    top = max("ACTG", key=seq.count)
    grown, votes = {seq[p] for p in range(len(seq)) if seq[p] == top}, {}
    for length in range(2, depth + 1):
        places = [p for p in range(len(seq) - length + 1) if seq[p : p + length - 1] in grown and seq[p + length - 1] in "ACGT"]
        n = {k: c for k, c in Counter(seq[p : p + length] for p in places).items() if c > cutoff}
        if not n:
            break
        hint = max(n, key=lambda k: (n[k], -seq.index(k[:-1]) if length > 2 else 0, -"ACGT".index(k[-1])))
        sizes = Counter(map(len, seq.split(hint)))
        gap, many = max(sizes.items(), key=lambda x: x[1])
        vote = votes.setdefault(gap + length, [0, hint, many / sizes.total()])
        vote[0] += 1
        if many / sizes.total() > vote[2]:
            vote[1:] = hint, many / sizes.total()
        grown = set(n)
    if not votes:
        return seq, 0.0, len(seq)
    period, (_, hint, score) = max(votes.items(), key=lambda x: x[1][0])
    return hint, score, period


@pytest.mark.parametrize("steps", [0, 2, 64])
def test_cuts_of_many_texts_at_once(monkeypatch, steps):
    monkeypatch.setattr(G, "STEPS", steps)
    rng, seqs = random.Random(steps), ["", "A", "NNN"]
    for _ in range(60):
        unit = "".join(rng.choice(rng.choice(["ACGT", "AC", "ACGTN", "A"])) for _ in range(rng.randint(1, 14)))
        seq = list(unit * rng.randint(0, 30))
        for _ in range(rng.randint(0, 4)):
            seq.insert(rng.randrange(len(seq) + 1), rng.choice("ACGTNé"))
        seqs.append("".join(seq))
    cutoffs = [rng.choice([1, 3, 10]) for _ in seqs]
    for depth in (2, 6, 40):
        assert G.Texts(seqs, cutoffs).cuts(depth) == [cut_of(s, depth, c) for s, c in zip(seqs, cutoffs, strict=True)]


def test_chunks_hold_every_text(monkeypatch):
    monkeypatch.setattr(G, "TOGETHER", 10)
    sizes = [0, 4, 6, 1, 30, 30, 2, 0]
    assert [i for part in G.chunks(sizes) for i in range(part.start, part.stop)] == list(range(len(sizes)))
    assert all(sum(sizes[p]) <= 10 or p.stop - p.start == 1 for p in G.chunks(sizes)) and list(G.chunks([])) == []


#: 1,010 pieces of five bases, each twice, come before the only pieces as long as the period.
CROWDED = [x for a in "ACGT" for b in "ACGT" for c in "ACGT" for d in "ACGT" for e in "ACGT" for x in [a + b + c + d + e] * 2][:2020] + ["ACG", "TTT", "ACG"]


def crowded(spark):
    return spark.createDataFrame([(1, CROWDED, 3), (2, ["A", "A"], 3)], "array_ord long, pieces array<string>, period int")


def test_reference_among_more_than_a_thousand_pieces(spark):
    assert [tuple(r) for r in D.reference_monomers(crowded(spark)).collect()] == [(1, "ACG", 2)]
    capped = crowded(spark).select(D.reference_monomer(F.col("pieces"), F.col("period"), D.CANDIDATES).alias("r"))
    assert [r["r"] for r in capped.collect()] == [None, None]
    assert all("1000" not in registry.SQL[q].partition("ref AS")[2] for q in ("reference_monomer", "diagnostics"))


def test_reference_is_the_first_of_equals(spark):
    df = spark.createDataFrame([(1, ["CC", "AA", "T", "AA", "CC", "T", "T"], 2), (2, [], 2)], "array_ord long, pieces array<string>, period int")
    assert [tuple(r) for r in D.reference_monomers(df).collect()] == [(1, "CC", 2)]
    assert sorted(tuple(r) for r in D.monomer_counts(df).collect()) == [(1, "AA", 2, 1), (1, "CC", 2, 0), (1, "T", 3, 2)]


def test_diagnostics_of_more_than_a_thousand_pieces(spark, monkeypatch):
    monkeypatch.setattr(D, "first_pass", lambda cuts: crowded(spark))
    monkeypatch.setattr(registry, "_cut", lambda *_: None)
    got = registry.diagnostics(spark, DATA).where("monomer = 'ACG' or i = 0").orderBy("i").collect()
    assert [(r["array_ord"], r["i"], r["n_head"], r["distance"]) for r in got] == [(1, 0, 2, 4), (1, 2020, 2, 0), (1, 2022, 2, 0)]


def test_monomer_table_counts_in_workers(spark):
    """One aggregate, of the distinct monomers of batches; before, all pairs of array and monomer went through an exchange."""
    rng = random.Random(4)
    rows = [(o, [rng.choice(["a", "b", "é", "cc", "", "d" * 9]) for _ in range(rng.choice([0, 1, 7]))]) for o in rng.sample(range(-50, 1 << 40), 60)] + [(3, None)]
    want = {}
    for o, pieces in sorted(rows[:-1]):
        for i, m in enumerate(pieces):
            want.setdefault(m, [0, o, i])[0] += 1
    got = E.monomer_table(spark.createDataFrame(rows, "array_ord long, pieces array<string>").repartition(7))
    assert plan(got).count("Aggregate") == 1
    assert [tuple(r) for r in got.collect()] == [(n, len(m), m, o, i) for m, (n, o, i) in sorted(want.items(), key=lambda x: (-x[1][0], *x[1][1:]))]
