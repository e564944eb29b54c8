"""Queries of the subpackage with SQL, and the pipeline's stages."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from satloom.llm import bpe, common, quality_classifier, quality_rules, registry
from tests.llm.test_methods import brute_classes
from tests.test_queries import rows

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    assert rows(registry.QUERIES[name](spark, DATA).toPandas()) == rows(con.execute(registry.SQL[name]).df())


def test_phrases(spark):
    from satloom.llm import licenses

    texts = [(1, "All Rights  Reserved. x CC-BY? all rights reserved"), (2, "xcc by general public licenses"), (3, "General\nPublic license")]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert [got[1][k] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels")] == [9, 3, 0, 6, "cc-by,reserved"]
    assert (got[2]["n_base"], got[2]["first_word"]) == (0, None)
    assert (got[3]["n_base"], got[3]["first_word"], got[3]["last_word"], got[3]["base_labels"]) == (1, 0, 0, "gpl")


def test_wide_windows_equal_packed_ones(spark):
    from pyspark.sql import functions as F

    texts = ["a b c a b c x", "a a a a a", "p q", "", "one two three four one two three"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    w = quality_rules.words(F.col("t"))
    got = df.select(quality_rules.repeated_words(w).alias("n"), quality_rules.repeated_words(w, place_bits=1).alias("wide")).collect()
    assert [r["n"] for r in got] == [r["wide"] for r in got] == [6, 5, 0, 0, 6]


def test_pipeline(spark):
    docs = common.table(spark, DATA, "documents")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    names, stages = zip(*corpus_pipeline.STAGES, strict=True)
    kept = docs
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    one = common.stored(stages[0](spark, docs, DATA), names[0])
    assert one.columns == docs.columns and ids(one) == {r["doc_id"] for r in quality_rules.op9_quality_rules(spark, DATA).where("kept").collect()}
    two = common.stored(stages[1](spark, one, DATA), names[1])
    good = {r["doc_id"] for r in quality_classifier.score(one, quality_classifier.train(one, common.table(spark, DATA, "labels"))).where("predicted = 1").collect()}
    assert ids(two) == good
    three = common.stored(stages[2](spark, two, DATA), names[2])
    classes = brute_classes({i: text[i] for i in ids(two)})
    assert ids(three) == set(classes.values())
    four = common.stored(stages[3](spark, three, DATA), names[3])
    items = [r["text"] for r in common.table(spark, DATA, "benchmark").collect()]
    assert not any(x in text[i] for i in ids(four) for x in items) and four.columns == docs.columns
    last = corpus_pipeline.run(spark, DATA)
    assert ids(last) == ids(four)
    assert bpe.codec is not None and last.count() == four.count()
