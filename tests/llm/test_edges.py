"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns for every operator."""

import pytest
from pyspark.sql import functions as F

from satloom.llm import bpe, decontaminate, html_text, licenses, lm_scoring, near_dedup, quality_classifier, quality_rules, token_files, toxicity

public = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, failed string, x string, m string, row string"
LONG = "alpha beta gamma delta " * 8000 + "z" * 50_000


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, "s", None, "a", "b", "c", "d", "e") for i, t in texts], SCHEMA)


CASES = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three four five six"), (4, "one two three four five six"), (None, "one two three four five six"), (5, LONG), (6, "é ß 日本 😀  x")]


@pytest.fixture(params=["rows", "empty"])
def table(spark, request):
    return docs(spark, CASES if request.param == "rows" else [])


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 1), (99, 1, 1), (None, 1, 0), (6, None, None)], "doc_id bigint, quality int, toxic int")


def size(table):
    return table.count()


def test_bpe(table):
    path = public.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(table, path, public.PATTERN, ["doc_id", "text"])
    back = bpe.decode(ids, path, public.PATTERN, ["text"])
    assert all((r["text"] or "") == bytes(r["decoded"]).decode() for r in back.collect())
    assert bpe.roundtrip_digest(table, path, public.PATTERN, ["doc_id"]).count() == size(table)


def test_token_files(spark, table, tmp_path):
    token_files.write_tokens(table, str(tmp_path / "t"), public.path("byte_bpe_50k.json"), public.PATTERN, 2)
    rows = token_files.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert len(rows) == size(table)
    assert [r["start"] for r in rows] == [sum(x["n_tokens"] for x in rows[:i]) for i in range(len(rows))]
    assert all(bytes(r["ids"])[-4:] == b"\2\0\0\0" for r in rows)
    known = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert known == sorted(known)


def test_quality_rules(table):
    rows = quality_rules.ledger(table)
    assert rows.count() == size(table) and {"lang", "source", "n_chars"} <= set(rows.columns)
    assert all(r["failed"] & quality_rules.BASE for r in rows.where("doc_id in (1, 2, 3)").collect())
    quality_rules.ablation(rows).collect()


def test_classifier(table, labels):
    rows = quality_classifier.score(table, quality_classifier.train(table, labels)).collect()
    assert len(rows) == size(table) and all(0 <= r["score"] <= 1 for r in rows)


def test_classifier_without_labels(table, labels):
    assert all(r["score"] == 0.5 for r in quality_classifier.score(table, quality_classifier.train(table, labels.limit(0))).collect())


def test_toxicity(table, labels):
    for given in (labels, labels.limit(0)):
        rows = toxicity.score(table, toxicity.fit(table, given), ["doc_id"]).collect()
        assert len(rows) == size(table) and all(0 <= r["score"] <= 1 for r in rows)


def test_licenses(table):
    rows = licenses.scan(table).collect()
    assert len(rows) == size(table) and all(r["n_base"] == 0 and r["first_word"] is None and r["labels"] == "" for r in rows)


def test_decontamination(spark, table):
    for items in ([], [(1, None), (2, ""), (3, "one two three four five six"), (3, "one two three four five six")]):
        bench = spark.createDataFrame(items, "item_id bigint, text string")
        found = decontaminate.contamination(table, bench).collect()
        assert {r["doc_id"] for r in found} == ({4, None} if items and size(table) else set())


def test_html(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<p>a"), (3, "<p>a"), (4, "<script>x"), (5, "<p>" + "word " * 50_000)], "page_id bigint, html string")
    rows = html_text.extract(pages, ["page_id"]).collect()
    assert [r["text"] for r in rows[:5]] == ["", "", "a", "a", ""] and rows[5]["n_chars"] == 249_999
    assert html_text.extract(pages.limit(0), ["page_id"]).count() == 0


def test_near_dedup(spark, table):
    rows, found = near_dedup.classes(table)
    joined = rows.join(found, "node", "left").select("doc_id", F.coalesce("keep.doc_id", "doc_id").alias("c")).collect()
    assert len(joined) == size(table)
    kept = near_dedup.keep_one(spark, table, "")
    assert kept.columns == table.columns
    assert kept.count() == (6 if size(table) else 0)  # three blank texts, the short one once, the long one, the last


def test_lm(table):
    model, counts = lm_scoring.fit(table.where("doc_id <> 6"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN, steps=3)
    rows = lm_scoring.score(table, model, counts, ["doc_id"]).collect()
    assert len(rows) == size(table)
    for r in rows:
        if r["doc_id"] in (1, 2, 3):
            assert r["n_tokens"] == 1
        assert r["score"] < 0
