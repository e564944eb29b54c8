"""License blocks over lines, several notices a document, and the filters of the join."""

import duckdb
import pandas as pd
import pytest

from satloom.llm import licenses
from tests.test_queries import rows

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
WRAPPED = "intro text\nPermission is hereby granted, free of charge,\nto any person obtaining a copy of this software\nand associated documentation files (the rest)"
TEXTS = [
    (1, "x\nReleased under the MIT License\ny\nLicensed under the Apache License, Version 2.0\nz"), (2, WRAPPED), (3, MIT), (4, f"{MIT}\n{MIT}\nAll rights reserved\nAll rights reserved"),
    (4, "All rights\nreserved under the GNU Lesser General\nPublic License as published by the Free Software Foundation"), (4, None), (5, "Released under\n\nthe MIT\nother words stand here " * 3),
    (6, "\n".join(MIT.split())), (7, "version of the license under the terms " * 40), (8, "Permission was granted to a person. " + "filler word " * 40 + "\nfiles of software documentation, charge free"), (9, ""), (None, "CC BY 4.0\nLicensed under\nCC BY-SA 4.0"),
]


@pytest.fixture(scope="module")
def got(spark):
    return licenses.scan(spark.createDataFrame(TEXTS, "doc_id bigint, text string")).toPandas()


def test_one_row_a_document(got):
    assert len(got) == len(TEXTS)
    one = got[got.doc_id == 1].iloc[0]
    assert (one.labels, one.n_base) == ("apache,mit", 0)


def test_wrapped_notices(got):
    assert set(got[got.doc_id.isin([2, 3, 6])].labels) == {"mit"}
    assert sorted(got[got.doc_id == 4].labels) == ["", "gpl,lgpl,reserved", "mit,reserved"]


def test_equals_sql(got):
    documents = pd.DataFrame(TEXTS, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})  # noqa: F841
    assert rows(got) == rows(duckdb.sql(licenses.SQL["op3_licenses"]).df())


def test_filters_reject_no_match(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    tokens = sorted({w for _, t in licenses.TEMPLATES for w in licenses._words(t)})
    frequency = licenses.template_frequencies(docs, tokens)
    index, universe = licenses.prefix_index(licenses.TEMPLATES, frequency), licenses.global_order(set(tokens), frequency)
    lines = [x.lower() for _, t in TEXTS for x in (t or "").split("\n")]
    # One late word of a template after the rarer words of others: many words, but few left in the order.
    lines += [" ".join([*(w for w in universe[: universe.index(e["prefix"][-1])] if w not in e["words"]), e["prefix"][-1]]) for e in index]
    blocks = spark.createDataFrame([(licenses._words(x),) for x in lines], "seq array<string>").select("seq", licenses.F.lit(True).alias("whole"), licenses.ordered(licenses.F.col("seq"), universe).alias("tokens"))
    pairs = [r for r in licenses.candidates(blocks, index).collect() if r["template"] is not None]
    assert any(not r["long_enough"] for r in pairs) and any(r["long_enough"] and not r["placed_well"] for r in pairs)
    kept = {(tuple(r["seq"]), r["template"]) for r in licenses.containment_join(blocks, index).collect() if r["template"] is not None}
    assert kept == {(tuple(w), e["template"]) for w in map(licenses._words, lines) for e in index if len(set(w) & set(e["words"])) >= e["need"]}
