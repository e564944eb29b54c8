"""License scans (operator 3): exact set-similarity join of text blocks with license templates, built-in functions only.

A block is a line, or a run of consecutive words, whatever lines they stand in, of at most ``SLACK`` times the
template's number of words: a notice wrapped over lines is found as one on a line is.  A template meets a
block that contains at least ``CONTAINED`` of the template's word set.  The join finds every such pair:

* words of templates are ordered by how many documents hold them, rarest first, over the whole corpus, and the
  words of a block that any template has are brought into the same order;
* *prefix*: with overlap ``o`` needed of ``n`` words, a block must hold one of the first ``n - o + 1``
  words, so only blocks with such a word are joined, on the first of these words that they hold;
* *length*: a block needs ``o`` distinct words or more;
* *positional*: from that first word on, the block must have ``o`` words left in the order.

Templates are a parameter of a stated size (``MOST_TEMPLATES``), so their prefix index is broadcast;
documents are scanned, never exploded into words: only the blocks with a prefix word become rows.

Null texts count as empty and give a row of zeros; repeated rows, and rows of equal ids, give a row each (rows
are told apart by a row number of the scan); a very long text is split inside its row, and of it only the
neighbourhoods of prefix words become rows; ties of frequency are ordered by the word; an empty table gives
no rows.  Only the id and text columns are read, so other columns may have any names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: One word of the contract as a Java class: after lower-casing A-Z, everything but the excluded ASCII.
LETTER = "0-9A-Za-z\\x{80}-\\x{10FFFF}"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
CONTAINED = 0.8
#: Words of a run that may meet a template, as a multiple of the template's.
SLACK = 1.25
MOST_TEMPLATES = 256
#: label -> notice; several notices may carry one label.
TEMPLATES: list[tuple[str, str]] = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("public-domain", "This work is dedicated to the public domain"),
    ("reserved", "All rights reserved"),
]


def _words(text: str) -> list[str]:
    """Words of a template, which is ASCII."""
    return re.findall(r"[0-9a-z]+", text.lower())


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased, and no other letter."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _UPPER.lower()), F.lit(f"[{LETTER}]+"), F.lit(0))


def _phrase(p: str) -> str:
    return f"(?i)(?<![{LETTER}])" + f"[^{LETTER}]+".join(p.split()) + f"(?![{LETTER}])"


def template_frequencies(docs: DataFrame, tokens: list[str], column: str = "text") -> dict[str, int]:
    """Documents that hold each template word, over the whole corpus: one row a template word."""
    # A document without the rarer half of any notice still counts for its common words.
    held = F.array_intersect(words(F.col(column)), F.array(*[F.lit(t) for t in tokens]))
    rows = docs.select(F.explode(held).alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()
    return {r["t"]: r["n"] for r in rows}


def prefix_index(templates: list[tuple[str, str]], frequency: dict[str, int], contained: float = CONTAINED) -> list[dict]:
    """Per template: its words in the global order, the overlap needed, its prefix, and the longest run that may meet it."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"at most {MOST_TEMPLATES} templates")
    out = []
    for k, (label, text) in enumerate(templates):
        own = _words(text)
        order = global_order(set(own), frequency)
        need = -(-len(order) * round(contained * 1000) // 1000)
        out.append({"template": k, "label": label, "words": order, "need": need, "prefix": order[: len(order) - need + 1], "span": int(len(own) * SLACK)})
    return out


def global_order(tokens: set[str], frequency: dict[str, int]) -> list[str]:
    return sorted(tokens, key=lambda w: (frequency.get(w, 0), w))


def ordered(seq: Column, universe: list[str]) -> Column:
    """The distinct words of a block that templates have, in the global order in which ``universe`` is given."""
    return F.array_intersect(F.array(*[F.lit(x) for x in universe]), seq)


def candidates(blocks: DataFrame, index: list[dict]) -> DataFrame:
    """``blocks`` (with ``tokens``, see ``ordered``) joined with the templates one of whose prefix words they hold.

    One row a block and template, at the first of their common words in the global order; ``long_enough`` and
    ``placed_well`` are the length and positional filters.  Blocks without such a word stay, with nulls.
    """
    rows = [(p, i, e["template"], e["label"], e["words"], e["need"], e["span"]) for e in index for i, p in enumerate(e["prefix"])]
    side = blocks.sparkSession.createDataFrame(rows, "prefix_word string, place int, template int, label string, words array<string>, need int, span int")
    known = F.array(*[F.lit(x) for x in sorted({p for p, *_ in rows})])
    left = blocks.withColumn("held", F.explode_outer(F.array_intersect("tokens", known)))
    first = (F.col("place") == 0) | ~F.arrays_overlap(F.slice("words", 1, F.greatest(F.col("place"), F.lit(1))), F.col("tokens"))
    pairs = left.join(F.broadcast(side), (F.col("held") == F.col("prefix_word")) & first, "left")
    long_enough, placed_well = F.size("tokens") >= F.col("need"), F.size("tokens") - F.array_position("tokens", F.col("held")) + 1 >= F.col("need")
    return pairs.withColumns({"long_enough": long_enough, "placed_well": placed_well}).drop("prefix_word", "place")


def containment_join(blocks: DataFrame, index: list[dict]) -> DataFrame:
    """``blocks`` (``tokens``, ``seq``, ``whole``) left-joined with every template that they contain well enough.

    Adds ``template``, ``label`` and ``share``, null where nothing is met.  A block that isn't ``whole`` is a
    neighbourhood, of which a run of ``span`` words must meet the template.
    """
    runs = F.transform(F.sequence(F.lit(1), F.size("seq")), lambda at: F.size(F.array_intersect("words", F.slice("seq", at, F.col("span")))))
    overlap = F.when(F.col("long_enough") & F.col("placed_well"), F.when(F.col("whole"), F.size(F.array_intersect("words", "tokens"))).otherwise(F.array_max(runs)))
    pairs = candidates(blocks, index).withColumn("overlap", overlap)
    met = F.col("overlap") >= F.col("need")
    return pairs.select(*blocks.columns, F.when(met, F.col("template")).alias("template"), F.when(met, F.col("label")).alias("label"), F.when(met, F.col("overlap") / F.size("words")).alias("share"))


def blocks_of(text: Column, index: list[dict]) -> Column:
    """Blocks with a prefix word: lines, and the neighbourhoods of prefix words in texts of several lines."""
    prefix_words = sorted({p for e in index for p in e["prefix"]})
    span = max((e["span"] for e in index), default=1)
    hit = F.array(*[F.lit(p) for p in prefix_words])
    block = lambda seq, whole: F.struct(seq.alias("seq"), F.lit(whole).alias("whole"))
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(any_word(prefix_words))), lambda x: block(words(x), True))

    def around(w: Column) -> Column:
        places = F.filter(F.transform(w, lambda x, i: F.when(F.array_contains(hit, x), i)), lambda i: i.isNotNull())
        return F.transform(places, lambda i: block(F.slice(w, F.greatest(i - span + 2, F.lit(1)), 2 * span - 1), False))

    none = F.array().cast("array<struct<seq:array<string>,whole:boolean>>")
    return F.concat(lines, F.when(F.contains(F.rtrim(text), F.lit("\n")), common.let(words(text), around)).otherwise(none))


def any_word(tokens: list[str]) -> str:
    return f"(?i)(?<![{LETTER}])(?:" + "|".join(tokens) + f")(?![{LETTER}])"


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, contained: float = CONTAINED, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """Per document: base counts and places of the phrases, and labels of phrases and templates."""
    # The row number is made below the explode, so that all blocks of a row have it.
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc_id"), F.coalesce(F.col(column), F.lit("")).alias("text"))
    tokens = sorted({w for _, t in templates for w in _words(t)})
    frequency = template_frequencies(source, tokens)
    index, universe = prefix_index(templates, frequency, contained), global_order(set(tokens), frequency)
    any_phrase = "(?i)(?:" + "|".join(_phrase(p)[4:] for p in PHRASES) + ")"
    any_prefix = any_word(sorted({p for e in index for p in e["prefix"]}))
    count = lambda t: F.regexp_count(t, F.lit(f"[{LETTER}]+")).cast("bigint")
    found = {label: F.regexp_count("text", F.lit(_phrase(p))).cast("bigint") for p, label in PHRASES.items()}

    def places(n: Column) -> Column:
        """Base digest of a text with a phrase: words before the first, and after the last."""
        tail = F.regexp_extract("text", f"(?is)^.*({any_phrase[4:]})(.*)$", 1)
        rest = F.regexp_extract("text", f"(?is)^.*{any_phrase[4:]}(.*)$", 1)
        first = F.regexp_extract("text", f"(?is)^(.*?){any_phrase[4:]}", 1)
        return F.struct(count(first).alias("first_word"), (n - count(rest) - count(tail)).alias("last_word"))

    labels = lambda parts: F.array_compact(F.array(*[F.when(c > 0, F.lit(k)) for k, c in parts.items()]))
    base = F.when(F.col("text").rlike(any_phrase), common.let(count(F.col("text")), lambda n: F.struct(n.alias("n_words"), sum(found.values(), F.lit(0)).cast("bigint").alias("n_base"), places(n).alias("p"), labels(found).alias("base"))))
    base = base.otherwise(F.struct(count(F.col("text")).alias("n_words"), F.lit(0).cast("bigint").alias("n_base"), F.struct(F.lit(None).cast("bigint").alias("first_word"), F.lit(None).cast("bigint").alias("last_word")).alias("p"), F.array().cast("array<string>").alias("base")))
    based = source.select("row", "doc_id", base.alias("b"), F.when(F.col("text").rlike(any_prefix), blocks_of(F.col("text"), index)).alias("blocks"))
    rows = based.select("row", "doc_id", "b", F.explode_outer("blocks").alias("k")).select("row", "doc_id", "b", "k.seq", "k.whole", ordered(F.col("k.seq"), universe).alias("tokens"))
    met = containment_join(rows, index).select("row", F.struct("doc_id", "b").alias("d"), "label", "share")
    one = met.groupBy("row").agg(F.first("d").alias("d"), F.collect_set("label").alias("met"), F.max("share").alias("share"))
    base_labels, n_base = F.col("d.b.base"), F.col("d.b.n_base")
    return one.select(
        "d.doc_id", "d.b.n_words", "d.b.n_base", "d.b.p.first_word", "d.b.p.last_word",
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.col("met"))), ",").alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce(F.col("share"), F.lit(0.0))).alias("score"),
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 3 over all documents."""
    return scan(common.table(spark, sf_dir, "documents"))


_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _sql() -> str:
    def at(p: str) -> str:
        return "list_filter(range(1, len(w) + 1), lambda i: " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) + ")"

    known = ", ".join(f"({e['template']}, '{e['label']}', {e['words']!r}, {e['need']}, {e['span']})" for e in prefix_index(TEMPLATES, {}))
    starts = " || ".join(at(p) for p in PHRASES)
    base = ", ".join(f"CASE WHEN len({at(p)}) > 0 THEN '{label}' END" for p, label in PHRASES.items())
    return f"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '{_CLASS}') AS w FROM t),
p AS (SELECT rid, doc_id, len(w) AS n, list_sort({starts}) AS s, list_filter([{base}], lambda x: x IS NOT NULL) AS base FROM w),
l AS (SELECT rid, list_distinct(regexp_extract_all(line, '{_CLASS}')) AS b FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM t)),
k(template, label, words, need, span) AS (VALUES {known}),
kw AS (SELECT template, unnest(words) AS word FROM k),
h AS (SELECT rid, template, word, i FROM (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS i FROM w) JOIN kw USING (word)),
r AS (SELECT a.rid, k.label, count(DISTINCT b.word) / any_value(len(k.words)) AS share FROM h a JOIN k USING (template) JOIN h b ON b.rid = a.rid AND b.template = a.template AND b.i BETWEEN a.i AND a.i + k.span - 1
 GROUP BY a.rid, a.template, a.i, k.label HAVING count(DISTINCT b.word) >= any_value(k.need)),
hits AS (SELECT rid, label, len(list_intersect(b, words)) / len(words) AS share FROM l, k WHERE len(list_intersect(b, words)) >= need UNION ALL SELECT rid, label, share FROM r),
m AS (SELECT rid, list(DISTINCT label) AS met, max(share) AS share FROM hits GROUP BY rid)
SELECT doc_id, n::BIGINT AS n_words, len(s)::BIGINT AS n_base, (s[1] - 1)::BIGINT AS first_word, (s[len(s)] - 1)::BIGINT AS last_word,
 array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(base || coalesce(met, []))), ',') AS labels,
 CASE WHEN len(s) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score FROM p LEFT JOIN m USING (rid)"""


QUERIES = {"op3_licenses": op3_licenses}
SQL = {"op3_licenses": _sql()}
