"""Stages and operators at their edges, with clashing columns; methods that SQL can't express against brute force."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from satloom.llm import common, decontaminate, near_dedup, quality_classifier, quality_rules
from tests.llm.test_edges import CASES, LONG, docs

DATA = "/root/testdata/sf0.001"
EXTRA = "doc_id bigint, text string, n_words string, failed string, m string, x string, score string, predicted string, row string, node string, hash string, n string"


@pytest.fixture(params=["rows", "empty"])
def table(spark, request):
    rows = [(i, t, *[f"MINE{k}" for k in range(10)]) for i, t in CASES] if request.param == "rows" else []
    return spark.createDataFrame(rows, EXTRA)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stage_passes_columns_on(spark, table, name, stage):
    kept = stage(spark, table, DATA)
    assert kept.schema.names == table.schema.names and [f.dataType for f in kept.schema] == [f.dataType for f in table.schema]
    rows = kept.collect()
    assert all(r["n_words"] == "MINE0" and r["failed"] == "MINE1" and r["m"] == "MINE2" for r in rows)
    given = {(r["doc_id"], r["text"]) for r in table.collect()}
    assert {(r["doc_id"], r["text"]) for r in rows} <= given
    if name == "decontamination":
        assert len(rows) == table.count()


def test_last_stage_and_run(spark, table, tmp_path):
    rows = corpus_pipeline.encode(spark, table, DATA).collect()
    assert len(rows) == table.count() and all(r["n_tokens"] * 4 == len(r["ids"]) for r in rows)
    for name in ("labels", "benchmark"):
        common.table(spark, DATA, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs(spark, CASES if rows else []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= len(rows)


def test_windows_whose_hashes_collide(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(list("abcde"), int(n))) for n in rng.integers(0, 60, 60)]

    def brute(text):
        w, at = text.split(), defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        return len({p for x in at.values() if len(x) > 1 for i in x for p in (i, i + 1, i + 2)})

    w = quality_rules.words(F.col("t"))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", quality_rules.repeated_words(w).alias("n"), quality_rules.repeated_words(w, hash_bits=2).alias("few"), quality_rules.repeated_words(w, place_bits=1, hash_bits=1).alias("wide")).collect()
    assert all(r["n"] == r["few"] == r["wide"] == brute(texts[r["i"]]) for r in got)


def test_compiled_rules_are_the_matrix_and_lasso_holds(spark):
    labels = common.table(spark, "/root/testdata/sf0.01", "labels")
    sample = quality_classifier.statistics(quality_classifier.training_sample(common.table(spark, "/root/testdata/sf0.01", "documents"), labels, "quality"))
    rows = sample.select("doc_id", "y", "x.*").orderBy("doc_id", *quality_classifier.FEATURES).toPandas()
    x, y = rows[quality_classifier.FEATURES].to_numpy(float), rows["y"].to_numpy(float)
    model = quality_classifier.fit_rules(x, y)
    a = model.matrix(x).astype(float)
    want = 1 / (1 + np.exp(-(a @ np.array(model.weights) + model.bias)))
    got = sample.select("doc_id", model.column(F.col("x")).alias("s"), "x.*").orderBy("doc_id", *quality_classifier.FEATURES).toPandas()
    assert np.allclose(got["s"], want, atol=1e-12) and len(model.rules) == len(model.weights) > 0
    # At the minimum of the lasso every kept rule's gradient equals the penalty, with the sign of its weight.
    scale = np.maximum(a.std(0), 0.02)
    gradient = (a / scale).T @ (want - y) / len(y)
    assert np.abs(gradient + 2e-3 * np.sign(model.weights)).max() < 1e-3 and abs((want - y).mean()) < 1e-3


def brute_windows(canon, text, whole):
    """(size, template, place, slots) by the words themselves, both with and without names as slots."""
    raw, _, _, kinds = canon.words(text or "")
    core = [decontaminate._strip("", w).lower() for w in raw]
    n, sizes = len(raw), set()
    out = set()
    for plain in (False, True):
        k = [0 if plain and x == decontaminate.NAME else int(x) for x in kinds]
        first = decontaminate.WINDOW if not whole else min(decontaminate.WINDOW, n)
        sizes = {first, *whole_sizes} if not whole else {first}
        heavy = set()
        for size in sizes - {0}:
            for p in range(n - size + 1):
                own = k[p : p + size]
                dense = 2 * sum(x > 0 for x in own) > size
                if dense and size == decontaminate.WINDOW:
                    heavy.add(p)
                key = tuple(core[p + i] if dense or not own[i] else f"<{own[i]}>" for i in range(size))
                out.add((size, dense, key, p, tuple(core[p + i] for i in range(size) if own[i])))
        for size in {min(decontaminate.LONG, n)} if whole else whole_long:
            for p in range(n - size + 1) if size > decontaminate.WINDOW else ():
                own = k[p : p + size]
                if any(p <= q <= p + size - decontaminate.WINDOW for q in heavy) and 2 * own.count(0) >= decontaminate.WINDOW:
                    out.add((size, False, tuple(core[p + i] if not own[i] else f"<{own[i]}>" for i in range(size)), p, tuple(core[p + i] for i in range(size) if own[i])))
    return n, out


whole_sizes: set[int] = set()
whole_long: set[int] = set()


def test_decontamination_against_brute_force(spark):
    documents, benchmark = common.table(spark, DATA, "documents"), common.table(spark, DATA, "benchmark")
    extra = [(9001, DENSE.replace("12 3 4", "7 8 11").replace("14", "17")), (9002, TRAIN.upper()), (9003, "x " + TRAIN.lower() + " y")]
    documents = documents.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id bigint, text string"))
    benchmark = benchmark.select("item_id", "text").union(spark.createDataFrame([(801, DENSE), (802, TRAIN), (803, "a short item of six words"), (804, "It took 3 hours and 4 minutes to go 5 km")], "item_id bigint, text string"))
    canon = decontaminate.Canon()
    items = {}
    for r in benchmark.collect():
        items.setdefault(r["text"], r["item_id"])
    by_item = {i: brute_windows(canon, t, True) for t, i in items.items()}
    whole_sizes.update(s for _, w in by_item.values() for s, *_ in w if s < decontaminate.WINDOW)
    whole_long.update(s for _, w in by_item.values() for s, *_ in w if s > decontaminate.WINDOW)
    index = defaultdict(list)
    for i, (_, w) in by_item.items():
        for size, dense, key, p, slots in w:
            index[size, dense, key].append((i, p, slots))
    want = set()
    for r in documents.collect():
        met = defaultdict(set)
        for size, dense, key, p, slots in brute_windows(canon, r["text"], False)[1]:
            for i, q, there in index.get((size, dense, key), ()):
                met[i].add((p, q, size, slots, there))
        for i, found in met.items():
            n = by_item[i][0]
            covered, run, _ = decontaminate.judge(n, [(p, q, s, list(a), list(b)) for p, q, s, a, b in found])
            if run >= min(decontaminate.RUN, n) or covered >= decontaminate.RUN and covered / n >= decontaminate.SHARE:
                want.add((r["doc_id"], i))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(documents, benchmark).collect()}
    assert got == want and {(9001, 801), (9002, 802), (9003, 802)} <= got


DENSE = "Solve 12 3 4 minus 5 6 and walk 9 km in 14 hours 15 min or 16 km in 20 hours 30 min before you add 40 50 60 again"
TRAIN = "A train leaves Paris and Rome and Berlin and Madrid before Anna meets Peter near Lyon and Turin with Maria today"


def test_stretch_of_a_torn_diagonal(spark):
    words = " ".join(f"word{i} is {i} km" for i in range(12))
    item = f"{words} and the end is 3 km"
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    texts = [(1, item.replace("end is 3 km", "end is 77 km")), (2, "nothing of that kind")]
    found = decontaminate.contamination(spark.createDataFrame(texts, "doc_id bigint, text string"), bench).collect()
    assert [r["doc_id"] for r in found] == [1]


def test_join_by_shuffle_equals_broadcast(spark, monkeypatch):
    documents, benchmark = common.table(spark, DATA, "documents"), common.table(spark, DATA, "benchmark")
    want = sorted(map(tuple, decontaminate.contamination(documents, benchmark).collect()), key=str)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, decontaminate.contamination(documents, benchmark).collect()), key=str) == want


def test_two_interleaved_groups_of_near_copies(spark, tmp_path):
    """Members of either group differ from its middle by one to four words, so that many pairs are near the threshold."""
    rng = np.random.default_rng(5)
    a, b = ([f"{c}{i}" for i in range(90)] for c in "ab")
    b[:30] = a[:30]
    texts = {}
    for i in range(240):
        w = list((a, b)[i % 2])
        for p in rng.choice(90, int(rng.integers(0, 6)), replace=False):
            w[p] = f"n{rng.integers(0, 12)}"
        texts[i] = " ".join(w)
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in near_dedup.op7_near_dedup(spark, str(tmp_path)).collect()}
    from tests.llm.test_methods import brute_classes

    want = brute_classes(texts)
    assert {i: r["class_id"] for i, r in got.items()} == want
    assert all((r["n_links"] > 0 or r["n_copies"] > 1) == (list(want.values()).count(want[i]) > 1) for i, r in got.items())


def test_difference_bounds_every_similar_pair():
    """Of two similar bags, one far from the center, the prefixes of the differences share a hash."""
    rng = np.random.default_rng(8)
    for _ in range(300):
        base = rng.integers(0, 60, 50)
        bags = []
        for _ in range(3):
            w = base.copy()
            w[rng.choice(50, int(rng.integers(0, 9)), replace=False)] = rng.integers(0, 90)
            v, c = np.unique(w, return_counts=True)
            bags.append((near_dedup.mix(v.astype(np.uint64)), c))
        bags = [(v[o], c[o]) for v, c in bags for o in [np.argsort(v.view(np.int64))]]
        seen = defaultdict(int)
        for v, _ in bags:
            for x in v.tolist():
                seen[x] += 1
        full = [tuple(x[[seen[i] > 1 for i in v.tolist()]] for x in (v.view(np.int64), c.astype(np.int64), np.array([seen[i] for i in v.tolist()]))) for v, c in bags]
        center, y, z = full
        d1, t1 = near_dedup.difference(center, 50, y, 50, 3)
        d2, t2 = near_dedup.difference(center, 50, z, 50, 3)
        order = [(v[np.argsort(v)], c[np.argsort(v)]) for v, c in bags]
        s = near_dedup.similarity(*order[1], *order[2])
        assert abs((100 - d1) / (100 + d1) - near_dedup.similarity(*order[0], *order[1])) < 1e-9
        if s >= 0.8 and (9 * d1 > 100 or 9 * d2 > 100):
            assert set(t1.tolist()) & set(t2.tolist())


def test_long_text_is_whole(spark):
    kept = quality_rules.ledger(docs(spark, [(1, LONG)])).collect()[0]
    assert kept["n_words"] == len(LONG.split())


def test_ratio_decides_where_nothing_is_marked(spark):
    """Pages without marks keep their article, and without any name of a menu, footer or advert its lines still go."""
    import re
    from collections import Counter

    from satloom.llm import html_text

    pages = [r["html"] for r in common.table(spark, "/root/testdata/sf0.01", "pages").collect()]

    def lines(html, names):
        parser = html_text.Lines()
        parser.feed(re.sub(r' class="?ad"?', "" if "nav" in names else r"\g<0>", re.sub(rf"<(/?)(?:{names})\b", r"<\1div", html)))
        parser.close()
        parser.flush()
        return parser.lines

    for names, least, changed in (("article|main", (0.99, 0.98), 0), ("article|main|nav|footer|header|aside", (0.8, 0.95), 0.9)):
        same = given = wanted = n = 0
        for html in pages:
            want, every = html_text.main_text(html).split("\n"), lines(html, names)
            got = html_text.regions(every)
            same += sum((Counter(want) & Counter(got)).values())
            given, wanted, n = given + len(got), wanted + len(want), n + (len(got) < len(every))
        assert same / given >= least[0] and same / wanted >= least[1] and n >= changed * len(pages)


def test_page_marks_and_names():
    from satloom.llm import html_text

    assert html_text.main_text("<main><div class='post related'>body</div></main>") == "body"
    assert html_text.main_text("<article>a<p/>b</article>") == "a\nb"
    assert html_text.main_text("<article>a<div class='related-posts'>x</div><div class=share>y</div></article>") == "a"
