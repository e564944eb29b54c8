"""Methods against brute force on small data."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from satloom.llm import attention, bpe, common, decontaminate, html_text, lm_scoring, near_dedup, quality_classifier, token_files, toxicity

public = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
DATA = "/root/testdata/sf0.001"
TEXT = st.text(alphabet=st.sampled_from(list(" \n\t \x1cabcdeE.,!'stlm12²日😀é́#")), max_size=40)


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(bpe.load_ranks(public.path("byte_bpe_50k.tiktoken")), public.PATTERN)


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r["text"] for r in common.table(spark, DATA, "documents").collect()}


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_bpe_is_that_of_tiktoken(codec, text):
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_perfect_hash(codec):
    h = codec.hash
    assert sorted(h.values) == sorted(codec.ranks.values()) and len(h.keys) == len(set(h.keys)) == h.n
    assert all(h.find(w) == r for w, r in list(codec.ranks.items())[::97]) and h.find(b"\xff no such word") == -1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500))
def test_directly_addressable_codes(ids):
    a = np.array(ids, np.uint32)
    levels, bitmaps, ranks = token_files.pack(a)
    assert token_files.unpack(levels, bitmaps).tolist() == ids
    for i in range(0, len(ids), 37):
        assert token_files.token_at(i, levels, bitmaps, ranks) == ids[i]


def test_token_file_query(spark, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    at = 0
    got = {r["doc_id"]: r for r in token_files.op10_token_files(spark, DATA).collect()}
    for i in sorted(documents):
        ids = [*t.encode(documents[i] or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_parts_over_line_breaks_need_no_pattern():
    import regex

    plain = lambda t: b"".join(w.encode() + b"|" for w in regex.findall(public.PATTERN, t))
    units = bpe.Units(public.PATTERN, lambda w: w.encode() + b"|", 8, 8)
    seen, real = [], units.split
    units.split = lambda t: seen.append(t) or real(t)
    for t in ["one two.\nThree four\nfive two, four", "one two.\nThree \u00e9t\u00e9!\n\u00c9t\u00e9 two"] * 2:
        assert units.encode(t) == plain(t)
    assert set(seen) == {"one"}
    for t in ["", " ", "a ", "a  b", "a \n b", "a\n ", "a b\u00a0 ", "a \u2003b", " a.\nb's c\n\nd e\n f", "two.\n two. \nthree ", "a 1\nb b\n1 " + "x" * 99 + ".\nb " + "x" * 99] * 3:
        assert units.encode(t) == plain(t)


def test_added_tokens_in_texts(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = ["one two", "one<|endoftext|> two", "<|endoftext|>", "a <|endoftext| > b", "x <|endoftext|><|endoftext|>y"]
    path = str(tmp_path / "t")
    token_files.write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), path, public.path("byte_bpe_50k.json"), public.PATTERN, 2)
    got = {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in token_files.read_tokens(spark, path).collect()}
    assert got == {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in enumerate(texts)}


def test_random_access_on_files(spark, documents, tmp_path):
    path = str(tmp_path / "t")
    token_files.write_tokens(common.table(spark, DATA, "documents").repartition(3), path, public.path("byte_bpe_50k.json"), public.PATTERN, 2)
    every = np.concatenate([np.frombuffer(bytes(r["ids"]), "<u4") for r in token_files.read_tokens(spark, path).orderBy("start").collect()])
    asked = [0, 0, len(every) - 1, *np.random.default_rng(1).integers(0, len(every), 300).tolist()]
    got = token_files.tokens_at(spark, path, spark.createDataFrame([(i,) for i in [*asked, len(every), -1]], "position long")).collect()
    assert sorted((r["position"], r["id"]) for r in got if r["id"] is not None) == sorted((i, int(every[i])) for i in asked)
    assert {r["position"] for r in got if r["id"] is None} == {len(every), -1}


def test_bpe_query(spark, documents, codec):
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    for r in bpe.op8_byte_bpe(spark, DATA).collect():
        text = documents[r["doc_id"]] or ""
        ids = enc.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(3)
    gaps = []
    for _ in range(40):
        a = Counter(rng.integers(0, 300, 500).tolist())
        b = +Counter({k: max(0, v + int(rng.integers(-1, 2))) for k, v in a.items()})
        bag = lambda c: (near_dedup.mix(np.array(sorted(c), np.uint64)), np.array([c[k] for k in sorted(c)]))
        x, y = near_dedup.signatures([bag(a), bag(b)])
        both = sum((a & b).values())
        gaps.append((x == y).mean() - both / (sum(a.values()) + sum(b.values()) - both))
    assert abs(np.mean(gaps)) < 0.02


def brute_classes(texts):
    bags = {i: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := near_dedup._words_of(t)) else None for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(sorted(texts), 2):
        if bags[i] and bags[j]:
            both = sum((bags[i] & bags[j]).values())
            if both >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in texts}


def test_near_duplicates_against_all_pairs(spark, documents):
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.op7_near_dedup(spark, DATA).collect()}
    assert got == brute_classes(documents)


def test_chain_of_near_copies_is_one_class(spark, tmp_path):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(60):
        texts[i] = " ".join(words)
        words[int(rng.integers(0, 200))] = f"n{i}"
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.op7_near_dedup(spark, str(tmp_path)).collect()}
    assert got == brute_classes(texts)


def test_leaks(spark, documents, tmp_path):
    item = "A train leaves Paris at 9 km and travels 120 km in 3 hours before it stops again near Lyon for 9 more minutes today"
    same = item.replace("120", "75").replace("9 km", "4 km").replace("for 9", "for 4").replace("Paris", "Rome").replace("3 hours", "2 hours")
    torn = item.replace("9 km", "4 km").replace("for 9", "for 5")
    texts = [(1, f"before it all. {item} and after"), (2, f"x y. {same} z"), (3, "nothing like it here at all in any place of this text"), (4, " ".join(item.split()[:7]) + " something else"), (5, torn)]
    bench = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    found = {r["doc_id"]: r["reparameterised"] for r in decontaminate.contamination(spark.createDataFrame(texts, "doc_id bigint, text string"), bench).collect()}
    assert found == {1: False, 2: True}


def test_verbatim_words_beside_torn_slots(spark):
    plain = "the old keeper of the lighthouse walked slowly along the quiet shore and counted every boat that came home before dark"
    item = f"It is 9 km from the harbour to the village and {plain} and then rested for 9 minutes at the gate"
    texts = [(1, item.replace("9 minutes", "5 minutes")), (2, item.replace("9 minutes", "5 minutes").replace(plain, "nobody has ever seen it"))]
    found = decontaminate.contamination(spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame([(7, item)], "item_id bigint, text string"))
    assert {r["doc_id"]: r["reparameterised"] for r in found.collect()} == {1: False}


def test_leaks_against_substrings(spark, documents):
    items = {r["item_id"]: r["text"] for r in common.table(spark, DATA, "benchmark").collect()}
    whole = {i for i, t in documents.items() for x in items.values() if x in t}
    got = {r["doc_id"] for r in decontaminate.op4_decontamination(spark, DATA).collect()}
    flat = lambda t: re.findall(r"\w+", t.lower())
    for i in got - whole:
        w, runs = flat(documents[i]), {tuple(v[k : k + 12]) for x in items.values() for v in [flat(x)] for k in range(max(1, len(v) - 11))}
        assert any(tuple(w[k : k + 12]) in runs for k in range(len(w)))
    assert whole <= got


def test_neighbours_are_exact():
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(700):
        at = np.sort(rng.choice(90, int(rng.integers(0, 9)), replace=False))
        rows.append((at, rng.integers(1, 4, len(at)).astype(float)))
    index = toxicity.Index(list(range(700)), rng.integers(0, 2, 700).astype(float), rows, 90)
    dense = np.zeros((700, 90))
    for place, i in enumerate(index.ids):
        dense[place, rows[i][0]] = index.weights(*rows[i])[0]
    for at, c in rows[:200]:
        w, _ = index.weights(at, c)
        places, got = index.nearest(at, w)
        every = dense[:, at] @ w
        want = np.sort(every[every > 0])[::-1][: toxicity.NEIGHBOURS]
        assert np.allclose(got, want) and np.allclose(every[places], got)


def auc(labels, scores):
    order = sorted(zip(scores, labels, strict=True))
    ranks = [i for i, (_, y) in enumerate(order) if y]
    n1 = len(ranks)
    return (sum(ranks) - n1 * (n1 - 1) / 2) / (n1 * (len(order) - n1))


@pytest.mark.parametrize("label,query,least", [("quality", quality_classifier.op5_quality_classifier, 0.95), ("toxic", toxicity.op1_toxicity, 0.85)])
def test_held_out_accuracy(spark, label, query, least):
    data = "/root/testdata/sf0.01"
    y = {r["doc_id"]: r[label] for r in common.table(spark, data, "labels").collect()}
    rows = [r for r in query(spark, data).collect() if r["held_out"] and r["doc_id"] in y]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert auc([y[r["doc_id"]] for r in rows], [r["score"] for r in rows]) > least


def test_attention_gradients_and_tables():
    model = attention.Attention(7, width=4, inner=5, context=4, hop=4)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(0)
    inputs, targets, first = model.windows([rng.integers(0, 7, n) for n in (3, 0, 9, 14)])
    assert first.tolist() == [0, 1, 1, 4, 8] and (targets >= 0).sum() == 26
    loss, grad = model.gradients(inputs, targets)
    for k, p in model.p.items():
        at = tuple(rng.integers(0, s) for s in p.shape)
        p[at] += 1e-5
        up, _ = model.gradients(inputs, targets)
        p[at] -= 2e-5
        down, _ = model.gradients(inputs, targets)
        p[at] += 1e-5
        assert abs((up - down) / 2e-5 - grad[k][at]) < 1e-4
    model.prepare()
    assert abs(-model.log_probs(inputs, targets).sum() / 26 - loss) < 1e-4


def test_levels_gradients_and_probabilities():
    model = attention.Levels(np.array([50, 0, 9, 8, 7, 2, 1, 1, 1, 0], float), classes=4, width=4, inner=5, context=4, hop=4)
    model.p = {k: v.astype(np.float64) + 0.1 for k, v in model.p.items()}
    rng = np.random.default_rng(0)
    inputs, targets, _ = model.windows([rng.integers(0, 10, n) for n in (3, 0, 9, 14)])
    loss, grad = model.gradients(inputs, targets)
    for k, p in model.p.items():
        at = tuple(rng.integers(0, s) for s in p.shape)
        p[at] += 1e-5
        up, _ = model.gradients(inputs, targets)
        p[at] -= 2e-5
        down, _ = model.gradients(inputs, targets)
        p[at] += 1e-5
        assert abs((up - down) / 2e-5 - grad[k][at]) < 1e-4
    model.prepare()
    assert abs(-model.log_probs(inputs, targets).sum() / 26 - loss) < 1e-4
    each = [model.log_probs(inputs[:1], np.where(np.arange(4) == 2, i, -1)[None]).sum() for i in range(10)]
    assert abs(np.exp(each).sum() - 1) < 1e-4


def test_a_step_projects_each_id_once():
    rows = []

    class Noted(np.ndarray):
        def __array_ufunc__(self, ufunc, method, *args, **how):
            rows.extend([args[0].size // args[0].shape[-1]] * (ufunc is np.matmul))
            return getattr(ufunc, method)(*(np.asarray(x) for x in args), **how)

    model = attention.Levels(np.array([50, 0, 9, 8, 7, 2, 1, 1, 1, 0], float), classes=4, width=4, inner=5, context=4, hop=4)
    inputs, targets, _ = model.windows([np.array([2, 3, 2, 4, 3] * 20), np.array([4, 2])])
    plain = model.gradients(inputs, targets)
    for k in ("K", "V"):
        model.p[k] = model.p[k].view(Noted)
    noted = model.gradients(inputs, targets)
    assert len(rows) >= 4 and max(rows) <= len(np.unique(inputs))
    assert noted[0] == plain[0] and all(np.array_equal(noted[1][k], plain[1][k]) for k in plain[1])


def test_lm_sees_the_order_of_frequent_words(spark):
    names = [f"{a}{b}" for a in ("ba", "ko", "mi", "tu", "re") for b in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJ"]
    rng = np.random.default_rng(2)
    cycle = lambda n: [w for _ in range(n) for w in ("stone", "river", "cloud")]
    texts = [(i, " ".join([*(names[j] for j in rng.permutation(len(names))), *cycle(20)])) for i in range(1, 41)]
    docs = spark.createDataFrame([*texts, (100, " ".join(names)), (101, " ".join(reversed(names))), (102, "river stone cloud " * 20), (103, "stone river cloud " * 20)], "doc_id bigint, text string")
    model, counts = lm_scoring.fit(docs.where("doc_id < 100"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    got = {r["doc_id"]: r for r in lm_scoring.score(docs.where("doc_id >= 100"), model, counts, ["doc_id"]).collect()}
    assert math.isclose(got[102]["base_score"], got[103]["base_score"], rel_tol=1e-9)
    assert got[100]["score"] != got[101]["score"] and got[103]["score"] > got[102]["score"] + 1


def test_lm_is_fitted_on_all_rows(spark):
    texts = [f"{'stone' if i % 2 else 'river'} number {i}" for i in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(2)
    model, _ = lm_scoring.fit(docs, public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        raw = lm_scoring.Speller(f.read(), public.PATTERN, []).raw
    every = [i for t in texts for w in lm_scoring.words_of(t) for i in raw(w)]
    assert model["known"] == sorted(set(every)) and model["trained"] == len(every) + len(texts)


def test_lm_base_scores(spark, documents):
    rows = lm_scoring.op2_lm_score(spark, DATA).collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter()
    for i, t in documents.items():
        if not held(i):
            counts.update([*lm_scoring.words_of(t), b""])
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        words = [*lm_scoring.words_of(documents[r["doc_id"]]), b""]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(words), sum(counts[w] > 0 for w in words), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0


def test_lm_fit_reads_each_text_twice(spark):
    seen = spark.sparkContext.accumulator(0)

    def noted(text):
        seen.add(1)
        return text

    docs = spark.createDataFrame([(i, f"stone number {i}") for i in range(60)], "doc_id bigint, text string")
    docs = docs.select("doc_id", F.udf(noted)("text").alias("text"))
    model, counts = lm_scoring.fit(docs, public.path("byte_bpe_50k.tiktoken"), public.PATTERN, steps=3)
    assert model["total"] == 240 and seen.value <= 2 * 60  # the words are counted, then the ids are stored


def test_lm_ids_of_words_together():
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        speller = lm_scoring.Speller(f.read(), public.PATTERN, [])
    plain = ["a", "'s", "don't", "1234", "x9y", "...", "Straße", "\u4e2d\u6587", "\x00", "it's!", "#", "e\u0301"] * 60
    for words in (plain, [*plain, "\u00a0", "a\u00a0", "\u00a0\u00a0b", "\u2003x", "\u0085", "\x1c"] * 2, []):
        words = [w.encode() for w in words]
        ids, sizes = speller.raws(words)
        assert ids.tolist() == [i for w in words for i in speller.raw(w)] and sizes.tolist() == [len(speller.raw(w)) for w in words]


@given(st.lists(st.none() | TEXT, max_size=6))
@settings(deadline=None)
def test_lm_words_split(texts):
    lists = lm_scoring.split(pa.array([None, *texts], pa.string())[1:])
    assert [[w.encode() for w in x or [] if w] for x in lists.to_pylist()] == [lm_scoring.words_of(t) for t in texts]


def test_lm_reader_forgets_words_beyond_the_table(monkeypatch):
    monkeypatch.setattr(lm_scoring, "CACHE_WORDS", 3)
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        speller = lm_scoring.Speller(f.read(), public.PATTERN, [])
    reader = lm_scoring.Reader([(b"stone", 3), (b"river", 2)], 8, 5, 2, speller)
    same = np.arange(reader.end + 1, dtype=np.int32)
    for texts in (["stone a b stone"], [None, "c d c", "river"], ["e f g h i stone e"], ["a stone", ""]):
        n, known, base, rare, ids = reader.read(pa.array(texts, pa.string()))
        words = [lm_scoring.words_of(t) for t in texts]
        assert n.to_pylist() == [len(w) + 1 for w in words]
        assert known.to_pylist() == [1 + sum(x in (b"stone", b"river") for x in w) for w in words]
        assert [{r["word"]: r["n"] for r in x} for x in rare.to_pylist()] == [Counter(x for x in w if x not in (b"stone", b"river")) for w in words]
        assert [x.tolist() for x in lm_scoring.streams(ids, np.uint16, same)] == [[*(i for x in w for i in speller.raw(x)), reader.end] for w in words]
        c = {b"stone": 3, b"river": 2}
        for got, w in zip(base.to_pylist(), words, strict=True):
            assert math.isclose(got, sum(math.log10((x + 0.1) / 8.6) for x in [2, *(c[y] for y in w if y in c)]))


def test_levels_large_logits():
    for factor in (1, 300):
        model = attention.Levels(np.array([50, 0, 9, 8, 7, 2, 1, 1, 1, 0], float), classes=4, width=4, inner=5, context=4, hop=4)
        model.p = {k: v.astype(np.float64) * (factor if k in "UQ" else 1) for k, v in model.p.items()}
        inputs, targets, _ = model.windows([np.arange(10), np.arange(3)])
        loss, grad = model.gradients(inputs, targets)
        model.prepare()
        logs = model.log_probs(inputs, targets)
        assert math.isclose(loss, -logs.sum() / 13, rel_tol=1e-5) and (logs[targets < 0] == 0).all() and all(np.isfinite(g).all() for g in grad.values())
        p = np.exp([[model.log_probs(inputs[:1], np.where(np.arange(4) == 2, i, -1)[None])[0, 2] for i in range(10)]])
        assert math.isclose(p.sum(), 1, rel_tol=1e-5)


def test_page_text(spark):
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href=x>m</a></ul></nav><div class='ad'>buy</div><article><h1>H</h1><p><b>one &amp; two<br><p>three\n four</p><form>f</form></article><div id=comments><p>no</div><footer>f</footer>"
    assert html_text.main_text(page) == "H\none & two\nthree four"
    bare = "<body><div>short</div>" + "<p>" + "long words here " * 20 + "</p>" * 1 + "<p>" + "more of them " * 20 + "</p><div><a>x</a><a>y</a></div>"
    assert "long words" in html_text.main_text(bare)
