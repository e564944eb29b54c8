"""Language-model scores of whole texts (operator 2), beside the base score by word counts.

The model sees a text as the byte-level BPE ids of all its words (a blank before each) and an end.  A
causal self-attention model scores this stream in overlapping windows; its output is a class of ids, times
the share of the id in its class over all training rows; frequent ids are classes of their own.  Ids that no training word has are one id, shared evenly.  The score is the log10 of
the product over all ids.

Counts cover all training rows.  Words of the table (at most ``TABLE``, by count) are looked up in each
worker; all others are joined by shuffle, so the base score is exact whatever the vocabulary's size.
The model is fitted on every window of every training row: each partition makes steps from the same
model, and the results, weighted by their ids, are averaged over rounds; a row belongs to one round.
Every text is read once for the fit and the scores: its ids are stored in the shared folder.

Null texts count as empty: the end alone.  Repeated rows are scored one by one; ties don't matter; an
empty table gives no rows; without training rows N and V are 0.
"""

from __future__ import annotations

import base64
import copy
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .attention import Levels

FOLDS = 10
TABLE = 150_000
#: Longer words go to the join, so that the table is bounded in bytes too.
TABLE_BYTES = 40
#: Words beyond the table that a worker keeps, besides those of the texts at hand.
CACHE_WORDS = 250_000
#: Words that are counted together in a task.
TOGETHER_COUNTED = 2_500_000
#: Words that are encoded in one call, and white space in them that the pattern may match with the blank between two.
TOGETHER, ODD_SPACE = 512, re.compile(r"[^\S ]")
#: Hundredths of the training rows where the rounds of the fit end, and the rate of the steps in each.
ROUNDS = ((2, 0.01), (15, 0.01), (50, 0.006), (100, 0.003))
#: Windows of a step, and those that are shuffled together.
STEP_WINDOWS, SHUFFLED = 256, 8192
#: A partition of fewer windows goes over them again until it has made so many steps in a round.
LEAST_STEPS = 100


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def split(texts: pa.Array) -> pa.ListArray:
    """``words_of`` of every text; white space at its ends, or no word, gives an empty one besides."""
    return pc.ascii_split_whitespace(pc.ascii_lower(texts))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over all rows; the end is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held, ends = [], 0, 0
        for batch in batches:
            for start, end in common.pieces(batch):
                waiting.append(split(batch.column("text")[start:end]).flatten())
                held, ends = held + len(waiting[-1]), ends + end - start
                if held > TOGETHER_COUNTED:
                    yield out(waiting)
                    waiting, held = [], 0
        if waiting:
            yield out(waiting)
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([ends], pa.int64())], ["word", "c"])

    def out(waiting: list[pa.Array]) -> pa.RecordBatch:
        counts = pc.value_counts(pa.concat_arrays(waiting))
        words, c = counts.flatten()
        some = pc.greater(pc.binary_length(words), 0)
        return pa.RecordBatch.from_arrays([words.filter(some).cast(pa.binary()), c.filter(some).cast(pa.int64())], ["word", "c"])

    common.importable(docs.sparkSession)
    common.small_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Speller:
    """Byte-level BPE ids of words, and as the ids of the model: ``known``, any other, the end."""

    def __init__(self, rank_file: bytes, pattern: str, known: list[int]):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_file.splitlines() if x.strip())}
        self.encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.blank = np.zeros(raw_end(rank_file), bool)
        self.blank[[i for x, i in ranks.items() if x[:1] == b" "]] = True

    def raw(self, word: bytes) -> list[int]:
        return self.encode(" " + word.decode("utf-8", "replace"))

    def raws(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ``raw`` ids of many words in one array, and how many each has.

        Words are encoded many at a time: no match of the pattern reaches over the one blank between two words, unless
        there is other white space beside it.  The blank is in the first id of a word and in no other.
        """
        flat: list[int] = []
        for a in range(0, len(words), TOGETHER):
            text = " " + b" ".join(words[a : a + TOGETHER]).decode("utf-8", "replace")
            if ODD_SPACE.search(text):
                for w in words[a : a + TOGETHER]:
                    flat += self.raw(w)
            else:
                flat += self.encode(text)
        ids = np.array(flat, np.int32)
        return ids, np.diff(np.flatnonzero(self.blank[ids]), append=len(ids))


def raw_end(rank_file: bytes) -> int:
    """The raw id of a text's end: one more than the largest of the ranks."""
    return 1 + max(int(x.split()[1]) for x in rank_file.splitlines() if x.strip())


def id_type(end: int) -> type:
    """How raw ids are stored."""
    return np.uint16 if end < 1 << 16 else np.int32


def model_ids(end: int, known: list[int]) -> np.ndarray:
    """The ids of the model by raw ids: ``known``, any other, the end."""
    of = np.full(end + 1, len(known), np.int32)
    of[known] = np.arange(len(known))
    of[end] = len(known) + 1
    return of


def streams(column: pa.Array, kind: type, of: np.ndarray) -> list[np.ndarray]:
    """Ids of the model of each stored text."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    flat = of.take(np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind))
    cut = ((ends - ends[0]) // np.dtype(kind).itemsize).tolist()
    return [flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


class Places(dict):
    """Places of words; a word without one gets the next, and is ``new``."""

    def __init__(self, known: dict[bytes, int]):
        super().__init__(known)
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at


class Reader:
    """What a worker needs to read texts: the word table, and the raw ids of the words seen."""

    def __init__(self, table: list[tuple[bytes, int]], total: int, distinct: int, ends: int, speller: Speller):
        self.speller, self.ends, self.end = speller, ends, len(speller.blank)
        # The end of a text is a word of the table.
        words = [w for w, _ in table]
        self.table = {w: i for i, w in enumerate([b"", *words])}
        self.base = np.log10((np.array([ends, *(c for _, c in table)], float) + 0.1) / (total + 0.1 * (distinct + 1)))
        ids, sizes = speller.raws(words)
        self.ids, self.sizes = np.append(self.end, ids).astype(id_type(self.end)), np.append(1, sizes)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.fixed = self.ids, self.sizes, self.begin
        self.at = Places(self.table)

    def codes(self, words: list[bytes]) -> np.ndarray:
        """Places of words in the tables; words not seen before get a new place."""
        if len(self.at) > len(self.table) + CACHE_WORDS:
            self.at, (self.ids, self.sizes, self.begin) = Places(self.table), self.fixed
        out = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        if self.at.new:
            ids, sizes = self.speller.raws(self.at.new)
            self.begin = np.append(self.begin, len(self.ids) + np.cumsum(sizes) - sizes)
            self.ids, self.sizes = np.append(self.ids, ids.astype(self.ids.dtype)), np.append(self.sizes, sizes)
            self.at.new.clear()
        return out

    def read(self, texts: pa.Array) -> list[pa.Array]:
        """Per text: tokens, tokens known by the table, their base score, (word, n) beyond the table, raw ids with the end."""
        lists = split(texts)
        encoded = lists.flatten().dictionary_encode()
        distinct, which = encoded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), encoded.indices.to_numpy()
        of = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        real = which != pc.index(encoded.dictionary, "").as_py()
        which, of = which[real], of[real]
        # An end, place 0, after the words of each text.
        edges = np.append(0, np.cumsum(np.bincount(of, minlength=len(texts)) + 1))
        codes = np.zeros(edges[-1], np.int64)
        codes[np.arange(len(of)) + of] = self.codes(distinct).take(which)
        sizes = self.sizes.take(codes)
        ends = np.cumsum(sizes)
        ids = self.ids.take(np.repeat(self.begin.take(codes) - ends + sizes, sizes) + np.arange(ends[-1]))
        in_table = codes < len(self.table)
        base = self.base.take(np.where(in_table, codes, 0))
        base *= in_table
        known = np.add.reduceat(in_table, edges[:-1], dtype=np.int64) - (self.ends == 0)
        at = np.flatnonzero(~in_table)
        text = np.searchsorted(edges, at, "right") - 1
        _, first, n = np.unique(text * np.int64(len(self.at)) + codes[at], return_index=True, return_counts=True)
        words = pa.array([distinct[i] for i in which[at[first] - text[first]].tolist()], pa.binary())
        starts = np.append(0, np.cumsum(np.bincount(text[first], minlength=len(texts)))).astype(np.int32)
        rare = pa.ListArray.from_arrays(pa.array(starts), pa.StructArray.from_arrays([words, pa.array(n, pa.int64())], ["word", "n"]))
        cut = (np.append(0, ends)[edges] * ids.itemsize).astype(np.int32)
        binary = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(cut), pa.py_buffer(ids)])
        return [pa.array(np.diff(edges)), pa.array(known), pa.array(np.add.reduceat(base, edges[:-1])), rare, binary]


def _table(counts: DataFrame, limit: int) -> list[tuple[bytes, int]]:
    """The most frequent words: all with at least the least count that keeps their number within the limit."""
    short = counts.where((F.length("word") > 0) & (F.length("word") <= TABLE_BYTES))
    total, least = 0, 1 << 62
    for r in short.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).limit(limit).toLocalIterator():
        total += r["n"]
        if total > limit:
            break
        least = r["c"]
    rows = [(bytes(r["word"]), r["c"]) for r in short.where(F.col("c") >= least).collect()]
    return sorted(rows, key=lambda x: (-x[1], x[0]))


def read(docs: DataFrame, words: dict, keep: list[str]) -> DataFrame:
    """Every text read once, for the fit and the scores: ``row``, ``keep`` columns and what ``Reader.read`` returns."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        w = shared.value
        _, reader = common.kept("lm", id(w), lambda: (w, Reader(w["table"], w["total"], w["distinct"], w["ends"], Speller(w["rank_file"], w["pattern"], []))))
        for start, end in common.pieces(batch, most=1 << 22):
            made = reader.read(batch.column("text")[start:end])
            yield pa.RecordBatch.from_arrays([*[batch.column(k)[start:end] for k in ["row", *keep]], *made], ["row", *keep, "n_tokens", "known", "base", "rare", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), *keep, "text")
    return common.stored(common.arrow_map(rows, run, f"row long, {_columns(docs, keep)}n_tokens long, known long, base double, rare array<struct<word:binary,n:bigint>>, ids binary"), "lm-texts")


def _columns(df: DataFrame, keep: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for k in keep for f in df.schema if f.name == k)


def count_ids(texts: DataFrame, end: int) -> np.ndarray:
    """How often each raw id occurs in all training rows, the end included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses, same = np.zeros(end + 1, np.int64), np.arange(end + 1, dtype=np.int32)
        for batch in batches:
            if batch.num_rows:
                uses += np.bincount(np.concatenate(streams(batch.column("ids"), id_type(end), same)), minlength=end + 1)
        at = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(uses[at])], ["i", "c"])

    uses = np.zeros(end + 1, np.int64)
    for r in texts.select("ids").mapInArrow(run, "i int, c long").groupBy("i").agg(F.sum("c").alias("c")).collect():
        uses[r["i"]] = r["c"]
    return uses


def train(texts: DataFrame, lm: Levels, end: int, known: list[int], steps: int | None = None) -> int:
    """Fit ``lm`` on all rows by rounds of averaged partitions; returns the ids it was fitted on."""
    spark = texts.sparkSession
    low = trained = 0
    for high, rate in ROUNDS:
        shared = spark.sparkContext.broadcast((lm, model_ids(end, known)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, rate=rate) -> Iterator[pa.RecordBatch]:
            own, of = shared.value
            own = copy.deepcopy(own)
            rng, state, n, done = np.random.default_rng(TaskContext.get().partitionId()), {}, 0, 0
            waiting, held = [], 0

            def learn() -> None:
                nonlocal waiting, held, n, done
                inputs, targets, _ = own.windows(waiting)
                waiting, held = [], 0
                n += int((targets >= 0).sum())
                again = True
                while again:
                    order = rng.permutation(len(inputs))
                    for a in range(0, len(order), STEP_WINDOWS):
                        if steps is None or done < steps:
                            at = order[a : a + STEP_WINDOWS]
                            own.update(inputs[at], targets[at], state, rate)
                            done += 1
                    again = done < LEAST_STEPS and (steps is None or done < steps)

            for batch in batches:
                for ids in streams(batch.column("ids"), id_type(end), of) if batch.num_rows else ():
                    waiting.append(ids)
                    held += len(ids)
                    if held >= SHUFFLED * own.hop:
                        learn()
            if waiting:
                learn()
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(own.packed() * np.float64(n)).tobytes()], pa.binary())], ["n", "p"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, 0.0
            for batch in batches:
                for m, p in zip(batch.column("n"), batch.column("p"), strict=True):
                    n, total = n + m.as_py(), total + np.frombuffer(p.as_py())
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "p"])

        part = texts.where((F.col("place") >= low) & (F.col("place") < high)).select("ids")
        n, total = 0, 0.0
        for r in part.mapInArrow(run, "n long, p binary").repartition(8).mapInArrow(add, "n long, p binary").toLocalIterator():
            n, total = n + r["n"], total + np.frombuffer(bytes(r["p"]))
        if n:
            lm.unpack(total / n)
        low, trained = high, trained + n
    lm.prepare()
    return trained


def count(docs: DataFrame, vocabulary: str, pattern: str) -> tuple[dict, DataFrame]:
    """What the workers need to read texts, and the counts of all words.  ``docs``: text, of the training rows."""
    counts = common.stored(count_words(docs), "word-counts")
    sums = counts.agg(F.sum("c").alias("total"), F.count("*").alias("distinct"), F.sum(F.when(F.length("word") == 0, F.col("c"))).alias("ends")).first()
    with open(vocabulary, "rb") as f:
        rank_file = f.read()
    return {"table": _table(counts, TABLE), "total": sums["total"] or 0, "distinct": sums["distinct"], "ends": sums["ends"] or 0, "rank_file": rank_file, "pattern": pattern}, counts


def learn(texts: DataFrame, words: dict, steps: int | None = None) -> dict:
    """The model.  ``texts``: ids, place, of the training rows."""
    end = raw_end(words["rank_file"])
    uses = count_ids(texts, end)
    known = np.flatnonzero(uses[:end]).tolist()
    lm = Levels(np.append(uses[known], [0, uses[end]]).astype(float))
    # Ids that no training word has share the probability of one.
    other = sum(1 for x in words["rank_file"].splitlines() if x.strip()) - len(known)
    return words | {"lm": lm, "known": known, "end": end, "log_other": float(np.log(max(1, other))), "trained": train(texts, lm, end, known, steps)}


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` with the place of each row in the rounds of the fit."""
    return docs.withColumn("place", F.pmod(F.xxhash64("doc_id", "text"), F.lit(100)))


def fit(docs: DataFrame, vocabulary: str, pattern: str, steps: int | None = None) -> tuple[dict, DataFrame]:
    """The model, and the counts of all training rows.  ``docs``: doc_id, text, of the training rows.

    ``steps`` bounds the batches of a partition in a round; without it every window is used.
    """
    words, counts = count(docs, vocabulary, pattern)
    return learn(read(placed(docs), words, ["place"]), words, steps), counts


def score(docs: DataFrame, model: dict, counts: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``."""
    return score_read(read(docs, {k: model[k] for k in ("table", "total", "distinct", "ends", "rank_file", "pattern")}, keep), model, counts, keep)


def score_read(texts: DataFrame, model: dict, counts: DataFrame, keep: list[str]) -> DataFrame:
    """``score`` of texts that ``read`` has returned."""
    shared = texts.sparkSession.sparkContext.broadcast((model["lm"], model_ids(model["end"], model["known"])))
    kind, other, log_other = id_type(model["end"]), len(model["known"]), model["log_other"]
    own = ["row", *keep, "n_tokens", "known", "base"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lm, of = shared.value
        for start, end in common.pieces(batch, "ids", most=1 << 20):
            inputs, targets, first = lm.windows(streams(batch.column("ids")[start:end], kind, of))
            logs = lm.log_probs(inputs, targets)
            logs[targets == other] -= log_other
            sums = np.add.reduceat(logs.sum(1), first[:-1]) / np.log(10)
            yield pa.RecordBatch.from_arrays([*[batch.column(k)[start:end] for k in own], pa.array(sums)], [*own, "score"])

    done = common.stored(common.arrow_map(texts.select(*own, "ids"), run, f"row long, {_columns(texts, keep)}n_tokens long, known long, base double, score double"), "lm-scores")
    c = F.coalesce("c", F.lit(0))
    part = F.col("n") * F.log10((c + 0.1) / F.lit(model["total"] + 0.1 * (model["distinct"] + 1)))
    rare = texts.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n").join(counts, "word", "left")
    rest = rare.groupBy("row").agg(F.sum(part).alias("more"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"))
    zero = F.lit(0)
    return done.join(rest, "row", "left").select(
        *keep, "n_tokens", (F.col("known") + F.coalesce("more_known", zero)).alias("n_known"), F.lit(model["total"]).cast("bigint").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score"
    )


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 2 over all documents."""
    import public_tokenizers as public

    docs = placed(common.table(spark, sf_dir, "documents").select("doc_id", "text", common.held_out("doc_id", FOLDS).alias("held_out")))
    words, counts = count(docs.where("not held_out"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    texts = read(docs, words, ["doc_id", "held_out", "place"])
    return score_read(texts, learn(texts.where("not held_out"), words), counts, ["doc_id", "held_out"])


QUERIES = {"op2_lm_score": op2_lm_score}
SQL: dict[str, str] = {}
