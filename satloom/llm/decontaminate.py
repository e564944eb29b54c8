"""Benchmark decontamination by template canonicalisation (operator 4).

Words are lower-cased and stripped of punctuation; numbers, units and names become typed placeholders.
Windows of ``WINDOW`` canonical words of the benchmark are hash-joined with those of the documents.  A window
with names is also hashed with the names as plain words, so that case makes no difference.  A window of slots for the
most part holds little wording: it is hashed with its values, and the windows of ``LONG`` words around it (of
the whole item if that is shorter) are hashed as templates, if at least half of ``WINDOW`` of their words are plain.

Matches of one document and item on one diagonal (place in the document minus place in the item) must
fill the slots consistently: one value of the item stands for one value of the document and the other
way round, which is what a re-parameterised question does and a chance match of slots does not.  Of a diagonal
that contradicts itself, consistent stretches of ``TORN`` words or more count, and windows without slots.

A document is contaminated by an item if consistent windows cover a run of ``RUN`` words of the item
(all of a shorter item), or at least ``RUN`` words and ``SHARE`` of it.

Documents are scanned once; windows are first tested against a bitmap of the benchmark's hashes whose
size is fixed within stated bounds, and only those that pass become rows.  The benchmark's windows are
broadcast up to ``BROADCAST_ROWS`` and joined by shuffle beyond it, salted so that a passage of many documents is dealt
to several tasks.

Null texts and null ids: a null text has no windows; a null id is kept as null.  Repeated rows are
judged alike; of items with equal texts the least id stands for all.  Items of fewer than ``WINDOW`` words form
one window of their own length, tested only where the benchmark has such lengths.  A very long text is scanned whole
in one worker.  Empty tables give no rows.  Only ids and texts are read, so other columns may have any names; the
stage ``keep_clean`` passes them on.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 8
#: Words of the windows around a window of many slots; a power of the hash for each.
LONG = 16
RUN = 13
#: Words of a consistent stretch that counts on a diagonal that contradicts itself.
TORN = 2 * RUN
SHARE = 0.5
BROADCAST_ROWS = 200_000
#: Parts of a hash in the join by shuffle.
SALT = 16
#: Bits of the bitmap, as powers of two: 1 MB to 32 MB.
LEAST_BITS, MOST_BITS = 23, 28
#: Raw words whose canonical form one Python worker keeps.
CACHE_WORDS = 150_000
UNITS = frozenset("mm cm m km mi mile miles inch inches ft feet foot yd yard yards mg g kg lb lbs oz ton tons ml l liter liters litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh km/h % percent dollar dollars usd eur euro euros cent cents $ € £ °c °f w kw v".split())
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million half".split())
_strip = re.compile(r"^[^\w%$€£°]+|[^\w%$€£°]+$").sub
_number = re.compile(r"[$€£]?[+-]?\d+(?:[.,:/]\d+)*(?:st|nd|rd|th)?%?").fullmatch
PLAIN, NUM, UNIT, NAME = 0, 1, 2, 3
_slot_codes = np.array([xxhash.xxh3_64_intdigest(b"\0slot%d" % k) for k in range(4)], np.uint64)
_powers = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) | 1 for k in range(LONG)], np.uint64)


class Canon:
    """Canonical codes of raw words, in a bounded table of one Python process."""

    def __init__(self):
        self.reset()

    def reset(self):
        self.at: dict[str, int] = {}
        self.codes, self.flags = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.uint8)

    def add(self, raw: str) -> int:
        core = _strip("", raw)
        low = core.lower()
        kind = NUM if _number(core) or low in NUMBERS else UNIT if low in UNITS else PLAIN
        # A capital at the start of a longer word that isn't all capitals may be a name; see words().
        named = kind == PLAIN and core[:1].isupper() and len(core) > 1 and not core.isupper()
        ends = raw[-1:] in ".!?:;\"')]|"
        k = len(self.at)
        if k >= len(self.codes):
            self.codes, self.flags = np.resize(self.codes, 2 * k), np.resize(self.flags, 2 * k)
        self.codes[k] = xxhash.xxh3_64_intdigest(low.encode())
        self.flags[k] = kind | named << 2 | ends << 3 | (not core) << 4
        self.at[raw] = k
        return k

    def words(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Raw words that have a core, their canonical codes, their own codes, and their kinds."""
        raw = text.split()
        if len(self.at) > CACHE_WORDS:
            self.reset()
        at = self.at
        for x in {x for x in raw if x not in at}:
            self.add(x)
        index = np.fromiter(map(at.__getitem__, raw), np.int64, len(raw))
        flags = self.flags[index]
        if (empty := flags & 16).any():
            stay = np.flatnonzero(empty == 0)
            # A sign alone that ends a sentence counts for the word before it.
            raw, index, flags = [raw[i] for i in stay], index[stay], flags[stay]
        kinds = flags & 3
        named = (flags & 4) != 0
        if len(raw):
            named[0] = False
            named[1:] &= (flags[:-1] & 8) == 0
        kinds = np.where(named, NAME, kinds).astype(np.uint8)
        own = self.codes[index]
        return raw, np.where(kinds != PLAIN, _slot_codes[kinds], own), own, kinds


def hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` codes."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out += codes[k : k + n] * _powers[k]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


_WINDOWS = "pos int, size int, length int, hash long, slots array<string>"


def _slots(raw: list[str], kinds: np.ndarray, start: int, size: int) -> list[str]:
    return [_strip("", raw[start + k]).lower() for k in range(size) if kinds[start + k] != PLAIN]


def forms(codes: np.ndarray, own: np.ndarray, kinds: np.ndarray, sizes: list[int], long: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(size, places, hashes, kinds) of the windows of a text, see the head of this file."""
    named = kinds == NAME
    for plain in (False, True) if named.any() else (False,):
        if plain:
            codes, kinds, before = np.where(named, own, codes), np.where(named, PLAIN, kinds).astype(np.uint8), np.append(0, np.cumsum(named))
        filled = np.append(0, np.cumsum(kinds != PLAIN))
        for size in sizes:
            if not 0 < size <= len(codes):
                continue
            h, slots = hashes(codes, size), filled[size:] - filled[:-size]
            if (heavy := 2 * slots > size).any():
                h = np.where(heavy, hashes(own, size), h)
            # The second time, windows without names are those of the first.
            at = np.flatnonzero(before[size:] > before[:-size]) if plain else np.arange(len(h))
            yield size, at, h[at], kinds
            if size == WINDOW and heavy.any():
                dense = np.append(0, np.cumsum(heavy))
                for wide in long:
                    if wide <= len(codes):
                        n = len(codes) - wide + 1
                        words = wide - (filled[wide:] - filled[:-wide])
                        ok = (dense[wide - WINDOW + 1 :][:n] > dense[:n]) & (2 * words >= WINDOW)
                        at = np.flatnonzero(ok & (before[wide:] > before[:-wide])) if plain else np.flatnonzero(ok)
                        if len(at):
                            yield wide, at, hashes(codes, wide)[at], kinds


def windows(texts: DataFrame, keep: list[str], column: str = "text", passes=None, short: tuple[int, ...] = (), long: tuple[int, ...] = (), whole: bool = False) -> DataFrame:
    """Canonical windows of every text: ``keep`` columns, place, size, words of the text, hash, slot values.

    ``passes`` is a broadcast bitmap that windows must pass; ``short`` lists sizes below ``WINDOW`` and ``long``
    those above it to form as well; ``whole`` forms the sizes that an item has.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, found, canon = [], [], common.kept("canon", 0, Canon)
        for i, text in enumerate(batch.column(column).to_pylist()):
            raw, codes, own, kinds = canon.words(text or "")
            n = len(raw)
            sizes, wide = ([min(WINDOW, n)], [min(LONG, n)] if n > WINDOW else []) if whole else ([WINDOW, *short], list(long))
            for size, at, h, filled in forms(codes, own, kinds, sizes, wide):
                if passes is not None and len(at):
                    ok = common.passes(passes.value, h)
                    at, h = at[ok], h[ok]
                for p, x in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
                    rows.append(i)
                    found.append((p, size, n, x, _slots(raw, filled, p, size)))
            if len(rows) >= 20_000:
                yield made(batch, rows, found)
                rows, found = [], []
        if rows:
            yield made(batch, rows, found)

    def made(batch: pa.RecordBatch, rows: list[int], found: list[tuple]) -> pa.RecordBatch:
        kept = [batch.column(k).take(pa.array(rows)) for k in keep]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([*kept, *[pa.array(x, t) for x, t in zip(zip(*found, strict=True), kinds, strict=True)]], [*keep, "pos", "size", "length", "hash", "slots"])

    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for k in keep for f in texts.schema if f.name == k)
    return common.arrow_map(texts.select(*keep, column), run, head + _WINDOWS)


def _consistent(pairs: set[tuple[str, str]]) -> bool:
    return len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def stretches(own: list[tuple[int, int, int, list[str], list[str]]]) -> list[list[tuple]]:
    """The matches of a diagonal, by place, cut wherever the next one contradicts the stretch so far."""
    out, forth, back = [], {}, {}
    for x in sorted(own, key=lambda x: x[1:3]):
        pairs = list(zip(x[4], x[3], strict=True))
        if not out or any(forth.get(a, b) != b or back.get(b, a) != a for a, b in pairs):
            out.append([])
            forth, back = {}, {}
        forth.update(pairs)
        back.update((b, a) for a, b in pairs)
        out[-1].append(x)
    return out


def judge(length: int, found: list[tuple[int, int, int, list[str], list[str]]]) -> tuple[int, int, bool]:
    """Covered words of the item, its longest covered run, and whether a slot's value differs.

    ``found``: (place in the document, place in the item, size, slots there, slots here).
    """
    by_diagonal = defaultdict(list)
    for x in found:
        by_diagonal[x[0] - x[1]].append(x)
    hit, differs = np.zeros(length, bool), False
    for own in by_diagonal.values():
        values = lambda rows: {(a, b) for _, _, _, there, here in rows for a, b in zip(here, there, strict=True)}
        if not _consistent(values(own)):
            parts = [x for x in stretches(own) if _consistent(values(x)) and max(y[1] + y[2] for y in x) - x[0][1] >= TORN]
            own = [y for x in parts for y in x] + [y for y in own if not y[3]]
        differs |= any(a != b for a, b in values(own))
        for _, at, size, *_ in own:
            hit[at : at + size] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return int(hit.sum()), int((edges[1::2] - edges[::2]).max(initial=0)), differs


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs (document, item) that meet the rule.

    Columns: ``doc_id``, ``text_hash`` (xxhash64 of the text), ``item_id`` (the least of equal item
    texts), ``covered``, ``run``, ``share``, ``reparameterised``.
    """
    items = benchmark.where("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id"))
    ours = common.stored(windows(items, ["item_id"], whole=True), "template-windows")
    sizes = lambda c: F.collect_set(F.when(c, F.col("size")))
    stats = ours.agg(F.count("*").alias("n"), sizes(F.col("size") < WINDOW).alias("short"), sizes(F.col("size") > WINDOW).alias("long")).first()
    passes = docs.sparkSession.sparkContext.broadcast(common.bitmap(ours, "hash", LEAST_BITS, MOST_BITS, 64))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    theirs = windows(keyed, ["doc_id", "text_hash"], passes=passes, short=tuple(sorted(stats["short"])), long=tuple(sorted(stats["long"])))
    theirs = theirs.select("doc_id", "text_hash", F.col("pos").alias("doc_pos"), "size", "hash", F.col("slots").alias("doc_slots"))
    on = ["hash", "size"]
    if stats["n"] <= BROADCAST_ROWS:
        right = F.broadcast(ours)
    else:
        on, theirs = [*on, "salt"], theirs.withColumn("salt", F.pmod(F.hash("doc_id", "doc_pos"), F.lit(SALT)))
        right = ours.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    met = theirs.join(right, on).groupBy("doc_id", "text_hash", "item_id").agg(F.max("length").alias("length"), F.collect_set(F.struct("doc_pos", "pos", "size", "doc_slots", "slots")).alias("found"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        length = batch.column("length").to_pylist()
        rows = [(*judge(n, [tuple(x.values()) for x in f]),) for n, f in zip(length, batch.column("found").to_pylist(), strict=True)]
        made = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int32(), pa.int32(), pa.bool_()], strict=True)]
        return pa.RecordBatch.from_arrays([*[batch.column(k) for k in ("doc_id", "text_hash", "item_id", "length")], *made], ["doc_id", "text_hash", "item_id", "length", "covered", "run", "reparameterised"])

    kinds = {f.name: f.dataType.simpleString() for f in met.schema}
    judged = common.arrow_map(met, run, f"doc_id {kinds['doc_id']}, text_hash long, item_id {kinds['item_id']}, length int, covered int, run int, reparameterised boolean")
    share = F.col("covered") / F.col("length")
    enough = (F.col("run") >= F.least(F.lit(RUN), F.col("length"))) | ((F.col("covered") >= RUN) & (share >= SHARE))
    return judged.where(enough).select("doc_id", "text_hash", "item_id", "covered", "run", share.alias("share"), "reparameterised")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents: ``doc_id``, the items found in them, and the strongest evidence."""
    found = contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("share").alias("share"), F.max("run").cast("long").alias("longest_run"), F.max("reparameterised").alias("reparameterised"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that no benchmark item contaminates, with their columns."""
    bad = contamination(docs, common.table(spark, sf_dir, "benchmark")).select("doc_id", "text_hash").distinct().withColumnRenamed("doc_id", "bad_id")
    same = F.xxhash64(docs["text"]) == bad["text_hash"]
    return docs.join(bad, same & docs["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti")


QUERIES = {"op4_decontamination": op4_decontamination}
SQL: dict[str, str] = {}
