"""Near-duplicate classes by BagMinHash (operator 7).

A document is the multiset of its windows of five lower-cased words (a shorter one is one window).
Copies are two documents whose weighted Jaccard similarity is at least ``SIMILAR``; classes are the
connected components of that relation.

1. *Signatures.*  The weights of a window are the counts 1, 2, ...; its weight axis is cut into the
   intervals (0,1], (1,2], (2,4], (4,8], ...  Every (window, interval) has a Poisson process whose rate is the
   interval's width; each point has a time, a register and a weight coordinate, and counts for a
   document if the coordinate is within its weight.  A register keeps the earliest time, so two
   documents agree on a register with probability equal to their weighted Jaccard similarity.  All points
   come from hashes; points beyond the time when all registers are full are never generated.
2. *Exact copies* (equal word sequences) are one node from here on, however many they are.
3. *Bands* of ``ROWS`` registers make buckets: a pair at the threshold shares none with probability
   (1 - 0.8^5)^25 < 0.00005.
4. *Bounds.*  Windows that no other candidate has are counted for every node; a node of which they are
   more than a fifth has no partner.
5. *Stars.*  Every node is verified against the most central of its buckets' nodes; verified pairs join
   components, and a pair inside a component needs no test.
6. *Differences* (``residue``), in the buckets that still hold several components: each has the node whose
   windows are the most frequent as its center, and every node is compared with the centers of its
   buckets.  With ``D`` the windows in which a node differs from a center, two nodes are similar if and only
   if ``D`` of both have enough in common, and one of them is far from the center, or they would be one
   component.  An exact prefix join on ``D``, rarest differences first and with the positional bound,
   finds every such pair: members of a group meet on shared deviations and not on what the group shares.
7. Components by alternating large and small stars.

No bucket is capped and no candidate link between components is left out.

Nulls: a null or blank text is a class of its own; a null id is kept.  Repeated rows are exact copies and
ties of ids are broken by the hash of the text.  Very long texts are cut by no bound: a text's windows are
one row of the bag table.  An empty table gives no rows.  Other columns don't matter to the query; the
stage ``keep_one`` passes them on whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
CACHE_WORDS = 100_000
#: Rows of one node in a join of pairs before it is dealt to more than one task.
STAR = 512
_u = np.uint64
_powers = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(SHINGLE)], np.uint64)
_bands = np.array([[pow(0xD6E8FEB86659FD93, b * ROWS + r + 1, 1 << 64) | 1 for r in range(ROWS)] for b in range(BANDS)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> _u(30))
    x = x * _u(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _u(27))
    x = x * _u(0x94D049BB133111EB)
    return x ^ (x >> _u(31))


class Words:
    """64-bit hashes of words, in a bounded table of one Python process."""

    def __init__(self):
        self.seen: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        seen = self.seen
        if missing := [w for w in words if w not in seen]:
            if len(seen) > CACHE_WORDS:
                self.seen = seen = {}
                missing = words
            for w in missing:
                seen[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def shingles(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct window hashes, ascending, and their counts."""
    h = common.kept("near", 0, Words).hashes(words)
    size = min(SHINGLE, len(h))
    if not size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out += h[k : k + n] * _powers[k]
    return np.unique(mix(out), return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """BagMinHash of many bags at once: the earliest time of each register, as the bits of a double."""
    sizes = [len(v) for v, _ in bags]
    owner = np.repeat(np.arange(len(bags)), sizes)
    values, counts = np.concatenate([v for v, _ in bags]), np.concatenate([c for _, c in bags])
    seeds, width, low, weight, owners = [values], [np.ones(len(values))], [np.zeros(len(values))], [counts.astype(float)], [owner]
    bottom, node = 1, 1
    while (deep := counts > bottom).any():
        salt = node * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF
        seeds.append(mix(values[deep] + _u(salt)))
        width.append(np.full(deep.sum(), float(bottom)))
        low.append(np.full(deep.sum(), float(bottom)))
        weight.append(counts[deep].astype(float))
        owners.append(owner[deep])
        bottom, node = bottom * 2, node + 1
    first = [np.concatenate(x) for x in (seeds, width, low, weight, owners)]
    limit = registers * (np.log(registers) + 3.0) / np.bincount(owner, weights=counts, minlength=len(bags))
    out = np.full((len(bags), registers), np.inf)
    todo = np.ones(len(bags), bool)
    while todo.any():
        here = todo[first[4]]
        state, wide, base, most, own = first if here.all() else [x[here] for x in first]
        best, time = np.full(len(bags) * registers, np.inf), np.zeros(len(state))
        while len(state):
            state = mix(state + _u(0x9E3779B97F4A7C15))
            time = time - np.log(((state >> _u(11)).astype(float) + 0.5) * 2.0**-53) / wide
            live = np.flatnonzero(time < limit[own])
            state, time, wide, base, most, own = state[live], time[live], wide[live], base[live], most[live], own[live]
            draw = mix(state ^ _u(0xD1B54A32D192ED03))
            at = ((draw & _u(0xFFFFFFFF)) * _u(registers) >> _u(32)).astype(np.int64) + own * registers
            ok = base + wide * ((draw >> _u(32)).astype(float) * 2.0**-32) < most
            np.minimum.at(best, at[ok], time[ok])
        best = best.reshape(len(bags), registers)
        out[todo] = best[todo]
        # A bag whose registers aren't all full goes again, further in time.
        todo &= ~np.isfinite(best).all(1)
        limit = limit * 2
    return out.view(np.uint64)


def signature(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """BagMinHash of one bag."""
    return signatures([(values, counts)])[0]


def _words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def digests(docs: DataFrame) -> DataFrame:
    """Per row: id, hash of the text, ``node`` (hash of its words; null without words), windows, bands."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start, end in common.pieces(batch, most=1 << 20):
            words = [_words_of(x) for x in batch.column("text")[start:end].to_pylist()]
            full = [i for i, w in enumerate(words) if w]
            nodes, bands = [None] * len(words), [None] * len(words)
            if full:
                sig = signatures([shingles(words[i]) for i in full])
                keys = mix((sig.reshape(-1, BANDS, ROWS) * _bands).sum(2) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                for k, i in enumerate(full):
                    nodes[i], bands[i] = xxhash.xxh3_128_digest(b" ".join(words[i])), keys[k]
            sizes = [max(1, len(w) - SHINGLE + 1) if w else 0 for w in words]
            made = [pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(k)[start:end] for k in ("doc_id", "text_hash")] + made, ["doc_id", "text_hash", "node", "size", "bands"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return common.arrow_map(rows, run, "doc_id long, text_hash long, node binary, size long, bands array<bigint>")


def bags(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Window multisets of ``nodes`` (node, text_hash of one document): node, hashes and counts as bytes."""
    passes = docs.sparkSession.sparkContext.broadcast(common.bitmap(nodes, "text_hash"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(common.passes(passes.value, batch.column("text_hash").to_numpy()))
        out = []
        for text in batch.column("text").take(pa.array(at)).to_pylist():
            words = _words_of(text)
            if words:
                values, counts = shingles(words)
                out.append((xxhash.xxh3_128_digest(b" ".join(words)), values.tobytes(), counts.astype(np.uint32).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in range(3)], ["node", "values", "counts"])

    found = common.arrow_map(docs.select(F.xxhash64("text").alias("text_hash"), "text"), run, "node binary, values binary, counts binary")
    return found.groupBy("node").agg(F.first("values").alias("values"), F.first("counts").alias("counts"))


def similarity(v: np.ndarray, c: np.ndarray, w: np.ndarray, d: np.ndarray) -> float:
    """Weighted Jaccard of two bags with ascending distinct hashes."""
    at = np.minimum(np.searchsorted(w, v), len(w) - 1)
    same = w[at] == v
    both = int(np.minimum(c[same], d[at[same]]).sum())
    return both / (int(c.sum()) + int(d.sum()) - both)


def meet(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` (a, b) with ``columns`` of both nodes, as x_* of ``a`` and y_* of ``b``, and ``n``, the pairs of ``a``.

    A node ``a`` of many pairs is dealt to several tasks.
    """
    stars = common.stored(pairs.groupBy("a").agg(F.count("*").alias("n")), "parts").withColumn("parts", F.ceil(F.col("n") / STAR).cast("int"))
    left = table.join(stars, table["node"] == stars["a"]).select("a", "n", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *[F.col(k).alias(f"x_{k}") for k in columns])
    dealt = pairs.join(stars, "a").select(F.col("a").alias("a2"), "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part2"))
    right = dealt.join(table, dealt["b"] == table["node"]).select("a2", "b", "part2", *[F.col(k).alias(f"y_{k}") for k in columns])
    return right.join(left, (right["a2"] == left["a"]) & (right["part2"] == left["part"])).drop("a2", "part", "part2")


def verified(pairs: DataFrame, bag: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Pairs (a, b, similarity) of nodes whose bags are similar."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = [batch.column(k).to_pylist() for k in ("x_values", "x_counts", "y_values", "y_counts")]
        found = np.array([similarity(np.frombuffer(v, np.uint64), np.frombuffer(c, np.uint32), np.frombuffer(w, np.uint64), np.frombuffer(d, np.uint32)) for v, c, w, d in zip(*cols, strict=True)])
        return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found)], ["a", "b", "similarity"]).filter(pa.array(found >= similar))

    return common.arrow_map(meet(pairs, bag, ["values", "counts"]), run, "a binary, b binary, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each connected component, for nodes with an edge.

    Alternating stars: every round links nodes to lesser ones until each is linked to its least alone.
    """
    edges = common.stored(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = common.stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least").withColumnRenamed("a", "u")
        # Large star: greater neighbours of a node go to its least neighbour.
        large = edges.join(least, edges["b"] == least["u"]).select("a", F.col("m").alias("b")).where("a <> b").distinct()
        large = common.stored(large, "large")
        # Small star: lesser neighbours of a node, and the node, go to the least of them.
        low = common.stored(large.groupBy("a").agg(F.min("b").alias("m")), "low").withColumnRenamed("a", "u")
        near = large.join(low, large["a"] == low["u"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = common.stored(near.union(low.select("u", "m")).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        state = now


def windows_of(bag: DataFrame, key: str) -> DataFrame:
    """(value, ``key``, c): a row for every distinct window of every bag."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, (v, c) in enumerate(zip(batch.column("values").to_pylist(), batch.column("counts").to_pylist(), strict=True)):
            values, counts = np.frombuffer(v, np.int64), np.frombuffer(c, np.uint32).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values), batch.column(key).take(pa.array(np.full(len(values), i))), pa.array(counts)], ["value", key, "c"])

    return common.arrow_map(bag.select(key, "values", "counts"), run, f"value long, {key} {dict(bag.dtypes)[key]}, c long")


def own_windows(bag: DataFrame) -> DataFrame:
    """(id, own): windows of a node, by their counts, that no other node of ``bag`` has; ``id`` is ``node_id``."""
    rows = windows_of(bag.withColumn("id", node_id()), "id")
    # The exclusive or over the nodes of a window of one node is that node.
    alone = rows.groupBy("value").agg(F.count("*").alias("n"), F.bit_xor("id.high").alias("high"), F.bit_xor("id.low").alias("low"), F.sum("c").alias("c")).where("n = 1")
    return alone.groupBy(F.struct("high", "low").alias("id")).agg(F.sum("c").alias("own"))


def node_id() -> Column:
    """128 bits of a node as two numbers, which hash aggregates take."""
    return F.struct(F.xxhash64("node").alias("high"), F.xxhash64(F.lit(1), "node").alias("low"))


def shared_windows(nodes: DataFrame, bag: DataFrame) -> DataFrame:
    """(node, size, most, middle, windows): what each node shares with others of ``bag``.

    ``windows`` lists (value, c, n) by value, where ``n`` nodes have the window; ``most`` is the sum of ``c``,
    and ``middle`` the mean number of nodes that have a window of the node.
    """
    rows = common.stored(windows_of(bag, "node"), "windows")
    shared = common.stored(rows.groupBy("value").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    held = rows.join(shared, "value").groupBy("node").agg(F.sum("c").alias("most"), F.sum(F.col("c") * F.col("n")).alias("sum"), F.sort_array(F.collect_list(F.struct("value", "c", "n"))).alias("windows"))
    return common.stored(nodes.join(held, "node").select("node", "size", "most", (F.col("sum") / F.col("size")).alias("middle"), "windows"), "held")


def _occurrences(values: np.ndarray, low: np.ndarray, high: np.ndarray, sign: int) -> np.ndarray:
    """One hash for every occurrence ``low .. high - 1`` of each value."""
    many = high - low
    at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
    return mix(np.repeat(values, many).view(np.uint64) + at.astype(np.uint64) * _powers[0] + _u(sign))


def difference(x: tuple, x_size: int, y: tuple, y_size: int, group: int) -> tuple[int, np.ndarray]:
    """How many windows of ``y`` differ from the center ``x``, and the hashes of the prefix of these differences.

    ``x`` and ``y``: values (ascending), counts and frequencies of the shared windows.  The order is that of
    rising frequency among the ``group`` nodes of the center: windows that no other node has, windows that
    the center lacks, then windows that the node lacks.  Windows that no other node has are no candidates, so the
    hash of their places is left out: the first hash returned has place ``len(prefix) - len(hashes)``.

    With e = |D| - size / 9, two nodes are similar if and only if their differences share (e + e') / 2 or more.
    No e is less than that of the center, -size / 9; where ``y`` is similar to the center, its partner is not.
    """
    (v, c, n), (w, d, m) = x, y
    own, lost = y_size - int(d.sum()), x_size - int(c.sum())
    every = np.concatenate([v, w])
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.diff(every, prepend=every[0] - 1 if len(every) else 0) != 0)
    value, freq = every[first], np.concatenate([n, m])[order][first]
    at = np.searchsorted(value, v), np.searchsorted(value, w)
    have, need = np.zeros(len(value), np.int64), np.zeros(len(value), np.int64)
    need[at[0]], have[at[1]] = c, d
    more, less = have > need, have < need
    size = own + lost + int(np.abs(have - need).sum())
    far = 9 * size > x_size + y_size
    least = max(1, -(-(9 * size - y_size - x_size if far else 9 * size - y_size + x_size) // 18))
    rank = np.concatenate([np.repeat(freq[more], (have - need)[more]), np.repeat(np.maximum(2, group - freq[less]) + group, (need - have)[less]), np.full(lost, 2 * group + 2)])
    hashes = np.concatenate([_occurrences(value[more], need[more], have[more], 0), _occurrences(value[less], have[less], need[less], 1), mix(np.arange(lost, dtype=np.uint64))])
    return size, hashes[np.lexsort((hashes, rank))][: max(0, size - least + 1 - own)]


def residue(rest: DataFrame, bag: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, similarity) to centers, and the places (center, token, pos, node, far, d, size) of the prefixes.

    ``rest``: (key, node, size) of the buckets that hold several components.
    """
    held = shared_windows(rest.select("node", "size").distinct(), bag)
    middle = rest.select("key", "node").join(held.select("node", "middle"), "node")
    middle = common.stored(middle, "placed-middle")
    centers = common.stored(middle.groupBy("key").agg(F.max(F.struct("middle", F.col("node").alias("a"))).alias("c")).select("key", "c.a"), "middles")
    pairs = common.stored(middle.join(centers, "key").where("node <> a").select("a", F.col("node").alias("b")).distinct(), "center-pairs")
    both = meet(pairs, held, ["size", "windows"])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        def parts(column: str):
            rows, flat = batch.column(column), batch.column(column).flatten()
            cut = np.append(0, np.cumsum(rows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)))
            cols = [flat.field(k).to_numpy(zero_copy_only=False) for k in range(3)]
            return [tuple(x[i:j] for x in cols) for i, j in zip(cut[:-1], cut[1:], strict=True)]

        sizes = [batch.column(k).to_pylist() for k in ("x_size", "y_size", "n")]
        done = [difference(x, nx, y, ny, n) for x, nx, y, ny, n in zip(parts("x_windows"), sizes[0], parts("y_windows"), sizes[1], sizes[2], strict=True)]
        d, total = np.array([x for x, _ in done]), np.array(sizes[0]) + np.array(sizes[1])
        own = [ny - int(y[1].sum()) for y, ny in zip(parts("y_windows"), sizes[1], strict=True)]
        made = [pa.array(d), pa.array((total - d) / (total + d)), pa.array(own, pa.int64()), pa.array([x.view(np.int64) for _, x in done], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("y_size"), *made], ["a", "b", "size", "d", "similarity", "own", "tokens"])

    compared = common.stored(common.arrow_map(both, run, "a binary, b binary, size long, d long, similarity double, own long, tokens array<bigint>"), "differences")
    near = F.col("similarity") >= SIMILAR
    places = compared.select("a", F.col("b").alias("node"), (~near).alias("far"), "d", "size", "own", F.posexplode("tokens").alias("at", "token"))
    return compared.where(near).select("a", "b", "similarity"), places.select(F.col("a").alias("center"), "token", (F.col("at") + F.col("own")).alias("pos"), "node", "far", "d", "size")


def difference_pairs(places: DataFrame, component: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components, one of them far from the center, whose prefixes meet well enough."""
    own = component.select("node", "component")
    rows = common.stored(places.join(own, "node", "left").withColumn("component", F.coalesce("component", "node")), "prefixes")
    x, y = rows.where("far").alias("x"), rows.alias("y")
    same = (F.col("x.center") == F.col("y.center")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component")) & (~F.col("y.far") | (F.col("x.node") < F.col("y.node")))
    # What both have from here on must reach the common differences that similar nodes have.
    left = F.least(F.col("x.d") - F.col("x.pos"), F.col("y.d") - F.col("y.pos"))
    enough = 18 * left >= 9 * (F.col("x.d") + F.col("y.d")) - F.col("x.size") - F.col("y.size")
    return x.join(y, same & enough).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Digests of all rows, and per node the row to keep of its class."""
    return linked_classes(docs)[:2]


def linked_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Digests of all rows; per node the row to keep of its class; and verified links (a, b, similarity) of nodes."""
    spark = docs.sparkSession
    rows = common.stored(digests(docs), "digests")
    with common.scratch(spark):
        nodes = common.stored(rows.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"), F.first("size").alias("size"), F.first("bands").alias("bands")), "nodes")
        members = nodes.select("node", F.explode("bands").alias("key"))
        many = common.stored(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "buckets")
        near = common.stored(members.join(many, "key"), "members")
        used = nodes.join(near.select("node").distinct(), "node", "left_semi")
        bag = common.bucketed(bags(docs, used.select(F.col("row.text_hash").alias("text_hash"))), "bags", "node")
        # What no other candidate has can't overlap; a node with too much of it has no partner.
        weighed = used.select("node", "size", node_id().alias("id")).join(own_windows(bag), "id", "left")
        live = common.stored(weighed.where(5 * (F.col("size") - F.coalesce("own", F.lit(0))) >= 4 * F.col("size")).select("node", "size"), "live")
        placed = common.stored(near.join(live.select("node"), "node"), "placed")
        sizes = common.stored(placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        crowded = common.stored(placed.join(sizes, "key").select("key", "node", "n"), "crowded")
        # The middle of a group shares its bands with more nodes than what strays from it.
        middle = crowded.join(crowded.groupBy("node").agg(F.sum("n").alias("weight")), "node").select("key", "node", "weight")
        middle = common.stored(middle, "middle")
        centers = common.stored(middle.groupBy("key").agg(F.max(F.struct("weight", F.col("node").alias("a"))).alias("c")).select("key", "c.*"), "centers")
        full = common.stored(middle.drop("weight").join(centers, "key"), "full")
        shared = full.where("node <> a").groupBy("node", "a").agg(F.count("*").alias("n"), F.max("weight").alias("weight"))
        stars = shared.groupBy("node").agg(F.max_by("a", F.struct("weight", "n", "a")).alias("a")).select("a", F.col("node").alias("b"))
        links = common.stored(verified(common.stored(stars, "star-pairs"), bag), "links")
        found = common.stored(components(links), "components")

        labelled = common.stored(full.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "labelled")
        mixed = labelled.groupBy("key").agg((F.min("component") != F.max("component")).alias("several")).where("several").select("key")
        rest = common.stored(labelled.join(common.stored(mixed, "mixed"), "key").join(live, "node").select("key", "node", "size"), "rest")
        few = common.stored(bag.join(rest.select("node").distinct(), "node"), "rest-bags")
        more, places = residue(rest, few)
        links = links.unionByName(more)
        found = common.stored(components(links), "components")
        last = common.stored(verified(common.stored(difference_pairs(places, found), "last-pairs"), few), "last-links")
        links = common.stored(links.unionByName(last).dropDuplicates(["a", "b"]), "all-links")
        linked = found if last.isEmpty() else common.stored(components(links), "components")

        of = nodes.select("node", "row").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = common.stored(of.groupBy("component").agg(F.min(F.struct("row.doc_id", "row.text_hash")).alias("keep")), "least")
        out = common.stored(of.select("node", "component").join(least, "component").select("node", "keep"), "classes", lasting=True)
        return rows, out, common.stored(links, "near-links", lasting=True)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document.

    ``doc_id``; ``class_id``, the least id of its class; ``n_copies``, the rows with its words, itself included;
    ``n_links``, the verified links of its words to other words of the class; ``similarity``, the greatest of these
    (1 for exact copies alone, null for a document of no class but its own).
    """
    rows, found, links = linked_classes(common.table(spark, sf_dir, "documents"))
    ends = links.select("a", "b", "similarity").union(links.select("b", "a", "similarity"))
    degree = ends.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_links"), F.max("similarity").alias("similarity"))
    copies = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("n_copies"))
    per_node = found.join(copies, "node").join(degree, "node", "left")
    all_rows = rows.select("doc_id", "node").join(per_node, "node", "left")
    n = F.coalesce("n_copies", F.lit(1))
    return all_rows.select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("class_id"), n.cast("bigint").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(n > 1, F.lit(1.0)).otherwise(F.col("similarity")).alias("similarity"),
    )


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the row with the least (id, hash of the text), with its columns."""
    rows, found = classes(docs)
    keyed = rows.select("doc_id", "text_hash", "node").join(found, "node", "left")
    mine = F.col("node").isNull() | (F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("text_hash") == F.col("keep.text_hash")))
    by_row = keyed.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), F.max(mine).alias("mine"))
    by_row = common.stored(by_row.where("n > 1 or not mine"), "rows-to-drop")
    same = lambda other: docs["doc_id"].cast("bigint").eqNullSafe(other["doc_id"]) & (F.xxhash64(docs["text"]) == other["text_hash"])
    out = docs.join(by_row, same(by_row), "left_anti")
    again = by_row.where("mine")
    if again.isEmpty():
        return out
    # Repeated rows of a text that stays: one of each.
    return out.unionByName(docs.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "text"]))


QUERIES = {"op7_near_dedup": op7_near_dedup}
SQL: dict[str, str] = {}
