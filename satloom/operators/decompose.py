"""Decomposition of arrays into monomers: first pass, refinement, fixpoint, and the bulk path in Arrow batches."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from . import kmers
from .growth import Texts, chunks
from .growth import codes as _codes
from .tables import importable, stored

DEPTH = 100
#: Distinct monomers among which ``second_pass_once`` seeks the reference monomer, as its SQL does; all others look at all.
CANDIDATES = 1000
#: Pieces up to this many periods are left alone by the refinement.
LONG = 1.3


class NoReferenceMonomer(ValueError):
    """No piece of an array has the length of its period."""


def with_cutoff(arrays: DataFrame, cutoff: int | None = None, sticky: bool = True) -> DataFrame:
    """Adds ``cutoff``: the given one, the first array's for all (``sticky``), or each array's own by its length."""
    if cutoff:
        return arrays.withColumn("cutoff", F.lit(cutoff))
    if not sticky:
        return arrays.withColumn("cutoff", S.length_cutoff(F.length("seq")))
    first = arrays.agg(F.min_by(F.length("seq"), "array_ord").alias("n")).select(S.length_cutoff(F.col("n")).alias("cutoff"))
    return arrays.crossJoin(F.broadcast(first))  # one row


def first_pass_pieces(seq: Column, cut: Column, period: Column, compat: bool = True) -> Column:
    """Pieces of a sequence cut before every occurrence of ``cut``, multiples of the period cut evenly.

    With ``compat`` an array that starts with the cut gets one more copy of it in front.
    """
    pieces = S.literal_split(seq, cut)
    led = F.transform(pieces, lambda x, i: F.when(i > 0, F.concat(cut, x)).when(x == "", cut).otherwise(x))
    if not compat:
        led = F.filter(F.transform(pieces, lambda x, i: F.when(i > 0, F.concat(cut, x)).otherwise(x)), lambda x: x != "")
    return F.flatten(F.transform(led, lambda x: S.even_parts(x, period)))


def first_pass(cuts: DataFrame, compat: bool = True) -> DataFrame:
    """(array_ord, cut, score, period, pieces) of arrays with their cuts."""
    whole = F.when(F.col("cut") == F.col("seq"), F.array("seq") if not compat else F.array("seq", "seq"))
    return cuts.select("array_ord", "cut", "score", "period", F.coalesce(whole, first_pass_pieces(F.col("seq"), F.col("cut"), F.col("period"), compat)).alias("pieces"))


def counted(pieces: Column) -> Column:
    """Distinct pieces as (less, i, m): minus their count, their first place and themselves; the commonest first, then the earliest."""
    placed = F.array_sort(F.transform(pieces, lambda x, i: F.struct(x.alias("m"), i.alias("i"))))
    bound = lambda value, fn: F.transform(F.array(value), fn)[0]  # noqa: E731  lambdas would compute it again

    def runs(s: Column) -> Column:
        at = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        begin = F.filter(at, lambda k: (k == 0) | (F.get(s, k)["m"] != F.get(s, k - 1)["m"]))
        return F.array_sort(bound(begin, lambda b: F.transform(b, lambda k, j: F.struct((k - F.coalesce(F.get(b, j + 1), F.size(s))).alias("less"), F.get(s, k)["i"].alias("i"), F.get(s, k)["m"].alias("m")))))

    return bound(placed, runs)


def monomer_counts(pieces: DataFrame) -> DataFrame:
    """(array_ord, monomer, n, first_ord) of every distinct piece."""
    each = pieces.select("array_ord", F.explode(counted(F.col("pieces"))).alias("x"))
    return each.select("array_ord", F.col("x.m").alias("monomer"), (-F.col("x.less")).cast("bigint").alias("n"), F.col("x.i").alias("first_ord"))


def reference_monomer(pieces: Column, period: Column, candidates: int | None = None) -> Column:
    """(reference, n): the commonest piece as long as the period, null if there is none; equal counts go to the first.

    With ``candidates`` only so many distinct pieces are looked at, the commonest of any length.
    """
    if candidates:
        best = F.filter(F.slice(counted(pieces), 1, candidates), lambda x: F.length(x["m"]) == period)
    else:
        best = counted(F.filter(pieces, lambda x: F.length(x) == period))
    first = F.get(best, F.lit(0))
    return F.when(first.isNotNull(), F.struct(first["m"].alias("reference"), (-first["less"]).cast("bigint").alias("n")))


def reference_monomers(pieces: DataFrame) -> DataFrame:
    """(array_ord, reference, n): the commonest piece as long as the period; arrays that have none are left out."""
    found = pieces.select("array_ord", reference_monomer(F.col("pieces"), F.col("period")).alias("r"))
    return found.where("r is not null").select("array_ord", "r.reference", "r.n")


def refined(piece: Column, reference: Column, period: Column) -> Column:
    """A long piece cut in two where it fits the reference monomer best, if that is close enough."""
    n, size = F.length(reference), F.length(piece)
    up = lambda a, b: F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    starts = F.concat(up(F.lit(0), F.least(size - n + 1, F.lit(5)) - 1), up(F.greatest(F.lit(0), size - n - 4), size - n))
    ranked = F.transform(starts, lambda i, k: F.struct(F.levenshtein(reference, F.substring(piece, i + 1, n)).alias("d"), k.alias("k"), i.alias("i")))
    close = F.array_min(F.filter(ranked, lambda x: x["d"] < n))

    def cut(best: Column) -> Column:
        at = F.when(best["i"] == 0, n).otherwise(best["i"])
        parts = F.array(F.substring(piece, F.lit(1), at), F.substring(piece, at + 1, size))
        return F.when(2 * best["d"] < n, F.filter(parts, lambda x: x != "")).otherwise(F.array(piece))

    return F.when(size / period <= LONG, F.array(piece)).otherwise(F.coalesce(F.transform(F.array(close), cut)[0], F.array(piece)))


def second_pass_round(pieces: DataFrame, candidates: int | None = None) -> DataFrame:
    """One refinement of all arrays: (array_ord, cut, score, period, pieces, changed)."""
    known = pieces.withColumn("reference", reference_monomer(F.col("pieces"), F.col("period"), candidates)["reference"])
    new = F.when(F.col("reference").isNull(), F.col("pieces")).otherwise(F.flatten(F.transform("pieces", lambda x: refined(x, F.col("reference"), F.col("period")))))
    out = known.withColumn("new", new)
    return out.select("array_ord", "cut", "score", "period", F.col("new").alias("pieces"), (F.size("new") != F.size("pieces")).alias("changed"))


def refine_to_fixpoint(pieces: DataFrame) -> DataFrame:
    """Refinement rounds over the arrays that still change; every change adds a piece, so it ends."""
    done, active = None, stored(pieces.select("array_ord", "cut", "score", "period", "pieces"))
    while True:
        after = stored(second_pass_round(active))
        still = after.where("not changed").drop("changed")
        done = still if done is None else done.unionByName(still)
        active = after.where("changed").drop("changed")
        if active.isEmpty():
            return done


def decompose_native(arrays: DataFrame, depth: int = DEPTH, cutoff: int | None = None, compat: bool = True) -> DataFrame:
    """(array_ord, cut, score, period, pieces): passes and refinement by DataFrame operators, rounds of all arrays at once."""
    based = with_cutoff(arrays.select("array_ord", "seq"), cutoff, sticky=compat)
    start = first_pass(kmers.best_cut(based.where("seq <> ''"), depth, F.col("cutoff")), compat)
    empty = based.where("seq = ''").select("array_ord", F.lit("").alias("cut"), F.lit(0.0).alias("score"), F.lit(0).alias("period"), F.array().cast("array<string>").alias("pieces"))
    return refine_to_fixpoint(start).unionByName(empty)


# The bulk path: one array at a time inside a worker, for arrays too long to become rows.


def distance(a: str, b: str) -> int:
    """Levenshtein distance by bit-parallel columns; a's characters are the bits."""
    if not a:
        return len(b)
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    m = len(a)
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, score = full, 0, m
    for c in b:
        eq = masks.get(c, 0)
        d0 = (((eq & plus) + plus) ^ plus) | eq | minus
        hp, hn = minus | ~(d0 | plus), plus & d0
        score += bool(hp & top) - bool(hn & top)
        hp, hn = hp << 1 | 1, hn << 1
        plus, minus = (hn | ~(d0 | hp)) & full, hp & d0 & full
    return score


def _even(piece: str, period: int) -> list[str]:
    if not piece or period <= 0 or len(piece) % period:
        return [piece]
    return [piece[i : i + period] for i in range(0, len(piece), period)]


def decompose_texts(seqs: list[str], depth: int, cutoffs: list[int], compat: bool = True) -> Iterator[tuple[str, float, int, list[str]]]:
    """Cut, score, period and pieces of each array; cuts are sought in many arrays at once."""
    for part in chunks(list(map(len, seqs))):
        for seq, found in zip(seqs[part], Texts(seqs[part], cutoffs[part]).cuts(depth), strict=True):
            yield (*found, _refined_pieces(seq, *found, compat)) if seq else ("", 0.0, 0, [])


def decompose_text(seq: str, depth: int = DEPTH, cutoff: int = S.LEAST_CUTOFF, compat: bool = True) -> tuple[str, float, int, list[str]]:
    """Cut, score, period and pieces of one array."""
    return next(decompose_texts([seq], depth, [cutoff], compat))


def _refined_pieces(seq: str, cut: str, _: float, period: int, compat: bool) -> list[str]:
    """Pieces of one array, refined until nothing changes."""
    if cut == seq:
        pieces = [seq, seq] if compat else [seq]
    else:
        split = seq.split(cut)
        led = [split[0] or cut if compat else split[0], *[cut + x for x in split[1:]]]
        pieces = [p for x in led if x for p in _even(x, period)]
    known: dict[tuple[str, str], list[str]] = {}
    while True:
        distinct = Counter(pieces)
        reference = next((m for m, _ in sorted(distinct.items(), key=lambda x: -x[1]) if len(m) == period), None)
        if reference is None:
            return pieces
        long = [x for x in distinct if len(x) / len(reference) > LONG and (reference, x) not in known]
        known.update(((reference, x), [y for y in (x[:at], x[at:]) if y]) for x, at in zip(long, split_places(long, reference), strict=True))
        after = [y for x in pieces for y in known.get((reference, x), (x,))]
        if len(after) == len(pieces):
            return after
        pieces = after


def distances(reference: str, others: np.ndarray) -> np.ndarray:
    """Levenshtein distances of a text and the rows of a matrix of code points, all by the same bit-parallel columns."""
    if len(reference) > 64:
        return np.array([distance(reference, "".join(map(chr, x))) for x in others.tolist()], np.int64)
    letters, of = np.unique(_codes(reference), return_inverse=True)
    masks = np.zeros(len(letters) + 1, np.uint64)
    np.bitwise_or.at(masks, of, np.uint64(1) << np.arange(len(reference), dtype=np.uint64))
    at = np.minimum(np.searchsorted(letters, others), len(letters) - 1)
    equal = masks[np.where(letters[at] == others, at, len(letters))]
    full, top, one = np.uint64((1 << len(reference)) - 1), np.uint64(len(reference) - 1), np.uint64(1)
    plus, minus, score = np.full(len(others), full), np.zeros(len(others), np.uint64), np.full(len(others), len(reference), np.int64)
    for eq in equal.T:
        d0 = (((eq & plus) + plus) ^ plus) | eq | minus
        hp, hn = minus | ~(d0 | plus), plus & d0
        score += (hp >> top & one).astype(np.int64) - (hn >> top & one).astype(np.int64)
        hp, hn = hp << one | one, hn << one
        plus, minus = (hn | ~(d0 | hp)) & full, hp & d0 & full
    return score


def split_places(pieces: list[str], reference: str) -> list[int]:
    """Where each piece, longer than the reference, is split; 0 if nowhere.

    The reference is sought at the five first and five last places of a piece, of all pieces at once.  The nearest
    place wins, the first of equals in that order; if that is more than half of the reference away, none does.
    """
    n = len(reference)
    starts = [np.concatenate([np.arange(min(len(x) - n + 1, 5)), np.arange(max(0, len(x) - n - 4), len(x) - n + 1)]) for x in pieces]
    if not pieces:
        return []
    owner = np.repeat(np.arange(len(pieces)), [len(x) for x in starts])
    begin = np.cumsum([0, *map(len, pieces)])[:-1]
    text = _codes("".join(pieces))
    found = distances(reference, text[(np.concatenate(starts) + begin[owner])[:, None] + np.arange(n)])
    best = np.lexsort((np.arange(len(found)), found, owner))[np.searchsorted(owner, np.arange(len(pieces)))]
    at = np.concatenate(starts)[best]
    return np.where(2 * found[best] >= n, 0, np.where(at == 0, n, at)).tolist()


def decompose(arrays: DataFrame, depth: int = DEPTH, cutoff: int | None = None, compat: bool = True, check: bool = False) -> DataFrame:
    """Bulk path: (array_ord, header, cut, score, period, pieces) in Arrow batches, one array a row.

    ``check`` adds ``problem``: why the array couldn't be refined ("" if it could).
    """
    importable(arrays.sparkSession)
    header = F.col("header") if "header" in arrays.columns else F.lit(None).cast("string").alias("header")
    based = with_cutoff(arrays.select("array_ord", header, F.coalesce("seq", F.lit("")).alias("seq")), cutoff, sticky=compat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(decompose_texts(batch.column("seq").to_pylist(), depth, batch.column("cutoff").to_pylist(), compat))
            if rows:
                problem = ["empty array" if not s else "" if any(len(x) == p for x in x4) else "no monomer as long as the period" for s, (_, _, p, x4) in zip(batch.column("seq").to_pylist(), rows, strict=True)]
                kinds = [pa.string(), pa.float64(), pa.int32(), pa.list_(pa.string())]
                made = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("array_ord"), batch.column("header"), *made, pa.array(problem, pa.string())], ["array_ord", "header", "cut", "score", "period", "pieces", "problem"])

    out = based.mapInArrow(run, "array_ord long, header string, cut string, score double, period int, pieces array<string>, problem string")
    return out if check else out.drop("problem")


def require_decomposable(decomposed: DataFrame) -> DataFrame:
    """Raise for arrays that the program this mirrors can't handle; ``decomposed`` comes with ``check``."""
    bad = decomposed.where("problem <> ''").select("array_ord", "problem").take(1)
    if bad:
        raise NoReferenceMonomer(f"array {bad[0]['array_ord']}: {bad[0]['problem']}")
    return decomposed.drop("problem")
