"""One strand and one start k-mer for all decomposed arrays."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from . import growth as G
from .tables import elements, importable

K = 5
CANDIDATES = 100
LEAST_F1 = 0.5


class NoStartKmer(ValueError):
    """No candidate k-mer starts monomers well enough."""


def oriented(arrays: DataFrame, start: str | None = None) -> DataFrame:
    """(array_ord, pieces, reversed) of (array_ord, pieces), by base counts or by a given k-mer."""
    spaced = F.array_join("pieces", " ")
    text = S.orient_by_kmer(F.col("spaced"), F.lit(start)) if start else S.orient_by_bases(F.col("spaced"))
    turned = arrays.withColumn("spaced", spaced).withColumn("turned", text)
    others = [c for c in arrays.columns if c != "pieces"]
    return turned.select(*others, S.whitespace_split(F.col("turned")).alias("pieces"), (F.col("turned") != F.col("spaced")).alias("reversed"))


def kmer_census(arrays: DataFrame, k: int = K) -> DataFrame:
    """(kmer, n, first_ord, first_pos) over the joined arrays; a run of the same k-mer counts once."""
    importable(arrays.sparkSession)
    joined = arrays.select(F.col("array_ord").cast("long").alias("array_ord"), F.array_join("pieces", "").alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # In the order of arrays, so that the first place among the texts is the first of all.
            # Short ones go here: a condition on the text would have its whole expression computed again below.
            batch = batch.filter(pc.greater_equal(pc.utf8_length(batch.column("s")), k)).sort_by("array_ord")
            texts, ords = batch.column("s").to_pylist(), batch.column("array_ord").to_numpy()
            for part in G.chunks(list(map(len, texts))):
                owner, n, place = G.census(texts[part], k)
                columns = [[texts[part][i][p : p + k] for i, p in zip(owner.tolist(), place.tolist(), strict=True)], n, ords[part][owner], place]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.string(), pa.int64(), pa.int64(), pa.int32()], strict=True)], ["kmer", "n", "a", "p"])

    counted = joined.mapInArrow(run, "kmer string, n long, a long, p int").groupBy("kmer").agg(F.sum("n").alias("n"), F.min(F.struct("a", "p")).alias("f"))
    return counted.select("kmer", "n", F.col("f.a").alias("first_ord"), F.col("f.p").alias("first_pos"))


def start_kmers(arrays: DataFrame, census: DataFrame) -> DataFrame:
    """(kmer, rank, r, p, f1) of the most frequent k-mers.

    r and p are the shares of monomers that hold the k-mer at all, and once.  The candidates are a
    hundred rows by definition, matched with distinct monomers and their counts.
    """
    top = census.orderBy(F.desc("n"), "first_ord", "first_pos").limit(CANDIDATES)
    ranked = top.select("kmer", F.row_number().over(Window.orderBy(F.desc("n"), "first_ord", "first_pos")).alias("rank"))
    monomers = elements(arrays, "pieces", "m").groupBy("m").agg(F.count("*").alias("n"))
    listed = ranked.agg(F.collect_list(F.struct("kmer", "rank")).alias("kmers"))
    pairs = monomers.crossJoin(F.broadcast(listed)).select("m", "n", F.explode("kmers").alias("k"))  # one row of a hundred
    copies = S.occurrences(F.col("m"), F.col("k.kmer"))
    sums = pairs.select("k.kmer", "k.rank", "n", copies.alias("c")).groupBy("kmer", "rank").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("any"), F.sum(F.when(F.col("c") == 1, F.col("n")).otherwise(0)).alias("once"))
    r, p = F.col("any") / F.col("all"), F.col("once") / F.col("all")
    return sums.select("kmer", "rank", r.alias("r"), p.alias("p"), F.when(r + p > 0, 2 * r * p / (r + p)).otherwise(F.lit(0.0)).alias("f1"))


def start_kmer(arrays: DataFrame) -> DataFrame:
    """The best of ``start_kmers``: greatest f1 of at least one half, the more frequent of equals; at most one row."""
    good = start_kmers(arrays, kmer_census(arrays)).where(F.col("f1") >= LEAST_F1)
    return good.orderBy(F.desc("f1"), "rank").limit(1)


def cut_before(joined: Column, kmer: Column) -> Column:
    """Pieces of the joined array, cut before every occurrence of the k-mer, overlapping ones too."""
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, F.concat(F.lit("(?="), S.quoted(kmer), F.lit(")")), -1))


def rotate(arrays: DataFrame, start: str | None = None, compat: bool = False) -> DataFrame:
    """(array_ord, ..., pieces, reversed) cut at the start k-mer.

    Without a start k-mer one is chosen over all arrays; if none will do, ``compat`` raises and
    otherwise the arrays stay oriented and uncut.
    """
    turned = oriented(arrays, start)
    if not start:
        best = start_kmer(turned).select("kmer").take(1)  # one row by definition
        if not best:
            if compat:
                raise NoStartKmer("no k-mer starts enough monomers")
            return turned
        start = best[0]["kmer"]
    return turned.withColumn("pieces", cut_before(F.array_join("pieces", ""), F.lit(start)))
