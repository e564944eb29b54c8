"""Token ids in files of directly addressable codes (operator 10).

An id is cut into 8-bit chunks, lowest first.  Level k holds the k-th chunk of every id that has one,
a continuation bitmap says which ids go on to level k + 1, and a rank directory counts the set bits
before each block of 512, so that token i is found by one rank a level: no block is decoded.

A file is a Parquet part of such segments: one row for about ``SEGMENT`` tokens or for one longer
document, with document ids and ends beside the levels.  Spark's writer commits the parts, so a lost
executor leaves no half-written file.  Parts and segments are in ascending order of the document id.

Null texts count as empty: the end id alone.  Null ids come first; equal ids are ordered by a hash of
the text, so equal rows can be told apart by nothing but their place.  An empty table gives no rows.  A very
long text is a segment of its own.  Only the id and text columns are read, so other columns may have any names.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .bpe import Units

#: Tokens of a segment; a longer document has one of its own.
SEGMENT = 1 << 20
BLOCK = 512
#: Entries of the encoder's caches in a worker, about 150 bytes each.
CACHE_PARTS, CACHE_WORDS = 1_000_000, 500_000
LAYOUT = "part int, seg int, seg_start long, n_tokens long, doc_ids array<bigint>, doc_ends binary, levels array<binary>, bitmaps array<binary>, ranks array<binary>"


def pack(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels, bitmaps and rank directories of ids up to 32 bits."""
    levels, bitmaps, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        levels.append((rest & 0xFF).astype(np.uint8).tobytes())
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bitmaps.append(bits.tobytes())
        counts = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        ranks.append(np.concatenate([[0], np.cumsum(counts)]).astype("<u4").tobytes())
        if not more.any():
            return levels, bitmaps, ranks
        rest = rest[more] >> 8


def unpack(levels: list[bytes], bitmaps: list[bytes]) -> np.ndarray:
    """All ids of a segment."""
    out = np.zeros(0, np.uint32)
    for level, bitmap in zip(reversed(levels), reversed(bitmaps), strict=True):
        low = np.frombuffer(level, np.uint8)
        here = low.astype(np.uint32)
        if len(out):
            more = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little", count=len(low)).astype(bool)
            here[more] |= out << 8
        out = here
    return out


def token_at(i: int, levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes]) -> int:
    """Id of token ``i``: one byte and one rank a level."""
    value = shift = 0
    for level, bitmap, rank in zip(levels, bitmaps, ranks, strict=True):
        value |= level[i] << shift
        if not bitmap[i >> 3] >> (i & 7) & 1:
            break
        block = i // BLOCK
        before = int.from_bytes(bitmap[block * BLOCK // 8 : i // 8], "little").bit_count() + (bitmap[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
        i = int.from_bytes(rank[4 * block : 4 * block + 4], "little") + before
        shift += 8
    return value


#: How byte-level models write bytes as letters: printable ones as themselves, the rest from 256 on.
_shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
_letters = {b: b for b in _shown} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_shown))}


def _shown_as(word: str) -> str:
    """A pre-token in the letters of the model."""
    if word.isascii():
        # Of the signs from the space to the tilde only the space, which can but begin a longer pre-token, is changed.
        if word.isalpha():
            return word
        if word[0] == " " and word[1:].isalpha():
            return "\u0120" + word[1:]
    return word.encode().decode("latin-1").translate(_letters)


def _encoder(model: str, pattern: str) -> Callable[[str], bytes]:
    """The library's BPE model of this process behind a bounded cache of pre-tokens.

    Texts that hold an added token are encoded by the library as a whole.
    """

    def make() -> Callable[[str], bytes]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole = Tokenizer.from_str(model)
        bpe = whole.model.tokenize
        raw = [i.to_bytes(4, "little") for i in range(whole.get_vocab_size())]

        def word(text: str) -> bytes:
            # Most are a space and letters; see ``_shown_as``.
            found = bpe("\u0120" + text[1:] if text[0] == " " and text.isascii() and text[1:].isalpha() else _shown_as(text))
            return raw[found[0].id] if len(found) == 1 else b"".join([raw[x.id] for x in found])

        encode = Units(pattern, word, CACHE_PARTS, CACHE_WORDS).encode
        added = [x.content for x in whole.get_added_tokens_decoder().values()]
        return lambda text: array("I", whole.encode(text, add_special_tokens=False).ids).tobytes() if any(x in text for x in added) else encode(text)

    return common.kept("tokens", hash((model, pattern)), make)


def _segment(part: int, seg: int, start: int, docs: list, ends: list[int], ids: list[bytes]) -> tuple[pa.RecordBatch, int]:
    tokens = np.frombuffer(b"".join(ids), "<u4")
    levels, bitmaps, ranks = pack(tokens)
    row = [[part], [seg], [start], [len(tokens)], [docs], [np.array(ends, "<u8").tobytes()], [levels], [bitmaps], [ranks]]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), *[pa.list_(pa.binary())] * 3]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], [x.split()[0] for x in LAYOUT.split(", ")]), start + len(tokens)


def write_tokens(docs: DataFrame, path: str, model_file: str, pattern: str, end_id: int, id_column: str = "doc_id", column: str = "text") -> None:
    """Encode every text, append ``end_id`` and write the segments in ascending order of the id."""
    with open(model_file, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(model.value, pattern)
        part = TaskContext.get().partitionId()
        seg = start = n = 0
        doc_ids, ends, ids = [], [], []
        for batch in batches:
            for a, b in common.pieces(batch):
                for doc, text in zip(batch.column("doc_id")[a:b].to_pylist(), batch.column("text")[a:b].to_pylist(), strict=True):
                    own = encode(text or "") + end
                    if doc_ids and n + len(own) // 4 > SEGMENT:
                        out, start = _segment(part, seg, start, doc_ids, ends, ids)
                        yield out
                        seg, n, doc_ids, ends, ids = seg + 1, 0, [], [], []
                    n += len(own) // 4
                    doc_ids.append(doc)
                    ends.append(n)
                    ids.append(own)
        if doc_ids:
            yield _segment(part, seg, start, doc_ids, ends, ids)[0]

    common.importable(docs.sparkSession)
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(column).alias("text"))
    # The hash also cuts a run of equal ids between partitions.
    order = ["doc_id", F.xxhash64("text")]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, LAYOUT).write.option("compression", "uncompressed").parquet(path)


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Per document of the files: ``doc_id``, ``start``, ``n_tokens``, and ``ids`` (binary) or ``ids_crc32``.

    The starts of the parts come from their totals: one small row a part.
    """
    segments = spark.read.schema(LAYOUT).parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(batch.num_rows):
            row = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
            ids = unpack(row["levels"], row["bitmaps"])
            ends = np.frombuffer(row["doc_ends"], "<u8").astype(np.int64)
            starts = np.concatenate([[0], ends[:-1]])
            raw = memoryview(ids.astype("<u4").tobytes())
            parts = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            last = pa.array([zlib.crc32(x) for x in parts], pa.int64()) if digest else pa.array([bytes(x) for x in parts], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts + (row["seg_start"] + row["part_start"])), pa.array(ends - starts), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    needed = segments.select("part", "seg_start", "doc_ids", "doc_ends", "levels", "bitmaps").join(before, "part")
    return common.arrow_map(needed, run, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary"))


def segment_index(spark: SparkSession, path: str) -> DataFrame:
    """One small row a segment: ``start`` and ``n_tokens`` of its tokens among all, ``part`` and ``seg``."""
    rows = spark.read.schema(LAYOUT).parquet(path).select("part", "seg", "seg_start", "n_tokens")
    before = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    return rows.join(before, "part").select("part", "seg", (F.col("part_start") + F.col("seg_start")).alias("start"), "n_tokens")


def tokens_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """``positions`` (``position``, counted over all tokens of the files) with ``id``; no segment is unpacked.

    Positions are joined with the index of the segments, then with their levels, bitmaps and rank directories, and
    each is resolved by one byte and one rank a level.  A position outside of the files has a null id.
    """
    index = segment_index(spark, path)
    # Segments are told apart by ranges of as many positions; a segment of more tokens stands in several.
    spread = index.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / SEGMENT), F.floor((F.col("start") + F.greatest(F.col("n_tokens") - 1, F.lit(0))) / SEGMENT))))
    asked = positions.select("position").withColumn("cell", F.floor(F.col("position") / SEGMENT))
    placed = asked.join(spread, (asked["cell"] == spread["cell"]) & (F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + F.col("n_tokens")), "left").select("position", "part", "seg", (F.col("position") - F.col("start")).alias("i"))
    segments = spark.read.schema(LAYOUT).parquet(path).select("part", "seg", "levels", "bitmaps", "ranks")
    # All positions of a segment go with it in one row, in chunks, so that its levels are sent once a chunk.
    chunks = placed.where("part is not null").groupBy("part", "seg", F.pmod(F.xxhash64("position"), F.lit(16)).alias("chunk")).agg(F.collect_set("i").alias("at"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k in range(batch.num_rows):
            levels, bitmaps, ranks, at = (batch.column(c)[k].as_py() for c in ("levels", "bitmaps", "ranks", "at"))
            ids = [token_at(i, levels, bitmaps, ranks) for i in at]
            same = [pa.array([batch.column(c)[k].as_py()] * len(at), pa.int32()) for c in ("part", "seg")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(at, pa.int64()), pa.array(ids, pa.int64())], ["part", "seg", "i", "id"])

    found = common.arrow_map(segments.join(chunks, ["part", "seg"]).select("part", "seg", "at", "levels", "bitmaps", "ranks"), run, "part int, seg int, i long, id long")
    return placed.join(found, ["part", "seg", "i"], "left").select("position", "id")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 10: files in the shared folder, then the documents read back from them."""
    import public_tokenizers as public

    path = f"{common.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(common.table(spark, sf_dir, "documents"), path, public.path("byte_bpe_50k.json"), public.PATTERN, 2)
    return read_tokens(spark, path, digest=True)


QUERIES = {"op10_token_files": op10_token_files}
SQL: dict[str, str] = {}
