"""Byte-level BPE by ranks: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest.

Operator 8.  ``encode`` and ``decode`` are the general operators (ids as a little-endian binary
column); ``roundtrip_digest`` does both in one pass over the text and returns digests.

Null texts count as empty: no ids, digests of no bytes.  Repeated rows give repeated results, an empty
table an empty one; of pieces that could be merged next the leftmost goes first; a very long text is encoded whole
in one worker.  Other columns of the input are kept or ignored as each function says, and a kept column that has
the name of a column made gives way to it.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Entries of the caches that one Python worker keeps of parts between spaces and of pre-tokens; the older
#: half goes when a newer half is full.
CACHE_PARTS, CACHE_WORDS = 500_000, 250_000
#: Longer parts are encoded each time, so that the caches' memory is bounded.
CACHE_CHARS = 64
#: Signs that may end a part and are a pre-token of their own after letters.
ENDS = frozenset(".,!?;:|*%&$#)")


def load_ranks(path: str) -> bytes:
    """The rank file as it is; about a megabyte, its size fixed by the public vocabulary."""
    with open(path, "rb") as f:
        return f.read()


class PerfectHash:
    """Minimal perfect hash of byte strings by hash and displace: n keys fill n slots."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 3)
        self.shift = [0] * self.buckets
        slots: list[int] = [-1] * n
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            groups[h % self.buckets].append(i)
        free = None
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            members = groups[b]
            if not members:
                break
            if len(members) == 1:
                # Singles take what is left; a negative shift names the slot itself.
                if free is None:
                    free = [i for i, x in enumerate(slots) if x < 0]
                s = free.pop()
                slots[s], self.shift[b] = members[0], -s - 1
                continue
            d = 0
            while True:
                at = [self._slot(hashes[i], d) for i in members]
                if len(set(at)) == len(at) and all(slots[s] < 0 for s in at):
                    break
                d += 1
            self.shift[b] = d
            for s, i in zip(at, members, strict=True):
                slots[s] = i
        self.keys = [keys[i] for i in slots]
        self.values = slots

    def _slot(self, h: int, d: int) -> int:
        return (((h >> 20) ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) % self.n

    def find(self, key: bytes) -> int:
        """Index of ``key`` among the keys given, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        s = -d - 1 if d < 0 else self._slot(h, d)
        return self.values[s] if self.keys[s] == key else -1


def merge(piece: bytes, rank_of) -> list[int]:
    """BPE of one pre-token: the lowest rank first, the leftmost of equals; O(n log n).

    ``after[i]`` is the end of the part that starts at i, ``before[i]`` the start of the part left of
    it.  A heap entry holds rank, start and end in one integer and is stale when its start or end is no
    longer a part's.
    """
    n = len(piece)
    after = list(range(1, n + 1))
    before = list(range(-1, n))
    w = n.bit_length()
    mask = (1 << w) - 1
    heap = [((r << w | i) << w) | i + 2 for i in range(n - 1) if (r := rank_of(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    tokens = [rank_of(piece[i : i + 1]) for i in range(n)]
    while heap:
        x = pop(heap)
        end = x & mask
        i = x >> w & mask
        j = after[i]
        if j < 0 or j >= n or after[j] != end:
            continue
        after[i], after[j], tokens[i] = end, -1, x >> w + w
        if end < n:
            before[end] = i
            e = after[end]
            if (r := rank_of(piece[i:e])) is not None:
                push(heap, ((r << w | i) << w) | e)
        if i:
            p = before[i]
            if (r := rank_of(piece[p:end])) is not None:
                push(heap, ((r << w | p) << w) | end)
    out, i = [], 0
    while i < n:
        out.append(tokens[i])
        i = after[i]
    return out


class Codec:
    """Encoder and decoder of one Python process."""

    def __init__(self, rank_file: bytes, pattern: str):
        pairs = [line.split() for line in rank_file.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.words = list(self.ranks)
        ids = list(self.ranks.values())
        self.hash = PerfectHash(self.words)
        self.hash.values = [ids[i] for i in self.hash.values]
        self.bytes = [b""] * (max(ids) + 1)
        for k, v in self.ranks.items():
            self.bytes[v] = k
        self.units = Units(pattern, lambda word: array("I", self.piece(word.encode())).tobytes())

    def piece(self, b: bytes) -> list[int]:
        i = self.hash.find(b)
        return [i] if i >= 0 else merge(b, self.ranks.get)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return self.units.encode(text)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Units:
    """Encodes a text part by part between single spaces, each part looked up in a bounded cache.

    A space begins a new pre-token wherever no white space stands beside it, so the parts encode
    independently; a text where that doesn't hold is split as a whole.  ``word`` gives the ids of one
    pre-token as little-endian bytes.
    """

    #: A space before white space, or after it at the text's end.  ``\\s`` of Python covers that of the pattern.
    joined_any = re.compile(r" \s|\s \Z").search
    blanks = "\n\t\r\x0b\x0c\x1c\x1d\x1e\x1f "
    after = tuple(" " + x for x in blanks)
    last = tuple(x + " " for x in blanks)

    def __init__(self, pattern: str, word, most_parts: int = CACHE_PARTS, most_words: int = CACHE_WORDS):
        self.split, self.make = regex.compile(pattern).findall, word
        #: Whether a line break between words is a pre-token of its own in this pattern.
        self.lines = self.split(" a\nb") == [" a", "\n", "b"] and all(self.split(f" a{x}\nb") == [" a", x, "\n", "b"] for x in ENDS)
        self.most_parts, self.most_words = most_parts, most_words
        self.parts, self.old_parts, self.words, self.old_words = {}, {}, {}, {}

    def joined(self, text: str) -> bool:
        if text.isascii():
            return any(x in text for x in self.after) or text.endswith(self.last)
        return self.joined_any(text) is not None

    def encode(self, text: str) -> bytes:
        head, *parts = text.split(" ")
        known = self.parts
        if missing := list(dict.fromkeys(filterfalse(known.__contains__, parts))):
            # Parts that begin with white space are never in the cache, so only a text that misses some can be joined.
            if any(p[:1].isspace() or not p for p in missing) and self.joined(text):
                return self.whole(text)
            long = self.fill(missing)
            tail = b"".join(map(known.__getitem__, parts))
            for p in long:
                known.pop(p, None)
            if len(known) >= self.most_parts // 2:
                self.parts, self.old_parts = {}, known
        else:
            tail = b"".join(map(known.__getitem__, parts))
        return self.whole(head) + tail if head else tail

    def whole(self, text: str) -> bytes:
        words = self.words
        return b"".join([words.get(p) or self.word(p) for p in self.split(text)])

    def word(self, p: str) -> bytes:
        ids = self.words.get(p)
        if ids is None:
            ids = self.old_words.get(p) or self.make(p)
            if len(p) <= CACHE_CHARS:
                if len(self.words) >= self.most_words // 2:
                    self.words, self.old_words = {}, self.words
                self.words[p] = ids
        return ids

    def spaced(self, p: str) -> bytes:
        """Ids of a space and the letters ``p``, which are a part themselves."""
        ids = self.parts.get(p) or self.old_parts.get(p)
        if ids is None:
            ids = self.make(" " + p)
            if len(p) <= CACHE_CHARS:
                self.parts[p] = ids
        return ids

    def part(self, p: str) -> bytes:
        """Ids of a space and ``p``."""
        if p[:-1].isalpha() and p[-1] in ENDS:
            return self.spaced(p[:-1]) + self.word(p[-1])
        if self.lines:
            # The last word of a line, its sign if any, the line break, and the first word of the next line.
            a, _, b = p.partition("\n")
            if b.isalpha():
                if a.isalpha():
                    return self.spaced(a) + self.word("\n") + self.word(b)
                if a[:-1].isalpha() and a[-1] in ENDS:
                    return self.spaced(a[:-1]) + self.word(a[-1]) + self.word("\n") + self.word(b)
        return self.whole(" " + p)

    def fill(self, missing: list[str]) -> list[str]:
        """Put the missing parts into the cache; returns those too long to stay."""
        known, old, make, part = self.parts, self.old_parts.get, self.make, self.part
        for p in missing:
            # What this cache has just dropped, a word alone, or more than a word.
            known[p] = old(p) or (make(" " + p) if p.isalpha() else part(p))
        return [p for p in missing if len(p) > CACHE_CHARS or not p]


def codec(rank_file: bytes, pattern: str) -> Codec:
    """The codec of this process, made once."""
    return common.kept("bpe", (hash(rank_file), pattern), lambda: Codec(rank_file, pattern))


def _map(df: DataFrame, vocabulary, pattern: str, column: str, keep: list[str], work, schema: str) -> DataFrame:
    rank_file = df.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = codec(rank_file.value, pattern)
        for start, end in common.pieces(batch, column):
            rows = [work(c, x) for x in batch.column(column)[start:end].to_pylist()]
            kept = [batch.column(k)[start:end] for k in keep]
            made = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*keep, *names])

    names = [x.split()[0] for x in schema.split(", ")]
    keep = [k for k in keep if k not in names]
    types = [{"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[x.split()[1]] for x in schema.split(", ")]
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for k in keep for f in df.schema if f.name == k)
    return common.arrow_map(df.select(*keep, *[c for c in [column] if c not in keep]), run, head + schema)


def encode(df: DataFrame, vocabulary: str, pattern: str, keep: list[str], column: str = "text") -> DataFrame:
    """``keep`` columns, then ``n_tokens`` and ``ids`` (binary, little-endian unsigned 32-bit integers)."""

    def work(c: Codec, text: str | None):
        ids = c.encode(text or "")
        return len(ids) // 4, ids

    return _map(df, vocabulary, pattern, column, keep, work, "n_tokens long, ids binary")


def decode(df: DataFrame, vocabulary: str, pattern: str, keep: list[str], column: str = "ids") -> DataFrame:
    """``keep`` columns, then ``decoded`` (binary: the text's bytes)."""
    return _map(df, vocabulary, pattern, column, keep, lambda c, ids: (c.decode(ids or b""),), "decoded binary")


def roundtrip_digest(df: DataFrame, vocabulary: str, pattern: str, keep: list[str], with_ids: bool = False, column: str = "text") -> DataFrame:
    """Encode, then decode the ids: ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked for, ``ids``."""

    def work(c: Codec, text: str | None):
        ids = c.encode(text or "")
        row = len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()
        return (*row, ids) if with_ids else row

    return _map(df, vocabulary, pattern, column, keep, work, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 8 over all documents."""
    import public_tokenizers as public

    return roundtrip_digest(common.table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN, ["doc_id"])


QUERIES = {"op8_byte_bpe": op8_byte_bpe}
SQL: dict[str, str] = {}
