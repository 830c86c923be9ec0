"""Encoding of the whole corpus with a byte-level BPE vocabulary.

Two tiers. A minimal perfect hash over the vocabulary (hash and displace)
resolves each pre-token that is a token as a whole, by one probe and one
comparison. The others are merged byte by byte: symbols are a linked list, and a
heap holds the candidate merges by rank; stale ones are skipped when they come up.

The vocabulary and its hash are built once on the driver and broadcast: their
size is that of the vocabulary file, which is checked."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from citeflow.runtime import spread, table

#: Where the public vocabularies lie; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
#: Pre-tokenisation of the GPT-2 family (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A vocabulary of more tokens is refused rather than broadcast.
MOST_TOKENS = 2_000_000
#: Resolved pre-tokens that a Python worker keeps; it starts anew when full.
KEPT = 200_000


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a ``.tiktoken`` file by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    if len(tokens) > MOST_TOKENS:
        raise ValueError(f"{len(tokens)} tokens; {MOST_TOKENS} may be broadcast")
    return tokens


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: ``find`` gives the index
    of one of them, or -1 for any other string."""

    def __init__(self, keys: list[bytes]):
        for self.seed in range(20):
            if self._build(keys):
                return
        raise ValueError("equal keys")

    def _build(self, keys: list[bytes]) -> bool:
        self.keys, self.n = keys, len(keys)
        n, self.buckets = self.n, max(1, self.n // 3)
        h = [xxhash.xxh3_128_intdigest(k, self.seed) for k in keys]
        first = np.array([x & 0xFFFFFFFF for x in h], dtype=np.int64) % self.buckets
        a = np.array([(x >> 32) & 0xFFFFFFFF for x in h], dtype=np.int64)
        b = np.array([(x >> 64) & 0xFFFFFFFF for x in h], dtype=np.int64) % max(1, n)
        order = np.argsort(first, kind="stable")
        starts = np.searchsorted(first[order], np.arange(self.buckets + 1))
        sizes = np.diff(starts)
        taken, shift, slot = np.zeros(n, dtype=bool), np.zeros(self.buckets, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for bucket in np.argsort(-sizes, kind="stable"):
            own = order[starts[bucket] : starts[bucket + 1]]
            if len(own) < 2:
                break
            for base in range(0, 1 << 24, 512):  # displacements are tried by the block
                d = np.arange(base, base + 512, dtype=np.int64)
                at = np.sort((a[own][:, None] + d * b[own][:, None] + d * d) % n, axis=0)
                good = np.flatnonzero(~taken[at].any(axis=0) & (np.diff(at, axis=0) > 0).all(axis=0))
                if len(good):
                    shift[bucket] = d = base + int(good[0])
                    slot[own] = (a[own] + d * b[own] + d * d) % n
                    taken[slot[own]] = True
                    break
            else:
                return False
        # A bucket of one key names its slot outright, as -1 - slot.
        ones = np.flatnonzero(sizes == 1)
        free = np.flatnonzero(~taken)
        slot[order[starts[ones]]] = free
        shift[ones] = -1 - free
        index = np.empty(n, dtype=np.int64)
        index[slot] = np.arange(n)
        self.shift, self.index = shift.tolist(), index.tolist()
        return True

    def find(self, key: bytes) -> int:
        if not self.n:
            return -1
        h = xxhash.xxh3_128_intdigest(key, self.seed)
        d = self.shift[(h & 0xFFFFFFFF) % self.buckets]
        if d < 0:
            i = self.index[-1 - d]
        else:
            i = self.index[(((h >> 32) & 0xFFFFFFFF) + d * (((h >> 64) & 0xFFFFFFFF) % self.n) + d * d) % self.n]
        return i if self.keys[i] == key else -1


class Encoder:
    """Byte-level BPE by ranks."""

    def __init__(self, tokens: list[bytes]):
        self.hash = PerfectHash(tokens)
        self.single = [self.hash.find(bytes([b])) for b in range(256)]
        if min(self.single) < 0:
            raise ValueError("the vocabulary lacks single bytes")

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is no token as a whole."""
        find, n = self.hash.find, len(piece)
        start, end = list(range(n)), list(range(1, n + 1))
        prev, following = list(range(-1, n - 1)), list(range(1, n + 1))
        ids = [self.single[b] for b in piece]
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := find(piece[i : i + 2])) >= 0]
        heapq.heapify(heap)
        while heap:
            rank, i, to = heapq.heappop(heap)
            if not alive[i]:
                continue
            j = following[i]
            if j >= n or end[j] != to:
                continue  # one side has grown since
            end[i], ids[i], alive[j] = to, rank, False
            k = following[i] = following[j]
            if k < n:
                prev[k] = i
                if (r := find(piece[start[i] : end[k]])) >= 0:
                    heapq.heappush(heap, (r, i, end[k]))
            p = prev[i]
            if p >= 0 and (r := find(piece[start[p] : to])) >= 0:
                heapq.heappush(heap, (r, p, to))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = following[i]
        return out

    def piece(self, text: str) -> tuple[int, ...]:
        raw = text.encode("utf-8", "surrogatepass")
        whole = self.hash.find(raw)
        return (whole,) if whole >= 0 else tuple(self.merge(raw))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(read_ranks(path))


def encode(docs: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, ids) of each row: ids are the integers of its text, an empty list
    for null and for an empty text. Rows stay as they are: repeated keys and
    texts are encoded each."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(encoder(path))
    kind = docs.schema[key].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pieces, known = shared.value, regex.compile(PATTERN).findall, {}
        for batch in it:
            lists, lengths = [], [0]
            for t in batch.column(1).to_pylist():
                n = lengths[-1]
                if t:
                    for p in pieces(t):
                        got = known.get(p)
                        if got is None:
                            got = enc.piece(p)
                            if len(p) <= 64:
                                if len(known) >= KEPT:
                                    known.clear()
                                known[p] = got
                        lists.append(got)
                        n += len(got)
                lengths.append(n)
            flat = pa.array(np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=lengths[-1]))
            ids = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["k", "ids"])

    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document's text."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return encode(docs, "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


QUERIES = {"p7_ids": p7_ids}
SQL: dict[str, str] = {}
