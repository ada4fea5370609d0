"""Byte-level BPE encoding and decoding (operator 12) by a hierarchical-bitmap rank queue.

The pieces of a text (matches of the split pattern) are merged each for itself.  Their adjacent
pairs wait in buckets, one per merge rank; a bitmap of three levels of 64-bit words marks
the ranks whose bucket holds something, so the lowest waiting rank is found by one
find-first-set per level, whatever the length of a piece.  A bucket holds the positions
of a linked list over the pieces' bytes, leftmost first; a position whose pair has changed since it
was put there is stale and skipped.  Every merge puts at most two new pairs into the queue, so
n bytes take O(n log n) steps, also where a whole text is one piece.

A worker remembers the ids of short pieces it has met (about ``REMEMBERED`` of them, then it
starts anew), which changes no result.  Texts are split in parts of about ``PART_CHARS``
characters, cut before white space that follows other characters, where every match ends.

Defined results: a null text counts as an empty one (no ids); null and repeated ``doc_id`` are
rows like any other; a text without white space, however long, is one part; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
from array import array
from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow

#: Pieces of at most ``SHORT_PIECE`` characters are remembered, at most ``REMEMBERED`` of them.
REMEMBERED, SHORT_PIECE = 1_000_000, 48
PART_CHARS = 1 << 20
#: Bytes of input whose results are sent back at a time (one row at least).
SEND_BYTES = 1 << 23
CUT = regex.compile(r"(?<=\S)(?=\s)")
_WORKER: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """The merge ranks of a rank file: one line ``base64 rank`` per token."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class RankQueue:
    """Positions by rank: a heap of positions per rank and a bitmap of the ranks that have one."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.high = [0] * ((ranks >> 18) + 1)
        self.buckets: dict[int, list[int]] = {}

    def open(self, rank: int, positions: list[int]) -> None:
        """Put a bucket of ascending positions at a rank that has none."""
        self.buckets[rank] = positions
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.high[rank >> 18] |= 1 << (rank >> 12 & 63)

    def lowest(self) -> int:
        """The lowest rank that has a bucket, by find-first-set from level to level; -1 if none has."""
        for at, word in enumerate(self.high):
            if word:
                at = at << 6 | (word & -word).bit_length() - 1
                word = self.mid[at]
                at = at << 6 | (word & -word).bit_length() - 1
                word = self.low[at]
                return at << 6 | (word & -word).bit_length() - 1
        return -1

    def close(self, rank: int) -> None:
        del self.buckets[rank]
        self.low[rank >> 6] ^= 1 << (rank & 63)
        if not self.low[rank >> 6]:
            self.mid[rank >> 12] ^= 1 << (rank >> 6 & 63)
            if not self.mid[rank >> 12]:
                self.high[rank >> 18] ^= 1 << (rank >> 12 & 63)


class RankBPE:
    """Ids of texts and bytes of ids for one rank table and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"single bytes without a rank: {missing}")
        self.ranks = ranks
        self.split = regex.compile(pattern)
        self.size = max(ranks.values()) + 1
        self.token = [b""] * self.size
        for token, rank in ranks.items():
            self.token[rank] = token
        self.byte = [bytes([b]) for b in range(256)]
        self.known: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece.  All pieces wait in one queue: their merges don't touch each other,
        and a bucket is drained until a merge brings a pair of a lower rank."""
        data = b"".join(pieces)
        n, rank_of, queue = len(data), self.ranks.get, RankQueue(self.size)
        buckets, open_bucket = queue.buckets, queue.open
        node = [self.byte[b] for b in data]
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        waiting = array("i", [-1]) * n  # rank of the pair that starts here
        start, first = 0, defaultdict(list)
        for piece in pieces:
            end = start + len(piece)
            after[end - 1] = before[start] = -1
            for i in range(start, end - 1):
                rank = rank_of(data[i:i + 2])
                if rank is not None:
                    waiting[i] = rank
                    first[rank].append(i)
            start = end
        for rank, positions in first.items():
            open_bucket(rank, positions)
        while (rank := queue.lowest()) >= 0:
            bucket, token, lower = buckets[rank], self.token[rank], False
            while bucket and not lower:
                i = heappop(bucket)
                if waiting[i] != rank:
                    continue
                right = after[i]
                end = after[right]
                after[i], node[i] = end, token
                waiting[i] = waiting[right] = -1
                if end >= 0:
                    before[end] = i
                    new = rank_of(token + node[end])
                    if new is not None:
                        waiting[i] = new
                        lower = new < rank
                        if new in buckets:
                            heappush(buckets[new], i)
                        else:
                            open_bucket(new, [i])
                left = before[i]
                if left >= 0:
                    new = rank_of(node[left] + token)
                    if new is None:
                        waiting[left] = -1
                    else:
                        waiting[left] = new
                        lower = lower or new < rank
                        if new in buckets:
                            heappush(buckets[new], left)
                        else:
                            open_bucket(new, [left])
            if not bucket:
                queue.close(rank)
        out, start = [], 0
        for piece in pieces:
            ids, i = [], start
            while i >= 0:
                ids.append(self.ranks[node[i]])
                i = after[i]
            out.append(ids)
            start += len(piece)
        return out

    def _learn(self, pieces: list[str]) -> None:
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        rest = []
        for piece, data in zip(pieces, raw):
            rank = self.ranks.get(data)      # a piece that is a token itself is not merged
            if rank is None:
                rest.append((piece, data))
            else:
                self.known[piece] = rank.to_bytes(4, "little")
        for (piece, _), ids in zip(rest, self.merge([data for _, data in rest]), strict=True):
            self.known[piece] = np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held, size = [], 0

        def settle() -> None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            new = list(dict.fromkeys(p for _, pieces in held for p in pieces if p not in self.known))
            self._learn(new)
            for i, pieces in held:
                out[i].append(b"".join(map(self.known.__getitem__, pieces)))
            for piece in new:
                if len(piece) > SHORT_PIECE:
                    del self.known[piece]

        for i, text in enumerate(texts):
            for part in parts(text):
                held.append((i, self.split.findall(part)))
                size += len(part)
                if size >= PART_CHARS:
                    settle()
                    held, size = [], 0
        settle()
        return [b"".join(x) for x in out]

    def decode(self, values: list[bytes]) -> list[bytes]:
        return [b"".join(map(self.token.__getitem__, np.frombuffer(v, "<u4").tolist())) for v in values]


def parts(text: str) -> Iterator[str]:
    """The text in parts of about ``PART_CHARS`` characters that end where a piece ends."""
    at = 0
    while len(text) - at > PART_CHARS:
        cut = CUT.search(text, at + PART_CHARS)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def _codec(path: str, pattern: str) -> RankBPE:
    key = (path, pattern)
    if key not in _WORKER:
        _WORKER[key] = RankBPE(read_ranks(path), pattern)
    return _WORKER[key]


def _mapped(df: DataFrame, source: str, target: str, work) -> DataFrame:
    """``df`` with the binary column ``target``: ``work()`` gives the function of a list of ``source``."""
    schema = T.StructType([*df.schema.fields, T.StructField(target, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = work()
        for b in batches:
            # runs of rows of about SEND_BYTES, one row at least
            ends = pc.cumulative_sum(pc.binary_length(b.column(source)).cast(pa.int64())).to_numpy(zero_copy_only=False)
            begun = 0
            while begun < b.num_rows:
                base = ends[begun - 1] if begun else 0
                rows = b.slice(begun, max(1, int(np.searchsorted(ends, base + SEND_BYTES, "right")) - begun))
                begun += rows.num_rows
                out = pa.array(one(rows.column(source).to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([*rows.columns, out], names=[*rows.schema.names, target])
    return in_arrow(df, run, schema)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids``: the ids of every whole text, packed as little-endian unsigned 32-bit integers."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return _mapped(rows, "text", "ids", lambda: _codec(path, pattern).encode).select("doc_id", "ids")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes its ``ids`` stand for."""
    return _mapped(encoded, "ids", "decoded", lambda: _codec(path, pattern).decode)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text, by way of its ids and back."""
    there = encode(docs, path, pattern).select(
        "doc_id", "ids", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"))
    return decode(there, path, pattern).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
