"""Token-ID output (operator 3): canonical length-limited Huffman files of token ids.

Documents are encoded once; the ids are kept packed, counted, put in ``doc_id`` order and
written as coded rows of about ``ROW_IDS`` ids.  The file format is a Parquet table, so
Spark's commit protocol covers lost tasks:

``part, seq``            order of the rows (ranges of ``doc_id``, then position in the range)
``doc_ids, doc_lens``    the documents of the row and their id counts
``n_ids``                all ids of the row
``checkpoints``          bit offset of every block of ``BLOCK_IDS`` ids
``payload``              the bit stream, most significant bit first

A second table holds the code book (``id, length``); codes are canonical, so lengths are
enough.  Blocks start at known bit offsets and decode independently, which the reader uses to
decode all blocks of a row in lockstep through one table of ``2 ** MAX_BITS`` entries.

Defined results: a null text encodes like an empty one (the end id alone); rows with equal
``doc_id`` are ordered by id count, then by a hash of their ids, null ids come last;
the strings of added tokens in a text get those tokens' ids, as the library gives them; an empty table gives empty files; extra
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import in_arrow, span_hashes, stored

ROW_IDS, BLOCK_IDS, MAX_BITS = 1 << 20, 1 << 10, 16
#: Distinct text pieces whose ids a worker remembers at most, characters encoded at a time, and
#: the places where a longer text may be cut: one blank between other characters than white space.
CACHE_PIECES, PART_CHARS = 1_000_000, 1 << 19
CUT = re.compile(r"(?<=\S) (?=\S)")
OTHER_SPACE = re.compile(r"[^\S \n]")
#: Pieces that are one word with the blank before it; they are encoded many at a time.
PLAIN = re.compile(r" [A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
JOINED = 50
_WORKER: dict = {}
_SEED = 3
_LETTER, _PUNCT, _SPACE = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PUNCT[[ord(c) for c in ".,;:!?*#$%&()"]] = True
_SPACE[[10, 32]] = True
_NOT_LATIN = np.ones(256, bool)
_NOT_LATIN[0x80:0xC0] = False
_NOT_LATIN[[0x97, 0xB7]] = True


def piece_starts(data: np.ndarray) -> np.ndarray:
    """Marks places where the byte-level splitter surely starts a new piece, in text whose only white
    space is blanks and line feeds: before a run of them, between a Latin letter and a
    punctuation mark, and between a lone line feed and a letter."""
    prev = np.r_[np.uint8(0), data[:-1]]
    before = np.r_[np.zeros(2, np.uint8), data[:-2]] if len(data) > 1 else np.zeros(len(data), np.uint8)
    space, after_space = _SPACE[data], _SPACE[prev]
    cut = space & ~after_space
    cut |= _PUNCT[data] & (_LETTER[prev] | ((before == 0xC3) & ~_NOT_LATIN[prev]))
    cut |= _LETTER[data] & (prev == 10) & ~_SPACE[before]
    return cut


class Encoder:
    """Ids of texts by the tokenizers library, asked once for each distinct piece.

    Pieces are told apart by 64-bit hashes of their bytes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        # the library finds these in the text before it splits; the longer one counts where two start
        added = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=lambda t: (-len(t), t))
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.tok.model._resize_cache(0)  # no piece is asked for twice
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self._forget()

    def _forget(self) -> None:
        self.keys, self.at = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.size = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        plain = [i for i, p in enumerate(pieces) if PLAIN.fullmatch(p)]
        known = set(plain)
        other = [i for i in range(len(pieces)) if i not in known]
        groups = [plain[i:i + JOINED] for i in range(0, len(plain), JOINED)]
        got = [np.empty(0, np.uint32)]
        sizes = []
        for group, e in zip(groups, self.tok.encode_batch_fast(["".join([pieces[i] for i in g]) for g in groups],
                                                              add_special_tokens=False), strict=True):
            got.append(np.array(e.ids, np.uint32))
            # a word's first id, and no other, holds its blank
            sizes.append(np.diff(np.r_[np.flatnonzero(self.opens[got[-1]]), len(got[-1])]))
            if len(sizes[-1]) != len(group):
                raise AssertionError("the splitter joined pieces")
        for e in self.tok.encode_batch_fast([pieces[i] for i in other], add_special_tokens=False):
            got.append(np.array(e.ids, np.uint32))
            sizes.append(np.array([len(got[-1])]))
        ids, size = np.concatenate(got), np.concatenate(sizes)
        n = len(self.keys)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + len(size) > len(self.size):
            self.start, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.size))
        self.flat[self.used:self.used + len(ids)] = ids
        self.size[n:n + len(size)] = size
        self.start[n:n + len(size)] = self.used + np.cumsum(size) - size
        self.used += len(ids)
        keys = np.concatenate([self.keys, keys[plain + other]])
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], np.concatenate([self.at, n + np.arange(len(size))])[order]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the id count of each text."""
        import pandas as pd
        if len(self.keys) > CACHE_PIECES:
            self._forget()
        # texts with other white space or an added token are left to the library
        whole = {i: np.array(self.tok.encode(t, add_special_tokens=False).ids, np.uint32)
                 for i, t in enumerate(texts) if OTHER_SPACE.search(t) or (self.added and self.added.search(t))}
        raw = [b"" if i in whole else t.encode("utf-8", "surrogatepass") for i, t in enumerate(texts)]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        first = np.cumsum(sizes) - sizes
        cut = piece_starts(data)
        cut[first[sizes > 0]] = True
        start = np.flatnonzero(cut)
        counts = np.searchsorted(start, first + sizes) - np.searchsorted(start, first)
        end = np.r_[start[1:], len(data)][:len(start)]
        code, keys = pd.factorize(span_hashes(data, start, end, _SEED), sort=True)
        near = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = self.keys[near] != keys if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            one = np.empty(len(keys), np.int64)
            one[code] = np.arange(len(code))
            at = one[new]
            blob = data.tobytes()
            self._learn(keys[new], [blob[a:z].decode("utf-8", "surrogatepass")
                                    for a, z in zip(start[at].tolist(), end[at].tolist(), strict=True)])
        place = self.at[np.searchsorted(self.keys, keys)]
        at = place[code]
        size = self.size[at]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
        lens = np.diff(bounds)
        if whole:
            parts = [whole.get(i, ids[bounds[i]:bounds[i + 1]]) for i in range(len(texts))]
            ids, lens = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, lens


def parts(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Runs of about ``PART_CHARS`` characters: the row each part belongs to, and the parts."""
    rows, held, size = [], [], 0
    for i, t in enumerate(texts):
        t, at = t or "", 0
        while True:
            cut = CUT.search(t, at + PART_CHARS) if len(t) - at > PART_CHARS else None
            end = cut.start() if cut else len(t)
            rows.append(i)
            held.append(t[at:end])
            size += end - at
            at = end
            if size >= PART_CHARS:
                yield rows, held
                rows, held, size = [], [], 0
            if at >= len(t):
                break
    if held:
        yield rows, held


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """``doc_id, n_tokens, tie, packed``: ids of every document, packed by zstd."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import zstandard
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = _WORKER.get(tokenizer) or _WORKER.setdefault(tokenizer, Encoder(tokenizer))
        zstd = zstandard.ZstdCompressor(level=1)
        for b in batches:
            held: dict[int, list[np.ndarray]] = {}
            done = 0

            def settle(upto: int) -> pa.RecordBatch:
                """Rows whose parts are all there."""
                packed, lens = [], []
                for i in range(done, upto):
                    ids = np.concatenate([*held.pop(i), np.array([end_id], np.uint32)])
                    wide = ids.max() >= 1 << 16
                    packed.append((b"4" if wide else b"2") + zstd.compress(ids.astype("<u4" if wide else "<u2").tobytes()))
                    lens.append(len(ids))
                return pa.RecordBatch.from_arrays(
                    [b.column(0).slice(done, upto - done), pa.array(lens, pa.int64()),
                     pa.array([zlib.crc32(p) for p in packed], pa.int64()), pa.array(packed, pa.binary())],
                    names=["doc_id", "n_tokens", "tie", "packed"])

            for rows, texts in parts(b.column(1).to_pylist()):
                if rows[0] > done:
                    yield settle(rows[0])
                    done = rows[0]
                ids, lens = enc.encode(texts)
                ends = np.cumsum(lens)
                for i, a, z in zip(rows, (ends - lens).tolist(), ends.tolist(), strict=True):
                    held.setdefault(i, []).append(ids[a:z].copy())
            if b.num_rows:
                yield settle(b.num_rows)

    ids = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(
        docs.select("doc_id", "text"), run, f"doc_id {ids}, n_tokens long, tie long, packed binary")


def unpack(packed: bytes, zstd) -> np.ndarray:
    return np.frombuffer(zstd.decompress(packed[1:]), "<u4" if packed[:1] == b"4" else "<u2").astype(np.uint32)


def id_counts(encoded: DataFrame) -> DataFrame:
    """``id, n`` over all documents; each task sends one row per id it has seen."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        zstd, total = zstandard.ZstdDecompressor(), np.zeros(0, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            got = np.bincount(np.concatenate([unpack(p, zstd) for p in b.column(0).to_pylist()]))
            if len(got) > len(total):
                got, total = total, got
            total[:len(got)] += got
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], names=["id", "n"])

    return in_arrow(encoded.select("packed"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``max_bits`` bits (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols don't fit codes of {max_bits} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    levels, merged = [], leaves
    flags = np.ones(n, bool)
    for _ in range(max_bits):
        levels.append(flags)
        pairs = merged[:len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        merged, flags = both[by], by < n
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(levels):
        own = int(flags[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Book:
    """Canonical codes: shorter first, equal lengths by id."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.uint32), lengths[order].astype(np.int64)
        self.bits = int(self.lengths.max(initial=1))
        steps = np.left_shift(1, self.bits - self.lengths)
        first = np.cumsum(steps) - steps
        self.codes = first >> (self.bits - self.lengths)
        size = int(self.ids.max(initial=0)) + 1
        self.code_of, self.len_of = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code_of[self.ids], self.len_of[self.ids] = self.codes, self.lengths
        self.sym = np.zeros(1 << self.bits, np.uint32)
        self.step = np.ones(1 << self.bits, np.int64)
        used = int(steps.sum())
        self.sym[:used], self.step[:used] = np.repeat(self.ids, steps), np.repeat(self.lengths, steps)

    def encode(self, ids: np.ndarray, block: int = BLOCK_IDS) -> tuple[bytes, np.ndarray]:
        lens = self.len_of[ids]
        ends = np.cumsum(lens)
        at = ends - lens
        word = at >> 5
        value = self.code_of[ids] << (64 - (at & 31) - lens).astype(np.uint64)
        n = int(ends[-1] + 31 >> 5) + 1 if len(ids) else 0
        out = np.bincount(word, weights=(value >> np.uint64(32)).astype(np.float64), minlength=n + 1)
        out[1:] += np.bincount(word, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)[:n]
        return out[:n].astype(">u4").tobytes(), at[::block]

    def decode(self, payload: bytes, checkpoints: np.ndarray, n_ids: int, block: int = BLOCK_IDS) -> np.ndarray:
        raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        pos, last = checkpoints.astype(np.int64), len(payload)
        out = np.empty((block, len(pos)), np.uint32)
        shift, mask = 32 - self.bits, (1 << self.bits) - 1
        for t in range(min(block, n_ids)):
            key = (window[np.minimum(pos >> 3, last)] >> (shift - (pos & 7)).astype(np.uint32)) & np.uint32(mask)
            out[t] = self.sym[key]
            pos += self.step[key]
        return out.T.ravel()[:n_ids]


def write_coded(encoded: DataFrame, path: str, max_bits: int = MAX_BITS, row_ids: int = ROW_IDS) -> None:
    """Write ``encoded`` in ``doc_id`` order below ``path`` (``/book`` and ``/rows``)."""
    spark = encoded.sparkSession
    # at most one row per id of the vocabulary
    rows = sorted((r["id"], r["n"]) for r in id_counts(encoded).collect())
    ids, counts = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    bits = max(max_bits, (max(2, len(ids)) - 1).bit_length())
    if bits > 24:
        raise ValueError("the decoding window holds codes of at most 24 bits")
    lengths = code_lengths(counts, bits)
    spark.createDataFrame([(int(a), int(b)) for a, b in zip(ids, lengths, strict=True)],
                          "id long, length int").coalesce(1).write.parquet(f"{path}/book")
    shared = spark.sparkContext.broadcast((ids, lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        zstd, book = zstandard.ZstdDecompressor(), None
        held_ids, held_docs, held_lens, size, seq = [], [], [], 0, 0

        def out(part):
            ids = np.concatenate(held_ids)
            payload, points = book.encode(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([held_docs], pa.list_(pa.int64())),
                 pa.array([held_lens], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()),
                 pa.array([points.tolist()], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                names=["part", "seq", "doc_ids", "doc_lens", "n_ids", "checkpoints", "payload"])

        part = None
        for b in batches:
            book = book or Book(*shared.value)
            parts = b.column(2).to_numpy()
            for i, (doc, packed) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                ids = unpack(packed, zstd)
                held_ids.append(ids)
                held_docs.append(doc)
                held_lens.append(len(ids))
                size, part = size + len(ids), int(parts[i])
                if size >= row_ids:
                    yield out(part)
                    held_ids, held_docs, held_lens, size, seq = [], [], [], 0, seq + 1
        if held_ids:
            yield out(part)

    order = [F.col("doc_id").asc_nulls_last(), F.col("n_tokens"), F.col("tie")]
    (encoded.repartitionByRange(*order).sortWithinPartitions(*order)
     .select(F.col("doc_id").cast("long"), "packed", F.spark_partition_id().alias("part"))
     .mapInArrow(run, "part int, seq long, doc_ids array<long>, doc_lens array<long>, n_ids long, "
                      "checkpoints array<long>, payload binary")
     .write.option("compression", "none").parquet(f"{path}/rows"))


def read_coded(spark: SparkSession, path: str) -> DataFrame:
    """``part, seq, place, doc_id, ids`` decoded from the files, a row per document."""
    return _decoded(spark, path, "ids array<long>", lambda ids: ids.tolist(), pa.list_(pa.int64()))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` decoded from the files."""
    got = _decoded(spark, path, "n_tokens long, ids_crc32 long", None, None)
    rows = spark.read.parquet(f"{path}/rows").select("part", "seq", "n_ids")
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    per = rows.groupBy("part").agg(F.sum("n_ids").alias("all"))
    parts = per.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("off"))
    starts = (rows.withColumn("inside", inside).join(parts, "part")
              .select("part", "seq", (F.col("off") + F.col("inside")).alias("row_start")))
    return (got.join(starts, ["part", "seq"])
            .select("doc_id", (F.col("row_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"))


def _decoded(spark: SparkSession, path: str, columns: str, value, kind) -> DataFrame:
    rows = spark.read.parquet(f"{path}/rows")
    book_rows = spark.read.parquet(f"{path}/book").collect()  # at most one row per id of the vocabulary
    shared = spark.sparkContext.broadcast((np.array([r["id"] for r in book_rows], np.int64),
                                           np.array([r["length"] for r in book_rows], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = None
        for b in batches:
            for i in range(b.num_rows):
                book = book or Book(*shared.value)
                r = {n: b.column(k)[i] for k, n in enumerate(b.schema.names)}
                lens = r["doc_lens"].values.to_numpy()
                ids = book.decode(r["payload"].as_py(), r["checkpoints"].values.to_numpy(), r["n_ids"].as_py())
                cut = np.r_[0, np.cumsum(lens)]
                own = [ids[a:z] for a, z in zip(cut[:-1], cut[1:], strict=True)]
                if value is None:
                    last = [pa.array(lens), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64())]
                else:
                    last = [pa.array([value(x) for x in own], kind)]
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["part"].as_py()] * n, pa.int32()), pa.array([r["seq"].as_py()] * n, pa.int64()),
                     pa.array(cut[:-1]), r["doc_ids"].values, *last],
                    names=["part", "seq", "before", "doc_id", *(c.split()[0] for c in columns.split(", "))])

    return (rows.select("part", "seq", "doc_ids", "doc_lens", "n_ids", "checkpoints", "payload")
            .mapInArrow(run, f"part int, seq long, before long, doc_id long, {columns}"))


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Encode, write the coded files, read them back: the digest of every document."""
    spark = docs.sparkSession
    encoded = stored(encode_documents(docs, tokenizer, end_id), "token-ids")
    path = scratch_path(spark, "token-files")
    write_coded(encoded, path)
    return read_digests(spark, path)
