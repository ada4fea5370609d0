"""LM scoring (operator 10): word counts for the base score, online logistic context mixing for the model.

The model spells a text's UTF-8 bytes and an end symbol as bits along Huffman trees of the
training bytes, one per preceding byte.  For every bit, predictors of several context lengths look up counts in
hashed tables trained on all training documents; their stretched probabilities are combined
by a weight vector that a gate (how well the longer contexts are known) selects.  Every text
starts from trained vectors, a logistic regression over all bits of all training documents: these
fall into two folds by crc32 of the id, each is predicted by tables of the other, and the bits are
counted by gate and predictions.  The selected vector and a final probability map are refined
after every bit, from the first to the last bit of the text.  numpy runs many texts in
lockstep, each lane one text after the other; the last few of a run, which have no company, take a plain loop.

Word counts are 64-bit hashes of whole words counted over the corpus.  Words that hold a
millionth of all words or more (hence at most a million) are broadcast; all others meet
their counts in a join, where no word's group can be larger than that share.

Defined results: a null text scores like an empty one (the end token alone); a null
``doc_id`` counts as training (crc32 of the empty text is 0, remainder 0: held out); repeated
rows score alike and count each time; an empty table gives an empty result; extra columns
are ignored; words and tables read texts of over ``PIECE_BYTES`` bytes in pieces cut at white
space, the model scores them whole.
"""

from __future__ import annotations

import heapq
import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, span_hashes, stored
from .token_codec import code_lengths

HELD_OUT = 10
#: Share of all words from which a word's count is broadcast; at most ``1 / HEAVY`` words have it.
HEAVY = 1e-6
#: Context lengths in bytes and the bits of their tables; the first is indexed directly.
ORDERS = ((1, 17), (3, 20), (5, 21))
END, CODE_BITS = 256, 15
CHUNK = 1 << 16
SLICE_BYTES, MODEL_BYTES, PIECE_BYTES = 1 << 16, 1 << 20, 1 << 22
#: Bits of one gathering of a lane, bytes of all lanes of a round, and bytes of texts that run together.
BLOCK, ROUND_BYTES, RUN_BYTES = 32, 1 << 20, 1 << 25
#: So many lanes at most run side by side, and so few take the plain loop.
LANES, FEW = 512, 12
#: Slots (as bits) for symbols whose inputs are kept, and the number of inputs that are.
KEPT_SLOTS, KEPT_INPUTS = 21, 1 << 23
RATE, MAP_RATE, GATES = 0.015, 0.02, 16
#: Log odds from -8 to 8 in steps of 1 / ``UNIT``: their probabilities, these times the ``STEP`` of a weight,
#: and their cells of the final map, ``MAP_STEP`` steps each.
UNIT, MAP_STEP = 1024, 512
TOP, STEP = 8 * UNIT, RATE * UNIT
MAP_SIZE = 2 * TOP // MAP_STEP + 1
SQUASH = 1 / (1 + np.exp(-np.arange(-TOP, TOP + 1) / UNIT))
PULL = SQUASH * STEP
CELL = (np.arange(2 * TOP + 1) + MAP_STEP // 2) // MAP_STEP
#: Logarithms are added as multiples of ``1 / LOG_UNIT``.
LOG_UNIT = float(1 << 30)
#: The first weights are fitted to counts of bits by gate and ``LEVELS`` levels of each prediction, ``LEVEL`` log odds apart.
LEVELS, LEVEL = 32, 0.5
FIRST_WEIGHTS = (0.25, 0.35, 0.45)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SEED, _LOWER = 20, np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]  # A-Z count as a-z
END_WORD = 0
SCALE = 2000.0


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a byte array and their starts; A-Z count as a-z."""
    gap = np.concatenate([[True], _SPACE[data], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    h = span_hashes(_LOWER[data], start, end, _SEED)
    h[h == END_WORD] = 1
    return h, start


def slices(texts: list[str | None], size_bytes: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, piece starts, owning row and whether a text ends there, about ``size_bytes`` (by
    default ``SLICE_BYTES``) at a time.

    Pieces are joined with a line feed, which belongs to no piece.
    """
    held, owner, last, size = [], [], [], 0

    def out():
        lens = np.fromiter(map(len, held), np.int64, len(held))
        starts = np.cumsum(lens + 1) - lens - 1
        return np.frombuffer(b"\n".join(held) + b"\n", np.uint8), starts, np.array(owner), np.array(last)

    for i, t in enumerate(texts):
        raw = t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass")
        at = 0
        while True:
            cut = len(raw)
            if cut - at > PIECE_BYTES:
                tail = np.flatnonzero(_SPACE[np.frombuffer(raw, np.uint8)[at + PIECE_BYTES // 2:]])
                cut = at + PIECE_BYTES // 2 + int(tail[0]) if len(tail) else len(raw)
            held.append(raw[at:cut])
            owner.append(i)
            last.append(cut == len(raw))
            size += cut - at
            at = cut
            if size >= (size_bytes or SLICE_BYTES):
                yield out()
                held, owner, last, size = [], [], [], 0
            if at >= len(raw):
                break
    if held:
        yield out()


# --- word counts --------------------------------------------------------------------------

def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    import pandas as pd
    place, kinds = pd.factorize(np.concatenate([p[0] for p in parts]))
    return (kinds, *(np.bincount(place, weights=np.concatenate([p[k] for p in parts]), minlength=len(kinds)).astype(np.int64)
                     for k in (1, 2)))


class Known:
    """Places of hashes in a sorted array, found through their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, keys[-1:] if len(keys) else np.uint64(0))
        self.shift = np.uint64(64 - min(22, max(4, len(keys).bit_length() + 3)))
        first = np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift
        self.start = np.append(np.searchsorted(keys, first), len(keys))
        self.n = len(keys)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 for unknown ones."""
        lead = (h >> self.shift).astype(np.int64)
        at = self.start.take(lead)
        out = np.where((self.keys.take(at) == h) & (at < self.n), at, -1)
        left = np.flatnonzero((out < 0) & (self.start.take(lead + 1) - at > 1))
        step = 1
        while len(left):
            p = at[left] + step
            hit = self.keys[p] == h[left]
            out[left[hit]] = p[hit]
            left = left[~hit]
            step += 1
            left = left[self.start[lead[left] + 1] - at[left] > step]
        return out


def spelled_pairs(data: np.ndarray, starts: np.ndarray, last: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """``257 * symbol before + symbol`` of every symbol of the ``taken`` pieces; ``END`` stands before the first."""
    sizes = np.diff(np.r_[starts, len(data)])
    sym, ends = data.astype(np.int64), starts + sizes - 1
    sym[ends] = END
    pair = sym.copy()
    pair[1:] += 257 * sym[:-1]
    pair[starts] = sym[starts] + 257 * END
    use = np.repeat(taken, sizes)
    use[ends[~last]] = False
    return pair[use]


def count_words(docs: DataFrame) -> DataFrame:
    """``kind, h, trained, seen``: words (kind 0) in training texts and in all, and pairs of neighbouring
    symbols (kind 1, at most 257 times 257) in training texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        spelled = np.zeros(257 * 257, np.int64)

        def out(kind, h, trained, seen):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(h), kind, np.int8)), pa.array(h.view(np.int64)), pa.array(trained), pa.array(seen)],
                names=["kind", "h", "trained", "seen"])

        for b in batches:
            train = ~b.column(1).to_numpy(zero_copy_only=False)
            for data, starts, owner, last in slices(b.column(0).to_pylist()):
                h, at = word_hashes(data)
                mine = train[owner][np.searchsorted(starts, at, "right") - 1]
                ends = train[owner[last]]
                h = np.concatenate([h, np.full(len(ends), END_WORD, np.uint64)])
                mine = np.concatenate([mine, ends])
                held.append(_merged([(h, mine, np.ones(len(h), np.int64))]))
                rows += len(held[-1][0])
                spelled += np.bincount(spelled_pairs(data, starts, last, train[owner]), minlength=257 * 257)
                if rows > 4_000_000:
                    held = [_merged(held)]
                    rows = len(held[0][0])
                    if rows > 3_000_000:
                        yield out(0, *held[0])
                        held, rows = [], 0
        if held:
            yield out(0, *_merged(held))
        used = np.flatnonzero(spelled)
        yield out(1, used.astype(np.uint64), spelled[used], spelled[used])

    counted = _input(docs).select("text", "held_out").mapInArrow(run, "kind byte, h long, trained long, seen long")
    return counted.groupBy("kind", "h").agg(F.sum("trained").alias("trained"), F.sum("seen").alias("seen"))


def _input(docs: DataFrame) -> DataFrame:
    """Ids and UTF-8 texts: tasks work on bytes alone."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), (crc_remainder("doc_id", HELD_OUT) == 0).alias("held_out"))


# --- bits and contexts --------------------------------------------------------------------

class Spelling:
    """Bits of the 257 symbols along the Huffman tree of the symbol before, as ``2 * node + bit`` per place.

    A symbol and the bytes before it, as far as any context reaches, make one number of 9 bits
    a byte.  Texts repeat most of these, so bits and table places are worked out once per
    distinct number.
    """

    def __init__(self, counts: np.ndarray):
        """``counts``: of each symbol after each symbol (``END``: the first ones), or one row for all."""
        counts = np.atleast_2d(counts).astype(np.float64)
        weights = counts + 8 * (counts.sum(axis=0) + 1) / (counts.sum() + 257)
        self.tree = np.minimum(np.arange(512), END) if len(counts) > 1 else np.zeros(512, np.int64)
        self.lens = np.stack([code_lengths(w, CODE_BITS) for w in weights])
        self.steps = np.zeros((len(counts), 257, CODE_BITS), np.uint16)
        for lens, steps in zip(self.lens.tolist(), self.steps, strict=True):
            code, nodes, before = 0, {}, 0
            for s in sorted(range(257), key=lens.__getitem__):
                code <<= lens[s] - before
                before = lens[s]
                steps[s, :before] = [2 * nodes.setdefault((j, code >> (before - j)), len(nodes))
                                     + (code >> (before - j - 1) & 1) for j in range(before)]
                code += 1
        self.steps = self.steps.ravel()

    def keys(self, data: np.ndarray, starts: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of every symbol (a cut piece has no end symbol), and the symbols of each piece."""
        sizes = np.diff(np.r_[starts, len(data)])
        sym = data.astype(np.uint64)
        ends = starts + sizes - 1
        sym[ends] = END
        key, reach, held = sym, ORDERS[-1][0], 1
        while held <= reach:  # twice as many symbols each time
            more = min(held, reach + 1 - held)
            longer = key.copy()
            longer[held:] |= (key[:-held] & np.uint64((1 << 9 * more) - 1)) << np.uint64(9 * held)
            key, held = longer, held + more
        for j in range(reach):  # nothing reaches before a piece
            first = starts[sizes > j] + j
            own = (1 << 9 * (j + 1)) - 1
            key[first] = (key[first] & np.uint64(own)) | np.uint64((1 << 9 * (reach + 1)) - 1 - own)
        return (key if last.all() else np.delete(key, ends[~last])), sizes - ~last

    def distinct(self, keys: np.ndarray):
        """Of distinct numbers: their code lengths, and per bit the step, the table index for each
        context and the number it belongs to."""
        sym = (keys & np.uint64(511)).astype(np.int64)
        sym += 257 * self.tree[((keys >> np.uint64(9)) & np.uint64(511)).astype(np.int64)]
        lens = self.lens.ravel()[sym]
        cut = np.cumsum(lens)
        at = np.repeat(np.arange(len(keys)), lens)
        step = self.steps[np.repeat(sym * CODE_BITS - (cut - lens), lens) + np.arange(len(at))]
        node = (step >> np.uint16(1)).astype(np.uint32)
        spread, index = node * np.uint32(0x9E3779B1), []
        for order, bits in ORDERS:
            context = (keys >> np.uint64(9)) & np.uint64((1 << 9 * order) - 1)
            if order == 1:
                index.append((context.astype(np.uint32) << np.uint32(8))[at] + node)
                continue
            h = (context * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            x = (h.astype(np.uint32)[at] ^ spread) * np.uint32(0x27D4EB2F)
            index.append(x >> np.uint32(32 - bits))
        return lens, step, index, at


def distinct_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)])
    return keys[first], np.diff(np.append(first, len(keys)))


def count_keys(train: DataFrame, spelling) -> DataFrame:
    """``second, key, n``: the numbers of the training documents' symbols (``Spelling.keys``) by fold, counted
    task by task; a number may have several rows."""
    fold = np.uint64(1 << 9 * (ORDERS[-1][0] + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, held, rows = spelling.value, [], 0

        def merged():
            keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
            by = np.argsort(keys)
            keys, n = keys[by], n[by]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[first], np.add.reduceat(n, first)

        def out(keys, n):
            return pa.RecordBatch.from_arrays([pa.array(keys >= fold), pa.array((keys & (fold - np.uint64(1))).view(np.int64)), pa.array(n)],
                                              names=["second", "key", "n"])

        for b in batches:
            second = b.column(1).to_numpy(zero_copy_only=False)
            for data, starts, owner, last in slices(b.column(0).to_pylist(), MODEL_BYTES):
                keys, sizes = s.keys(data, starts, last)
                keys[np.repeat(second[owner], sizes)] |= fold
                held.append(distinct_counts(keys))
                rows += len(held[-1][0])
                if rows > 2_000_000:
                    held = [merged()]
                    rows = len(held[0][0])
                    if rows > 1_500_000:
                        yield out(*held[0])
                        held, rows = [], 0
        if held:
            yield out(*merged())

    return train.select("text", "second").mapInArrow(run, "second boolean, key long, n long")


def count_bits(train: DataFrame, spelling, raw: bool = False) -> DataFrame:
    """``chunk, table``: the training documents' bits counted in all tables end to end, ``stretched`` or
    as the 64-bit counts themselves (``raw``)."""
    return count_key_bits(count_keys(train.select("text", F.lit(False).alias("second")), spelling), spelling, 1, raw)


def count_key_bits(keys: DataFrame, spelling, folds: int = 2, raw: bool = True) -> DataFrame:
    """``count_bits`` of counted numbers, the tables of one fold after those of the other."""
    sizes = [2 << bits for _, bits in ORDERS]
    offsets = np.cumsum([0, *sizes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, flat = spelling.value, np.zeros((folds, offsets[-1]), np.uint32)
        for b in batches:
            second, key, n = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for fold in range(folds):
                mine = second == bool(fold)
                _, step, index, at = s.distinct(key[mine].view(np.uint64))
                weight = n[mine].astype(np.uint32)[at]
                bit = (step & np.uint16(1)).astype(np.uint32)
                for t, x in zip(np.split(flat[fold], offsets[1:-1]), index, strict=True):
                    np.add.at(t, (x << np.uint32(1)) | bit, weight)
        yield _packed(flat.ravel())

    assert all(n % CHUNK == 0 for n in offsets)
    return _summed_chunks(keys.select("second", "key", "n").mapInArrow(run, "chunk int, packed binary"), raw)


def _packed(flat: np.ndarray) -> pa.RecordBatch:
    """``chunk, packed``: the chunks of an array of counts that have any."""
    import zstandard
    zstd = zstandard.ZstdCompressor(level=3)
    used = [i for i in range(0, len(flat), CHUNK) if flat[i:i + CHUNK].any()]
    return pa.RecordBatch.from_arrays(
        [pa.array([i // CHUNK for i in used], pa.int32()),
         pa.array([zstd.compress(flat[i:i + CHUNK].astype("<u4").tobytes()) for i in used], pa.binary())],
        names=["chunk", "packed"])


def _summed_chunks(chunks: DataFrame, raw: bool) -> DataFrame:
    """``chunk, table``: the sums of packed chunks, ``stretched`` or as 64-bit counts (``raw``)."""
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        zstd, held, total = zstandard.ZstdDecompressor(), None, None

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([held], pa.int32()), pa.array([(total if raw else stretched(total)).tobytes()], pa.binary())], names=["chunk", "table"])

        for b in batches:
            for chunk, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got = np.frombuffer(zstd.decompress(packed), "<u4").astype(np.int64)
                if chunk != held:
                    if held is not None:
                        yield out()
                    held, total = chunk, got
                else:
                    total = total + got
        if held is not None:
            yield out()

    return chunks.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(summed, "chunk int, table binary")


def _whole(chunks: DataFrame, size: int) -> np.ndarray:
    """The array of 64-bit counts, of fixed size, whose summed chunks are given."""
    flat = np.zeros(size, np.int64)
    for r in chunks.toLocalIterator():
        part = np.frombuffer(r["table"], np.int64)
        flat[r["chunk"] * CHUNK:r["chunk"] * CHUNK + len(part)] = part
    return flat


def stretched(counts: np.ndarray) -> np.ndarray:
    """Log odds of a one times ``SCALE`` as 16-bit integers; the low two bits say how often the
    context was seen."""
    n = counts.reshape(-1, 2).astype(np.float64)
    odds = np.log((n[:, 1] + 0.4) / (n[:, 0] + 0.4)).clip(-12, 12) * SCALE
    known = np.digitize(n.sum(axis=1), (1, 4, 30))
    return (odds.astype(np.int16) & ~np.int16(3)) | known.astype(np.int16)


# --- mixing -------------------------------------------------------------------------------

def _log_units(chance: np.ndarray, final: np.ndarray, bits: np.ndarray, ends=()) -> np.ndarray:
    """Of each column the sum of its bits' log probabilities in whole ``1 / LOG_UNIT``s, of the mixed ``chance``
    (times ``STEP``) and the map's ``final``; of the columns in ``ends`` (column, text, count) the first bits count.

    Logarithms of 32-bit numbers are off by some 1e-7 a bit."""
    p = chance * (0.6 / STEP)
    p += final * 0.4
    p -= 1
    p += bits
    p = np.abs(p, out=p).astype(np.float32)
    for i, _, valid in ends:
        p[valid:, i] = 1
    np.log(p, out=p)
    p *= np.float32(LOG_UNIT)
    # whole numbers far below 2 ** 53
    return np.rint(p, out=p).astype(np.float64).sum(axis=0).astype(np.int64)


class Kept:
    """Inputs of symbols met before, by the symbol's number; when there are too many, it starts anew.

    A number lies in one of two slots or, if both are taken, is worked out again."""

    EMPTY = np.uint64((1 << 64) - 1)
    FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))

    def __init__(self):
        self.key = np.full(1 << KEPT_SLOTS, self.EMPTY)
        self.code = np.zeros(1 << KEPT_SLOTS, np.int32)
        self.words, self.n = np.empty(1 << 16, np.uint64), 0

    def _slot(self, key: np.ndarray, k: int) -> np.ndarray:
        return ((key * self.FACTORS[k]) >> np.uint64(64 - KEPT_SLOTS)).view(np.int64)

    def codes(self, key: np.ndarray, inputs) -> np.ndarray:
        """``16 * place + size`` of each number's ``words``; of new numbers, ``inputs`` gives words and sizes."""
        import pandas as pd
        if self.n > KEPT_INPUTS:
            self.key[:] = self.EMPTY
            self.n = 0
        slot = self._slot(key, 0)
        out = self.code.take(slot)
        left = np.flatnonzero(self.key.take(slot) != key)
        if len(left):
            slot = self._slot(key[left], 1)
            out[left] = self.code[slot]
            left = left[self.key[slot] != key[left]]
        if len(left):
            code, new = pd.factorize(key[left])
            words, sizes = inputs(new)
            while self.n + len(words) > len(self.words):
                self.words = np.concatenate([self.words, np.empty_like(self.words)])
            self.words[self.n:self.n + len(words)] = words
            mine = ((self.n + np.cumsum(sizes) - sizes) * 16 + sizes).astype(np.int32)
            self.n += len(words)
            out[left] = mine[code]
            for k in range(2):
                slot = self._slot(new, k)
                free = self.key[slot] == self.EMPTY
                self.key[slot[free]] = new[free]
                held = self.key[slot] == new
                self.code[slot[held]] = mine[held]
                new, mine = new[~held], mine[~held]
        return out


class _Lane:
    """Texts that run one after the other, and the words (``Mixer.inputs``) that wait to be run."""

    def __init__(self):
        self.texts, self.at = deque(), 0
        self.parts: list[list] = []  # text, words, whether it ends there

    def add(self, text: int, words: np.ndarray, end: bool) -> None:
        if self.parts and not self.parts[-1][2]:
            words = np.concatenate([self.parts.pop()[1], words])
        self.parts.append([text, words, end])

    def goes_on(self) -> bool:
        """Whether words will follow."""
        return bool(self.texts)

    def bits(self) -> int:
        return sum(len(words) for _, words, _ in self.parts)

    def blocks(self) -> int:
        """A text's last block is filled up."""
        return sum(-(-len(words) // BLOCK) if end else len(words) // BLOCK for _, words, end in self.parts)

    def all(self) -> list[list]:
        parts, self.parts = self.parts, []
        return parts

    def take(self, n: int, j: int, ends: dict) -> np.ndarray:
        """The words of the next ``n`` blocks, filled up with zeros; lane ``j`` is entered in ``ends`` at the blocks where texts end."""
        out, b = [], 0
        while b < n and self.parts:
            text, words, end = self.parts[0]
            most = -(-len(words) // BLOCK) if end else len(words) // BLOCK
            if b + most > n or not end:
                k = min(n - b, most)
                out.append(words[:k * BLOCK])
                self.parts[0][1] = words[k * BLOCK:].copy()
                break
            b += most
            out += [words, np.zeros(most * BLOCK - len(words), np.uint64)]
            ends.setdefault(b - 1, []).append((j, text, len(words) - (most - 1) * BLOCK))
            self.parts.pop(0)
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Mixer:
    """Trained tables and first weights; ``log10_probabilities`` runs the online part.

    Each lane, a text at a time, holds a weight vector per gate; the gate of a bit tells how often the two
    longer contexts were seen.
    """

    def __init__(self, spelling: Spelling, tables: list[np.ndarray]):
        self.spelling, self.tables = spelling, tables
        self.weights = np.tile(np.array(FIRST_WEIGHTS), (GATES, 1))
        self.kept = None

    def __getstate__(self):
        return self.__dict__ | {"kept": None}

    def _distinct_inputs(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs of each number's bits, and their count."""
        lens, step, index, _ = self.spelling.distinct(keys)
        x = np.empty((len(step), 4), np.int16)
        for k, (t, i) in enumerate(zip(self.tables, index, strict=True)):
            x[:, k] = t[i]
        x[:, 3] = (((x[:, 2] & 3) << 2) | (x[:, 1] & 3)) << 1 | (step & np.uint16(1)).astype(np.int16)
        return x.view(np.uint64)[:, 0], lens

    def inputs(self, data, starts, last, skip=None):
        """Per bit the predictions of the tables and ``2 * gate + bit`` as four 16-bit numbers in one
        64-bit value; and each piece's bit count.  The first ``skip`` symbols of a piece are only
        context."""
        key, sizes = self.spelling.keys(data, starts, last)
        if skip is not None:
            begin = np.cumsum(sizes) - sizes
            key = np.delete(key, np.repeat(begin - (np.cumsum(skip) - skip), skip) + np.arange(skip.sum()))
            sizes = sizes - skip
        if self.kept is None:
            self.kept = Kept()
        code = self.kept.codes(key, self._distinct_inputs)
        size = code & 15
        code >>= 4
        cut = np.cumsum(size, dtype=np.int64)
        # places follow each other within a symbol and jump between symbols
        place = np.ones(int(cut[-1]) if len(cut) else 0, np.int32)
        code[1:] -= code[:-1] + size[:-1] - 1
        place[(cut - size)] = code
        np.cumsum(place, out=place)
        ends = np.r_[0, cut][np.cumsum(sizes)]
        return self.kept.words.take(place), np.diff(np.r_[0, ends])

    def count_gates(self, data: np.ndarray, starts: np.ndarray, last: np.ndarray, counts: np.ndarray) -> None:
        """Adds the bits to ``counts`` by gate, levels of the three predictions and the bit itself."""
        self.count_key_gates(*distinct_counts(self.spelling.keys(data, starts, last)[0]), counts)

    def count_key_gates(self, keys: np.ndarray, n: np.ndarray, counts: np.ndarray) -> None:
        """``count_gates`` for distinct numbers that occur ``n`` times."""
        _, step, index, at = self.spelling.distinct(keys)
        x = [t[i] for t, i in zip(self.tables, index, strict=True)]
        cell = (((x[2] & 3) << 2) | (x[1] & 3)).astype(np.int64)
        for f in x:
            cell *= LEVELS
            cell += np.clip(f // int(LEVEL * SCALE) + LEVELS // 2, 0, LEVELS - 1)
        cell *= 2
        cell += step & np.uint16(1)
        np.add.at(counts, cell, n[at])

    def fit_gates(self, texts: list[str | bytes]) -> None:
        """First weights of whole texts, by these tables."""
        counts = np.zeros(GATES * 2 * LEVELS ** 3, np.int64)
        for data, starts, _, last in slices(texts, MODEL_BYTES):
            self.count_gates(data, starts, last, counts)
        self.weights = gate_weights(counts)

    def run(self, words: np.ndarray, pos: np.ndarray, active: list[int], ends: dict[int, list[tuple[int, int, int]]],
            state: tuple[np.ndarray, ...], total: np.ndarray) -> None:
        """Runs blocks of bits; of block b the first ``active[b]`` lanes, each from its ``pos`` on.

        ``state`` has the lanes' weights by table and gate, their maps and the log probability (natural, times
        ``LOG_UNIT``) of their texts so far; it is refined in place.  ``ends`` of a block tells lanes, texts that end there
        and how many bits they have in it: their log probability goes to ``total`` and the lane starts anew.
        Sums, products and table places of 64-bit numbers are the same in any company and the logarithms are
        added as integers, so a text's score doesn't depend on the texts beside it."""
        weights, refined = state[0].reshape(3, -1), state[1].reshape(-1)
        w0, w1, w2 = weights
        lane_gate, lane_map = np.arange(len(pos)) * GATES, np.arange(len(pos)) * MAP_SIZE
        a = 0
        for b, a0 in enumerate(active):
            if a0 != a:
                a = a0
                # constants as arrays, which numpy takes faster than numbers
                middle, kept = np.full(a, TOP + 0.5), np.full(a, 1 - MAP_RATE)
                w, x, dot, err, r = np.empty((3, a)), np.empty((3, a)), np.empty(a), np.empty(a), np.empty(a)
                x0, x1, x2 = x
                v0, v1, v2 = w
                chance, final, inputs = np.empty((BLOCK, a)), np.empty((BLOCK, a)), np.empty((BLOCK, 3, a))
                where, dots = pos[:a] + (b * BLOCK + np.arange(BLOCK)[:, None]), np.empty((BLOCK, a), np.int64)
            block = words.take(where, mode="clip").view(np.int16).reshape(BLOCK, a, 4)
            where += BLOCK
            tag = block[:, :, 3]
            bits = (tag & np.int16(1)).astype(np.float64)
            for k in range(3):
                np.multiply(block[:, :, k], 1 / SCALE, out=inputs[:, k])
            for f, at, pulled, place, p in zip(inputs, (tag >> np.int16(1)) + lane_gate[:a], bits * STEP, dots, chance, strict=True):
                weights.take(at, axis=1, out=w, mode="clip")
                np.multiply(w, f, out=x)
                np.add(x0, x2, out=dot)
                np.add(dot, x1, out=dot)
                np.add(dot, middle, out=dot)
                np.copyto(place, dot, casting="unsafe")
                PULL.take(place, out=p, mode="clip")
                np.subtract(pulled, p, out=err)
                np.multiply(f, err, out=x)
                np.add(w, x, out=w)
                w0[at], w1[at], w2[at] = v0, v1, v2
            cells = CELL.take(dots, mode="clip")
            cells += lane_map[:a]
            for cell, mapped, q in zip(cells, bits * MAP_RATE, final, strict=True):
                refined.take(cell, out=q, mode="clip")
                np.multiply(q, kept, out=r)
                np.add(r, mapped, out=r)
                refined[cell] = r
            done = ends.get(b, ())
            state[2][:a] += _log_units(chance, final, bits, done)
            for i, text, _ in done:
                self._finish(i, text, state, total)

    def _finish(self, i: int, text: int, state: tuple[np.ndarray, ...], total: np.ndarray) -> None:
        """The lane's text is scored; the next one starts from the first weights."""
        total[text] = state[2][i]
        state[0][:, i], state[1][i], state[2][i] = self.weights.T * UNIT, SQUASH[::MAP_STEP], 0

    def _alone(self, words: np.ndarray, weights: np.ndarray, refined: np.ndarray) -> int:
        """``run`` for one lane, bit after bit; gives the log probability."""
        (w0, w1, w2), cells = weights.tolist(), refined.tolist()
        pull, cell_of, middle, kept, last, total = PULL.tolist(), CELL.tolist(), TOP + 0.5, 1 - MAP_RATE, 2 * TOP, 0
        for begin in range(0, len(words), CHUNK):
            rows = words[begin:begin + CHUNK].view(np.int16).reshape(-1, 4)
            bits = rows[:, 3] & np.int16(1)
            scaled = (rows[:, :3] * (1 / SCALE)).T.tolist()
            chance, final = [], []
            for f0, f1, f2, g, bit in zip(*scaled, (rows[:, 3] >> np.int16(1)).tolist(), bits.tolist(), strict=True):
                dot = w0[g] * f0 + w2[g] * f2 + w1[g] * f1 + middle
                place = 0 if dot < 0 else last if dot > last else int(dot)
                p = pull[place]
                err = bit * STEP - p
                w0[g] += f0 * err
                w1[g] += f1 * err
                w2[g] += f2 * err
                cell = cell_of[place]
                r = cells[cell]
                cells[cell] = r * kept + bit * MAP_RATE
                chance.append(p)
                final.append(r)
            total += int(_log_units(np.array(chance)[:, None], np.array(final)[:, None], bits[:, None].astype(np.float64))[0])
        weights[:] = w0, w1, w2
        refined[:] = cells
        return total

    def _scored(self, texts: list[str | bytes | None]) -> np.ndarray:
        """Log probabilities (natural) of whole texts.

        The longest texts first, each goes to the lane with the least bytes.  A round spells the next bytes of the
        lanes, with the bytes before them as context, and runs as many blocks as all lanes have that go on after
        them.  What a lane has left over, or a text's last block beyond its end, waits or is filled up."""
        raw = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass") for t in texts]
        size, reach = [len(t) for t in raw], ORDERS[-1][0]
        lanes = [_Lane() for _ in range(min(len(raw), LANES))]
        load = [(0, i) for i in range(len(lanes))]
        for text in sorted(range(len(raw)), key=size.__getitem__, reverse=True):
            bytes_of, i = load[0]
            lanes[i].texts.append(text)
            heapq.heapreplace(load, (bytes_of + size[text] + BLOCK // 2, i))
        n = len(lanes)
        state = (np.repeat(self.weights.T[:, None] * UNIT, n, axis=1), np.tile(SQUASH[::MAP_STEP], (n, 1)), np.zeros(n, np.int64))
        total, live = np.zeros(len(raw), np.int64), list(range(n))
        while live:
            more = max(64, ROUND_BYTES // len(live))
            pieces, skip, last, whose = [], [], [], []
            for i in live:
                lane, want = lanes[i], more
                if lane.bits() >= 4 * more:  # has enough left over
                    continue
                while lane.texts and want > 0:
                    text, at = lane.texts[0], lane.at
                    to = min(size[text], at + want)
                    skip.append(min(at, reach))
                    pieces.append(raw[text][at - skip[-1]:to])
                    last.append(to == size[text])
                    whose.append((lane, text))
                    want -= to - at + 1
                    lane.at = to
                    if last[-1]:
                        lane.texts.popleft()
                        lane.at = 0
            if pieces:
                lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
                words, count = self.inputs(np.frombuffer(b"\n".join(pieces) + b"\n", np.uint8), np.cumsum(lens + 1) - lens - 1,
                                           np.array(last), np.array(skip))
                at = 0
                for (lane, text), k, end in zip(whose, count.tolist(), last, strict=True):
                    lane.add(text, words[at:at + k], end)
                    at += k
            if len(live) < FEW:
                for i in live:
                    for text, part, end in lanes[i].all():
                        state[2][i] += self._alone(part, state[0][:, i], state[1][i])
                        if end:
                            self._finish(i, text, state, total)
            else:
                live.sort(key=lambda i: -lanes[i].blocks())
                have = np.array([lanes[i].blocks() for i in live])
                steps = min((lanes[i].blocks() for i in live if lanes[i].goes_on()), default=int(have[0]))
                active = np.searchsorted(-have, -np.arange(steps), "left").tolist()
                if active[-1] < FEW:  # these few go on alone
                    active = [a for a in active if a >= FEW]
                ends, parts = {}, []
                for j, i in enumerate(live):
                    parts.append(lanes[i].take(len(active), j, ends))
                sizes = np.fromiter(map(len, parts), np.int64, len(parts))
                own = (np.ascontiguousarray(state[0][:, live]), state[1][live], state[2][live])
                self.run(np.concatenate(parts), np.cumsum(sizes) - sizes, active, ends, own, total)
                state[0][:, live], state[1][live], state[2][live] = own
            live = [i for i in live if lanes[i].goes_on() or lanes[i].parts]
        return total / LOG_UNIT

    def log10_probabilities(self, texts: list[str | bytes | None]) -> np.ndarray:
        """Of whole texts, which run together."""
        return self._scored(texts) / math.log(10)


def gate_weights(counts: np.ndarray) -> np.ndarray:
    """Weights by gate of a logistic regression (Newton's method) over bits counted by ``Mixer.count_gates``; a gate
    without bits keeps ``FIRST_WEIGHTS``, which count like one bit."""
    out = np.tile(np.array(FIRST_WEIGHTS), (GATES, 1))
    for gate, n in enumerate(counts.reshape(GATES, -1, 2)):
        used = np.flatnonzero(n.any(axis=1))
        f = (np.stack(np.unravel_index(used, (LEVELS,) * 3), axis=1) - LEVELS // 2 + 0.5) * LEVEL
        ones, both = n[used, 1].astype(np.float64), n[used].sum(axis=1).astype(np.float64)

        def loss(w, f=f, ones=ones, both=both):
            dot = f @ w
            return (both * np.logaddexp(0, dot) - ones * dot).sum() + 0.5 * ((w - FIRST_WEIGHTS) ** 2).sum()

        w, now = out[gate], loss(out[gate])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
            step = np.linalg.solve((f * (both * p * (1 - p))[:, None]).T @ f + np.eye(3), f.T @ (ones - both * p) + FIRST_WEIGHTS - w)
            while (new := loss(w + step)) > now and np.abs(step).max() > 1e-9:
                step /= 2
            if np.abs(step).max() <= 1e-9:
                break
            w, now = w + step, new
        out[gate] = w
    return out


def train(docs: DataFrame, spelled: np.ndarray, n_train: int) -> Mixer:
    """Tables and first weights from all training documents; for the weights, each fold meets the tables of the
    other, as its own would make contexts look too well known."""
    spelling = Spelling(spelled)
    sc = docs.sparkSession.sparkContext
    sizes = [2 << bits for _, bits in ORDERS]
    cuts = np.cumsum(sizes)[:-1]
    shared = sc.broadcast(spelling)
    second = crc_remainder("doc_id", 2 * HELD_OUT) >= HELD_OUT
    found = _input(docs).where("not held_out").select("text", second.alias("second"))
    # bits and predictions follow from a symbol and the bytes before it, so the texts are read once
    keys = stored(count_keys(found, shared), "lm-keys")
    # of fixed size: two 64-bit integers per slot of the tables
    halves = _whole(count_key_bits(keys, shared), 2 * sum(sizes)).reshape(2, -1)
    tables = [[stretched(t) for t in np.split(half, cuts)] for half in halves]
    mixer = Mixer(spelling, [stretched(t) for t in np.split(halves[0] + halves[1], cuts)])
    if not n_train:
        return mixer
    folds = sc.broadcast([Mixer(spelling, t) for t in tables[::-1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(GATES * 2 * LEVELS ** 3, np.int64)
        for b in batches:
            second, key, n = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for fold, other in enumerate(folds.value):
                mine = second == bool(fold)
                other.count_key_gates(key[mine].view(np.uint64), n[mine], counts)
        yield _packed(counts)

    counted = keys.mapInArrow(run, "chunk int, packed binary")
    mixer.weights = gate_weights(_whole(_summed_chunks(counted, raw=True), GATES * 2 * LEVELS ** 3))
    return mixer


# --- scoring ------------------------------------------------------------------------------

def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches joined up to about ``size`` bytes: the more texts run together, the fuller the lockstep."""
    held = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.nbytes for x in held) >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte``."""
    sc = docs.sparkSession.sparkContext
    counts = stored(count_words(docs), "lm-counts")
    words = counts.where("kind = 0")
    n, kinds, seen = words.agg(F.sum("trained"), F.count(F.when(F.col("trained") > 0, 1)), F.sum("seen")).first()
    n, kinds, seen = n or 0, kinds or 0, seen or 0
    low = math.log10(n + 0.1 * (kinds + 1))
    spelled = np.zeros((257, 257), np.int64)
    pairs = counts.where("kind = 1").select("h", "trained").toArrow()
    spelled.ravel()[pairs.column("h").to_numpy()] = pairs.column("trained").to_numpy()
    heavy = words.where(F.col("seen") >= max(1.0, HEAVY * seen)).select("h", "trained").toArrow()
    key, value = heavy.column("h").to_numpy().view(np.uint64), heavy.column("trained").to_numpy()
    order = np.argsort(key)
    heavy_words = sc.broadcast((Known(key[order]), value[order]))
    model = sc.broadcast(train(docs, spelled, int(spelled[:, END].sum())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        known, trained = heavy_words.value
        logs = np.log10(trained + 0.1) - low
        row = TaskContext.get().partitionId() << 40
        for b in gathered(batches, RUN_BYTES):
            texts = b.column(1).to_pylist()
            m = len(texts)
            tokens, hits, base, size = (np.zeros(m, d) for d in (np.int64, np.int64, np.float64, np.int64))
            light = [[] for _ in range(m)]
            for data, starts, owner, last in slices(texts):
                h, at = word_hashes(data)
                mine = owner[np.searchsorted(starts, at, "right") - 1]
                h = np.concatenate([h, np.full(int(last.sum()), END_WORD, np.uint64)])
                mine = np.concatenate([mine, owner[last]])
                tokens += np.bincount(mine, minlength=m)
                place = known.find(h)
                found = place >= 0
                place = place[found]
                hits += np.bincount(mine[found], weights=trained[place] > 0, minlength=m).astype(np.int64)
                base += np.bincount(mine[found], weights=logs[place], minlength=m)
                rare, whose = h[~found].view(np.int64), mine[~found]
                by = np.argsort(whose, kind="stable")
                ends = np.cumsum(np.bincount(whose, minlength=m))
                for i in np.unique(whose):
                    light[i].append(rare[by[(ends[i - 1] if i else 0):ends[i]]])
                np.add.at(size, owner, np.diff(np.r_[starts, len(data)]) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(m)), b.column(0), b.column(2), pa.array(tokens), pa.array(hits), pa.array(base),
                 pa.array(model.value.log10_probabilities(texts)), pa.array(size),
                 pa.array([np.concatenate(x) if x else [] for x in light], pa.list_(pa.int64()))],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "n_bytes", "light"])
            row += m

    ids = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(_input(docs).mapInArrow(
        run, f"row long, doc_id {ids}, held_out boolean, n_tokens long, known long, base double, score double, "
             "n_bytes long, light array<long>"), "lm-rows")
    rare = rows.select("row", F.explode("light").alias("h"))
    c = F.col("trained")
    per_row = (rare.join(words.where(F.col("seen") < max(1.0, HEAVY * seen)).select("h", "trained"), "h")
               .groupBy("row").agg(F.sum(F.log10(c + F.lit(0.1)) - F.lit(low)).alias("rare_base"),
                                   F.count(F.when(c > 0, 1)).alias("rare_known")))
    return (rows.drop("light").join(per_row, "row", "left")
            .select("doc_id", "held_out", "n_tokens",
                    (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
                    F.lit(n).cast("long").alias("train_tokens"),
                    (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"), "score", "n_bytes",
                    (F.col("score") * -math.log2(10) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte")))
