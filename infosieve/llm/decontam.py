"""Benchmark decontamination (operator 6): latent semantic retrieval, then order and answer checks.

1. Document frequencies of the benchmark's words are counted over all documents.
2. A randomised SVD (subspace iteration) of TF-IDF passages gives a latent space.  It is fitted on
   all benchmark items and all passages of ``FIT_WORDS`` words of all documents: Spark sums the products
   ``A^T A`` of the passages once, by pairs of words, and every pass multiplies the stored sums.
3. Documents are cut into windows of two segments, one segment apart, for segment lengths that
   cover the items; an item of at most a segment lies wholly in one window.  Pairs of a window
   and an item of whose answer terms, its rarest words, the window holds ``ANSWER_SHARE`` are
   counted exactly; those whose cosine reaches ``COSINE`` times the item's share of the window's
   length become candidates.
4. A candidate stays if the longest common subsequence covers ``LCS_SHARE`` of the item's words.
   An item of fewer than ``SHORT`` words that stands in the window word by word stays whatever
   its cosine.

Defined results: null and empty texts and items match nothing; repeated rows give equal
pairs; an item that occurs several times in a document gives one pair, its best window;
items of fewer than ``SHORT`` words must match wholly (in order, and with gaps only from a
cosine of ``COSINE``); extra columns are ignored; a text of any length is searched whole, window
by window; an empty benchmark or table finds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, span_hashes, stored

RANK, OVERSAMPLE, PASSES = 128, 8, 2
FIT_WORDS = 64
SEGMENT, COSINE, LCS_SHARE, ANSWER_TERMS, ANSWER_SHARE, SHORT = 16, 0.15, 0.6, 8, 0.5, 8
#: Latent vectors of words; more words than this share them by remainder.
TERMS = 1 << 16
#: Word pairs are summed in tiles of ``TILE`` times ``TILE``, those of the ``DENSE`` most frequent words in an array
#: per task; a row of them is a slab, ``ROWS`` rows of a tile.
TILE, ROWS, DENSE = 256, 16, 4096
SLAB = ROWS * TILE
#: Pairs of windows and items, by answer terms, that are counted together.
PAIRS, SLICE_CHARS = 1 << 21, 400_000
_SEED = 6
#: White space, punctuation and symbols beyond ASCII separate words as those of ASCII do.
_OTHER_GAP = re.compile(r"[^\w\x00-\x7f]")
#: Bytes of words, once other gaps are blanks: ASCII letters, digits and underscores, and all beyond ASCII.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (``\\w+``) of lower-cased texts, and each text's word count."""
    lowered = [(t or "").lower() for t in texts]
    raw = [(t if t.isascii() else _OTHER_GAP.sub(" ", t)).encode("utf-8", "surrogatepass") for t in lowered]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    inside = np.concatenate([[False], _IN_WORD[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    ends = np.cumsum(sizes)
    return span_hashes(data, start, end, _SEED), np.searchsorted(start, ends) - np.searchsorted(start, ends - sizes)


class Benchmark:
    """Items as word numbers, with document frequencies once they are counted.

    A benchmark is the stated query set; its size bounds this object.
    """

    def __init__(self, items: list[tuple[int, str | None]]):
        hashes, counts = word_hashes([t for _, t in items])
        parts = np.split(hashes, np.cumsum(counts)[:-1]) if items else []
        kept = [(i, h) for (i, _), h in zip(items, parts, strict=True) if len(h)]
        self.keys = np.unique(hashes)
        self.ids = [i for i, _ in kept]
        self.seqs = [np.searchsorted(self.keys, h) for _, h in kept]
        self.idf = np.ones(len(self.keys))
        self.answers: list[frozenset] = []
        self.masks: list[dict] = []
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def weigh(self, df: np.ndarray, n_docs: int) -> None:
        self.idf = np.maximum(np.log((n_docs + 1) / (df + 1)), 0.05)
        for seq in self.seqs:
            kinds = np.unique(seq)
            rare = kinds[np.lexsort((kinds, -self.idf[kinds]))][:ANSWER_TERMS]
            self.answers.append(frozenset(rare.tolist()))
            mask: dict = {}
            for k, t in enumerate(seq.tolist()):
                mask[t] = mask.get(t, 0) | 1 << k
            self.masks.append(mask)

    def numbers(self, texts: list[str | None]) -> list[np.ndarray]:
        """Word numbers of each text, -1 for words no item has."""
        h, counts = word_hashes(texts)
        out = np.full(len(h), -1, np.int64)
        near = np.flatnonzero(self.maybe[(h >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, h[near]), len(self.keys) - 1)
        hit = self.keys[at] == h[near]
        out[near[hit]] = at[hit]
        return np.split(out, np.cumsum(counts)[:-1])

    def needed(self, item: int) -> int:
        """Distinct answer terms that a match must hold."""
        return -int(-ANSWER_SHARE * len(self.answers[item]) // 1)

    def lcs(self, item: int, seq: list[int]) -> int:
        """Length of the longest common subsequence, a bit of an integer per word of the item."""
        mask, full = self.masks[item], (1 << len(self.seqs[item])) - 1
        open_ = full
        for t in seq:
            hit = mask.get(t)
            if hit:
                both = open_ & hit
                open_ = (open_ + both | open_ & ~hit) & full
        return len(self.seqs[item]) - open_.bit_count()


def _document_frequencies(docs: DataFrame, bench) -> DataFrame:
    """``term, df`` (term -1: the number of documents); a task sends one row per word it has seen."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b_ = bench.value
        df, n = np.zeros(len(b_.keys), np.int64), 0
        for b in batches:
            for _, seqs in _slices(b.column(0).to_pylist(), b_):
                for got in seqs:
                    df[np.unique(got[got >= 0])] += 1
            n += b.num_rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[df[at], n])], names=["term", "df"])

    return in_arrow(docs.select("text"), run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Passages:
    """TF-IDF rows of unit length of passages of ``cut`` words, by the places of the words' vectors."""

    def __init__(self, bench: Benchmark, place: np.ndarray, cut: int = FIT_WORDS):
        self.bench, self.cut, self.n = bench, cut, len(place)
        # words in the order of their places: sorted words are sorted places
        words = np.argsort(place[np.arange(len(bench.keys)) % self.n], kind="stable")
        self.order = np.argsort(words)
        self.places, self.idf = place[words % self.n], bench.idf[words]

    def rows(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in ascending order and weights of all rows, and the places of each row."""
        parts = self.bench.numbers(texts)
        lens = np.fromiter(map(len, parts), np.int64, len(parts))
        seq = np.concatenate(parts)
        known = np.flatnonzero(seq >= 0)
        cuts = -(-lens // self.cut)
        inside = known - np.repeat(np.cumsum(lens) - lens, lens)[known]
        row = np.repeat(np.cumsum(cuts) - cuts, lens)[known] + inside // self.cut
        key, count = np.unique(row * len(self.order) + self.order[seq[known]], return_counts=True)
        row, word = np.divmod(key, len(self.order))
        w = count * self.idf[word]
        w /= np.sqrt(np.bincount(row, weights=w * w))[row]
        key = row * self.n + self.places[word]
        if self.n < len(self.order):  # words that share a vector
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
            key, w = key[first], np.add.reduceat(w, first) if len(first) else w
        sizes = np.bincount(key // self.n)
        return key % self.n, w, sizes[sizes > 0]


def _corners(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each place what it adds to the number of a pair, as its smaller and as its larger one.

    Pairs lie in tiles of ``TILE`` times ``TILE``, the tiles of the first places first."""
    block, inside = np.divmod(np.arange(n), TILE)
    return block * TILE ** 2 + inside * TILE, block * (block + 1) // 2 * TILE ** 2 + inside


def _products(terms: np.ndarray, weights: np.ndarray, sizes: np.ndarray, corners) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of all pairs of a row's places and the products of their weights, some ``PAIRS`` at a time."""
    first = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        one, other = np.triu_indices(size)
        rows = first[sizes == size]
        step = max(1, (PAIRS >> 4) // len(one))
        for a in range(0, len(rows), step):
            at = rows[a:a + step] + np.arange(size)[:, None]
            t, w = terms[at], weights[at]
            yield (corners[0][t][one] + corners[1][t][other]).ravel(), (w[one] * w[other]).ravel()


def _summed_pairs(pairs: list) -> list:
    """Pairs and their sums as a list of one piece."""
    key, place = np.unique(np.concatenate([k for k, _ in pairs]), return_inverse=True)
    return [(key, np.bincount(place, weights=np.concatenate([w for _, w in pairs])))]


def _products_of_passages(docs: DataFrame, shared, place, dense_places: int) -> DataFrame:
    """``slab, cells, weights``: the products ``A^T A`` of all passages of all documents, a row per slab of pairs;
    of slab -1 the weight is the number of passages.

    A task sums the pairs of the ``dense_places`` first places in an array, all others in sorted lists."""
    def packed(slab, cells, weights):
        return pa.RecordBatch.from_arrays(
            [pa.array(slab, pa.int32()), pa.array([c.astype("<u2").tobytes() for c in cells], pa.binary()),
             pa.array([w.astype("<f4").tobytes() for w in weights], pa.binary())], names=["slab", "cells", "weights"])

    def sent(key, weight):
        slab = key // SLAB
        cut = np.flatnonzero(np.diff(slab)) + 1
        slabs, cells, sums = slab[np.r_[0, cut]].tolist(), np.split(key % SLAB, cut), np.split(weight, cut)
        for a in range(0, len(slabs), 1000):
            yield packed(slabs[a:a + 1000], cells[a:a + 1000], sums[a:a + 1000])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Passages(shared.value, place.value)
        corners = _corners(passages.n)
        blocks = -(-min(passages.n, dense_places) // TILE)
        dense, rest, held, n = np.zeros(blocks * (blocks + 1) // 2 * TILE ** 2), [], 0, 0
        for b in batches:
            for texts in _runs(b.column(0).to_pylist()):
                terms, weights, sizes = passages.rows(texts)
                n += len(sizes)
                for key, weight in _products(terms, weights, sizes, corners):
                    if passages.n > blocks * TILE:
                        far = key >= len(dense)
                        rest.append((key[far], weight[far]))
                        held += len(rest[-1][0])
                        key, weight = key[~far], weight[~far]
                    np.add.at(dense, key, weight)
                    if held > 2 * PAIRS:
                        rest = _summed_pairs(rest)
                        held = len(rest[0][0])
                        if held > PAIRS:
                            yield from sent(*rest[0])
                            rest, held = [], 0
        if held:
            yield from sent(*_summed_pairs(rest)[0])
        used = np.flatnonzero(dense)
        if len(used):
            yield from sent(used, dense[used])
        yield packed([-1], [np.zeros(1)], [np.array([n])])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab, total = None, np.zeros(SLAB)

        def out():
            used = np.flatnonzero(total)
            return packed([slab], [used], [total[used]])

        for b in batches:
            for i, cells, weights in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if i != slab:
                    if slab is not None:
                        yield out()
                    slab = i
                    total[:] = 0
                total[np.frombuffer(cells, "<u2")] += np.frombuffer(weights, "<f4")
        if slab is not None:
            yield out()

    schema = "slab int, cells binary, weights binary"
    return (in_arrow(docs.select("text"), run, schema).repartition("slab").sortWithinPartitions("slab")
            .mapInArrow(summed, schema))


def latent_space(docs: DataFrame, bench: Benchmark, shared, rank: int = RANK, dense_places: int = DENSE) -> np.ndarray:
    """Projection of word numbers (modulo ``TERMS``) to ``rank`` latent coordinates."""
    spark = docs.sparkSession
    n = min(len(bench.keys), TERMS)
    width = min(n, rank + OVERSAMPLE)
    # words of many documents come first
    rarity = np.full(n, np.inf)
    np.minimum.at(rarity, np.arange(len(bench.keys)) % n, bench.idf)
    place = np.argsort(np.argsort(rarity, kind="stable"))
    slabs = stored(_products_of_passages(docs, shared, spark.sparkContext.broadcast(place), dense_places), "lsa-products")
    passages = int(sum(np.frombuffer(r["weights"], "<f4")[0] for r in slabs.where("slab = -1").collect()))
    own = []
    for seq in bench.seqs:
        kinds, count = np.unique(seq, return_counts=True)
        w = count * bench.idf[kinds]
        own.append((place[kinds % n], w / np.sqrt((w * w).sum())))
    # items and corpus passages weigh the same in total, however few the items are
    heavier = max(1.0, passages / len(own))
    at = np.repeat(np.arange(len(own)), [len(t) for t, _ in own])
    own_terms, own_weights = (np.concatenate(x) for x in zip(*own, strict=True))
    blocks = -(-n // TILE)

    def multiplied(q: np.ndarray) -> np.ndarray:
        rows = np.zeros((blocks * TILE, width), np.float32)
        rows[:n] = q
        basis = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict = {}
            for b in batches:
                for i, cells, weights in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    tile, first = divmod(i * ROWS, TILE)
                    y = int((np.sqrt(8 * tile + 1) - 1) // 2)
                    x = tile - y * (y + 1) // 2
                    slab = np.zeros(SLAB, np.float32)
                    slab[np.frombuffer(cells, "<u2")] = np.frombuffer(weights, "<f4")
                    slab = slab.reshape(ROWS, TILE)
                    for k in {x, y} - total.keys():
                        total[k] = np.zeros((TILE, width))
                    total[x][first:first + ROWS] += slab @ basis.value[y * TILE:(y + 1) * TILE]
                    if x == y:  # the other half, without the diagonal
                        slab = np.triu(slab, first + 1)
                    total[y] += slab.T @ basis.value[x * TILE + first:x * TILE + first + ROWS]
            for k, v in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([v.tobytes()], pa.binary())], names=["block", "v"])

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: dict = {}
            for b in batches:
                for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    x = np.frombuffer(v, np.float64)
                    kept[k] = kept[k] + x if k in kept else x
            yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int32()), pa.array([x.tobytes() for x in kept.values()], pa.binary())],
                                             names=["block", "v"])

        z = np.zeros((blocks * TILE, width))
        # at most TERMS rows of the rank's width
        for r in (slabs.where("slab >= 0").mapInArrow(run, "block int, v binary").repartition("block")
                  .mapInArrow(summed, "block int, v binary").toLocalIterator()):
            z[r["block"] * TILE:(r["block"] + 1) * TILE] = np.frombuffer(r["v"], np.float64).reshape(TILE, width)
        y = np.zeros((len(own), width))
        for a in range(0, len(at), PAIRS >> 8):
            part = slice(a, a + (PAIRS >> 8))
            np.add.at(y, at[part], q[own_terms[part]] * own_weights[part][:, None])
        for a in range(0, len(at), PAIRS >> 8):
            part = slice(a, a + (PAIRS >> 8))
            np.add.at(z, own_terms[part], y[at[part]] * (heavier * own_weights[part])[:, None])
        return z[:n]

    q = np.linalg.qr(np.random.default_rng(6).standard_normal((n, width)))[0]
    for _ in range(PASSES):
        q = np.linalg.qr(multiplied(q))[0]
    z = multiplied(q)
    values, turn = np.linalg.eigh(q.T @ z)
    best = np.argsort(-values)[:min(rank, width)]
    return (q @ turn[:, best]).astype(np.float32)[place]


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``first, first + 1, ...`` of each size, end to end."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _stands(item: np.ndarray, seq: np.ndarray) -> bool:
    """Whether the item stands in the sequence word by word."""
    n = len(seq) - len(item) + 1
    return n > 0 and bool(np.all([seq[j:j + n] == t for j, t in enumerate(item.tolist())], axis=0).any())


class Searcher:
    """Embeds windows and checks candidates."""

    def __init__(self, bench: Benchmark, space: np.ndarray):
        self.bench = bench
        # a word's latent row with its weight folded in
        self.rows = (space[np.arange(len(bench.keys)) % TERMS] * bench.idf[:, None]).astype(np.float32)
        lens = np.array([len(s) for s in bench.seqs])
        self.level = np.ceil(np.log2(np.maximum(lens, 1) / SEGMENT)).clip(0).astype(int)
        self.top = int(self.level.max(initial=0))
        self.telling = np.zeros(len(bench.keys), bool)
        self.telling[[t for a in bench.answers for t in a]] = True
        self.needed = np.array([bench.needed(i) for i in range(len(lens))], np.int64)
        self.short = lens < SHORT
        self.bound = np.where(self.short, COSINE, COSINE * lens / (2 * SEGMENT << self.level))
        # items by answer term, for each level
        self.postings = []
        for k in range(self.top + 1):
            held = [(t, i) for i in np.flatnonzero(self.level == k).tolist() for t in bench.answers[i]]
            t, i = np.array(held, np.int64).reshape(-1, 2).T
            by = np.lexsort((i, t))
            self.postings.append((np.searchsorted(t[by], np.arange(len(bench.keys) + 1)), i[by]))
        self.least = [max(1, min((bench.needed(i) for i in np.flatnonzero(self.level == k).tolist()), default=1))
                      for k in range(self.top + 1)]
        vec = np.stack([self.rows[s].sum(axis=0) for s in bench.seqs]) if len(lens) else np.zeros((0, space.shape[1]), np.float32)
        norm = np.sqrt((vec * vec).sum(axis=1, keepdims=True))
        self.items = vec / np.maximum(norm, 1e-12)

    def candidates(self, seqs: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, float]]:
        """``document, item, first word, end word, cosine`` of windows that hold the answer terms an
        item needs and reach its bound; short items need no cosine.

        Only windows with such a pair are embedded.
        """
        lens = np.array([len(s) for s in seqs])
        words = np.concatenate(seqs)
        first = np.cumsum(lens) - lens
        known = np.flatnonzero(words >= 0)
        terms = words[known]
        telling = known[self.telling[terms]]
        before = np.r_[0, np.cumsum(np.bincount(telling, minlength=len(words)))]
        for k in range(self.top + 1):
            mine = np.flatnonzero(self.level == k)
            if not len(mine):
                continue
            seg = SEGMENT << k
            count = np.maximum(1, -(-lens // seg) - 1)
            owner = np.repeat(np.arange(len(seqs)), count)
            start = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * seg
            a = first[owner] + start
            z = np.minimum(a + 2 * seg, first[owner] + lens[owner])
            live = np.flatnonzero(before[z] - before[a] >= self.least[k])
            first_item, items = self.postings[k]
            sizes = np.diff(first_item)
            load = np.r_[0, np.cumsum(sizes[words[telling]])]
            tell_lo, tell_hi = np.searchsorted(telling, a[live]), np.searchsorted(telling, z[live])
            group = np.cumsum(load[tell_hi] - load[tell_lo]) // PAIRS
            cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(live)] if len(live) else [0]
            for g0, g1 in zip(cuts[:-1], cuts[1:], strict=True):
                w, i = self._sharing(words[telling], tell_lo[g0:g1], tell_hi[g0:g1], sizes, first_item, items)
                for at in range(0, len(w), 4096):
                    one, own = np.unique(live[g0:g1][w[at:at + 4096]], return_inverse=True)
                    lo, hi = np.searchsorted(known, a[one]), np.searchsorted(known, z[one])
                    rows = self.rows[terms[_ranges(lo, hi - lo)]]
                    win = np.add.reduceat(rows, np.cumsum(hi - lo) - (hi - lo))
                    norm = np.sqrt((win * win).sum(axis=1))
                    win /= np.maximum(norm, 1e-9)[:, None]
                    item = i[at:at + 4096]
                    cos = np.einsum("ij,ij->i", win[own], self.items[item])
                    near = np.flatnonzero((cos >= self.bound[item]) | (self.short[item]))
                    for x, y, c in zip(one[own[near]].tolist(), item[near].tolist(), cos[near].tolist(), strict=True):
                        yield int(owner[x]), y, int(start[x]), int(start[x]) + 2 * seg, c

    def _sharing(self, told, lo, hi, sizes, first_item, items) -> tuple[np.ndarray, np.ndarray]:
        """Windows and items of whose answer terms the window holds enough distinct ones."""
        n = len(self.bench.keys)
        held = np.unique(np.repeat(np.arange(len(lo)), hi - lo) * n + told[_ranges(lo, hi - lo)])
        window, term = held // n, held % n
        some = items[_ranges(first_item[term], sizes[term])]
        pair, count = np.unique(np.repeat(window, sizes[term]) * len(self.needed) + some, return_counts=True)
        item = pair % len(self.needed)
        enough = count >= self.needed[item]
        return pair[enough] // len(self.needed), item[enough]

    def matches(self, seqs: list[np.ndarray]) -> list[tuple[int, int, float, float, int, int]]:
        """``document, item, cosine, lcs share, first word, words`` of the best window of each pair."""
        best: dict = {}
        for d, i, a, z, c in self.candidates(seqs):
            seq, item = seqs[d][a:z], self.bench.seqs[i]
            if self.short[i] and c < self.bound[i]:
                if not _stands(item, seq):
                    continue
                share = 1.0
            else:
                share = self.bench.lcs(i, seq[seq >= 0].tolist()) / len(item)
            if share < (1.0 if self.short[i] else LCS_SHARE):
                continue
            got = (share, c, -a)
            if (d, i) not in best or got > best[d, i][0]:
                best[d, i] = (got, min(z, len(seqs[d])) - a)
        return [(d, i, c, share, -a, n) for (d, i), ((share, c, a), n) in sorted(best.items())]


def _runs(texts: list) -> Iterator[list]:
    """Runs of texts of about ``SLICE_CHARS`` characters."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= SLICE_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _slices(texts: list, bench: Benchmark) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Word numbers of runs of documents of about ``SLICE_CHARS`` characters, and each run's first place."""
    at = 0
    for run in _runs(texts):
        yield at, bench.numbers(run)
        at += len(run)


def fit(docs: DataFrame, benchmark: DataFrame) -> Searcher | None:
    """The searcher for a benchmark with ``item_id, text``; None if it has no words."""
    sc = docs.sparkSession.sparkContext
    # the benchmark is the stated query set
    bench = Benchmark([(r["item_id"], r["text"]) for r in benchmark.select("item_id", "text").collect()])
    if not len(bench.keys):
        return None
    df, n_docs = np.zeros(len(bench.keys), np.int64), 0
    for r in _document_frequencies(docs, sc.broadcast(bench)).collect():
        if r["term"] < 0:
            n_docs = r["df"]
        else:
            df[r["term"]] = r["df"]
    bench.weigh(df, n_docs)
    return Searcher(bench, latent_space(docs, bench, sc.broadcast(bench)))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, cosine, lcs_share, first_word, n_words``: a row per document and item found in it."""
    ids, items = (t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (benchmark, "item_id")))
    schema = f"doc_id {ids}, item_id {items}, cosine double, lcs_share double, first_word long, n_words long"
    found = fit(docs, benchmark)
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            doc_ids = b.column(0)
            for at, seqs in _slices(b.column(1).to_pylist(), s.bench):
                got = s.matches(seqs)
                if got:
                    d, i, c, share, a, n = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [doc_ids.take(pa.array([at + x for x in d])), pa.array([s.bench.ids[x] for x in i]),
                         pa.array(c, pa.float64()), pa.array(share, pa.float64()), pa.array(a, pa.int64()), pa.array(n, pa.int64())],
                        names=["doc_id", "item_id", "cosine", "lcs_share", "first_word", "n_words"])

    return in_arrow(docs.select("doc_id", "text"), run, schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` in which no item is found; the text meets the searcher in place."""
    found = fit(docs, benchmark)
    if found is None:
        return docs
    shared, place = docs.sparkSession.sparkContext.broadcast(found), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            clean = np.ones(b.num_rows, bool)
            for at, seqs in _slices(b.column(place).to_pylist(), s.bench):
                for d, *_ in s.matches(seqs):
                    clean[at + d] = False
            yield b.filter(pa.array(clean))

    return in_arrow(docs, run, docs.schema)
