"""Periodic runs of words (operator 11) by string synchronising sets.

A run is a stretch of words that repeats with smallest period q at least ``EXPONENT`` times and
can't be extended by either neighbour.  Runs are proposed scale by scale and then checked
and extended word by word, so hashes never decide a result:

* Periods of at most ``DIRECT`` words come from comparing the words with themselves, shifted.
* Scale t = 4, 8, 16, ... finds the periods from 2t - 1 to 4t - 2.  Windows of t words get hashes, made
  from those of half the length.  Position i is in the synchronising set if the smallest hash among
  the windows i ... i + t is that of window i or of window i + t; which positions are chosen depends
  on the 2t words after them alone.  Two chosen positions 2t - 1 to 4t - 2 words apart before the
  same 2t words propose their distance as a period.
* Windows inside highly periodic regions (period of at most t / 3) are left out of the minimum, else
  they would be chosen without bound; those regions are runs of smaller periods, which the
  scales before have supplied.

Why nothing is missed: where t successive positions are not chosen, the 3t - 1 words from the first on have
a period of at most t / 3.  If a run of smallest period p in [2t - 1, 4t - 2] had p successive
starts without a chosen one, the regions would overlap to a stretch of p + 2t - 1 words with a
period of at most t / 3, which then would divide p.  Three repetitions hold p starts, their partners one period
on, and the 2t words after those.

Texts are searched many at a time, joined with separators that are equal to no word.  Long
scales keep only the texts that are long enough for them.

Defined results: a null text counts as an empty one (no words, no runs, nothing left); ties of the
best run go to the smaller start, then period; null and repeated ``doc_id`` are rows like any
other; a text of any length is searched whole, alone if need be; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow

MIN_WORDS, EXPONENT, DIRECT = 24, 3, 6
#: Words searched at a time (a longer text is searched alone) and bytes sent back at a time.
JOINED_WORDS, SEND_BYTES = 1 << 18, 1 << 23
_SEED, _NONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFFFFFFFFFFFFFFFF)
_U64 = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _ahead(x: np.ndarray, by: int, fill) -> np.ndarray:
    """``x[i + by]`` at place i."""
    out = np.full_like(x, fill)
    if by < len(x):
        out[:len(x) - by] = x[by:]
    return out


def _doubled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of windows of twice the ``width``."""
    with np.errstate(over="ignore"):
        return _mixed(h * _SEED + _mixed(_ahead(h, width, 0)))


def _equal_until(w: np.ndarray, i: int, d: int) -> int:
    """The first place from i on whose word differs from that d words later."""
    step, last = 64, len(w) - d
    while i < last:
        j = min(i + step, last)
        differs = w[i:j] != w[i + d:j + d]
        k = int(differs.argmax())
        if differs[k]:
            return i + k
        i, step = j, min(4 * step, 1 << 20)
    return max(i, last)


def _equal_from(w: np.ndarray, i: int, d: int) -> int:
    """The smallest place up to i from which on all words equal those d words later."""
    step = 64
    while i > 0:
        j = max(i - step, 0)
        differs = (w[j:i] != w[j + d:i + d])[::-1]
        k = int(differs.argmax())
        if differs[k]:
            return i - k
        i, step = j, min(4 * step, 1 << 20)
    return 0


class _Found:
    """Runs found so far, with periods in ascending order where stretches coincide."""

    def __init__(self):
        self.start, self.length, self.period = [], [], []
        self.stretches: set[tuple[int, int]] = set()

    def add(self, start: int, length: int, period: int) -> None:
        # the same stretch with a smaller period: that one is the smallest period
        if length >= EXPONENT * period and (start, length) not in self.stretches:
            self.stretches.add((start, length))
            self.start.append(start)
            self.length.append(length)
            self.period.append(period)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.array(x, np.int64) for x in (self.start, self.length, self.period))


def _direct(w: np.ndarray, found: _Found) -> None:
    for p in range(1, DIRECT + 1):
        edge = np.diff(np.r_[False, w[:-p] == w[p:], False].astype(np.int8)) if len(w) > p else np.empty(0, np.int8)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = last - first >= (EXPONENT - 1) * p
        for a, z in zip(first[long].tolist(), last[long].tolist(), strict=True):
            found.add(a, z - a + p, p)


def synchronising_set(h: np.ndarray, t: int, omitted: np.ndarray) -> np.ndarray:
    """Positions chosen by the hashes ``h`` of windows of t words, ``omitted`` windows left out."""
    key = np.where(omitted, _NONE, h)
    low, width = key.copy(), 1
    while width < t:
        np.minimum(low[:-width], low[width:].copy(), out=low[:-width])
        width *= 2
    low = np.minimum(low, _ahead(low, 1, _NONE))
    return np.flatnonzero((low != _NONE) & ((low == key) | (low == _ahead(key, t, _NONE))))


def _pairs(at: np.ndarray, context: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``(distance, position)`` of chosen positions before equal contexts, in ascending order."""
    left, step = np.arange(len(at)), 1
    out = []
    while True:
        left = left[left + step < len(at)]
        gap = at[left + step] - at[left]
        near = gap <= most
        left, gap = left[near], gap[near]
        if not len(left):
            break
        same = (gap >= least) & (context[left] == context[left + step])
        out.append(np.stack([gap[same], at[left[same]]]))
        step += 1
    pairs = np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)
    return pairs[:, np.lexsort((pairs[1], pairs[0]))]


def find_runs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text, start, length, period)`` of all runs of at least ``EXPONENT`` periods, of whatever length.

    ``words`` holds the texts one after the other, as numbers below 2**40; ``sizes`` their word counts.
    """
    n_texts = len(sizes)
    bounds = np.cumsum(sizes)
    w = np.insert(words.astype(np.int64), bounds, -1 - np.arange(n_texts))  # a separator ends every text
    first = bounds - sizes + np.arange(n_texts)
    found = _Found()
    _direct(w, found)
    # the scales' own view: words, their places in w, and the text of each
    place, size_of = np.arange(len(w)), np.repeat(sizes, sizes + 1)
    h = _mixed(w.view(np.uint64) + _SEED)
    width = 1
    while width < 4:
        h = _doubled(h, width)
        width *= 2
    t, view = width, w
    while len(sizes) and EXPONENT * (2 * t - 1) <= int(size_of.max(initial=0)):
        alive = size_of >= EXPONENT * (2 * t - 1)
        if alive.sum() < 0.7 * len(alive):
            view, place, size_of, h = view[alive], place[alive], size_of[alive], h[alive]
        start, length, period = found.arrays()
        periodic = (3 * period <= t) & (length >= t)
        mark = np.zeros(len(w) + 1, np.int64)
        np.add.at(mark, start[periodic], 1)
        np.add.at(mark, start[periodic] + length[periodic] - t + 1, -1)
        omitted = np.cumsum(mark)[place] > 0
        twice = _doubled(h, t)
        at = synchronising_set(h, t, omitted)
        distance, position = _pairs(at, twice[at], 2 * t - 1, 4 * t - 2)
        now, upto = 0, -1
        for d, s in zip(distance.tolist(), position.tolist(), strict=True):
            if d != now:
                now, upto = d, -1
            if s < upto:
                continue  # inside the stretch just extended
            a, z = _equal_from(view, s, d), _equal_until(view, s, d)
            upto = z
            if z > a:
                found.add(int(place[a]), z - a + d, d)
        h, t = twice, 2 * t
    start, length, period = found.arrays()
    text = np.searchsorted(first, start, "right") - 1
    order = np.lexsort((period, start))
    return text[order], (start - first[text])[order], length[order], period[order]


def _kept(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Marks the words that no run contains after its first period."""
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, start + period, 1)
    np.add.at(mark, start + length, -1)
    return np.cumsum(mark[:-1]) == 0


def _searched(texts: list[list[bytes]]) -> tuple[list[list[dict]], list[bytes]]:
    """The runs and the remaining words of each text."""
    codes: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], np.int64)
    count = itertools.count()
    words = np.fromiter(map(codes.setdefault, itertools.chain.from_iterable(texts), count), np.int64, int(sizes.sum()))
    text, start, length, period = find_runs(words, sizes)
    long = length >= np.maximum(MIN_WORDS, EXPONENT * period)
    text, start, length, period = text[long], start[long], length[long], period[long]
    runs: list[list[dict]] = [[] for _ in texts]
    left = [b" ".join(t) if not len(text) else b"" for t in texts]
    begin, end = np.searchsorted(text, np.arange(len(texts))), np.searchsorted(text, np.arange(len(texts)), "right")
    for i, t in enumerate(texts):
        a, z = begin[i], end[i]
        if a == z:
            left[i] = b" ".join(t)
            continue
        runs[i] = [{"start": s, "length": n, "period": q} for s, n, q in
                   zip(start[a:z].tolist(), length[a:z].tolist(), period[a:z].tolist(), strict=True)]
        left[i] = b" ".join(itertools.compress(t, _kept(len(t), start[a:z], length[a:z], period[a:z])))
    return runs, left


RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: all runs of every whole text by start and period, and the text without
    the words that repeat one of them (bytes, joined by one blank)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.BinaryType())])
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, column = b.column("doc_id"), b.column("text")
            held, n, size, begun = [], 0, 0, 0
            for i in range(b.num_rows):
                raw = column[i].as_py()
                held.append(raw.split())  # bytes split at ASCII white space alone
                n += len(held[-1])
                size += len(raw)
                if n >= JOINED_WORDS or size >= SEND_BYTES or i + 1 == b.num_rows:
                    runs, left = _searched(held)
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(begun, len(held)), pa.array([len(t) for t in held], pa.int64()),
                         pa.array(runs, run_type), pa.array(left, pa.binary())], names=["doc_id", "n_words", "runs", "collapsed"])
                    held, n, size, begun = [], 0, 0, i + 1
    return in_arrow(rows, work, schema)


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with a run planted in the texts whose id's crc32 ends in 0 (none where the id is null):
    from word a = g % n on, the text repeats its words a ... a + p - 1, with g = crc32 / 10 and p = 1 + (n - a) / (3 + g % 8)."""
    rows = docs.select("doc_id", F.col("doc_id").cast("string").alias("id"), F.col("text").cast("binary").alias("text"))
    schema = rows.select("doc_id", "text").schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_plant(i, t) for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "text"])
    return in_arrow(rows, work, schema).select("doc_id", F.col("text").cast("string").alias("text"))


def _plant(doc_id: str | None, text: bytes | None) -> bytes | None:
    h = zlib.crc32(doc_id.encode()) if doc_id is not None else 1
    if h % 10 or not text or not (words := text.split()):
        return text
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(words[:a] + list(itertools.islice(itertools.cycle(words[a:a + p]), n - a)))


def _best(runs: Column) -> Column:
    """The run of the greatest length / period, the first of equals; null if there is none."""
    def better(best: Column, r: Column) -> Column:
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    return F.aggregate(runs, F.lit(None).cast(RUN), better)


def digests(docs: DataFrame) -> DataFrame:
    """The runs of every text, planted ones included, as counts, the best run and digests."""
    found = periodic_runs(planted(docs)).withColumn("best", _best(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                                                      r["period"].cast("string")))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    best = F.col("best")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
