"""Language ID (operator 5): interpolated Kneser-Ney character models in sorted hash arrays.

Texts are lower-cased and reduced to letters with one boundary between words; the models see
the letters of the current word (order ``ORDER``).  They are fitted on a sample of labelled
rows of about ``TRAIN_ROWS`` rows per language (hash-drawn; rows of over ``TRAIN_CHARS``
characters don't train), counted by Spark; the driver turns the counts into one pair of
sorted hash arrays per language and order.  A text gets the language of the lowest
cross-entropy per symbol.  ``rejected`` marks texts whose best cross-entropy lies beyond
the bound of that language and length, plus a margin.  The bound is a high quantile over the
sample's calibration fold, scored by models without the counts of that fold.

Defined results: null texts and texts without a letter are ``und`` with score 0 and count as
rejected; rows with a null ``lang`` don't train but are predicted; ties go to the smaller
language name; without any labelled row every text is ``und``; extra columns are ignored, whatever their names;
repeated rows get equal results; a text of any length is scored whole, piece by piece; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, in_arrow, stored

ORDER, DISCOUNT = 4, 0.75
#: Expected rows per language that train, and the longest of them.
TRAIN_ROWS, TRAIN_CHARS = 2000, 200_000
#: Symbols a language may use beyond those it has shown.
UNSEEN = 1 << 12
#: Characters handled at a time; longer texts are cut at blanks.
SLICE_CHARS = 1 << 18
#: One row of so many of the sample calibrates; the quantile that is the bound (the next lower row's).
CALIBRATE, QUANTILE = 5, 0.95
#: Nats per symbol beyond the bound that reject a text.
MARGIN = 0.5
_MULT = np.uint64(0x9E3779B97F4A7C15)
_WORKER: dict = {}


def _letters() -> np.ndarray:
    if "letters" not in _WORKER:
        _WORKER["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _WORKER["letters"]


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts (0 is the boundary before and between words) and each text's count.

    Every text starts with a boundary that belongs to no word and ends with one that does.
    """
    lowered = [t.lower() + "\n" for t in texts]
    joined = "".join(lowered)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sym = np.where(_letters()[points], points, 0)
    lens = np.fromiter(map(len, lowered), np.int64, len(lowered))
    keep = sym > 0
    keep[1:] |= sym[:-1] > 0
    ends = np.cumsum(lens)
    kept = np.cumsum(keep)
    return sym[keep], np.diff(np.r_[0, kept[ends - 1]]) if len(ends) else ends


def windows(sym: np.ndarray) -> list[np.ndarray]:
    """The symbol at 0, 1, ... ORDER-1 places before each place; nothing reaches past a boundary."""
    out, alive = [sym.astype(np.uint64)], np.ones(len(sym), bool)
    for j in range(1, ORDER):
        back = np.zeros(len(sym), np.uint64)
        back[j:] = sym[:-j] if j < len(sym) else 0
        back = np.where(alive, back, 0)
        alive = back > 0
        out.append(back)
    return out


def hashes(win: list[np.ndarray]) -> list[np.ndarray]:
    """Hash of the n-gram that ends at each place, for n = 1 ... len(win)."""
    out, h, power = [], np.zeros(len(win[0]), np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for w in win:
            h = h + (w + np.uint64(1)) * power
            power = power * _MULT
            x = h * np.uint64(0xD6E8FEB86659FD93)
            out.append(x ^ (x >> np.uint64(32)))
    return out


class Model:
    """One language: per order, sorted n-gram hashes with log probabilities and sorted context
    hashes with log back-off weights."""

    def __init__(self, win: list[np.ndarray], counts: np.ndarray):
        levels = [(win, counts.astype(np.float64))]
        for n in range(ORDER - 1, 0, -1):
            rows = np.stack(levels[-1][0][:n])
            kinds, count = np.unique(rows, axis=1, return_counts=True)
            levels.append((list(kinds), count.astype(np.float64)))
        levels.reverse()
        self.ngrams, self.contexts = [], []
        lower = None
        for n, (w, c) in enumerate(levels, 1):
            own = hashes(w)[-1]
            ctx = hashes(w[1:])[-1] if n > 1 else np.zeros(len(own), np.uint64)
            kinds, place = np.unique(ctx, return_inverse=True)
            total = np.bincount(place, weights=c)
            types = np.bincount(place)
            back = DISCOUNT * types / total
            if n == 1:
                low = np.full(len(own), 1.0 / (len(own) + UNSEEN))
                self.floor = float(np.log(back[0]) - np.log(len(own) + UNSEEN))
            else:
                keys, probs = lower
                low = probs[np.searchsorted(keys, hashes(w[:n - 1])[-1])]
            p = np.maximum(c - DISCOUNT, 0) / total[place] + back[place] * low
            order = np.argsort(own)
            lower = own[order], p[order]
            self.ngrams.append((own[order], np.log(p[order]).astype(np.float32)))
            self.contexts.append((kinds, np.log(back).astype(np.float32)))

    def log_probability(self, grams: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """Of n-grams given as hashes per order; ``contexts`` are those of the symbols before."""
        out = np.zeros(len(grams[0]), np.float64)
        todo = np.arange(len(out))
        for n in range(ORDER, 0, -1):
            keys, values = self.ngrams[n - 1]
            h = grams[n - 1][todo]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            out[todo[hit]] += values[at[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
            if n > 1:
                keys, values = self.contexts[n - 1]
                h = contexts[n - 2][todo]
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                out[todo] += np.where(keys[at] == h, values[at], 0)
            else:
                out[todo] += self.floor
        return out


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > SLICE_CHARS:
        cut = text.rfind(" ", at + SLICE_CHARS // 2, at + SLICE_CHARS)
        cut = cut if cut > 0 else at + SLICE_CHARS
        yield text[at:cut]
        at = cut
    yield text[at:]


def cross_entropies(models: list[Model], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Nats per symbol (texts x languages) and the symbol counts; slices bound the memory."""
    import pandas as pd
    total, count = np.zeros((len(texts), len(models))), np.zeros(len(texts), np.int64)

    def add(held: list[str], owner: list[int]) -> None:
        sym, n = symbols(held)
        if not len(sym):
            return
        win = windows(sym)
        place, kinds = pd.factorize(hashes(win)[-1])
        first = np.empty(len(kinds), np.int64)
        first[place[::-1]] = np.arange(len(place) - 1, -1, -1)
        few = [w[first] for w in win]
        grams, contexts = hashes(few), hashes(few[1:])
        ends, running = np.cumsum(n), np.zeros(len(sym) + 1)
        for k, m in enumerate(models):
            np.cumsum(m.log_probability(grams, contexts)[place], out=running[1:])
            np.add.at(total[:, k], owner, running[ends] - running[ends - n])
        np.add.at(count, owner, n)

    held, owner, size = [], [], 0
    for i, t in enumerate(texts):
        for piece in _pieces(t):
            held.append(piece)
            owner.append(i)
            size += len(piece)
            if size >= SLICE_CHARS:
                add(held, owner)
                held, owner, size = [], [], 0
    if held:
        add(held, owner)
    return -total / np.maximum(count, 1)[:, None], count


def train_rows(docs: DataFrame, rows_per_lang: int = TRAIN_ROWS) -> DataFrame:
    """The drawn sample ``doc_id, lang, text``: labelled rows outside the held-out fold."""
    usable = docs.select("doc_id", "lang", "text").where(crc_remainder("doc_id", 5) != 0).where("lang is not null and text is not null")
    # stored, so that Spark knows its size and the texts need no shuffle to meet it
    share = stored(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("_rows")), "langid-langs").withColumnRenamed("lang", "_lang")
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = usable.join(share, usable["lang"] == share["_lang"]).where(draw * F.col("_rows") < rows_per_lang)
    return stored(drawn.where(F.length("text") <= TRAIN_CHARS).select("doc_id", "lang", "text"), "langid-sample")


def _in_fold() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(CALIBRATE)) == 0


def _ngram_counts(sample: DataFrame) -> DataFrame:
    """``lang, c0 ..., n, n_fold``: counts over the sample, and over its calibration fold alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, texts = np.array(b.column(0).to_pylist(), object), b.column(1).to_pylist()
            folds = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for lang, in_fold in sorted(set(zip(langs.tolist(), folds.tolist(), strict=True))):
                held, size = [], 0
                own = [p for i in np.flatnonzero((langs == lang) & (folds == in_fold)) for p in _pieces(texts[i])]
                for n, piece in enumerate(own, 1):
                    held.append(piece)
                    size += len(piece)
                    if size < SLICE_CHARS and n < len(own):
                        continue
                    sym, _ = symbols(held)
                    held, size = [], 0
                    if len(sym):
                        kinds, count = np.unique(np.stack(windows(sym)), axis=1, return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(count)), *(pa.array(k.astype(np.int64)) for k in kinds), pa.array(count),
                             pa.array(count * in_fold)],
                            names=["lang", *(f"c{j}" for j in range(ORDER)), "n", "n_fold"])

    cols = [f"c{j}" for j in range(ORDER)]
    marked = sample.select("lang", "text", F.coalesce(_in_fold(), F.lit(False)))
    counted = in_arrow(marked, run, "lang string, " + ", ".join(f"{c} long" for c in cols) + ", n long, n_fold long")
    return counted.groupBy("lang", *cols).agg(F.sum("n").alias("n"), F.sum("n_fold").alias("n_fold"))


class Identifier:
    """Models of all learned languages and the calibrated rejection bounds."""

    def __init__(self, langs: list[str], models: list[Model]):
        self.langs, self.models, self.bounds = langs, models, np.full((len(langs), 64), np.inf)

    def best(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language index (-1: none), score, cross-entropy and symbol count of every text."""
        if not self.models:
            none = np.zeros(len(texts))
            return np.full(len(texts), -1), none, none, none.astype(np.int64)
        ce, n = cross_entropies(self.models, texts)
        at = ce.argmin(axis=1)
        low = ce[np.arange(len(texts)), at]
        score = 1 / np.exp(-(ce - low[:, None]) * np.minimum(n, 50)[:, None]).sum(axis=1)
        return np.where(n > 0, at, -1), np.where(n > 0, score, 0.0), low, n

    def rejected(self, at: np.ndarray, ce: np.ndarray, n: np.ndarray) -> np.ndarray:
        if not self.langs:
            return at < 0
        return (at < 0) | (ce > self.bounds[at, _bins(n)] + MARGIN)


def _bins(n: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(n, 1)).astype(int)


def calibrated(at: np.ndarray, ce: np.ndarray, n: np.ndarray, langs: int) -> np.ndarray:
    """Bounds (languages x length bins) from the language, cross-entropy and symbols of calibration rows.

    A bin without rows of its language takes the bound of the language's next longer bin that
    has some, else of the next shorter one; a language without rows takes all languages' rows.
    """
    bins, bounds = _bins(n), np.full((langs, 64), np.inf)
    for k in range(langs):
        mine = at == k if (at == k).any() else at >= 0
        own = {int(b): float(np.quantile(ce[mine & (bins == b)], QUANTILE, method="lower")) for b in np.unique(bins[mine])}
        for b in range(64 if own else 0):
            near = min((x for x in own if x >= b), default=max(own))
            bounds[k, b] = own[near]
    return bounds


def fit(docs: DataFrame, rows_per_lang: int = TRAIN_ROWS) -> Identifier:
    sample = train_rows(docs, rows_per_lang)
    # at most the n-grams of the bounded sample
    got = _ngram_counts(sample).toArrow()
    lang = np.array(got.column("lang").to_pylist(), object)
    cols = [got.column(f"c{j}").to_numpy().astype(np.uint64) for j in range(ORDER)]
    counts, fold = got.column("n").to_numpy(), got.column("n_fold").to_numpy()
    langs = sorted(set(lang))

    def models(n: np.ndarray) -> Identifier:
        named = [x for x in langs if n[lang == x].any()]
        return Identifier(named, [Model([c[(lang == x) & (n > 0)] for c in cols], n[(lang == x) & (n > 0)]) for x in named])

    who = models(counts)
    if not langs:
        return who
    apart = models(counts - fold)
    # a sample too small for both parts calibrates on all its rows
    drawn = sample.where(_in_fold()) if fold.any() and apart.langs == langs else sample
    shared = docs.sparkSession.sparkContext.broadcast(apart if apart.langs == langs else who)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, _, ce, m = shared.value.best(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(ce), pa.array(m, pa.int64())], names=["at", "ce", "n"])

    # three numbers per row of the bounded sample
    rows = in_arrow(drawn.select("text"), run, "at long, ce double, n long").where("at >= 0").toArrow()
    who.bounds = calibrated(*(rows.column(c).to_numpy() for c in ("at", "ce", "n")), len(langs))
    return who


def identify(docs: DataFrame, who: Identifier) -> DataFrame:
    """``docs`` columns ``doc_id`` with ``lang_pred, score, rejected`` per row."""
    shared = docs.sparkSession.sparkContext.broadcast(who)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        names = np.array([*w.langs, "und"], object)
        for b in batches:
            at, score, ce, n = w.best([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(names[at].tolist(), pa.string()), pa.array(score),
                 pa.array(w.rejected(at, ce, n))], names=["doc_id", "lang_pred", "score", "rejected"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(
        docs.select("doc_id", "text"), run, f"doc_id {ids}, lang_pred string, score double, rejected boolean")


def predict(docs: DataFrame) -> DataFrame:
    """Fit on ``docs`` outside the held-out fold and predict every row."""
    return (identify(docs, fit(docs)).withColumn("held_out", crc_remainder("doc_id", 5) == 0)
            .select("doc_id", "held_out", "lang_pred", "score", "rejected"))


def keep_known(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose text some learned language explains; the text is read once."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            at, _, ce, n = w.best([t or "" for t in b.column(place).to_pylist()])
            yield b.filter(pa.array(~w.rejected(at, ce, n)))

    return in_arrow(docs, run, docs.schema)
