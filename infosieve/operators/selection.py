"""Iterative feature selection (mRMR, max relevance, custom scores), both layouts.

Plan per run:

1. one job validates the input and builds the class histogram;
2. one aggregation counts the candidate x class tables (A3, checkpointed) and turns them
   into the relevance terms; the per-feature state
   ``(feature, nnz, n_levels, lo, rel_*, red_*, max_*, min_*)`` is checkpointed to the shared folder;
3. each iteration takes the best ``select_top`` candidates from the state (a bounded
   top-k, only the winners reach the driver) and counts the candidate x winner tables in
   **one** pass over the data (newest winners only: redundancy is kept as a running sum,
   maximum and minimum).  The counts are checkpointed, so recovery and information read the
   small counts, never the data again; the state is checkpointed too, so lineage stays
   short and a lost executor only costs the current iteration.

A winner is paired on its support or on its zero rows only (``sparse_winners``) where that
reads fewer cells; results never depend on it.

Lazy redundancy (``lazy``): a score that can only fall while redundancy is added (``Score.bounded``) has
an upper bound for every candidate, its score with the redundancy counted so far.  An iteration then
counts, in batches of the highest bounds, only candidates whose bound reaches the best scores known, until
the best are certain.  The picks are the same; ``trace`` tells what was counted.  The redundancy of single
candidates is kept on the driver, at most ``lazy_limit`` of them; beyond that, or after
``LAZY_ROUNDS`` batches in one iteration, one pass counts all candidates and the state takes over.

Journal (``journal``, a folder that all executors reach): the class counts, the state and the picks of every
finished iteration are written there, the picks last.  A new driver that is given the same folder
goes on after the last finished iteration with the same result; the data must be the same.

``select_top`` is cut to the features still missing from ``k``, so exactly ``k`` features are
returned where enough candidates exist.

Ties are broken deterministically: ``round(score, 12)`` descending, then feature id ascending
(the user's key when keys are hashed).
"""

from __future__ import annotations

import json
import logging
import time
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .contingency import count_pairs, full_table, marginals, recover_missing_cells, recover_zero_other
from .information import FEW_CELLS, mi_from_pairs
from .journal import Journal
from .ranks import rank_terms
from .scores import CellTerm, JointAgg, RankTerm, Score, TablesTerm, VectorAgg, get_score


log = logging.getLogger("infosieve.selection")


def explain_string(df: DataFrame, mode: str = "formatted") -> str:
    """The text ``df.explain(mode)`` prints, for logging."""
    jvm = df.sparkSession.sparkContext._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


class _Clock:
    def __init__(self):
        self.t = time.perf_counter()

    def lap(self, what: str) -> None:
        now = time.perf_counter()
        log.info("%-28s %7.3fs", what, now - self.t)
        self.t = now


def _ordering(score_col: str = "score", by: str = "feature"):
    s = F.col(score_col)
    return [F.round(s, 12).desc_nulls_last(), F.col(by).asc()]


def _clean(c):
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c.cast("double"))


#: Batches of one iteration before all candidates are counted, and candidates from which "auto" is lazy.
LAZY_ROUNDS, LAZY_FROM = 5, 20_000


class Selector:
    """Run a selection over a layout; ``run()`` returns ``(rank, feature, score)``."""

    def __init__(self, layout, k: int, score="mrmr", broadcast_rows: int = 1_000_000,
                 all_zero: str = "drop", release_input: bool = True,
                 sparse_winners="auto", checkpoint_every: int = 1, lazy="auto", lazy_batch: int = 64,
                 lazy_limit: int = 10_000, journal: str | None = None):
        if k < 0:
            raise ValueError("k must be >= 0")
        if all_zero not in ("drop", "keep"):
            raise ValueError("all_zero must be 'drop' or 'keep'")
        self.layout = layout
        self.k = int(k)
        self.score: Score = get_score(score)
        self.broadcast_rows = broadcast_rows
        self.all_zero = all_zero
        self.release_input = release_input
        if sparse_winners not in ("auto", True, False, "zero_rows"):
            raise ValueError("sparse_winners must be 'auto', True, False or 'zero_rows'")
        self.sparse_winners = sparse_winners
        if checkpoint_every < 1:
            raise ValueError("checkpoint_every must be >= 1")
        self.checkpoint_every = checkpoint_every
        if lazy not in ("auto", True, False):
            raise ValueError("lazy must be 'auto', True or False")
        if lazy is True and not self.score.bounded:
            raise ValueError(f"the score {self.score.name!r} gives no upper bounds (Score.bounded)")
        self.lazy, self.lazy_batch, self.lazy_limit = lazy and self.score.bounded, int(lazy_batch), int(lazy_limit)
        self.trace: list[tuple] = []
        self.journal = Journal(journal) if journal else None
        layout.broadcast_rows = broadcast_rows
        self.terms = dict(self.score.terms)
        self.mi = any(v == "mi" for v in self.terms.values())
        self.cells = {k_: v for k_, v in self.terms.items() if isinstance(v, CellTerm)}
        self.vectors = {k_: v for k_, v in self.terms.items() if isinstance(v, VectorAgg)}
        self.joints = {k_: v for k_, v in self.terms.items() if isinstance(v, JointAgg)}
        self.whole = {k_: v for k_, v in self.terms.items() if isinstance(v, TablesTerm)}
        self.summed = [k_ for k_ in self.terms if k_ not in self.joints and k_ not in self.whole]
        if self.whole:
            self.lazy = False
        self.ranks = {k_: v for k_, v in self.terms.items() if isinstance(v, RankTerm)}
        if (self.vectors or self.joints) and not hasattr(layout, "vector_terms"):
            raise ValueError("vector scores need feature-wise input with dense value arrays")

    # ------------------------------------------------------------------------------------
    _selected: list = []

    def _raw_terms(self, pairs: DataFrame, keys: list, hist: DataFrame, hist_keys: list,
                   hist_rows: int, winners: list | None, table_cells: int | None = None) -> DataFrame:
        """Per (keys) table: every raw term of the score as a column ``t_<name>``.  MI, cell and rank
        terms come from the pair counts; vector terms from the value vectors."""
        out = mi_from_pairs(pairs, hist, self.n, keys, hist_keys, hist_rows, self.broadcast_rows,
                            cell_terms={k_: v.fn for k_, v in self.cells.items()}, table_cells=table_cells)
        out = out.select(*keys, "nnz", "n_levels", "lo", *([F.col("mi").alias("t_mi")] if self.mi else []),
                         *[F.col(k_).alias("t_" + k_) for k_ in self.cells])
        if self.ranks:
            whole = full_table(pairs, hist, keys, self.layout.zero, hist_keys) if self.layout.zero is not None else pairs
            out = out.join(rank_terms(whole, keys, {k_: v.kind for k_, v in self.ranks.items()}, "t_"), keys, "left")
        if self.vectors:
            vs = self.layout.vector_terms(winners, self.vectors, exclude=self._selected)
            vs = vs.select(*keys, *[F.col(k_).alias("t_" + k_) for k_ in self.vectors])
            out = out.join(vs, keys, "full")
        return out

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        """A checkpoint of ``df``, in the journal if there is one."""
        return df.checkpoint(eager=True) if self.journal is None else self.journal.write(df, name)

    def _whole_tables(self, pairs: DataFrame, hist: DataFrame, keys: list, hist_keys: list, place: int) -> DataFrame:
        """``feature, other, place, a, b, n, na, nb``: complete tables with their margins; the class has place 0."""
        full = (full_table(pairs, hist, keys, self.layout.zero, hist_keys) if self.layout.zero is not None
                else pairs.select(*keys, "a", "b", F.col("n").cast("long").alias("n")))
        other = F.col("other") if "other" in keys else F.lit(None).cast(self.layout.feature_type).alias("other")
        nb = hist.select(*hist_keys, "b", F.col("nb").cast("long").alias("nb"))
        na = full.groupBy(*keys, "a").agg(F.sum("n").alias("na"))
        # levels of different variables lie side by side, so they are told as text
        return (full.join(na, [*keys, "a"]).join(nb, [*hist_keys, "b"])
                .select("feature", other, F.lit(place).alias("place"), F.col("a").cast("string").alias("a"),
                        F.col("b").cast("string").alias("b"), "n", "na", "nb").checkpoint(eager=True))

    def _with_joints(self, state: DataFrame) -> DataFrame:
        """``state`` with the joint and table terms of the present selection as ``rel_<name>``."""
        for name, term in self.whole.items():
            cells = reduce(DataFrame.union, self._all_tables).withColumn("total", F.lit(int(self.n)))
            if self._selected:
                cells = cells.where(~F.col("feature").isin(list(self._selected)))
            cells = cells.withColumn("tile", F.pmod(F.xxhash64("place", "a"), F.lit(term.tiles)))
            got = term.fn(cells).select("feature", F.col("value").cast("double").alias("rel_" + name))
            state = state.drop("rel_" + name).join(got, "feature", "left")
        if not self.joints:
            return state
        got = self.layout.joint_terms(list(self._selected), self.joints)
        got = got.select("feature", *[F.col(k_).alias("rel_" + k_) for k_ in self.joints])
        return state.drop(*["rel_" + k_ for k_ in self.joints]).join(got, "feature", "left")

    _sizes = None

    def _state_sizes(self, state: DataFrame):
        """(non-zero cells, marginal rows, most levels of one candidate, candidates), one small job."""
        if self._sizes is None:
            r = state.agg(F.sum("nnz").alias("c"), F.sum("n_levels").alias("m"),
                          F.max("n_levels").alias("top"), F.count(F.lit(1)).alias("f")).first()
            self._sizes = (float(r["c"] or 0), float(r["m"] or 0), int(r["top"] or 0), int(r["f"] or 0))
        return self._sizes

    def _pair_on_support(self, support_rows: int, state: DataFrame) -> bool:
        """Cost rule for pairing on part of the rows (a winner's support, or its zero rows).
        The full pass touches every non-zero cell (C); the partial pass touches about
        C * rows / N cells plus a few passes over the candidates' marginal rows (M) to
        recover the skipped cells."""
        if self.sparse_winners in ("auto", "zero_rows"):
            cells, marg_rows, _, _ = self._state_sizes(state)
            return cells * support_rows / max(self.n, 1) + 4.0 * marg_rows < 0.5 * cells
        return bool(self.sparse_winners)

    def _pair_values(self, raw: DataFrame) -> dict:
        return self.score.pair_values({k_: F.coalesce(F.col("t_" + k_), F.lit(0.0)) for k_ in self.summed})

    # ------------------------------------------------------------------------------------
    def run(self) -> DataFrame:
        self._cached = []
        try:
            return self._run()
        finally:
            for df in self._cached:
                df.unpersist()
            if self.release_input and hasattr(self.layout, "unpersist"):
                self.layout.unpersist()

    def _run(self) -> DataFrame:
        lay = self.layout
        self._selected, self._sizes = [], None
        spark = lay.rows.sparkSession
        clock = _Clock()
        prep = lay.prepare(self.broadcast_rows)
        self.n = prep.n
        clock.lap("prepare")
        result: list = []
        ftype = lay.feature_type
        names_df = lay.names() if hasattr(lay, "names") else None
        out_type = lay.name_type if names_df is not None else ftype
        schema = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("feature", out_type),
                               T.StructField("score", T.DoubleType())])
        if self.all_zero == "keep" and (names_df is not None or lay.feature_ids() is None):
            raise ValueError("all_zero='keep' needs a layout that knows its features (columns, arrays, vectors, ids)")
        if self.k == 0 or self.n == 0:
            return spark.createDataFrame([], schema)

        # relevance: candidate x class tables (A3), one exchange of map-side combined counts
        # checkpointed (not cached): AQE sizes its partitions to the aggregated data, while a
        # cached plan keeps spark.sql.shuffle.partitions of them; it is read by the relevance
        # pass, the winners' histograms and the sparse-winner recovery
        found = self.journal.last(spark, self._settings()) if self.journal else None
        if found:
            self._ct = found["counts"]
        else:
            counted = lay.class_counts() if hasattr(lay, "class_counts") else count_pairs(lay.class_rows([]), ["feature"])
            self._ct = self._kept(counted, "counts")
        self._marg = None
        widest = self._ct.groupBy("feature").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0]
        raw = self._raw_terms(self._ct, ["feature"], prep.hist, [], prep.n_classes, None, int(widest or 0))
        rel = self._pair_values(raw)
        names = list(rel)
        state = raw.select("feature", F.coalesce("nnz", F.lit(0)).cast("long").alias("nnz"),
                           F.coalesce("n_levels", F.lit(0)).cast("long").alias("n_levels"),
                           "lo",
                           *[rel[c].alias("rel_" + c) for c in names],
                           *[F.lit(0.0).alias("red_" + c) for c in names])
        if self.all_zero == "keep":
            ids = lay.feature_ids().select(F.col("feature").cast(ftype).alias("feature"))
            zero_rel = self.score.pair_values({k_: F.lit(0.0) for k_ in self.summed})
            state = ids.join(state, "feature", "left").select(
                "feature", F.coalesce("nnz", F.lit(0)).cast("long").alias("nnz"),
                F.coalesce("n_levels", F.lit(0)).cast("long").alias("n_levels"), "lo",
                *[F.coalesce("rel_" + c, zero_rel[c]).alias("rel_" + c) for c in names],
                *[F.coalesce("red_" + c, F.lit(0.0)).alias("red_" + c) for c in names])
        if names_df is not None:
            # internal ids are hashes: carry the user's key for reporting and tie-breaking
            state = state.join(names_df, "feature")
        name_col = "name" if names_df is not None else "feature"
        state = state.select("*", *[F.lit(None).cast("double").alias(f"{e}_{c}") for e in ("max", "min") for c in names])
        self._all_tables = [self._whole_tables(self._ct, prep.hist, ["feature"], [], 0)] if self.whole else []
        state = found["state"] if found else self._kept(self._with_joints(state), "state-0000")
        expected = getattr(lay, "expected_cells", None)
        if expected is not None and not found:
            seen = state.agg(F.sum("nnz")).first()[0] or 0
            if int(seen) != expected:
                raise ValueError(f"{expected - int(seen)} cells lie outside the class vector's positions")
        clock.lap("relevance")
        selected: list = []           # internal ids (state, marginals)
        self._selected = selected
        self._names, self._named, self._state, self._picked, self._base = names, names_df is not None, state, [], 0
        self._fresh: dict = {}        # candidates counted on their own: sums, maxima and minima, winners counted
        if self.lazy == "auto":
            self.lazy = self._state_sizes(state)[3] >= LAZY_FROM and not self.vectors and not self.joints
        n_iter, start = self.score.max_iterations(self.k), 1
        if found:
            self._picked, self._base, start = found["picked"], found["base"], found["iteration"] + 1
            selected += [r["feature"] for r in self._picked]
            result += [(j, r["name"], r["score"]) for j, r in enumerate(self._picked, 1)]
            for j, r in enumerate(self._picked, 1):
                self._add_whole_tables([r], j)
        elif self.journal:
            self.journal.note(spark, 0, [], 0, "state-0000", self._settings(), self._picked_schema())
        for i in range(start, n_iter + 1):
            m = min(self.score.select_top(i, self.k), self.k - len(selected))
            if m <= 0:
                break
            top = self._best(i, m)
            clock.lap(f"iteration {i}: pick")
            if not top:
                break
            for r in top:
                selected.append(r["feature"])
                self._picked.append(r)
                result.append((len(selected), r["name"], r["score"]))
            if i == n_iter or len(selected) >= self.k or not self.score.uses_redundancy:
                continue
            self._add_whole_tables(top, len(selected) - len(top) + 1)
            if not names:
                # joint and table terms only: nothing is summed against single winners
                self._state = self._kept(self._with_joints(self._state), f"state-{i:04d}")
            elif not self.lazy:
                self._count_all(i)
            if self.journal:
                self.journal.note(spark, i, self._picked, self._base, self._state_name, self._settings(), self._picked_schema())
            clock.lap(f"iteration {i}: redundancy")
        return spark.createDataFrame(result, schema)

    # ------------------------------------------------------------------------------------
    def _settings(self) -> str:
        return json.dumps([self.n, self.k, self.score.name, sorted(self.terms), type(self.layout).__name__, self.all_zero])

    def _picked_schema(self) -> T.StructType:
        ftype, lay = self._state.schema["feature"].dataType, self.layout
        name = lay.name_type if self._named else ftype
        return T.StructType([T.StructField(c, t) for c, t in (
            ("feature", ftype), ("name", name), ("score", T.DoubleType()), ("nnz", T.LongType()), ("n_levels", T.LongType()),
            ("lo", self._state.schema["lo"].dataType))])

    @property
    def _state_name(self) -> str:
        return self.journal.name_of(self._state)

    def _add_whole_tables(self, top: list, place: int) -> None:
        """Keep the complete tables of all candidates with newly selected features, for table terms."""
        if self.whole:
            for j, r in enumerate(top):
                pairs, hist, _, _ = self._pairs([r])
                self._all_tables.append(self._whole_tables(pairs, hist, ["feature", "other"], ["other"], place + j))

    def _scored(self, i: int) -> DataFrame:
        """Every candidate with its score, an upper bound where ``upto`` winners of more are counted."""
        names, ends = self._names, ("max", "min")
        sums = [f"red_{c}" for c in names] + [f"{e}_{c}" for e in ends for c in names]
        state = self._state.withColumn("upto", F.lit(self._base))
        if self._selected:
            state = state.where(~F.col("feature").isin(self._selected))
        if self._fresh:
            spark = state.sparkSession
            kind = T.StructType([T.StructField("feature", self._state.schema["feature"].dataType)]
                                + [T.StructField("n_" + c, T.DoubleType()) for c in sums] + [T.StructField("n_upto", T.IntegerType())])
            own = spark.createDataFrame([(f, *values, upto) for f, (values, upto) in self._fresh.items()], kind)
            state = state.join(F.broadcast(own), "feature", "left").select(   # at most lazy_limit rows
                *[c for c in state.columns if c not in (*sums, "upto")],
                *[F.when(F.col("n_upto").isNull(), F.col(c)).otherwise(F.col("n_" + c)).alias(c) for c in sums],
                F.coalesce("n_upto", "upto").alias("upto"))
        red = {c: F.col("red_" + c) for c in names}
        red |= {f"{c}_{e}": F.coalesce(f"{e}_{c}", F.lit(0.0)) for e in ends for c in names}
        sc = _clean(self.score.column({c: F.col("rel_" + c) for c in [*names, *self.whole, *self.joints]}, red,
                                      len(self._selected), i, self.k))
        name = F.col("name" if self._named else "feature").alias("name")
        return state.select("feature", name, sc.alias("score"), "nnz", "n_levels", "lo", "upto", *sums)

    def _best(self, i: int, m: int) -> list:
        """The ``m`` best candidates; bounds that reach them are counted first."""
        batch, now, rounds = self.lazy_batch, len(self._selected), 0
        while True:
            rows = (self._scored(i).orderBy(*_ordering(by="name"))
                    .limit(m + (batch if self.lazy and now else 0)).collect())
            best, stale = [], []
            for r in rows:
                if r["upto"] == now or not self.lazy:
                    best.append(r)
                    if len(best) == m:
                        break
                else:
                    stale.append(r)
            if not stale:
                return best
            rounds += 1
            if rounds > LAZY_ROUNDS or len(self._fresh) + len(stale) > self.lazy_limit:
                self._count_all(i)
            else:
                self._count_some(i, rounds, stale)
                batch *= 2

    def _count_some(self, i: int, rounds: int, stale: list) -> None:
        """Count single candidates against the winners each has not met; the sums stay on the driver."""
        names, now = self._names, len(self._selected)
        first = min(r["upto"] for r in stale)
        winners = self._picked[first:]
        raw = self._tables(winners, stale)
        pv = self._pair_values(raw)
        met = raw.select("feature", "other", *[pv[c].alias(c) for c in names]).collect()
        values = {(r["feature"], r["other"]): [r[c] or 0.0 for c in names] for r in met}
        for r in stale:
            red = [r["red_" + c] for c in names]
            high, low = ([r[f"{e}_{c}"] for c in names] for e in ("max", "min"))
            for w in self._picked[r["upto"]:]:
                for j, v in enumerate(values.get((r["feature"], w["feature"]), [0.0] * len(names))):
                    red[j] += v
                    high[j] = v if high[j] is None else max(high[j], v)
                    low[j] = v if low[j] is None else min(low[j], v)
            self._fresh[r["feature"]] = [*red, *high, *low], now
        missing = [now - r["upto"] for r in stale]
        self.trace.append((i, rounds, len(stale), sum(missing), sum(int(r["nnz"]) * c for r, c in zip(stale, missing))))

    def _marginals(self) -> DataFrame:
        """``(feature, a, n)`` of all candidates; built on first need only (partial pairing)."""
        if self._marg is None:
            self._marg = marginals(self._ct, ["feature"]).checkpoint(eager=True)
        return self._marg

    def _winner_levels(self, top: list) -> tuple[DataFrame, int]:
        """``(other, b, nb)`` of some winners and a bound of its rows: their levels from the class pass, the
        zeros from the state."""
        lay, ftype = self.layout, self.layout.feature_type
        spark = lay.rows.sparkSession
        level_rows = T.StructType([T.StructField("other", ftype), T.StructField("b", lay.value_type),
                                   T.StructField("nb", T.LongType())])
        winners = [r["feature"] for r in top]
        zeros = [(r["feature"], lay.zero, self.n - int(r["nnz"])) for r in top] if lay.zero is not None else []
        if zeros and all(int(r["n_levels"]) <= 1 for r in top):
            # binary winners: the state knows both levels
            zeros += [(r["feature"], r["lo"], int(r["nnz"])) for r in top if r["lo"] is not None]
            hist = spark.createDataFrame([z for z in zeros if z[2] > 0], level_rows)
        else:
            of = self._marg if self._marg is not None else marginals(self._ct.where(F.col("feature").isin(winners)), ["feature"])
            hist = (of.where(F.col("feature").isin(winners))
                    .select(F.col("feature").alias("other"), F.col("a").alias("b"), F.col("n").alias("nb")))
            if zeros:
                hist = hist.unionByName(spark.createDataFrame(zeros, level_rows)).where(F.col("nb") > 0)
        return hist, sum(int(r["n_levels"]) for r in top) + len(top)

    def _tables(self, top: list, only: list | None = None) -> DataFrame:
        """Raw terms of the candidates (``only`` some) with the winners ``top``."""
        pairs, hist, hist_rows, cells = self._pairs(top, only)
        return self._raw_terms(pairs, ["feature", "other"], hist, ["other"], hist_rows, [r["feature"] for r in top], cells)

    def _pairs(self, top: list, only: list | None = None) -> tuple[DataFrame, DataFrame, int, int]:
        """Counts of the candidates (``only`` some) with the winners ``top``, the one pass over the data; the
        winners' histograms, a bound of their rows and of the cells of one table."""
        lay, ftype = self.layout, self.layout.feature_type
        winners = [r["feature"] for r in top]
        selected = list(self._selected)
        nnz = {r["feature"]: int(r["nnz"]) for r in top}
        sparse = dense = False
        if hasattr(lay, "winner_counts"):
            sparse = lay.zero is not None
            pairs = lay.winner_counts(winners, selected, sum(nnz.values()), None if only is None else [r["feature"] for r in only])
        else:
            if only is None:
                # a sparse winner (small support) is paired only on its support; the b = 0 cells
                # come from the candidates' marginals, so the pass reads a fraction of the cells
                mode = self.sparse_winners
                sparse = (lay.zero is not None and mode != "zero_rows"
                          and self._pair_on_support(sum(nnz.values()), self._state))
                # a dense binary winner is paired on its zero rows only; its one non-zero level is
                # recovered the same way (same cost rule, on the complement of the support)
                dense = (not sparse and lay.zero is not None and all(int(r["n_levels"]) == 1 for r in top)
                         and (mode == "zero_rows" or
                              self._pair_on_support(sum(self.n - x for x in nnz.values()), self._state)))
            kw = {"nnz": nnz} if getattr(lay, "winner_rows_takes_nnz", False) else {}
            if only is not None:
                kw["only"] = [r["name"] for r in only]
            pairs = count_pairs(lay.winner_rows([r["name"] for r in top], [r["name"] for r in self._picked],
                                                nonzero_only=sparse, zero_only=dense, **kw), ["feature", "other"])
        levels = max((int(r["n_levels"]) for r in only), default=0) if only is not None else self._state_sizes(self._state)[2]
        cells = levels * (1 + max(int(r["n_levels"]) for r in top))
        if sparse or dense or self.cells or self.ranks or self.whole or cells > FEW_CELLS:
            # recovery and several terms read the counts more than once, the data only here
            pairs = pairs.checkpoint(eager=True)
        marg = self._marginals if only is None else (
            lambda: marginals(self._ct.where(F.col("feature").isin([r["feature"] for r in only])), ["feature"]))
        if sparse:
            pairs = recover_zero_other(pairs, marg(), winners, selected, ftype, lay.zero)
        elif dense:
            pairs = recover_missing_cells(pairs, marg(), winners, selected, ftype, {r["feature"]: r["lo"] for r in top})
        hist, hist_rows = self._winner_levels(top)
        return pairs, hist, hist_rows, cells

    def _count_all(self, i: int) -> None:
        """Count every candidate against the winners the state does not hold yet."""
        names, top = self._names, self._picked[self._base:]
        raw = self._tables(top)
        pv = self._pair_values(raw)
        add = raw.groupBy("feature").agg(*[f(pv[c]).alias(f"{e}_add_{c}") for c in names
                                           for e, f in (("sum", F.sum), ("max", F.max), ("min", F.min))])
        state = self._state.join(add, "feature", "left").select(
            "feature", *(["name"] if self._named else []), "nnz", "n_levels", "lo",
            *["rel_" + c for c in names],
            *[(F.col("red_" + c) + F.coalesce(F.col("sum_add_" + c), F.lit(0.0))).alias("red_" + c)
              for c in names],
            *[f(F.col(f"{e}_{c}"), F.coalesce(F.col(f"{e}_add_{c}"), F.lit(0.0))).alias(f"{e}_{c}")
              for e, f in (("max", F.greatest), ("min", F.least)) for c in names])
        state = self._with_joints(state)
        if log.isEnabledFor(logging.DEBUG):
            log.debug("iteration %d plan:\n%s", i, explain_string(state))
        if self.journal or i % self.checkpoint_every == 0:
            # cut lineage: the next iterations (and a retry after a lost executor) start here
            state = self._kept(state, f"state-{i:04d}")
        else:
            # materialised by the next pick (one job instead of a write + a read)
            state = state.persist(StorageLevel.MEMORY_AND_DISK)
            self._cached.append(state)
        if self.lazy or self._sizes is not None:
            cells, _, _, candidates = self._state_sizes(self._state)
            self.trace.append((i, 0, candidates, candidates * len(top), int(cells) * len(top)))
        self._state, self._base = state, len(self._picked)
        self._fresh = {}

    def traced(self) -> DataFrame:
        """What a finished run has counted: ``(iteration, batch, candidates, tables, cells)``; batch 0 is a pass
        over all candidates, and cells are the candidates' non-zero cells times the winners they met."""
        return self.layout.rows.sparkSession.createDataFrame(
            self.trace, "iteration int, batch int, candidates long, tables long, cells long")


def select_features(layout, k: int, score="mrmr", **kw) -> DataFrame:
    """Convenience wrapper: ``Selector(layout, k, score, **kw).run()``."""
    return Selector(layout, k, score, **kw).run()
