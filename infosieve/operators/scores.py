"""Scores and selection policies.

A score turns per-candidate statistics into one number per iteration.  Statistics come as
*terms*: every term is measured once against the class (``rel[name]``) and, in each
iteration, against each newly selected feature; the running sums over the selected set are
``red[name]``, ``red[name + "_max"]`` and ``red[name + "_min"]`` the largest and smallest value
against one selected feature (0 while nothing is selected).  Six kinds of term exist:

* ``"mi"``                      - mutual information in bits (sparse closed form, any layout)
* ``CellTerm(fn)``             - ``sum over the non-zero cells of the full contingency table``
                                  of ``fn(n, na, nb, N)`` (zero cells recovered explicitly)
* ``VectorAgg(fn)``            - an aggregate ``fn(x, y)`` over the aligned value vectors of the
                                  candidate and the other variable (feature-wise input)
* ``RankTerm(kind)``           - ``"spearman"`` or ``"kendall"`` rank correlation (tau-b) of the two variables,
                                  ties by mean ranks; levels need an order, strings take their own
* ``TablesTerm(fn)``          - any function of a candidate's tables with the class and all selected features
                                  together; measured anew in each iteration, found in ``rel``
* ``JointAgg(fn)``             - an aggregate ``fn(x, y, s)`` over the aligned values of the candidate,
                                  the class and all selected features (a list, in selection
                                  order); measured anew in each iteration, found in ``rel``

Every term is a Spark aggregate, so custom scores stay distributed and JVM-side.
``select_top`` / ``max_iterations`` are the selection policy hooks.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CellTerm:
    fn: Callable[[Column, Column, Column, Column], Column]


@dataclass(frozen=True)
class VectorAgg:
    fn: Callable[[Column, Column], Column]


@dataclass(frozen=True)
class JointAgg:
    fn: Callable[[Column, Column, list], Column]


@dataclass(frozen=True)
class TablesTerm:
    """``fn(cells) -> (feature, value)`` sees the complete tables of every candidate at once: a DataFrame
    ``(feature, other, place, a, b, n, na, nb, total, tile)`` with a row per non-empty cell, zero levels included.  ``place`` is
    0 for the class (``other`` null) and 1, 2, ... for the selected features in order; levels are told as text;
    ``na`` and ``nb`` are the margins.  What is grouped by feature alone should be combinable (sums, maxima);
    for functions that need whole groups, ``(feature, tile)`` deals the levels ``a`` of each table out to ``tiles``
    groups, whose results ``fn`` merges."""

    fn: Callable
    tiles: int = 64


@dataclass(frozen=True)
class RankTerm:
    kind: str

    def __post_init__(self):
        if self.kind not in ("spearman", "kendall"):
            raise ValueError(f"unknown rank statistic {self.kind!r}")


class Score:
    """Base class.  Override ``column``; ``terms`` defaults to mutual information only."""

    name = "score"
    #: True says that the score never rises while the ``red`` sums and maxima grow (and minima are not
    #: used), for pair values of at least 0; then a partial redundancy gives an upper bound.
    bounded = False
    terms: dict = {"mi": "mi"}
    uses_redundancy = True

    def column(self, rel: dict, red: dict, n_selected: int, i: int, nfs: int) -> Column:
        raise NotImplementedError

    def pair_values(self, terms: dict) -> dict:
        """Per (candidate, other) values built from the raw terms; ``rel`` holds them against
        the class and ``red`` their sums over the selected features."""
        return dict(terms)

    def select_top(self, i: int, nfs: int) -> int:
        return 1

    def max_iterations(self, nfs: int) -> int:
        return nfs


class MRMR(Score):
    """MI(f, class) - c * sum_s MI(f, s); c = 1 for up to one selected feature, else 1/|S|."""

    name = "mrmr"
    bounded = True

    def column(self, rel, red, n_selected, i, nfs):
        coef = 1.0 if n_selected <= 1 else 1.0 / n_selected
        return rel["mi"] - F.lit(coef) * red["mi"]


class MaxRelevance(Score):
    """MI(f, class) only: one pass that takes ``nfs`` features at once."""

    name = "maxrel"
    uses_redundancy = False

    def column(self, rel, red, n_selected, i, nfs):
        return rel["mi"]

    def select_top(self, i, nfs):
        return nfs

    def max_iterations(self, nfs):
        return 1


class MIQ(Score):
    """Quotient form: MI(f, class) / (mean MI(f, s)); +inf while the redundancy is zero."""

    name = "miq"

    def column(self, rel, red, n_selected, i, nfs):
        if n_selected == 0:
            return rel["mi"]
        mean = red["mi"] / F.lit(float(n_selected))
        return F.when(F.round(mean, 12) > 0,  # rounding noise is no redundancy
                      rel["mi"] / mean).otherwise(F.lit(float("inf")))


class ExprScore(Score):
    """Score from a user function ``fn(rel, red, n_selected, i, nfs) -> Column``."""

    def __init__(self, fn, terms: dict | None = None, select_top: int = 1, max_iterations=None,
                 name: str = "expr", pair_values=None, bounded: bool = False):
        self.fn = fn
        self.bounded = bounded
        self.terms = dict(terms or {"mi": "mi"})
        self._pair = pair_values
        self._top = select_top
        self._max = max_iterations
        self.name = name

    def column(self, rel, red, n_selected, i, nfs):
        return self.fn(rel, red, n_selected, i, nfs)

    def pair_values(self, terms):
        return self._pair(terms) if self._pair else dict(terms)

    def select_top(self, i, nfs):
        return self._top(i, nfs) if callable(self._top) else self._top

    def max_iterations(self, nfs):
        if self._max is None:
            return -(-nfs // max(1, self.select_top(1, nfs))) if not callable(self._top) else nfs
        return self._max(nfs) if callable(self._max) else self._max


def chi2_term() -> CellTerm:
    """Pearson chi-square as a cell sum: N * sum n^2 / (na nb) - N (zero cells add nothing)."""
    return CellTerm(lambda n, na, nb, N: N * n * n / (na * nb) - n)


def entropy_terms() -> dict:
    """H(candidate), H(other) and MI as cell sums; symmetric uncertainty is 2 MI / (H1 + H2)."""
    def p(n, N):
        return n / N
    return {
        "mi": "mi",
        "hf": CellTerm(lambda n, na, nb, N: -p(n, N) * F.log2(na / N)),
        "ho": CellTerm(lambda n, na, nb, N: -p(n, N) * F.log2(nb / N)),
    }


def symmetric_uncertainty_mrmr() -> ExprScore:
    """mRMR with symmetric uncertainty SU = 2 MI / (H(f) + H(o)) in place of MI (a table score)."""
    def su(d):
        h = d["hf"] + d["ho"]
        return {"su": F.when(h > 0, 2.0 * d["mi"] / h).otherwise(F.lit(0.0))}

    def fn(rel, red, n_selected, i, nfs):
        coef = 1.0 if n_selected <= 1 else 1.0 / n_selected
        return rel["su"] - F.lit(coef) * red["su"]

    return ExprScore(fn, terms=entropy_terms(), name="su_mrmr", pair_values=su)


def max_redundancy_mrmr() -> ExprScore:
    """MI(f, class) minus the largest MI(f, s): a table score that is no sum over the selected."""
    return ExprScore(lambda rel, red, n, i, k: rel["mi"] - red["mi_max"], name="max_redundancy", bounded=True)


_REGISTRY = {
    "mrmr": MRMR, "maxrel": MaxRelevance, "miq": MIQ,
    # score class names accepted by the command-line job
    "InstanceWiseMRMR": MRMR, "FeatureWiseMRMR": MRMR, "InstanceWiseMaxRelevance": MaxRelevance,
}


def get_score(score) -> Score:
    if isinstance(score, Score):
        return score
    if isinstance(score, str):
        key = score.rsplit(".", 1)[-1]
        if key in _REGISTRY:
            return _REGISTRY[key]()
        raise ValueError(f"unknown score {score!r}; known: {sorted(_REGISTRY)}")
    raise TypeError(f"score must be a Score or a registered name, got {type(score).__name__}")


def register_score(name: str, factory) -> None:
    _REGISTRY[name] = factory
