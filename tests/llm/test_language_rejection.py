"""Rejection bounds."""

import random

import numpy as np

from infosieve.llm import langid

from .helpers import documents
from .test_text_models import rows_of


def test_bounds_are_quantiles_of_their_own_bin():
    at = np.zeros(41, np.int64)
    n = np.r_[np.full(21, 20), np.full(20, 300)]
    ce = np.r_[np.linspace(2.0, 2.2, 20), 9.0, np.full(20, 3.0)]
    bounds = langid.calibrated(at, ce, n, 2)
    assert 2.1 < bounds[0, 4] <= 2.2 and bounds[0, 8] == 3.0
    assert bounds[0, 3] == bounds[0, 4] and bounds[0, 6] == 3.0 and bounds[0, 30] == 3.0
    assert np.isfinite(bounds[1]).all()


def test_one_noisy_labelled_row_lets_no_gibberish_pass(spark):
    rng = random.Random(3)

    def noise(k):
        return " ".join("".join(rng.choices("qxzjvkwþðđžßñøœ", k=7)) for _ in range(k))
    rows = [r for r in rows_of(spark) if r[0] is not None]
    # probes have no label, so they neither train nor calibrate
    noisy = [(7_000_000 + i, noise(2000), "en", "a") for i in range(3)]
    probes = [(8_000_000 + i, noise(k), None, "a") for i, k in enumerate((20, 60, 200, 400))]
    got = {r["doc_id"]: r["rejected"] for r in langid.predict(documents(spark, rows + noisy + probes)).collect()}
    assert all(got[d] for d, *_ in probes)
    clean = [got[d] for d, t, *_ in rows if t]
    assert sum(clean) <= 0.02 * len(clean)
