"""Periodic runs against comparing every period directly."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from infosieve.llm import periodic, queries
from infosieve.llm.common import table

from .helpers import EDGES, SF, documents


def plain_runs(words, least=0):
    """All (start, length, smallest period) with three periods or more, by period."""
    n, seen, out = len(words), set(), []
    for p in range(1, n // 3 + 1):
        i = 0
        while i < n - p:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j - i + p >= 3 * p and (i, j - i + p) not in seen:
                seen.add((i, j - i + p))
                out.append((i, j - i + p, p))
            i = j
    return sorted((r for r in out if r[1] >= least), key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words, 24)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (
        "".join(f"{s},{length},{q}\n" for s, length, q in runs), " ".join(w for i, w in enumerate(words) if i not in gone))]
    return (doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, *sha)


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def by_text(rows):
    return sorted((tuple(r) for r in rows), key=str)


def random_words(rng):
    """Words with repetitions inside repetitions."""
    letters = rng.choice([1, 2, 3, 5, 50])

    def part(depth):
        if not depth:
            return [rng.randrange(letters) for _ in range(rng.randrange(1, 9))]
        x = [w for _ in range(rng.randrange(1, 3)) for w in part(depth - 1)] * rng.choice([1, 1, 2, 3, 4, 7])
        return x + x[:rng.randrange(len(x) + 1)]
    return part(rng.randrange(4))[:500]


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_direct_comparison(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = [random_words(rng) if rng.random() > 0.1 else [] for _ in range(rng.randrange(1, 8))]
        got = [[] for _ in texts]
        for i, *run in zip(*[x.tolist() for x in periodic.find_runs(
                np.array(sum(texts, []), np.int64), np.array([len(t) for t in texts], np.int64))]):
            got[i].append(tuple(run))
        assert got == [plain_runs(t) for t in texts]


def test_thue_morse_and_fibonacci_words():
    thue, fib = [0], [[0], [0, 1]]
    while len(thue) < 2048:
        thue += [1 - x for x in thue]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    # words whose halves collide in polynomial hashes; no cubes, and very many cubes
    for words in (thue, fib[-1], thue[:64] * 5 + fib[-1]):
        _, *got = periodic.find_runs(np.array(words, np.int64), np.array([len(words)]))
        assert list(zip(*[x.tolist() for x in got])) == plain_runs(words)


def test_long_text_with_long_and_short_periods():
    rng = random.Random(3)
    block = [rng.randrange(10 ** 6) for _ in range(20_000)]
    words = [1, 2] * 500 + block * 3 + block[:7] + [5] * 1000 + block[:100]
    _, start, length, period = periodic.find_runs(np.array(words, np.int64), np.array([len(words)]))
    got = set(zip(start.tolist(), length.tolist(), period.tolist()))
    assert {(0, 1000, 2), (1000, 60_007, 20_000), (61_007, 1000, 1)} <= got


def test_chosen_positions_depend_on_their_context_alone():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, 400)
    twice = np.r_[words, rng.integers(5, 9, 57), words]
    h, t = periodic._mixed(twice.astype(np.uint64)), 8
    for width in (1, 2, 4):
        h = periodic._doubled(h, width)
    at = set(periodic.synchronising_set(h, t, np.zeros(len(h), bool)).tolist())
    inside = range(400 - 2 * t)
    assert [i in at for i in inside] == [i + 457 in at for i in inside]
    assert all(any(i + k in at for k in range(t)) for i in range(300))


def test_edges(spark):
    rows = [*EDGES, (20, "a b \u0085 " * 40, "en", "a"), (21, "x " * 23, "en", None), (22, "x " * 24, "en", None),
            (23, "\x1f \x1f\n" * 30, "en", None), (24, " ".join(["p q r"] * 9), None, None)]
    got = periodic.digests(documents(spark, rows)).select(COLUMNS).collect()
    assert by_text(got) == by_text(plain_digest(i, t) for i, t, *_ in rows)


def test_query(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    got = queries.op11_periodic_runs(spark, SF).select(COLUMNS).collect()
    assert by_text(got) == by_text(plain_digest(*r) for r in docs)
    assert sum(r["n_runs"] > 0 for r in got) > 5


def test_empty_table(spark):
    assert periodic.digests(documents(spark, [])).count() == 0
