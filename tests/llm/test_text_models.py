import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from infosieve.llm import context_mixing, decontam, langid, pii

from .helpers import EDGES, SF, documents, tuples


def rows_of(spark, n=None):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    return rows[:n]


# --- language ID

def slow_kneser_ney(sym_lists, order=langid.ORDER, d=langid.DISCOUNT):
    """Probabilities by dictionaries over tuples of symbols."""
    def grams(s):
        for i in range(len(s)):
            back, alive = [s[i]], True
            for j in range(1, order):
                x = s[i - j] if alive and i >= j else 0
                alive = alive and x > 0
                back.append(x)
            yield tuple(back)
    counts = [None] * (order + 1)
    counts[order] = Counter(g for s in sym_lists for g in grams(s))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter({g[:n] for g in ()})
        for g in counts[n + 1]:
            counts[n][g[:n]] += 1
    def p(g):
        n = len(g)
        if n == 0:
            return 1 / (len(counts[1]) + langid.UNSEEN)
        same = {k: v for k, v in counts[n].items() if k[1:] == g[1:]}
        if not same:
            return p(g[:-1])
        total = sum(same.values())
        return max(same.get(g, 0) - d, 0) / total + d * len(same) / total * p(g[:-1])
    return p, grams


def test_model_equals_dictionaries():
    texts = ["the cat sat on the mat", "a cat and a hat", "the end"]
    syms = [langid.symbols([t])[0].tolist() for t in texts]
    win = [np.concatenate(x) for x in zip(*(langid.windows(np.array(s)) for s in syms), strict=True)]
    kinds, n = np.unique(np.stack(win), axis=1, return_counts=True)
    model = langid.Model(list(kinds), n)
    p, grams = slow_kneser_ney(syms)
    for probe in ("the hat", "zebra cat", "sat on", "q"):
        s = langid.symbols([probe])[0]
        ce, count = langid.cross_entropies([model], [probe])
        assert count[0] == len(s)
        assert ce[0, 0] == pytest.approx(-sum(math.log(p(g)) for g in grams(s.tolist())) / len(s), rel=1e-5)


def test_symbols_keep_letters_and_one_boundary():
    sym, n = langid.symbols(["  Ab,, c1d ", "", "123", "É"])
    assert n.tolist() == [7, 0, 0, 2]
    assert "".join(chr(c) if c else "_" for c in sym) == "ab_c_d_é_"


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(df).join(df.select("doc_id", "lang"), "doc_id").toPandas()
    for r in got.itertuples():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = got[got.held_out]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all() and got.rejected.mean() < 0.01


def test_language_of_edges(spark):
    rows = [*EDGES, *((50 + i, "der die das und nicht " * 5, "de", "x") for i in range(20)),
            *((90 + i, "the and of with that " * 5, "en", "x") for i in range(20))]
    got = {r["doc_id"]: r for r in langid.predict(documents(spark, rows)).collect()}
    assert len(got) == len({r[0] for r in rows})
    for d in (2, 3, 4, 10):
        expected = "und" if not re.search(r"[^\W\d_]", next(t or "" for i, t, _, _ in rows if i == d)) else None
        assert expected is None or (got[d]["lang_pred"], got[d]["score"], got[d]["rejected"]) == ("und", 0.0, True)
    assert got[55]["lang_pred"] == "de" and got[95]["lang_pred"] == "en"
    kept = langid.keep_known(documents(spark, rows))
    assert kept.columns == documents(spark).columns
    assert {2, 3, 4}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_other_scripts_are_rejected(spark):
    rows = [*rows_of(spark), (10_000, "日本語の文章はここにあります " * 20, None, "x"), (10_001, "ξενοδοχείο θάλασσα ουρανός " * 20, None, "x")]
    got = {r["doc_id"]: r["rejected"] for r in langid.predict(documents(spark, rows)).collect()}
    assert got[10_000] and got[10_001] and sum(got.values()) <= 4


def test_language_without_training_rows(spark):
    rows = [(1, "text", None, "a")]
    assert [r["lang_pred"] for r in langid.predict(documents(spark, rows)).collect()] == ["und"]
    assert langid.predict(documents(spark, []).limit(0)).count() == 0


def test_long_texts_are_cut_at_blanks(monkeypatch):
    monkeypatch.setattr(langid, "SLICE_CHARS", 64)
    text = " ".join(f"wort{chr(97 + i % 26)}" for i in range(200))
    assert "".join(langid._pieces(text)) == text and max(map(len, langid._pieces(text))) <= 64


# --- decontamination

def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_equals_the_table():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(1, 20))] for _ in range(2))
        bench = decontam.Benchmark([(1, " ".join(a))])
        bench.weigh(np.zeros(len(bench.keys)), 1)
        seq = bench.numbers([" ".join(b)])[0]
        assert bench.lcs(0, seq[seq >= 0].tolist()) == slow_lcs(a, b)


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def passages(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


def test_every_verbatim_item_is_found(spark):
    docs, items = rows_of(spark), [(r["item_id"], r["text"]) for r in passages(spark).collect()]
    def joined(t):
        return " " + " ".join(words(t)) + " "
    want = {(d, i) for d, t, *_ in docs for i, x in items if joined(x) in joined(t)}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(documents(spark, docs), passages(spark)).collect()}
    assert got == want and want


def test_paraphrases_are_found_and_clean_texts_left(spark):
    rng = random.Random(2)
    items = [(r["item_id"], words(r["text"])) for r in passages(spark).collect()]
    items = [x for x in items if len(x[1]) >= 20]
    docs = rows_of(spark, 100)
    filler = [words(t) for _, t, *_ in docs]
    planted, want = [], set()
    for k, (i, w) in enumerate(items):
        kept = [x for x in w if rng.random() > 0.12]
        around = rng.choice(filler)
        at = rng.randint(0, len(around))
        planted.append((5000 + k, " ".join([*around[:at], *kept, *around[at:]]), None, None))
        want.add((5000 + k, i))
    shuffled = [(6000 + k, " ".join(rng.sample(w, len(w))), None, None) for k, (_, w) in enumerate(items)]
    got = {(r["doc_id"], r["item_id"]) for r in
           decontam.contaminated(documents(spark, docs + planted + shuffled), passages(spark)).collect()}
    assert len(want - got) <= 0.1 * len(want)
    assert not [d for d, _ in got if d >= 6000]


def test_contamination_of_edges(spark):
    bench = spark.createDataFrame([(1, "the cat sat on the mat and then the cat left"), (2, None), (3, ""), (4, "no id")],
                                  "item_id long, text string")
    got = decontam.contaminated(documents(spark), bench)
    assert sorted({(r["doc_id"], r["item_id"]) for r in got.collect()}, key=str) == [(1, 1), (6, 1), (None, 4)]
    clean = decontam.keep_clean(documents(spark), bench)
    assert clean.columns == documents(spark).columns and clean.count() == len(EDGES) - 4
    none = bench.limit(0)
    assert decontam.contaminated(documents(spark), none).count() == 0
    assert decontam.keep_clean(documents(spark), none).count() == len(EDGES)
    assert decontam.contaminated(documents(spark, []).limit(0), bench).count() == 0


# --- personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def slow_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c.isdigit()]
            check = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")),
                    "card": 12 <= len(digits) <= 19 and check % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(3)
    parts = [*"0123456789", ".", "@", "a", "b.c", "-", " ", "+", "(", ")", "é", "192.168.", "4111111111111111", "x@y.z"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == slow_spans(text)


def test_long_runs_take_linear_time():
    assert pii.base_spans("1" * 200_000 + "@" + "a" * 200_000) == []
    assert pii.base_spans("a" * 200_000 + "@b.c") == [(0, 0, 200_004)]


def test_personal_data_of_documents(spark):
    import hashlib
    rows = [*rows_of(spark), *EDGES]
    got = pii.find(documents(spark, rows)).collect()
    want = Counter()
    for d, t, *_ in rows:
        spans = slow_spans(t or "")
        text = ",".join(f"{pii.KINDS[k]}:{a}:{z}" for a, k, z in spans)
        want[(d, *(sum(s[1] == n for s in spans) for n in range(4)), hashlib.sha256(text.encode()).hexdigest())] += 1
        own = [r["spans"] for r in got if r["doc_id"] == d]
        assert all(set(filter(None, text.split(","))) <= set(s.split(",")) for s in own) or len(own) > 1
    assert Counter(tuple(r)[:6] for r in got) == want
    assert pii.find(documents(spark, []).limit(0)).count() == 0


def test_repeated_mentions_are_labelled_alike():
    """A hidden or broken mention takes the label of the whole one far away."""
    rng = random.Random(5)
    texts = []
    for _ in range(300):
        name = "".join(rng.choices("abcdefgh", k=6)) + str(rng.randint(10, 99))
        texts.append(f"write to {name}@mail{rng.randint(0, 9)}.example.com " + "the plain words go on " * 10
                     + f"again {name}@mail{rng.randint(0, 9)}.example.com or not 12 of {rng.randint(1, 99)}")
    graph, field = pii.Graph(), pii.Field()
    for i, t in enumerate(texts):
        graph.add(i, t, pii.base_spans(t))
    field.fit(graph)
    text = "write to bcadfe42@mail1.example.com " + "the plain words go on " * 10 + "again bcadfe42@mail1 or not 12 of 33"
    base, probe = pii.base_spans(text), pii.Graph()
    probe.add(0, text, base)
    assert probe.skip
    p = field.marginals(probe)
    mention = next(i for i, (a, z) in enumerate(probe.spans) if text[a:z] == "bcadfe42@mail1")
    alone = pii.Graph()
    alone.add(0, text[len("write to bcadfe42@mail1.example.com"):], [])
    q = field.marginals(alone)
    single = next(i for i, (a, z) in enumerate(alone.spans) if "bcadfe42" in text[len("write to bcadfe42@mail1.example.com"):][a:z])
    assert p[mention, 1] > q[single, 1] and p[mention, 1] > 0.5


def test_marginals_equal_enumeration():
    """On a tree, message passing is exact."""
    field = pii.Field()
    rng = np.random.default_rng(7)
    field.unary[:] = rng.normal(size=field.unary.shape)
    field.chain[:] = rng.normal(size=field.chain.shape)
    graph = pii.Graph()
    graph.add(0, "a 1 b", [])
    feats, _, chain, skip, fixed = graph.arrays()
    assert len(skip) == 0 and len(feats) == 3
    import itertools
    total = np.zeros((3, pii.LABELS))
    for y in itertools.product(range(pii.LABELS), repeat=3):
        s = sum(field.unary[feats[i]].sum(axis=0)[y[i]] + fixed[i] * field.chain[0][y[i]] for i in range(3))
        s += sum(field.chain[y[a], y[b]] for a, b in chain)
        for i in range(3):
            total[i, y[i]] += math.exp(s)
    assert np.allclose(field.marginals(graph), total / total.sum(axis=1, keepdims=True), atol=2e-3)


# --- language-model scoring

def slow_scores(rows):
    def tokens(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
        return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w] + [None]
    counts = Counter()
    for d, t in rows:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 10:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    for d, t in rows:
        own = tokens(t)
        yield (d, zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0, len(own), sum(counts[w] > 0 for w in own), n,
               round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), 6))


@pytest.mark.parametrize("heavy", [1e-6, 1e-2])
def test_base_scores(spark, heavy, monkeypatch):
    """With a large share almost every word takes the join instead of the broadcast."""
    monkeypatch.setattr(context_mixing, "HEAVY", heavy)
    rows = [*rows_of(spark, 80), *EDGES]
    got = context_mixing.score(documents(spark, rows)).collect()
    assert Counter((*tuple(r)[:5], round(r["base_score"], 6)) for r in got) == Counter(slow_scores([r[:2] for r in rows]))
    assert all(r["score"] < 0 for r in got)


def small_mixer(texts):
    spelled = np.zeros(257 * 257)
    for data, starts, _, last in context_mixing.slices(texts):
        spelled += np.bincount(context_mixing.spelled_pairs(data, starts, last, np.ones(len(starts), bool)), minlength=257 * 257)
    spelling = context_mixing.Spelling(spelled.reshape(257, 257))
    tables = [np.zeros(2 << bits, np.int64) for _, bits in context_mixing.ORDERS]
    for data, starts, _, last in context_mixing.slices(texts):
        keys, _ = spelling.keys(data, starts, last)
        _, step, index, _ = spelling.distinct(keys)
        for t, x in zip(tables, index, strict=True):
            np.add.at(t, (x.astype(np.int64) << 1) | (step & 1), 1)
    mixer = context_mixing.Mixer(spelling, [context_mixing.stretched(t) for t in tables])
    mixer.fit_gates(texts)
    return mixer


def test_tables_counted_in_spark_equal_plain_counts(spark):
    """Distinct numbers are counted first and their bits with that weight."""
    texts = [t for _, t, *_ in rows_of(spark, 30)]
    mixer = small_mixer(texts)
    plain = [np.zeros(2 << bits, np.int64) for _, bits in context_mixing.ORDERS]
    for data, starts, _, last in context_mixing.slices(texts):
        keys, _ = mixer.spelling.keys(data, starts, last)
        _, step, index, _ = mixer.spelling.distinct(keys)
        for t, x in zip(plain, index, strict=True):
            np.add.at(t, (x.astype(np.int64) << 1) | (step & 1), 1)
    docs = spark.createDataFrame([(bytearray(t.encode()),) for t in texts], "text binary").repartition(3)
    flat = np.zeros(sum(len(t) for t in plain) // 2, np.int16)
    size = context_mixing.CHUNK // 2
    for r in context_mixing.count_bits(docs, spark.sparkContext.broadcast(mixer.spelling)).collect():
        part = np.frombuffer(r["table"], np.int16)
        flat[r["chunk"] * size:r["chunk"] * size + len(part)] = part
    assert (flat == context_mixing.stretched(np.concatenate(plain))).all()


def test_known_hashes_are_found():
    rng = np.random.default_rng(8)
    keys = np.unique(np.r_[rng.integers(0, 1 << 63, 500, dtype=np.uint64), np.arange(40, dtype=np.uint64),
                           np.uint64(2 ** 64 - 1) - np.arange(30, dtype=np.uint64)])
    probe = np.r_[keys, rng.integers(0, 1 << 63, 500, dtype=np.uint64), np.array([50, 2 ** 64 - 40], np.uint64)]
    for some in (keys, keys[:1], keys[:0]):
        want = [int(np.flatnonzero(some == h)[0]) if h in some else -1 for h in probe]
        assert context_mixing.Known(some).find(probe).tolist() == want


def test_probabilities_of_all_next_symbols_sum_to_one(spark):
    """The tree's codes are complete, so the model is a distribution over symbols."""
    mixer = small_mixer([t for _, t, *_ in rows_of(spark, 20)])
    assert mixer.spelling.lens.shape == (257, 257)
    assert (2.0 ** -mixer.spelling.lens).sum(axis=1) == pytest.approx(1)


def test_pairs_of_symbols_follow_each_piece(monkeypatch):
    """Pieces of one text are not joined, and only a text's last piece has an end."""
    monkeypatch.setattr(context_mixing, "PIECE_BYTES", 8)
    texts = ["ab", None, "abcd efgh ijkl mnop", "ü\n\n"]
    want = Counter()
    for data, starts, owner, last in context_mixing.slices(texts):
        for s, e, i, x in zip(starts, np.r_[starts[1:], len(data)] - 1, owner, last, strict=True):
            syms = [256, *data[s:e].tolist(), *([256] if x else [])]
            if i != 0:
                want.update(257 * a + b for a, b in zip(syms, syms[1:], strict=False))
        got = context_mixing.spelled_pairs(data, starts, last, owner != 0)
        assert Counter(got.tolist()) == want


def test_model_beats_byte_frequencies(spark):
    """Held-out bits per byte lie far below the entropy of single bytes."""
    rows = rows_of(spark)
    got = [r for r in context_mixing.score(documents(spark, rows)).collect() if r["held_out"]]
    n = Counter(b"".join((t or "").encode() for _, t, *_ in rows))
    total = sum(n.values())
    entropy = -sum(c / total * math.log2(c / total) for c in n.values())
    assert -sum(r["score"] for r in got) * math.log2(10) / sum(r["n_bytes"] for r in got) < 0.75 * entropy


def test_pieces_of_very_long_texts(monkeypatch):
    monkeypatch.setattr(context_mixing, "PIECE_BYTES", 64)
    monkeypatch.setattr(context_mixing, "SLICE_BYTES", 100)
    text = " ".join(f"word{i}" for i in range(100))
    pieces = [(data[s:e].tobytes(), bool(x)) for data, starts, _, last in context_mixing.slices([text, None, "x" * 500])
              for s, e, x in zip(starts, np.r_[starts[1:], len(data)] - 1, last, strict=True)]
    assert b"".join(p for p, _ in pieces).decode() == text + "x" * 500
    assert sum(x for _, x in pieces) == 3


def test_scores_of_nothing(spark):
    assert context_mixing.score(documents(spark, []).limit(0)).count() == 0
    one = context_mixing.score(documents(spark, [(3, None, None, None)])).collect()
    assert len(one) == 1 and one[0]["n_tokens"] == 1
