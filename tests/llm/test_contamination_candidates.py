"""Candidates of decontamination."""

import random

import numpy as np
import pytest

from infosieve.llm import decontam

from .helpers import documents
from .test_text_models import passages, rows_of, slow_lcs, words


def brute_pairs(searcher, docs):
    """Pairs of documents and items of at least SHORT words by the answer and order checks on every window, without a cosine."""
    bench, found = searcher.bench, set()
    for d, seq in zip([d for d, *_ in docs], bench.numbers([t for _, t, *_ in docs]), strict=True):
        for i, item in enumerate(bench.seqs):
            seg = decontam.SEGMENT << int(searcher.level[i])
            for a in range(0, max(1, -(-len(seq) // seg) - 1) * seg, seg):
                part = [t for t in seq[a:a + 2 * seg].tolist() if t >= 0]
                if (len(item) >= decontam.SHORT and len(bench.answers[i].intersection(part)) >= bench.needed(i)
                        and slow_lcs(item.tolist(), part) >= decontam.LCS_SHARE * len(item)):
                    found.add((d, bench.ids[i]))
                    break
    return found


def test_diluted_and_short_items_are_found(spark):
    """Items among words of the benchmark, which pull the cosine down; recall against brute force is 1."""
    rng = random.Random(4)
    long = [[f"t{k}w{j}" for j in range(17)] for k in range(30)]
    short = [[f"s{k}a", f"s{k}b"] for k in range(10)]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(long + short)], "item_id long, text string")
    pool = [w for x in long for w in x]
    docs = []
    for k, x in enumerate(long):
        kept = [x[j] for j in sorted(rng.sample(range(17), 11))]
        docs.append((k, " ".join([rng.choice(pool)] * 12 + kept + [rng.choice(pool)] * 12), None, None))
    for k, x in enumerate(short):
        docs.append((100 + k, " ".join([rng.choice(pool)] * 15 + x + [rng.choice(pool)] * 15), None, None))
    found = decontam.contaminated(documents(spark, docs), bench)
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    searcher = decontam.fit(documents(spark, docs), bench)
    want = brute_pairs(searcher, docs) | {(100 + k, 30 + k) for k in range(len(short))}
    assert len(want) > 12 and got == want   # equally rare answer terms are taken by hash: 12 to 17 pairs


def test_no_pair_of_the_tables_is_lost(spark):
    docs = rows_of(spark, 60)
    searcher = decontam.fit(documents(spark, docs), passages(spark))
    shorts = {r["item_id"] for r in passages(spark).collect() if len(words(r["text"])) < decontam.SHORT}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(documents(spark, docs), passages(spark)).collect()}
    assert {p for p in got if p[1] not in shorts} == brute_pairs(searcher, docs)


def test_other_blanks_and_quotes_separate_words(spark):
    texts = ["quick brown　fox—jumped “over” the… ¿lazy? dog’s légère 日本 _x1", "plain words"]
    hashes, counts = decontam.word_hashes(texts)
    want = [w for t in texts for w in words(t)]
    assert counts.tolist() == [len(words(t)) for t in texts]
    assert hashes.tolist() == [decontam.word_hashes([w])[0][0] for w in want]
    passage = "the quick brown fox jumped over one lazy dog near the river bank while nobody watched it"
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = documents(spark, [(1, passage.replace(" ", " "), None, None), (2, "“" + passage.replace(" ", "　") + "”", None, None),
                             (3, "nothing of the kind", None, None)])
    assert {r["doc_id"] for r in decontam.contaminated(docs, bench).collect()} == {1, 2}
    assert {r["doc_id"] for r in decontam.keep_clean(docs, bench).collect()} == {3}


def plain_products(bench, docs, slots):
    """``A^T A`` of all passages and of the items, which weigh the same in total."""
    def row(part):
        r, sums = np.zeros(len(bench.keys)), np.zeros(slots)
        np.add.at(r, part[part >= 0], 1)
        r *= bench.idf
        np.add.at(sums, np.arange(len(r)) % slots, r / np.sqrt((r * r).sum()))
        return sums

    rows = [row(s[a:a + decontam.FIT_WORDS]) for s in bench.numbers([t for _, t, *_ in docs])
            for a in range(0, len(s), decontam.FIT_WORDS) if (s[a:a + decontam.FIT_WORDS] >= 0).any()]
    a, items = np.array(rows), np.array([row(s) for s in bench.seqs])
    return a.T @ a + max(1.0, len(a) / len(items)) * (items.T @ items)


@pytest.mark.parametrize("n_docs,n_words,slots,dense", [(3000, 60, 1 << 16, 4096), (300, 600, 1 << 16, 256), (300, 600, 500, 256)])
def test_latent_space_is_fitted_on_all_documents(spark, n_docs, n_words, slots, dense, monkeypatch):
    """Also with words beyond the dense places and with words that share vectors."""
    monkeypatch.setattr(decontam, "TERMS", slots)
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(n_words)]
    items = [(k, " ".join(rng.choices(vocab, k=n_words // 4))) for k in range(8)]
    # each tenth of the documents speaks of other words
    docs = [(k, " ".join(rng.choices(vocab[k % 10::10] + ["other", "words"], k=rng.choice([5, 30, 150]))), None, None)
            for k in range(n_docs)] + [(-1, None, None, None), (-2, "", None, None), (-3, "nothing known", None, None)]
    bench = decontam.Benchmark(items)
    df = np.sum([np.bincount(np.unique(s[s >= 0]), minlength=len(bench.keys)) for s in bench.numbers([t for _, t, *_ in docs])], axis=0)
    bench.weigh(df, len(docs))
    n = min(slots, len(bench.keys))
    space = decontam.latent_space(documents(spark, docs), bench, spark.sparkContext.broadcast(bench), n, dense)
    want = plain_products(bench, docs, n)
    values, turned = np.linalg.eigvalsh(want)[::-1], space.T @ want @ space
    assert np.allclose(turned, np.diag(values), atol=1e-4 * values[0])
