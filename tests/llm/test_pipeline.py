import hashlib

import corpus_pipeline
from infosieve.llm import langid

from .helpers import SF, documents
from .test_mixing_license import size, water
from .test_text_models import words
from .test_tokens_simhash import expected_digests, slow_components, slow_fingerprint


def copies(doc_id, rate):
    draw = int(hashlib.md5(f"mix:{doc_id}".encode()).hexdigest()[:13], 16) / 2 ** 52
    return int(rate) + (draw < rate - int(rate))


def test_pipeline_equals_its_stages_by_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r["doc_id"] for r in langid.predict(df).where("not rejected").collect()}
    rows = sorted((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect() if r["doc_id"] in known)
    roots = slow_components([slow_fingerprint(t) for _, t, *_ in rows])
    rows = [r for i, r in enumerate(rows) if roots[i] == i]
    items = [" " + " ".join(words(r["text"])) + " " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r in rows if not any(x in " " + " ".join(words(r[1])) + " " for x in items)]
    targets, sizes = water(rows)
    mixed = [(d, t) for d, t, _, s in rows for _ in range(copies(d, targets[s] / sizes[s] if sizes[s] else 0.0))]
    assert len({d for d, _ in mixed}) < len(known) and len(mixed) > len({d for d, _ in mixed})
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()), key=lambda r: r[1])
    assert got == expected_digests(mixed)
    assert all(size(t) > 0 for _, t in mixed)


def test_stages_keep_the_columns_and_take_edges(spark):
    df = documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns, name
        assert out.schema == df.schema, name
        assert stage(spark, df.limit(0), SF).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, df.limit(0), SF).count() == 0
    clean = {1, 5, 7, 8, 9}
    kept = corpus_pipeline.decontaminate(spark, df, SF)
    assert clean <= {r["doc_id"] for r in kept.collect()}
