import re
from collections import defaultdict

import pytest

from infosieve.llm import license_rules, license_scan, mixing

from .helpers import EDGES, documents, duck, tuples


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def water(rows, weights=(5, 2, 1)):
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += size(text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = 1.5 * total - sum(2 * sizes[s] for s in capped)
        wsum = sum(w[s] for s in order if s not in capped)
        new = {s for s in order if s not in capped and w[s] * (rest / wsum) > 2 * sizes[s]} if wsum else set()
        if not new:
            return {s: 2.0 * sizes[s] if s in capped else w[s] * (rest / wsum) for s in order}, sizes
        capped |= new


def test_targets_follow_water_filling(spark):
    targets, sizes = water(EDGES)
    got = mixing.mix(documents(spark)).collect()
    assert len(got) == len(EDGES)
    for r in got:
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["size"] * r["copies"] <= 2 * r["size"]


def test_targets_of_many_sources(spark):
    rows = [(i, "w " * (i * 37 % 11 + 1), "en", f"s{i % 23:02d}") for i in range(400)]
    targets, _ = water(rows)
    df = mixing.mix(documents(spark, rows))
    for r in df.collect():
        assert r["target"] == pytest.approx(targets[r["source"]])
    assert tuples(df, "doc_id", "taken") == tuples(mixing.mix(documents(spark, rows)), "doc_id", "taken")


def test_taken_words_come_near_the_target(spark):
    rows = [(i, "w " * 20, "en", f"s{i % 3}") for i in range(3000)]
    by = defaultdict(lambda: [0, 0.0])
    for r in mixing.mix(documents(spark, rows)).collect():
        by[r["source"]][0] += r["taken"]
        by[r["source"]][1] = r["target"]
    for taken, target in by.values():
        assert abs(taken - target) < 0.05 * target


def test_mix_equals_its_sql(spark):
    rows = [r for r in EDGES if r[0] is not None]
    df = documents(spark, rows)
    got = mixing.mix(df)
    want = duck(mixing.ORACLE, documents=df.select("doc_id", "text", "source").toPandas())
    key = ["doc_id", "size", "copies"]
    a, b = (x.sort_values(key).reset_index(drop=True) for x in (got.toPandas(), want))
    assert a[key + ["taken"]].values.tolist() == b[key + ["taken"]].values.tolist()
    assert a["target"].tolist() == pytest.approx(b["target"].tolist())


def test_emit_repeats_rows_whole(spark):
    df = documents(spark)
    copies = {(r["doc_id"], r["size"]): r["copies"] for r in mixing.mix(df).collect()}
    out = mixing.emit(df)
    assert out.columns == df.columns
    n = defaultdict(int)
    for r in out.collect():
        n[r["doc_id"], size(r["text"])] += 1
    once = defaultdict(int)
    for d, text, _, _ in EDGES:
        once[d, size(text)] += 1
    assert n == {k: c * once[k] for k, c in copies.items() if c}


def test_empty_table(spark):
    df = documents(spark, []).limit(0)
    assert mixing.mix(df).count() == 0 and mixing.emit(df).count() == 0
    assert license_scan.scan(df).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def scanned(text):
    """The scan, rule by rule and pair by pair."""
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words = WORD.findall(text)
    places, base = [], set()
    for phrase, label in license_rules.BASE:
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    norm = " " + " ".join(words) + " "
    found = sorted((m.start(), -m.end(), -priority, label) for label, priority, keyword, pattern in license_rules.rules()
                   if keyword in norm for m in re.finditer(license_scan.bounded(pattern), norm))
    kept = [d for i, d in enumerate(found) if not any(e[1] <= d[1] and e[2] <= d[2] for e in found[:i])]
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | {d[3] for d in kept})), max((-d[2] for d in kept), default=0) / 5)


LICENCES = ["CC-BY cc by cc by", "GNU General Public License, version 3 or later. All rights reserved", "cc by-nc-sa 4.0 é",
            "Licensed under the Apache License, Version 2.0.", "MIT License " * 40, "all  rights\nreserved ALL RIGHTS RESERVED",
            "licence cc0", "x" * 1000 + " gpl", "General public license general public license", "cc bye accc by",
            "SPDX-License-Identifier: MIT", "redistributions in binary form must reproduce the above copyright notice",
            "ALL RİGHTS RESERVED all rights reserved"]


def test_scan_equals_brute_force(spark):
    rows = [*EDGES, *((100 + i, t, None, None) for i, t in enumerate(LICENCES))]
    got = [tuple(r) for r in license_scan.scan(documents(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(str((d, *scanned(t))) for d, t, _, _ in rows)


def test_every_rule_is_reachable():
    rules = license_rules.rules()
    assert len(rules) > 200
    for _, priority, keyword, pattern in rules:
        re.compile(pattern)
        assert 1 <= priority <= license_scan.TOP_PRIORITY
        assert any(s in keyword for s in license_rules.STEMS)


def test_scan_has_no_python(spark):
    plan = license_scan.scan(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
