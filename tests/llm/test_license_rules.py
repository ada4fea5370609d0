"""Rules on their phrase alone."""

import itertools
import re
from re import _constants as kind
from re import _parser

from infosieve.llm import license_rules, license_scan

from .helpers import documents


def phrases(tokens, full):
    """Texts that match a pattern: every branch and class, options left out or taken."""
    parts = []
    for op, arg in tokens:
        if op is kind.LITERAL:
            parts.append([chr(arg)])
        elif op is kind.IN:
            parts.append([chr(c) for o, a in arg for c in ([a] if o is kind.LITERAL else [a[0]])])
        elif op is kind.SUBPATTERN:
            parts.append(phrases(arg[3], full))
        elif op is kind.BRANCH:
            parts.append([p for b in arg[1] for p in phrases(b, full)])
        elif op is kind.MAX_REPEAT:
            low, high, sub = arg
            n = int(high) if full else low
            parts.append([p * n for p in phrases(sub, full)] if n else [""])
        else:
            raise AssertionError(op)
    return ["".join(p) for p in itertools.product(*parts)]


def test_every_rule_fires_on_its_phrase_alone(spark):
    cases = []
    for label, _, keyword, pattern in license_rules.rules():
        for p in {p for full in (False, True) for p in phrases(_parser.parse(pattern), full)}:
            assert re.fullmatch(pattern, p) and keyword in p, (label, p, keyword)
            assert any(s in p for s in license_rules.STEMS), p
            cases.append((len(cases), p, label, pattern))
    alone = [(i, p, None, None) for i, p, *_ in cases]
    got = {r["doc_id"]: r for r in license_scan.scan(documents(spark, alone)).select("doc_id", "labels", "score").collect()}
    assert all(got[i]["score"] > 0 and got[i]["labels"] for i, *_ in cases)


def test_true_phrases_are_found(spark):
    want = [("Distributed as BSD 3-Clause.", "bsd-3-clause"), ("BSD 2-Clause", "bsd-2-clause"), ("bsd 4 clause", "bsd-4-clause"),
            ("0-clause BSD", "bsd-0-clause"), ("MIT No Attribution", "mit-0"), ("under the same terms as Perl itself.", "perl"),
            ("Alle Rechte vorbehalten.", "reserved"), ("No part of this publication may be reproduced.", "reserved")]
    rows = [(i, t, None, None) for i, (t, _) in enumerate(want)]
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(documents(spark, rows)).collect()}
    assert [got[i] for i in range(len(want))] == [x for _, x in want]
