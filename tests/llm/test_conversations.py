"""Conversation structure repair against plain recursion over whole conversations."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from infosieve.llm import conversations as C
from infosieve.llm import queries
from infosieve.llm.common import table

from .helpers import SF

NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        h = zlib.crc32(key.encode()) % 20
        if h == 0:
            continue
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if h == 3 else 1)
    return out


def plain_repair(rows):
    """One conversation's result; ``rows`` are its rows after damage."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2],
                                       hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))
    turns = [r[1] for r in rows if r[1] is not None]
    seen, faults = set(), []
    for _, _, role, text in rows:
        end = text.rstrip(SPACE)
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else
                      "truncated" if end[-1] not in ".!?" else None)
        seen.add((role, text))
    letters = [r[2][:1] for r in rows]
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, state, inserted):
        options = []
        if i == len(rows):
            if state in ("", "a"):
                options.append((0, "", ()))
        else:
            c, audit, out = best(i + 1, state, 0)
            options.append((4 + c, "D" + audit, out))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 * (faults[i] == "truncated")
                if letters[i] and letters[i] in follow[state]:
                    c, audit, out = best(i + 1, letters[i], 0)
                    options.append((extra + c, "K" + audit, (f"{rows[i][2]}:{rows[i][3]}", *out)))
                for role in ("user", "assistant"):
                    if role[0] in follow[state]:
                        c, audit, out = best(i + 1, role[0], 0)
                        options.append((extra + 3 + c, "R" + audit, (f"{role}:{rows[i][3]}", *out)))
        if inserted < 3:
            for role in ("user", "assistant"):
                if role[0] in follow[state]:
                    c, audit, out = best(i, role[0], inserted + 1)
                    options.append((3 + c, "I" + audit, (f"{role}:", *out)))
        return min(options, default=(10 ** 9, "", ()))

    cost, audit, out = best(0, "", 0)
    return ((max(turns) - min(turns) + 1 - len(set(turns))) if turns else 0, *[faults.count(f) for f in NAMES[1:4]],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:])), cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def plain(rows):
    after = plain_damage(rows)
    return {c: plain_repair([r for r in after if r[0] == c]) for c in {r[0] for r in rows}}


def found(df):
    got = [(r["conv_id"], tuple(r[n] for n in NAMES)) for r in df.collect()]
    assert len(dict(got)) == len(got)
    return dict(got)


def rows_of(spark, rows):
    """Conversations with extra columns whose names the operator uses itself."""
    schema = "conv_id long, turn long, role string, text string, lo long, rid string, `a.b` int, place int, _pid int"
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], schema)


def random_rows(seed, conversations, most):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "a", "Ursula"]
    texts = ["Yes.", "Yes.", "no", "Why?  \n", " \t", "", None, "Go!", "é…", "a:b\nc."]
    return [(rng.choice([None, c, c, c]) if c == 3 else c, rng.choice([None, t, t, t, t + 2]),
             rng.choice(roles[:3] if rng.random() < 0.7 else roles), rng.choice(texts))
            for c in range(conversations) for t in range(rng.randrange(1, most))]


EDGES = [(1, 0, "user", "Hello there."), (1, 1, "assistant", "Hi!"), (1, 1, "assistant", "Hi!"), (2, None, None, None),
         (None, 5, "system", "Be kind."), (None, None, "user", "x" * 200_000 + "."), (4, 9, "system", "Only."),
         (5, 0, "", "no letter."), (6, 3, "user", "   \n"), (7, 0, "assistant", "First? "), (7, 5, "user", "cut off")]


@pytest.mark.parametrize("block_rows", [None, 1, 2, 1000])
def test_repair_equals_recursion(spark, block_rows):
    rows = EDGES + [(c + 100 if c is not None else c, *r) for c, *r in random_rows(7, 60, 14)]
    assert found(C.digests(rows_of(spark, rows), block_rows)) == plain(rows)


def test_long_conversation(spark):
    rows = [(1, t, *random.Random(t).choice([("user", f"u{t}."), ("assistant", f"a{t}"), ("system", "s."), ("user", "again.")]))
            for t in range(700)] + [(2, 0, "user", "one.")]
    assert found(C.digests(rows_of(spark, rows))) == plain(rows)


def test_query_equals_recursion(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op13_repair_conversations(spark, SF)) == plain(rows)


def test_repaired_order_is_legal(spark):
    edits, _ = C.repair(rows_of(spark, random_rows(11, 40, 20)).select("conv_id", "turn", "role", "text"))
    orders = {}
    for r in sorted(edits.where("edit <> 'D'").collect(), key=lambda r: (r["lo"], r["block"], r["k"])):
        orders[r["lo"]] = orders.get(r["lo"], "") + r["role"][:1]
    assert orders and all(re.fullmatch("(s?(ua)+)?", x) for x in orders.values())


def test_table_sizes_stay_small_in_long_blocks():
    rng, steps = random.Random(2), C.Steps()
    v = (C.FAR, C.FAR, C.FAR, 0)
    for _ in range(20_000):
        v, _ = steps.before(rng.randrange(12), v)
    assert len(steps.back) < 2000


def test_empty_table(spark):
    assert C.digests(rows_of(spark, [])).count() == 0
