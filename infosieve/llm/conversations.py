"""Conversation structure repair (operator 13): square-root checkpointed dynamic programming.

Rows of a conversation are repaired to the order ``(system? (user assistant)+)?`` by the cheapest
edits: Keep 0, Rerole to user or assistant 3, Delete 4 (required for blank and duplicate rows),
Insert an empty user or assistant message 3, and 3 for a truncated row that stays.  Among the
cheapest edit sequences the one whose initials are least in ASCII is taken.

A state says what may follow (start, after system, after user, after assistant).  ``cost[i][q]``
is the least cost of rows i, i + 1, ... from state q, insertions included.  The n rows of a conversation
are cut into blocks of ceil(sqrt(n)) rows, and only the vectors at block ends are kept:

1. every block gives a 4 x 4 table of least costs between its first and last state;
2. the blocks of a conversation are passed from the last to the first, which leaves the cost vector
   at each block's end, the checkpoint;
3. every block recomputes its own vectors from its checkpoint and walks forward along tight edits
   from each of the four states, least initial first;
4. the blocks are passed from the first to the last, which tells each the state it begins in.

Steps 1 and 3 deal with blocks on their own, so the rows of one conversation, however many, are
spread over all tasks; steps 2 and 4 see about sqrt(n) short rows per conversation, one at a time.  Texts
take no part: they are joined to the edits by row number.

Order: conversations' rows by turn (nulls first), then role, then a digest of the text; equal rows
stay together.  Duplicates are told by a digest of role and text.

Defined results: null roles and texts count as one blank; a null ``conv_id`` is a conversation like any
other, null turns come first; empty and very long texts are texts like any other (texts are only
read in whole for digests); repeated rows are duplicates; a conversation without rows left
has no edits; an empty table gives an empty result; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, numbered, stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
#: States: start, after system, after user, after assistant; the role that may follow each.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
#: Roles by first letter, as the state they lead to; 0 for any other.
LETTERS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: A row's code is 3 * letter + fault.
SOUND, CUT, GONE = range(3)
FAR = 1 << 40


def _closed(v: tuple) -> tuple:
    """Costs after any insertions."""
    v = list(v)
    for _ in range(2):
        for q in range(4):
            v[q] = min(v[q], INSERT + v[NEXT[q]])
    return tuple(v)


#: Costs at the end of a conversation: done at the start or after an assistant.
END = _closed((0, FAR, FAR, 0))


def _edits(code: int, q: int) -> list[tuple[str, int, int]]:
    """``(initial, cost, next state)`` of the edits of a row in state q, initials ascending."""
    letter, fault = divmod(code, 3)
    out = [("D", DELETE, q)]
    if fault != GONE:
        stays = TRUNCATED * (fault == CUT)
        if letter == NEXT[q] or (letter == SYSTEM and q == START):
            out.append(("K", KEEP + stays, letter))
        if letter != NEXT[q]:
            out.append(("R", REROLE + stays, NEXT[q]))
    return out


EDITS = [[_edits(code, q) for q in range(4)] for code in range(12)]


class Steps:
    """Backward steps over rows, remembered: vectors less their minimum take few values."""

    def __init__(self):
        self.back: dict = {}
        self.forward: dict = {}

    def before(self, code: int, v: tuple) -> tuple[tuple, int]:
        """The cost vector before a row, less its minimum, and that minimum."""
        key = (code, v)
        if key not in self.back:
            got = _closed(tuple(min(cost + v[to] for _, cost, to in EDITS[code][q]) for q in range(4)))
            least = min(got)
            self.back[key] = tuple(x - least if x < FAR // 2 else FAR for x in got), least
        return self.back[key]

    def walk(self, code: int, v: tuple, q: int) -> tuple[str, int]:
        """The initials of the edits up to and with a row's own, and the state after it."""
        key = (code, v, q)
        if key not in self.forward:
            self.forward[key] = self._walk(code, v, q)
        return self.forward[key]

    def _walk(self, code: int, v: tuple, q: int) -> tuple[str, int]:
        now, least = self.before(code, v)
        own = {initial: (cost, to) for initial, cost, to in EDITS[code][q]}
        for initial in "DIKR":
            if initial == "I":
                if now[q] == INSERT + now[NEXT[q]]:
                    rest, to = self.walk(code, v, NEXT[q])
                    return "I" + rest, to
            elif initial in own:
                cost, to = own[initial]
                if now[q] + least == cost + v[to]:
                    return initial, to
        raise AssertionError("no tight edit")


def last_inserts(q: int) -> str:
    """Insertions after the last row."""
    out = ""
    while END[q]:
        out, q = out + "I", NEXT[q]
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults by crc32(``conv_id:turn``) % 20: 0 drops the row, 1 empties its
    text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4 makes it a user's."""
    blank = F.lit(" ")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"),
                                F.coalesce("text", blank).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.withColumn("fault", F.crc32(key.cast("binary")) % 20).where("fault != 0")
    fault = F.col("fault")
    copies = F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
        .alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _letter(role: Column) -> Column:
    first, out = F.substring(role, 1, 1), F.lit(0)
    for letter, state in LETTERS.items():
        out = F.when(first == letter, F.lit(state)).otherwise(out)
    return out


def with_faults(rows: DataFrame) -> DataFrame:
    """Light rows: ``rid, conv_id, turn, place`` (position among all rows in order), ``letter`` and ``fault``
    (blank, duplicate, truncated or null, the first that holds)."""
    seen = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    light = rows.select("rid", "conv_id", "turn", "role", seen.alias("seen"), _letter(F.col("role")).alias("letter"),
                        (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("seen"), F.col("rid")]
    at = stored(numbered(light, order, "conversation-rows", out="place").drop("role"), "conversation-order")
    firsts = at.groupBy("conv_id", "seen").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    fault = (F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated"))
    return at.join(firsts, "place", "left").select("rid", "conv_id", "turn", "place", "letter", fault.alias("fault"))


def summaries(light: DataFrame) -> DataFrame:
    """``conv_id, lo, n, gaps, blank, duplicate, truncated`` per conversation; ``lo`` is its first place."""
    return light.groupBy("conv_id").agg(
        F.min("place").alias("lo"), F.count(F.lit(1)).alias("n"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns], strict=True)


def _streamed(df: DataFrame, work, schema: str, arrow: dict) -> DataFrame:
    """``df``'s rows through the generator ``work``, task by task, in the order they lie in."""
    as_arrow = pa.schema(list(arrow.items()))
    return in_arrow(df, lambda batches: _batches(work(_rows(batches)), as_arrow), schema)


LONG, LONGS, TEXT = pa.int64(), pa.list_(pa.int64()), pa.string()


def blocks(light: DataFrame, summary: DataFrame, block_rows: int | None = None) -> DataFrame:
    """``lo, block, last, rids, codes``: each conversation in blocks of ceil(sqrt(n)) rows (or ``block_rows``)."""
    size = F.lit(block_rows) if block_rows else F.ceil(F.sqrt("n"))
    code = 3 * F.col("letter") + (F.when(F.col("fault").isin("blank", "duplicate"), GONE)
                                  .when(F.col("fault") == "truncated", CUT).otherwise(SOUND))
    s = summary.select(F.col("conv_id").alias("s_conv"), "lo", "n", size.cast("long").alias("size"))
    rows = light.join(s, light["conv_id"].eqNullSafe(s["s_conv"])).select(
        "lo", F.expr("(place - lo) div size").alias("block"), F.expr("(n - 1) div size").alias("last"), "place",
        code.cast("long").alias("code"), "rid")
    held = rows.groupBy("lo", "block", "last").agg(F.sort_array(F.collect_list(F.struct("place", "rid", "code"))).alias("r"))
    return held.select("lo", "block", "last", F.col("r.rid").alias("rids"), F.col("r.code").alias("codes"))


def _tables(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Step 1: least costs from each first to each last state, inner illegal pairs, outer letters."""
    steps = Steps()
    for lo, block, last, codes in rows:
        columns = []
        for to in range(4):
            v, total = tuple(0 if q == to else FAR for q in range(4)), 0
            for code in reversed(codes):
                v, least = steps.before(code, v)
                total += least
            columns.append([x + total for x in v])
        letters = [c // 3 for c in codes]
        bad = sum(pair not in LEGAL for pair in zip(letters, letters[1:]))
        yield lo, block, last, [columns[to][q] for q in range(4) for to in range(4)], bad, letters[0], letters[-1]


def _checkpoints(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Step 2, blocks in descending order: the costs at the block's end and start, illegal pairs."""
    v, following = END, 0
    for lo, block, last, table, bad, first, final in rows:
        if block == last:
            v = END
        else:
            bad += (final, following) not in LEGAL
        end, following = v, first
        v = _closed(tuple(min(table[4 * q + to] + end[to] for to in range(4)) for q in range(4)))
        yield lo, block, list(end), v[START], bad


def _walks(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Step 3: the edits from each first state, and the state they end in."""
    steps = Steps()
    for lo, block, last, codes, end in rows:
        least = min(end)
        v = tuple(x - least for x in end)
        vectors = [v]
        for code in reversed(codes):
            v, _ = steps.before(code, v)
            vectors.append(v)
        vectors.reverse()
        edits, exits = [], []
        for q in range(4):
            out = []
            for i, code in enumerate(codes):
                piece, q = steps.walk(code, vectors[i + 1], q)
                out.append(piece)
            edits.append("".join(out) + (last_inserts(q) if block == last else ""))
            exits.append(q)
        yield lo, block, edits, exits


def _entries(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Step 4, blocks in ascending order: the state each begins in."""
    q = START
    for lo, block, exits in rows:
        if block == 0:
            q = START
        yield lo, block, q
        q = exits[q]


def _spelled(rows: Iterator[tuple]) -> Iterator[tuple]:
    """One row per edit of a block: its order, initial, the row it is about (null for insertions), its new role."""
    for lo, block, rids, codes, edits, q in rows:
        i = 0
        for k, initial in enumerate(edits):
            role, rid = None, None
            if initial in "IR":
                q = NEXT[q]
                role = ROLE_OF[q]
            elif initial == "K":
                q = codes[i] // 3
            if initial != "I":
                rid = rids[i]
                i += 1
            yield lo, block, k, initial, rid, role


def repair(rows: DataFrame, block_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The edits that repair conversations ``(conv_id, turn, role, text)``, and a summary of each conversation.

    Edits: ``lo, block, k`` (conversation, order of its edits), ``edit`` (initial), ``role, text`` of the message that
    results (null for deletions).  Summary: ``conv_id, lo, n, gaps, blank, duplicate, truncated, illegal, cost``.
    """
    texts = stored(rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                               F.coalesce("text", F.lit(" ")).alias("text"))
                   .withColumn("rid", F.monotonically_increasing_id()), "conversation-texts")
    light = stored(with_faults(texts), "conversation-faults")
    summary = stored(summaries(light), "conversation-summary")
    cut = stored(blocks(light, summary, block_rows), "conversation-blocks")
    tables = _streamed(cut.select("lo", "block", "last", "codes"), _tables,
                       "lo long, block long, last long, costs array<long>, bad long, first long, final long",
                       {"lo": LONG, "block": LONG, "last": LONG, "costs": LONGS, "bad": LONG, "first": LONG, "final": LONG})
    ends = stored(_streamed(tables.repartition("lo").sortWithinPartitions("lo", F.desc("block")), _checkpoints,
                            "lo long, block long, end array<long>, cost long, bad long",
                            {"lo": LONG, "block": LONG, "end": LONGS, "cost": LONG, "bad": LONG}), "conversation-ends")
    walks = stored(_streamed(cut.join(ends, ["lo", "block"]).select("lo", "block", "last", "codes", "end"), _walks,
                             "lo long, block long, edits array<string>, exits array<long>",
                             {"lo": LONG, "block": LONG, "edits": pa.list_(TEXT), "exits": LONGS}), "conversation-walks")
    entries = _streamed(walks.select("lo", "block", "exits").repartition("lo").sortWithinPartitions("lo", "block"), _entries,
                        "lo long, block long, entry long", {"lo": LONG, "block": LONG, "entry": LONG})
    chosen = (walks.join(entries, ["lo", "block"]).select("lo", "block", F.get("edits", F.col("entry")).alias("edits"), "entry")
              .join(cut, ["lo", "block"]).select("lo", "block", "rids", "codes", "edits", "entry"))
    spelled = stored(_streamed(chosen, _spelled, "lo long, block long, k long, edit string, rid long, new_role string",
                               {"lo": LONG, "block": LONG, "k": LONG, "edit": TEXT, "rid": LONG, "new_role": TEXT}),
                     "conversation-edits")
    order = ["lo", "block", "k", "edit"]
    stay = (spelled.where(F.col("edit").isin("K", "R")).join(texts.select("rid", "role", "text"), "rid")
            .select(*order, F.coalesce("new_role", "role").alias("role"), "text"))
    other = spelled.where(F.col("edit").isin("D", "I")).select(
        *order, F.col("new_role").alias("role"), F.when(F.col("edit") == "I", F.lit("")).alias("text"))
    whole = ends.groupBy("lo").agg(F.sum("bad").alias("illegal"), F.max(F.when(F.col("block") == 0, F.col("cost"))).alias("cost"))
    return stay.union(other), summary.join(whole, "lo")


def _digested(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Per conversation, in order: the initials of its edits, and the digest of its messages."""
    now, audit, sha, some = None, [], None, False
    for lo, edit, role, text in rows:
        if lo != now:
            if now is not None:
                yield now, "".join(audit), sha.hexdigest()
            now, audit, sha, some = lo, [], hashlib.sha256(), False
        audit.append(edit)
        if edit != "D":
            sha.update(("\n" * some + role + ":" + text).encode())
            some = True
    if now is not None:
        yield now, "".join(audit), sha.hexdigest()


def digests(conversations: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Faults, cost, edits and digest of the repair of every damaged conversation.

    A digest reads the messages of a conversation one after the other, whatever their number, and
    holds none of them."""
    edits, summary = repair(damaged(conversations), block_rows)
    read = _streamed(edits.repartition("lo").sortWithinPartitions("lo", "block", "k").select("lo", "edit", "role", "text"),
                     _digested, "lo long, audit string, repaired_sha256 string",
                     {"lo": LONG, "audit": TEXT, "repaired_sha256": TEXT})
    found = summary.join(read, "lo", "left").withColumnRenamed("conv_id", "f_conv")
    every = conversations.select("conv_id").distinct()
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, every["conv_id"].eqNullSafe(found["f_conv"]), "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
