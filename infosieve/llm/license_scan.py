"""Licence scan (operator 2): ordered signature rules, DataFrame functions only.

Texts that hold none of a few stems are done after one look.  The others are normalised to
words joined by blanks; every rule whose keyword occurs yields the intervals its pattern
matches; a detection inside another one of the same or a higher priority is suppressed by
one sweep over the intervals in order of their start.

Defined results: a null text scans like an empty one; repeated rows give equal rows;
extra columns are ignored; a text of any length is scanned whole; an empty table gives an empty
result; overlapping detections that do not contain each other all stay;
of equal intervals the highest priority stays, then the smallest label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER
from .license_rules import BASE, STEMS, rules

#: One run of word characters, before and after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP_PRIORITY = 5


def bounded(pattern: str) -> str:
    """A pattern over whole words of the normalised text."""
    return f"(?<= )(?:{pattern})(?= )"


def _blanks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _base(norm: Column, n_words: Column, phrase: str) -> Column:
    """``n, first, last`` of one phrase: what lies before, between and after its places."""
    pieces = F.split(norm, bounded(phrase), -1)
    n = F.size(pieces) - 1
    last = n_words - (_blanks(F.element_at(pieces, -1)) - 1) - len(phrase.split())
    return F.struct(n.cast("long").alias("n"), F.when(n > 0, _blanks(pieces[0]) - 1).cast("long").alias("first"),
                    F.when(n > 0, last).cast("long").alias("last"))


def _detections(norm: Column) -> Column:
    """Array of ``start, neg_end, neg_priority, label`` of all rules whose keyword occurs."""
    table = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(priority).alias("priority"),
                               F.lit(keyword).alias("keyword"), F.lit(bounded(pattern)).alias("pattern"))
                      for label, priority, keyword, pattern in rules()])

    def places(r: Column) -> Column:
        hits = F.regexp_extract_all(norm, r["pattern"], F.lit(0))
        pieces = F.split(norm, r["pattern"], -1)
        none = F.array().cast("array<struct<start:int,neg_end:int,neg_priority:int,label:string>>")

        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(pieces, i))
            end = start + F.length(F.get(hits, i))
            one = F.struct(start.alias("start"), (-end).alias("neg_end"), (-r["priority"]).alias("neg_priority"),
                           r["label"].alias("label"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        found = F.aggregate(F.sequence(F.lit(0), F.size(hits) - 1),
                            F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
        return F.when(F.size(hits) > 0, found).otherwise(none)

    near = F.filter(table, lambda r: F.contains(norm, r["keyword"]))
    return F.array_sort(F.flatten(F.transform(near, places)))


def _kept(detections: Column) -> Column:
    """Labels and best priority after interval containment; the input is in order of start.

    ``ends`` holds the furthest end seen for each priority, so one look tells whether an
    earlier detection of the same or a higher priority contains the current one.
    """
    zero = F.struct(F.array_repeat(F.lit(-1), TOP_PRIORITY).alias("ends"),
                    F.array().cast("array<string>").alias("labels"), F.lit(0).alias("best"))

    def step(acc: Column, d: Column) -> Column:
        inside = F.array_max(F.slice(acc["ends"], -d["neg_priority"], TOP_PRIORITY)) >= -d["neg_end"]
        ends = F.transform(acc["ends"], lambda e, p: F.when(p + 1 == -d["neg_priority"], F.greatest(e, -d["neg_end"]))
                           .otherwise(e))
        return F.struct(ends.alias("ends"),
                        F.when(inside, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(d["label"])))
                        .alias("labels"),
                        F.when(inside, acc["best"]).otherwise(F.greatest(acc["best"], -d["neg_priority"])).alias("best"))

    return F.aggregate(detections, zero, step)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every document.

    ``score`` is the best kept priority over the highest one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lowered = F.lower(text)
    gate = F.lit(False)
    for stem in STEMS:
        gate = gate | F.contains(lowered, F.lit(stem))
    words = F.trim(F.regexp_replace(F.translate(text, ASCII_UPPER, ASCII_LOWER), GAP, " "))
    found = (docs.select("doc_id", F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
                         F.when(gate, F.concat(F.lit(" "), words, F.lit(" "))).alias("norm")))
    bases = [_base(F.col("norm"), F.col("n_words"), phrase) for phrase, _ in BASE]
    found = found.withColumn("base", F.when(F.col("norm").isNotNull(), F.array(*bases)))
    found = found.withColumn("kept", F.when(F.col("norm").isNotNull(), _kept(_detections(F.col("norm")))))
    names = F.array_compact(F.array(*[F.when(F.col("base")[i]["n"] > 0, F.lit(label))
                                      for i, (_, label) in enumerate(BASE)]))
    none = F.array().cast("array<string>")
    base_names = F.coalesce(names, none)
    all_names = F.array_union(base_names, F.coalesce(F.col("kept.labels"), none))
    return found.select(
        "doc_id", "n_words",
        F.coalesce(sum((F.col("base")[i]["n"] for i in range(1, len(BASE))), F.col("base")[0]["n"]),
                   F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.col("base.first")).alias("first_word"), F.array_max(F.col("base.last")).alias("last_word"),
        F.array_join(F.array_sort(base_names), ",").alias("base_labels"),
        F.array_join(F.array_sort(all_names), ",").alias("labels"),
        (F.coalesce(F.col("kept.best"), F.lit(0)) / F.lit(float(TOP_PRIORITY))).alias("score"))
