"""row samples (the sampling step of the synthetic-data jobs), decided by digests of seed and key."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import col_of, fresh_names

#: Hex digits of the digest that decide; 13 digits are 52 bits.
DIGITS = 13


def _digest(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def bernoulli_sample(df: DataFrame, fraction: float, key: str | Column, seed: int = 42) -> DataFrame:
    """Each row kept with probability ``fraction``, decided by the digest of seed and key alone,
    so the sample does not depend on partitioning and reruns agree (no replacement)."""
    key = col_of(key) if isinstance(key, str) else key
    digest = F.substring(_digest(key, seed), 1, DIGITS)
    if fraction >= 1:
        return df
    threshold = format(int(fraction * 16 ** DIGITS), f"0{DIGITS}x")
    return df.where(digest < F.lit(threshold))


#: Hex digits looked at in one step of the threshold search, and rows that may be fetched to end it.
STEP_DIGITS, FETCHED = 4, 10_000


def exact_sample(df: DataFrame, k: int, key: str | Column, seed: int = 42) -> DataFrame:
    """Exactly ``k`` rows (all, if there are fewer): those of the smallest digests of seed and key.

    The k-th smallest digest is searched, not sorted for: a histogram of the next ``STEP_DIGITS`` hex digits
    (at most 16 ** ``STEP_DIGITS`` rows) tells which digits it starts with and how many rows lie
    below; the search goes on inside that prefix until few rows share it.  The sample does not depend on
    partitioning and reruns agree.  Equal keys have equal digests: keys should be unique; rows that share the
    k-th digest are told apart by the digest of the whole row, and equal rows are dealt out until
    exactly ``k`` are kept.  A null key counts as empty text."""
    if k < 0:
        raise ValueError("k must be >= 0")
    key = col_of(key) if isinstance(key, str) else key
    columns = [col_of(c) for c in df.columns]
    whole = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    (digest,) = fresh_names(["digest"], df.columns)
    keyed = df.withColumn(digest, F.concat(_digest(F.coalesce(key.cast("string"), F.lit("")), seed), whole))
    d, prefix, wanted = F.col(digest), "", k
    while len(prefix) < 96:
        counts = (keyed.where(d.startswith(prefix)).groupBy(F.substring(d, len(prefix) + 1, STEP_DIGITS).alias("p"))
                  .agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect())
        if not prefix and sum(r["n"] for r in counts) <= k:
            return df
        for r in counts:
            if r["n"] >= wanted:
                prefix += r["p"]
                break
            wanted -= r["n"]
        if r["n"] == wanted or not wanted:
            break
        if r["n"] <= FETCHED:
            last = [x[0] for x in keyed.where(d.startswith(prefix)).select(d).orderBy(d).limit(wanted).collect()]
            prefix, wanted = last[-1], sum(x == last[-1] for x in last)
            break
    if not k:
        return df.limit(0)
    below = keyed.where(F.substring(d, 1, len(prefix)) < prefix)
    level = keyed.where(d.startswith(prefix))
    if len(prefix) == 96:
        level = level.limit(wanted)   # rows equal in every column
    return below.union(level).select(*columns)
