"""Exact top-k inner product search (operator 9): a pivot-distance index.

Vectors become integers (``floor(scale * x)``).  One more coordinate, ``sqrt(M - |x|^2)`` with
``M`` the largest squared norm, turns the highest inner product into the smallest distance.
Every vector is keyed by its nearest pivot and its distance from it; sorted by that key, runs
of rows of one pivot are annuli, each kept as one packed matrix with its smallest and largest
distance.  A query's threshold starts at the k-th score of its own annulus; it then expands
the annuli of the best bounds, and in the last round every annulus whose triangle-inequality
bound still reaches its threshold.  Queries travel in blocks, annuli as packed rows, so no
task holds more than one of each.

Pivots are picked farthest-first from a hash-drawn sample of at most ``PIVOT_SAMPLE`` rows; all
rows are indexed and the search is exact, so recall is 1.

Defined results: vectors that are null or hold null or non-finite components take no part;
shorter vectors count as padded with zeros; an empty vector scores 0; rows that repeat a
``vec_id`` are rows of their own (a query skips only its own row); ties go to the smaller
``vec_id`` (null last); scores beyond 64 bits raise an error; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, stored

K, SCALE, QUERY_EVERY = 20, 64, 20
PIVOTS, PIVOT_SAMPLE = 48, 2048
#: Rows of an annulus at least, and annuli at most (their bounds are broadcast: 32 bytes each).
ANNULUS_ROWS, MAX_ANNULI = 2048, 1 << 16
QUERY_ROWS = 1024
#: Annuli that each query block expands per round; the last round takes all that are left.
ROUNDS = (4, None)


def integers(embeddings: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, v`` (integers as long array) of the vectors that take part."""
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return (embeddings.where(v.isNotNull() & ~bad)
            .select("vec_id", F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("v")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column padded with zeros to ``dim``."""
    lens = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(lens) and (lens == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lens), dim), np.int64)
    out[np.arange(dim)[None, :] < lens[:, None]] = flat
    return out


def farthest_first(points: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` distinct rows, each the farthest from those before."""
    chosen = [0]
    near = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(points)):
        at = int(near.argmax())
        if near[at] <= 0:
            break
        chosen.append(at)
        near = np.minimum(near, ((points - points[at]) ** 2).sum(axis=1))
    return points[chosen]


class Space:
    """What every task needs to know: pivots in the raised space, the norm bound, the packing."""

    def __init__(self, dim: int, norm: int, sample: np.ndarray):
        self.dim, self.norm = dim, norm
        # in tests of huge components; ordinary vectors take the first
        self.kind = "<i2" if norm < 1 << 30 else "<i4" if norm < 1 << 62 else "<i8"
        self.exact_float = norm < 1 << 53
        self.pivots = farthest_first(self.raised(sample), PIVOTS)

    def raised(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        rest = np.sqrt(np.maximum(self.norm - (x * x).sum(axis=1), 0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def distances(self, points: np.ndarray) -> np.ndarray:
        sq = ((points ** 2).sum(axis=1)[:, None] + (self.pivots ** 2).sum(axis=1)[None, :]
              - 2 * points @ self.pivots.T)
        return np.sqrt(np.maximum(sq, 0))

    def slack(self) -> float:
        """Covers the rounding of distances in a bound on scores."""
        return 1 + 1e-6 * float(self.norm)

    def scores(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        if self.exact_float:
            return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
        return q.astype(np.int64) @ x.astype(np.int64).T


def best_in(scores: np.ndarray, own: np.ndarray, order: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row, the places of its k best columns; ``order`` ranks columns for ties, ``own`` is
    a column to skip (-1: none)."""
    for i, row in enumerate(scores):
        if own[i] >= 0:
            row = row.copy()
            row[own[i]] = np.iinfo(np.int64).min
        if len(row) > 4 * k:
            cut = np.partition(row, len(row) - k)[len(row) - k]
            at = np.flatnonzero(row >= cut)
        else:
            at = np.arange(len(row))
        at = at[at != own[i]]
        yield i, at[np.lexsort((order[at], -row[at]))[:k]]


def top_k(embeddings: DataFrame, k: int = K, scale: int = SCALE, every: int = QUERY_EVERY,
          annulus_rows: int = ANNULUS_ROWS, query_rows: int = QUERY_ROWS, rounds=ROUNDS) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose ``vec_id`` is divisible by ``every``."""
    spark = embeddings.sparkSession
    result = "query_id long, rank int, vec_id long, score long"
    rows = stored(integers(embeddings, scale=scale), "topk-rows")
    sq = F.aggregate("v", F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x.cast("decimal(38,0)") * x).cast("decimal(38,0)"))
    n, dim, norm = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(sq)).first()
    if not n:
        return spark.createDataFrame([], result)
    norm, dim = int(norm), max(1, dim)
    if norm >= 1 << 63:
        raise OverflowError("scores of these vectors don't fit 64 bits")
    sample = rows.orderBy(F.xxhash64("vec_id", "v")).limit(PIVOT_SAMPLE).select("v").toArrow().column("v").combine_chunks()
    space = spark.sparkContext.broadcast(Space(dim, norm, _matrix(sample, dim)))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = space.value
        for b in batches:
            x = _matrix(b.column(1), s.dim)
            d = s.distances(s.raised(x))
            pivot = d.argmin(axis=1) if len(d) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r.tobytes() for r in x.astype(s.kind)], pa.binary()),
                 pa.array(pivot, pa.int32()), pa.array(d[np.arange(len(d)), pivot])],
                names=["vec_id", "x", "pivot", "r"])

    keyed = rows.select(F.col("vec_id").cast("long"), "v").mapInArrow(key, "vec_id long, x binary, pivot int, r double")
    order = [F.col("pivot"), F.col("r"), F.col("vec_id").asc_nulls_last(), F.col("x")]
    size = max(annulus_rows, -(-n // MAX_ANNULI))
    placed = stored(numbered(keyed, order, "topk-keyed", out="row")
                    .withColumn("annulus", F.floor(F.col("row") / size) * (PIVOTS + 1) + F.col("pivot")), "topk-placed")

    def packed(batches: Iterator[pa.RecordBatch], is_query: bool) -> Iterator[pa.RecordBatch]:
        """Matrices of whole groups; rows come sorted by group."""
        s, held, group = space.value, [], None

        def out():
            g, row, vec, x, r = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([g[0]], pa.int64()), pa.array([row], pa.list_(pa.int64())), pa.array([vec], pa.list_(pa.int64())),
                 pa.array([b"".join(x)], pa.binary()), pa.array([min(r)]), pa.array([max(r)])],
                names=["grp", "rows", "ids", "x", "lo", "hi"])

        for b in batches:
            for t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and t[0] != group:
                    yield out()
                    held = []
                group = t[0]
                held.append(t)
        if held:
            yield out()

    packing = "grp long, rows array<long>, ids array<long>, x binary, lo double, hi double"
    annuli = stored(placed.repartition("annulus").sortWithinPartitions("annulus", "row")
                    .select("annulus", "row", "vec_id", "x", "r").mapInArrow(lambda b: packed(b, False), packing), "topk-annuli")
    # at most MAX_ANNULI + PIVOTS + 1 rows
    meta = annuli.select("grp", "lo", "hi").toArrow()
    bounds = spark.sparkContext.broadcast(tuple(meta.column(c).to_numpy() for c in ("grp", "lo", "hi")))

    asked = placed.where((F.col("vec_id") % every) == 0)
    blocks = (numbered(asked.select("row", "vec_id", "x", "r"), [F.col("row")], "topk-asked", out="place")
              .withColumn("block", F.floor(F.col("place") / query_rows)))
    queries = stored(blocks.repartition("block").sortWithinPartitions("block", "row")
                     .select("block", "row", "vec_id", "x", "r").mapInArrow(lambda b: packed(b, True), packing)
                     .select(F.col("grp").alias("block"), F.col("rows").alias("q_rows"), F.col("ids").alias("q_ids"),
                             F.col("x").alias("q")), "topk-queries")

    def need(batches: Iterator[pa.RecordBatch], limit: int | None) -> Iterator[pa.RecordBatch]:
        """Annuli of each query block whose bound reaches the threshold of one of its queries."""
        s, (grp, lo, hi) = space.value, bounds.value
        for b in batches:
            for i in range(b.num_rows):
                block, q, level = (b.column(c)[i].as_py() for c in range(3))
                q = np.frombuffer(q, s.kind).reshape(-1, s.dim).astype(np.float64)
                far = s.distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1))
                top = (q * q).sum(axis=1) + s.norm
                level = np.array([-np.inf if x is None else x for x in level])
                reach = np.full(len(grp), -np.inf)
                for at in range(0, len(grp), 4096):
                    part = slice(at, at + 4096)
                    d = far[:, grp[part] % (PIVOTS + 1)]
                    gap = np.maximum(0, np.maximum(lo[part] - d, d - hi[part]))
                    bound = (top[:, None] - gap ** 2) / 2 + s.slack()
                    reach[part] = np.where(bound >= level[:, None], bound, -np.inf).max(axis=0)
                at = np.flatnonzero(reach > -np.inf)
                at = at[np.argsort(-reach[at], kind="stable")][:limit]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(at), pa.int64()), pa.array(grp[at])],
                                                 names=["block", "grp"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = space.value
        for b in batches:
            for i in range(b.num_rows):
                q_rows, q_ids, q, level, rows_, ids, x = (b.column(c)[i].as_py() for c in range(7))
                q = np.frombuffer(q, s.kind).reshape(-1, s.dim)
                x = np.frombuffer(x, s.kind).reshape(-1, s.dim)
                rows_, q_rows = np.array(rows_), np.array(q_rows)
                vec = np.array([np.iinfo(np.int64).max if v is None else v for v in ids])
                rank = np.lexsort((rows_, [v is None for v in ids], vec))
                order = np.empty(len(rank), np.int64)
                order[rank] = np.arange(len(rank))
                place = {r: j for j, r in enumerate(rows_.tolist())}
                own = np.array([place.get(r, -1) for r in q_rows.tolist()])
                found = s.scores(q, x)
                got = []
                for j, at in best_in(found, own, order, k):
                    if level[j] is not None:
                        at = at[found[j, at] >= level[j]]
                    got += [(int(q_rows[j]), q_ids[j], int(rows_[a]), ids[a], int(found[j, a])) for a in at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in (zip(*got, strict=True) if got else [[]] * 5)],
                    names=["q_row", "query_id", "row", "vec_id", "score"])

    found_schema = "q_row long, query_id long, row long, vec_id long, score long"
    best = Window.partitionBy("q_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")

    def evaluated(pairs: DataFrame, levels: DataFrame, name: str) -> DataFrame:
        left = queries.join(levels, "block")
        work = pairs.join(annuli, "grp").join(left, "block").select("q_rows", "q_ids", "q", "level", "rows", "ids", "x")
        return stored(work.mapInArrow(score, found_schema), name)

    def trimmed(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def thresholds(found: DataFrame | None, name: str) -> DataFrame:
        """``block, level``: each query's k-th score so far, in the block's order of queries."""
        if found is None:
            none = F.array().cast("array<long>")
            return queries.select("block", F.transform("q_rows", lambda _: F.lit(None).cast("long")).alias("level"))
        kth = found.where(F.col("rank") == k).select("q_row", F.col("score").alias("kth"))
        asked_ = queries.select("block", F.posexplode("q_rows").alias("pos", "q_row")).join(kth, "q_row", "left")
        return stored(asked_.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pos", "kth"))).alias("l"))
                      .select("block", F.transform("l", lambda x: x["kth"]).alias("level")), name)

    home = (placed.where((F.col("vec_id") % every) == 0).select("row", F.col("annulus").alias("grp"))
            .join(queries.select("block", F.explode("q_rows").alias("row")), "row").select("block", "grp").distinct())
    done = stored(home, "topk-home")
    found = stored(trimmed(evaluated(done, thresholds(None, ""), "topk-found-home")), "topk-best-home")
    for i, limit in enumerate(rounds):
        levels = thresholds(found, f"topk-levels{i}")
        wanted = queries.join(levels, "block").select("block", "q", "level").mapInArrow(
            lambda b, limit=limit: need(b, limit), "block long, grp long")
        todo = stored(wanted.join(done, ["block", "grp"], "left_anti"), f"topk-need{i}")
        more = evaluated(todo, levels, f"topk-found{i}")
        found = stored(trimmed(found.drop("rank").unionByName(more)), f"topk-best{i}")
        done = done.unionByName(todo)
    return found.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
