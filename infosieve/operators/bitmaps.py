"""Position bitmaps: candidate x winner tables (A4, J2) by AND and popcount.

The non-zero cells of any layout are turned once into one row per (feature, level, block of
``BLOCK`` positions) that holds the positions as bits of ``WORDS`` 64-bit words.  Two levels meet as often
as their words have common bits, so an iteration joins the winner's few bitmap rows to the
candidates' on the block and sums ``bit_count(x & y)``; no cell is unpacked again.  Blocks that hold no
position of a level have no row, and a row never stands for more cells than it replaces.

The class is held the same way, so the relevance pass reads bitmaps too.  Cells where the winner is zero
come from the candidates' marginals (``recover_zero_other``).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import FeatureWise, Prepared, col_of
from .contingency import hinted

WORDS = 4
BLOCK = 64 * WORDS


def pack(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``cells(keys..., pos)`` -> ``(keys..., block, w0 ... w3)``; partial words are OR-ed map-side."""
    pos = F.col("pos")
    bit = F.expr("shiftleft(1L, CAST(pos & 63 AS INT))")
    word = F.shiftright(pos, 6).bitwiseAND(WORDS - 1)
    return (cells.select(*keys, F.floor(pos / BLOCK).cast("long").alias("block"), word.alias("w"), bit.alias("bit"))
            .groupBy(*keys, "block").agg(*[F.bit_or(F.when(F.col("w") == i, F.col("bit")).otherwise(F.lit(0).cast("long")))
                                           .alias(f"w{i}") for i in range(WORDS)]))


def common(left: str = "w", right: str = "v") -> Column:
    """How many positions two bitmap rows of one block have in common."""
    return sum((F.bit_count(F.col(f"{left}{i}").bitwiseAND(F.col(f"{right}{i}"))) for i in range(1, WORDS)),
               F.bit_count(F.col(f"{left}0").bitwiseAND(F.col(f"{right}0"))))


class BitmapCells:
    """A layout whose tables are counted from bitmaps; made from any other layout.

    Instance layouts get positions by numbering the rows of one checkpoint, which a lost executor rereads
    unchanged; feature-wise input has its own positions."""

    def __init__(self, layout):
        self.layout = layout
        self.broadcast_rows = layout.broadcast_rows if hasattr(layout, "broadcast_rows") else 1_000_000
        self._held: list[DataFrame] = []

    def __getattr__(self, name):
        if name == "layout":
            raise AttributeError(name)
        return getattr(self.layout, name)

    def prepare(self, broadcast_rows: int) -> Prepared:
        inner = self.layout
        inner.broadcast_rows = self.broadcast_rows
        done = inner.prepare(broadcast_rows)
        if isinstance(inner, FeatureWise):
            cells, classes = inner.cells_df.select("feature", "pos", "a"), inner._class
        else:
            pos, b = inner.CARRY_OTHER, inner.CARRY_B
            rows = inner.rows.select(F.monotonically_increasing_id().alias(pos), col_of(inner.label).alias(b),
                                     *inner.payload()).checkpoint(eager=True)
            cells = inner.explode(rows, [pos], []).select("feature", F.col(pos).alias("pos"), "a")
            classes = rows.select(F.col(pos).alias("pos"), F.col(b).alias("b"))
        self._n = done.n
        bitmaps, of_class = pack(cells, ["feature", "a"]), pack(classes, ["b"])
        if done.n > self.broadcast_rows:
            # the other side of each join is too large to broadcast: bring blocks together once
            bitmaps = bitmaps.repartition("block")
        self._held = [bitmaps.persist(StorageLevel.MEMORY_AND_DISK), of_class.persist(StorageLevel.MEMORY_AND_DISK)]
        self.bitmaps, self._of_class = self._held
        return done

    def _counts(self, candidates: DataFrame, other: DataFrame, rows: int | None, keys: list[str]) -> DataFrame:
        """``(feature, keys..., a, b, n)`` of the candidates' bitmaps with those of ``other``."""
        side = other.select(*keys, "b", "block", *[F.col(f"w{i}").alias(f"v{i}") for i in range(WORDS)])
        met = candidates.join(hinted(side, rows, self.broadcast_rows), "block")
        return (met.select("feature", *keys, "a", "b", common().alias("n")).where("n > 0")
                .groupBy("feature", *keys, "a", "b").agg(F.sum("n").alias("n")))

    def class_counts(self) -> DataFrame:
        """A3: ``(feature, a, b, n)`` of every feature with the class."""
        return self._counts(self.bitmaps, self._of_class, self._n, [])

    def winner_counts(self, winners: list, exclude: list, rows: int | None = None, only: list | None = None) -> DataFrame:
        """A4: ``(feature, other, a, b, n)`` of the candidates (``only`` those given) with the winners' non-zero
        levels; ``rows`` is a bound of the winners' bitmap rows."""
        def ids(values):
            return F.col("feature").isin([F.lit(v).cast(self.layout.feature_type) for v in values])
        found = self.bitmaps.where(ids(winners)).withColumnRenamed("a", "b").withColumnRenamed("feature", "other")
        cand = self.bitmaps.where(~ids(exclude)) if exclude else self.bitmaps
        if only is not None:
            cand = cand.where(ids(only)) if only else cand.where(F.lit(False))
        return self._counts(cand, found, rows, ["other"])

    def unpersist(self) -> None:
        for df in self._held:
            df.unpersist()
        self.layout.unpersist()
