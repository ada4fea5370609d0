"""Data layouts of the selection input, and the unpivot to (row, feature, value) cells.

Instance-wise layouts keep one row per observation.  A pass over them explodes each row
into its **non-zero** cells and pairs every cell with a per-row value of the "other"
variable: the label, or the value of a selected feature read from the same row (plain
column reference / array index / map lookup), so pairing never needs a join.

* ``WideInstances``  - one column per feature (``df.select(label, *features)``)
* ``ArrayInstances`` - one ARRAY column, feature = 0-based position
* ``MapInstances``   - one MAP<feature, value> column of the non-zero cells (sparse data)

The feature-wise layout (``FeatureWise``) keeps one row per feature; its cells are paired
with the class vector and with the selected features' vectors by an equi-join on the
instance position, broadcast only when the vector's row count is known to be small.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .alignment import KEY, drop_stored, feature_key, store_by_position, store_cells
from .contingency import hinted

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType, T.BooleanType)


SMALL = (T.ByteType, T.ShortType, T.IntegerType, T.BooleanType)


@dataclass
class Prepared:
    """What a layout knows after its one validation / class-histogram job."""
    n: int                 # number of instances
    hist: DataFrame        # (b, nb) class histogram, materialised
    n_classes: int


def _bad_value(c: Column, dtype: T.DataType) -> Column:
    bad = c.isNull()
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        bad = bad | F.isnan(c)
    return bad


def col_of(name: str) -> Column:
    """A column by its exact name (dots, spaces and backticks are not parsed)."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh_names(names: list[str], taken: list[str]) -> list[str]:
    """``names``, each with as many underscores in front as it takes to be none of ``taken``."""
    lower, out = {t.lower() for t in taken}, []
    for n in names:
        while n.lower() in lower:
            n = "_" + n
        out.append(n)
    return out


def level_type(types: list[T.DataType]) -> T.DataType:
    """A type that holds the levels of all columns exactly: their own one (integers as LONG,
    floating point as DOUBLE), DOUBLE for small integers among floating point, else STRING."""
    def own(t):
        if isinstance(t, (*SMALL, T.LongType)):
            return T.LongType()
        return T.DoubleType() if isinstance(t, T.FloatType) else t
    kinds = {own(t).simpleString(): own(t) for t in types}
    if len(kinds) == 1:
        return next(iter(kinds.values()))
    if all(isinstance(t, (*SMALL, T.FloatType, T.DoubleType)) for t in types):
        return T.DoubleType()
    return T.StringType()


def zero_of(dtype: T.DataType):
    """The zero level as it is written in ``dtype``; None for types without one."""
    if isinstance(dtype, T.StringType):
        return "0"
    if isinstance(dtype, T.DecimalType):
        return Decimal(0)
    return 0.0 if isinstance(dtype, T.DoubleType) else 0 if isinstance(dtype, T.LongType) else None


def level(c: Column, dtype: T.DataType, to: T.DataType) -> Column:
    """``c`` as a level; zeros of numbers among strings are all written ``0``."""
    if isinstance(to, T.StringType) and isinstance(dtype, NUMERIC):
        number = c.cast("int") if isinstance(dtype, T.BooleanType) else c
        return F.when(number == 0, F.lit("0")).otherwise(number.cast("string"))
    if isinstance(dtype, T.BooleanType):
        c = c.cast("int")
    return c.cast(to)


def _finish_hist(hist: DataFrame, extra: list[str], what: str):
    """Materialise a class histogram ``(b, nb, bad, extra...)`` and sum it up.

    Returns ``(hist(b, nb), n, levels, row of the extras' minima and maxima)``."""
    hist = hist.checkpoint(eager=True)
    agg = [F.sum("nb").alias("n"), F.count(F.lit(1)).alias("levels"), F.sum("bad").alias("bad")]
    agg += [F.min(e).alias("min_" + e) for e in extra] + [F.max(e).alias("max_" + e) for e in extra]
    row = hist.agg(*agg).first()
    if row["bad"]:
        raise ValueError(f"{row['bad']} {what} hold a null or NaN label or feature value")
    return hist.select("b", "nb"), int(row["n"] or 0), int(row["levels"]), row


def _input_bytes(df: DataFrame) -> int:
    """Bytes of the relations a plan reads (sum over its leaves, from the optimizer's
    statistics: file sizes for scans).  Join estimates can be far off; the leaves are not."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


class _Instances:
    """Shared code of the instance-wise layouts.

    ``rows`` is the projected input (label + features only).  With ``cache=True`` it is
    persisted (MEMORY_AND_DISK: a lost block is recomputed from the source) because every
    iteration scans it once.  A small input (its source relations under ``SPREAD_BYTES``) is
    first spread round-robin over the cluster's cores, so a one-file table does not run
    every pass in one task; large inputs keep their file splits (no extra shuffle).  The
    size comes from the plan statistics, so nothing is executed to decide.
    """

    SPREAD_BYTES = 1 << 30

    value_type: T.DataType = T.DoubleType()
    zero = 0.0
    feature_type: T.DataType = T.StringType()

    #: Names of the carried columns; a layout whose rows have the user's column names picks others.
    CARRY_B, CARRY_OTHER = "__b", "__other"

    def __init__(self, df: DataFrame, label: str, cache: bool):
        self.label = label
        if cache:
            cores = df.sparkSession.sparkContext.defaultParallelism
            if _input_bytes(df) < self.SPREAD_BYTES:
                df = df.repartition(cores)
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
        self.rows = df
        self._cached = cache

    # --- per layout -------------------------------------------------------------------
    def explode(self, base: DataFrame, carry: list[str], exclude: list, only: list | None = None) -> DataFrame:
        """``base`` (= rows plus carried columns) -> ``(carry..., feature, a)``, non-zero only; of the
        features ``only``, if given, no other cell is made."""
        raise NotImplementedError

    def value_of(self, feature) -> Column:
        raise NotImplementedError

    def bad_row(self) -> Column:
        raise NotImplementedError

    def payload(self) -> list[Column]:
        raise NotImplementedError

    def feature_ids(self) -> DataFrame | None:
        return None

    def names(self) -> DataFrame | None:
        """``(feature, name)`` when internal ids differ from the user's ids (hashed keys)."""
        return None

    def other_id(self, name) -> Column:
        return F.lit(name).cast(self.feature_type)

    # --- common ------------------------------------------------------------------------
    def zero_level(self) -> Column:
        return F.lit(self.zero).cast(self.value_type)

    def extra_checks(self) -> list[Column]:
        """Per-class aggregates folded into the histogram job (named columns)."""
        return []

    def prepare(self, broadcast_rows: int) -> Prepared:
        y = col_of(self.label)
        extra = self.extra_checks()
        hist = (self.rows.groupBy(y.alias("b"))
                .agg(F.count(F.lit(1)).alias("nb"),
                     F.sum(F.when(y.isNull() | self.bad_row(), 1).otherwise(0)).alias("bad"), *extra))
        names = [c for c in hist.columns if c not in ("b", "nb", "bad")]
        small, n, levels, self._extra = _finish_hist(hist, names, "rows")
        return Prepared(n, small, levels)

    def class_rows(self, exclude: list) -> DataFrame:
        """(feature, a, b): every non-zero cell of a candidate with the row's label."""
        b = self.CARRY_B
        base = self.rows.select(col_of(self.label).alias(b), *self.payload())
        return self.explode(base, [b], exclude).select("feature", "a", F.col(b).alias("b"))

    def winner_rows(self, winners: list, exclude: list, nonzero_only: bool = False,
                    zero_only: bool = False, only: list | None = None) -> DataFrame:
        """(feature, other, a, b): every non-zero candidate cell (of the candidates ``only``, if given) with
        each winner's value, read from the same row (no join).  ``nonzero_only`` keeps only the rows where the
        winner is non-zero (its support), ``zero_only`` those where it is zero; the skipped
        cells are then recovered from the candidates' marginals."""
        b, other = self.CARRY_B, self.CARRY_OTHER
        if len(winners) == 1:
            w = winners[0]
            base = self.rows.select(self.other_id(w).alias(other),
                                    self.value_of(w).alias(b), *self.payload())
        else:
            others = F.array(*[F.struct(self.other_id(w).alias(other),
                                        self.value_of(w).alias(b)) for w in winners])
            base = self.rows.select(F.inline(others), *self.payload())
        if nonzero_only:
            base = base.where(F.col(b) != self.zero_level())
        elif zero_only:
            base = base.where(F.col(b) == self.zero_level())
        return self.explode(base, [other, b], exclude, only).select(
            "feature", F.col(other).alias("other"), "a", F.col(b).alias("b"))

    def unpersist(self) -> None:
        if self._cached:
            self.rows.unpersist()


class WideInstances(_Instances):
    """One column per feature, of any groupable types.

    Levels keep their columns' type where all columns share it, else they are compared as
    strings (``level_type``).  The zero rule holds per feature: cells of numeric columns that
    are zero are skipped, other columns have no zero."""

    #: Columns up to which the unpivot is an Expand inside whole-stage codegen; wider tables hold
    #: their levels in one array from the start (null where a number is zero), which has no
    #: width limit.  Same rows either way.
    EXPAND_COLUMNS = 200
    def __init__(self, df: DataFrame, label: str, features: list[str] | None = None, cache: bool = True):
        features = list(features) if features is not None else [c for c in df.columns if c != label]
        if len(set(features)) != len(features):
            raise ValueError("duplicate feature column")
        types = {f.name: f.dataType for f in df.schema.fields}
        missing = [c for c in [label, *features] if c not in types]
        if missing:
            raise ValueError(f"unknown columns {missing}")
        self.value_type = level_type([types[c] for c in features]) if features else T.DoubleType()
        self.zero = zero_of(self.value_type)
        self.features = features
        self._types = types
        self.in_array = len(features) > self.EXPAND_COLUMNS
        self.CARRY_B, self.CARRY_OTHER, self.LEVELS, self.BAD = fresh_names(
            ["__b", "__other", "__levels", "__bad"], [label, *features])
        rows = df.select(col_of(label), *[col_of(f) for f in features])
        if self.in_array:
            self._place = {f: i for i, f in enumerate(features)}
            # SQL text: one expression is parsed, where thousands of Column objects would be built
            levels, bad = (F.expr(f"array({', '.join(make(f) for f in features)})") for make in (self._level_sql, self._bad_sql))
            rows = df.select(col_of(label), levels.alias(self.LEVELS), F.exists(bad, lambda x: x).alias(self.BAD))
        super().__init__(rows, label, cache)

    def _level(self, feature) -> Column:
        """The level, null where a number is zero."""
        c = level(col_of(feature), self._types[feature], self.value_type)
        return F.when(c != self.zero_level(), c) if isinstance(self._types[feature], NUMERIC) else c

    def _level_sql(self, feature) -> str:
        """``_level`` as SQL text."""
        name, dtype, to = "`" + feature.replace("`", "``") + "`", self._types[feature], self.value_type
        number = f"CAST({name} AS INT)" if isinstance(dtype, T.BooleanType) else name
        if not isinstance(dtype, NUMERIC):
            return f"CAST({name} AS {to.simpleString()})"
        # null where the number is zero; a null or NaN is found by ``_bad_sql``
        return f"CASE WHEN {number} <> 0 THEN CAST({number} AS {to.simpleString()}) END"

    def _bad_sql(self, feature) -> str:
        name, dtype = "`" + feature.replace("`", "``") + "`", self._types[feature]
        nan = f" OR isnan({name})" if isinstance(dtype, (T.FloatType, T.DoubleType)) else ""
        return f"({name} IS NULL{nan})"

    def _any_bad(self) -> Column:
        return F.exists(F.array(*[_bad_value(col_of(f), self._types[f]) for f in self.features]), lambda x: x) \
            if self.features else F.lit(False)

    def value_of(self, feature) -> Column:
        if self.in_array:
            return F.coalesce(F.col(self.LEVELS)[self._place[feature]], self.zero_level())
        return level(col_of(feature), self._types[feature], self.value_type)

    def payload(self) -> list[Column]:
        return [F.col(self.LEVELS)] if self.in_array else [self._level(f).alias(f) for f in self.features]

    def explode(self, base, carry, exclude, only=None):
        out_of = set(exclude)
        keep = [f for f in (self.features if only is None else only) if f not in out_of]
        if not keep:
            return base.select(*carry, F.lit(None).cast("string").alias("feature"),
                               F.lit(None).cast(self.value_type).alias("a")).where(F.lit(False))
        if not self.in_array:
            return base.unpivot(carry, [col_of(f) for f in keep], "feature", "a").where(F.col("a").isNotNull())
        if only is not None:
            cells = [F.struct(F.lit(f).alias("feature"), F.col(self.LEVELS)[self._place[f]].alias("a")) for f in keep]
            return base.select(*carry, F.inline(F.array(*cells))).where(F.col("a").isNotNull())
        names = F.array(*[F.lit(f) for f in self.features])
        out = (base.select(*carry, F.posexplode(self.LEVELS).alias("__i", "a")).where(F.col("a").isNotNull())
               .select(*carry, F.get(names, F.col("__i")).alias("feature"), "a"))
        return out.where(~F.col("feature").isin(list(exclude))) if exclude else out

    def bad_row(self) -> Column:
        return F.col(self.BAD) if self.in_array else self._any_bad()

    def feature_ids(self) -> DataFrame:
        spark = self.rows.sparkSession
        return spark.createDataFrame([(f,) for f in self.features], "feature string")


class ArrayInstances(_Instances):
    """One ARRAY column; feature ids are the 0-based positions (INT).  Arrays of numbers skip
    their zeros, arrays of other types have none."""

    feature_type = T.IntegerType()

    def __init__(self, df: DataFrame, label: str, array_col: str, cache: bool = True):
        element = df.schema[array_col].dataType.elementType
        self.value_type = level_type([element])
        self.zero = zero_of(self.value_type) if isinstance(element, NUMERIC) else None
        values = F.transform(col_of(array_col), lambda x: level(x, element, self.value_type))
        self.array_col = "__values"
        super().__init__(df.select(col_of(label).alias("__label"), values.alias(self.array_col)), "__label", cache)

    def value_of(self, feature) -> Column:
        return col_of(self.array_col)[int(feature)]

    def payload(self) -> list[Column]:
        return [col_of(self.array_col)]

    def explode(self, base, carry, exclude, only=None):
        if only is None:
            each = F.posexplode(col_of(self.array_col)).alias("feature", "a")
        elif only:
            each = F.inline(F.array(*[F.struct(F.lit(int(f)).alias("feature"), self.value_of(f).alias("a")) for f in only]))
        else:
            return base.select(*carry, F.lit(0).alias("feature"), self.zero_level().alias("a")).where(F.lit(False))
        out = base.select(*carry, each)
        if self.zero is not None:
            out = out.where(F.col("a") != self.zero_level())
        ex = [int(e) for e in exclude]
        return out.where(~F.col("feature").isin(ex)) if ex else out

    def bad_row(self) -> Column:
        c = col_of(self.array_col)
        return c.isNull() | F.exists(c, lambda x: _bad_value(x, self.value_type))

    def extra_checks(self) -> list[Column]:
        return [F.min(F.size(col_of(self.array_col))).alias("lo"), F.max(F.size(col_of(self.array_col))).alias("hi")]

    def prepare(self, broadcast_rows: int) -> Prepared:
        p = super().prepare(broadcast_rows)
        lo, hi = self._extra["min_lo"] or 0, self._extra["max_hi"] or 0
        if lo != hi:
            raise ValueError(f"ragged rows: arrays of {lo} to {hi} values")
        self.width = int(hi or 0)
        return p

    def feature_ids(self) -> DataFrame:
        return self.rows.sparkSession.range(self.width).select(F.col("id").cast("int").alias("feature"))


class MapInstances(_Instances):
    """One MAP<feature, value> column holding the non-zero cells of each row; an absent
    feature is zero (``0`` among strings).

    ``hash_keys=True`` aggregates string keys (tokens, names) as 64-bit hashes (``xxhash64``):
    grouping and sorting a LONG is about twice as fast as a string, which pays off on very
    large vocabularies (it costs one extra pass to build the hash -> key dictionary).  If two
    keys collide the layout falls back to the strings, so results never depend on the
    hashing; users always see the original keys and ties are broken by them.
    """

    def __init__(self, df: DataFrame, label: str, map_col: str, cache: bool = True, hash_keys: bool = False,
                 width: int | None = None):
        mt = df.schema[map_col].dataType
        if not isinstance(mt, T.MapType):
            raise ValueError(f"{map_col} is not a MAP column")
        if width is not None and not isinstance(mt.keyType, T.IntegerType):
            raise ValueError("a width needs positions (INT) as keys")
        self.width = width
        self.name_type = mt.keyType
        is_str = isinstance(mt.keyType, T.StringType)
        self.hash_keys = bool(hash_keys) and is_str
        self.feature_type = T.LongType() if self.hash_keys else mt.keyType
        self._names = None
        self.value_type = level_type([mt.valueType])
        self.zero = zero_of(self.value_type)
        if self.zero is None:
            raise ValueError(f"values of {mt.valueType.simpleString()} have no zero for absent features")
        m = F.transform_values(col_of(map_col), lambda k, v: level(v, mt.valueType, self.value_type))
        m = F.map_filter(m, lambda k, v: _bad_value(v, self.value_type) | (v != self.zero_level()))
        self.map_col = "__cells"
        super().__init__(df.select(col_of(label).alias("__label"), m.alias(self.map_col)), "__label", cache)

    def value_of(self, feature) -> Column:
        return F.coalesce(col_of(self.map_col)[F.lit(feature).cast(self.name_type)], self.zero_level())

    def other_id(self, name) -> Column:
        return F.xxhash64(F.lit(name).cast(self.name_type)) if self.hash_keys else super().other_id(name)

    def payload(self) -> list[Column]:
        return [col_of(self.map_col)]

    def explode(self, base, carry, exclude, only=None):
        cells = col_of(self.map_col)
        if only is not None:
            wanted = [F.lit(f).cast(self.name_type) for f in only]
            cells = F.map_filter(cells, lambda k, v: k.isin(wanted))
        out = base.select(*carry, F.explode(cells).alias("__key", "a"))
        if exclude:
            out = out.where(~F.col("__key").isin(list(exclude)))
        key = F.xxhash64("__key") if self.hash_keys else F.col("__key")
        return out.select(*carry, key.alias("feature"), "a")

    def bad_row(self) -> Column:
        c = col_of(self.map_col)
        return c.isNull() | F.exists(F.map_values(c), lambda v: _bad_value(v, self.value_type))

    def prepare(self, broadcast_rows: int) -> Prepared:
        p = super().prepare(broadcast_rows)
        if self.hash_keys:
            d = (self.rows.select(F.explode(F.map_keys(col_of(self.map_col))).alias("name")).distinct()
                 .select(F.xxhash64("name").alias("feature"), "name"))
            d = d.checkpoint(eager=True)
            clash = d.groupBy("feature").count().where(F.col("count") > 1).limit(1).count()
            if clash:
                self.hash_keys, self.feature_type = False, self.name_type
            else:
                self._names = d
        return p

    def names(self) -> DataFrame | None:
        return self._names if self.hash_keys else None

    def feature_ids(self) -> DataFrame | None:
        """The positions of the declared ``width``, features that are zero everywhere included."""
        return None if self.width is None else self.rows.sparkSession.range(self.width).select(F.col("id").cast("int").alias("feature"))


class VectorInstances(MapInstances):
    """One ML vector column, read as its (index, value) pairs; feature ids are positions (INT)."""

    def __init__(self, df: DataFrame, label: str, vector_col: str, cache: bool = True):
        v = F.unwrap_udt(col_of(vector_col))
        sparse = v["type"] == 0
        self._size = F.when(sparse, v["size"]).otherwise(F.size(v["values"]))
        places = F.when(sparse, v["indices"]).otherwise(
            F.transform(v["values"], lambda x, i: i))
        pairs = df.select(col_of(label).alias("y"), F.map_from_arrays(places, v["values"]).alias("cells"),
                          self._size.alias("width"))
        self._widths = pairs.select("width")
        super().__init__(pairs, "y", "cells", cache)

    def prepare(self, broadcast_rows: int) -> Prepared:
        p = super().prepare(broadcast_rows)
        lo, hi = self._widths.agg(F.min("width"), F.max("width")).first()
        if lo != hi:
            raise ValueError(f"ragged rows: vectors of {lo} to {hi} values")
        self.width = int(hi or 0)
        return p

    def feature_ids(self) -> DataFrame:
        return self.rows.sparkSession.range(self.width).select(F.col("id").cast("int").alias("feature"))


class FeatureWise:
    """One row per feature.  ``cells(feature, pos, a)`` holds the non-zero values, ``classes``
    is ``(pos, b)`` with one row per instance position 0 ... n-1.  With ``dense`` the cells
    ``(feature, pos, x)`` hold zeros too, which vector scores need; they are cached once,
    partitioned by position when a position vector is too large to broadcast, and the
    non-zero cells are read from them.

    ``store`` keeps the cells (and the class) in tables of that many buckets by position, sorted by feature
    key inside each file, in place of the cache: a feature is fetched by a read that skips the row groups of
    other features, and cells meet winners and class without moving (no exchange)."""

    broadcast_rows = 1_000_000
    winner_rows_takes_nnz = True
    check_unique = True
    expected_cells = None

    def __init__(self, cells: DataFrame, classes: DataFrame, ids: DataFrame, cache: bool = True,
                 lengths: DataFrame | None = None, dense: bool = False, value_type: T.DataType | None = None,
                 zero=0.0, store: int | None = None):
        self.store = store
        self.source = cells           # (feature, pos, a): with zeros if dense
        self.dense = dense
        self.cells_df = None          # non-zero cells, set in prepare()
        self._cache = cache
        self._held = None
        self.classes = classes
        self.ids = ids
        self.lengths = lengths
        self.feature_type = ids.schema["feature"].dataType
        self.value_type = value_type or T.DoubleType()
        self.zero = zero

    @property
    def rows(self) -> DataFrame:
        return self.source

    @classmethod
    def from_arrays(cls, df: DataFrame, id_col: str, values_col: str, classes: DataFrame,
                    cache: bool = True, store: int | None = None) -> "FeatureWise":
        """``df(id, values ARRAY)`` plus ``classes(pos, label)``."""
        element = df.schema[values_col].dataType.elementType
        to = level_type([element])
        base = df.select(col_of(id_col).alias("feature"),
                         F.transform(col_of(values_col), lambda x: level(x, element, to)).alias("v"))
        lengths = base.select("feature", F.size("v").alias("len"),
                              F.coalesce(F.exists("v", lambda x: _bad_value(x, to)), F.lit(True)).alias("bad"))
        return cls(base.select("feature", F.posexplode("v").alias("pos", "a"))
                   .select("feature", F.col("pos").cast("long").alias("pos"), "a"), classes, base.select("feature"), cache,
                   lengths=lengths, dense=True, value_type=to, zero=zero_of(to) if isinstance(element, NUMERIC) else None,
                   store=store)

    @classmethod
    def from_cells(cls, cells: DataFrame, classes: DataFrame, feature: str = "feature", pos: str = "pos",
                   value: str = "value", ids: DataFrame | None = None, cache: bool = True,
                   dense: bool = False, check_unique: bool = True, store: int | None = None) -> "FeatureWise":
        """Long cells.  ``dense=True`` says every (feature, position) cell is present, zeros
        included, which vector scores need."""
        kind = cells.schema[value].dataType
        to = level_type([kind])
        c = cells.select(col_of(feature).alias("feature"), col_of(pos).cast("long").alias("pos"),
                         level(col_of(value), kind, to).alias("a"))
        out = cls(c, classes, ids if ids is not None else c.select("feature").distinct(), cache, dense=dense,
                  value_type=to, zero=zero_of(to), store=store)
        out.check_unique = check_unique
        return out

    def zero_level(self) -> Column:
        return F.lit(self.zero).cast(self.value_type)

    def prepare(self, broadcast_rows: int) -> Prepared:
        cl = self.classes.select(F.col("pos").cast("long").alias("pos"), F.col("b"))
        hist = (cl.groupBy("b").agg(F.count(F.lit(1)).alias("nb"),
                                    F.sum(F.when(_bad_value(F.col("b"), cl.schema["b"].dataType)
                                                 | F.col("pos").isNull(), 1).otherwise(0)).alias("bad")))
        small, n, levels, _ = _finish_hist(hist, [], "class positions")
        at = cl.agg(F.count_distinct("pos").alias("d"), F.min("pos").alias("lo"), F.max("pos").alias("hi")).first()
        if at["d"] != n:
            raise ValueError("class vector has repeated positions")
        if n and (at["lo"], at["hi"]) != (0, n - 1):
            raise ValueError(f"class positions run from {at['lo']} to {at['hi']}, not from 0 to {n - 1}")
        held = self.source
        if not self.dense and self.zero is not None:
            held = held.where(_bad_value(F.col("a"), self.value_type) | (F.col("a") != self.zero_level()))
        if self.store is not None:
            if self._held is None:
                self._held = store_cells(held.select("feature", "pos", "a"), self.store)
                self._class_table = store_by_position(cl, self.store)
            held, cl = self._held, self._class_table
        elif self._cache and self._held is None:
            if n > self.broadcast_rows:
                # position vectors too large to broadcast: co-locate the cells by position once,
                # so every later join on pos shuffles only the (small) vector side
                held = held.repartition("pos")
            self._held = held = held.persist(StorageLevel.MEMORY_AND_DISK)
        self._dense = held if self.dense else None
        # one job on the held cells: duplicate ids, wrong lengths, null / NaN values, positions out of range
        if self.lengths is not None:
            chk = self.lengths.groupBy("feature").agg(F.count(F.lit(1)).alias("k"), F.max("len").alias("len"),
                                                      F.max(F.col("bad").cast("int")).alias("bad"))
            r = chk.agg(F.max("k").alias("dup"), F.sum(F.when(F.col("len") != n, 1).otherwise(0)).alias("badlen"),
                        F.sum("bad").alias("bad")).first()
            if r["dup"] is not None and r["dup"] > 1:
                raise ValueError("Multiple features with the same ID")
            if r["bad"]:
                raise ValueError(f"{r['bad']} features hold a null or NaN value")
            if r["badlen"]:
                raise ValueError(f"{r['badlen']} feature vectors do not have the class vector's length {n}")
        else:
            bad = _bad_value(F.col("a"), self.value_type) | F.col("pos").isNull()
            r = held.agg(F.sum(F.when(bad, 1).otherwise(0)).alias("bad")).first()
            if r["bad"]:
                raise ValueError(f"{r['bad']} cells hold a null or NaN value")
            if self.check_unique:
                # a shuffle of the cells unless they are held by position; skip it with
                # check_unique=False for trusted input
                if held.groupBy("pos", "feature").count().where("count > 1").limit(1).count():
                    raise ValueError("Multiple features with the same ID")
        self.cells_df = held.where(F.col("a") != self.zero_level()) if self.dense and self.zero is not None else held
        if self.lengths is None:
            # every cell must meet a class position: checked after the relevance pass, which
            # counts the cells that joined (no extra pass over the join here)
            self.expected_cells = self.cells_df.count()
        self._n = n
        self._class = cl
        return Prepared(n, small, levels)

    def _candidates(self, cells: DataFrame, exclude: list | None) -> DataFrame:
        return cells.where(~F.col("feature").isin(list(exclude))) if exclude else cells

    def _fetch(self, cells: DataFrame, features: list) -> DataFrame:
        """The cells of some features (F3); on a stored table the keys prune what is read."""
        wanted = cells.where(F.col("feature").isin([F.lit(f).cast(self.feature_type) for f in features]))
        if self.store is None:
            return wanted
        return wanted.where(F.col(KEY).isin([feature_key(F.lit(f).cast(self.feature_type)) for f in features]))

    def _by_position(self, cells: DataFrame, features: list) -> DataFrame:
        """``(pos, m)``: the given features' values at each position as a map, read in one scan."""
        return (self._fetch(cells, features).groupBy("pos")
                .agg(F.map_from_entries(F.collect_list(F.struct("feature", "a"))).alias("m")))

    def class_rows(self, exclude: list) -> DataFrame:
        # every position has a class: inner equi-join; the class side is broadcast only below the bound
        return (self._candidates(self.cells_df, exclude)
                .join(hinted(self._class, self._n, self.broadcast_rows), "pos").select("feature", "a", "b"))

    def winner_rows(self, winners: list, exclude: list, nnz: dict | None = None,
                    nonzero_only: bool = False, zero_only: bool = False, only: list | None = None) -> DataFrame:
        """(feature, other, a, b): all winners' values meet the candidates (``only`` those given) in one
        join on position."""
        by_pos = self._by_position(self.cells_df, winners)
        rows = min(self._n, sum(int(x) for x in (nnz or {}).values())) if nnz else None
        c = self._candidates(self.cells_df, exclude) if only is None else self._fetch(self.cells_df, only)
        j = c.join(hinted(by_pos, rows, self.broadcast_rows), "pos", "inner" if nonzero_only else "left")
        if nonzero_only:
            return j.select("feature", "a", F.explode("m").alias("other", "b")).select("feature", "other", "a", "b")
        each = F.explode(F.array(*[F.lit(w).cast(self.feature_type) for w in winners]))
        j = j.select("feature", "a", "m", each.alias("other")).select("feature", "other", "a", F.col("m")[F.col("other")].alias("b"))
        if zero_only:
            j = j.where(F.col("b").isNull())
        if self.zero is None:
            return j
        return j.withColumn("b", F.coalesce("b", self.zero_level()))

    def _vectors(self) -> DataFrame:
        if self._dense is None:
            raise ValueError("vector scores need dense feature vectors (from_arrays or dense=True)")
        return self._dense

    def _class_values(self) -> DataFrame:
        numeric = isinstance(self._class.schema["b"].dataType, NUMERIC)
        return self._class.select("pos", (F.col("b").cast("double") if numeric else F.col("b")).alias("y"))

    def vector_terms(self, winners: list | None, terms: dict, exclude: list | None = None) -> DataFrame:
        """Aggregates ``fn(x, y)`` over aligned positions: against the class (``winners=None``)
        or against each winner's vector; one equi-join on ``pos`` for all winners."""
        d = self._candidates(self._vectors(), exclude)
        aggs = [fn.fn(F.col("a"), F.col("y")).alias(k) for k, fn in terms.items()]
        if winners is None:
            y = hinted(self._class_values(), self._n, self.broadcast_rows)
            return d.join(y, "pos").groupBy("feature").agg(*aggs)
        by_pos = hinted(self._by_position(self._vectors(), winners), self._n, self.broadcast_rows)
        return (d.join(by_pos, "pos").select("feature", "a", F.explode("m").alias("other", "y"))
                .groupBy("feature", "other").agg(*aggs))

    def joint_terms(self, selected: list, terms: dict) -> DataFrame:
        """Aggregates ``fn(x, y, s)`` over aligned positions: the candidate's value, the class and
        the list of the selected features' values, in selection order."""
        d = self._candidates(self._vectors(), selected)
        side = self._class_values()
        if selected:
            side = side.join(self._by_position(self._vectors(), selected), "pos")
        j = d.join(hinted(side, self._n, self.broadcast_rows), "pos")
        s = [F.col("m")[F.lit(w).cast(self.feature_type)] for w in selected]
        return j.groupBy("feature").agg(*[fn.fn(F.col("a"), F.col("y"), s).alias(k) for k, fn in terms.items()])

    def feature_ids(self) -> DataFrame:
        return self.ids

    def unpersist(self) -> None:
        if self._held is not None:
            if self.store is None:
                self._held.unpersist()
            else:
                drop_stored(self._held, self._class_table)
            self._held = None


def to_cells(df: DataFrame, row_id: str, features: list[str] | None = None, array_col: str | None = None,
             map_col: str | None = None) -> DataFrame:
    """Unpivot any instance table to its non-zero cells ``(row_id, feature, value)``.

    Values are levels as the layouts compare them (``level_type``): integers and decimals exactly, columns
    of different types as strings.  Only numbers have a zero to leave out; nulls and NaNs raise."""
    if row_id.lower() in ("feature", "value"):
        raise ValueError(f"the row id column can't be named {row_id!r}")
    rid = col_of(row_id).alias(row_id)

    def cell(value: Column, dtype: T.DataType, to: T.DataType) -> Column:
        bad = F.raise_error(F.lit("null or NaN feature value")).cast(to)
        return F.when(_bad_value(value, dtype), bad).otherwise(level(value, dtype, to))

    def nonzero(value: Column, to: T.DataType) -> Column:
        return value != F.lit(zero_of(to)).cast(to)

    if array_col:
        dtype = df.schema[array_col].dataType.elementType
        to = level_type([dtype])
        cells = F.transform(col_of(array_col), lambda x, i: F.struct(i.alias("feature"), cell(x, dtype, to).alias("value")))
        if isinstance(dtype, NUMERIC):
            cells = F.filter(cells, lambda c: nonzero(c["value"], to))
    elif map_col:
        dtype = df.schema[map_col].dataType.valueType
        to = level_type([dtype])
        cells = F.transform(F.map_entries(col_of(map_col)), lambda e: F.struct(
            e["key"].alias("feature"), cell(e["value"], dtype, to).alias("value")))
        if zero_of(to) is not None:
            cells = F.filter(cells, lambda c: nonzero(c["value"], to))
    else:
        types = {f.name: f.dataType for f in df.schema.fields}
        features = list(features) if features is not None else [c for c in df.columns if c != row_id]
        to = level_type([types[f] for f in features]) if features else T.DoubleType()
        each = []
        for f in features:
            value = cell(col_of(f), types[f], to)
            if isinstance(types[f], NUMERIC):
                value = F.when(nonzero(value, to), value)
            each.append(F.struct(F.lit(f).alias("feature"), value.alias("value")))
        cells = F.filter(F.array(*each), lambda c: c["value"].isNotNull()) if each else F.array().cast(
            "array<struct<feature:string,value:double>>")
    return df.select(rid, F.inline(cells))


def layout_for(df: DataFrame, label: str, features: str | list[str] | None = None, **kw):
    """Pick the instance-wise layout from the schema: an ARRAY column -> ``ArrayInstances``,
    a MAP column -> ``MapInstances``, an ML vector column -> ``VectorInstances``, a list of
    columns (or None: every other column) -> ``WideInstances``."""
    if isinstance(features, str):
        dt = df.schema[features].dataType
        if isinstance(dt, T.ArrayType):
            return ArrayInstances(df, label, features, **kw)
        if isinstance(dt, T.MapType):
            return MapInstances(df, label, features, **kw)
        if dt.typeName() == "vector" or dt.simpleString() == "vector":
            return VectorInstances(df, label, features, **kw)
        features = [features]
    return WideInstances(df, label, features, **kw)
