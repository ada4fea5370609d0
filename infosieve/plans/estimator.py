"""M7: select-then-reduce as a ``pyspark.ml`` Estimator / Model pair.

``InfoSelector(k, score).fit(df)`` runs the selection on ``featuresCol`` (ARRAY, MAP or an ML
vector) against ``labelCol``; the model keeps the chosen ids in selection order and its
``transform`` projects every row to those features (P2), as a vector for vector input.

Both have ``Params``, so they take part in a ``Pipeline``, in ``ParamMap`` copies and grid searches,
check schemas (``transformSchema``) and are saved and loaded like Spark's own stages.  A score is
saved by its registered name; a score object must be registered (``register_score``) to be saved.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cells import col_of, layout_for
from ..operators.scores import Score, get_score
from ..operators.selection import select_features


def _kind(schema: T.StructType, col: str) -> str:
    """``array``, ``map`` or ``vector``."""
    if col not in schema.fieldNames():
        raise ValueError(f"unknown column {col!r}")
    dt = schema[col].dataType
    if isinstance(dt, T.ArrayType):
        return "array"
    if isinstance(dt, T.MapType):
        return "map"
    if isinstance(dt, VectorUDT):
        return "vector"
    raise ValueError(f"{col!r} is {dt.simpleString()}, not an array, map or vector")


class _SelectorParams(HasFeaturesCol, HasOutputCol):
    def transformSchema(self, schema: T.StructType) -> T.StructType:
        """The schema that ``transform`` gives; raises where the input does not fit."""
        kind, out = _kind(schema, self.getFeaturesCol()), self.getOutputCol()
        if out in schema.fieldNames():
            raise ValueError(f"the output column {out!r} exists already")
        return T.StructType([*schema.fields, T.StructField(out, VectorUDT() if kind == "vector" else T.ArrayType(T.DoubleType()))])


class InfoSelectorModel(Model, _SelectorParams, MLReadable, MLWritable):
    """The chosen feature ids, in selection order, and their scores."""

    def __init__(self, selected: list | None = None, scores: list | None = None, feature_type: T.DataType | None = None):
        super().__init__()
        self._setDefault(featuresCol="features", outputCol="selected")
        self.selected, self.scores = list(selected or []), list(scores or [])
        self.feature_type = feature_type or T.LongType()

    def setOutputCol(self, value: str) -> InfoSelectorModel:
        return self._set(outputCol=value)

    def setFeaturesCol(self, value: str) -> InfoSelectorModel:
        return self._set(featuresCol=value)

    def _transform(self, df: DataFrame) -> DataFrame:
        self.transformSchema(df.schema)
        features, out = self.getFeaturesCol(), self.getOutputCol()
        kind, c = _kind(df.schema, features), col_of(features)
        if kind == "vector" and self.selected:
            # keeps sparse vectors sparse
            return VectorSlicer(inputCol=features, outputCol=out, indices=[int(s) for s in self.selected]).transform(df)
        if kind == "vector":
            raise ValueError("no features were selected")
        if kind == "map":
            picked = F.array(*[F.coalesce(c[F.lit(s)].cast("double"), F.lit(0.0)) for s in self.selected])
        else:
            picked = F.array(*[c[int(s)].cast("double") for s in self.selected])
        return df.withColumn(out, picked.cast("array<double>"))

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)


class _ModelWriter(MLWriter):
    def __init__(self, instance: InfoSelectorModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        m = self.instance
        schema = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("feature", m.feature_type),
                               T.StructField("score", T.DoubleType())])
        rows = [(i + 1, f, s) for i, (f, s) in enumerate(zip(m.selected, m.scores, strict=True))]
        self.sparkSession.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/data")


class _ModelReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> InfoSelectorModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        data = self.sparkSession.read.parquet(f"{path}/data")
        rows = data.orderBy("rank").collect()
        model = self.cls([r["feature"] for r in rows], [r["score"] for r in rows], data.schema["feature"].dataType)
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class InfoSelector(Estimator, _SelectorParams, HasLabelCol, MLReadable, MLWritable):
    k = Param(Params._dummy(), "k", "how many features to select", typeConverter=TypeConverters.toInt)
    score = Param(Params._dummy(), "score", "a registered score name or a Score")
    options = Param(Params._dummy(), "options", "further keywords of the Selector, a dict of plain values")

    def __init__(self, k: int | None = None, score=None, label_col: str | None = None, features_col: str | None = None,
                 output_col: str | None = None, **options):
        super().__init__()
        self._setDefault(k=10, score="mrmr", labelCol="label", featuresCol="features", outputCol="selected", options={})
        given = {"k": k, "score": score, "labelCol": label_col, "featuresCol": features_col, "outputCol": output_col,
                 "options": options or None}
        self._set(**{name: v for name, v in given.items() if v is not None})

    def setParams(self, **kw) -> InfoSelector:
        return self._set(**kw)

    def transformSchema(self, schema: T.StructType) -> T.StructType:
        if self.getLabelCol() not in schema.fieldNames():
            raise ValueError(f"unknown column {self.getLabelCol()!r}")
        get_score(self.getOrDefault(self.score))
        return super().transformSchema(schema)

    def _fit(self, df: DataFrame) -> InfoSelectorModel:
        self.transformSchema(df.schema)
        lay = layout_for(df, self.getLabelCol(), self.getFeaturesCol())
        found = select_features(lay, self.getOrDefault(self.k), self.getOrDefault(self.score), **self.getOrDefault(self.options))
        res = found.orderBy("rank").collect()
        model = InfoSelectorModel([r["feature"] for r in res], [r["score"] for r in res], found.schema["feature"].dataType)
        return model._set(featuresCol=self.getFeaturesCol(), outputCol=self.getOutputCol())

    def write(self) -> MLWriter:
        return _EstimatorWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return DefaultParamsReader(cls)


class _EstimatorWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        score = self.instance.getOrDefault(self.instance.score)
        if isinstance(score, Score):
            try:
                known = type(get_score(score.name)) is type(score) and not score.__dict__
            except ValueError:
                known = False
            if not known:
                raise ValueError(f"the score {score.name!r} is an object; register it and give its name to save the stage")
            named = self.instance.copy()
            named._set(score=score.name)
            DefaultParamsWriter.saveMetadata(named, path, self.sparkSession)
            return
        super().saveImpl(path)
