"""Learners as pyspark.ml estimators: fitted models transform tables, and are saved and loaded as such.

Points are rows with an array of attributes and a label. What a fit brings to the driver is bounded by classes times attributes.

Defined results: a row whose attributes are null, of another number than the model's, or hold a null has a null score (which counts as 0 when
classes are compared) and teaches nothing; a class without such rows scores null everywhere; extra columns stay.
"""

from __future__ import annotations

import json
import uuid

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import dense_index, saved
from .ml import error_rate, one_vs_rest, regress_one_vs_rest


def whole(features: str, n: int) -> Column:
    """Whether an array has n elements and none of them is null."""
    return (F.size(features) == n) & ~F.exists(features, lambda x: x.isNull())


def nearness(features: str, centre: Column, n: int) -> Column:
    """1 / (1 + squared distance to the centre), null where either isn't whole."""
    d = F.aggregate(F.zip_with(F.col(features), centre, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    return F.when(whole(features, n) & (F.size(centre) == n), 1.0 / (1.0 + d))


class _Scoring(HasFeaturesCol, HasLabelCol):
    scoreCol = Param(Params._dummy(), "scoreCol", "column of the score that label 1 fits", TypeConverters.toString)

    def getScoreCol(self) -> str:
        return self.getOrDefault(self.scoreCol)


class MeanScore(Estimator, _Scoring, DefaultParamsWritable, DefaultParamsReadable):
    """Learns where the rows of label 1 lie; a row's score is 1 / (1 + its squared distance to their mean)."""

    @keyword_only
    def __init__(self, *, featuresCol: str = "features", labelCol: str = "label", scoreCol: str = "score"):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", scoreCol="score")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> MeanScoreModel:
        f = self.getFeaturesCol()
        ones = dataset.where(F.col(self.getLabelCol()) == 1)
        n = ones.agg(F.max(F.size(f))).first()[0] or 0
        row = ones.where(whole(f, n)).agg(*[F.avg(F.get(f, i).cast("double")).alias(f"m{i}") for i in range(n)]).first() if n > 0 else []
        centre = [] if None in tuple(row) else [float(x) for x in row]
        return self._copyValues(MeanScoreModel(centre=centre))


class MeanScoreModel(Model, _Scoring, DefaultParamsWritable, DefaultParamsReadable):
    centre = Param(Params._dummy(), "centre", "mean of the attributes of the rows of label 1", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, centre: list[float] = ()):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", scoreCol="score", centre=[])
        self._set(centre=list(centre))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        c = self.getOrDefault(self.centre)
        score = nearness(self.getFeaturesCol(), F.array(*[F.lit(x) for x in c]), len(c)) if c else F.lit(None).cast("double")
        return dataset.withColumn(self.getScoreCol(), score)


class _Classes(HasLabelCol, HasPredictionCol):
    valueCol = Param(Params._dummy(), "valueCol", "column of the classes weighed by their scores", TypeConverters.toString)

    def getValueCol(self) -> str:
        return self.getOrDefault(self.valueCol)


class OneVsRest(Estimator, _Classes, MLWritable, MLReadable):
    """A model a class, from an estimator that tells label 1 from 0 and whose model adds a score column. Labels are numbers."""

    def __init__(self, learner: Estimator | None = None, labelCol: str = "label", predictionCol: str = "prediction", valueCol: str = "value"):
        super().__init__()
        self.learner = learner
        self._setDefault(labelCol="label", predictionCol="prediction", valueCol="value")
        self._set(labelCol=labelCol, predictionCol=predictionCol, valueCol=valueCol)

    def _fit(self, dataset: DataFrame) -> OneVsRestModel:
        name, own = self.getLabelCol(), f"label-{uuid.uuid4().hex}"
        classes = sorted(r[0] for r in dataset.where(F.col(name).isNotNull()).select(name).distinct().collect())  # as many as there are models
        learner = self.learner.copy({self.learner.labelCol: own})
        models = [learner.fit(dataset.withColumn(own, (F.col(name) == F.lit(c)).cast("int"))) for c in classes]
        return self._copyValues(OneVsRestModel(classes, models))

    def copy(self, extra=None) -> OneVsRest:
        new = super().copy(extra)
        new.learner = self.learner.copy(extra)
        return new

    def write(self) -> MLWriter:
        return _Writer(self, {"learner": self.learner}, {})

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(lambda parts, extra: OneVsRest(parts["learner"]))


class OneVsRestModel(Model, _Classes, MLWritable, MLReadable):
    """Predicts the class of the largest score above 0, the first of equals, or else 0; and the classes weighed by their scores, over their sum."""

    def __init__(self, classes: list, models: list[Model]):
        super().__init__()
        self.classes, self.models = classes, models
        self._setDefault(labelCol="label", predictionCol="prediction", valueCol="value")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = {c: f"score-{uuid.uuid4().hex}" for c in self.classes}
        rows = dataset
        for c, m in zip(self.classes, self.models, strict=True):
            rows = m.copy({m.scoreCol: names[c]}).transform(rows)
        score = lambda c: F.col(names[c])
        kept = [c for c in dataset.columns if c not in (self.getPredictionCol(), self.getValueCol())]
        none = F.lit(None)
        if not self.classes:
            return rows.select(*kept, none.cast("int").alias(self.getPredictionCol()), none.cast("double").alias(self.getValueCol()))
        own = {x: f"{x}-{uuid.uuid4().hex}" for x in ("predicted", "value")}
        inner = rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), *names.values())
        both = regress_one_vs_rest(one_vs_rest(inner, self.classes, score).withColumnRenamed("predicted", own["predicted"]), self.classes, score).withColumnRenamed("value", own["value"])
        return both.select("row.*", F.col(own["predicted"]).alias(self.getPredictionCol()), F.col(own["value"]).alias(self.getValueCol()))

    def copy(self, extra=None) -> OneVsRestModel:
        new = super().copy(extra)
        new.models = [m.copy(extra) for m in self.models]
        return new

    def write(self) -> MLWriter:
        return _Writer(self, {f"model-{i}": m for i, m in enumerate(self.models)}, {"classes": json.dumps(self.classes)})

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(lambda parts, extra: OneVsRestModel(json.loads(extra["classes"]), [parts[f"model-{i}"] for i in range(len(parts))]))


class _Writer(MLWriter):
    """Params as metadata, each part in a folder of its own."""

    def __init__(self, instance: Params, parts: dict, extra: dict):
        super().__init__()
        self.instance, self.parts, self.extra = instance, parts, extra

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, extraMetadata=self.extra | {"parts": list(self.parts)})
        for name, part in self.parts.items():
            part.write().session(self.sparkSession).save(f"{path.rstrip('/')}/{name}")


class _Reader(MLReader):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        parts = {name: DefaultParamsReader.loadParamsInstance(f"{path.rstrip('/')}/{name}", self.sparkSession) for name in metadata["parts"]}
        out = self.make(parts, metadata)
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        return out


def repeated_accuracy(rows: DataFrame, estimator: Estimator, folds: int = 3, runs: int = 5, key: str = "id") -> float:
    """1 - mean error over runs: in each the rows are shuffled anew by key, one share in `folds` is tried, the others teach.

    A continuous prediction is tried by its squared error, as is a double label."""
    label, guess = estimator.getLabelCol(), estimator.getPredictionCol()
    errors = []
    for k in range(runs):
        dealt = saved(rows.withColumn("__fold", F.pmod(F.xxhash64(F.lit(k), F.col(key)), F.lit(folds))), "learn")
        tried = estimator.fit(dealt.where("__fold <> 0").drop("__fold")).transform(dealt.where("__fold = 0").drop("__fold"))
        kind = rows.schema[label].dataType.simpleString()
        errors.append(error_rate(tried, label, guess, kind in ("double", "float")).first()["error"] or 0.0)
    return 1.0 - sum(errors) / len(errors)


def leave_n_out(rows: DataFrame, n: int, size: int, features: str = "features", label: str = "label", order: str = "id") -> DataFrame:
    """(block, error): rows in the order of `order`, cut into whole blocks of n; each block is tried by class means that haven't seen it.

    Means are unlearned, not learned again: a class's sums less the block's own. That is one pass for the sums, one for the trial, however many
    blocks there are. Rows beyond the last whole block teach but aren't tried. `size` is the number of attributes; rows that aren't whole, or have no
    label, take no part. A class that lies wholly in the block scores nothing in it; equal scores go to the smaller class.
    """
    points = rows.where(whole(features, size) & F.col(label).isNotNull()).select(F.col(order).alias("o"), F.col(label).alias("c"), F.transform(features, lambda x: x.cast("double")).alias("f"))
    placed = saved(dense_index(points, "o", "place").select("place", "c", "f", F.expr(f"place div {n}").alias("block")), "blocks")
    total = placed.count()
    sums = saved(placed.groupBy("block", "c").agg(F.count("*").alias("k"), F.array(*[F.sum(F.get("f", i)) for i in range(size)]).alias("s")), "sums")
    every = sums.groupBy("c").agg(F.sum("k").alias("k"), *[F.sum(F.get("s", i)).alias(f"s{i}") for i in range(size)]).orderBy("c").collect()  # a row a class
    if not every:
        return sums.select("block", F.lit(0.0).alias("error"))
    kind = sums.schema["c"].dataType
    classes = F.array(*[F.struct(F.lit(r["c"]).cast(kind).alias("c"), F.lit(r["k"]).alias("k"), F.array(*[F.lit(r[f"s{i}"]) for i in range(size)]).alias("s")) for r in every])
    own = sums.where(F.col("block") < total // n).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("c", F.struct("k", "s")))).alias("own"))  # a class each

    def unlearned(r: Column) -> Column:
        mine = F.try_element_at("own", r["c"])
        left = r["k"] - F.coalesce(mine["k"], F.lit(0))
        rest = F.zip_with(r["s"], F.coalesce(mine["s"], F.array_repeat(F.lit(0.0), size)), lambda a, b: a - b)
        return F.struct(r["c"].alias("c"), left.alias("left"), F.transform(rest, lambda x: F.try_divide(x, left)).alias("m"))

    by_block = own.select("block", F.filter(F.transform(classes, unlearned), lambda m: m["left"] > 0).alias("means"))
    d = lambda m: F.aggregate(F.zip_with("f", m["m"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.transform("means", lambda m: F.struct(F.round(d(m), 12).alias("d"), m["c"].alias("c"))))["c"]
    tried = placed.join(by_block, "block").select("block", (best != F.col("c")).cast("double").alias("wrong"))
    return tried.groupBy("block").agg(F.avg("wrong").alias("error"))
