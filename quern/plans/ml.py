"""The graph as a stage of pyspark.ml: an estimator with Params, and a model that can be saved and loaded."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.graph import to_lists
from quern.plans import descent

_INT, _FLOAT, _STR = TypeConverters.toInt, TypeConverters.toFloat, TypeConverters.toString
DEFAULTS = {
    "k": 10, "distance": "euclidean", "algorithm": "optimized", "rho": 0.5, "delta": 0.001, "maxIter": 20, "sampleRate": 1.0, "seed": 42,
    "idCol": "id", "vectorCol": "vec", "outputCol": "neighbors",
}


class _Shared(Params):
    k = Param(Params._dummy(), "k", "neighbours of a point", _INT)
    distance = Param(Params._dummy(), "distance", "name of the metric", _STR)
    algorithm = Param(Params._dummy(), "algorithm", "naive, or the name of a preset: optimized, adaptive, ...", _STR)
    rho = Param(Params._dummy(), "rho", "share of k that a round samples", _FLOAT)
    delta = Param(Params._dummy(), "delta", "share of edges whose change ends the descent", _FLOAT)
    maxIter = Param(Params._dummy(), "maxIter", "rounds at most", _INT)
    sampleRate = Param(Params._dummy(), "sampleRate", "share of candidates that are evaluated", _FLOAT)
    seed = Param(Params._dummy(), "seed", "seed of all draws", _INT)
    idCol = Param(Params._dummy(), "idCol", "column of ids", _STR)
    vectorCol = Param(Params._dummy(), "vectorCol", "column of vectors", _STR)
    outputCol = Param(Params._dummy(), "outputCol", "column of neighbours' ids that transform adds", _STR)

    def get(self, name: str):
        return self.getOrDefault(self.getParam(name))


class KNNGraphEstimator(Estimator, _Shared, DefaultParamsWritable, DefaultParamsReadable):
    """fit(table) gives a KNNGraphModel. Settings are Params, given by name."""

    def __init__(self, **settings):
        super().__init__()
        self._setDefault(**DEFAULTS)
        self._set(**settings)

    def _fit(self, dataset: DataFrame) -> KNNGraphModel:
        points = dataset.select(F.col(self.get("idCol")).cast("bigint").alias("id"), F.col(self.get("vectorCol")).cast("array<double>").alias("vec"))
        name = self.get("algorithm")
        if name == "naive":
            result = descent.nn_descent_naive(points, self.get("k"), self.get("distance"), self.get("maxIter"), self.get("seed"))
        else:
            given = {"rho": self.get("rho"), "delta": self.get("delta"), "max_iterations": self.get("maxIter"), "sample_rate": self.get("sampleRate"), "seed": self.get("seed")}
            result = descent.descend(points, descent.Settings(k=self.get("k"), **(descent.PRESETS[name] | given)), self.get("distance"))
        return self._copyValues(KNNGraphModel(result.graph))


class KNNGraphModel(Model, _Shared, MLWritable, MLReadable):
    """edges: the graph as p, q, dist, is_new. transform() joins each row's neighbours to it by id."""

    def __init__(self, edges: DataFrame | None = None):
        super().__init__()
        self._setDefault(**DEFAULTS)
        self.edges = edges

    def copy(self, extra=None) -> KNNGraphModel:
        out = super().copy(extra)
        out.edges = self.edges
        return out

    def neighbors(self) -> DataFrame:
        """p, neighbors: ids by ascending distance."""
        return to_lists(self.edges)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        own = self.neighbors().select(F.col("p").alias("_p"), F.col("neighbors").alias(self.get("outputCol")))
        return dataset.join(own, F.col(self.get("idCol")) == F.col("_p"), "left").drop("_p")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: KNNGraphModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.edges.write.parquet(f"{path}/edges")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> KNNGraphModel:
        spark = SparkSession.active()
        found = DefaultParamsReader.loadMetadata(path, spark)
        model = self.cls(spark.read.parquet(f"{path}/edges"))
        model._resetUid(found["uid"])
        DefaultParamsReader.getAndSetParams(model, found)
        return model
