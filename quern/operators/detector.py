"""Logistic-regression detector on sentence features."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.probe import dot

LEAST_SCALE = 1e-8


@dataclass(frozen=True)
class Detector:
    """Coefficients of ``sigmoid((x - mean) / scale . coef + intercept)``."""

    coef: tuple[float, ...]
    intercept: float = 0.0
    mean: tuple[float, ...] | None = None
    scale: tuple[float, ...] | None = None

    def __post_init__(self):
        for name, values in (("mean", self.mean), ("scale", self.scale)):
            if values is not None and len(values) != len(self.coef):
                raise ValueError(f"{name} has {len(values)} entries, coef has {len(self.coef)}")
        if not self.coef:
            raise ValueError("a detector needs coefficients")

    @classmethod
    def from_dict(cls, spec: dict) -> Detector:
        if "coef" not in spec:
            raise ValueError("the detector has no 'coef'")
        flat = lambda v: None if v is None else tuple(float(x) for x in np.ravel(v))
        return cls(flat(spec["coef"]), float(np.ravel(spec.get("intercept", 0.0))[0]), flat(spec.get("mean")), flat(spec.get("scale")))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Detector:
        """From one JSON object or one Parquet row. Pickles run code when they are read and are refused."""
        if path.rstrip("/").endswith((".pkl", ".pickle", ".joblib")):
            raise ValueError("pickled detectors are refused; store coef, intercept, mean and scale as JSON or Parquet")
        if path.rstrip("/").endswith(".json"):
            return cls.from_dict(json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())))
        return cls.from_dict(spark.read.parquet(path).first().asDict(recursive=True))

    @classmethod
    def from_estimator(cls, model) -> Detector:
        """From a fitted linear model, or a pipeline of a scaler (``mean_``, ``scale_``) and such a model
        (``coef_``)."""
        steps = [s for _, s in model.steps] if hasattr(model, "steps") else [model]
        linear = next((s for s in reversed(steps) if hasattr(s, "coef_")), None)
        if linear is None:
            raise ValueError("no step has coef_")
        scaler = next((s for s in steps if hasattr(s, "mean_") and hasattr(s, "scale_")), None)
        return cls.from_dict({"coef": linear.coef_, "intercept": linear.intercept_} | ({"mean": scaler.mean_, "scale": scaler.scale_} if scaler is not None else {}))

    def repeats(self, n: int) -> int:
        """How often ``n`` features, one layer's, are repeated to meet the coefficients of all layers."""
        if n < 1 or len(self.coef) % n:
            raise ValueError(f"{n} features, but the detector has {len(self.coef)} coefficients")
        return len(self.coef) // n

    def score(self, x: Column) -> Column:
        """Probability for an array of features: as many as there are coefficients, or of one layer, which stand
        for each layer then. Another size is an error; a null array has a null score."""
        size = len(self.coef)
        n = F.size(x)
        wrong = F.raise_error(F.concat(n.cast("string"), F.lit(f" features, but the detector has {size} coefficients"))).cast("array<double>")
        x = F.when(x.isNull(), F.lit(None)).when(n == size, x.cast("array<double>")).when((n > 0) & (F.lit(size) % F.greatest(n, F.lit(1)) == 0), F.flatten(F.array_repeat(x.cast("array<double>"), F.floor(F.lit(size) / n).cast("int")))).otherwise(wrong)
        if self.mean is not None:
            x = F.zip_with(x, _array(self.mean), lambda a, m: a - m)
        if self.scale is not None:
            x = F.zip_with(x, _array([max(s, LEAST_SCALE) for s in self.scale]), lambda a, s: a / s)
        return 1.0 / (1.0 + F.exp(-(dot(x, _array(self.coef)) + F.lit(float(self.intercept)))))

    def probability(self, x: np.ndarray) -> np.ndarray:
        """``score`` of rows of features, by numpy."""
        if not len(x):
            return np.zeros(0)
        x = np.tile(x, (1, self.repeats(x.shape[1])))
        if self.mean is not None:
            x = x - np.array(self.mean)
        if self.scale is not None:
            x = x / np.maximum(np.array(self.scale), LEAST_SCALE)
        return 1 / (1 + np.exp(-(x @ np.array(self.coef) + self.intercept)))


def _array(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def train(rows: DataFrame, features_col: str = "features", label_col: str = "label") -> Detector:
    """A detector fitted by Spark ML on ``array<double>`` features and 0/1 labels."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    data = rows.select(array_to_vector(features_col).alias("x"), F.col(label_col).cast("double").alias("y"))
    scaler = StandardScaler(withMean=True, withStd=True, inputCol="x", outputCol="z").fit(data)
    model = LogisticRegression(featuresCol="z", labelCol="y", regParam=1e-3).fit(scaler.transform(data))
    return Detector(tuple(model.coefficients.toArray()), float(model.intercept), tuple(scaler.mean.toArray()), tuple(scaler.std.toArray()))
