"""Pair models: two-fold boosted trees with out-of-fold scores, and a pluggable joint pair scorer. All can be saved and loaded, in any file system."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkin.functions.strings import similarities
from rowkin.operators.folds import MATCHER_FOLDS
from rowkin.sources.tables import read_text, write_text

MISSING = -9999.0
#: Boosting parameters; the depth stands for 127 leaves. MLlib grows by level and has no L2 term.
TREES = {"maxIter": 500, "maxDepth": 7, "stepSize": 0.08, "minInstancesPerNode": 200, "featureSubsetStrategy": "0.8", "subsamplingRate": 0.7, "seed": 0}


def vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with its feature columns as one vector; null and NaN become ``MISSING``."""
    plain = df.withColumns({f"_{c}": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(MISSING)) for c in columns})
    return VectorAssembler(inputCols=[f"_{c}" for c in columns], outputCol="features").transform(plain).drop(*(f"_{c}" for c in columns))


@dataclass
class FoldModels:
    """One model for each of two folds; a row of one fold is scored by the other fold's model, all others by the mean."""

    columns: list[str]
    models: dict[int, object]

    def score(self, df: DataFrame, name: str = "p", fold: str | None = "f") -> DataFrame:
        out, (a, b) = vectors(df, self.columns), sorted(self.models)
        for k in (a, b):
            out = self.models[k].setFeaturesCol("features").setProbabilityCol(f"probability_{k}").setRawPredictionCol(f"raw_{k}").setPredictionCol(f"prediction_{k}").transform(out)
        pa, pb = (vector_to_array(f"probability_{k}")[1] for k in (a, b))
        return out.withColumn(name, out_of_fold(F.col(fold) if fold else F.lit(-1), pa, pb, (a, b))).select(*df.columns, name)

    def importances(self, top: int = 15) -> list[tuple[str, float]]:
        """The most important columns of the first fold's model."""
        return sorted(zip(self.columns, map(float, self.models[min(self.models)].featureImportances.toArray()), strict=True), key=lambda t: (-t[1], t[0]))[:top]


    def save(self, path: str) -> None:
        for k, model in self.models.items():
            model.write().overwrite().save(f"{path}/fold_{k}")
        write_text(SparkSession.active(), f"{path}/columns.json", json.dumps({"columns": self.columns, "folds": sorted(self.models)}))

    @classmethod
    def load(cls, path: str) -> FoldModels:
        known = json.loads(read_text(SparkSession.active(), f"{path}/columns.json"))
        return cls(known["columns"], {k: GBTClassificationModel.load(f"{path}/fold_{k}") for k in known["folds"]})


def out_of_fold(fold: Column, pa: Column, pb: Column, folds: tuple[int, int] = MATCHER_FOLDS) -> Column:
    """A row of the first fold gets the second model's score and the other way round; all others the mean."""
    return F.when(fold == folds[0], pb).when(fold == folds[1], pa).otherwise((pa + pb) / 2)


def fit_folds(df: DataFrame, columns: Sequence[str], folds: tuple[int, int] = MATCHER_FOLDS, validate: float = 0.0, **parameters) -> FoldModels:
    """Boosted trees for each fold (column f, label y). ``validate``: the share of the other fold, drawn by a hash of the pair, that stops boosting early."""
    parameters, models = TREES | parameters, {}
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        parameters = {"checkpointInterval": 10} | parameters  # boosting's lineage is cut in the shared folder
    for k in folds:
        rows = df.filter(F.col("f") == k).withColumn("held", F.lit(False))
        trees = GBTClassifier(labelCol="y", featuresCol="features", **parameters)
        if validate:
            other = df.filter(F.col("f").isin(list(folds)) & (F.col("f") != k)).filter(F.pmod(F.xxhash64("s", "x"), F.lit(10_000)) < round(validate * 10_000))
            rows, trees = rows.unionByName(other.withColumn("held", F.lit(True))), trees.setValidationIndicatorCol("held")
        known = vectors(rows, columns).select("features", F.col("y").cast("double").alias("y"), "held").persist(StorageLevel.MEMORY_AND_DISK)
        models[k] = trees.fit(known)
        known.unpersist()
    return FoldModels(list(columns), models)


class PairScorer:
    """The default joint scorer of two texts: logistic regression on string scores. Any object with fit, score, save and load can take its place.

    ``start`` is an earlier scorer to go on from: its log-odds are one of the scores, so that what it knows is there from the first step.
    """

    scores = {"ratio": "ratio", "tset": "token_set_ratio", "tsort": "token_sort_ratio", "part": "partial_ratio", "jw": "jaro_winkler"}

    def __init__(self, iterations: int = 50, start: PairScorer | None = None):
        self.iterations, self.start, self.model = iterations, start, None

    def _scored(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with their string scores, in one Python pass however long the chain of scorers."""
        found = pairs.withColumn("z", similarities({n: (k, F.col("text_s"), F.col("text_x")) for n, k in self.scores.items()}))
        return found.select(*pairs.columns, *(F.col(f"z.{n}").alias(n) for n in self.scores))

    def _features(self, scored: DataFrame) -> DataFrame:
        names = list(self.scores)
        if self.start is not None:
            scored, names = self.start._odds(scored, "start"), [*names, "start"]
        return vectors(scored, names).drop("start")

    def _odds(self, scored: DataFrame, name: str) -> DataFrame:
        out = self.model.transform(self._features(scored))
        return out.select(*scored.columns, vector_to_array("rawPrediction")[1].alias(name))

    def fit(self, pairs: DataFrame, weight: str | None = None) -> PairScorer:
        """``pairs``: text_s, text_x, y, and a weight of each row if named."""
        trainer = LogisticRegression(labelCol="y", maxIter=self.iterations, regParam=1e-3)
        self.model = (trainer.setWeightCol(weight) if weight else trainer).fit(self._features(self._scored(pairs)))
        return self

    def score(self, pairs: DataFrame, name: str = "ce") -> DataFrame:
        """``pairs`` with the log-odds of a match."""
        return self._odds(self._scored(pairs), name).select(*pairs.columns, name)

    @property
    def key(self) -> str:
        """What its scores depend on."""
        return repr((self.model and (self.model.coefficients, self.model.intercept), self.start and self.start.key))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        write_text(SparkSession.active(), f"{path}/scorer.json", json.dumps({"iterations": self.iterations, "start": self.start is not None}))
        if self.start is not None:
            self.start.save(f"{path}/start")

    @classmethod
    def load(cls, path: str) -> PairScorer:
        known = json.loads(read_text(SparkSession.active(), f"{path}/scorer.json"))
        out = cls(known["iterations"], cls.load(f"{path}/start") if known["start"] else None)
        out.model = LogisticRegressionModel.load(f"{path}/model")
        return out


def likely(scores: DataFrame, least: float = 0.005, p: str = "p1") -> DataFrame:
    """The pairs worth the joint scorer."""
    return scores.filter(F.col(p) > least)


def embedded(records: DataFrame, embed: Callable[[Column], Column], key: str = "entity_id") -> DataFrame:
    """(key, country, e): records through an embedder of their text."""
    from rowkin.operators.normalize import pair_text

    return records.select(key, "country", embed(F.lower(pair_text(F.col("business_name"), F.col("business_address")))).alias("e"))
