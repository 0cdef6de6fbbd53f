"""Stacked two-stage (hurdle) models on Spark ML."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.ranges import numbered
from tessella.session import materialise

SEED = 42


@dataclass(frozen=True)
class Theme:
    """A sub-model: its features, and the share of variance that its components keep (None: no components)."""

    name: str
    features: tuple[str, ...]
    variance: float | None = 0.95


def load_themes(settings: dict, kept: set[str] | None = None) -> list[Theme]:
    """The enabled themes of settings["submodels"], each {"features": [...], "enabled": true, "variance": none}, in their order.

    A theme keeps the features in `kept`, if given, once each; one that keeps none is left out. A theme without features is an error.
    """
    out = []
    for name, theme in (settings.get("submodels") or {}).items():
        if not theme.get("enabled", True):
            continue
        if not theme.get("features"):
            raise ValueError(f"theme {name} has no features")
        features = tuple(c for c in dict.fromkeys(theme["features"]) if kept is None or c in kept)
        if features:
            out.append(Theme(name, features, theme.get("variance")))
    return out


def with_inputs(df: DataFrame, themes: list[Theme]) -> DataFrame:
    """df with every input of the themes as a double: a column that it lacks is 0; nulls stay for the themes' own medians."""
    inputs = dict.fromkeys(c for t in themes for c in t.features)
    return df.withColumns({c: F.col(c).cast("double") if c in df.columns else F.lit(0.0) for c in inputs})


def prepare(df: DataFrame, theme: Theme) -> PipelineModel:
    """Median imputation, standardisation and, if asked, the components that hold the share of the variance."""
    filled = [f"{c}_filled" for c in theme.features]
    stages = [Imputer(strategy="median", inputCols=list(theme.features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol=f"{theme.name}_raw", handleInvalid="keep"), StandardScaler(withMean=True, inputCol=f"{theme.name}_raw", outputCol=f"{theme.name}_x")]
    model = Pipeline(stages=stages).fit(df)
    if theme.variance is None or len(theme.features) < 2:
        return model
    scaled = model.transform(df)
    full = PCA(k=len(theme.features), inputCol=f"{theme.name}_x", outputCol=f"{theme.name}_c").fit(scaled)
    total, k = 0.0, 0
    for share in full.explainedVariance.toArray():
        total, k = total + share, k + 1
        if total >= theme.variance:
            break
    return PipelineModel([*model.stages, PCA(k=k, inputCol=f"{theme.name}_x", outputCol=f"{theme.name}_c").fit(scaled)])


def date_folds(df: DataFrame, date: str, folds: int) -> DataFrame:
    """df with _fold: blocks of consecutive dates, so a later fold never trains an earlier one's predictions."""
    dates = df.select(date).distinct().withColumn("_fold", F.ntile(folds).over(Window.orderBy(date)) - 1)
    return df.join(F.broadcast(dates), date)


@dataclass
class Hurdle:
    """Per theme a classifier of any event and a regressor of how many; a meta model of each; a calibrator."""

    themes: list[Theme]
    prepared: dict[str, PipelineModel]
    classifiers: dict[str, object]
    regressors: dict[str, object]
    meta_class: object = None
    meta_count: object = None
    calibrator: object = None

    def base(self, df: DataFrame) -> DataFrame:
        for t in self.themes:
            own = [c for c in df.columns if c not in ("rawPrediction", "probability", "prediction")]
            df = self.prepared[t.name].transform(df.select(*own))
            df = self.classifiers[t.name].transform(df).withColumn(f"p_{t.name}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
            df = self.regressors[t.name].transform(df).withColumn(f"m_{t.name}", F.least(F.lit(500.0), F.greatest(F.lit(0.0), F.col("prediction")))).select(*dict.fromkeys([*own, f"p_{t.name}", f"m_{t.name}"]))
        return df

    def predict(self, df: DataFrame) -> DataFrame:
        """df with prob, mean_if_any and expected = prob * mean_if_any; inputs that df lacks count as 0."""
        x = self.base(with_inputs(df, self.themes))
        assembled = _assemble(x, self.themes)
        x = self.meta_class.transform(assembled).withColumn("prob", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        if self.calibrator is not None:
            x = self.calibrator.apply(x, "prob")
        x = self.meta_count.transform(x).withColumn("mean_if_any", F.least(F.lit(500.0), F.greatest(F.lit(0.0), F.col("prediction"))))
        return x.withColumn("expected", expected(F.col("prob"), F.col("mean_if_any"))).select(*df.columns, "prob", "mean_if_any", "expected")


def expected(prob: Column, mean_if_any: Column) -> Column:
    return prob * mean_if_any


def calibrated(c: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))


def _assemble(df: DataFrame, themes: list[Theme]) -> DataFrame:
    return VectorAssembler(inputCols=[f"p_{t.name}" for t in themes] + [f"m_{t.name}" for t in themes], outputCol="meta_x", handleInvalid="keep").transform(df.drop("meta_x"))


def _base_models(df: DataFrame, themes: list[Theme], target: str, linear: bool) -> Hurdle:
    h = Hurdle(themes, {}, {}, {})
    df = df.withColumn("_any", (F.col(target) > 0).cast("double"))
    for t in themes:
        h.prepared[t.name] = prepare(df, t)
        x = h.prepared[t.name].transform(df)
        features = f"{t.name}_c" if f"{t.name}_c" in x.columns else f"{t.name}_x"
        classifier = LogisticRegression(regParam=0.1, featuresCol=features, labelCol="_any") if linear else GBTClassifier(maxIter=20, maxDepth=4, seed=SEED, featuresCol=features, labelCol="_any")
        regressor = GeneralizedLinearRegression(family="poisson", link="log", regParam=0.1, maxIter=20, featuresCol=features, labelCol=target) if linear else GBTRegressor(maxIter=20, maxDepth=4, seed=SEED, featuresCol=features, labelCol=target)
        h.classifiers[t.name] = classifier.fit(x)
        h.regressors[t.name] = regressor.fit(x.where(F.col(target) > 0))
    return h


def calibration_split(df: DataFrame, positive: str, order: list[str], method: str = "temporal_tail", fraction: float = 0.2, fallback: float = 0.3, least: int = 10, seed: int = SEED) -> DataFrame:
    """df with _calibrate: whether a row is held out for calibration.

    temporal_tail takes the last rows in order, random those of the least hash of the order columns, so many that int(n (1 -
    fraction)) are left; where these hold fewer than `least` positives, fallback takes the fraction's place.
    """
    if method not in ("temporal_tail", "random"):
        raise ValueError(f"unknown split {method}")
    columns = [F.col(c) for c in order] if method == "temporal_tail" else [F.xxhash64(*order, F.lit(seed)), *map(F.col, order)]
    rows = numbered(df, "_number", columns)
    n = rows.count()
    held = lambda share: F.col("_number") > int(n * (1 - share))
    enough = rows.where(held(fraction)).agg(F.coalesce(F.sum(positive), F.lit(0))).first()[0] >= least
    return rows.withColumn("_calibrate", held(fraction if enough else fallback)).drop("_number")


class Calibrator:
    """Of a probability: Platt's sigmoid or a step function that never falls, fitted on held-out rows; none with one class only."""

    def __init__(self, scored: DataFrame, score: str, truth: str, method: str):
        self.model, self.method = None, method
        rows = scored.select(F.col(score).cast("double").alias("_score"), F.col(truth).cast("double").alias("_truth"))
        if method not in ("sigmoid", "isotonic"):
            raise ValueError(f"unknown calibration {method}")
        if rows.select("_truth").distinct().count() < 2:
            return
        if method == "isotonic":
            self.model = IsotonicRegression(featuresCol="_score", labelCol="_truth").fit(rows)
        else:
            x = VectorAssembler(inputCols=["_score"], outputCol="_x").transform(rows)
            self.model = LogisticRegression(regParam=0.0, featuresCol="_x", labelCol="_truth").fit(x)

    def apply(self, df: DataFrame, score: str) -> DataFrame:
        if self.model is None:
            return df
        if self.method == "sigmoid":
            z = F.lit(float(self.model.coefficients[0])) * F.col(score) + F.lit(float(self.model.intercept))
            return df.withColumn(score, 1 / (1 + F.exp(-z)))
        return self.model.transform(df.withColumn("_score", F.col(score))).withColumn(score, calibrated("prediction")).drop("prediction", "_score")


def fit(df: DataFrame, themes: list[Theme], target: str, date: str, folds: int = 4, linear: bool = True, calibration: str = "none", split: str = "temporal_tail", fraction: float = 0.2, meta: str = "logistic", meta_params: dict | None = None) -> Hurdle:
    """Out-of-fold predictions over expanding blocks of dates train the meta models; base models are refitted on all rows.

    linear takes logistic and Poisson models, else boosted trees, for the meta model of counts too. meta is the classifier
    over the themes' probabilities, logistic or boosted, and meta_params go over its defaults. calibration: none,
    sigmoid or isotonic, fitted on out-of-fold rows that calibration_split keeps from the meta models.
    """
    if meta not in ("logistic", "boosted"):
        raise ValueError(f"unknown meta model {meta}")
    columns = sorted({c for t in themes for c in t.features} | {target, date})
    data = materialise(date_folds(df.select(*columns), date, folds))
    out = []
    for f in range(1, folds):
        base = _base_models(data.where(F.col("_fold") < f), themes, target, linear)
        out.append(base.base(data.where(F.col("_fold") == f)).select(target, date, *[f"p_{t.name}" for t in themes], *[f"m_{t.name}" for t in themes]))
    oof = out[0]
    for o in out[1:]:
        oof = oof.unionByName(o)
    oof = _assemble(materialise(oof), themes).withColumn("_any", (F.col(target) > 0).cast("double"))
    held = None
    if calibration != "none":
        parts = materialise(calibration_split(oof.withColumn("_row", F.monotonically_increasing_id()), "_any", [date, "_row"], split, fraction).drop("_row"))
        held, oof = parts.where("_calibrate"), parts.where("not _calibrate")
    h = _base_models(data, themes, target, linear)
    defaults = {"regParam": 0.1} if meta == "logistic" else {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1, "seed": SEED}
    kind = LogisticRegression if meta == "logistic" else GBTClassifier
    h.meta_class = kind(featuresCol="meta_x", labelCol="_any", **(defaults | (meta_params or {}))).fit(oof)
    count = GeneralizedLinearRegression(family="poisson", link="log", regParam=0.1, maxIter=20, featuresCol="meta_x", labelCol=target) if linear else GBTRegressor(maxIter=20, maxDepth=4, seed=SEED, featuresCol="meta_x", labelCol=target)
    h.meta_count = count.fit(oof.where(F.col(target) > 0))
    if held is not None:
        scored = h.meta_class.transform(held).withColumn("_score", vector_to_array("probability")[1])
        h.calibrator = Calibrator(scored, "_score", "_any", calibration)
    return h


def permutation_importance(df: DataFrame, predict, metric, features: list[str], key: str) -> dict[str, float]:
    """Loss of the metric when a feature's values are dealt anew: rows by key are given the values of rows by hash."""
    whole = metric(predict(df))
    out = {}
    for c in features:
        by = lambda *order: numbered(df.select(key, c), "_i", list(order)).select(key, c, "_i")
        dealt = by(F.col(key)).select(key, "_i").join(by(F.xxhash64(key, F.lit(c)), F.col(key)).select(c, "_i"), "_i").select(key, F.col(c))
        out[c] = whole - metric(predict(df.drop(c).join(dealt, key)))
    return out
