"""Contributions of features to the predictions of tree models: path-dependent Shapley values."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tessella.plans.model.ensemble import Hurdle, with_inputs

#: A test at a split: the threshold (left if at most that), or the categories that go left; and whether the path goes left.
Test = tuple[float | tuple[float, ...], bool]


@dataclass
class Leaf:
    """A leaf's weighted value and, for each feature tested on the way, its tests and the share of the training rows that pass them."""

    value: float
    tests: dict[int, list[Test]]
    shares: dict[int, float]


def leaves(model) -> list[Leaf]:
    """All leaves of a fitted tree or ensemble of trees of Spark ML, times the tree's weight. Their number depends on the model alone."""
    if not hasattr(model, "trees"):
        trees, weights = [model], [1.0]
    else:
        trees, weights = model.trees, model.treeWeights
    if model.__class__.__name__.startswith("RandomForest"):
        weights = [w / sum(weights) for w in weights]
    return [leaf for tree, weight in zip(trees, weights, strict=True) for leaf in _tree_leaves(tree._java_obj.rootNode(), weight)]


def _tree_leaves(root, weight: float) -> Iterator[Leaf]:
    todo = [(root, {}, {})]
    while todo:
        node, tests, shares = todo.pop()
        if node.subtreeDepth() == 0:
            yield Leaf(node.prediction() * weight, tests, shares)
            continue
        split, rows = node.split(), node.impurityStats().count()
        feature = split.featureIndex()
        test = split.threshold() if split.getClass().getSimpleName() == "ContinuousSplit" else tuple(split.leftCategories())
        for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
            share = shares.get(feature, 1.0) * child.impurityStats().count() / rows
            todo.append((child, tests | {feature: [*tests.get(feature, []), (test, left)]}, shares | {feature: share}))


def base_value(paths: list[Leaf]) -> float:
    """The prediction when no feature is known: leaves by their shares of the training rows."""
    return sum(p.value * float(np.prod(list(p.shares.values()))) for p in paths)


def shapley(x: np.ndarray, paths: list[Leaf]) -> np.ndarray:
    """Rows by features: each feature's Shapley value for each row of x.

    On a path with m features, feature i moves a leaf's value by (passes - share) times the sum over subsets of the other
    m - 1 features, known ones counting as passed or not and unknown ones by their share. Subsets of a size weigh alike, so
    the sum is read from the coefficients of the product of (share + passes * t): polynomial in the depth, for all rows at once.
    """
    out = np.zeros(x.shape)
    for p in paths:
        features = list(p.tests)
        m = len(features)
        passes = [_passes(x[:, f], p.tests[f]) for f in features]
        weights = [factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)]
        for i, f in enumerate(features):
            sums = np.zeros((m, len(x)))
            sums[0] = 1.0
            for j, g in enumerate(features):
                if j != i:
                    taken = sums[:-1] * passes[j]
                    sums *= p.shares[g]
                    sums[1:] += taken
            out[:, f] += p.value * (passes[i] - p.shares[f]) * np.dot(weights, sums)
    return out


def _passes(values: np.ndarray, tests: list[Test]) -> np.ndarray:
    ok = np.ones(len(values), bool)
    for test, left in tests:
        ok &= (np.isin(values, test) if isinstance(test, tuple) else values <= test) == left
    return ok.astype(float)


def contributions(model, df: DataFrame, keys: list[str], features: str = "features") -> DataFrame:
    """keys, base and contributions (an array in the order of the vector's features) of each row of df.

    base + the contributions is what the model's trees add up to: a regressor's prediction, the second entry of a boosted
    classifier's raw prediction. Models whose leaves hold votes (tree and forest classifiers) are refused. A null vector gives null
    contributions; NaN goes right at a split, as in the model. No rows are shuffled; the leaves go to the tasks.
    """
    if "Classification" in model.__class__.__name__ and not model.__class__.__name__.startswith("GBT"):
        raise ValueError(f"the leaves of {model.__class__.__name__} vote for a class; take a regressor or boosted trees")
    paths, n = leaves(model), model.numFeatures
    base = base_value(paths)

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(b.num_columns - 1).to_pylist()
            there = [i for i, v in enumerate(vectors) if v is not None]
            found = [None] * len(vectors)
            if there:
                values = shapley(np.array([vectors[i] for i in there], float).reshape(len(there), n), paths)
                for i, v in zip(there, values.tolist(), strict=True):
                    found[i] = v
            columns = [*b.columns[:-1], pa.array([base] * len(vectors), pa.float64()), pa.array(found, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names[:-1], "base", "contributions"])

    rows = df.select(*keys, F.when(F.col(features).isNotNull(), vector_to_array(features)).alias("_x"))
    schema = StructType([*rows.schema.fields[:-1], StructField("base", DoubleType()), StructField("contributions", ArrayType(DoubleType()))])
    return rows.mapInArrow(explain, schema)


def long_contributions(explained: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys, feature, contribution: a row a feature; rows without contributions give none."""
    pairs = F.explode(F.arrays_zip(F.array(*map(F.lit, names)).alias("feature"), F.col("contributions").alias("contribution"))).alias("_p")
    return explained.select(*keys, pairs).select(*keys, F.col("_p.feature").alias("feature"), F.col("_p.contribution").alias("contribution"))


def blended(themes: DataFrame, weights: dict[str, float], keys: list[str]) -> DataFrame:
    """Contributions of several themes' models (keys, theme, feature, contribution) by the meta model's weight of each theme.

    A feature of several themes is summed; themes without a weight count nothing. One shuffle, by keys and feature.
    """
    table = F.create_map(*[F.lit(v) for pair in weights.items() for v in pair]) if weights else F.create_map().cast("map<string,double>")
    weighed = themes.withColumn("contribution", F.coalesce(table[F.col("theme")], F.lit(0.0)) * F.col("contribution"))
    return weighed.groupBy(*keys, "feature").agg(F.sum("contribution").alias("contribution"))


def meta_weights(h: Hurdle) -> dict[str, float]:
    """What the meta classifier makes of each theme's probability: its coefficient, or a boosted one's importance."""
    values = h.meta_class.featureImportances if hasattr(h.meta_class, "trees") else h.meta_class.coefficients
    return {t.name: float(values[i]) for i, t in enumerate(h.themes)}


def theme_contributions(h: Hurdle, df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, theme, feature, contribution of each theme's classifier: of boosted trees by `contributions`, of a logistic one weight times scaled value.

    Scaled values have mean 0, so both are against the mean row. Features of a theme with components are these, as theme_c0 and so on.
    """
    out = None
    for t in h.themes:
        rows = h.prepared[t.name].transform(with_inputs(df, h.themes).select(*dict.fromkeys([*keys, *t.features])))
        model, parts = h.classifiers[t.name], f"{t.name}_c" in rows.columns
        features = f"{t.name}_c" if parts else f"{t.name}_x"
        names = [f"{features}{i}" for i in range(model.numFeatures)] if parts else list(t.features)
        if hasattr(model, "trees"):
            explained = contributions(model, rows, keys, features)
        else:
            weights = F.array(*[F.lit(float(w)) for w in model.coefficients])
            explained = rows.select(*keys, F.zip_with(vector_to_array(features), weights, lambda x, w: x * w).alias("contributions"))
        one = long_contributions(explained, keys, names).select(*keys, F.lit(t.name).alias("theme"), "feature", "contribution")
        out = one if out is None else out.unionByName(one)
    return out


def explain(h: Hurdle, df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, feature, contribution to the whole model's probability of any event: the themes' contributions by the meta model's weights."""
    return blended(theme_contributions(h, df, keys), meta_weights(h), keys)
