from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tessella.plans.model import attributions as A

NAMES = [f"f{i}" for i in range(6)]


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 8, (400, 6)).astype(float)
    y = x[:, 0] * x[:, 1] - 3 * (x[:, 2] > 4) + x[:, 3] * (x[:, 0] > 3) + rng.normal(size=400)
    rows = [(i, *map(float, r), float(t), float(t > 12)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, ["id", *NAMES, "y", "label"])
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(df)


def known(node, x, features):
    """A tree's expected prediction if only those features of x are known, node by node."""
    if node.subtreeDepth() == 0:
        return node.prediction()
    split, left, right = node.split(), node.leftChild(), node.rightChild()
    if split.featureIndex() in features:
        return known(left if x[split.featureIndex()] <= split.threshold() else right, x, features)
    a, b = left.impurityStats().count(), right.impurityStats().count()
    return (a * known(left, x, features) + b * known(right, x, features)) / (a + b)


def by_subsets(roots, x):
    """Shapley values by their definition, over all subsets of six features; roots: (root node, weight)."""
    value = {s: sum(w * known(r, x, set(s)) for r, w in roots) for k in range(7) for s in combinations(range(6), k)}
    out = []
    for i in range(6):
        others = [s for s in value if i not in s]
        out.append(sum(factorial(len(s)) * factorial(5 - len(s)) / factorial(6) * (value[tuple(sorted((*s, i)))] - value[s]) for s in others))
    return value[()], out


@pytest.mark.parametrize("kind", ["tree", "boosted", "forest", "classes"])
def test_equal_to_all_subsets_and_add_up(train, kind):
    estimator = {
        "tree": DecisionTreeRegressor(labelCol="y", maxDepth=5),
        "boosted": GBTRegressor(labelCol="y", maxDepth=3, maxIter=4, seed=1),
        "forest": RandomForestRegressor(labelCol="y", maxDepth=4, numTrees=3, seed=1),
        "classes": GBTClassifier(maxDepth=3, maxIter=3, seed=1),
    }[kind]
    model = estimator.fit(train)
    raw = model.transform(train)
    total = F.element_at(A.vector_to_array("rawPrediction"), 2) if kind == "classes" else F.col("prediction")
    predicted = {r["id"]: r["t"] for r in raw.select("id", total.alias("t")).collect()}
    got = {r["id"]: (r["base"], r["contributions"]) for r in A.contributions(model, train, ["id"]).collect()}
    assert len(got) == 400
    # A boosted classifier's raw prediction is its trees' sum.
    assert all(abs(base + sum(c) - predicted[i]) < 1e-9 for i, (base, c) in got.items())
    trees = list(zip(model.trees, model.treeWeights)) if kind != "tree" else [(model, 1.0)]
    scale = 1 / len(trees) if kind == "forest" else 1.0
    roots = [(t._java_obj.rootNode(), w * scale) for t, w in trees]
    for r in train.where("id < 5").collect():
        base, values = by_subsets(roots, list(r["features"]))
        assert np.allclose([got[r["id"]][0], *got[r["id"]][1]], [base, *values], atol=1e-9)


def test_missing_vectors_and_classes(spark, train):
    model = DecisionTreeRegressor(labelCol="y", maxDepth=3).fit(train)
    empty = spark.createDataFrame([(1, None), (2, [float("nan")] * 6)], "id long, v array<double>").withColumn("features", F.when(F.col("v").isNotNull(), array_to_vector("v")))
    got = {r["id"]: r["contributions"] for r in A.contributions(model, empty, ["id"]).collect()}
    assert got[1] is None and len(got[2]) == 6 and not np.isnan(got[2]).any()
    assert A.contributions(model, empty.limit(0), ["id"]).count() == 0
    with pytest.raises(ValueError):
        A.contributions(DecisionTreeClassifier(maxDepth=2).fit(train), train, ["id"])


def test_long_and_blended(spark):
    explained = spark.createDataFrame([(1, [0.5, -1.0]), (2, None)], "id long, contributions array<double>")
    long = A.long_contributions(explained, ["id"], ["a", "b"])
    assert sorted(map(tuple, long.collect())) == [(1, "a", 0.5), (1, "b", -1.0)]
    themes = long.withColumn("theme", F.lit("x")).unionByName(long.withColumn("theme", F.lit("y"))).unionByName(long.withColumn("theme", F.lit("z")))
    got = A.blended(themes, {"x": 2.0, "y": -1.0}, ["id"])
    assert sorted(map(tuple, got.collect())) == [(1, "a", 0.5), (1, "b", -1.0)]
    assert {r["contribution"] for r in A.blended(themes, {}, ["id"]).collect()} == {0.0}
