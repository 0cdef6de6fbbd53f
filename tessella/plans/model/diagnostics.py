"""Collinearity, feature grouping, attributions and pruning."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import prefix_theme
from tessella.operators.ranges import running_sums
from tessella.session import materialise


def gram(vectors: DataFrame, k: int) -> DataFrame:
    """(i, j, n, s, ss, p) of all pairs of places of the vectors in _v: over the rows that have both, their number, and the sums of x(i), x(i) ** 2 and x(i) * x(j).

    Null and NaN are missing. Each task sums its rows by matrix products, so k ** 2 rows a task are shuffled, whatever the number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = b["_v"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, k)
            there = np.isfinite(x)
            x, m = np.where(there, x, 0.0), there.astype(np.float64)
            part = np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
            total = part if total is None else total + part
        if total is not None:
            i, j = np.indices((k, k)).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *[pa.array(t.ravel()) for t in total]], ["i", "j", "n", "s", "ss", "p"])

    parts = vectors.select("_v").mapInArrow(run, "i long, j long, n double, s double, ss double, p double")
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss", "p")])


def rank_vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    """_v: of each row the average ranks of its columns, less the column's mean rank; missing where the value is.

    All columns are ranked together: values are counted by (column, value), the counts summed range by range, and the ranks brought back
    to the rows in one join and one grouping, however many columns there are.
    """
    rows = materialise(df.select(F.monotonically_increasing_id().alias("_row"), F.array(*[F.col(c).cast("double") for c in columns]).alias("_x")))
    long = rows.select("_row", F.posexplode("_x").alias("_c", "_value")).where("_value is not null")
    counts = long.groupBy("_c", "_value").agg(F.count("*").alias("_n"))
    placed = running_sums(counts, {"_upto": "_n"}, [F.col("_value")], ["_c"], {"_all": "_n"})
    ranks = placed.select("_c", "_value", (F.col("_upto") - (F.col("_n") - 1) / 2 - (F.col("_all") + 1) / 2).alias("_r"))
    ranked = long.join(ranks, ["_c", "_value"]).groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_c", "_r"))).alias("_m"))
    return ranked.select(F.array(*[F.try_element_at("_m", F.lit(i)) for i in range(len(columns))]).alias("_v"))


def spearman_pairs(df: DataFrame, columns: list[str], least: float = 0.0) -> DataFrame:
    """(a, b, rho) of the pairs of columns whose rank correlation is at least so strong, over the rows that have both."""
    sums = gram(rank_vectors(df, columns), len(columns))
    other = sums.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("s").alias("t"), F.col("ss").alias("tt"))
    both = sums.where("i < j").join(other, ["i", "j"])
    spread = lambda s, ss: F.col("n") * F.col(ss) - F.col(s) * F.col(s)
    rho = F.try_divide(F.col("n") * F.col("p") - F.col("s") * F.col("t"), F.sqrt(spread("s", "ss") * spread("t", "tt")))
    name = lambda c: F.element_at(F.array(*map(F.lit, columns)), (F.col(c) + 1).cast("int"))
    return both.select(name("i").alias("a"), name("j").alias("b"), rho.alias("rho")).where(F.abs("rho") >= least)


def moments(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Sums of products of all pairs of columns, over the rows that have all of them; the driver holds that matrix alone."""
    k = len(columns)
    vectors = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna().select(F.array(*columns).alias("_v"))
    m = np.zeros((k, k))
    for r in gram(vectors, k).select("i", "j", "p").collect():
        m[r["i"], r["j"]] = r["p"]
    return m


def vif_uncentred(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, vif): of the regression on the other columns without an intercept, from the inverse of the moments."""
    m = moments(df, columns)
    inverse = np.linalg.pinv(m)
    return df.sparkSession.createDataFrame([(c, float(m[i, i] * inverse[i, i])) for i, c in enumerate(columns)], "column string, vif double")


def complete_linkage(names: list[str], rho: dict[tuple[str, str], float], threshold: float) -> list[list[str]]:
    """Groups of columns in which every pair is at least so strongly correlated; the strongest pair of groups joins first."""
    strength = lambda a, b: min(abs(rho.get((x, y), rho.get((y, x), 0.0))) for x in a for y in b)
    groups = [[n] for n in names]
    while len(groups) > 1:
        s, i, j = max((strength(a, b), -i, -j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if s < threshold:
            break
        groups[-i] += groups.pop(-j)
    return groups


def removal_candidates(groups: Iterable[list[str]], importance: dict[str, float]) -> list[str]:
    """All but the most important column of each group."""
    return [n for g in groups for n in sorted(g, key=lambda n: (-importance.get(n, 0.0), n))[1:]]


def bundle_closure(stable: set[str], available: set[str], two_way: dict[str, list[str]], rescue: dict[str, list[str]], guards: dict[str, set[str]]) -> list[str]:
    """stable with the available columns that belong to it, sorted.

    First, once and in order, a two-way bundle (a column and its siblings) of which any is kept is kept whole. Then what a kept
    column rescues is kept, and what that rescues, to a fixed point. Last, a guard's flag is kept if any of its family is;
    the rest of the family is not. Only columns that are added must be available.
    """
    kept = set(stable)
    for column, siblings in two_way.items():
        bundle = {column, *siblings}
        if bundle & kept:
            kept |= bundle & available
    todo = list(kept)
    while todo:
        more = set(rescue.get(todo.pop(), ())) & available - kept
        kept |= more
        todo.extend(more)
    return sorted(kept | {flag for flag, family in guards.items() if flag in available and kept & set(family)})


def linear_attributions(df: DataFrame, weights: dict[str, float], keys: list[str]) -> DataFrame:
    """(keys, feature, contribution): weight times the distance from the mean; exact for linear models."""
    means = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in weights])
    parts = df.crossJoin(F.broadcast(means)).select(*keys, *[(F.lit(w) * (F.col(c) - F.col(f"_m_{c}"))).alias(c) for c, w in weights.items()])
    return parts.unpivot(keys, list(weights), "feature", "contribution")


def group_contributions(long: DataFrame, keys: list[str], prefixes: dict[str, str]) -> DataFrame:
    """(keys, theme, contribution) summed over the features of a theme."""
    return long.withColumn("theme", prefix_theme(F.col("feature"), prefixes)).groupBy(*keys, "theme").agg(F.sum("contribution").alias("contribution"))


def importance_share(importance: DataFrame, pattern: str) -> DataFrame:
    """(share, alert): what the features that match the pattern have of all importance, and whether that is over a half."""
    share = F.sum(F.when(F.col("feature").rlike(pattern), F.col("importance")).otherwise(0.0)) / F.sum("importance")
    return importance.agg(share.alias("share")).withColumn("alert", F.col("share") > 0.5)


def topic_impact(long: DataFrame, topic: str, predicted: str, more_than: int = 5) -> DataFrame:
    """(topic, n, mean prediction) of the topics with more than so many rows."""
    return long.groupBy(topic).agg(F.count("*").alias("n"), F.avg(predicted).alias("mean_prediction")).where(F.col("n") > more_than)


def stability_selection(df: DataFrame, features: list[str], target: str, rounds: int = 10, share: float = 0.5, keep: float = 0.7, seed: int = 42) -> dict[str, float]:
    """Features that beat a random shadow feature in at least `keep` of the rounds, with how often they did.

    Each round fits a logistic model on a hash half of the rows, standardised, with a shadow column of hash noise; a feature
    beats it by the size of its weight. Rounds are Spark ML fits; only weights reach the driver.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    wins = dict.fromkeys(features, 0)
    key = F.xxhash64(*features, target)
    for r in range(rounds):
        rows = df.fillna(0.0, features).withColumns({"_shadow": F.pmod(F.xxhash64(key, F.lit(seed + r)), F.lit(10_000)) / 10_000.0, "_part": F.pmod(F.xxhash64(key, F.lit(-seed - r)), F.lit(1_000)) / 1_000.0}).where(F.col("_part") < share)
        x = VectorAssembler(inputCols=[*features, "_shadow"], outputCol="_raw", handleInvalid="skip").transform(rows)
        x = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(x).transform(x)
        weights = LogisticRegression(featuresCol="_x", labelCol=target, regParam=0.01, maxIter=30).fit(x).coefficients.toArray()
        for f, w in zip(features, weights):
            wins[f] += abs(w) > abs(weights[-1])
    return {f: n / rounds for f, n in wins.items() if n / rounds >= keep}
