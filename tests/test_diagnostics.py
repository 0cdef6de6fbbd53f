"""Ranks and products of many columns at once against numpy, column by column."""

import numpy as np
import pytest

from tessella.plans.model import diagnostics

K = 40


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, K))
    x[:, 1] = x[:, 0] ** 3 + 0.1 * x[:, 1]
    x[:, 2] = np.maximum(0, np.round(x[:, 2]))  # many ties
    x[:, 3] = 7.0  # no spread
    x[:, 4] = np.nan
    x[rng.random((300, K)) < 0.1] = np.nan
    names = [f"c{i}" for i in range(K)]
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(4), x, names


def average_ranks(column):
    out = np.full(len(column), np.nan)
    there = ~np.isnan(column)
    values = column[there]
    out[there] = [(values < v).sum() + ((values == v).sum() + 1) / 2 for v in values]
    return out


def test_rank_correlations(table):
    df, x, names = table
    got = {(r["a"], r["b"]): r["rho"] for r in diagnostics.spearman_pairs(df, names).collect()}
    ranked = [average_ranks(x[:, i]) for i in range(K)]
    want = {}
    for i in range(K):
        for j in range(i + 1, K):
            both = ~np.isnan(ranked[i]) & ~np.isnan(ranked[j])
            if both.sum() > 1 and np.ptp(ranked[i][both]) > 0 and np.ptp(ranked[j][both]) > 0:
                want[names[i], names[j]] = np.corrcoef(ranked[i][both], ranked[j][both])[0, 1]
    assert got == pytest.approx(want) and set(got) == set(want)
    assert set(diagnostics.spearman_pairs(df, names, 0.9).select("a", "b").collect()) == {k for k, v in want.items() if abs(v) >= 0.9}


def test_moments_over_complete_rows(table):
    df, x, names = table
    some = [0, 1, 2, 5]
    whole = x[:, some][~np.isnan(x[:, some]).any(axis=1)]
    assert diagnostics.moments(df, [names[i] for i in some]) == pytest.approx(whole.T @ whole)
    assert (diagnostics.moments(df.where("false"), names[:2]) == 0).all()


def test_one_grouping_for_all_columns(table):
    df, _, names = table
    plan = diagnostics.rank_vectors(df, names)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 3
