"""The feature matrix: which columns, joined how, with which targets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.windows import lead_targets, over_cell

HORIZONS = {"14d": 1, "1m": 2, "2m": 4, "3m": 6}


@dataclass(frozen=True)
class Feature:
    """A registered output: where its rows come from, how it was made, and how its gaps are read ('flow': 0, 'stock': unknown)."""

    name: str
    source: str
    transformation: str = "raw"
    kind: str = "stock"
    enabled: bool = True


def resolve(features: list[Feature], themes: dict[str, list[str]], panel: list[str], static: list[str]) -> dict[str, list[str]]:
    """Requested columns (of enabled features and of themes) as temporal and static ones; fail on those that neither has."""
    wanted = list(dict.fromkeys([f.name for f in features if f.enabled] + [c for cs in themes.values() for c in cs]))
    missing = [c for c in wanted if c not in panel and c not in static]
    if missing:
        raise ValueError(f"columns that no table has: {', '.join(missing)}")
    return {"temporal": [c for c in wanted if c in panel], "static": [c for c in wanted if c not in panel]}


def build(panel: DataFrame, static: DataFrame, columns: dict[str, list[str]], target: str, horizons: dict[str, int] = HORIZONS, require_targets: bool = True) -> DataFrame:
    """Panel with static features and, for each horizon, the target's value and whether it is above 0.

    Rows without all targets are dropped, as models need them; scoring keeps them. The targets' window and the panel's key
    are the same, so both need one shuffle; static features are one row a cell.
    """
    temporal = panel.select("cell", "date", *dict.fromkeys([*columns["temporal"], target]))
    with_targets = lead_targets(temporal, target, horizons, over_cell())
    if require_targets:
        with_targets = with_targets.dropna(subset=[f"target_{h}" for h in horizons])
    return with_targets.join(static.select("cell", *columns["static"]), "cell") if columns["static"] else with_targets


def add_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the columns that it lacks, as null doubles."""
    return df.withColumns({c: F.lit(None).cast("double") for c in columns if c not in df.columns})
