"""Rules for news records: codes of actions, trust in their places, and clusters of themes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of predatory action codes, weights by type of place (others 0.75), and the themes of each cluster.
PREDATORY_CODES = ("10", "11", "17", "18", "19")
PLACE_WEIGHTS = {3: 1.0, 4: 1.0, 5: 0.5, 1: 0.25}
OTHER_PLACE = 0.75
THEME_CLUSTERS = {
    "resource_predation": ("NATURAL_RESOURCES", "MINING", "SMUGGLING", "TAX_FNCACT", "EXTORTION", "BLACK_MARKET"),
    "displacement": ("REFUGEES", "DISPLACEMENT", "FAMINE", "FOOD_SECURITY"),
    "governance_breakdown": ("CORRUPTION", "UNGOVERNED", "FAILED_STATE", "REBELLION", "COUP"),
}


def place_weight(kind: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for kv in PLACE_WEIGHTS.items() for x in kv])
    return F.coalesce(F.try_element_at(weights, kind.cast("int")), F.lit(OTHER_PLACE))


def predatory_count(code: Column, kind: Column) -> Column:
    """The place's weight if the code begins as a predatory one, else 0; a null code is none."""
    return F.when(F.coalesce(code.cast("string").rlike(f"^(?:{'|'.join(PREDATORY_CODES)})"), F.lit(False)), place_weight(kind)).otherwise(0.0)


def in_cluster(themes: Column, cluster: str) -> Column:
    """Whether a list of themes, divided by semicolons, holds one of the cluster's as a whole; null holds none."""
    return F.coalesce(F.arrays_overlap(F.split(themes, ";"), F.array(*map(F.lit, THEME_CLUSTERS[cluster]))), F.lit(False))
