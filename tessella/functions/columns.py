"""Kinds of feature columns, by name."""

from __future__ import annotations

import re

# Patterns of names by kind, tried in this order; other columns are stocks. The last pattern of the first kind
# asks for a backslash, so lags are not matched by it; that is kept for equal results.
KINDS = {
    "computed": (r"^target_", r"_available$", r"^is_", r"^has_", r"_flag$", r"^month_(sin|cos)$", r"^is_dry_season$", r"^epoch$", r"^cw_", r"^narrative_", r"^fusion_", r"_decay_", r"_spatial_lag", r"_lag\\d+$"),
    "flow": (r"^national_", r"^(fatalities|casualties|deaths)", r"_count$", r"^acled_count_", r"^gdelt_.*_count", r"_event_count$", r"^(protest|riot|battle|explosion)_", r"outage_score$", r"^mech_", r"^ioda_"),
    "sparse": (r"^price_", r"_price$", r"food_price", r"displacement", r"^iom_", r"_recency_days$"),
}


def column_kind(name: str, flows: frozenset[str] = frozenset()) -> str:
    """computed, flow, sparse or stock; names that the configuration calls flows are flows."""
    if name in flows:
        return "flow"
    return next((kind for kind, patterns in KINDS.items() if any(re.search(p, name, re.IGNORECASE) for p in patterns)), "stock")


def columns_by_kind(names: list[str], flows: frozenset[str] = frozenset()) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {kind: [] for kind in (*KINDS, "stock")}
    for name in names:
        out[column_kind(name, flows)].append(name)
    return out
