"""python -m tessella COMMAND: panel, matrix, score, evaluate, validate or serve over a folder of tables."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from tessella.plans import catalogue
from tessella.session import get_spark

#: What each command runs, in order.
COMMANDS = {
    "panel": ("flow_zero_fill", "lags", "forward_fills", "recency_days", "ewm_30d", "rolling_shock_26", "seasonal_zscore"),
    "matrix": ("feature_matrix",),
    "score": ("hurdle_ensemble",),
    "evaluate": ("metrics_auc", "metrics_binary", "recall_at_fpr", "tier_recall", "coverage_by_bin", "vif_uncentred", "spearman_pairs"),
    "validate": ("contract_checks", "gap_check", "step_alignment", "prevalence", "null_report"),
    "serve": ("serve_predictions_h3", "serve_predictions_region", "serve_history", "serve_summary"),
}


def main() -> None:
    p = argparse.ArgumentParser(prog="tessella", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--data", default="/root/testdata/sf0.01", help="folder of Parquet tables")
    p.add_argument("--out", help="folder that results are written to; else they are shown")
    p.add_argument("--step", help="only this query of the command")
    p.add_argument("--start-date", help="drop rows whose date is before")
    p.add_argument("--end-date", help="drop rows whose date is after")
    a = p.parse_args()
    spark, queries = get_spark(), catalogue.queries()
    for name in COMMANDS[a.command]:
        if a.step and name != a.step:
            continue
        df = queries[name](spark, a.data)
        if "date" in df.columns:
            df = df.where(F.col("date") >= F.lit(a.start_date).cast("date")) if a.start_date else df
            df = df.where(F.col("date") <= F.lit(a.end_date).cast("date")) if a.end_date else df
        if a.out:
            df.write.mode("overwrite").parquet(f"{a.out.rstrip('/')}/{name}")
        else:
            print(name)
            df.show(20, truncate=False)


if __name__ == "__main__":
    main()
