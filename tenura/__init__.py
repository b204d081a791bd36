"""tenura: subject-level churn, explanation and survival analytics on Spark.

Every public operator takes a DataFrame plus column names and returns a
DataFrame.  Heavy work (scans, joins, grouping, windows) stays on Spark;
the driver only sees results whose size is bounded by the number of
features, distinct times or strata.
"""

from tenura.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
