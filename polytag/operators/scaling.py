"""Feature scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def minmax_scale(df: DataFrame, cols, lo: float = -1.0, hi: float = 1.0) -> DataFrame:
    """Scale numeric columns to [lo, hi]; a constant column maps to lo.

    One min/max aggregation (partial + final) gives 2 numbers per column; they
    come back to the driver and enter the projection as literals."""
    mm = df.agg(*[F.min(c).cast("double").alias(f"mn_{c}") for c in cols],
                *[F.max(c).cast("double").alias(f"mx_{c}") for c in cols]).first()
    out = []
    for c in df.columns:
        if c in cols:
            mn, mx = mm[f"mn_{c}"], mm[f"mx_{c}"]
            if mn is None or mx == mn:
                out.append(F.lit(lo).alias(c))
            else:
                out.append((F.lit(lo) + (F.col(c).cast("double") - F.lit(mn)) / F.lit(mx - mn) * F.lit(hi - lo)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)
