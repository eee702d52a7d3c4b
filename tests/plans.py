"""Reading physical plans in assertions."""

from __future__ import annotations


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final(df) -> str:
    """The plan as it ran, AQE decisions included."""
    df.collect()
    return physical(df)
