"""Quality gates over collection statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from docpress.errors import QualityGateError

MIN_RATIO = 5.0


def check(stats: DataFrame, min_ratio: float | Column = MIN_RATIO) -> DataFrame:
    """Add the verdicts to statistics rows; a NULL ratio does not pass.

    ``min_ratio`` may be a column, to judge each row by its own floor.
    """
    floor = min_ratio if isinstance(min_ratio, Column) else F.lit(float(min_ratio))
    has_documents = F.col("n_docs") > 0
    ratio_ok = F.coalesce(F.col("avg_ratio") >= floor, F.lit(False))
    return stats.select(
        "*",
        has_documents.alias("has_documents"),
        ratio_ok.alias("ratio_ok"),
        (has_documents & ratio_ok).alias("passed"),
    )


def enforce(checked: Row, min_ratio: float = MIN_RATIO) -> Row:
    """Return the checked row, or raise when it did not pass."""
    if not checked["has_documents"]:
        raise QualityGateError("the collection holds no documents")
    if not checked["ratio_ok"]:
        raise QualityGateError(
            f"mean compression ratio {checked['avg_ratio']} is below {min_ratio}")
    return checked
