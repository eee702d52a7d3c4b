"""Stored documents."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_ABSENT = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_collection(spark: SparkSession, path: str | None, *, format: str = "parquet",
                    schema: T.StructType | None = None, **options: object) -> DataFrame:
    """Documents of a collection; a query reads only the columns it names.

    With ``schema`` a collection that does not exist yet reads as empty.
    """
    reader = spark.read.format(format).options(**options)
    if schema is None:
        return reader.load(path)
    try:
        return reader.load(path)
    except AnalysisException as error:
        if error.getCondition() not in _ABSENT:
            raise
        return spark.createDataFrame([], schema)
