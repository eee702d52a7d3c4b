"""Statistics, ordered reads and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docpress.catalog.registry import (
    SIZED_DOCUMENTS_SQL, SIZED_EVENTS_SQL, micros, query, mean_digits, mean_digits_sql,
    sized_documents, sized_events, table)
from docpress.operators import stats as S
from docpress.operators.gates import check
from docpress.operators.ranked import top_k
from docpress.scratch import scratch_path

_STATS_SQL = f"""
    count(*) as n_docs, {mean_digits_sql("avg(compression_ratio)")} as avg_ratio,
    sum(original_size)::bigint as total_original,
    sum(compressed_size)::bigint as total_compressed
"""


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: mean_digits(name) for name in names})


@query("collection_stats", f"""
    select {_STATS_SQL},
           {mean_digits_sql("sum(original_size)::double / nullif(sum(compressed_size), 0)")}
               as overall_ratio
    from ({SIZED_DOCUMENTS_SQL})
""")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.collection_stats(sized_documents(spark, sf_dir)), "avg_ratio", "overall_ratio")


@query("stats_from_commits", f"""
    select {_STATS_SQL},
           {mean_digits_sql("sum(original_size)::double / nullif(sum(compressed_size), 0)")}
               as overall_ratio, true as median_fits
    from ({SIZED_DOCUMENTS_SQL})
""")
def stats_from_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of a collection from the partials of four commits, one of them stored twice."""
    path, partials = scratch_path(spark, "commits"), scratch_path(spark, "partials")
    documents = sized_documents(spark, sf_dir)
    for part in (0, 1, 2, 3, 1):
        mine = F.pmod(F.coalesce(F.col("_id").cast("bigint"), F.lit(0)), F.lit(4)) == part
        S.append_with_partial(documents.where(mine), path, partials, f"part-{part}")
    merged = S.merged_stats(spark.read.parquet(partials), (0.5,))
    # At least 47 % of the values lie on either side of the sketches' median, itself included.
    median = merged.first()["ratio_quantiles"]
    value, middle = F.col("compression_ratio"), F.lit(median[0] if median else None)
    fits = spark.read.parquet(path).agg(
        (F.count_if(value <= middle) >= 0.47 * F.count(value))
        & (F.count_if(value >= middle) >= 0.47 * F.count(value))).first()[0]
    return _rounded(merged.drop("ratio_quantiles").withColumn("median_fits", F.lit(fits)),
                    "avg_ratio", "overall_ratio")


@query("logical_size", f"""
    select count(*) as n_docs, sum(compressed_size)::bigint as logical_bytes
    from ({SIZED_DOCUMENTS_SQL})
""")
def logical_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.logical_size(sized_documents(spark, sf_dir))


@query("ratio_count_summary", f"""
    select {mean_digits_sql("avg(compression_ratio)")} as avg_ratio, count(*) as total_docs
    from ({SIZED_DOCUMENTS_SQL})
""")
def ratio_count_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.ratio_count_summary(sized_documents(spark, sf_dir)), "avg_ratio")


def _top_documents(metric: str, order: str) -> str:
    return f"""
        select _id, original_size, compressed_size, compression_ratio
        from ({SIZED_DOCUMENTS_SQL}) order by {metric} {order} nulls last, _id limit 25
    """


def _shown(df: DataFrame) -> DataFrame:
    return df.select("_id", "original_size", "compressed_size", "compression_ratio")


@query("topk_original_size", _top_documents("original_size", "desc"))
def topk_original_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(top_k(sized_documents(spark, sf_dir), "original_size", 25))


@query("topk_compressed_size", _top_documents("compressed_size", "desc"))
def topk_compressed_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(top_k(sized_documents(spark, sf_dir), "compressed_size", 25))


@query("topk_best_ratio", _top_documents("compression_ratio", "desc"))
def topk_best_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(top_k(sized_documents(spark, sf_dir), "compression_ratio", 25))


@query("topk_worst_ratio", _top_documents("compression_ratio", "asc"))
def topk_worst_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(top_k(sized_documents(spark, sf_dir), "compression_ratio", 25, ascending=True))


@query("topk_newest", f"""
    select _id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as stored_at, original_size
    from ({SIZED_EVENTS_SQL}) order by ts desc, _id limit 25
""")
def topk_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = sized_events(table(spark, sf_dir, "events")).withColumn(
        "metadata", F.struct("timestamp"))
    return top_k(documents, "metadata.timestamp", 25).select(
        "_id", micros("metadata.timestamp").alias("stored_at"), "original_size")


@query("ratio_gate", f"""
    select floor, n_docs, {mean_digits_sql("avg_ratio")} as avg_ratio, n_docs > 0 as has_documents,
           avg_ratio >= floor as ratio_ok, n_docs > 0 and avg_ratio >= floor as passed
    from (select count(*) as n_docs, avg(compression_ratio) as avg_ratio
          from ({SIZED_DOCUMENTS_SQL})), (values (1.0::double), (5.0::double)) as f(floor)
""")
def ratio_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same statistics row judged by a floor it passes and one it fails."""
    stats = S.collection_stats(sized_documents(spark, sf_dir))
    floors = stats.withColumn("floor", F.explode(F.array(F.lit(1.0), F.lit(5.0))))
    return _rounded(check(floors, F.col("floor")), "avg_ratio").select(
        "floor", "n_docs", "avg_ratio", "has_documents", "ratio_ok", "passed")
