"""Reading files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docpress.catalog.registry import micros, query, table, table_path
from docpress.functions.payload import JSON_OPTIONS, row_json
from docpress.operators.layout import read_spread
from docpress.scratch import scratch_path
from docpress.sources.files import input_inventory, read_table

_EVENTS_SQL = """
    select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts, user_id, event_type, value, props
    from events
"""


@query("scan_parquet", "select * from customer")
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, table_path(sf_dir, "customer"))


@query("scan_json_roundtrip", _EVENTS_SQL)
def scan_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    path = scratch_path(spark, "events") + ".json"
    events.write.options(**JSON_OPTIONS).json(path)
    back = read_table(spark, path, schema=events.schema, **JSON_OPTIONS)
    return back.withColumn("ts", micros("ts"))


@query("scan_csv_roundtrip", """
    select * replace (strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%f') as l_shipdate) from lineitem
""")
def scan_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    path = scratch_path(spark, "lineitem") + ".csv"
    lines.write.option("header", "true").csv(path)
    return read_table(spark, path, schema=lines.schema).withColumn(
        "l_shipdate", micros("l_shipdate"))


@query("scan_dispatch", """
    select f.reader, part.* from part, (values ('csv'), ('folder'), ('json')) as f(reader)
""")
def scan_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    base = scratch_path(spark, "part")
    part.write.json(f"{base}/part.json")
    part.write.option("header", "true").csv(f"{base}/part.csv")
    part.write.parquet(f"{base}/part")
    reads = [
        read_table(spark, f"{base}/{name}", schema=part.schema).select(
            F.lit(reader).alias("reader"), "*")
        for reader, name in (("csv", "part.csv"), ("folder", "part"), ("json", "part.json"))
    ]
    return reduce(DataFrame.unionByName, reads)


@query("scan_json_gz", _EVENTS_SQL)
def scan_json_gz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A landing folder of gzip JSON lines: one task per file, so spread after it."""
    events = table(spark, sf_dir, "events")
    path = scratch_path(spark, "landing")
    events.write.option("compression", "gzip").options(**JSON_OPTIONS).json(path)
    landed = read_spread(spark, path, schema=events.schema, **JSON_OPTIONS)
    return landed.withColumn("ts", micros("ts"))


@query("input_inventory", """
    select count(distinct (source, doc_id % 4)) as n_files,
           sum(strlen(to_json(d)::varchar) + 1)::bigint as n_bytes
    from documents d
""")
def inventory_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of JSON lines with four files for each source."""
    documents = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "landing")
    (documents.select(row_json(documents.columns).alias("value"), F.col("source").alias("of"),
                      (F.col("doc_id") % 4).alias("salt"))
     .repartition("of", "salt").write.partitionBy("of", "salt").text(path))
    return input_inventory(spark, path).select("n_files", "n_bytes")
