"""Spark settings the jobs rely on. No credentials live here."""

from __future__ import annotations

from pyspark.sql import SparkSession

# UTC keeps rendered timestamps stable, and the byte cap on Arrow batches bounds the
# memory of a Python worker however long the texts are.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}

STREAM_CONF = {
    "spark.sql.streaming.metricsEnabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def object_store_conf(endpoint: str, *, path_style: bool = True,
                      credentials_provider: str | None = None) -> dict[str, str]:
    """Settings for ``s3a://`` paths on an S3-compatible store.

    Keys come from the credentials provider (environment, instance profile,
    mounted secret), never from code.
    """
    conf = {
        "spark.hadoop.fs.s3a.endpoint": endpoint,
        "spark.hadoop.fs.s3a.path.style.access": str(path_style).lower(),
    }
    if credentials_provider:
        conf["spark.hadoop.fs.s3a.aws.credentials.provider"] = credentials_provider
    return conf


def build_session(app_name: str, *, master: str | None = None, streaming: bool = False,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Session with :data:`BASE_CONF`; ``extra`` wins over the defaults."""
    conf = {**BASE_CONF, **(STREAM_CONF if streaming else {}), **(extra or {})}
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
