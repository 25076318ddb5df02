"""Settings that stateful streams need."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Arbitrary state needs the RocksDB store; the checkpoint location of each query keeps it on shared storage."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
