"""Session settings and the lineage cut shared by the iterative operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Cells of all grids together that may be sent to every task, some hundred bytes each.
FEW_CELLS = 400_000
_LOCAL_FOLDERS: dict[str, str] = {}


def build_session(master: str | None = None, app: str = "mapweave", **conf) -> SparkSession:
    """Session with UTC time, AQE and skew-join splitting; the cluster supplies the rest."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Superseded checkpoints go when their tables are no longer referenced.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster; a temporary one only in local mode where none is set."""
    context = spark.sparkContext
    current = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not context.getCheckpointDir():
            context.setCheckpointDir(current)
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that every executor can reach.")
    folder = _LOCAL_FOLDERS.setdefault(context.applicationId, tempfile.mkdtemp(prefix="mapweave-ckpt-"))
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame, wide: bool = False) -> DataFrame:
    """Reliable checkpoint: the result outlives any lost executor.

    ``wide`` is for inputs of joins that multiply rows: a table small enough to be coalesced into fewer partitions than
    there are cores is dealt out again, so the multiplied work uses all of them. Large tables are left as they are.
    """
    checkpoint_dir(df.sparkSession)
    result = df.checkpoint(eager=True)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return result.repartition(cores) if wide and result.rdd.getNumPartitions() < cores else result
