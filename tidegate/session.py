"""Session set-up and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_spark(app: str = "tidegate", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session with the settings the operators expect (UTC, AQE, RocksDB state)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**ENGINE_CONF, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local session, where the
    driver and the executors share one machine, may fall back to a temporary folder.
    """
    sc = spark.sparkContext
    shared = sc.getConf().get(CHECKPOINT_CONF, None) or spark.conf.get(CHECKPOINT_CONF, None)
    if shared is None and sc.getCheckpointDir() is not None:
        shared = sc.getCheckpointDir()
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="tidegate-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared)
    return shared


def new_run_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the work folder; nothing is ever reused or deleted."""
    return f"{work_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of executors."""
    work_dir(df.sparkSession)
    return df.checkpoint(eager=True)
