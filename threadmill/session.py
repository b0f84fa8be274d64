"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

#: SQL settings that the engine's plans rely on.  A cluster's own values win.
SQL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(cpus: int = 8, app: str = "threadmill", **extra: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {
        **SQL_DEFAULTS,
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts.

    A cluster names it in ``spark.checkpoint.dir``; all executors share it.
    Only a local session without the setting gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="threadmill-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder, so that lost executors
    cost a read and not a recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def weakly(df: DataFrame):
    """The JVM's weak reference to the plan of ``df``."""
    return df.sparkSession.sparkContext._jvm.java.lang.ref.WeakReference(df._jdf)


def let_go(spark: SparkSession, plan, most: float = 10.0) -> None:
    """Has the files of the shuffles of a plan, see ``weakly``, that nothing refers to any more deleted now.

    Spark deletes them when the driver's JVM collects its garbage, which a
    driver with memory to spare may not do before the query ends.
    """
    gc.collect()
    until = time.time() + most
    while not plan.refersTo(None) and time.time() < until:
        time.sleep(0.5)  # the JVM is told what Python no longer holds about once a second
        spark.sparkContext._jvm.System.gc()
