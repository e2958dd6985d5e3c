"""Session helpers for tests, benches and scripts; clusters bring their own session."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def local_session(app: str = "citeloom", cpus: str | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


#: Rows of an Arrow batch, where the session keeps Spark's own 10,000: texts are long, and what
#: a batch takes beside the heap, in the JVM and in its Python workers, counts against an executor.
BATCH = "1000"


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver found it, and be sent small batches."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) not in paths:
        env["PYTHONPATH"] = os.pathsep.join([str(ROOT), *paths])
    return spark


def dealt(df: DataFrame) -> DataFrame:
    """`df` dealt anew over as many tasks as a shuffle has, and four a core at least: for rows that
    are few bytes, so that one task would read them all, and much work each."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def settled(df: DataFrame) -> DataFrame:
    """`df` worked out once, in the folder that the driver and all executors share.

    What reads it again sees the same rows in the same parts, whatever the planner makes of it.
    A folder of our own is set only where the session names none and runs in one process.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="citeloom-")
            atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
