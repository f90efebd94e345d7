"""Session settings the results depend on, and the shared folder for staged tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# UTC keeps timestamps comparable; the skew settings let AQE split a hot key of a
# shuffle join even when an aggregation on the same key follows it.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

_own_folder: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="mirador-ship-")  # the driver serves it until it ends
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = os.path.join(folder, "mirador")
        context.addPyFile(
            shutil.make_archive(archive, "zip", os.path.dirname(package), os.path.basename(package))
        )
        _shipped.add(context.applicationId)


def tune(spark: SparkSession) -> SparkSession:
    ship(spark)
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def staging_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    if context.applicationId not in _own_folder:
        folder = tempfile.mkdtemp(prefix="mirador-stage-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_folder[context.applicationId] = folder
    return _own_folder[context.applicationId]


def local_session(cores: int | str = "*", memory: str = "8g", **settings: str) -> SparkSession:
    """Single-machine session for tests and the bench."""
    workers = os.cpu_count() if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("mirador")
        .config("spark.sql.shuffle.partitions", str(workers))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
