"""Session defaults and shared scratch folders."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from weakref import WeakKeyDictionary

from pyspark.sql import SparkSession


# Settings that suit these plans and that a session may change at any time.  Rows
# with many text columns make long generated methods, which the JVM runs without
# compiling them; past this size Spark generates smaller ones instead.
SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows that a Python worker holds at once; ten times fewer than Spark's own number, because rows carry whole texts.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}

# Bytes of a task's input, from files and from shuffles.  Packed columns of numbers grow up to a hundred times as wide rows
# of text, which sorts and sort-based aggregates hold, so Spark's own 128 and 64 MB make tasks that spill all they read.
TASK_BYTES = {
    "spark.sql.files.maxPartitionBytes": 4 << 20,
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 8 << 20,
}

# Partitions of a shuffle before adaptive execution joins small ones; a shuffle cannot be cut finer later.
SHUFFLE = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
SHUFFLE_PARTITIONS = 600


_given: WeakKeyDictionary[SparkSession, dict[str, str | None]] = WeakKeyDictionary()


def tune(spark: SparkSession, wide_rows: bool = True) -> SparkSession:
    """Apply SETTINGS to a session that someone else made.

    With `wide_rows`, TASK_BYTES lower and SHUFFLE_PARTITIONS raises what the session came with; else that holds.
    """
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    given = _given.setdefault(spark, {name: spark.conf.get(name, None) for name in [*TASK_BYTES, SHUFFLE]})
    for name, value in given.items():
        if value is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, value)
    if wide_rows:
        for name, most in TASK_BYTES.items():
            if _bytes(spark, spark.conf.get(name)) > most:
                spark.conf.set(name, f"{most}b")
        if int(given[SHUFFLE] or spark.conf.get("spark.sql.shuffle.partitions")) < SHUFFLE_PARTITIONS:
            spark.conf.set(SHUFFLE, str(SHUFFLE_PARTITIONS))
    ship(spark)
    return spark


def _bytes(spark: SparkSession, size: str) -> int:
    """A size as Spark's settings write it, in bytes."""
    return spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context."""
    context = spark.sparkContext
    if getattr(context, "_allelegate_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="allelegate-")), "allelegate.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._allelegate_shipped = True


def local_session(cores: int | str = 8, partitions: int = 8, app: str = "allelegate") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return tune(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("ALLELEGATE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a fresh local one only for a local master without one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
        if not named:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="allelegate-")
            spark.sparkContext.setCheckpointDir(named)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own for one run, below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
