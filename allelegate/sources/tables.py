"""Stored tables as versioned Parquet, and the risk history.

A version is a folder of its own and counts once Spark has committed it, so a
merge can read the last one while it writes the next.  Rules are partitioned
by review status, which lets a match read the approved ones only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelegate.plans.schemas import TABLES

PARTITIONS = {"drug_gene_rules": ["review_status"]}


def _versions(spark: SparkSession, root: str, table: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/{table}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = []
    for status in fs.listStatus(path):
        done = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if status.getPath().getName().startswith("version=") and fs.exists(done):
            found.append(status.getPath().getName().removeprefix("version="))
    return sorted(found)


def current_version(spark: SparkSession, root: str, table: str) -> str | None:
    """Newest committed version; versions sort as text."""
    done = _versions(spark, root, table)
    return done[-1] if done else None


def version_before(spark: SparkSession, root: str, table: str, version: str) -> str | None:
    earlier = [v for v in _versions(spark, root, table) if v < version]
    return earlier[-1] if earlier else None


def write_version(df: DataFrame, root: str, table: str, version: str) -> None:
    """A new version of a table.  Writing the same version again replaces it."""
    schema = TABLES[table]
    typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    writer = typed.write.mode("overwrite")
    if table in PARTITIONS:
        writer = writer.partitionBy(*PARTITIONS[table])
    writer.parquet(f"{root}/{table}/version={version}")


def load_table(spark: SparkSession, root: str, table: str, version: str | None) -> DataFrame:
    """One version of a table; empty without a version."""
    if version is None:
        return spark.createDataFrame([], TABLES[table])
    return spark.read.schema(TABLES[table]).parquet(f"{root}/{table}/version={version}")


def load_tables(spark: SparkSession, root: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Current version of each table, with its fixed schema."""
    return {name: load_table(spark, root, name, current_version(spark, root, name)) for name in names or list(TABLES)}


def stored_tables(spark: SparkSession, root: str) -> DataFrame:
    """Names of tables that have a committed version."""
    return spark.createDataFrame([(t,) for t in TABLES if _versions(spark, root, t)], "name string")


def append_risk_results(rows: DataFrame, path: str, run_date: str, run_id: str) -> None:
    """History rows of one run, beside those of all other runs.

    A run owns its partition: running it again replaces its own rows instead of adding them twice, also when it has
    none this time, and touches no other run.
    """
    rows.write.mode("overwrite").parquet(f"{path}/run_date={run_date}/run_id={run_id}")


def read_risk_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
