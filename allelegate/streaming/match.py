"""Risk matching on a stream of requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from allelegate.functions.text import trim_all
from allelegate.operators.match import match_risk, risk_history_rows
from allelegate.sources.tables import append_risk_results

Tables = Callable[[], tuple[DataFrame, DataFrame, DataFrame, DataFrame]]


def match_risk_stream(
    requests: DataFrame, patients: DataFrame, meds: DataFrame, rules: DataFrame, pgx: DataFrame
) -> DataFrame:
    """Decisions for streamed requests: two stream-static joins and row expressions, no state.

    Spark lists the files of the static tables when the stream starts; `keep_history` reads them anew for each
    micro-batch.
    """
    return match_risk(requests, patients, meds, rules, pgx)


def batch_clock(spark: SparkSession, log: str, batch: int):
    """Time at which a micro-batch was first decided, kept in `log`, so a batch that runs again has the same."""
    path = f"{log}/batch={batch:010d}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        spark.range(1).select(F.current_timestamp().alias("at")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).first()["at"]


def keep_history(requests: DataFrame, tables: Tables, path: str, checkpoint: str, request: list[str], clock: str | None = None, **trigger) -> StreamingQuery:
    """Decide streamed requests and keep their history; a batch that runs again replaces its own rows.

    `tables` is called for each micro-batch and returns the current patients, medications, rules and results.
    Of the results, only those of the batch's patients are gathered.  Rows carry the batch's own time, which is
    kept in `clock` (a folder beside the checkpoint by default).
    """

    def decide(batch: DataFrame, number: int) -> None:
        patients, meds, rules, pgx = tables()
        asked = batch.select(trim_all(F.col("patient_id").cast("string")).alias("_asked")).distinct()
        own = pgx.join(asked, pgx["patient_id"].cast("string") == F.col("_asked"), "left_semi")
        at = batch_clock(batch.sparkSession, clock or f"{checkpoint}-clock", number)
        run = f"batch-{number:010d}"
        rows = risk_history_rows(match_risk(batch, patients, meds, rules, own), run, F.lit(at), request)
        append_risk_results(rows, path, f"{at:%Y-%m-%d}", run)

    return (
        requests.writeStream.foreachBatch(decide)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
