"""Streaming queries: tables written as files, streamed to the end, results read back."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelegate.operators import merge as G
from allelegate.plans.fixtures import read_sql, view
from allelegate.plans.session import scratch_path
from allelegate.queries import query
from allelegate.queries.accounts import THROTTLE
from allelegate.queries.match import DECISION, FLAT, HISTORY, REQ_PLAIN, REQUEST, RUN_TS, flat, inputs, run_ts
from allelegate.queries.merge import IN_ORDER, UPSERT_PGX
from allelegate.sources.buckets import BucketTable
from allelegate.sources.tables import read_risk_results
from allelegate.streaming.apply import apply_stream
from allelegate.streaming.match import keep_history, match_risk_stream
from allelegate.streaming.profiles import Profiles
from allelegate.streaming.throttle import throttle_batches, throttle_stream


def in_slices(spark, slices: list[DataFrame], name: str, start) -> None:
    """Write slice after slice as files; after each, `start` streams all new files as one micro-batch."""
    path = scratch_path(spark, name)
    for part in slices:
        part.write.mode("append").parquet(path)
        start(spark.readStream.schema(slices[0].schema).parquet(path)).awaitTermination()


def to_files(stream: DataFrame, out: str, log: str):
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start()


def run_to_table(spark, stream: DataFrame, name: str) -> DataFrame:
    out, log = scratch_path(spark, name), scratch_path(spark, f"{name}-log")
    to_files(stream, out, log).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("match_risk_stream", f"with {REQ_PLAIN}, {DECISION} {FLAT}")
def match_stream(spark, sf):
    requests, patients, meds, rules, pgx = inputs(spark, sf)
    path = scratch_path(spark, "requests")
    requests.write.parquet(path)
    stream = spark.readStream.schema(requests.schema).parquet(path)
    return run_to_table(spark, flat(match_risk_stream(stream, patients, meds, rules, pgx)), "decisions")


KEPT = HISTORY.replace("created_at from history", "true as has_time from history").replace(f"timestamp '{RUN_TS}' as created_at", "true as has_time")


@query("keep_history", KEPT)
def history_of_stream(spark, sf):
    """Requests in two slices, decided per micro-batch against tables that are read anew."""
    requests, *_ = inputs(spark, sf)
    path, log = scratch_path(spark, "history"), scratch_path(spark, "history-log")
    current = lambda: inputs(spark, sf)[1:]
    slices = [requests.where("line_no <= 2"), requests.where("line_no > 2 or line_no is null")]
    in_slices(spark, slices, "requests", lambda stream: keep_history(stream, current, path, log, REQUEST))
    kept = read_risk_results(spark, path)
    return kept.withColumn("has_time", F.col("created_at").isNotNull()).drop("id", "created_at", "run_date", "run_id")


#: Two micro-batches of requests, and the results that are stored before each.
EARLY, LATE = "line_no <= 2", "(line_no > 2 or line_no is null)"
FIRST = "id % 3 > 0"


def _history_of(requests: str, results: str) -> str:
    """The history of some requests over some results."""
    text = re.sub(r"\bfx_requests\b", f"(select * from fx_requests where {requests})", KEPT)
    return f"select * from ({re.sub(r'\bfx_pgx\b', f'(select * from fx_pgx where {results})', text)}) x"


@query("keep_history_by_profiles", f"{_history_of(EARLY, FIRST)} union all {_history_of(LATE, 'true')}")
def history_by_profiles(spark, sf):
    """Requests in two slices against stored profiles; a third of the results is stored between the two."""
    requests, patients, meds, rules, pgx = inputs(spark, sf)
    root, path, log, more = (scratch_path(spark, n) for n in ("profiles", "history", "history-log", "results-log"))
    text = lambda df, *names: df.withColumns({c: F.col(c).cast("string") for c in names})
    pgx = text(pgx, "patient_id")
    profiles = Profiles.started(root, text(patients, "id"), text(meds, "id"), text(rules, "medication_id"), pgx.where(FIRST))
    columns = requests.columns
    asked = text(requests, "patient_id", "medication_id")
    steps = iter([lambda: None, lambda: _stored_late(spark, profiles, pgx, more)])

    def decide(stream):
        next(steps)()
        return profiles.history_stream(stream, path, log, REQUEST)

    in_slices(spark, [asked.where(EARLY), asked.where(LATE)], "requests", decide)
    kept = read_risk_results(spark, path)
    plain = {c: F.col(c).cast(requests.schema[c].dataType) for c in columns if c in kept.columns}
    return kept.withColumns(plain | {"has_time": F.col("created_at").isNotNull()}).drop("id", "created_at", "run_date", "run_id")


def _stored_late(spark, profiles: Profiles, pgx: DataFrame, log: str) -> None:
    union = lambda stored, batch: stored.unionByName(batch)
    late = pgx.where(f"not ({FIRST})")
    in_slices(spark, [late], "results", lambda stream: profiles.results_stream(stream, union, log))


def attempts_by_week(spark, sf) -> list[DataFrame]:
    return [
        read_sql(spark, sf, f"select * from fx_attempts where {test}")
        for test in (
            "ts < timestamp '2024-01-08 00:00:00'",
            "ts >= timestamp '2024-01-08 00:00:00' and ts < timestamp '2024-01-17 00:00:00'",
            "ts >= timestamp '2024-01-17 00:00:00'",
        )
    ]


@query("throttle_stream", THROTTLE)
def throttle(spark, sf):
    out, log = scratch_path(spark, "throttled"), scratch_path(spark, "throttled-log")
    number = lambda stream: throttle_stream(stream, "subject", "ts", ["event_id"], window_seconds=10 * 24 * 3600, maximum=3)
    in_slices(spark, attempts_by_week(spark, sf), "attempts", lambda stream: to_files(number(stream), out, log))
    return spark.read.parquet(out)


@query("throttle_batches", THROTTLE)
def throttle_by_batch(spark, sf):
    root, log = scratch_path(spark, "throttle"), scratch_path(spark, "throttle-log")
    run = lambda stream: throttle_batches(
        stream, "subject", "ts", ["event_id"], root, log, window_seconds=10 * 24 * 3600, maximum=3, keep_seconds=30 * 24 * 3600
    )
    in_slices(spark, attempts_by_week(spark, sf), "attempts", run)
    return spark.read.parquet(f"{root}/attempts").drop("batch")


@query("apply_stream", UPSERT_PGX)
def apply_changes(spark, sf):
    """Results entered in two parts by ship date, merged one version after the other."""
    text = lambda df, c: df.withColumn(c, F.col(c).cast("string"))
    root, log = scratch_path(spark, "store"), scratch_path(spark, "store-log")
    table = BucketTable(spark, root, "pgx_results", "patient_id")
    table.write(view(spark, sf, "fx_store_pgx"), "-start")
    parts = [
        text(read_sql(spark, sf, f"select * from fx_pgx_in where l_shipdate {test} timestamp '1998-01-01 00:00:00'"), "patient_id")
        for test in ("<", ">=")
    ]
    patients = text(view(spark, sf, "fx_patients"), "id")

    def merge(stored: DataFrame, batch: DataFrame) -> DataFrame:
        return G.upsert_pgx(stored, G.checked_results(batch, patients), IN_ORDER, run_ts().cast("timestamp"))

    in_slices(spark, parts, "results", lambda stream: apply_stream(stream, merge, table, log))
    return table.read().select(
        "id",
        F.col("patient_id").cast("bigint").alias("patient_id"),
        "gene",
        "phenotype",
        "genotype",
        "source",
        F.col("created_at").cast("timestamp_ntz").alias("created_at"),
        F.col("updated_at").cast("timestamp_ntz").alias("updated_at"),
    )
