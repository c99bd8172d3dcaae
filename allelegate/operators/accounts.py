"""Accounts with their patient, and live sessions with their account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelegate.operators.merge import unexpired


def account_patient(users: DataFrame, patients: DataFrame) -> DataFrame:
    """Each user with the earliest of their patients; users without one are left out."""
    first = patients.groupBy("user_id").agg(
        F.min_by(F.struct(F.col("id").alias("patient_id"), "first_name"), F.struct("created_at", "id")).alias("_p")
    )
    return users.select(F.col("id").alias("user_id"), "email").join(first, "user_id").select(
        "user_id", "email", "_p.patient_id", "_p.first_name"
    )


def session_account(sessions: DataFrame, users: DataFrame, patients: DataFrame, run_ts: Column) -> DataFrame:
    """Each live session with its account and first patient."""
    live = unexpired(sessions, run_ts).select("user_id", "token_hash", "expires_at")
    return live.join(account_patient(users, patients), "user_id")


def exists_lookup(requests: DataFrame, parents: dict[str, DataFrame]) -> DataFrame:
    """Adds `has_<column>` per id column: whether its parent table has that id."""
    out = requests
    for column, parent in parents.items():
        known = parent.select(F.col("id").alias(f"_{column}"))
        out = out.join(known, F.col(column) == F.col(f"_{column}"), "left").withColumn(
            f"has_{column}", F.col(f"_{column}").isNotNull()
        ).drop(f"_{column}")
    return out
