"""From several staged sources to merged medications and rules, or to a review file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from allelegate.operators.merge import upsert_medications, upsert_rules
from allelegate.operators.staging import dedupe_last, staged, union_sources
from allelegate.plans.session import scratch_path


def prepare(sources: list[DataFrame], order: list[str], approval_aware: bool = False) -> DataFrame:
    """All sources in order, one rule per key; `first_*` columns are the position to go on with."""
    return dedupe_last(union_sources(sources), ["ord_source", *order], approval_aware)


def run_ingest(
    sources: list[DataFrame],
    order: list[str],
    medications: DataFrame,
    rules: DataFrame,
    run_ts: Column,
    approval_aware: bool = False,
    strict: bool = True,
) -> dict[str, DataFrame]:
    """Merged `medications` and `drug_gene_rules`, and the `staged` rules behind them.

    The sources are read and brought down to one rule per key once, into a table in the shared folder that all three
    results read.  A rule that is not allowed fails every result, or, if not `strict`, is in `staged` only.
    """
    path = scratch_path(run_spark := medications.sparkSession, "prepared")
    prepared = prepare(sources, order, approval_aware)
    prepared.write.parquet(path)
    prepared = run_spark.read.schema(prepared.schema).parquet(path)
    position = [f"first_{c}" for c in ["ord_source", *order]]
    meds = upsert_medications(medications, prepared, position, run_ts, strict)
    return {
        "staged": staged(prepared),
        "medications": meds,
        "drug_gene_rules": upsert_rules(rules, prepared, meds, position, run_ts, strict),
    }
