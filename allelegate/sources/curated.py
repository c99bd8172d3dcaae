"""The curated starter rules, staged and in collected shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelegate.functions.text import add_disclaimer
from allelegate.operators.staging import medication_aliases
from allelegate.plans import domains as D


def _specs(spark: SparkSession) -> DataFrame:
    rows = [(i, *spec) for i, spec in enumerate(D.CURATED)]
    specs = spark.createDataFrame(
        rows,
        "ord_record int, generic string, gene string, phenotype string, risk_level string, patient string, "
        "clinician string, action string",
    )
    named = medication_aliases(spark).where("alias = generic").drop("alias")
    return specs.join(named, "generic")


def curated_rules(spark: SparkSession, approved: bool = False) -> DataFrame:
    """Staged starter rules; approved only when a reviewer says so."""
    return _specs(spark).select(
        F.col("generic").alias("medication_generic_name"),
        F.col("brand").alias("brand_name"),
        F.col("class").alias("drug_class"),
        "gene",
        "phenotype",
        "risk_level",
        add_disclaimer("patient").alias("patient_summary"),
        add_disclaimer("clinician").alias("clinician_summary"),
        F.coalesce("action", F.lit(D.DEFAULT_ACTION)).alias("recommended_action"),
        F.lit(D.PAIR_SOURCE).alias("evidence_source"),
        F.lit(D.GUIDELINE_URL).alias("evidence_url"),
        F.lit(D.CURATED_VERSION).alias("rule_version"),
        F.lit(D.APPROVED if approved else D.PENDING).alias("review_status"),
        "ord_record",
    )


def curated_records(spark: SparkSession, source_name: str = "MVP curated CPIC review starter") -> DataFrame:
    """The same rules as collected records; `source_name` labels the collector."""
    return _specs(spark).select(
        F.lit(source_name).alias("sourceName"),
        F.lit("curated_static").alias("sourceType"),
        F.lit(D.GUIDELINE_URL).alias("sourceUrl"),
        F.struct(
            F.col("generic").alias("genericName"), F.col("brand").alias("brandName"), F.col("class").alias("drugClass")
        ).alias("medication"),
        "gene",
        "phenotype",
        F.col("risk_level").alias("riskLevel"),
        add_disclaimer("clinician").alias("rawSummary"),
        add_disclaimer("patient").alias("patientSummary"),
        add_disclaimer("clinician").alias("clinicianSummary"),
        F.coalesce("action", F.lit(D.DEFAULT_ACTION)).alias("recommendedAction"),
        F.lit(D.CURATED_NOTES).alias("notes"),
        "ord_record",
    )
