"""Medication search, gene profiles and phenotype choices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelegate.functions.text import trim_all
from allelegate.operators.search_index import SearchIndex, like_pattern, matches
from allelegate.plans import domains as D
from allelegate.plans.session import scratch_path
from allelegate.plans.skew import with_position

def name_contains(meds: DataFrame, query: str) -> DataFrame:
    """Medications whose generic or brand name contains the query text."""
    pattern = F.lit(query)
    rows = meds.withColumn("_pattern", like_pattern(pattern))
    return rows.where(matches()).drop("_pattern")


def search_medications(meds: DataFrame, queries: DataFrame, top: int = 10, index: SearchIndex | None = None) -> DataFrame:
    """First `top` active medications by name for each distinct query text.

    A query without hits, or without text, gives one row with a message.  `index` is a stored index of `meds`
    (`SearchIndex.built`); without it one is made for these searches.
    """
    index = index or SearchIndex.built(meds, scratch_path(meds.sparkSession, "search_index"))
    asked = queries.select(trim_all("query").alias("query")).distinct()
    found = index.search(asked.where("query <> ''"), top)
    return (
        asked.join(found, "query", "left")
        .withColumn("supported", F.col("id").isNotNull())
        .withColumn(
            "message",
            F.when(F.col("query") == "", D.EMPTY_QUERY).when(F.col("id").isNull(), D.UNSUPPORTED),
        )
        .select("query", "supported", "message", "position", "id", "generic_name", "brand_name", "drug_class")
    )


def results_by_gene(pgx: DataFrame) -> DataFrame:
    """Position of each result in its patient's profile, by gene."""
    return with_position(pgx, ["patient_id"], ["gene", "id"])


def gene_profile(requests: DataFrame, patients: DataFrame, pgx: DataFrame) -> DataFrame:
    """Profiles of the requested patients: one row per result, in order by `position`.

    A blank or unknown patient, and one without results, gives one row.
    """
    text_id = dict(requests.dtypes)["patient_id"] == "string"
    who = F.nullif(trim_all("patient_id"), F.lit("")) if text_id else F.col("patient_id")
    asked = requests.select(who.alias("patient_id")).distinct()
    known = patients.select(F.col("id").alias("_known"))
    # only what is asked for is numbered
    wanted = pgx.join(asked.select(F.col("patient_id").alias("_asked")), F.col("patient_id") == F.col("_asked"), "left_semi")
    rows = results_by_gene(wanted).select(
        F.col("patient_id").alias("_owner"), F.col("id").alias("pgx_result_id"), "gene", "phenotype", "genotype", "position"
    )
    found = asked.join(known, F.col("patient_id") == F.col("_known"), "left")
    return found.join(rows, F.col("_known") == F.col("_owner"), "left").select(
        "patient_id",
        F.col("_known").isNotNull().alias("supported"),
        F.when(F.col("patient_id").isNull(), D.MISSING_PATIENT_ID)
        .when(F.col("_known").isNull(), D.PATIENT_NOT_FOUND)
        .alias("message"),
        "position",
        "pgx_result_id",
        "gene",
        "phenotype",
        "genotype",
    )


def phenotype_options(pgx: DataFrame, domain: DataFrame) -> DataFrame:
    """Results with the phenotype an edit starts from.

    `domain` has gene, idx, phenotype.  A saved phenotype that the gene allows
    stays; else the gene's first one is taken, and a gene without a domain
    keeps what it has.
    """
    first = domain.groupBy("gene").agg(F.min_by("phenotype", "idx").alias("_first"))
    allowed = domain.select("gene", "phenotype").distinct().withColumn("allowed", F.lit(True))
    return (
        pgx.join(first, "gene", "left")
        .join(allowed, ["gene", "phenotype"], "left")
        .withColumn("allowed", F.coalesce("allowed", F.lit(False)))
        .withColumn("choice", F.when(F.col("allowed"), F.col("phenotype")).otherwise(F.coalesce("_first", "phenotype")))
        .drop("_first")
    )


