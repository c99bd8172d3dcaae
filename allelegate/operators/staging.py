"""From source records to one staged rule per key, ready for review or merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allelegate.functions.text import (
    blank_to_null,
    default_if_blank,
    default_phenotype,
    norm_gene,
    norm_key,
    norm_text,
    rule_key_label,
    split_genes,
)
from allelegate.plans import domains as D
from allelegate.plans.schemas import NORMALIZED_COLUMNS, STAGED_COLUMNS


def medication_aliases(spark: SparkSession) -> DataFrame:
    """The fixed alias list: six rows."""
    return spark.createDataFrame(D.MEDICATION_ALIASES, "alias string, generic string, brand string, class string")


def map_aliases(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Inner lookup of `column` by import key; adds `generic`, `brand` and `class`.

    `aliases` has unique `alias` keys.  Rows without an alias are dropped.
    """
    keyed = df.withColumn("_key", norm_key(column))
    return keyed.join(aliases.withColumnRenamed("alias", "_key"), "_key").drop("_key")


def known_phenotype(column: Column | str) -> Column:
    """Canonical phenotype by import key, null when unknown."""
    known = [F.lit(p) for ps in D.PHENOTYPES.values() for p in ps for _ in range(2)]
    return F.try_element_at(F.create_map(*known), norm_key(column))


def supported_gene(gene: Column | str) -> Column:
    return (F.col(gene) if isinstance(gene, str) else gene).isin(D.SUPPORTED_GENES)


def candidates_from_cells(
    cells: DataFrame, drug: Column, gene: Column, phenotype: Column, source_name: Column, source_url: Column,
    aliases: DataFrame,
) -> DataFrame:
    """Staged placeholders from the cells of a delimited file or a table.

    Only mapped rows stay.  Nothing the source says becomes a recommendation.
    """
    rows = cells.withColumns(
        {"_drug": drug, "_gene": gene, "_phenotype": known_phenotype(phenotype), "_source": source_name, "_url": source_url}
    ).where("_gene <> '' and _phenotype is not null")
    mapped = map_aliases(rows, "_drug", aliases)
    kept = [c for c in cells.columns if c.startswith("ord_")]
    return mapped.select(
        F.col("generic").alias("medication_generic_name"),
        F.col("brand").alias("brand_name"),
        F.col("class").alias("drug_class"),
        norm_gene("_gene").alias("gene"),
        F.col("_phenotype").alias("phenotype"),
        F.lit("insufficient_data").alias("risk_level"),
        F.lit(D.PENDING_SUMMARY).alias("patient_summary"),
        F.lit(D.SOURCE_CLINICIAN_SUMMARY).alias("clinician_summary"),
        F.lit(D.PENDING_ACTION).alias("recommended_action"),
        F.col("_source").alias("evidence_source"),
        F.col("_url").alias("evidence_url"),
        F.lit(D.SOURCE_IMPORT_VERSION).alias("rule_version"),
        F.lit(D.PENDING).alias("review_status"),
        *kept,
    )


def candidates_from_pairs(rows: DataFrame, drug: Column, genes: Column, source_url: Column, aliases: DataFrame) -> DataFrame:
    """Staged placeholders from gene-drug pairs: one row per supported gene of a cell."""
    cells = rows.withColumns({"_drug": drug, "_genes": genes, "_url": source_url}).where("_genes <> ''")
    kept = [c for c in rows.columns if c.startswith("ord_")]
    exploded = map_aliases(cells, "_drug", aliases).select(
        "generic", "brand", "class", "_url", *kept, F.posexplode(split_genes("_genes")).alias("ord_gene", "gene")
    )
    return exploded.where(supported_gene("gene")).select(
        F.col("generic").alias("medication_generic_name"),
        F.col("brand").alias("brand_name"),
        F.col("class").alias("drug_class"),
        "gene",
        default_phenotype("gene").alias("phenotype"),
        F.lit("insufficient_data").alias("risk_level"),
        F.lit(D.PENDING_SUMMARY).alias("patient_summary"),
        F.lit(D.PAIR_CLINICIAN_SUMMARY).alias("clinician_summary"),
        F.lit(D.PENDING_ACTION).alias("recommended_action"),
        F.lit(D.PAIR_SOURCE).alias("evidence_source"),
        F.col("_url").alias("evidence_url"),
        F.lit(D.PAIR_IMPORT_VERSION).alias("rule_version"),
        F.lit(D.PENDING).alias("review_status"),
        *kept,
        "ord_gene",
    )


def normalize_records(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Raw source records to normalized ones; columns that are not part of a record stay.

    `strict` fails the job at the first level or state that is not allowed;
    otherwise such rows come out with a reason in `invalid`.
    """
    med = F.col("medication")
    extra = [c for c in raw.columns if c.startswith("ord_")]
    leveled = raw.withColumns(
        {
            "riskLevel": F.coalesce(blank_to_null(norm_key("riskLevel")), F.lit("insufficient_data")),
            "reviewStatus": F.coalesce(blank_to_null(norm_key("reviewStatus")), F.lit(D.PENDING)),
        }
    )
    leveled = checked(leveled, "riskLevel", "reviewStatus", strict)
    return leveled.select(
        norm_key(med["genericName"]).alias("genericName"),
        norm_text(med["brandName"]).alias("brandName"),
        blank_to_null(norm_text(med["drugClass"])).alias("drugClass"),
        norm_gene("gene").alias("gene"),
        norm_key("phenotype").alias("phenotype"),
        "riskLevel",
        default_if_blank("patientSummary", D.PENDING_SUMMARY).alias("patientSummary"),
        default_if_blank("clinicianSummary", D.PENDING_SUMMARY).alias("clinicianSummary"),
        default_if_blank("recommendedAction", D.PENDING_ACTION).alias("recommendedAction"),
        norm_text("sourceName").alias("sourceName"),
        blank_to_null(norm_text("sourceUrl")).alias("sourceUrl"),
        norm_text("sourceType").alias("sourceType"),
        "reviewStatus",
        norm_text("notes").alias("evidenceNotes"),
        norm_text("rawSummary").alias("rawSummary"),
        F.lit(D.COLLECTOR_VERSION).alias("ruleVersion"),
        *extra,
        *([] if strict else ["invalid"]),
    )


def to_rules(normalized: DataFrame, strict: bool = True, restrict_supported: bool = False) -> DataFrame:
    """Normalized records to staged rules; on request only those of the supported medications."""
    extra = [c for c in normalized.columns if c not in NORMALIZED_COLUMNS]
    rules = normalized.select(
        norm_key("genericName").alias("medication_generic_name"),
        norm_text("brandName").alias("brand_name"),
        blank_to_null(norm_text("drugClass")).alias("drug_class"),
        norm_gene("gene").alias("gene"),
        norm_key("phenotype").alias("phenotype"),
        norm_key("riskLevel").alias("risk_level"),
        norm_text("patientSummary").alias("patient_summary"),
        norm_text("clinicianSummary").alias("clinician_summary"),
        norm_text("recommendedAction").alias("recommended_action"),
        norm_text("sourceName").alias("evidence_source"),
        norm_text("sourceUrl").alias("evidence_url"),
        default_if_blank("ruleVersion", D.COLLECTOR_VERSION).alias("rule_version"),
        F.coalesce(blank_to_null(norm_key("reviewStatus")), F.lit(D.PENDING)).alias("review_status"),
        *extra,
    )
    if restrict_supported:
        rules = rules.where(F.col("medication_generic_name").isin(sorted({m[1] for m in D.MEDICATION_ALIASES})))
    return checked(rules, "risk_level", "review_status", strict)


def invalid_reason(risk_level: str, review_status: str) -> Column:
    """Why a rule may not be stored, or null."""
    risk, status = F.col(risk_level), F.col(review_status)
    return F.when(
        ~F.coalesce(risk.isin(D.RISK_LEVELS), F.lit(False)),
        F.concat(F.lit("Invalid risk level: "), F.coalesce(risk, F.lit(""))),
    ).when(
        ~F.coalesce(status.isin(D.REVIEW_STATUSES), F.lit(False)),
        F.concat(F.lit("Invalid review status: "), F.coalesce(status, F.lit(""))),
    )


def checked(df: DataFrame, risk_level: str, review_status: str, strict: bool) -> DataFrame:
    """Fail on a level or state that is not allowed, or name it in `invalid`.

    The failure sits in the review status, which every merge, summary and
    review file reads.  As a filter it would be pushed below the normalization
    and repeat it.
    """
    reason = invalid_reason(risk_level, review_status)
    if not strict:
        return df.withColumn("invalid", reason)
    stop = F.raise_error(reason).cast("string")
    return df.withColumn(review_status, F.when(reason.isNull(), F.col(review_status)).otherwise(stop))


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """Sources one after another; `ord_source` keeps the given order."""
    tagged = [df.withColumn("ord_source", F.lit(i)) for i, df in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def dedupe_key() -> dict[str, Column]:
    return {
        "_generic": F.col("medication_generic_name"),
        "_gene": norm_gene("gene"),
        "_phenotype": norm_key("phenotype"),
        "_evidence": F.col("evidence_source"),
    }


def dedupe_last(rules: DataFrame, order: list[str], approval_aware: bool = False) -> DataFrame:
    """One rule per (medication, gene, phenotype, evidence): last value, first position.

    Both are aggregates that combine before the shuffle, so a key with very
    many copies sends one row per task.  The position comes out as `first_*`
    columns, one per order column.  With `approval_aware` a later unapproved
    copy does not replace an approved one.
    """
    place = F.struct(*order)
    rank = F.struct((F.col("review_status") == D.APPROVED).alias("a"), *order) if approval_aware else place
    names = [c for c in rules.columns if c not in order]
    # What a key holds as it is comes from the key, and need not be carried twice.
    own = {"medication_generic_name": "_generic", "evidence_source": "_evidence"}
    payload = [c for c in names if c not in own]
    kept = (
        rules.withColumns(dedupe_key())
        .groupBy("_generic", "_gene", "_phenotype", "_evidence")
        .agg(F.max_by(F.struct(*payload), rank).alias("_last"), F.min(place).alias("_first"))
    )
    return kept.select(
        *[F.col(own.get(c, f"_last.{c}")).alias(c) for c in names],
        *[F.col(f"_first.{c}").alias(f"first_{c}") for c in order],
    )


def distinct_medications(rules: DataFrame) -> DataFrame:
    return rules.select("medication_generic_name").distinct().orderBy("medication_generic_name")


def distinct_candidates(rules: DataFrame) -> DataFrame:
    label = rule_key_label("medication_generic_name", norm_gene("gene"), norm_key("phenotype"))
    return rules.select(label.alias("candidate")).distinct().orderBy("candidate")


def pending_count(rules: DataFrame) -> DataFrame:
    """Pending rows, copies included."""
    return rules.agg(F.count_if(F.col("review_status") == D.PENDING).alias("pending"))


def review_summary(rules: DataFrame) -> DataFrame:
    """Counts of a dry run: medications, distinct candidates, pending rows."""
    label = rule_key_label("medication_generic_name", norm_gene("gene"), norm_key("phenotype"))
    # Grouping first keeps the distinct counts on keys instead of on every row.
    keys = rules.groupBy(F.col("medication_generic_name").alias("m"), label.alias("c")).agg(
        F.count_if(F.col("review_status") == D.PENDING).alias("p")
    )
    return keys.agg(
        F.countDistinct("m").alias("medications"),
        F.countDistinct("c").alias("candidates"),
        F.coalesce(F.sum("p"), F.lit(0)).alias("pending"),
    )


def staged(rules: DataFrame) -> DataFrame:
    return rules.select(*STAGED_COLUMNS)
