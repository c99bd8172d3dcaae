"""Constraint checks that Parquet does not make, and the coverage audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelegate.functions.text import in_domain, rule_key_label
from allelegate.plans.domains import REQUIRED_TABLES


def check_domains(df: DataFrame, domains: dict[str, list[str]]) -> DataFrame:
    """Rows with a value outside its domain, with the columns at fault."""
    faults = [F.when(~in_domain(c, allowed), F.lit(c)) for c, allowed in domains.items()]
    return df.withColumn("faults", F.array_compact(F.array(*faults))).where(F.size("faults") > 0)


def check_required(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a null in a column that may not be null."""
    faults = [F.when(F.col(c).isNull(), F.lit(c)) for c in columns]
    return df.withColumn("faults", F.array_compact(F.array(*faults))).where(F.size("faults") > 0)


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count; null keys never collide."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.where(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def check_references(child: DataFrame, column: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Child rows whose reference names no parent; null references are fine."""
    keys = parent.select(F.col(parent_key).alias("_parent"))
    return child.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_parent"), "left_anti")


def missing_tables(existing: DataFrame, required: list[str] = REQUIRED_TABLES) -> DataFrame:
    """Required table names without a row in `existing` (column `name`), in audit order."""
    spark = existing.sparkSession
    wanted = spark.createDataFrame(list(enumerate(required)), "ord int, name string")
    return wanted.join(existing.select("name"), "name", "left_anti").orderBy("ord")


def existing_tables(spark, database: str | None = None) -> DataFrame:
    """Names in the session catalog."""
    names = [(t.name,) for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(names, "name string")


def in_required_set(rows: DataFrame, required: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows whose keys are in the required set (columns named as in `keys`)."""
    on = [c == F.col(f"_r_{k}") for k, c in keys.items()]
    return rows.join(required.select(*[F.col(k).alias(f"_r_{k}") for k in keys]).distinct(), on, "left_semi")


def rules_with_medication(rules: DataFrame, meds: DataFrame) -> DataFrame:
    """Rule keys in the case that the audit compares, whatever the review state."""
    names = meds.select(F.col("id").alias("medication_id"), F.lower("generic_name").alias("generic_name"))
    return rules.join(names, "medication_id").select(
        "generic_name", F.upper("gene").alias("gene"), F.lower("phenotype").alias("phenotype")
    )


def missing_members(required: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return required.join(present.select(*keys).distinct(), keys, "left_anti")


def medication_faults(required: DataFrame, meds: DataFrame) -> DataFrame:
    """One message per fault of a required medication (generic_name, brand_name)."""
    # Of stored names that differ only in case, the last one counts.
    stored = (
        meds.groupBy(F.lower("generic_name").alias("_key"))
        .agg(F.max_by(F.struct("id", "brand_name", "is_active"), "generic_name").alias("m"))
    )
    label = F.concat("generic_name", F.lit(" / "), "brand_name")
    row = F.col("m")
    said = lambda test, text: F.when(test, F.concat(F.lit(text), label))
    faults = F.when(
        row.isNull(), F.array(F.concat(F.lit("Missing MVP medication: "), label))
    ).otherwise(
        F.array_compact(
            F.array(
                said(row["id"].isNull(), "Medication is missing id: "),
                said(
                    F.lower(F.coalesce(row["brand_name"], F.lit(""))) != F.lower("brand_name"),
                    "Medication has unexpected brand name: ",
                ),
                said(~F.coalesce(row["is_active"], F.lit(False)), "Medication is not active: "),
            )
        )
    )
    return required.join(stored, F.col("generic_name") == F.col("_key"), "left").select(
        F.lit("failure").alias("kind"), F.explode(faults).alias("message"), row.isNull().alias("absent")
    )


def audit_coverage(
    required_meds: DataFrame, required_rules: DataFrame, meds: DataFrame, rules: DataFrame, existing: DataFrame, go_on: bool = False
) -> DataFrame:
    """Passed and failed checks as (kind, message) rows, and one row `ok` that says whether none failed.

    `existing` names the tables that there are; missing ones end the audit, or, with `go_on`, only the checks that
    read them.  The counts behind the pass rows are single aggregates, so nothing is gathered.
    """
    spark = meds.sparkSession
    # at most as many names as there are required tables
    gaps = [r.name for r in missing_tables(existing).collect()]
    without = spark.createDataFrame([("failure", f"Missing required tables: {', '.join(gaps)}")], "kind string, message string")
    if gaps and not go_on:
        return without.union(spark.createDataFrame([("ok", "false")], without.schema))
    med_faults = medication_faults(required_meds, meds)
    keys = ["generic_name", "gene", "phenotype"]
    have = rules_with_medication(rules, meds).distinct().withColumn("_have", F.lit(True))
    met = required_rules.join(have, keys, "left")
    rule_faults = met.where("_have is null").select(
        F.lit("failure").alias("kind"),
        F.concat(F.lit("Missing MVP drug-gene rule: "), rule_key_label(*keys)).alias("message"),
    )
    tables_passed = spark.range(1).select(F.lit("passed").alias("kind"), F.lit("Required tables exist.").alias("message"))
    meds_passed = med_faults.agg(F.count_if("absent").alias("n")).where("n = 0").select(
        F.lit("passed").alias("kind"), F.lit("MVP medications exist with active rows and IDs.").alias("message")
    )
    rules_passed = met.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_have").isNull()).alias("m")).where(
        "m = 0"
    ).select(
        F.lit("passed").alias("kind"),
        F.concat(
            F.lit("Required MVP drug-gene rules exist ("), F.col("n").cast("string"), F.lit(" phenotype rules).")
        ).alias("message"),
    )
    parts = [without if gaps else tables_passed]
    if "medications" not in gaps:
        parts += [meds_passed, med_faults.select("kind", "message")]
    if not {"medications", "drug_gene_rules"} & set(gaps):
        parts += [rules_passed, rule_faults]
    found = reduce(DataFrame.unionByName, parts)
    ok = found.agg((F.count_if(F.col("kind") == "failure") == 0).cast("string").alias("message"))
    return found.unionByName(ok.select(F.lit("ok").alias("kind"), "message"))
