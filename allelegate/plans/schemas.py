"""Explicit schemas of the stored tables and of the staged records."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(spec: str) -> T.StructType:
    """`name:type` words; `!` marks a column that may not be null."""
    kinds = {"s": T.StringType(), "b": T.BooleanType(), "t": T.TimestampType(), "d": T.DateType()}
    fields = []
    for word in spec.split():
        name, kind = word.rstrip("!").split(":")
        fields.append(T.StructField(name, kinds[kind], not word.endswith("!")))
    return T.StructType(fields)


TABLES = {
    "users": _table("id:s! email:s! role:s! password_hash:s created_at:t! updated_at:t!"),
    "user_sessions": _table("id:s! user_id:s! token_hash:s! expires_at:t! created_at:t!"),
    "patients": _table(
        "id:s! user_id:s! first_name:s! last_name:s! date_of_birth:d created_at:t! updated_at:t!"
    ),
    "pgx_results": _table(
        "id:s! patient_id:s! gene:s! phenotype:s! genotype:s source:s! created_at:t! updated_at:t!"
    ),
    "medications": _table(
        "id:s! generic_name:s! brand_name:s drug_class:s is_active:b! created_at:t! updated_at:t!"
    ),
    "patient_medications": _table(
        "id:s! patient_id:s! medication_id:s! status:s! notes:s started_at:d stopped_at:d created_at:t! updated_at:t!"
    ),
    "drug_gene_rules": _table(
        "id:s! medication_id:s! gene:s! phenotype:s! risk_level:s! patient_summary:s! clinician_summary:s! "
        "recommended_action:s! evidence_source:s! evidence_url:s rule_version:s! review_status:s! imported_at:t "
        "created_at:t! updated_at:t!"
    ),
    "risk_results": _table(
        "id:s! patient_id:s! medication_id:s! pgx_result_id:s rule_id:s risk_level:s! patient_summary:s! "
        "clinician_summary:s recommended_action:s! created_at:t!"
    ),
}

# Unique keys of each table, besides `id`.
UNIQUE_KEYS = {
    "users": [["email"]],
    "user_sessions": [["user_id"], ["token_hash"]],
    "patients": [["user_id"]],
    "pgx_results": [["patient_id", "gene"]],
    "medications": [["generic_name"]],
    "patient_medications": [["patient_id", "medication_id"]],
    "drug_gene_rules": [["medication_id", "gene", "phenotype"]],
}

# Child table, column, parent table, what a delete of the parent does.
REFERENCES = [
    ("user_sessions", "user_id", "users", "cascade"),
    ("patients", "user_id", "users", "cascade"),
    ("pgx_results", "patient_id", "patients", "cascade"),
    ("patient_medications", "patient_id", "patients", "cascade"),
    ("patient_medications", "medication_id", "medications", "restrict"),
    ("drug_gene_rules", "medication_id", "medications", "restrict"),
    ("risk_results", "patient_id", "patients", "cascade"),
    ("risk_results", "medication_id", "medications", "restrict"),
    ("risk_results", "pgx_result_id", "pgx_results", "set_null"),
    ("risk_results", "rule_id", "drug_gene_rules", "set_null"),
]

# Staged rule, in the column order of the review file.
STAGED_COLUMNS = [
    "medication_generic_name",
    "brand_name",
    "drug_class",
    "gene",
    "phenotype",
    "risk_level",
    "patient_summary",
    "clinician_summary",
    "recommended_action",
    "evidence_source",
    "evidence_url",
    "rule_version",
    "review_status",
]

RAW_RECORD = (
    "sourceName string, sourceType string, sourceUrl string, "
    "medication struct<genericName: string, brandName: string, drugClass: string>, "
    "gene string, phenotype string, riskLevel string, rawSummary string, patientSummary string, "
    "clinicianSummary string, recommendedAction string, notes string, reviewStatus string"
)

NORMALIZED_COLUMNS = [
    "genericName",
    "brandName",
    "drugClass",
    "gene",
    "phenotype",
    "riskLevel",
    "patientSummary",
    "clinicianSummary",
    "recommendedAction",
    "sourceName",
    "sourceUrl",
    "sourceType",
    "reviewStatus",
    "evidenceNotes",
    "rawSummary",
    "ruleVersion",
]
NORMALIZED_RECORD = ", ".join(f"{c} string" for c in NORMALIZED_COLUMNS)
