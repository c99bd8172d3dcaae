"""Stored rows as result records: the field names that callers of the service see."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stored column to record field.
MEDICATION = {"id": "id", "generic_name": "genericName", "brand_name": "brandName", "drug_class": "drugClass"}
RESULT = {"id": "id", "gene": "gene", "phenotype": "phenotype", "genotype": "genotype", "source": "source"}
MATCH = {
    "gene": "gene",
    "phenotype": "phenotype",
    "risk_level": "riskLevel",
    "patient_summary": "patientSummary",
    "clinician_summary": "clinicianSummary",
    "recommended_action": "recommendedAction",
    "evidence_source": "evidenceSource",
    "rule_id": "ruleId",
    "pgx_result_id": "pgxResultId",
}
LIST_ITEM = {
    "id": "id",
    "medication_id": "medicationId",
    "generic_name": "genericName",
    "brand_name": "brandName",
    "drug_class": "drugClass",
    "status": "status",
    "notes": "notes",
    "created_at": "createdAt",
    "updated_at": "updatedAt",
    "safety": "safety",
    "assessment": "assessment",
}


def shape(fields: dict[str, str], of: Column | None = None) -> Column:
    """A record of the named columns, or of the fields of struct `of`."""
    return F.struct(*[(F.col(c) if of is None else of[c]).alias(name) for c, name in fields.items()])


def shape_matches(matches: str = "matches") -> Column:
    return F.transform(matches, lambda m: shape(MATCH, m))
