"""Fixed values.

Every value in this module is a fixed text, list or table that results must
carry as written; nothing here is logic.
"""

from __future__ import annotations

# States and levels.
PENDING = "pending_review"
APPROVED = "approved"
REJECTED = "rejected"
REVIEW_STATUSES = [PENDING, APPROVED, REJECTED]
RISK_LEVELS = ["low_risk", "caution", "potential_concern", "insufficient_data"]
LIST_STATUSES = ["active", "past", "considering"]
USER_ROLES = ["patient", "clinician", "admin"]
SUPPORTED_GENES = ["CYP2C19", "SLCO1B1"]

# Versions and labels of staged data.
COLLECTOR_VERSION = "mvp-0.1"
CURATED_VERSION = "mvp-v2"
SOURCE_IMPORT_VERSION = "source-import-v0"
PAIR_IMPORT_VERSION = "cpic-pair-import-v0"
PAIR_FILE_MARK = "cpic_gene-drug_pairs"
PAIR_SOURCE = "CPIC"
GUIDELINE_URL = "https://cpicpgx.org/guidelines/"
MANUAL_SOURCE = "manual_entry"

# Default and placeholder texts.
PENDING_SUMMARY = "Pending clinical review."
PENDING_ACTION = "Pending clinical review before use."
SOURCE_CLINICIAN_SUMMARY = "Imported source candidate pending clinical review."
PAIR_CLINICIAN_SUMMARY = "CPIC drug-gene pair candidate imported for manual review."
DEFAULT_ACTION = "Review this result with a clinician before making medication changes."
DISCLAIMER = " This information is for educational MVP purposes only and is not medical advice."
CURATED_NOTES = "Curated MVP starter candidate for review; not clinical approval. Not medical advice."
COLLECTED_NOTES = (
    "Conservative MVP collector output for review. Records are not clinically approved recommendations."
)
NORMALIZED_NOTE = "Normalized records are review material and default to pending_review."

# Risk outcome texts.
MISSING_IDS = "Provide both patientId and medicationId."
UNSUPPORTED = "This medication is not supported in the MVP yet."
PATIENT_NOT_FOUND = "Patient was not found."
NO_RULES = "No approved drug-gene rules found for this medication."
NO_RESULTS = "No PGx data found. Please add your genetic result before checking medication risk."
NO_MATCH = "No matching drug-gene rule was found for this medication and your saved PGx results."
MATCHED = "Medication risk result found."
NO_RESULTS_PATIENT = "No pharmacogenetic results are on file for this patient yet."
NO_RESULTS_CLINICIAN = (
    "Medication risk cannot be evaluated until the patient has at least one saved PGx result."
)
NO_RESULTS_ACTION = "Add a gene and phenotype result before checking medication risk."
INSUFFICIENT_PATIENT = (
    "There is not enough matching genetic information on file to assess this medication yet."
)
INSUFFICIENT_CLINICIAN = "No approved drug-gene rule matched the patient's available PGx results."
INSUFFICIENT_ACTION = DEFAULT_ACTION

# Texts of result entry, search and list changes.
MISSING_PATIENT_ID = "Provide a patientId."
MISSING_FIELDS = "Provide both gene and phenotype."
EMPTY_QUERY = "Enter a medication name to search."
LIST_ADD_INVALID = "Patient and medication are required."
LIST_ADD_UNKNOWN = "The medication was not found."
LIST_ADDED = "Medication added."
LIST_DUPLICATE = "This medication is already in your list."
LIST_UPDATE_INVALID = "Choose a valid status and keep notes under 500 characters."
LIST_NOT_FOUND = "Medication list item was not found."
LIST_UPDATED = "Medication updated."
LIST_REMOVE_INVALID = "A valid medication list item is required."
LIST_REMOVED = "Medication removed."

# What is said of safety before any is evaluated.
SAFETY_STATUS = "not_evaluated"
SAFETY_SOURCE_TYPE = "unavailable"
SAFETY_DOSAGE = "Not evaluated from a verified source."
ASSESSMENT_LEVEL = "unknown"
ASSESSMENT_LABEL = "Not evaluated"
ASSESSMENT_CONFIDENCE = "insufficient_data"
ASSESSMENT_FACTOR = (
    "VERIFIED_SAFETY_DATA_UNAVAILABLE",
    "Verified, versioned medication safety data is not available",
)

# Alias, generic name, brand name, drug class.
MEDICATION_ALIASES = [
    ("clopidogrel", "clopidogrel", "Plavix", "antiplatelet"),
    ("plavix", "clopidogrel", "Plavix", "antiplatelet"),
    ("citalopram", "citalopram", "Celexa", "antidepressant"),
    ("celexa", "citalopram", "Celexa", "antidepressant"),
    ("simvastatin", "simvastatin", "Zocor", "statin"),
    ("zocor", "simvastatin", "Zocor", "statin"),
]

# Phenotypes in display order, per gene.
PHENOTYPES = {
    "CYP2C19": [
        "poor metabolizer",
        "intermediate metabolizer",
        "normal metabolizer",
        "rapid metabolizer",
        "ultrarapid metabolizer",
    ],
    "SLCO1B1": [
        "normal function",
        "possible decreased function",
        "decreased function",
        "poor function",
    ],
}

# Header aliases of delimited files and pair workbooks.
DRUG_HEADERS = ["drug", "drug name", "chemical", "generic_name", "medication"]
GENE_HEADERS = ["gene", "gene symbol", "gene_symbol"]
PHENOTYPE_HEADERS = ["phenotype", "metabolizer status", "function"]
PAIR_DRUG_HEADERS = ["drug", "drug(s)"]
PAIR_GENE_HEADERS = ["genes", "gene"]

# Keys that a record must have.
RAW_REQUIRED = ["gene", "medication", "phenotype", "rawSummary", "sourceName", "sourceType"]
NORMALIZED_REQUIRED = [
    "brandName",
    "clinicianSummary",
    "gene",
    "genericName",
    "patientSummary",
    "phenotype",
    "recommendedAction",
    "reviewStatus",
    "riskLevel",
    "sourceName",
    "sourceType",
]

# Tables a complete store has, in audit order.
REQUIRED_TABLES = [
    "users",
    "medications",
    "drug_gene_rules",
    "patients",
    "patient_medications",
    "user_sessions",
    "pgx_results",
    "risk_results",
]

# The curated starter rules.  Generic name, gene, phenotype, risk
# level, patient summary, clinician summary, action (None: DEFAULT_ACTION).
CURATED = [
    ("clopidogrel", "CYP2C19", "poor metabolizer", "potential_concern",
     "Your CYP2C19 result suggests your body may activate clopidogrel less than expected.",
     "CYP2C19 poor metabolizer status may reduce clopidogrel activation and antiplatelet response.", None),
    ("clopidogrel", "CYP2C19", "intermediate metabolizer", "caution",
     "Your CYP2C19 result suggests your body may activate clopidogrel somewhat less than expected.",
     "CYP2C19 intermediate metabolizer status may reduce clopidogrel activation compared with normal "
     "metabolizer status.", None),
    ("clopidogrel", "CYP2C19", "normal metabolizer", "low_risk",
     "Your CYP2C19 result does not currently suggest a higher concern for how your body activates clopidogrel.",
     "CYP2C19 normal metabolizer status is generally associated with expected clopidogrel activation.", None),
    ("clopidogrel", "CYP2C19", "rapid metabolizer", "low_risk",
     "Your CYP2C19 result does not currently suggest a higher concern for how your body activates clopidogrel.",
     "CYP2C19 rapid metabolizer status is generally associated with adequate clopidogrel activation.", None),
    ("clopidogrel", "CYP2C19", "ultrarapid metabolizer", "low_risk",
     "Your CYP2C19 result does not currently suggest a higher concern for how your body activates clopidogrel.",
     "CYP2C19 ultrarapid metabolizer status is generally associated with adequate clopidogrel activation.", None),
    ("citalopram", "CYP2C19", "poor metabolizer", "potential_concern",
     "Your CYP2C19 result suggests your body may process citalopram more slowly than expected.",
     "CYP2C19 poor metabolizer status may increase citalopram exposure.", None),
    ("citalopram", "CYP2C19", "intermediate metabolizer", "caution",
     "Your CYP2C19 result suggests your body may process citalopram somewhat differently than expected.",
     "CYP2C19 intermediate metabolizer status may alter citalopram exposure.", None),
    ("citalopram", "CYP2C19", "normal metabolizer", "low_risk",
     "Your CYP2C19 result does not currently suggest a higher concern for how your body processes citalopram.",
     "CYP2C19 normal metabolizer status is generally associated with expected citalopram exposure.", None),
    ("citalopram", "CYP2C19", "rapid metabolizer", "caution",
     "Your CYP2C19 result suggests your body may process citalopram more quickly than expected.",
     "CYP2C19 rapid metabolizer status may reduce citalopram exposure and treatment response in some people.",
     None),
    ("citalopram", "CYP2C19", "ultrarapid metabolizer", "caution",
     "Your CYP2C19 result suggests your body may process citalopram more quickly than expected.",
     "CYP2C19 ultrarapid metabolizer status may reduce citalopram exposure and treatment response in some people.",
     None),
    ("simvastatin", "SLCO1B1", "normal function", "low_risk",
     "Your SLCO1B1 result does not show a major PGx-related concern for simvastatin in this MVP.",
     "SLCO1B1 normal function is not expected to increase simvastatin-associated muscle symptom risk in this "
     "simplified MVP rule set.",
     "Continue to review medication decisions with a clinician."),
    ("simvastatin", "SLCO1B1", "possible decreased function", "caution",
     "Your SLCO1B1 result may increase the chance of muscle-related side effects with simvastatin.",
     "SLCO1B1 possible decreased function may increase simvastatin-associated muscle symptom risk.", None),
    ("simvastatin", "SLCO1B1", "decreased function", "caution",
     "Your SLCO1B1 result may increase the chance of muscle-related side effects with simvastatin.",
     "SLCO1B1 decreased function may increase simvastatin-associated muscle symptom risk.", None),
    ("simvastatin", "SLCO1B1", "poor function", "potential_concern",
     "Your SLCO1B1 result may indicate a higher chance of muscle-related side effects with simvastatin.",
     "SLCO1B1 poor function may increase simvastatin-associated muscle symptom risk.", None),
]
