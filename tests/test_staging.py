"""Staging: curated rules, normalization, dedupe, summaries and the JSON envelopes."""

import json
import random

import pytest
from pyspark.sql import functions as F

from allelegate.operators import staging as S
from allelegate.plans.schemas import STAGED_COLUMNS
from allelegate.sources import curated, envelopes


def write(tmp_path, name, payload):
    path = tmp_path / name
    path.write_text(payload if isinstance(payload, str) else json.dumps(payload, indent=2))
    return str(path)


def test_curated_flow_from_collect_to_summary(spark, tmp_path):
    raw, normal = str(tmp_path / "raw"), str(tmp_path / "normal")
    envelopes.write_envelope_json(curated.curated_records(spark), raw, envelopes.collected_meta("now"), 5)
    records = envelopes.read_collected(spark, raw, lines=True)
    assert records.count() == 14
    normalized = S.normalize_records(records)
    envelopes.write_envelope_json(normalized, normal, envelopes.normalized_meta("now", raw))
    rules = envelopes.load_normalized_rules(spark, normal, lines=True)
    first = rules.where("medication_generic_name = 'clopidogrel' and phenotype = 'poor metabolizer'").first()
    assert (first.brand_name, first.gene, first.review_status, first.rule_version) == ("Plavix", "CYP2C19", "pending_review", "mvp-0.1")
    assert S.review_summary(rules).first().asDict() == {"medications": 3, "candidates": 14, "pending": 14}
    assert S.distinct_medications(rules).count() == 3 and S.pending_count(rules).first()[0] == 14
    meta = json.loads(spark.read.text(raw).first()[0])
    assert meta["collectionMode"] == "curated_static" and meta["collectorVersion"] == "mvp-0.1"


def test_curated_rules_need_approval(spark):
    assert {r.review_status for r in curated.curated_rules(spark).collect()} == {"pending_review"}
    approved = curated.curated_rules(spark, approved=True).collect()
    assert {r.review_status for r in approved} == {"approved"} and {r.rule_version for r in approved} == {"mvp-v2"}
    assert all(r.patient_summary.endswith("is not medical advice.") for r in approved)


GOOD = {
    "sourceName": " S ", "sourceType": "t", "medication": {"genericName": " Clopidogrel ", "brandName": "Plavix  X"},
    "gene": " cyp2c19", "phenotype": "Poor   Metabolizer", "rawSummary": None,
}


@pytest.mark.parametrize(
    "payload, message",
    [
        ({}, "Raw input must contain a records array."),
        ({"records": {}}, "Raw input must contain a records array."),
        ({"records": []}, "Raw input records array is empty."),
        ([GOOD], "Raw input must be a JSON object."),
        ("{nope", "not valid JSON"),
        ({"records": [GOOD, 5]}, "Raw record 2 must be an object."),
        ({"records": [{"gene": "g"}]}, "Raw record 1 is missing fields: medication, phenotype, rawSummary, sourceName, sourceType"),
        ({"records": [GOOD | {"medication": "x"}]}, "Raw record 1 medication must be an object."),
        ({"records": [GOOD | {"medication": {"genericName": "a", "brandName": ""}}]}, "Raw record 1 medication is missing brandName."),
    ],
)
def test_bad_raw_files_fail(spark, tmp_path, payload, message):
    path = write(tmp_path, "raw.json", payload)
    with pytest.raises(Exception) as failure:
        envelopes.read_collected(spark, path).collect()
    assert message in str(failure.value)


def test_lenient_read_keeps_all_records(spark, tmp_path):
    path = write(tmp_path, "raw.json", {"records": [GOOD, {"gene": None}]})
    got = {r.ord_record: r.error for r in envelopes.read_collected(spark, path, strict=False).collect()}
    assert got[1] is None and "is missing fields" in got[2] and "gene" not in got[2].split(": ")[1].split(", ")


def test_normalize_defaults(spark, tmp_path):
    path = write(tmp_path, "raw.json", {"records": [GOOD]})
    got = S.normalize_records(envelopes.read_collected(spark, path)).first()
    assert (got.genericName, got.brandName, got.drugClass, got.gene) == ("clopidogrel", "Plavix X", None, "CYP2C19")
    assert (got.phenotype, got.riskLevel, got.reviewStatus) == ("poor metabolizer", "insufficient_data", "pending_review")
    assert (got.patientSummary, got.recommendedAction) == ("Pending clinical review.", "Pending clinical review before use.")
    assert (got.sourceName, got.sourceUrl, got.evidenceNotes, got.rawSummary) == ("S", None, "", "")


def test_invalid_levels_fail_or_are_named(spark, tmp_path):
    path = write(tmp_path, "raw.json", {"records": [GOOD | {"riskLevel": "huge"}, GOOD | {"reviewStatus": "Approved "}]})
    records = envelopes.read_collected(spark, path)
    with pytest.raises(Exception, match="Invalid risk level: huge"):
        S.normalize_records(records).collect()
    lenient = S.normalize_records(records, strict=False).collect()
    assert [r.invalid for r in lenient] == ["Invalid risk level: huge", None] and lenient[1].reviewStatus == "approved"


def staged_rows(n, seed):
    rng = random.Random(seed)
    return [
        (rng.choice(["a", "b"]), f"brand{i}", None, rng.choice(["CYP2C19", "cyp2c19 "]), rng.choice(["Poor  x", "poor x", "y"]), "caution",
         "p", "c", "r", rng.choice(["CPIC", "other"]), "u", "v", rng.choice(["approved", "rejected", "pending_review"]), i)
        for i in range(n)
    ]


@pytest.mark.parametrize("aware", [False, True])
def test_dedupe_equals_a_dict(spark, aware):
    data = staged_rows(80, 5)
    df = spark.createDataFrame(data, ", ".join(f"{c} string" for c in STAGED_COLUMNS) + ", n int").repartition(3)
    want = {}
    for r in data:
        key = (r[0], " ".join(r[3].split()).upper(), " ".join(r[4].split()).lower(), r[9])
        first, kept = want.get(key, (r[13], None))
        if not (aware and kept and kept[12] == "approved" and r[12] != "approved"):
            kept = r
        want[key] = (first, kept)
    got = S.dedupe_last(df, ["n"], approval_aware=aware).collect()
    assert sorted((r.first_n, r.brand_name) for r in got) == sorted((f, k[1]) for f, k in want.values())


def test_placeholder_replaces_curated_row_unless_aware(spark):
    seed = S.staged(curated.curated_rules(spark, approved=True)).where("phenotype = 'normal function'")
    files = spark.createDataFrame([("zocor", "SLCO1B1", 0)], "d string, g string, ord_row int")
    pairs = S.candidates_from_pairs(files, F.col("d"), F.col("g"), F.lit("u"), S.medication_aliases(spark))
    union = S.union_sources([seed.withColumn("ord_row", F.lit(0)).withColumn("ord_gene", F.lit(0)), pairs])
    order = ["ord_source", "ord_row", "ord_gene"]
    assert S.dedupe_last(union, order).first().rule_version == "cpic-pair-import-v0"
    assert S.dedupe_last(union, order, approval_aware=True).first().rule_version == "mvp-v2"
