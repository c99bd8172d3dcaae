"""Risk matching: every branch, its texts, and both plans against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from allelegate.operators import match as M
from allelegate.plans import domains as D

MEDS = "id string, generic_name string, brand_name string, drug_class string, is_active boolean"
RULES = (
    "id string, medication_id string, gene string, phenotype string, risk_level string, patient_summary string, "
    "clinician_summary string, recommended_action string, evidence_source string, review_status string"
)
PGX = "id string, patient_id string, gene string, phenotype string, created_at int"


def rule(id, med, gene, phenotype, level, status="approved"):
    return (id, med, gene, phenotype, level, f"p-{id}", f"c-{id}", f"a-{id}", "CPIC", status)


def tables_of(spark, requests, patients, meds, rules, pgx):
    return (
        spark.createDataFrame(requests, "patient_id string, medication_id string"),
        spark.createDataFrame([(p,) for p in patients], "id string"),
        spark.createDataFrame([(m, f"g-{m}", None, None, a) for m, a in meds], MEDS),
        spark.createDataFrame(rules, RULES),
        spark.createDataFrame(pgx, PGX),
    )


def decide(spark, requests, patients, meds, rules, pgx, plan="array"):
    return M.match_risk(*tables_of(spark, requests, patients, meds, rules, pgx), plan)


def one(spark, request, *args, plan="array"):
    return decide(spark, [request], *args, plan=plan).first()


PAT, MED = ["p1"], [("m1", True), ("off", False)]
POOR = rule("r1", "m1", "CYP2C19", "poor metabolizer", "potential_concern")


@pytest.mark.parametrize("plan", ["array", "rows"])
@pytest.mark.parametrize(
    "request_, rules, pgx, branch, message, genes",
    [
        (("  ", ""), [POOR], [], "missing_ids", D.MISSING_IDS, []),
        ((None, "m1"), [POOR], [], "missing_ids", D.MISSING_IDS, []),
        (("p1", "off"), [POOR], [], "unsupported", D.UNSUPPORTED, []),
        (("nobody", "none"), [POOR], [], "unsupported", D.UNSUPPORTED, []),
        (("nobody", "m1"), [POOR], [], "unknown_patient", D.PATIENT_NOT_FOUND, []),
        (("p1", "m1"), [rule("r1", "m1", "CYP2C19", "x", "caution", "pending_review")], [], "no_rules", D.NO_RULES, []),
        (("p1", "m1"), [POOR], [], "no_results", D.NO_RESULTS, ["CYP2C19"]),
        (("p1", "m1"), [POOR], [("x1", "p1", "SLCO1B1", "normal function", 1)], "missing_genes",
         "Missing CYP2C19 PGx result for this medication.", ["CYP2C19"]),
        (("p1", "m1"), [POOR, rule("r0", "m1", "SLCO1B1", "poor function", "caution")],
         [("x1", "p1", "TPMT", "y", 1)], "missing_genes",
         "Missing SLCO1B1, CYP2C19 PGx results for this medication.", ["SLCO1B1", "CYP2C19"]),
        (("p1", "m1"), [POOR], [("x1", "p1", "CYP2C19", "normal metabolizer", 1)], "no_match", D.NO_MATCH, []),
        (("p1", "m1"), [POOR], [("x1", "p1", "CYP2C19", "poor  metabolizer", 1)], "no_match", D.NO_MATCH, []),
        ((" p1 ", " m1 "), [POOR], [("x1", "p1", " cyp2c19", "Poor Metabolizer ", 1)], "matched", D.MATCHED, []),
    ],
)
def test_branches(spark, plan, request_, rules, pgx, branch, message, genes):
    got = one(spark, request_, PAT, MED, rules, pgx, plan=plan)
    assert (got.branch, got.message, got.missing_genes) == (branch, message, genes)
    supported = branch not in ("missing_ids", "unsupported", "unknown_patient")
    assert got.supported == supported and got.matched == (branch == "matched")
    assert got.status == ("matched" if branch == "matched" else "insufficient_data" if supported else None)


def test_stored_text_of_a_missing_gene_is_the_message(spark):
    out = decide(spark, [("p1", "m1")], PAT, MED, [POOR], [("x", "p1", "TPMT", "y", 1)])
    shown, kept = out.first(), M.risk_history_rows(out, "run", F.current_timestamp(), ["patient_id", "medication_id"]).first()
    assert shown.clinician_summary == D.INSUFFICIENT_CLINICIAN
    assert kept.clinician_summary == "Missing CYP2C19 PGx result for this medication."
    assert (kept.pgx_result_id, kept.rule_id, kept.risk_level) == (None, None, "insufficient_data")


def test_two_matches_rank_by_risk(spark):
    rules = [rule("r1", "m1", "CYP2C19", "poor metabolizer", "low_risk"), rule("r2", "m1", "SLCO1B1", "poor function", "caution")]
    pgx = [("x1", "p1", "CYP2C19", "poor metabolizer", 1), ("x2", "p1", "SLCO1B1", "poor function", 1)]
    out = decide(spark, [("p1", "m1")], PAT, MED, rules, pgx)
    got = out.first()
    assert (got.risk_level, got.gene, got.rule_id, got.pgx_result_id) == ("caution", "SLCO1B1", "r2", "x2")
    assert [m.rule_id for m in got.matches] == ["r2", "r1"] and got.patient_summary == "p-r2"
    kept = M.risk_history_rows(out, "run", F.current_timestamp(), ["patient_id", "medication_id"]).collect()
    assert {r.rule_id for r in kept} == {"r1", "r2"} and len({r.id for r in kept}) == 2


def test_unsupported_leaves_no_history(spark):
    out = decide(spark, [("", ""), ("p1", "off"), ("no", "m1")], PAT, MED, [POOR], [])
    assert M.risk_history_rows(out, "run", F.current_timestamp(), ["patient_id", "medication_id"]).count() == 0


def test_history_of_equal_and_padded_requests(spark):
    """Two requests for one pair have different ids; ids are those that the decision is about."""
    pgx = [("x1", "p1", "CYP2C19", "poor metabolizer", 1)]
    for plan in ("array", "rows"):
        out = decide(spark, [(" p1 ", "m1"), ("p1", " m1")], PAT, MED, [POOR], pgx, plan=plan)
        kept = M.risk_history_rows(out, "run", F.current_timestamp(), ["patient_id", "medication_id"]).collect()
        assert {(r.patient_id, r.medication_id) for r in kept} == {("p1", "m1")}
        assert len({r.id for r in kept}) == len(kept) == 2


def test_stream_sees_results_stored_between_batches(spark, tmp_path):
    from allelegate.sources.tables import read_risk_results
    from allelegate.streaming.match import keep_history

    requests, patients, meds, rules, none = tables_of(spark, [("p1", "m1")], PAT, MED, [POOR], [])
    _, _, _, _, stored = tables_of(spark, [("p1", "m1")], PAT, MED, [POOR], [("x1", "p1", "CYP2C19", "poor metabolizer", 1)])
    now = {"pgx": none}
    landed, path, log = (str(tmp_path / n) for n in ("landed", "history", "log"))
    for results in (none, stored):
        now["pgx"] = results
        requests.write.mode("append").parquet(landed)
        stream = spark.readStream.schema(requests.schema).parquet(landed)
        keep_history(stream, lambda: (patients, meds, rules, now["pgx"]), path, log, ["patient_id"]).awaitTermination()
    rows = {r.run_id: r for r in read_risk_results(spark, path).collect()}
    assert [rows[k].rule_id for k in sorted(rows)] == [None, "r1"]
    assert len({r.created_at for r in rows.values()}) == 2


def brute(request, patients, meds, rules, pgx):
    norm = lambda v: (v or "").strip().lower()
    p, m = (request[0] or "").strip(), (request[1] or "").strip()
    if not p or not m:
        return ("missing_ids", [], [])
    if not dict(meds).get(m):
        return ("unsupported", [], [])
    if p not in patients:
        return ("unknown_patient", [], [])
    mine = sorted(r for r in rules if r[1] == m and r[9] == "approved")
    if not mine:
        return ("no_rules", [], [])
    need, seen = [], set()
    for r in mine:
        if norm(r[2]) and norm(r[2]) not in seen:
            seen.add(norm(r[2]))
            need.append(r[2])
    results = sorted((x for x in pgx if x[1] == p), key=lambda x: (x[4], x[0]))
    if not results:
        return ("no_results", need, [])
    have = {norm(x[2]) for x in results}
    gaps = [g for g in need if norm(g) not in have]
    if gaps:
        return ("missing_genes", gaps, [])
    rank = {"potential_concern": 4, "caution": 3, "low_risk": 2, "insufficient_data": 1}
    hits = []
    for r in mine:
        x = next((x for x in results if norm(x[2]) in seen and norm(x[2]) == norm(r[2]) and norm(x[3]) == norm(r[3])), None)
        if x:
            hits.append((-rank[r[4]], r[0], x[0]))
    return ("matched", [], [h[1:] for h in sorted(hits)]) if hits else ("no_match", [], [])


@pytest.mark.parametrize("plan", ["array", "rows"])
def test_random_data_matches_a_loop(spark, plan):
    rng = random.Random(11)
    genes, phenos = ["CYP2C19", "cyp2c19 ", "SLCO1B1", "TPMT", " "], ["poor", "Poor ", "normal", ""]
    patients = [f"p{i}" for i in range(12)]
    meds = [(f"m{i}", i % 5 != 0) for i in range(10)]
    levels = D.RISK_LEVELS
    rules = [
        rule(f"r{i:03d}", f"m{rng.randrange(10)}", rng.choice(genes), rng.choice(phenos), rng.choice(levels),
             rng.choice(["approved", "approved", "rejected", "pending_review"]))
        for i in range(50)
    ]
    pgx = [(f"x{i:03d}", f"p{rng.randrange(10)}", rng.choice(genes), rng.choice(phenos), rng.randrange(3)) for i in range(60)]
    # A third of all requests ask for one medication, another third come from one patient.
    requests = [("p1", f"m{rng.randrange(12)}") for _ in range(60)] + [(f"p{rng.randrange(14)}", "m1") for _ in range(60)]
    requests += [(rng.choice([f" p{rng.randrange(14)}", None, " "]), rng.choice([f"m{rng.randrange(12)}", ""])) for _ in range(60)]
    got = decide(spark, requests, patients, meds, rules, pgx, plan).collect()
    assert len(got) == len(requests)
    for r in got:
        hits = [(m.rule_id, m.pgx_result_id) for m in (r.matches or [])]
        assert (r.branch, r.missing_genes, hits) == brute((r.patient_id, r.medication_id), patients, meds, rules, pgx)


def test_array_plan_has_no_python_and_no_cartesian(spark):
    out = decide(spark, [("p1", "m1")], PAT, MED, [POOR], [], plan="array")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
