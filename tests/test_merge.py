"""Merges against row-by-row loops."""

import random

import pytest
from pyspark.sql import functions as F

from allelegate.operators import consolidate as C
from allelegate.operators import merge as G
from allelegate.operators.audit import check_unique
from allelegate.plans.schemas import STAGED_COLUMNS, TABLES

RUN = "2026-01-01 00:00:00"
OLD = "2020-01-01 00:00:00"


def frame(spark, table, rows):
    df = spark.createDataFrame(rows, ", ".join(f"{f.name} string" for f in TABLES[table].fields))
    return df.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[table].fields])


@pytest.mark.parametrize("seed", [1, 2])
def test_gated_upsert_equals_a_loop(spark, seed):
    rng = random.Random(seed)
    states = ["approved", "pending_review", "rejected"]
    store = {}
    meds = [(f"id{m}", f"med{m}", None, "old", "true", OLD, OLD) for m in range(2)]
    rules = []
    for m in range(2):
        for p in ["x", "y", "z"]:
            if rng.random() < 0.7:
                status = rng.choice(states)
                store[(f"med{m}", "G", p)] = ("stored", status)
                rules.append((f"r{m}{p}", f"id{m}", "G", p, "caution", "stored", "c", "a", "e", None, "v1.0", status, None, OLD, OLD))
    incoming = []
    for n in range(60):
        row = (f"med{rng.randrange(3)}", rng.choice([None, f"b{n}"]), rng.choice([None, f"c{n}"]), rng.choice(["G", " g "]),
               rng.choice(["X", "y ", "z", "w"]), "low_risk", f"text{n}", "c", "a", "e", "u", "v", rng.choice(states), n)
        incoming.append(row)
        key = (row[0], "G", row[4].strip().lower())
        if key not in store or store[key][1] != "approved" or row[12] == "approved":
            store[key] = (row[6], row[12])
    staged = spark.createDataFrame(incoming, ", ".join(f"{c} string" for c in STAGED_COLUMNS) + ", n int").repartition(3)
    medications = G.upsert_medications(frame(spark, "medications", meds), staged, ["n"], F.lit(RUN).cast("timestamp"))
    merged = G.upsert_rules(frame(spark, "drug_gene_rules", rules), staged, medications, ["n"], F.lit(RUN).cast("timestamp"))
    names = {r.id: r.generic_name for r in medications.collect()}
    got = {(names[r.medication_id], r.gene, r.phenotype): (r.patient_summary, r.review_status) for r in merged.collect()}
    assert got == store
    untouched = [r for r in merged.collect() if r.patient_summary == "stored"]
    assert all(str(r.updated_at) == OLD and r.imported_at is None for r in untouched)
    by_name = {r.generic_name: r for r in medications.collect()}
    for m in range(2):
        brands = [r[1] for r in incoming if r[0] == f"med{m}" and r[1]]
        assert by_name[f"med{m}"].brand_name == brands[-1] and by_name[f"med{m}"].id == f"id{m}"
        assert str(by_name[f"med{m}"].updated_at) == OLD and by_name[f"med{m}"].is_active


def test_same_run_gives_the_same_rows(spark):
    staged = spark.createDataFrame([("new", "b", "c", "g", "p", "caution", "p", "c", "a", "e", "u", "v", "approved", 0)],
                                   ", ".join(f"{c} string" for c in STAGED_COLUMNS) + ", n int")
    run = lambda: G.upsert_medications(frame(spark, "medications", []), staged, ["n"], F.lit(RUN).cast("timestamp")).collect()
    assert run() == run()


def test_result_upsert_codes_and_values(spark):
    stored = frame(spark, "pgx_results", [("x1", "p1", "SLCO1B1", "old", "*1/*1", "lab", OLD, OLD)])
    patients = spark.createDataFrame([("p1",)], "id string")
    rows = [("p1", " SLCO1B1 ", "decreased function", " *5/*5 ", 1), ("p1", "slco1b1", "poor function", " ", 2), ("p1", "TPMT", "  ", None, 3),
            (" ", "A", "b", None, 4), ("p9", "A", "b", None, 5), ("p1", "SLCO1B1", "poor function", None, 6)]
    checked = G.checked_results(spark.createDataFrame(rows, "patient_id string, gene string, phenotype string, genotype string, n int"), patients)
    assert {r.n: r.outcome for r in checked.collect()} == {
        1: "saved", 2: "saved", 3: "Provide both gene and phenotype.", 4: "Provide a patientId.", 5: "Patient was not found.", 6: "saved"}
    got = {r.gene: r for r in G.upsert_pgx(stored, checked, ["n"], F.lit(RUN).cast("timestamp")).collect()}
    assert set(got) == {"SLCO1B1", "slco1b1"}
    assert (got["SLCO1B1"].id, got["SLCO1B1"].phenotype, got["SLCO1B1"].genotype, got["SLCO1B1"].source) == ("x1", "poor function", None, "lab")
    assert got["slco1b1"].source == "manual_entry"


def test_sessions_keep_one_live_row_per_user(spark):
    sessions = spark.createDataFrame(
        [("s1", "u1", "h1", "2026-01-01 05:00:00", OLD), ("s2", "u2", "h2", "2025-12-31 23:00:00", OLD), ("s3", "u3", "h3", "2026-01-01 01:00:00", OLD)],
        "id string, user_id string, token_hash string, expires_at string, created_at string",
    ).withColumns({c: F.col(c).cast("timestamp") for c in ("expires_at", "created_at")})
    logins = spark.createDataFrame(
        [("u1", "a", "2025-12-31 13:00:00", 1), ("u1", "b", "2025-12-31 14:00:00", 2), ("u4", "c", "2025-12-31 11:00:00", 3)],
        "user_id string, token string, ts string, event_id int",
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.user_id: r for r in G.upsert_sessions(sessions, logins, F.lit(RUN).cast("timestamp")).collect()}
    assert set(got) == {"u1", "u3"} and got["u1"].id == "s1" and str(got["u1"].expires_at) == "2026-01-01 02:00:00"


def store(spark):
    return {
        "users": spark.createDataFrame([("u1",), ("u2",)], "id string"),
        "patients": spark.createDataFrame([("b", "u1", 1), ("a", "u1", 1), ("c", "u1", 5), ("z", "u2", 9)], "id string, user_id string, created_at int"),
        "pgx_results": spark.createDataFrame(
            [("1", "a", "CYP2C19", "poor", None, "m", 9, 9), ("2", "b", "CYP2C19", "old", None, "m", 1, 1), ("3", "c", "cyp2c19", "new", None, "m", 2, 2),
             ("4", "b", "TPMT", "x", None, "m", 1, 3), ("5", "z", "TPMT", "z", None, "m", 1, 1)],
            "id string, patient_id string, gene string, phenotype string, genotype string, source string, created_at int, updated_at int"),
        "patient_medications": spark.createDataFrame(
            [("l1", "a", "m1", "active", "mine", None, "e1", 1, 5), ("l2", "b", "m1", "past", "yours", "s2", "e2", 2, 3), ("l3", "c", "m1", "past", "late", "s3", None, 2, 4)],
            "id string, patient_id string, medication_id string, status string, notes string, started_at string, stopped_at string, created_at int, updated_at int"),
        "risk_results": spark.createDataFrame(
            [("h1", "b", "m1", "2", None), ("h2", "a", "m1", "1", None), ("h3", "z", "m1", "5", None)],
            "id string, patient_id string, medication_id string, pgx_result_id string, rule_id string"),
    }


def test_consolidation(spark):
    out = C.consolidate_patients(store(spark))
    assert {r.id for r in out["patients"].collect()} == {"a", "z"}
    pgx = {(r.patient_id, r.gene): (r.phenotype, r.updated_at) for r in out["pgx_results"].collect()}
    # The newest duplicate spells the gene in lower case, so it does not meet the stored row.
    assert pgx == {("a", "CYP2C19"): ("poor", 9), ("a", "cyp2c19"): ("new", 2), ("a", "TPMT"): ("x", 3), ("z", "TPMT"): ("z", 1)}
    item = out["patient_medications"].first()
    assert (item.id, item.patient_id, item.status, item.notes) == ("l1", "a", "past", "mine\n[Merged record] late")
    assert (item.started_at, item.stopped_at, item.updated_at) == ("s3", "e1", 5)
    history = {r.id: (r.patient_id, r.pgx_result_id) for r in out["risk_results"].collect()}
    assert history == {"h1": ("a", None), "h2": ("a", "1"), "h3": ("z", "5")}
    assert check_unique(out["patients"], ["user_id"]).count() == 0


def test_deletes_follow_references(spark):
    tables = store(spark)
    out = C.cascade_delete(tables, "users", spark.createDataFrame([("u1",)], "id string"))
    assert [r.id for r in out["patients"].collect()] == ["z"] and [r.id for r in out["pgx_results"].collect()] == ["5"]
    assert out["patient_medications"].count() == 0 and [r.id for r in out["risk_results"].collect()] == ["h3"]
    out = C.cascade_delete(tables, "pgx_results", spark.createDataFrame([("1",)], "id string"))
    assert {r.id: r.pgx_result_id for r in out["risk_results"].collect()} == {"h1": "2", "h2": None, "h3": "5"}
    tables["medications"] = spark.createDataFrame([("m1",), ("m2",)], "id string")
    out = C.cascade_delete(tables, "medications", spark.createDataFrame([("m1",), ("m2",)], "id string"))
    assert [r.id for r in out["medications"].collect()] == ["m1"] and [r.id for r in out["restricted"].collect()] == ["m1"]


def test_invalid_rules_name_no_medication(spark):
    good = ("new", "b", "c", "g", "p", "caution", "p", "c", "a", "e", "u", "v", "approved", 0)
    bad = ("odd", *good[1:5], "nonsense", *good[6:])
    staged = spark.createDataFrame([good, bad], ", ".join(f"{c} string" for c in STAGED_COLUMNS) + ", n int")
    at = F.lit(RUN).cast("timestamp")
    merge = lambda strict: G.upsert_medications(frame(spark, "medications", []), staged, ["n"], at, strict)
    assert [r.generic_name for r in merge(False).collect()] == ["new"]
    with pytest.raises(Exception, match="Invalid risk level: nonsense"):
        merge(True).collect()


def test_texts_come_back_from_their_pack(spark):
    odd = ["", " ", "a", "\u0001", "\u0002", "\u0002b", "\u0002n", "\u0002e", "x\u0002", "\u0002\u0002bn", "\u00e9\n\t\"", None]
    data = [(a, b, c) for a in odd for b in odd for c in odd]
    frame = spark.createDataFrame(data, "a string, b string, c string").select("*", G.packed(["a", "b", "c"]).alias("p"))
    back = frame.select("a", "b", "c", "p", *[x.alias(f"_{n}") for n, x in G.unpacked("p", ["a", "b", "c"]).items()]).collect()
    assert all((r.a, r.b, r.c) == (r._a, r._b, r._c) for r in back)
    assert len({r.p for r in back}) == len(data)


def test_rules_move_as_one_text_and_keep_odd_values(spark):
    texts = ["", "\u0002b", "\u0002n", "a,b\u0001", None]
    staged = spark.createDataFrame(
        [("med\u0002", "b", "c", " g", f"P {i}", "caution", t, "c", "a", None, t, "v", state, float(n))
         for i, t in enumerate(texts) for n, state in ((1, "approved"), (2, "rejected"), (0, "approved"), (float("nan"), "pending_review"))]
        + [(None, "b", "c", "g", "p", "caution", "t", "c", "a", None, None, "v", "approved", 9.0), ("med\u0002", "b", "c", "g", "late", "caution", "1", "c", "a", None, None, "v", "rejected", None),
           ("med\u0002", "b", "c", "g", "late", "caution", "2", "c", "a", None, None, "v", "pending_review", 0.0)],
        ", ".join(f"{c} string" for c in STAGED_COLUMNS) + ", n double",
    ).repartition(5)
    at = F.lit(RUN).cast("timestamp")
    medications = G.upsert_medications(frame(spark, "medications", []), staged, ["n"], at)
    merged = G.upsert_rules(frame(spark, "drug_gene_rules", []), staged, medications, ["n"], at)
    got = {r.phenotype: (r.gene, r.patient_summary, r.evidence_url, r.evidence_source, r.review_status) for r in merged.collect()}
    assert got == {f"p {i}": ("G", t, t, None, "approved") for i, t in enumerate(texts)} | {"late": ("G", "2", None, None, "pending_review")}
    lines = merged._jdf.queryExecution().optimizedPlan().toString().splitlines()
    whole = next(line for line in lines if "Aggregate" in line and "_approved" in line)
    assert "max_by(" not in whole and "array_join(" in whole + "".join(lines[lines.index(whole) :])
    joined = lines[next(i for i, line in enumerate(lines) if "Join FullOuter" in line) :]
    assert not any("split_part" in line and "patient_summary" in line for line in joined)


def test_last_rows_keep_values_of_other_types(spark):
    rows = [("k", 1, "approved", "x", 5, 1), ("k", 1, "rejected", "y", 6, 2), ("k", None, "rejected", None, None, 1), (None, 1, "rejected", "z", 7, 1)]
    df = spark.createDataFrame(rows, "k string, j int, review_status string, t string, v int, n int")
    got = G.gated_last(df, ["k", "j"], ["v", "review_status", "t", "n"], ["n"])
    assert got.columns == ["k", "j", "v", "review_status", "t", "n"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [("k", 1, 5, "approved", "x", 1), ("k", None, None, "rejected", None, 1), (None, 1, 7, "rejected", "z", 1)], key=repr)
