"""Work that is cut by bytes, and plans that move wide rows no more often than needed."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from allelegate.functions.text import IMPORT_SPACE, norm_gene, norm_key, norm_text
from allelegate.operators import consolidate as C
from allelegate.operators import lists as L
from allelegate.operators import match as M
from allelegate.operators import staging as S
from allelegate.plans import session
from allelegate.plans.schemas import RAW_RECORD, STAGED_COLUMNS
from allelegate.sources import envelopes
from allelegate.streaming import profiles as P


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_wide_rows_are_cut_into_small_tasks_and_given_sizes_come_back(spark):
    names = [*session.TASK_BYTES, session.SHUFFLE]
    session.tune(spark, wide_rows=False)
    given = [spark.conf.get(n, None) for n in names]
    session.tune(spark)
    for name, most in session.TASK_BYTES.items():
        assert session._bytes(spark, spark.conf.get(name)) <= most
    assert int(spark.conf.get(session.SHUFFLE)) >= session.SHUFFLE_PARTITIONS
    session.tune(spark, wide_rows=False)
    assert [spark.conf.get(n, None) for n in names] == given
    session.tune(spark)


def test_dedupe_carries_a_key_once(spark):
    rules = spark.createDataFrame([tuple("x" for _ in STAGED_COLUMNS) + (n,) for n in (2, 1)], [*STAGED_COLUMNS, "n"])
    kept = S.dedupe_last(rules, ["n"])
    carried = plan(kept).split("max_by(")[1].split("_last")[0]
    assert "medication_generic_name" not in carried and "evidence_source" not in carried
    row = kept.first()
    assert (row.medication_generic_name, row.evidence_source, row.first_n) == ("x", "x", 1)


ITEM = "id string, patient_id long, medication_id long, status string, notes string, started_at date, stopped_at date, created_at date, updated_at int"


def test_lists_are_joined_once_and_null_or_repeated_keys_stay(spark):
    rows = [
        ("a", 1, 7, "active", "old", 1), ("b", 2, 7, "past", "new", 2), ("c", 3, 7, "considering", "newer", 3),
        ("d", 1, None, "active", None, 1), ("e", 2, None, "past", "x", 2), ("f", None, 7, "active", None, 1),
        ("g", None, None, "active", None, 1), ("h", 3, 8, "past", None, 1), ("i", 1, 7, "active", "twin", 1),
        (None, 4, 9, "active", None, 1),
    ]
    items = spark.createDataFrame([(i, p, m, s, n, None, None, None, u) for i, p, m, s, n, u in rows], ITEM)
    mapping = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 1), (2, 4, 4)], "user_id long, from_id long, kept_id long")
    merged = C.merge_list(items, mapping)
    assert plan(merged).count("Join ") == 1
    got = sorted((r.patient_id or 0, r.medication_id or 0, r.id if len(r.id) == 1 else "made", r.status, r.notes or "") for r in merged.collect())
    mark = "\n[Merged record] "
    assert got == sorted([
        (1, 7, "a", "considering", f"old{mark}newer"), (1, 7, "i", "considering", f"twin{mark}newer"),
        (1, 0, "d", "active", ""), (1, 0, "made", "past", "x"), (0, 7, "f", "active", ""), (0, 0, "g", "active", ""),
        (1, 8, "made", "past", ""), (4, 9, "made", "active", ""),
    ])


def test_rows_of_pairs_and_rules_are_filtered_where_they_arise(spark):
    requests = spark.createDataFrame([(p, m) for p in (1, 2, 3) for m in (1, 2)], "patient_id long, medication_id long")
    rules = spark.createDataFrame(
        [(1, 1, "g", "p", "caution", "approved"), (2, 1, "G ", "q", "low_risk", "approved"), (3, 2, "h", "p", "caution", "approved"),
         (4, 2, None, "p", "caution", "approved"), (5, 2, "g", None, "caution", "approved"), (5, 1, "g", "p", "caution", "approved")],
        "id long, medication_id long, gene string, phenotype string, risk_level string, review_status string")
    pgx = spark.createDataFrame(
        [(1, 1, "g", "p", 2), (2, 1, "G", "P", 1), (3, 2, "g", "q", 1), (4, 2, "h", "x", 1), (5, None, "g", "p", 1), (6, 3, "g", None, 1), (7, 3, None, "p", 1)],
        "id long, patient_id long, gene string, phenotype string, updated_at int")
    found = M.match_first(requests, rules, pgx)
    got = sorted((r.patient_id, r.medication_id, r.rule_id, r.pgx_result_id) for r in found.collect())
    old = M.request_pairs(requests).join(M.keyed_rules(rules).where("gene_key <> ''"), "medication_id").join(
        M.first_results(pgx), ["patient_id", "gene_key", "phenotype_key"])
    assert found.columns == old.columns
    assert got == sorted((r.patient_id, r.medication_id, r.rule_id, r.pgx_result_id) for r in old.collect())
    assert {(1, 1, 1, 2), (1, 1, 5, 2), (2, 1, 2, 3)} <= set(got)
    lines = plan(found).splitlines()
    last = next(i for i, line in enumerate(lines) if "Join " in line)
    assert "medication_id" in lines[last] and "exists(" in "".join(lines[: last + 1])


def test_profiles_send_what_rules_use(spark):
    meds = spark.createDataFrame([(1, "m", "b", "c", True), (2, "n", "b", "c", True)], "id long, generic_name string, brand_name string, drug_class string, is_active boolean")
    rules = spark.createDataFrame([(1, 1, "g", "p", "caution", "approved")], "id long, medication_id long, gene string, phenotype string, risk_level string, review_status string")
    patients = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    pgx = spark.createDataFrame(
        [(1, 1, "g", "p", 1), (2, 1, "g", "q", 1), (3, 1, "h", "p", 1), (4, 2, "h", "p", 1)], "id long, patient_id long, gene string, phenotype string, updated_at int")
    rows = P.patient_rows(patients, pgx)
    got = {r._patient_id: (r._genes, r._found) for r in P.used_facts(rows, M.medication_profiles(meds, rules)).collect()}
    assert got == {"1": (["g"], {"g\u0001p": 1}), "2": ([], {}), "3": (None, None)}
    none = P.used_facts(rows, M.medication_profiles(meds.limit(0), rules))
    assert {r._patient_id: r._genes for r in none.collect()} == {"1": [], "2": [], "3": None}


def test_records_are_parsed_once(spark, tmp_path):
    path = str(tmp_path / "records")
    record = ("p", "x", "u", ("a", "b", None), "g", "p", None, "r", None, None, None, None, None)
    envelopes.write_envelope_json(spark.createDataFrame([record], RAW_RECORD), path, {}, 5)
    for read in (envelopes.read_collected, envelopes.read_normalized):
        assert plan(read(spark, path, lines=True)).count("from_json(") <= 2
    assert envelopes.read_collected(spark, path, lines=True).first().medication.genericName == "a"


def test_plain_text_is_not_matched_against_all_white_space(spark):
    texts = ["", " ", "a", " a b ", "a  b", "\ta\n\nB", "\xa0É\u2003 x", "A\x1fb", "~! Q", "  z", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = frame.select(norm_text("t").alias("x"), norm_key("t").alias("k"), norm_gene("t").alias("g")).collect()
    want = [" ".join(re.split(f"[{IMPORT_SPACE}]+", (t or "").strip(IMPORT_SPACE))) for t in texts]
    assert [(r.x, r.k, r.g) for r in got] == [(w, w.lower(), w.upper()) for w in want]
    assert "RLIKE" in plan(frame.select(norm_text("t")))


def test_a_delete_reads_and_shuffles_a_table_once(spark):
    patients = spark.createDataFrame([(1, 1), (2, 2), (None, 1)], "id int, user_id int")
    lists = spark.createDataFrame([("a", 1, 7), ("b", 2, 7), (None, 1, 7)], "id string, patient_id int, medication_id int")
    tables = {"patients": patients, "patient_medications": lists}
    out = C.cascade_delete(tables, "patients", spark.createDataFrame([(1,)], "id int"))
    left = out["patient_medications"]
    assert plan(left).count("Join") == 1
    assert {r.id for r in left.collect()} == {"b", None} and {r.id for r in out["patients"].collect()} == {2, None}


def test_a_split_carries_no_key_beside_its_row(spark):
    saved = spark.createDataFrame([(1, "a"), (1, "A "), (2, "x"), (None, "a")], "patient_id int, gene string")
    rows = [(1, " A", 1), (1, "b", 2), (1, "a", 3), (2, None, 4), (None, "a", 5), (1, "a", 3)]
    incoming = spark.createDataFrame(rows, "patient_id int, gene string, n int")
    out = L.split_new_and_known(incoming, saved, L.gene_key())
    assert out.columns == ["patient_id", "gene", "n", "known"]
    assert sorted((r.n, r.known) for r in out.collect()) == [(1, True), (2, False), (3, True), (3, True), (4, False), (5, False)]
    left = plan(out).split("Join ")[1].split("Aggregate")[0]
    assert "AS _gene" not in left and "AS _patient" not in left


def test_supported_rows_of_history_are_joined_without_the_others(spark):
    requests = spark.createDataFrame([(1, 1), (None, 1), (1, None), (9, 1), (1, 9), (2, 1)], "patient_id long, medication_id long")
    meds = spark.createDataFrame([(1, "m", "b", "c", True)], "id long, generic_name string, brand_name string, drug_class string, is_active boolean")
    rules = spark.createDataFrame([(1, 1, "g", "p", "caution", "approved")], "id long, medication_id long, gene string, phenotype string, risk_level string, review_status string")
    pgx = spark.createDataFrame([(1, 1, "g", "p", 1)], "id long, patient_id long, gene string, phenotype string, updated_at int")
    for how in ("array", "rows"):
        decided = M.match_risk(requests, spark.createDataFrame([(1,), (2,)], "id long"), meds, rules, pgx, how)
        assert sorted((r.branch, r.supported) for r in decided.collect()) == [
            ("matched", True), ("missing_ids", False), ("missing_ids", False), ("no_results", True), ("unknown_patient", False), ("unsupported", False)]
    kept = M.risk_history_rows(M.match_risk(requests, spark.createDataFrame([(1,), (2,)], "id long"), meds, rules, pgx), "r", F.current_timestamp(), ["patient_id"])
    filters = [line for line in plan(kept).splitlines() if "Filter " in line]
    assert filters and not any("CASE WHEN" in line for line in filters)
