"""What queries leave on disk beside their result: scratch files, and rows that are moved between tasks."""

from __future__ import annotations

import datetime as dt
import gzip

import pytest

from allelegate.operators import match as M
from allelegate.operators import staging as S
from allelegate.plans.schemas import RAW_RECORD
from allelegate.queries import sources as Q
from allelegate.sources import envelopes

LINEITEM = (
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
)


@pytest.fixture
def line_items(spark, tmp_path):
    """A folder with a table of 300 line items."""
    day = dt.datetime(2020, 1, 1)
    rows = [(n, n * 7, n % 9, n % 7, 1.0, n / 2, 0.0, n % 3 / 10, "ANR"[n % 3], "OF"[n % 2], day) for n in range(300)]
    spark.createDataFrame(rows, LINEITEM).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["collected_roundtrip", "normalized_roundtrip"])
def test_envelopes_of_a_round_trip_take_a_fraction_of_their_text(spark, line_items, tmp_path, monkeypatch, name):
    monkeypatch.setattr(Q, "scratch_path", lambda _, folder: str(tmp_path / folder))
    rules = getattr(Q, name)(spark, line_items)
    files = list((tmp_path / name.split("_")[0]).glob("part-*"))
    texts = [gzip.decompress(f.read_bytes()) if f.suffix == ".gz" else f.read_bytes() for f in files]
    assert sum(f.stat().st_size for f in files) < sum(map(len, texts)) / 5
    want = S.staged(S.to_rules(S.normalize_records(Q.branded(spark, line_items))))
    assert rules.count() == 300 and rules.exceptAll(want).isEmpty()


def test_a_compressed_file_holds_few_envelopes_and_reads_as_plain_ones(spark, tmp_path):
    record = '"sourceName": "s", "sourceType": "t", "gene": "G", "phenotype": "p", "rawSummary": "é \\\\n"'
    rows = spark.range(0, 100, 1, 2).selectExpr(
        f"from_json(concat('{{{record}, \"notes\": \"', id, '\", \"medication\": {{\"genericName\": \"a\", \"brandName\": \"b\"}}}}'), '{RAW_RECORD}') as r"
    ).select("r.*")
    for name, compression in (("plain", None), ("packed", "gzip")):
        envelopes.write_envelope_json(rows, str(tmp_path / name), {"run": "1"}, 3, compression)
    files = sorted((tmp_path / "packed").glob("part-*"))
    lines = [len(gzip.decompress(f.read_bytes()).splitlines()) for f in files]
    assert max(lines) == envelopes.ENVELOPES_PER_FILE and sum(lines) == 34
    assert [f.suffix for f in (tmp_path / "plain").glob("part-*")] == [".txt", ".txt"]
    plain, packed = (envelopes.read_collected(spark, str(tmp_path / n), lines=True) for n in ("plain", "packed"))
    fields = [c for c in plain.columns if not c.startswith("ord_")] + ["ord_record"]
    order = ["ord_file", "ord_block", "ord_envelope", "ord_record"]
    assert [r.notes for r in packed.orderBy(*order).collect()] == [str(n) for n in range(100)]
    assert plain.select(fields).exceptAll(packed.select(fields)).isEmpty() and packed.count() == 100


@pytest.fixture
def matching(spark):
    """Requests, patients, medications, rules and results with null, repeated and unknown keys."""
    ids = (None, 1, 2, 3, 4, 9)
    pairs = [(p, m) for p in ids for m in ids] + [(1, 1), (1, 1), (None, None)]
    requests = spark.createDataFrame([(n, p, m) for n, (p, m) in enumerate(pairs)], "n int, patient_id long, medication_id long")
    patients = spark.createDataFrame([(1,), (2,), (3,), (3,), (None,), (4,)], "id long")
    meds = spark.createDataFrame(
        [(1, "one", "b", "c", True), (2, "two", None, "c", True), (2, "twin", None, "c", True), (3, "three", "b", "c", True), (4, "off", "b", "c", False), (None, "x", "b", "c", True)],
        "id long, generic_name string, brand_name string, drug_class string, is_active boolean")
    rules = spark.createDataFrame(
        [(1, 1, "g", "p", "caution", "approved"), (2, 1, "G ", "q", "low_risk", "approved"), (3, 1, "h", "p", "potential_concern", "approved"),
         (3, 1, "h", "p", "potential_concern", "approved"), (4, 2, "h", None, "caution", "approved"), (5, 2, None, "p", "caution", "approved"),
         (6, 3, " ", "p", "caution", "approved"), (7, 1, "k", "p", "caution", "rejected"), (8, None, "g", "p", "caution", "approved")],
        "id long, medication_id long, gene string, phenotype string, risk_level string, review_status string")
    pgx = spark.createDataFrame(
        [(1, 1, "g", "p", 2), (2, 1, "G", "P", 1), (2, 1, "G", "P", 1), (3, 1, "h", "p", 1), (4, 2, "g", "q", 1), (5, 3, "z", "p", 1), (6, 3, "h", None, 1),
         (7, None, "g", "p", 1), (None, 2, "h", "x", 1), (8, 9, "g", "p", 1)],
        "id long, patient_id long, gene string, phenotype string, updated_at int")
    return requests, patients, meds, rules, pgx


def test_rows_and_arrays_decide_alike_on_odd_keys(matching):
    by_rows, by_arrays = (sorted(M.match_risk(*matching, plan=p).collect(), key=repr) for p in ("rows", "array"))
    assert by_rows == by_arrays
    first = [r for r in by_rows if (r.patient_id, r.medication_id) == (1, 1)]
    assert [[(m.rule_id, m.pgx_result_id) for m in r.matches] for r in first] == [[(3, 3), (3, 3), (1, 2)]] * 3
    assert sorted(r.branch for r in by_rows if r.patient_id == 3 and r.medication_id == 2) == ["matched"] * 4
    assert {r.patient_id: (r.branch, r.missing_genes) for r in by_rows if r.medication_id == 1} == {
        None: ("missing_ids", []), 1: ("matched", []), 2: ("matched", []), 3: ("missing_genes", ["g"]),
        4: ("no_results", ["g", "h"]), 9: ("unknown_patient", []),
    }


def test_the_rows_plan_moves_a_request_to_its_patient_and_its_medication_only(spark, matching):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = M.match_risk(*matching, plan="rows")._jdf.queryExecution().executedPlan().initialPlan()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved: list[list[str]] = []

    def walk(node) -> None:
        if node.nodeName() == "Exchange":
            moved.append([node.output().apply(i).name() for i in range(node.output().size())])
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    pairs = [m for m in moved if "patient_id" in m and "medication_id" in m]
    assert sorted(pairs, key=len) == [
        ["n", "patient_id", "medication_id"],
        ["n", "patient_id", "medication_id", "_leads", "_known", "_pairs", "_ids"],
    ]
    assert sum("n" in m for m in moved) == 2
