"""Tables in buckets and stored profiles: what is read and written follows the batch, and batches may run again."""

import os

import pytest
from pyspark.sql import functions as F

from allelegate.operators import merge as G
from allelegate.operators.match import match_risk
from allelegate.plans.schemas import TABLES
from allelegate.sources.buckets import BucketTable
from allelegate.sources.tables import read_risk_results
from allelegate.streaming.apply import apply_batch, apply_stream
from allelegate.streaming.profiles import Profiles
from test_match import MED, PAT, POOR, tables_of

SCHEMA = "patient_id string, gene string, phenotype string, genotype string, outcome string, n int"


def results(spark, rows):
    return spark.createDataFrame([(p, g, f, None, "saved", n) for p, g, f, n in rows], SCHEMA)


def merged(stored, batch):
    return G.upsert_pgx(stored, batch, ["n"], F.lit("2026-01-01").cast("timestamp"))


def plain(df):
    return sorted((r["patient_id"], r["gene"], r["phenotype"]) for r in df.collect())


def files(root):
    return sorted(os.path.relpath(os.path.join(d, n), root) for d, _, names in os.walk(root) for n in names if n.endswith(".parquet"))


@pytest.fixture
def table(spark, tmp_path):
    found = BucketTable(spark, str(tmp_path), "pgx_results", "patient_id", 16)
    found.write(merged(spark.createDataFrame([], TABLES["pgx_results"]), results(spark, [(f"p{i}", "G", "old", i) for i in range(200)])), "-start")
    return found


def test_files_follow_the_batch(spark, table, tmp_path):
    before = files(tmp_path)
    touched = apply_batch(results(spark, [("p7", "G", "new", 1), ("p7", "H", "x", 2)]), merged, table, "0000000000")
    assert len(touched) == 1
    new = [f for f in files(tmp_path) if f not in before]
    assert len([f for f in new if "/data/" in f]) == 1 and len(new) == 2
    assert plain(table.read()) == sorted([*((f"p{i}", "G", "new" if i == 7 else "old") for i in range(200)), ("p7", "H", "x")])
    assert len(table.read(touched).inputFiles()) == 1


def test_a_batch_that_runs_again_gives_the_same_table(spark, table, tmp_path):
    batches = [results(spark, [(f"p{i}", "G", f"v{b}", i) for i in range(b, 40, 7)]) for b in range(3)]
    # not a merge that could be done twice
    grow = lambda stored, batch: stored.unionByName(batch.select(*[F.col(c) if c in batch.columns else F.lit(None).cast(t).alias(c) for c, t in stored.dtypes]))
    for n, batch in enumerate(batches):
        apply_batch(batch, grow, table, f"{n:010d}")
    once = plain(table.read())
    apply_batch(batches[2], grow, table, "0000000002")
    assert plain(table.read()) == once
    # a write without its manifest does not count
    half = batches[1].select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES["pgx_results"]]).withColumn("bucket", F.lit(3))
    half.write.partitionBy("bucket").parquet(f"{tmp_path}/pgx_results/data/version=0000000003")
    assert plain(table.read()) == once


def test_empty_buckets_null_keys_and_rows_elsewhere(spark, table):
    touched = apply_batch(results(spark, [("p7", "G", "new", 1)]), lambda stored, _: stored.limit(0), table, "0000000000")
    assert all(table.bucket is not None and r not in plain(table.read(touched)) for r in [("p7", "G", "old")])
    assert table.read(touched).isEmpty() and not table.read().isEmpty()
    apply_batch(results(spark, [(None, "G", "new", 1)]), merged, table, "0000000001")
    assert table.read().where("patient_id is null").count() == 1
    with pytest.raises(Exception, match="not touched"):
        table.write(table.read(), "0000000002", touched)
    assert apply_batch(results(spark, []), merged, table, "0000000003") == []
    with pytest.raises(ValueError, match="16 buckets, not 8"):
        BucketTable(spark, table.root, "pgx_results", "patient_id", 8).read()


def test_old_versions_go(spark, table, tmp_path):
    for n in range(6):
        apply_batch(results(spark, [("p7", "G", f"v{n}", 1), (f"p{n}", "G", "y", 2)]), merged, table, f"{n:010d}", keep=2)
    assert table.versions() == ["0000000004", "0000000005"]
    used = {f"pgx_results/data/version={v}/bucket={b}" for k in table.versions() for b, v in table.manifest(k).items() if v}
    there = {os.path.dirname(f) for f in files(tmp_path) if "/data/" in f}
    assert there == used
    # 16 buckets, and those of the last versions but one
    assert len(there) <= 16 + 2
    assert ("p7", "G", "v5") in plain(table.read()) and len(plain(table.read())) == 200


def test_stream_equals_one_merge_after_the_other(spark, table, tmp_path):
    landed, log = str(tmp_path / "landed"), str(tmp_path / "log")
    want = table.read()
    for b in range(3):
        batch = results(spark, [(f"p{i}", "GH"[i % 2], f"v{b}", i) for i in range(b, 60, 11)])
        want = merged(want, batch)
        batch.write.mode("append").parquet(landed)
        apply_stream(spark.readStream.schema(batch.schema).parquet(landed), merged, table, log).awaitTermination()
    # the start, read before it expired
    assert len(plain(table.read())) == 200 + len({i for b in range(3) for i in range(b, 60, 11) if i % 2})


def test_a_stored_result_changes_the_next_decision(spark, tmp_path):
    requests, patients, meds, rules, none = tables_of(spark, [("p1", "m1")], PAT, MED, [POOR], [])
    _, _, _, _, stored = tables_of(spark, [("p1", "m1")], PAT, MED, [POOR], [("x1", "p1", "CYP2C19", "poor metabolizer", 1)])
    landed, path, log = (str(tmp_path / n) for n in ("landed", "history", "log"))
    profiles = Profiles.started(str(tmp_path / "profiles"), patients, meds, rules, none, buckets=8)
    union = lambda held, batch: held.unionByName(batch)
    for n in range(2):
        if n:
            profiles.change_results(stored, union, "0000000000")
        requests.write.mode("append").parquet(landed)
        stream = spark.readStream.schema(requests.schema).parquet(landed)
        profiles.history_stream(stream, path, log, ["patient_id"]).awaitTermination()
    rows = {r.run_id: r for r in read_risk_results(spark, path).collect()}
    assert [rows[k].rule_id for k in sorted(rows)] == [None, "r1"]
    # a change of rules is another delta
    profiles.change_medications(meds, rules.limit(0), "0000000001")
    assert [r.branch for r in profiles.match(requests).collect()] == ["no_rules"]


def test_a_decision_reads_the_buckets_of_its_batch(spark, tmp_path):
    pats = [f"p{i}" for i in range(60)]
    requests, patients, meds, rules, pgx = tables_of(
        spark, [(p, "m1") for p in [*pats, "nobody", None, " p3 "]], pats, MED, [POOR],
        [(f"x{i}-{k}", f"p{i}", g, "poor metabolizer", k) for i in range(0, 60, 2) for k, g in enumerate(["CYP2C19", " cyp2c19", "OTHER"])],
    )
    profiles = Profiles.started(str(tmp_path / "profiles"), patients, meds, rules, pgx, buckets=8)
    pick = lambda df: sorted((r.decided_patient or "", r.branch, r.rule_id or "", r.pgx_result_id or "") for r in df.collect())
    assert pick(profiles.match(requests)) == pick(match_risk(requests, patients, meds, rules, pgx))
    one = requests.where("patient_id = 'p2'")
    read = profiles.match(one).inputFiles()
    of_profiles = [f for f in read if "_profiles/" in f]
    assert len(of_profiles) == 2 and not [f for f in read if "pgx_results" in f]
