"""Every registered query against its SQL on the smallest data set."""

import os
import re
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from oracle import ROOT, compare, duck

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
NAMES = [n for n in QUERIES if n != "pipeline" and not re.match(r"op\d+_", n)]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees(spark, con, name):
    rows, _, note = compare(spark, con, name, QUERIES[name], SQL[name], SF_DIR)
    assert note == "ok", note
    assert rows > 0 or name in ("current_sessions", "unexpired", "session_account")


def test_package_reaches_workers(tmp_path):
    """Started from another folder, Python workers still find the package."""
    script = tmp_path / "elsewhere.py"
    script.write_text(
        f"import sys; sys.path.insert(0, {ROOT!r})\n"
        "import __spark_entry__ as entry\n"
        "from allelegate.plans.session import local_session\n"
        "spark = local_session(2, partitions=2)\n"
        "for name in ('throttle_attempts', 'workbook_candidates', 'html_candidates'):\n"
        f"    entry.queries()[name](spark, {SF_DIR!r}).collect()\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]


def test_entry(spark):
    df = entry.entry(spark)
    assert {"patient_id", "medication_id", "message"} <= set(df.columns)
