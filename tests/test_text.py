"""Text functions against plain Python on edge strings."""

import pytest
from pyspark.sql import functions as F

from allelegate.functions import text as X

EDGE = [
    "", " ", "  Poor   Metabolizer ", " Poor  metabolizer　", "a\tb\r\nc", "\x1cx\x1d\x1ey\x1f", "\x85z\x85",
    " q r s t ", "﻿bom﻿", "ÉCOLE ß", "    ", "x" + " " * 40 + "y", "😀  ok",
]


def values(spark, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*EDGE, None])], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_import_normalizer_equals_python(spark):
    want = [" ".join((v or "").strip().split()) for v in [*EDGE, None]]
    assert values(spark, X.norm_text("v")) == want
    assert values(spark, X.norm_key("v")) == [w.lower() for w in want]
    assert values(spark, X.norm_gene("v")) == [w.upper() for w in want]


def test_request_normalizer_keeps_inner_whitespace(spark):
    space = X.REQUEST_SPACE
    assert values(spark, X.trim_all("v")) == [(v or "").strip(space) for v in [*EDGE, None]]
    assert values(spark, X.match_key("v"))[2] == "poor   metabolizer"


def ask(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn("v")).first()[0]


@pytest.mark.parametrize(
    "value, ok",
    [
        ("123e4567-e89b-12d3-a456-426614174000", True),
        ("123E4567-E89B-42D3-B456-426614174000", True),
        ("123e4567-e89b-62d3-a456-426614174000", False),
        ("123e4567-e89b-12d3-c456-426614174000", False),
        ("123e4567-e89b-12d3-a456-426614174000\n", False),
        (None, False),
    ],
)
def test_uuid(spark, value, ok):
    assert ask(spark, value, X.is_uuid) is ok


def test_email_and_lengths(spark):
    assert [ask(spark, v, X.is_email) for v in ("a@b.c", "a b@c.d", "a@b", "@b.c", "a@b.c ")] == [True, False, False, False, False]
    fits = lambda v: ask(spark, v, X.within_length)
    assert fits("x" * 500) and not fits("x" * 501) and fits("😀" * 250) and not fits("😀" * 251)


def test_labels_and_messages(spark):
    assert [ask(spark, v, X.level_label) for v in ("potential_concern", "_x__yZ_", "", None)] == ["Potential Concern", "X YZ", "", ""]
    message = lambda g: ask(spark, g, X.missing_gene_message, "array<string>")
    assert message(["A"]) == "Missing A PGx result for this medication."
    assert message(["A", "B"]) == "Missing A, B PGx results for this medication."


def test_first_filled_counts_spaces_as_filled(spark):
    df = spark.createDataFrame([("", " ", "c"), (None, "", None)], "a string, b string, c string")
    assert [r[0] for r in df.select(X.first_filled("a", "b", "c")).collect()] == [" ", ""]


def test_notes_and_genes(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a"), (None, "b"), ("a", None), (None, None)], "o string, n string")
    got = [r[0] for r in df.select(X.merged_notes("o", "n")).collect()]
    assert got == ["a\n[Merged record] b", "a", "b", "a", None]
    assert ask(spark, " cyp2c19;SLCO1B1 , x", X.split_genes) == ["CYP2C19", "SLCO1B1", "X"]
    assert X.first_present(["drug(s)", "gene"], "drug", "drug(s)") == "drug(s)"
    assert ask(spark, "t", X.token_hash) == __import__("hashlib").sha256(b"t").hexdigest()


def test_stable_ids(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    first, again = (df.select(X.stable_id(F.lit("k"), "x", "y")).first()[0] for _ in range(2))
    assert first == again


def test_parts_of_an_id_do_not_run_into_each_other(spark):
    rows = [("A|B", "C"), ("A", "B|C"), ("A\\", "|B|C"), ("A|B|C", None), (None, "A|B|C"), ("A|B|C", ""), ("A|B|C", "\\N"), ("A\\|B", "C")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(X.stable_id("x", "y")).distinct().count() == len(rows)
