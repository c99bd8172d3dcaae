"""JSON envelopes: an object with run metadata and a `records` array.

Presence of keys is tested on the text of each record, because a typed read
cannot tell an absent key from a null one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allelegate.operators.staging import to_rules
from allelegate.plans import domains as D
from allelegate.plans.schemas import NORMALIZED_RECORD, RAW_RECORD

# Envelopes in a compressed file: one task reads it whole, so what a file holds must not grow with what a task writes.
ENVELOPES_PER_FILE = 8


def required_fields_missing(record: Column | str, required: list[str]) -> Column:
    """Sorted required keys that a record's JSON text lacks; a null value is not a lack."""
    names = F.array(*[F.lit(r) for r in sorted(required)])
    return F.array_sort(F.array_except(names, F.json_object_keys(record)))


def _stop(df: DataFrame, error: Column) -> DataFrame:
    """Fail the job at the first row with an error.  A filter is never pruned away."""
    return df.where(F.when(error.isNull(), F.lit(True)).otherwise(F.raise_error(error).cast("boolean")))


def _records(spark: SparkSession, path: str | list[str], label: str, lines: bool) -> DataFrame:
    """(ord_file, ord_block, ord_envelope, ord_record, record text), one row per record.

    An envelope is parsed once, inside the generator, below which no filter is pushed; its text is parsed again only to
    tell what is wrong with it.
    """
    text = spark.read.text(path, wholetext=not lines).select(
        F.col("_metadata.file_path").alias("ord_file"),
        F.col("_metadata.file_block_start").alias("ord_block"),
        F.monotonically_increasing_id().alias("ord_envelope"),
        "value",
    )
    # the other functions know no NaN either
    records = F.from_json("value", "records array<string>", {"allowNonNumericNumbers": "false"})["records"]
    error = (
        F.when(F.get_json_object("value", "$").isNull(), F.concat(F.lit("Input file is not valid JSON: "), "ord_file"))
        .when(F.json_object_keys("value").isNull(), F.lit(f"{label} input must be a JSON object."))
        .otherwise(F.lit(f"{label} input must contain a records array."))
    )
    found = F.coalesce(records, F.raise_error(error).cast("array<string>"))
    rows = text.select("ord_file", "ord_block", "ord_envelope", F.posexplode_outer(found).alias("_pos", "record"))
    good = _stop(rows, F.when(F.col("_pos").isNull(), F.lit(f"{label} input records array is empty.")))
    return good.select("ord_file", "ord_block", "ord_envelope", (F.col("_pos") + 1).alias("ord_record"), "record")


def _typed(rows: DataFrame, fine: Column, error: Column, schema: str, strict: bool) -> DataFrame:
    """Records as columns, parsed once by a generator; `error` looks at the text only where they are not `fine`."""
    order = ["ord_file", "ord_block", "ord_envelope", "ord_record"]
    typed = rows.select(*order, "record", F.inline(F.array(F.from_json("record", schema))))
    error = F.when(~F.coalesce(fine, F.lit(False)), error)
    fields = [c for c in typed.columns if c not in (*order, "record")]
    if strict:
        return _stop(typed, error).select(*order, *fields)
    return typed.select(*order, *fields, error.alias("error"), "record")


def _present(names: list[str]) -> Column:
    """A required key with a value is there; only one without may be a lack."""
    return reduce(Column.__and__, [F.col(n).isNotNull() for n in names])


def read_collected(spark: SparkSession, path: str | list[str], lines: bool = False, strict: bool = True) -> DataFrame:
    """Collected records.  `lines`: one envelope per line, as `write_envelope_json` leaves them.

    Strict reading fails at the first bad record and names it; otherwise each
    row carries its `error` and its text.
    """
    rows = _records(spark, path, "Raw", lines)
    missing = required_fields_missing("record", D.RAW_REQUIRED)
    which = F.concat(F.lit("Raw record "), F.col("ord_record").cast("string"))
    med = F.get_json_object("record", "$.medication")
    blank = lambda f: F.coalesce(F.get_json_object("record", f"$.medication.{f}"), F.lit("")) == ""
    error = (
        F.when(F.json_object_keys("record").isNull(), F.concat(which, F.lit(" must be an object.")))
        .when(F.size(missing) > 0, F.concat(which, F.lit(" is missing fields: "), F.array_join(missing, ", ")))
        .when(F.json_object_keys(med).isNull(), F.concat(which, F.lit(" medication must be an object.")))
        .when(blank("genericName"), F.concat(which, F.lit(" medication is missing genericName.")))
        .when(blank("brandName"), F.concat(which, F.lit(" medication is missing brandName.")))
    )
    named = (F.col("medication.genericName") != "") & (F.col("medication.brandName") != "")
    return _typed(rows, _present(D.RAW_REQUIRED) & named, error, RAW_RECORD, strict)


def read_normalized(spark: SparkSession, path: str | list[str], lines: bool = False, strict: bool = True) -> DataFrame:
    """Normalized records as written; `load_normalized_rules` goes on to staged rules."""
    rows = _records(spark, path, "Normalized", lines)
    missing = required_fields_missing("record", D.NORMALIZED_REQUIRED)
    which = F.concat(F.lit("Normalized record "), F.col("ord_record").cast("string"))
    error = F.when(
        F.json_object_keys("record").isNull(), F.concat(which, F.lit(" must be an object."))
    ).when(F.size(missing) > 0, F.concat(which, F.lit(" is missing fields: "), F.array_join(missing, ", ")))
    return _typed(rows, _present(D.NORMALIZED_REQUIRED), error, NORMALIZED_RECORD, strict)


def load_normalized_rules(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    return to_rules(read_normalized(spark, path, lines))


def collected_meta(collected_at: str) -> dict[str, str]:
    return {
        "collectedAt": collected_at,
        "collectorVersion": D.COLLECTOR_VERSION,
        "collectionMode": "curated_static",
        "notes": D.COLLECTED_NOTES,
    }


def normalized_meta(normalized_at: str, source_file: str) -> dict[str, str]:
    return {
        "normalizedAt": normalized_at,
        "normalizerVersion": D.COLLECTOR_VERSION,
        "sourceFile": source_file,
        "reviewNote": D.NORMALIZED_NOTE,
    }


def write_envelope_json(
    df: DataFrame, path: str, meta: dict[str, str], rows_per_envelope: int = 10_000, compression: str | None = None
) -> None:
    """Records in envelopes, one per line, each with the metadata and a bounded number of records.

    Spark turns rows into JSON; a task only joins the texts of its own rows.  With `compression` ("gzip") the repeated
    keys take little disk; the reader knows it by the files' names.
    """
    names = [c for c in df.columns if not c.startswith("ord_")]
    texts = df.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("record"))
    head = json.dumps(meta)[:-1] + (", " if meta else "") + '"records": ['

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[str] = []
        for batch in batches:
            held.extend(batch["record"])
            while len(held) >= rows_per_envelope:
                yield pd.DataFrame({"value": [head + ", ".join(held[:rows_per_envelope]) + "]}"]})
                held = held[rows_per_envelope:]
        if held:
            yield pd.DataFrame({"value": [head + ", ".join(held) + "]}"]})

    out = texts.mapInPandas(pack, "value string").write
    if compression:
        out = out.option("compression", compression).option("maxRecordsPerFile", ENVELOPES_PER_FILE)
    out.text(path)
