"""Merges of incoming rows into stored tables, as full outer joins.

A merge first brings the incoming rows down to one per key by an aggregate
that combines before the shuffle, then joins once on the key.  Results go to a
new version of the table (see `sources.tables`), never over the one being read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelegate.functions.text import (
    blank_to_null,
    expires_at,
    norm_gene,
    norm_key,
    stable_id,
    token_hash,
    trim_all,
)
from allelegate.operators.staging import checked, invalid_reason
from allelegate.plans import domains as D


def last_value(column: str, order: list[str]) -> Column:
    """Last non-null value in `order`."""
    known = F.col(column).isNotNull()
    return F.max_by(column, F.when(known, F.struct(*order)))


def merge_on(
    target: DataFrame, incoming: DataFrame, keys: list[str], columns: dict[str, Column], made: dict[str, Column] | None = None
) -> DataFrame:
    """Full outer merge.  In `columns`, `t.x` is the stored value and `n.x` the incoming one.

    `made` names columns that are made of these first, once per merged row.  The booleans `t._there` and `n._there` (null when absent) tell the cases apart.
    """
    t = target.withColumn("_there", F.lit(True)).alias("t")
    n = incoming.withColumn("_there", F.lit(True)).alias("n")
    on = [F.col(f"t.{k}") == F.col(f"n.{k}") for k in keys]
    both = t.join(n, on, "full_outer").withColumns(made or {})
    return both.select(
        *[F.coalesce(f"t.{k}", f"n.{k}").alias(k) for k in keys], *[c.alias(a) for a, c in columns.items()]
    )


def upsert_medications(target: DataFrame, incoming: DataFrame, order: list[str], run_ts: Column, strict: bool = True) -> DataFrame:
    """Stored medications with the staged ones: names fill in, and every named one becomes active.

    `incoming` holds staged rules; their `medication_generic_name` is the key.  A rule whose level or state is not
    allowed names no medication: it fails the merge, or, if not `strict`, is left out.
    """
    reason = invalid_reason("risk_level", "review_status")
    if strict:
        name = F.col("medication_generic_name")
        incoming = incoming.withColumn("medication_generic_name", F.when(reason.isNull(), name).otherwise(F.raise_error(reason).cast("string")))
    else:
        incoming = incoming.where(reason.isNull())
    latest = incoming.groupBy(F.col("medication_generic_name").alias("generic_name")).agg(
        last_value("brand_name", order).alias("brand_name"), last_value("drug_class", order).alias("drug_class")
    )
    return merge_on(
        target,
        latest,
        ["generic_name"],
        {
            "id": F.coalesce(F.col("t.id").cast("string"), stable_id(F.lit("medication"), "n.generic_name")),
            "brand_name": F.coalesce("n.brand_name", "t.brand_name"),
            "drug_class": F.coalesce("n.drug_class", "t.drug_class"),
            "is_active": F.coalesce(F.col("n._there"), F.col("t.is_active")),
            "created_at": F.coalesce(F.col("t.created_at"), run_ts),
            "updated_at": F.coalesce(F.col("t.updated_at"), run_ts),
        },
    )


RULE_VALUES = [
    "risk_level",
    "patient_summary",
    "clinician_summary",
    "recommended_action",
    "evidence_source",
    "evidence_url",
    "rule_version",
    "review_status",
]


# A mark and a letter stand between texts, for a null, and for a mark within a text.
MARK = "\u0002"
BREAK, NO_TEXT, PLAIN_MARK = f"{MARK}b", f"{MARK}n", f"{MARK}e"


def packed(columns: list[str]) -> Column:
    """Text columns as one text; `unpacked` gives them back, whatever they hold.

    In a sort and in a shuffle a row of many short texts takes less room so than with a place and a length for each.
    """
    return F.array_join(F.array(*[F.replace(c, F.lit(MARK), F.lit(PLAIN_MARK)) for c in columns]), BREAK, NO_TEXT)


def unpacked(text: str, columns: list[str]) -> dict[str, Column]:
    parts = {c: F.split_part(F.col(text), F.lit(BREAK), F.lit(i)) for i, c in enumerate(columns, 1)}
    return {c: F.replace(F.nullif(p, F.lit(NO_TEXT)), F.lit(PLAIN_MARK), F.lit(MARK)) for c, p in parts.items()}


def text_columns(rows: DataFrame, columns: list[str]) -> list[str]:
    types = dict(rows.dtypes)
    return [c for c in columns if types[c] == "string"]


def gated_packed(incoming: DataFrame, keys: list[str], values: list[str], order: list[str]) -> DataFrame:
    """`gated_last` with its text values `packed` in `_texts`, and whether the row is `_approved`."""
    key_texts, texts = text_columns(incoming, keys), text_columns(incoming, values)
    approved = (F.col("review_status") == D.APPROVED).alias("_approved")
    place = [F.col(c).alias(f"_order{i}") for i, c in enumerate(order)]
    kept = [*[c for c in values if c not in texts], "_texts"]
    by = [*[F.col(k) for k in keys if k not in key_texts], packed(key_texts).alias("_key")]
    rank_and_row = F.struct(approved, *place, *kept[:-1], packed(texts).alias("_texts"))
    last = incoming.groupBy(*by).agg(F.max(rank_and_row).alias("_last"))
    key = unpacked("_key", key_texts)
    return last.select(
        *[key.get(k, F.col(k)).alias(k) for k in keys], *[F.col(f"_last.{c}").alias(c) for c in ["_approved", *kept]]
    )


def gated_last(incoming: DataFrame, keys: list[str], values: list[str], order: list[str]) -> DataFrame:
    """Last approved row per key, else the last row: what a batch does before it meets the stored row."""
    found = unpacked("_texts", text_columns(incoming, values))
    best = gated_packed(incoming, keys, values, order)
    return best.select(*keys, *[found.get(v, F.col(v)).alias(v) for v in values])


def upsert_rules(
    target: DataFrame, incoming: DataFrame, medications: DataFrame, order: list[str], run_ts: Column, strict: bool = True
) -> DataFrame:
    """Stored rules with the staged ones, under the approval guard.

    An approved rule gives way only to an approved one.  Row by row in order
    that means: the last approved incoming row, else the stored row if it is
    approved, else the last incoming row.  `medications` is the result of
    `upsert_medications`, which holds every incoming name.
    """
    rows = incoming.select(
        F.col("medication_generic_name").alias("generic_name"),
        norm_gene("gene").alias("gene"),
        norm_key("phenotype").alias("phenotype"),
        *RULE_VALUES,
        *order,
    )
    rows = checked(rows, "risk_level", "review_status", strict)
    if not strict:
        rows = rows.where("invalid is null")
    # The winners' texts stay packed through both joins.
    best = gated_packed(rows, ["generic_name", "gene", "phenotype"], RULE_VALUES, order)
    texts = unpacked("n._texts", text_columns(rows, RULE_VALUES))
    said = {v: F.col(f"_said_{v}" if v in texts else f"n.{v}") for v in RULE_VALUES}
    named = best.join(
        medications.select("generic_name", F.col("id").cast("string").alias("medication_id")), "generic_name"
    ).drop("generic_name")
    stored = target.withColumn("medication_id", F.col("medication_id").cast("string"))
    new = F.col("n._there") & (
        F.col("t._there").isNull()
        | (F.col("t.review_status") != D.APPROVED)
        | F.col("n._approved")
    )
    pick = lambda a, b: F.when(new, a).otherwise(b)
    return merge_on(
        stored,
        named,
        ["medication_id", "gene", "phenotype"],
        {
            "id": F.coalesce(
                F.col("t.id").cast("string"), stable_id(F.lit("rule"), "n.medication_id", "n.gene", "n.phenotype")
            ),
            **{v: pick(said[v], F.col(f"t.{v}")) for v in RULE_VALUES},
            "imported_at": pick(F.coalesce(F.col("t.imported_at"), run_ts), F.col("t.imported_at")),
            "created_at": F.coalesce(F.col("t.created_at"), run_ts),
            "updated_at": pick(run_ts, F.col("t.updated_at")),
        },
        {f"_said_{v}": text for v, text in texts.items()},
    )


def checked_results(incoming: DataFrame, patients: DataFrame) -> DataFrame:
    """Incoming gene results with clean values and a coded `outcome`."""
    text_id = dict(incoming.dtypes)["patient_id"] == "string"
    who = F.nullif(trim_all("patient_id"), F.lit("")) if text_id else F.col("patient_id")
    clean = incoming.withColumns(
        {
            "patient_id": who,
            "gene": trim_all("gene"),
            "phenotype": trim_all("phenotype"),
            "genotype": blank_to_null(trim_all("genotype")),
        }
    )
    known = patients.select(F.col("id").alias("_known"))
    return (
        clean.join(known, F.col("patient_id") == F.col("_known"), "left")
        .withColumn(
            "outcome",
            F.when(F.col("patient_id").isNull(), D.MISSING_PATIENT_ID)
            .when((F.col("gene") == "") | (F.col("phenotype") == ""), D.MISSING_FIELDS)
            .when(F.col("_known").isNull(), D.PATIENT_NOT_FOUND)
            .otherwise("saved"),
        )
        .drop("_known")
    )


def upsert_pgx(target: DataFrame, results: DataFrame, order: list[str], run_ts: Column) -> DataFrame:
    """Stored results with the saved rows of `checked_results`: the last per (patient, gene) wins.

    The gene is compared as written; the source of a stored row stays.
    """
    saved = results.where("outcome = 'saved'")
    last = saved.groupBy("patient_id", "gene").agg(
        F.max_by(F.struct("phenotype", "genotype"), F.struct(*order)).alias("_last")
    ).select("patient_id", "gene", "_last.phenotype", "_last.genotype")
    there = F.col("n._there").isNotNull()
    return merge_on(
        target,
        last,
        ["patient_id", "gene"],
        {
            "id": F.coalesce(F.col("t.id").cast("string"), stable_id(F.lit("pgx"), "n.patient_id", "n.gene")),
            "phenotype": F.coalesce("n.phenotype", "t.phenotype"),
            "genotype": F.when(there, F.col("n.genotype")).otherwise(F.col("t.genotype")),
            "source": F.coalesce(F.col("t.source"), F.lit(D.MANUAL_SOURCE)),
            "created_at": F.coalesce(F.col("t.created_at"), run_ts),
            "updated_at": F.when(there, run_ts).otherwise(F.col("t.updated_at")),
        },
    )


def unexpired(sessions: DataFrame, run_ts: Column) -> DataFrame:
    return sessions.where(F.col("expires_at") > run_ts)


def upsert_sessions(target: DataFrame, logins: DataFrame, run_ts: Column) -> DataFrame:
    """Sessions live at `run_ts`: one per user, the newest sign-in wins, expired ones are gone.

    `logins` has user_id, token, ts and event_id; a live session keeps its id.
    """
    newest = (
        logins.groupBy("user_id")
        .agg(F.max_by(F.struct("token", "ts"), F.struct("ts", "event_id")).alias("_last"))
        .select(
            "user_id",
            token_hash("_last.token").alias("token_hash"),
            expires_at("_last.ts").alias("expires_at"),
            F.col("_last.ts").alias("created_at"),
        )
    )
    merged = merge_on(
        unexpired(target, run_ts),
        newest,
        ["user_id"],
        {
            "id": F.coalesce(F.col("t.id").cast("string"), stable_id(F.lit("session"), "n.user_id")),
            **{c: F.coalesce(f"n.{c}", f"t.{c}") for c in ("token_hash", "expires_at", "created_at")},
        },
    )
    return unexpired(merged, run_ts)
