"""Merging duplicate patients of a user into the oldest one, and deletes that follow references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelegate.functions.text import latest, merged_notes, stable_id
from allelegate.operators.audit import check_unique
from allelegate.operators.merge import merge_on
from allelegate.plans.schemas import REFERENCES


def first_patient(patients: DataFrame) -> DataFrame:
    """Earliest patient per user, by created_at then id."""
    return patients.groupBy("user_id").agg(
        F.min_by("id", F.struct("created_at", "id")).alias("kept_id")
    )


def canonical_patient(patients: DataFrame) -> DataFrame:
    """Every patient with the one that its user keeps.

    The minimum combines before the shuffle; the join back is on one row per
    user, which adaptive execution can split for a user with many patients.
    """
    return patients.select("user_id", F.col("id").alias("from_id")).join(first_patient(patients), "user_id")


def non_canonical(mapping: DataFrame) -> DataFrame:
    return mapping.where("from_id <> kept_id").select("from_id", "kept_id")


def non_canonical_rows(child: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows of patients that will go, with the patient that stays."""
    return child.join(non_canonical(mapping), F.col("patient_id") == F.col("from_id")).drop("from_id")


def latest_per_key(df: DataFrame, keys: list[Column | str], order: list[Column]) -> DataFrame:
    """First row per key in `order`; each task keeps one row per key before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", place).where("_rn = 1").drop("_rn")


def _newest() -> list[Column]:
    return [F.desc("updated_at"), F.asc("id")]


def _staying(child: DataFrame, mapping: DataFrame) -> DataFrame:
    return child.join(non_canonical(mapping), F.col("patient_id") == F.col("from_id"), "left_anti")


def merge_pgx(pgx: DataFrame, mapping: DataFrame) -> DataFrame:
    """Results after the merge: a duplicate's value wins, even an older one.

    Duplicates compete on the lowered gene, but meet stored rows on the gene as
    written.
    """
    moved = non_canonical_rows(pgx, mapping).withColumn("_gene", F.lower("gene"))
    moved = (
        latest_per_key(moved, ["kept_id", "_gene"], _newest())
        .drop("_gene", "patient_id")
        .withColumnRenamed("kept_id", "patient_id")
    )
    there = F.col("n._there").isNotNull()
    rest = [c for c in pgx.columns if c not in ("id", "patient_id", "gene", "updated_at", "created_at")]
    columns = {
        "id": F.coalesce(F.col("t.id").cast("string"), stable_id(F.lit("merged"), "n.patient_id", "n.gene")),
        **{c: F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"t.{c}")) for c in rest},
        "updated_at": latest("t.updated_at", "n.updated_at"),
    }
    if "created_at" in pgx.columns:
        columns["created_at"] = F.coalesce("t.created_at", "n.created_at")
    return merge_on(_staying(pgx, mapping), moved, ["patient_id", "gene"], columns)


def merge_list(items: DataFrame, mapping: DataFrame) -> DataFrame:
    """Medication lists after the merge: status of the duplicate, both notes, earliest start.

    Whole rows move twice: to the patient that they belong to, then to the item of the patient that stays, where the
    newest duplicate comes first.  Null keys meet nothing; they are dealt out by their ids.
    """
    to = non_canonical(mapping)
    owned = items.join(to, F.col("patient_id") == F.col("from_id"), "left").withColumns(
        {"_moved": F.col("from_id").isNotNull(), "patient_id": F.coalesce("kept_id", "patient_id")}
    )
    alone = ~F.col("_moved") & (F.col("patient_id").isNull() | F.col("medication_id").isNull())
    keys = ["patient_id", "medication_id", "_alone"]
    placed = owned.withColumn("_alone", F.when(alone, F.xxhash64("id")))
    rest = [c for c in items.columns if c not in ("patient_id", "medication_id")]
    ranked = Window.partitionBy(*keys).orderBy(F.desc("_moved"), *_newest())
    # the last row of an item stays, if any does
    stays = F.last(~F.col("_moved")).over(ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first = F.first(F.when(F.col("_moved"), F.struct(*rest))).over(ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = placed.withColumns({"_n": first, "_stays": stays, "_at": F.row_number().over(ranked)})
    kept = found.where(~F.col("_moved") | ((F.col("_at") == 1) & ~F.col("_stays")))
    t = lambda c: F.when(~F.col("_moved"), F.col(c))
    n = lambda c: F.col("_n")[c]
    columns = {
        "id": F.coalesce(t("id").cast("string"), stable_id(F.lit("merged"), *[F.when(F.col("_n").isNotNull(), F.col(c)) for c in keys[:2]])),
        "status": F.coalesce(n("status"), t("status")),
        "notes": F.when(F.col("_moved"), n("notes")).otherwise(merged_notes("notes", n("notes"))),
        "started_at": F.coalesce(t("started_at"), n("started_at")),
        "stopped_at": F.coalesce(n("stopped_at"), t("stopped_at")),
        "created_at": F.coalesce(t("created_at"), n("created_at")),
        "updated_at": latest(t("updated_at"), n("updated_at")),
    }
    return kept.select("patient_id", "medication_id", *[c.alias(name) for name, c in columns.items()])


def repoint_history(history: DataFrame, mapping: DataFrame, pgx: DataFrame) -> DataFrame:
    """History of the kept patients; links to results that the merge deletes become null."""
    moved = non_canonical(mapping)
    deleted = pgx.join(moved, F.col("patient_id") == F.col("from_id"), "left_semi").select(
        F.col("id").cast("string").alias("_deleted")
    )
    return (
        history.join(moved, F.col("patient_id") == F.col("from_id"), "left")
        .join(deleted, F.col("pgx_result_id").cast("string") == F.col("_deleted"), "left")
        .withColumns(
            {
                "patient_id": F.coalesce("kept_id", "patient_id"),
                "pgx_result_id": F.when(F.col("_deleted").isNull(), F.col("pgx_result_id")),
            }
        )
        .drop("from_id", "kept_id", "_deleted")
    )


def drop_duplicates_of(patients: DataFrame, mapping: DataFrame) -> DataFrame:
    return patients.join(non_canonical(mapping), F.col("id") == F.col("from_id"), "left_anti")


def consolidate_patients(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All four tables after every user keeps one patient.

    Under `shared_users` are users that still have several, which must be none before the user of a patient
    can be made unique.
    """
    patients = tables["patients"]
    mapping = canonical_patient(patients)
    out = dict(tables)
    out["pgx_results"] = merge_pgx(tables["pgx_results"], mapping)
    out["patient_medications"] = merge_list(tables["patient_medications"], mapping)
    out["risk_results"] = repoint_history(tables["risk_results"], mapping, tables["pgx_results"])
    out["patients"] = drop_duplicates_of(patients, mapping)
    out["shared_users"] = check_unique(out["patients"], ["user_id"])
    return out


def cascade_delete(tables: dict[str, DataFrame], table: str, ids: DataFrame) -> dict[str, DataFrame]:
    """Tables after deleting `ids` (one column, `id`) from `table`.

    References delete, null or forbid as the schema says.  Ids that a
    restricting reference still names are kept and come back under
    `restricted`.  A row without an id is not deleted with its parent.
    """
    doomed = ids.select(F.col("id")).distinct()
    held = None
    for child, column, parent, rule in REFERENCES:
        if parent == table and rule == "restrict" and child in tables:
            # One row per reference before the join: a busy parent is named by very many rows.
            refs = tables[child].select(F.col(column).alias("_ref")).distinct()
            named = doomed.join(refs, F.col("id") == F.col("_ref"), "left_semi")
            held = named if held is None else held.unionByName(named)
    out = dict(tables)
    if held is not None:
        out["restricted"] = held.distinct()
        doomed = doomed.join(out["restricted"], "id", "left_anti")
    deleted = {table: doomed}
    pending = [table]
    while pending:
        parent = pending.pop(0)
        for child, column, owner, rule in REFERENCES:
            if owner != parent or child not in tables or rule != "cascade":
                continue
            gone = (
                tables[child]
                .join(deleted[parent].select(F.col("id").alias("_ref")), F.col(column) == F.col("_ref"), "left_semi")
                .select("id")
            )
            deleted[child] = gone if child not in deleted else deleted[child].unionByName(gone).distinct()
            pending.append(child)
    # Rows go by their reference, so a table is not shuffled a second time by its ids.
    out[table] = out[table].join(deleted[table], "id", "left_anti")
    for child, column, owner, rule in REFERENCES:
        if rule == "cascade" and owner in deleted and child in deleted:
            refs = deleted[owner].select(F.col("id").alias("_ref"))
            on = (F.col(column) == F.col("_ref")) & F.col("id").isNotNull()
            out[child] = out[child].join(refs, on, "left_anti")
    for child, column, owner, rule in REFERENCES:
        if rule == "set_null" and owner in deleted and child in tables:
            gone = deleted[owner].select(F.col("id").alias("_gone"))
            out[child] = (
                out[child]
                .join(gone, F.col(column) == F.col("_gone"), "left")
                .withColumn(column, F.when(F.col("_gone").isNull(), F.col(column)))
                .drop("_gone")
            )
    return out
