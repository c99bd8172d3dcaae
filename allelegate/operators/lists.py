"""Patient medication lists: adds, updates, removes, and ordered mixes of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allelegate.functions.text import (
    blank_to_null,
    in_domain,
    is_uuid,
    match_key,
    stable_id,
    trim_all,
    within_length,
)
from allelegate.operators.match import active_medications
from allelegate.plans import domains as D
from allelegate.plans.item_scan import ItemMaps, held_before, item_map
from allelegate.plans.range_scan import entering_states
from allelegate.plans.session import scratch_path
from allelegate.plans.skew import in_order, in_ranges, segment_count, with_position

IdTest = Callable[[str], Column]

ITEM_COLUMNS = [
    "id", "patient_id", "medication_id", "status", "notes", "started_at", "stopped_at", "created_at", "updated_at",
]


def _first_only(rows: DataFrame, keys: list[str], order: list[str], flag: str) -> DataFrame:
    """`flag` is true on the first row per key among those where it is true.

    The join back runs on key and order together, so a key with many rows is
    spread over all tasks.
    """
    on = [*keys, *order]
    first = rows.where(F.col(flag)).groupBy(*keys).agg(F.min(F.struct(*order)).alias("_o")).select(
        *keys, *[F.col(f"_o.{c}").alias(c) for c in order], F.lit(True).alias("_first")
    )
    return rows.join(first, on, "left").withColumn(flag, F.coalesce("_first", F.lit(False)) & F.col(flag)).drop("_first")


def add_outcomes(
    requests: DataFrame, items: DataFrame, meds: DataFrame, order: list[str], id_test: IdTest = is_uuid
) -> DataFrame:
    """Coded outcome of each add: the first valid request for a free pair wins.

    `order` must tell any two requests for the same pair apart.
    """
    known = active_medications(meds).select(F.col("id").alias("_med"))
    taken = items.select(F.col("patient_id").alias("_tp"), F.col("medication_id").alias("_tm"))
    rows = (
        requests.join(known, F.col("medication_id") == F.col("_med"), "left")
        .join(taken, (F.col("patient_id") == F.col("_tp")) & (F.col("medication_id") == F.col("_tm")), "left")
        .withColumn("_valid", id_test("patient_id") & id_test("medication_id"))
        .withColumn("_free", F.col("_valid") & F.col("_med").isNotNull() & F.col("_tp").isNull())
    )
    rows = _first_only(rows, ["patient_id", "medication_id"], order, "_free")
    return rows.withColumns(
        {
            "code": F.when(~F.col("_valid"), "INVALID_INPUT")
            .when(F.col("_med").isNull(), "MEDICATION_NOT_FOUND")
            .when(~F.col("_free"), "DUPLICATE_MEDICATION"),
            "message": F.when(~F.col("_valid"), D.LIST_ADD_INVALID)
            .when(F.col("_med").isNull(), D.LIST_ADD_UNKNOWN)
            .when(~F.col("_free"), D.LIST_DUPLICATE)
            .otherwise(D.LIST_ADDED),
            "supported": F.col("_free"),
        }
    ).drop("_med", "_tp", "_tm", "_valid", "_free")


def apply_list_adds(items: DataFrame, outcomes: DataFrame, run_ts: Column) -> DataFrame:
    """The list with the winning adds."""
    new = outcomes.where("supported").select(
        stable_id(F.lit("item"), "patient_id", "medication_id").alias("id"),
        "patient_id",
        "medication_id",
        F.lit("active").alias("status"),
        run_ts.alias("created_at"),
        run_ts.alias("updated_at"),
    )
    return items.withColumn("id", F.col("id").cast("string")).unionByName(new, allowMissingColumns=True)


def update_outcomes(updates: DataFrame, items: DataFrame, id_test: IdTest = is_uuid) -> DataFrame:
    """Coded outcome of each update of an own item, with clean status and notes."""
    own = items.select(F.col("id").alias("_id"), F.col("patient_id").alias("_owner"))
    clean = updates.withColumns({"status": trim_all("status"), "notes": trim_all("notes")})
    valid = (
        id_test("patient_id") & id_test("item_id") & in_domain("status", D.LIST_STATUSES) & within_length("notes")
    )
    return (
        clean.withColumn("_valid", valid)
        .join(own, (F.col("item_id") == F.col("_id")) & (F.col("patient_id") == F.col("_owner")), "left")
        .withColumns(
            {
                "notes": blank_to_null("notes"),
                "code": F.when(~F.col("_valid"), "INVALID_INPUT").when(F.col("_id").isNull(), "NOT_FOUND"),
                "message": F.when(~F.col("_valid"), D.LIST_UPDATE_INVALID)
                .when(F.col("_id").isNull(), D.LIST_NOT_FOUND)
                .otherwise(D.LIST_UPDATED),
                "supported": F.col("_valid") & F.col("_id").isNotNull(),
            }
        )
        .drop("_valid", "_id", "_owner")
    )


def apply_list_updates(items: DataFrame, outcomes: DataFrame, order: list[str], run_ts: Column) -> DataFrame:
    """The list with the last good update per item."""
    last = (
        outcomes.where("supported")
        .groupBy(F.col("item_id").alias("id"))
        .agg(F.max_by(F.struct("status", "notes"), F.struct(*order)).alias("_u"))
    )
    hit = F.col("_u").isNotNull()
    return items.join(last, "id", "left").withColumns(
        {
            "status": F.when(hit, F.col("_u.status")).otherwise(F.col("status")),
            "notes": F.when(hit, F.col("_u.notes")).otherwise(F.col("notes")),
            "updated_at": F.when(hit, run_ts).otherwise(F.col("updated_at")),
        }
    ).drop("_u")


def remove_outcomes(removes: DataFrame, items: DataFrame, order: list[str], id_test: IdTest = is_uuid) -> DataFrame:
    """Coded outcome of each remove: the first good one deletes, later ones find nothing."""
    own = items.select(F.col("id").alias("_id"), F.col("patient_id").alias("_owner"))
    rows = (
        removes.withColumn("_valid", id_test("patient_id") & id_test("item_id"))
        .join(own, (F.col("item_id") == F.col("_id")) & (F.col("patient_id") == F.col("_owner")), "left")
        .withColumn("supported", F.col("_valid") & F.col("_id").isNotNull())
    )
    rows = _first_only(rows, ["patient_id", "item_id"], order, "supported")
    return rows.withColumns(
        {
            "code": F.when(~F.col("_valid"), "INVALID_INPUT").when(~F.col("supported"), "NOT_FOUND"),
            "message": F.when(~F.col("_valid"), D.LIST_REMOVE_INVALID)
            .when(~F.col("supported"), D.LIST_NOT_FOUND)
            .otherwise(D.LIST_REMOVED),
        }
    ).drop("_valid", "_id", "_owner")


def apply_list_removes(items: DataFrame, outcomes: DataFrame) -> DataFrame:
    gone = outcomes.where("supported").select(F.col("item_id").alias("id"))
    return items.join(gone, "id", "left_anti")


def change_outcomes(
    changes: DataFrame, items: DataFrame, meds: DataFrame, order: list[str],
    id_test: IdTest = is_uuid, named_by: list[str] | None = None, segments: int | None = None,
) -> DataFrame:
    """Outcome of every change in an ordered mix of adds, updates and removes, with the item that it touched (`target_id`).

    An add names a medication, an update or a remove an item by its id.  The item of an add has the id
    `new_item_id(named_by)`, the columns of `order` by default, so a later change may name it.  An item that has
    been removed is gone: a change by its id finds nothing, also when the medication is on the list again.

    Each change maps "no item, or the item of some id" to the same, and the state before each one comes from a scan
    that composes these maps over ranges of the changes (`plans.item_scan`), so a patient with any number of
    changes is spread over tasks.
    """
    known = active_medications(meds).select(F.col("id").alias("_med"))
    new_id = new_item_id(named_by or order)
    by_id = F.col("op").isin("update", "remove")
    clean = changes.withColumns({"status": trim_all("status"), "notes": trim_all("notes")})
    # every item that there is or may come to be, with its medication
    may_be = clean.where("op = 'add'").select(new_id.alias("item_id"), "patient_id", F.col("medication_id").alias("_of"))
    items_of = items.select(F.col("id").cast("string").alias("item_id"), "patient_id", F.col("medication_id").alias("_of"))
    items_of = items_of.unionByName(may_be).distinct()
    held = items.select(F.col("patient_id").alias("_tp"), F.col("medication_id").alias("_tm"), F.col("id").cast("string").alias("_stored"))
    rows = (
        clean.join(known, F.col("medication_id") == F.col("_med"), "left")
        .join(items_of, ["item_id", "patient_id"], "left")
        .select(*clean.columns, "_med", "_of")
        .withColumn("_on", F.when(by_id, F.col("_of")).otherwise(F.col("medication_id")))
        .join(held, (F.col("patient_id") == F.col("_tp")) & (F.col("_on") == F.col("_tm")), "left")
        .withColumn(
            "_bad",
            F.when(~id_test("patient_id") | ~F.coalesce(F.col("op").isin("add", "update", "remove"), F.lit(False)), "INVALID_INPUT")
            .when((F.col("op") == "add") & ~id_test("medication_id"), "INVALID_INPUT")
            .when(by_id & ~id_test("item_id") & F.col("_of").isNull(), "INVALID_INPUT")
            .when((F.col("op") == "update") & ~(in_domain("status", D.LIST_STATUSES) & within_length("notes")), "INVALID_INPUT")
            .when((F.col("op") == "add") & F.col("_med").isNull(), "MEDICATION_NOT_FOUND"),
        )
        .withColumns(
            {
                "notes": blank_to_null("notes"),
                "_pair": F.to_json(F.struct("patient_id", "_on")),
                "_adds": F.when(F.col("_bad").isNull() & (F.col("op") == "add"), new_id),
                "_drops": F.when(F.col("_bad").isNull() & (F.col("op") == "remove"), F.col("item_id").cast("string")),
            }
        )
    )
    there = F.col("_held").isNotNull()
    found = F.coalesce(F.col("_held") == F.col("item_id").cast("string"), F.lit(False))
    with_code = _with_held(rows, order, segments).withColumn(
        "code",
        F.coalesce(
            F.col("_bad"),
            F.when((F.col("op") == "add") & there, "DUPLICATE_MEDICATION")
            .when(F.col("op") == "add", "ADDED")
            .when(~found, "NOT_FOUND")
            .when(F.col("op") == "update", "UPDATED")
            .otherwise("REMOVED"),
        ),
    )
    touched = F.when(F.col("code") == "ADDED", F.col("_adds")).when(F.col("code").isin("UPDATED", "REMOVED"), F.col("_held"))
    return with_code.withColumn("target_id", touched).select(*clean.columns, "code", "target_id")


def new_item_id(named_by: list[str]) -> Column:
    """Id of the item that an add makes, the same on every retry."""
    return stable_id(F.lit("item"), "patient_id", "medication_id", *named_by)


def _with_held(rows: DataFrame, order: list[str], segments: int | None) -> DataFrame:
    """`rows` with the item that their pair holds before each, `_held`."""
    spark, kind = rows.sparkSession, ItemMaps()
    written = scratch_path(spark, "list_changes")
    rows.write.parquet(written)
    rows = spark.read.schema(rows.schema).parquet(written)
    segments = segments or segment_count(rows)
    cut = in_ranges(rows, ["_pair"], order, segments)
    sort, schema, path = ["_pair", *order], kind.schema(["seg"]), scratch_path(spark, "item_maps")

    def changes_of(table: pa.Table, a: int, b: int):
        return zip(table.column("_adds")[a:b].to_pylist(), table.column("_drops")[a:b].to_pylist(), strict=True)

    def make(group: tuple, table: pa.Table) -> pa.Table:
        table, cuts = in_order(table, sort)
        keys, a = table.column("_pair"), cuts[-2]
        found = item_map(keys[0].as_py(), keys[-1].as_py(), table.column("_stored")[a].as_py(), changes_of(table, a, cuts[-1]))
        return pa.Table.from_batches([kind.rows(found, (group[0].as_py(),), schema)])

    cut.select("_seg", *sort, "_stored", "_adds", "_drops").groupBy("_seg").applyInArrow(make, schema).write.parquet(path)
    maps = spark.read.schema(schema).parquet(path)
    # the driver sees one row per range
    entering = {r["seg"]: r["id"] for r in entering_states(maps, segments, kind).collect()}

    def walk(group: tuple, table: pa.Table) -> pa.Table:
        table, cuts = in_order(table, sort)
        seg, held = group[0].as_py(), []
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            start = entering[seg] if k == 0 and seg in entering else table.column("_stored")[a].as_py()
            held += held_before(start, changes_of(table, a, b))
        return table.append_column("_held", pa.array(held, pa.string()))

    return cut.groupBy("_seg").applyInArrow(walk, T.StructType([*cut.schema.fields, T.StructField("_held", T.StringType())]))


def apply_list_changes(items: DataFrame, outcomes: DataFrame, order: list[str], at: str) -> DataFrame:
    """The list after all changes; `at` is the time column of a change.

    An id belongs to one item, from its add to its remove, so the last add, remove and update of each id decide.
    """
    place = F.struct(*order)

    def last(code: str, value: Column) -> Column:
        return F.max_by(value, F.when(F.col("code") == code, place))

    pair = F.struct("patient_id", "medication_id", F.col(at).alias("at"))
    effect = (
        outcomes.where(F.col("target_id").isNotNull())
        .groupBy(F.col("target_id").alias("_id"))
        .agg(
            last("ADDED", pair).alias("_a"),
            F.max(F.col("code") == "REMOVED").alias("_gone"),
            last("UPDATED", F.struct("status", "notes", F.col(at).alias("at"))).alias("_u"),
        )
    )
    listed = items.withColumn("id", F.col("id").cast("string"))
    fresh, touched = F.col("_a").isNotNull(), F.col("_u").isNotNull()
    base = lambda c, d: F.when(fresh, d).otherwise(F.col(c))
    have = set(items.columns)
    return (
        listed.join(effect, F.col("id") == F.col("_id"), "full_outer")
        .where(~F.coalesce("_gone", F.lit(False)))
        .select(
            F.coalesce("id", "_id").alias("id"),
            base("patient_id", F.col("_a.patient_id")).alias("patient_id"),
            base("medication_id", F.col("_a.medication_id")).alias("medication_id"),
            F.when(touched, F.col("_u.status")).otherwise(base("status", F.lit("active"))).alias("status"),
            F.when(touched, F.col("_u.notes")).otherwise(base("notes", F.lit(None).cast("string"))).alias("notes"),
            *[F.when(~fresh, F.col(c)).alias(c) for c in ("started_at", "stopped_at") if c in have],
            base("created_at", F.col("_a.at")).alias("created_at"),
            F.when(touched, F.col("_u.at")).otherwise(base("updated_at", F.col("_a.at"))).alias("updated_at"),
        )
    )


def list_with_medication(items: DataFrame, meds: DataFrame) -> DataFrame:
    """Items with their medication, inactive ones included."""
    names = meds.select(F.col("id").alias("medication_id"), "generic_name", "brand_name", "drug_class")
    return items.join(names, "medication_id")


def medication_list(items: DataFrame, meds: DataFrame) -> DataFrame:
    """Items as shown: blank notes for null, and nothing claimed about safety."""
    nothing = F.lit(None).cast("string")
    no_texts = F.array().cast("array<string>")
    code, label = D.ASSESSMENT_FACTOR
    return list_with_medication(items, meds).select(
        "id",
        "patient_id",
        "medication_id",
        "generic_name",
        "brand_name",
        "drug_class",
        "status",
        F.coalesce("notes", F.lit("")).alias("notes"),
        "created_at",
        "updated_at",
        F.struct(
            F.lit(D.SAFETY_STATUS).alias("status"),
            nothing.alias("source"),
            F.lit(D.SAFETY_SOURCE_TYPE).alias("source_type"),
            F.lit(None).cast("timestamp").alias("last_updated"),
            no_texts.alias("forms"),
            F.lit(D.SAFETY_DOSAGE).alias("dosage_information"),
            no_texts.alias("side_effects"),
        ).alias("safety"),
        F.struct(
            F.lit(None).cast("int").alias("score"),
            F.lit(D.ASSESSMENT_LEVEL).alias("level"),
            F.lit(D.ASSESSMENT_LABEL).alias("label"),
            F.lit(D.ASSESSMENT_CONFIDENCE).alias("confidence"),
            F.array(F.struct(F.lit(code).alias("code"), F.lit(label).alias("label"))).alias("factors"),
            F.lit(True).alias("informational_only"),
        ).alias("assessment"),
    )


def list_by_created(items: DataFrame) -> DataFrame:
    """Position of each item in its patient's list, oldest first."""
    return with_position(items, ["patient_id"], ["created_at", "id"])


def owned_by(items: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests that name an item of their own patient."""
    own = items.select(F.col("id").alias("item_id"), "patient_id")
    return requests.join(own, ["item_id", "patient_id"], "left_semi")


def split_new_and_known(incoming: DataFrame, saved: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """`known` tells whether the key of a row is saved already; keys compare as given.

    The saved side is one row per key, so the join only adds a flag.
    """
    have = saved.select(*[c.alias(f"_saved{k}") for k, c in keys.items()]).distinct().withColumn("_known", F.lit(True))
    # The keys of incoming rows are made for the join alone and not carried beside what they are made of.
    same = reduce(and_, [c == F.col(f"_saved{k}") for k, c in keys.items()])
    joined = incoming.join(have, same, "left").withColumn("known", F.coalesce("_known", F.lit(False)))
    return joined.drop("_known", *keys, *[f"_saved{k}" for k in keys])


def gene_key() -> dict[str, Column]:
    return {"_patient": F.col("patient_id"), "_gene": match_key("gene")}
