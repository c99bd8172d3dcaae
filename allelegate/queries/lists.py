"""Medication list, search and profile queries."""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import functions as F

from allelegate.functions import shapes as X
from allelegate.operators import lists as L
from allelegate.operators import match as M
from allelegate.operators import search as S
from allelegate.operators.search_index import SearchIndex
from allelegate.plans.fixtures import read_sql, view
from allelegate.plans.session import scratch_path
from allelegate.queries import query
from allelegate.queries.match import RUN_TS, run_ts

TS = f"timestamp '{RUN_TS}'"
ORDER = ["ts", "event_id"]
UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"
PATIENT_OK = f"regexp_full_match(lower(c.patient_id), '{UUID}')"
STATUS_OK = "trim(c.status) in ('active', 'past', 'considering') and length(coalesce(c.notes, '')) <= 500"


def inputs(spark, sf, op):
    return read_sql(spark, sf, f"select * from fx_changes where op = '{op}'"), view(spark, sf, "fx_items")


ADDS = f"""
    base as (
      select c.*, case when not {PATIENT_OK} then 'INVALID_INPUT' when m.id is null then 'MEDICATION_NOT_FOUND'
          when i.id is not null then 'DUPLICATE_MEDICATION' end as early
      from fx_changes c left join fx_list_meds m on m.id = c.medication_id and m.is_active
      left join fx_items i on i.patient_id = c.patient_id and i.medication_id = c.medication_id
      where c.op = 'add'),
    outcome as (
      select event_id, patient_id, medication_id,
        coalesce(early, case when row_number() over (partition by patient_id, medication_id, early
          order by ts, event_id) > 1 then 'DUPLICATE_MEDICATION' end) as code from base)"""


@query(
    "list_adds",
    f"""with {ADDS} select event_id, patient_id, medication_id, code, code is null as supported,
        case code when 'INVALID_INPUT' then 'Patient and medication are required.'
          when 'MEDICATION_NOT_FOUND' then 'The medication was not found.'
          when 'DUPLICATE_MEDICATION' then 'This medication is already in your list.'
          else 'Medication added.' end as message from outcome""",
)
def list_adds(spark, sf):
    requests, items = inputs(spark, sf, "add")
    out = L.add_outcomes(requests, items, view(spark, sf, "fx_list_meds"), ORDER)
    return out.select("event_id", "patient_id", "medication_id", "code", "supported", "message")


@query(
    "list_after_adds",
    f"""with {ADDS}
        select id, patient_id, medication_id, status, notes, created_at, updated_at from fx_items
        union all
        select md5(concat_ws('|', 'item', patient_id, medication_id)), patient_id, medication_id, 'active', null, {TS}, {TS}
        from outcome where code is null""",
)
def list_after_adds(spark, sf):
    requests, items = inputs(spark, sf, "add")
    out = L.add_outcomes(requests, items, view(spark, sf, "fx_list_meds"), ORDER)
    return L.apply_list_adds(items, out, run_ts())


UPDATES = f"""
    outcome as (
      select c.event_id, c.ts, c.item_id, c.patient_id, trim(c.status) as status,
        nullif(trim(coalesce(c.notes, '')), '') as notes,
        case when not ({PATIENT_OK} and {STATUS_OK}) then 'INVALID_INPUT' when i.id is null then 'NOT_FOUND' end as code
      from fx_changes c left join fx_items i on i.id = c.item_id and i.patient_id = c.patient_id where c.op = 'update')"""


@query(
    "list_updates",
    f"""with {UPDATES} select event_id, item_id, patient_id, status, notes, code, code is null as supported,
        case code when 'INVALID_INPUT' then 'Choose a valid status and keep notes under 500 characters.'
          when 'NOT_FOUND' then 'Medication list item was not found.' else 'Medication updated.' end as message
        from outcome""",
)
def list_updates(spark, sf):
    updates, items = inputs(spark, sf, "update")
    out = L.update_outcomes(updates, items)
    return out.select("event_id", "item_id", "patient_id", "status", "notes", "code", "supported", "message")


@query(
    "list_after_updates",
    f"""with {UPDATES},
        last as (select * from (select *, row_number() over (partition by item_id order by ts desc, event_id desc) as rn
          from outcome where code is null) x where rn = 1)
        select i.id, i.patient_id, i.medication_id, coalesce(u.status, i.status) as status,
          case when u.event_id is null then i.notes else u.notes end as notes, i.created_at,
          case when u.event_id is null then i.updated_at else {TS} end as updated_at
        from fx_items i left join last u on u.item_id = i.id""",
)
def list_after_updates(spark, sf):
    updates, items = inputs(spark, sf, "update")
    return L.apply_list_updates(items, L.update_outcomes(updates, items), ORDER, run_ts())


REMOVES = f"""
    base as (
      select c.event_id, c.ts, c.item_id, c.patient_id, {PATIENT_OK} as ok, i.id is not null as found
      from fx_changes c left join fx_items i on i.id = c.item_id and i.patient_id = c.patient_id where c.op = 'remove'),
    outcome as (
      select event_id, item_id, patient_id, case when not ok then 'INVALID_INPUT'
        when not found or row_number() over (partition by item_id, patient_id, ok and found order by ts, event_id) > 1
          then 'NOT_FOUND' end as code
      from base)"""


@query(
    "list_removes",
    f"""with {REMOVES} select event_id, item_id, patient_id, code, code is null as supported,
        case code when 'INVALID_INPUT' then 'A valid medication list item is required.'
          when 'NOT_FOUND' then 'Medication list item was not found.' else 'Medication removed.' end as message
        from outcome""",
)
def list_removes(spark, sf):
    removes, items = inputs(spark, sf, "remove")
    out = L.remove_outcomes(removes, items, ORDER)
    return out.select("event_id", "item_id", "patient_id", "code", "supported", "message")


@query(
    "list_after_removes",
    f"""with {REMOVES} select i.* from fx_items i
        where i.id not in (select item_id from outcome where code is null)""",
)
def list_after_removes(spark, sf):
    removes, items = inputs(spark, sf, "remove")
    return L.apply_list_removes(items, L.remove_outcomes(removes, items, ORDER))


CHANGES = f"""
    base as (
      select c.*, trim(c.status) as new_status, nullif(trim(coalesce(c.notes, '')), '') as new_notes, m.id is not null as known,
        md5(concat_ws('|', 'item', c.patient_id, c.medication_id, cast(c.event_id as varchar))) as new_id
      from fx_item_changes c left join fx_list_meds m on m.id = c.medication_id and m.is_active),
    owners as (
      select id as item_id, patient_id, medication_id as own from fx_items
      union select new_id, patient_id, medication_id from base where op = 'add'),
    named as (
      select b.*, o.own, case when b.op in ('update', 'remove') then o.own else b.medication_id end as med
      from base b left join owners o on o.item_id = b.item_id and o.patient_id = b.patient_id),
    checked as (
      select c.*, case when not {PATIENT_OK} or c.op not in ('add', 'update', 'remove') then 'INVALID_INPUT'
          when c.op in ('update', 'remove') and own is null and not regexp_full_match(lower(c.item_id), '{UUID}') then 'INVALID_INPUT'
          when c.op = 'update' and not ({STATUS_OK}) then 'INVALID_INPUT'
          when c.op = 'add' and not known then 'MEDICATION_NOT_FOUND' end as bad,
        row_number() over (partition by c.patient_id, c.med order by c.ts, c.event_id) as n
      from named c),
    fold as (
      select k.patient_id, k.med, cast(0 as bigint) as n, i.id as held
      from (select distinct patient_id, med from checked) k
      left join fx_items i on i.patient_id = k.patient_id and i.medication_id = k.med
      union all
      select c.patient_id, c.med, c.n, case when c.bad is null and c.op = 'add' and f.held is null then c.new_id
          when c.bad is null and c.op = 'remove' and f.held = c.item_id then null else f.held end
      from fold f join checked c on c.patient_id = f.patient_id and c.med is not distinct from f.med and c.n = f.n + 1),
    outcome as (
      select c.*, coalesce(c.bad, case when c.op = 'add' then case when f.held is null then 'ADDED' else 'DUPLICATE_MEDICATION' end
          when f.held is distinct from c.item_id then 'NOT_FOUND' when c.op = 'update' then 'UPDATED' else 'REMOVED' end) as code
      from checked c join fold f on c.patient_id = f.patient_id and c.med is not distinct from f.med and c.n = f.n + 1)"""


def changed(spark, sf):
    items, meds = view(spark, sf, "fx_items"), view(spark, sf, "fx_list_meds")
    return items, L.change_outcomes(view(spark, sf, "fx_item_changes"), items, meds, ORDER, named_by=["event_id"])


@query("list_change_outcomes", f"with recursive {CHANGES} select event_id, patient_id, medication_id, item_id, op, code from outcome")
def list_change_outcomes(spark, sf):
    return changed(spark, sf)[1].select("event_id", "patient_id", "medication_id", "item_id", "op", "code")


@query(
    "list_changes",
    f"""with recursive {CHANGES},
        listed as (
          select id, patient_id, medication_id, status, notes, created_at, updated_at from fx_items
          union all
          select new_id, patient_id, medication_id, 'active', null, ts, ts from outcome where code = 'ADDED'),
        updated as (
          select * from (select item_id, new_status, new_notes, ts, row_number() over (
              partition by item_id order by ts desc, event_id desc) as rn from outcome where code = 'UPDATED') x where rn = 1)
        select l.id, l.patient_id, l.medication_id, coalesce(u.new_status, l.status) as status,
          case when u.item_id is null then l.notes else u.new_notes end as notes, l.created_at,
          coalesce(u.ts, l.updated_at) as updated_at
        from listed l left join updated u on u.item_id = l.id
        where l.id not in (select item_id from outcome where code = 'REMOVED')""",
)
def list_changes(spark, sf):
    items, outcomes = changed(spark, sf)
    return L.apply_list_changes(items, outcomes, ORDER, "ts")


@query(
    "medication_list",
    """select l.id, l.patient_id, l.medication_id, m.generic_name, m.brand_name, m.drug_class, l.status,
        coalesce(l.notes, '') as notes, l.created_at, l.updated_at, 'not_evaluated' as safety_status,
        'Not evaluated from a verified source.' as dosage, cast(null as integer) as score, 'unknown' as level,
        'VERIFIED_SAFETY_DATA_UNAVAILABLE' as factor
        from fx_list l join fx_meds m on m.id = l.medication_id""",
)
def medication_list(spark, sf):
    shown = L.medication_list(view(spark, sf, "fx_list"), view(spark, sf, "fx_meds"))
    flat = shown.withColumns(
        {
            "safety_status": F.col("safety.status"),
            "dosage": F.col("safety.dosage_information"),
            "score": F.col("assessment.score"),
            "level": F.col("assessment.level"),
            "factor": F.col("assessment.factors")[0]["code"],
        }
    )
    return flat.drop("safety", "assessment")


@query(
    "list_with_medication",
    """select l.id, l.patient_id, l.medication_id, m.generic_name, m.brand_name, m.drug_class
        from fx_list l join fx_meds m on m.id = l.medication_id""",
)
def list_with_medication(spark, sf):
    rows = L.list_with_medication(view(spark, sf, "fx_list"), view(spark, sf, "fx_meds"))
    return rows.select("id", "patient_id", "medication_id", "generic_name", "brand_name", "drug_class")


@query(
    "list_by_created",
    """select id, patient_id, row_number() over (partition by patient_id order by created_at, id) as position
        from fx_list""",
)
def list_by_created(spark, sf):
    return L.list_by_created(view(spark, sf, "fx_list")).select("id", "patient_id", "position")


@query(
    "owned_by",
    """select c.event_id, c.item_id, c.patient_id from fx_changes c
        join fx_items i on i.id = c.item_id and i.patient_id = c.patient_id""",
)
def owned_by(spark, sf):
    rows = L.owned_by(view(spark, sf, "fx_items"), view(spark, sf, "fx_changes"))
    return rows.select("event_id", "item_id", "patient_id")


@query(
    "split_new_and_known",
    """with known as (select distinct patient_id, lower(trim(gene)) as gk from fx_pgx)
        select i.*, k.gk is not null as known from fx_pgx_in i
        left join known k on k.patient_id = i.patient_id and k.gk = lower(trim(i.gene))""",
)
def split_new_and_known(spark, sf):
    return L.split_new_and_known(view(spark, sf, "fx_pgx_in"), view(spark, sf, "fx_pgx"), L.gene_key())


@query(
    "shape_records",
    """select x.id as pgx_result_id, x.gene, x.phenotype, x.source, m.id as medication_id, m.generic_name as "genericName",
        m.brand_name as "brandName", m.drug_class as "drugClass"
        from fx_store_pgx x join fx_meds m on m.id = x.patient_id""",
)
def shape_records(spark, sf):
    meds = view(spark, sf, "fx_meds").select(X.shape(X.MEDICATION).alias("medication"))
    results = view(spark, sf, "fx_store_pgx").select("patient_id", X.shape(X.RESULT).alias("result"))
    joined = results.join(meds, F.col("patient_id") == F.col("medication.id"))
    return joined.select(
        F.col("result.id").alias("pgx_result_id"),
        "result.gene",
        "result.phenotype",
        "result.source",
        F.col("medication.id").alias("medication_id"),
        "medication.genericName",
        "medication.brandName",
        "medication.drugClass",
    )


@query(
    "shape_list_items",
    """select l.patient_id, l.id, l.medication_id as "medicationId", m.generic_name as "genericName", l.status,
        coalesce(l.notes, '') as notes, l.created_at as "createdAt"
        from fx_list l join fx_meds m on m.id = l.medication_id""",
)
def shape_list_items(spark, sf):
    shown = L.medication_list(view(spark, sf, "fx_list"), view(spark, sf, "fx_meds"))
    items = shown.select("patient_id", X.shape(X.LIST_ITEM).alias("i"))
    return items.select("patient_id", *[F.col(f"i.{c}") for c in ("id", "medicationId", "genericName", "status", "notes", "createdAt")])


_indexes: WeakKeyDictionary = WeakKeyDictionary()


def stored_index(spark, sf) -> SearchIndex:
    """The index of a folder's medications, built by the first search of a session and then read."""
    kept = _indexes.setdefault(spark, {})
    if sf not in kept:
        kept[sf] = SearchIndex.built(view(spark, sf, "fx_meds"), scratch_path(spark, "search_index"))
    return kept[sf]


@query(
    "search_index",
    """with m as (
          select id, lower(generic_name) as a, lower(coalesce(brand_name, '')) as b from fx_meds where is_active),
        t as (
          select id, substring(a, i, k) as token from m, range(1, 400) p(i), range(1, 4) s(k) where i + k - 1 <= length(a)
          union select id, substring(b, i, k) from m, range(1, 400) p(i), range(1, 4) s(k) where i + k - 1 <= length(b)
          union select id, concat('length ...', cast(k as varchar)) from m, range(-1, 31) s(k)
          where k = -1 or greatest(length(a), length(b)) >= power(2, k))
        select token, count(*) as n from t group by token""",
)
def search_index(spark, sf):
    """Tokens of a new index with the number of names that hold them."""
    return SearchIndex.built(view(spark, sf, "fx_meds"), scratch_path(spark, "search_index")).tokens


@query(
    "search_top10",
    """with q as (select distinct trim(query) as query from fx_queries),
        hit as (select q.query, m.id, m.generic_name, m.brand_name, m.drug_class,
            row_number() over (partition by q.query order by m.generic_name, m.id) as position
          from q join fx_meds m on m.is_active and q.query <> ''
            and (m.generic_name ilike concat('%', q.query, '%') or m.brand_name ilike concat('%', q.query, '%')))
        select q.query, h.id is not null as supported,
          case when q.query = '' then 'Enter a medication name to search.'
            when h.id is null then 'This medication is not supported in the MVP yet.' end as message,
          h.position, h.id, h.generic_name, h.brand_name, h.drug_class
        from q left join hit h on h.query = q.query and h.position <= 10""",
)
def search_top10(spark, sf):
    found = S.search_medications(view(spark, sf, "fx_meds"), view(spark, sf, "fx_queries"), index=stored_index(spark, sf))
    return found.withColumn("position", F.col("position").cast("bigint"))


@query("name_contains", "select * from fx_meds where generic_name ilike '%ING 1_%' or brand_name ilike '%ING 1_%'")
def name_contains(spark, sf):
    return S.name_contains(view(spark, sf, "fx_meds"), "ING 1_")


@query(
    "results_by_gene",
    "select id, patient_id, gene, row_number() over (partition by patient_id order by gene, id) as position from fx_pgx",
)
def results_by_gene(spark, sf):
    return S.results_by_gene(view(spark, sf, "fx_pgx")).select("id", "patient_id", "gene", "position")


@query(
    "gene_profile",
    """with asked as (select distinct patient_id from fx_requests)
        select a.patient_id, p.id is not null as supported,
          case when a.patient_id is null then 'Provide a patientId.' when p.id is null then 'Patient was not found.' end
            as message,
          case when x.id is not null then row_number() over (partition by a.patient_id order by x.gene, x.id) end as position,
          x.id as pgx_result_id, x.gene, x.phenotype, x.genotype
        from asked a left join fx_patients p on p.id = a.patient_id left join fx_pgx x on x.patient_id = p.id""",
)
def gene_profile(spark, sf):
    return S.gene_profile(view(spark, sf, "fx_requests"), view(spark, sf, "fx_patients"), view(spark, sf, "fx_pgx"))


@query(
    "phenotype_options",
    """select x.id, x.gene, x.phenotype, d.phenotype is not null as allowed,
          coalesce(d.phenotype, f.phenotype, x.phenotype) as choice
        from fx_pgx x left join fx_dom d on d.gene = x.gene and d.phenotype = x.phenotype
        left join (select gene, arg_min(phenotype, idx) as phenotype from fx_dom group by gene) f on f.gene = x.gene""",
)
def phenotype_options(spark, sf):
    rows = S.phenotype_options(view(spark, sf, "fx_pgx"), view(spark, sf, "fx_dom"))
    return rows.select("id", "gene", "phenotype", "allowed", "choice")


@query(
    "history_latest",
    """select id, patient_id, risk_level, created_at, position from (
          select *, row_number() over (partition by patient_id order by created_at desc, id) as position from fx_history) t
        where position <= 5""",
)
def history_latest(spark, sf):
    return M.latest_history(view(spark, sf, "fx_history"), 5).select(
        "id", "patient_id", "risk_level", "created_at", "position"
    )


@query("history_newest_first", "select id, patient_id, medication_id, risk_level, created_at from fx_history")
def history_newest_first(spark, sf):
    rows = view(spark, sf, "fx_history").select("id", "patient_id", "medication_id", "risk_level", "created_at")
    return M.history_newest_first(rows)


