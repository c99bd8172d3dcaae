"""Merge and consolidation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelegate.operators import consolidate as C
from allelegate.operators import merge as G
from allelegate.operators.audit import check_unique
from allelegate.operators.ingest import run_ingest as ingest
from allelegate.plans.fixtures import read_sql, view
from allelegate.queries import query
from allelegate.queries.match import RUN_TS, run_ts
from allelegate.queries.staging import ORDER, ORDER_SQL, SOURCE_ORD, three_sources

TS = f"timestamp '{RUN_TS}'"

VALUES = (
    "risk_level, patient_summary, clinician_summary, recommended_action, evidence_source, evidence_url, "
    "rule_version, review_status"
).split(", ")


def merged_meds(source: str) -> str:
    return f"""
    inc as (select *, row_number() over (order by {{order}}) as seq from {source}),
    new_med as (
      select medication_generic_name as generic_name,
        arg_max(brand_name, seq) filter (where brand_name is not null) as brand_name,
        arg_max(drug_class, seq) filter (where drug_class is not null) as drug_class
      from inc group by 1),
    meds as (
      select coalesce(t.generic_name, n.generic_name) as generic_name,
        coalesce(t.id, md5(concat('medication|', n.generic_name))) as id,
        coalesce(n.brand_name, t.brand_name) as brand_name, coalesce(n.drug_class, t.drug_class) as drug_class,
        case when n.generic_name is not null then true else t.is_active end as is_active,
        coalesce(t.created_at, {TS}) as created_at, coalesce(t.updated_at, {TS}) as updated_at
      from fx_store_meds t full join new_med n on n.generic_name = t.generic_name)"""


PICK = ", ".join(f"case when take then n_{v} else t_{v} end as {v}" for v in VALUES)
MERGED_RULES = f"""
    best as (
      select m.id as medication_id, i.gene, i.phenotype, {', '.join('i.' + v for v in VALUES)},
        row_number() over (partition by m.id, i.gene, i.phenotype
          order by (i.review_status = 'approved') desc, i.seq desc) as rn
      from inc i join meds m on m.generic_name = i.medication_generic_name),
    met as (
      select coalesce(t.medication_id, n.medication_id) as medication_id, coalesce(t.gene, n.gene) as gene,
        coalesce(t.phenotype, n.phenotype) as phenotype, t.id as t_id, t.imported_at, t.created_at, t.updated_at,
        {', '.join(f't.{v} as t_{v}, n.{v} as n_{v}' for v in VALUES)},
        n.medication_id is not null and (t.id is null or t.review_status <> 'approved' or n.review_status = 'approved')
          as take
      from fx_store_rules t full join (select * from best where rn = 1) n
        on n.medication_id = t.medication_id and n.gene = t.gene and n.phenotype = t.phenotype),
    rules as (
      select medication_id, gene, phenotype,
        coalesce(t_id, md5(concat_ws('|', 'rule', medication_id, gene, phenotype))) as id, {PICK},
        case when take then coalesce(imported_at, {TS}) else imported_at end as imported_at,
        coalesce(created_at, {TS}) as created_at, case when take then {TS} else updated_at end as updated_at
      from met)"""


@query("upsert_medications", f"with {merged_meds('fx_norm').format(order=ORDER_SQL)} select * from meds")
def upsert_medications(spark, sf):
    return G.upsert_medications(view(spark, sf, "fx_store_meds"), view(spark, sf, "fx_norm"), ORDER, run_ts())


@query("upsert_rules", f"with {merged_meds('fx_norm').format(order=ORDER_SQL)}, {MERGED_RULES} select * from rules")
def upsert_rules(spark, sf):
    incoming = view(spark, sf, "fx_norm")
    meds = G.upsert_medications(view(spark, sf, "fx_store_meds"), incoming, ORDER, run_ts())
    return G.upsert_rules(view(spark, sf, "fx_store_rules"), incoming, meds, ORDER, run_ts())


@query(
    "gated_last",
    f"""with i as (select *, row_number() over (partition by medication_generic_name, gene, phenotype
          order by (review_status = 'approved') desc, {', '.join(c + ' desc' for c in ORDER)}) as rn from fx_norm)
        select medication_generic_name, gene, phenotype, risk_level, review_status, patient_summary from i where rn = 1""",
)
def gated_last(spark, sf):
    keys = ["medication_generic_name", "gene", "phenotype"]
    return G.gated_last(view(spark, sf, "fx_norm"), keys, ["risk_level", "review_status", "patient_summary"], ORDER)


PREPARED = f"""
    src as (select *, {SOURCE_ORD} as ord_source from fx_norm),
    sq as (select *, row_number() over (order by ord_source, {ORDER_SQL}) as place from src),
    ranked as (select *,
        row_number() over (partition by medication_generic_name, gene, phenotype, evidence_source order by place desc) as rn,
        min(place) over (partition by medication_generic_name, gene, phenotype, evidence_source) as first_place
      from sq),
    prepared as (select * from ranked where rn = 1)"""


@query(
    "run_ingest",
    f"with {PREPARED}, {merged_meds('prepared').format(order='first_place')}, {MERGED_RULES} select * from rules",
)
def run_ingest(spark, sf):
    out = ingest(
        three_sources(spark, sf), ORDER, view(spark, sf, "fx_store_meds"), view(spark, sf, "fx_store_rules"), run_ts()
    )
    return out["drug_gene_rules"]


@query(
    "run_ingest_medications",
    f"with {PREPARED}, {merged_meds('prepared').format(order='first_place')} select * from meds",
)
def run_ingest_medications(spark, sf):
    out = ingest(
        three_sources(spark, sf), ORDER, view(spark, sf, "fx_store_meds"), view(spark, sf, "fx_store_rules"), run_ts()
    )
    return out["medications"]


IN_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
CHECKED = f"""
    checked as (
      select i.*, trim(i.gene) as g, trim(i.phenotype) as ph, nullif(trim(coalesce(i.genotype, '')), '') as gt,
        case when i.patient_id is null then 'Provide a patientId.'
          when trim(i.gene) = '' or trim(i.phenotype) = '' then 'Provide both gene and phenotype.'
          when p.id is null then 'Patient was not found.' else 'saved' end as outcome
      from fx_pgx_in i left join fx_patients p on p.id = i.patient_id)"""
UPSERT_PGX = f"""
    with {CHECKED},
    last as (select * from (
        select *, row_number() over (partition by patient_id, g order by {', '.join(c + ' desc' for c in IN_ORDER)}) as rn
        from checked where outcome = 'saved') t where rn = 1)
    select coalesce(t.patient_id, n.patient_id) as patient_id, coalesce(t.gene, n.g) as gene,
      coalesce(t.id, md5(concat_ws('|', 'pgx', cast(n.patient_id as varchar), n.g))) as id,
      coalesce(n.ph, t.phenotype) as phenotype,
      case when n.patient_id is not null then n.gt else t.genotype end as genotype,
      coalesce(t.source, 'manual_entry') as source, coalesce(t.created_at, {TS}) as created_at,
      case when n.patient_id is not null then {TS} else t.updated_at end as updated_at
    from fx_store_pgx t full join last n on n.patient_id = t.patient_id and n.g = t.gene"""


@query("upsert_pgx", UPSERT_PGX)
def upsert_pgx(spark, sf):
    checked = G.checked_results(view(spark, sf, "fx_pgx_in"), view(spark, sf, "fx_patients"))
    return G.upsert_pgx(view(spark, sf, "fx_store_pgx"), checked, IN_ORDER, run_ts())


@query(
    "upsert_pgx_outcomes",
    f"with {CHECKED} select {', '.join(IN_ORDER)}, patient_id, g as gene, ph as phenotype, gt as genotype, outcome from checked",
)
def upsert_pgx_outcomes(spark, sf):
    checked = G.checked_results(view(spark, sf, "fx_pgx_in"), view(spark, sf, "fx_patients"))
    return checked.select(*IN_ORDER, "patient_id", "gene", "phenotype", "genotype", "outcome")


# The oldest patient of a user as the least (created_at, id), met again by the user's other patients.
KEPT = """
    oldest as (select user_id, min(struct_pack(since := created_at, id := id)) as kept from fx_patients group by user_id),
    kept as (select p.user_id, p.id as from_id, o.kept.id as kept_id from fx_patients p join oldest o on o.user_id = p.user_id),
    leaving as (select k.from_id, k.kept_id from kept k where k.from_id <> k.kept_id)"""


def mapping(spark, sf):
    return C.canonical_patient(view(spark, sf, "fx_patients"))


@query("canonical_patient", f"with {KEPT} select user_id, from_id, kept_id from kept")
def canonical_patient(spark, sf):
    return mapping(spark, sf)


@query(
    "non_canonical_join",
    f"with {KEPT} select p.*, m.kept_id from fx_pgx p join leaving m on m.from_id = p.patient_id",
)
def non_canonical_join(spark, sf):
    return C.non_canonical_rows(view(spark, sf, "fx_pgx"), mapping(spark, sf))


@query(
    "latest_per_key",
    """select id, patient_id, gene, phenotype, updated_at from (select *, row_number() over (
        partition by patient_id, lower(gene) order by updated_at desc, id) as rn from fx_pgx_raw) t where rn = 1""",
)
def latest_per_key(spark, sf):
    rows = C.latest_per_key(
        view(spark, sf, "fx_pgx_raw"), ["patient_id", F.lower("gene")], [F.desc("updated_at"), F.asc("id")]
    )
    return rows.select("id", "patient_id", "gene", "phenotype", "updated_at")


MERGED_PGX = f"""
    with {KEPT},
    n as (select * from (
        select m.kept_id, p.*, row_number() over (partition by m.kept_id, lower(p.gene)
          order by p.updated_at desc, p.id) as rn
        from fx_store_pgx p join leaving m on m.from_id = p.patient_id) x where rn = 1),
    t as (select p.* from fx_store_pgx p left join leaving m on m.from_id = p.patient_id where m.from_id is null)
    select coalesce(t.patient_id, n.kept_id) as patient_id, coalesce(t.gene, n.gene) as gene,
      coalesce(t.id, md5(concat_ws('|', 'merged', cast(n.kept_id as varchar), n.gene))) as id,
      case when n.id is not null then n.phenotype else t.phenotype end as phenotype,
      case when n.id is not null then n.genotype else t.genotype end as genotype,
      case when n.id is not null then n.source else t.source end as source,
      greatest(t.updated_at, n.updated_at) as updated_at, coalesce(t.created_at, n.created_at) as created_at
    from t full join n on n.kept_id = t.patient_id and n.gene = t.gene"""


@query("merged_pgx", MERGED_PGX)
def merged_pgx(spark, sf):
    return C.merge_pgx(view(spark, sf, "fx_store_pgx"), mapping(spark, sf))


MERGED_LIST = f"""
    with {KEPT},
    n as (select * from (
        select m.kept_id, p.*, row_number() over (partition by m.kept_id, p.medication_id
          order by p.updated_at desc, p.id) as rn
        from fx_list p join leaving m on m.from_id = p.patient_id) x where rn = 1),
    t as (select p.* from fx_list p left join leaving m on m.from_id = p.patient_id where m.from_id is null)
    select coalesce(t.patient_id, n.kept_id) as patient_id, coalesce(t.medication_id, n.medication_id) as medication_id,
      coalesce(t.id, md5(concat_ws('|', 'merged', cast(n.kept_id as varchar), cast(n.medication_id as varchar)))) as id,
      coalesce(n.status, t.status) as status,
      case when t.id is null then n.notes when t.notes is null then n.notes
        when n.notes is null or t.notes = n.notes then t.notes
        else concat(t.notes, chr(10), '[Merged record] ', n.notes) end as notes,
      coalesce(t.started_at, n.started_at) as started_at, coalesce(n.stopped_at, t.stopped_at) as stopped_at,
      coalesce(t.created_at, n.created_at) as created_at, greatest(t.updated_at, n.updated_at) as updated_at
    from t full join n on n.kept_id = t.patient_id and n.medication_id = t.medication_id"""


@query("merged_list", MERGED_LIST)
def merged_list(spark, sf):
    return C.merge_list(view(spark, sf, "fx_list"), mapping(spark, sf))


@query(
    "repointed_history",
    f"""with {KEPT},
        gone as (select distinct p.id from fx_store_pgx p join leaving m on m.from_id = p.patient_id)
        select h.id, coalesce(m.kept_id, h.patient_id) as patient_id, h.medication_id,
          case when g.id is null then h.pgx_result_id end as pgx_result_id, h.rule_id, h.risk_level, h.created_at
        from fx_history h left join leaving m on m.from_id = h.patient_id left join gone g on g.id = h.pgx_result_id""",
)
def repointed_history(spark, sf):
    return C.repoint_history(view(spark, sf, "fx_history"), mapping(spark, sf), view(spark, sf, "fx_store_pgx"))


def tables(spark, sf):
    names = {
        "patients": "fx_patients",
        "pgx_results": "fx_store_pgx",
        "patient_medications": "fx_list",
        "risk_results": "fx_history",
    }
    return {name: view(spark, sf, v) for name, v in names.items()}


@query(
    "remaining_patients",
    f"with {KEPT} select p.* from fx_patients p left join leaving m on m.from_id = p.id where m.from_id is null",
)
def remaining_patients(spark, sf):
    return C.consolidate_patients(tables(spark, sf))["patients"]


@query(
    "shared_users",
    f"""with {KEPT}, states as (select 'before' as state, user_id from fx_patients
          union all select 'after', p.user_id from fx_patients p where not exists (select 1 from leaving m where m.from_id = p.id)),
        shared as (select state, user_id from states where user_id is not null group by state, user_id having count(*) > 1)
        select s.state, count(h.user_id) as n from (values ('before'), ('after')) s(state)
          left join shared h on h.state = s.state group by s.state""",
)
def shared_users(spark, sf):
    """Users with several patients before and after consolidation."""
    before = check_unique(tables(spark, sf)["patients"], ["user_id"])
    after = C.consolidate_patients(tables(spark, sf))["shared_users"]
    count = lambda df, state: df.agg(F.lit(state).alias("state"), F.count("*").alias("n"))
    return count(before, "before").unionByName(count(after, "after"))


# Patients whose name ends in 7 leave; everything they own goes with them.
LEAVING = "select id from fx_patients where first_name like '%7'"


@query(
    "cascade_delete",
    f"""with gone as ({LEAVING}),
        gone_pgx as (select p.id from fx_store_pgx p join gone on gone.id = p.patient_id)
        select 'patients' as kind, cast(p.id as varchar) as id, cast(null as varchar) as link from fx_patients p
          where p.id not in (select id from gone)
        union all
        select 'pgx_results', p.id, null from fx_store_pgx p where p.patient_id not in (select id from gone)
        union all
        select 'patient_medications', l.id, null from fx_list l where l.patient_id not in (select id from gone)
        union all
        select 'risk_results', h.id, case when h.pgx_result_id in (select id from gone_pgx) then null
          else h.pgx_result_id end from fx_history h where h.patient_id not in (select id from gone)""",
)
def cascade_delete(spark, sf):
    return remaining(C.cascade_delete(tables(spark, sf), "patients", read_sql(spark, sf, LEAVING)))


def remaining(left: dict[str, DataFrame]) -> DataFrame:
    """The ids that a delete leaves in each table, and the results that history rows still name."""
    link = {"risk_results": F.col("pgx_result_id")}
    parts = [
        df.select(
            F.lit(name).alias("kind"),
            F.col("id").cast("string").alias("id"),
            link.get(name, F.lit(None)).cast("string").alias("link"),
        )
        for name, df in left.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# Accounts whose number ends in 7 are closed: their sessions, patients and all that these own go too.
CLOSING = "select id from fx_users where id % 10 = 7"


@query(
    "cascade_from_users",
    f"""with closing as ({CLOSING}), gone as (select p.id from fx_patients p join closing c on c.id = p.user_id),
        gone_pgx as (select p.id from fx_store_pgx p join gone on gone.id = p.patient_id)
        select 'users' as kind, cast(u.id as varchar) as id, cast(null as varchar) as link from fx_users u
          where not exists (select 1 from closing c where c.id = u.id)
        union all
        select 'user_sessions', s.id, null from fx_sessions s where not exists (select 1 from closing c where c.id = s.user_id)
        union all
        select 'patients', cast(p.id as varchar), null from fx_patients p where not exists (select 1 from gone g where g.id = p.id)
        union all
        select 'pgx_results', p.id, null from fx_store_pgx p where not exists (select 1 from gone g where g.id = p.patient_id)
        union all
        select 'patient_medications', l.id, null from fx_list l where not exists (select 1 from gone g where g.id = l.patient_id)
        union all
        select 'risk_results', h.id, case when not exists (select 1 from gone_pgx x where x.id = h.pgx_result_id) then h.pgx_result_id end
          from fx_history h where not exists (select 1 from gone g where g.id = h.patient_id)""",
)
def cascade_from_users(spark, sf):
    store = {"users": view(spark, sf, "fx_users"), "user_sessions": view(spark, sf, "fx_sessions"), **tables(spark, sf)}
    return remaining(C.cascade_delete(store, "users", read_sql(spark, sf, CLOSING)))


@query(
    "restricted_delete",
    """with used as (select distinct medication_id from fx_list union select distinct medication_id from fx_rules
          union select distinct medication_id from fx_history)
        select m.id, u.medication_id is not null as restricted from fx_meds m
        left join used u on u.medication_id = m.id where not m.is_active""",
)
def restricted_delete(spark, sf):
    meds = view(spark, sf, "fx_meds")
    asked = meds.where("not is_active").select("id")
    store = {
        "medications": meds,
        "patient_medications": view(spark, sf, "fx_list"),
        "drug_gene_rules": view(spark, sf, "fx_rules"),
        "risk_results": view(spark, sf, "fx_history"),
    }
    held = C.cascade_delete(store, "medications", asked)["restricted"].withColumn("_held", F.lit(True))
    return asked.join(held, "id", "left").select("id", F.coalesce("_held", F.lit(False)).alias("restricted"))
