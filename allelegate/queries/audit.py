"""Constraint and coverage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from allelegate.operators import audit as A
from allelegate.plans import domains as D
from allelegate.plans.fixtures import read_sql, view
from allelegate.queries import query
from allelegate.queries.staging import ORDER, ORDER_SQL


@query(
    "check_unique",
    "select patient_id, gene, count(*) as n_rows from fx_pgx_raw group by patient_id, gene having count(*) > 1",
)
def check_unique(spark, sf):
    return A.check_unique(view(spark, sf, "fx_pgx_raw"), ["patient_id", "gene"])


@query(
    "check_references",
    """select h.id, h.patient_id, h.rule_id from fx_history h left join fx_rules r on r.id = h.rule_id
        where r.id is null""",
)
def check_references(spark, sf):
    bad = A.check_references(view(spark, sf, "fx_history"), "rule_id", view(spark, sf, "fx_rules"))
    return bad.select("id", "patient_id", "rule_id")


@query(
    "check_domains",
    f"""select {ORDER_SQL}, 'risk_level' as faults from fx_stage where risk_level not in
        ('low_risk', 'caution', 'potential_concern', 'insufficient_data')""",
)
def check_domains(spark, sf):
    bad = A.check_domains(
        view(spark, sf, "fx_stage"), {"risk_level": D.RISK_LEVELS, "review_status": D.REVIEW_STATUSES}
    )
    return bad.select(*ORDER, F.array_join("faults", ",").alias("faults"))


@query(
    "check_required",
    """select order_id, line_no, concat_ws(',', case when patient_id is null then 'patient_id' end,
        case when medication_id is null then 'medication_id' end) as faults
        from fx_requests where patient_id is null or medication_id is null""",
)
def check_required(spark, sf):
    bad = A.check_required(view(spark, sf, "fx_requests"), ["patient_id", "medication_id"])
    return bad.select("order_id", "line_no", F.array_join("faults", ",").alias("faults"))


EXISTING = """
    select distinct case event_type when 'signup' then 'users' when 'click' then 'medications'
      when 'view' then 'drug_gene_rules' when 'purchase' then 'patients' else 'patient_medications' end as name
    from events"""


@query(
    "missing_tables",
    f"""select * from (values (0, 'users'), (1, 'medications'), (2, 'drug_gene_rules'), (3, 'patients'),
          (4, 'patient_medications'), (5, 'user_sessions'), (6, 'pgx_results'), (7, 'risk_results')) t(ord, name)
        where name not in ({EXISTING})""",
)
def missing_tables(spark, sf):
    return A.missing_tables(read_sql(spark, sf, EXISTING)).select("ord", "name")


@query(
    "rules_with_medication",
    """select lower(m.generic_name) as generic_name, upper(r.gene) as gene, lower(r.phenotype) as phenotype
        from fx_rules r join fx_meds m on m.id = r.medication_id""",
)
def rules_with_medication(spark, sf):
    return A.rules_with_medication(view(spark, sf, "fx_rules"), view(spark, sf, "fx_meds"))


@query(
    "in_required_set",
    """select m.* from fx_meds m where lower(m.generic_name) in (select generic_name from fx_required_meds)""",
)
def in_required_set(spark, sf):
    return A.in_required_set(
        view(spark, sf, "fx_meds"), view(spark, sf, "fx_required_meds"), {"generic_name": F.lower("generic_name")}
    )


HAVE = """
    have as (select lower(m.generic_name) as generic_name, upper(r.gene) as gene, lower(r.phenotype) as phenotype
      from fx_rules r join fx_meds m on m.id = r.medication_id),
    rule_faults as (select q.* from fx_required_rules q left join have h on h.generic_name = q.generic_name
      and h.gene = q.gene and h.phenotype = q.phenotype where h.gene is null)"""


@query("missing_members", f"with {HAVE} select generic_name, gene, phenotype from rule_faults")
def missing_members(spark, sf):
    have = A.rules_with_medication(view(spark, sf, "fx_rules"), view(spark, sf, "fx_meds"))
    return A.missing_members(view(spark, sf, "fx_required_rules"), have, ["generic_name", "gene", "phenotype"])


AUDIT = f"""
    with {HAVE},
    stored as (select *, row_number() over (partition by lower(generic_name) order by generic_name desc) as rn from fx_meds),
    met as (select q.*, s.id, s.brand_name as stored_brand, s.is_active
      from fx_required_meds q left join stored s on lower(s.generic_name) = q.generic_name and s.rn = 1),
    said as (select 'passed' as kind, 'Required tables exist.' as message
    union all select 'passed', 'MVP medications exist with active rows and IDs.'
      where not exists (select 1 from met where id is null)
    union all select 'passed', concat('Required MVP drug-gene rules exist (',
      cast((select count(*) from fx_required_rules) as varchar), ' phenotype rules).')
      where not exists (select 1 from rule_faults)
    union all select 'failure', concat('Missing MVP medication: ', generic_name, ' / ', brand_name) from met where id is null
    union all select 'failure', concat('Medication has unexpected brand name: ', generic_name, ' / ', brand_name)
      from met where id is not null and lower(coalesce(stored_brand, '')) <> lower(brand_name)
    union all select 'failure', concat('Medication is not active: ', generic_name, ' / ', brand_name)
      from met where id is not null and not is_active
    union all select 'failure', concat('Missing MVP drug-gene rule: ', generic_name, ' + ', gene, ' ', phenotype)
      from rule_faults)
    select * from said
    union all select 'ok', case when count(*) filter (where kind = 'failure') = 0 then 'true' else 'false' end from said"""


def audited(spark, sf, without: str | None = None) -> DataFrame:
    """Names of the tables in the session's catalog, where each required one stands for the driver's view of it."""
    sources = {
        "users": "fx_users", "medications": "fx_meds", "drug_gene_rules": "fx_rules", "patients": "fx_patients",
        "patient_medications": "fx_list", "user_sessions": "fx_sessions", "pgx_results": "fx_pgx", "risk_results": "fx_history",
    }
    for name, source in sources.items():
        view(spark, sf, source).createOrReplaceTempView(name)
    if without:
        spark.catalog.dropTempView(without)
    return A.existing_tables(spark)


@query("audit_coverage", AUDIT)
def audit_coverage(spark, sf):
    views = [view(spark, sf, v) for v in ("fx_required_meds", "fx_required_rules", "fx_meds", "fx_rules")]
    return A.audit_coverage(*views, audited(spark, sf))


@query("audit_missing_table", AUDIT.replace("'passed' as kind, 'Required tables exist.'", "'failure' as kind, 'Missing required tables: user_sessions'"))
def audit_missing_table(spark, sf):
    """A table that no coverage check reads is missing: its name, and all checks of the others."""
    views = [view(spark, sf, v) for v in ("fx_required_meds", "fx_required_rules", "fx_meds", "fx_rules")]
    return A.audit_coverage(*views, audited(spark, sf, without="user_sessions"), go_on=True)


# The stored rules audited against themselves: nothing is missing, so both pass rows show.
FULL_MEDS = "select lower(generic_name) as generic_name, coalesce(brand_name, '') as brand_name from fx_meds"
FULL_RULES = """
    select lower(m.generic_name) as generic_name, upper(r.gene) as gene, lower(r.phenotype) as phenotype
    from fx_rules r join fx_meds m on m.id = r.medication_id"""


@query(
    "audit_complete",
    f"""select 'passed' as kind, 'Required tables exist.' as message
        union all select 'passed', 'MVP medications exist with active rows and IDs.'
        union all select 'passed', concat('Required MVP drug-gene rules exist (',
          cast((select count(*) from ({FULL_RULES}) t) as varchar), ' phenotype rules).')
        union all select 'failure', concat('Medication is not active: ', lower(generic_name), ' / ', coalesce(brand_name, ''))
          from fx_meds where not is_active
        union all select 'ok', case when count(*) = 0 then 'true' else 'false' end from fx_meds where not is_active""",
)
def audit_complete(spark, sf):
    return A.audit_coverage(
        read_sql(spark, sf, FULL_MEDS), read_sql(spark, sf, FULL_RULES), view(spark, sf, "fx_meds"), view(spark, sf, "fx_rules"),
        audited(spark, sf),
    )
