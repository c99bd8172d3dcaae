"""The driver tables seen as patients, results, medications, rules and changes.

Each view is one SQL text that Spark and DuckDB both run.  Every view reads its
tables whole; where inputs of several kinds are needed, the kind is computed
from a column and no row is left out.
"""

from __future__ import annotations

import re
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

# Oldest date of birth aside, ids keep their numeric form unless text is the point.
VIEWS = {
    # Three patient rows per user.
    "fx_patients": """
        select c_custkey as id, cast(floor(c_custkey / 3) as bigint) as user_id, c_name as first_name,
               min(o_orderdate) as created_at
        from customer join orders on o_custkey = c_custkey
        group by c_custkey, cast(floor(c_custkey / 3) as bigint), c_name""",
    # Every order is one gene result.  Spelling and padding vary; three genes in ten matter to
    # rules.  Results of every eighth customer are filed under the next one, who so has none.
    "fx_pgx_raw": """
        select o_orderkey as id,
          case when o_custkey % 8 = 0 then o_custkey + 1 else o_custkey end as patient_id,
          case o_orderkey % 10 when 0 then 'CYP2C19' when 1 then 'SLCO1B1' when 2 then 'cyp2c19'
            when 3 then 'CYP2D6' when 4 then 'CYP2C9' when 5 then 'VKORC1' when 6 then 'TPMT'
            when 7 then 'DPYD' when 8 then 'UGT1A1' else 'G6PD' end as gene,
          case when o_orderkey % 10 = 1 then
            case cast(floor(o_orderkey / 10) as bigint) % 5 when 0 then 'normal function'
              when 1 then 'possible decreased function' when 2 then 'decreased function'
              when 3 then 'poor function' else 'unknown function' end
          else
            case cast(floor(o_orderkey / 10) as bigint) % 6 when 0 then 'poor metabolizer'
              when 1 then 'Intermediate Metabolizer' when 2 then ' normal metabolizer '
              when 3 then 'rapid metabolizer' when 4 then 'ultrarapid metabolizer'
              else 'indeterminate' end
          end as phenotype,
          case o_orderstatus when 'F' then concat('*', cast(o_orderkey % 5 as string), '/*1') when 'O' then ' '
            else null end as genotype,
          o_orderdate as updated_at
        from orders""",
    "fx_pgx": """
        select id, patient_id, gene, phenotype, genotype, updated_at from (
          select *, row_number() over (partition by patient_id, gene order by updated_at desc, id desc) as rn
          from fx_pgx_raw) t
        where rn = 1""",
    "fx_meds": """
        select p_partkey as id, concat(p_name, ' ', cast(p_partkey as string)) as generic_name,
          case when p_size % 7 = 0 then null else p_brand end as brand_name, p_type as drug_class,
          p_size % 10 <> 0 as is_active
        from part""",
    "fx_dom": """
        select * from (values
          ('CYP2C19', 0, 'poor metabolizer'), ('CYP2C19', 1, 'intermediate metabolizer'),
          ('CYP2C19', 2, 'normal metabolizer'), ('CYP2C19', 3, 'rapid metabolizer'),
          ('CYP2C19', 4, 'ultrarapid metabolizer'), ('SLCO1B1', 5, 'normal function'),
          ('SLCO1B1', 6, 'possible decreased function'), ('SLCO1B1', 7, 'decreased function'),
          ('SLCO1B1', 8, 'poor function')) t(gene, idx, phenotype)""",
    # Which genes a medication of a kind needs: the first, the second, or both.
    "fx_kinds": """
        select k.kind, d.gene, d.idx, d.phenotype
        from (values (0, 'CYP2C19'), (1, 'SLCO1B1'), (2, 'CYP2C19'), (2, 'SLCO1B1')) k(kind, gene)
        join fx_dom d on d.gene = k.gene""",
    "fx_rules": """
        select p_partkey * 10 + idx as id, p_partkey as medication_id, gene, phenotype,
          case (p_partkey + idx) % 4 when 0 then 'low_risk' when 1 then 'caution'
            when 2 then 'potential_concern' else 'insufficient_data' end as risk_level,
          concat('Patient text ', cast(p_partkey * 10 + idx as string)) as patient_summary,
          concat('Clinician text ', cast(p_partkey * 10 + idx as string)) as clinician_summary,
          concat('Action ', cast(idx as string)) as recommended_action,
          'CPIC' as evidence_source,
          case when p_partkey % 11 = 0 then 'pending_review'
            when (p_partkey + idx) % 5 = 0 then 'pending_review'
            when (p_partkey + idx) % 5 = 1 then 'rejected' else 'approved' end as review_status
        from part join fx_kinds on p_partkey % 3 = kind""",
    # Every line item asks about its part for its customer; some ask without or with unknown ids.
    "fx_requests": """
        select l_orderkey as order_id, l_linenumber as line_no,
          case when l_quantity = 1 then null when l_quantity = 50 then -1 - o_custkey else o_custkey end
            as patient_id,
          case when l_quantity = 2 then null when l_quantity = 49 then -1 - l_partkey else l_partkey end
            as medication_id
        from lineitem join orders on o_orderkey = l_orderkey""",
    # Text ids with padding and blanks.
    "fx_requests_text": """
        select l_orderkey as order_id, l_linenumber as line_no,
          case when l_quantity < 3 then '   ' else concat(' ', cast(o_custkey as string), ' ') end as patient_id,
          case when l_quantity > 48 then '' when l_quantity > 46 then 'none'
            else cast(l_partkey as string) end as medication_id
        from lineitem join orders on o_orderkey = l_orderkey""",
    # Staged rule candidates; the seven l_* columns are their input order.
    "fx_stage": """
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity,
          concat(' Med  ', cast(l_partkey as string)) as medication_generic_name,
          case when l_linestatus = 'O' then null else concat('Brand#', cast(l_suppkey as string)) end as brand_name,
          case when l_linenumber % 2 = 0 then null else concat('class ', cast(l_suppkey as string)) end as drug_class,
          case l_suppkey % 2 when 0 then ' cyp2c19' else 'SLCO1B1 ' end as gene,
          case l_linenumber % 3 when 0 then 'Poor  Metabolizer' when 1 then 'poor metabolizer'
            else 'normal function' end as phenotype,
          case l_linenumber % 4 when 0 then 'low_risk' when 1 then 'caution' when 2 then 'potential_concern'
            else ' ' end as risk_level,
          concat('Patient text ', cast(l_orderkey as string)) as patient_summary,
          case when l_tax = 0 then '  ' else concat('Clinician  text ', cast(l_orderkey as string)) end
            as clinician_summary,
          'Action' as recommended_action,
          case l_suppkey % 3 when 0 then 'CPIC' when 1 then 'PharmGKB' else 'custom' end as evidence_source,
          concat('https://example.org/', cast(l_suppkey as string)) as evidence_url,
          'mvp-0.1' as rule_version,
          case l_returnflag when 'A' then 'approved' when 'N' then 'pending_review' else 'rejected' end
            as review_status
        from lineitem""",
    # Ordered list changes, with ids shaped as identifiers; some are malformed, some of another patient.
    "fx_changes": """
        select event_id, ts, user_id,
          case when event_id % 50 = 7 then concat('user-', cast(user_id as string))
            when event_id % 20 = 3 then concat('00000000-0000-4000-8000-', lpad(cast(user_id + 1 as string), 12, '0'))
            else concat('00000000-0000-4000-8000-', lpad(cast(user_id as string), 12, '0')) end as patient_id,
          concat('00000000-0000-4000-9000-',
            lpad(cast(cast(regexp_extract(props, '([0-9]+)', 1) as bigint) % 10 as string), 12, '0')) as medication_id,
          concat('10000000-0000-4000-a000-',
            lpad(cast(user_id * 10 + cast(regexp_extract(props, '([0-9]+)', 1) as bigint) % 10 as string), 12, '0'))
            as item_id,
          case event_type when 'signup' then 'add' when 'click' then 'update' when 'purchase' then 'remove'
            when 'error' then 'noop' else 'view' end as op,
          case when value < 10 then ' past ' when value < 20 then 'considering' when value < 30 then 'unknown'
            else 'active' end as status,
          case when value < 5 then '  ' when value < 15 then null
            else concat(' note ', cast(event_id as string), ' ') end as notes
        from events""",
    # The same changes as a client sends them: two of three updates and removes name the item of the patient's last
    # add of the medication, if there is one, and the others the item that was there before.
    "fx_item_changes": """
        select c.event_id, c.ts, c.patient_id, c.medication_id, c.op, c.status, c.notes,
          case when c.op in ('update', 'remove') and c.event_id % 3 > 0 and a.event_id is not null
            then md5(concat_ws('|', 'item', a.patient_id, a.medication_id, cast(a.event_id as string)))
            else c.item_id end as item_id
        from (select x.*, max(case when op = 'add' then n end) over (
                partition by patient_id, medication_id order by n rows between unbounded preceding and 1 preceding) as before
              from (select y.*, row_number() over (partition by patient_id, medication_id order by ts, event_id) as n
                from fx_changes y) x) c
        left join (select z.*, row_number() over (partition by patient_id, medication_id order by ts, event_id) as n
          from fx_changes z) a
        on a.patient_id = c.patient_id and a.medication_id = c.medication_id and a.n = c.before""",
    # The list that the changes meet: what a patient viewed before.
    "fx_items": """
        select item_id as id, concat('00000000-0000-4000-8000-', lpad(cast(user_id as string), 12, '0')) as patient_id,
          medication_id, 'past' as status, min(notes) as notes, min(ts) as created_at, max(ts) as updated_at
        from fx_changes group by item_id, user_id, medication_id
        having max(case when op = 'view' then 1 else 0 end) = 1""",
    # Search texts: names and brands in either case, nations that match nothing, wildcards and a blank.
    "fx_queries": """
        select upper(p_name) as query from part union all select lower(p_brand) from part
        union all select n_name from nation
        union all select case r_regionkey when 0 then '%' when 1 then '_' when 2 then '   '
          when 3 then '____________________' else 'g_1' end from region""",
    # What an audit asks for: every part with its brand; some names and many rules are not stored.
    "fx_required_meds": """
        select case when p_size = 5 then concat('absent ', cast(p_partkey as string))
            else lower(concat(p_name, ' ', cast(p_partkey as string))) end as generic_name, p_brand as brand_name
        from part""",
    "fx_required_rules": """
        select lower(concat(p_name, ' ', cast(p_partkey as string))) as generic_name, gene, phenotype
        from part join fx_kinds on (p_partkey + p_size) % 3 = kind""",
    "fx_list_meds": """
        select concat('00000000-0000-4000-9000-', lpad(cast(p_partkey as string), 12, '0')) as id,
          generic_name, brand_name, drug_class, is_active
        from part join fx_meds m on m.id = p_partkey""",
    # Current medication list, one item per customer and part they ordered.
    "fx_list": """
        select concat(cast(o_custkey as string), '-', cast(l_partkey as string)) as id,
          o_custkey as patient_id, l_partkey as medication_id,
          case max(l_linenumber) % 3 when 0 then 'active' when 1 then 'past' else 'considering' end as status,
          case when max(l_linenumber) % 4 = 0 then null
            else concat('note ', cast(max(l_linenumber) as string)) end as notes,
          case when min(l_quantity) < 10 then null else min(l_shipdate) end as started_at,
          case when max(l_quantity) > 40 then null else max(l_shipdate) end as stopped_at,
          min(o_orderdate) as created_at, max(o_orderdate) as updated_at
        from lineitem join orders on o_orderkey = l_orderkey
        group by o_custkey, l_partkey""",
    # Stored history, one row per line item, pointing at results and rules that may be gone.
    "fx_history": """
        select concat(cast(l_orderkey as string), '-', cast(l_linenumber as string), '-', cast(l_partkey as string),
            '-', cast(l_suppkey as string), '-', cast(l_extendedprice as string)) as id,
          o_custkey as patient_id, l_partkey as medication_id,
          cast(o_orderkey as string) as pgx_result_id, l_partkey * 10 + l_linenumber as rule_id,
          case l_linenumber % 3 when 0 then 'low_risk' when 1 then 'caution' else 'potential_concern' end
            as risk_level,
          o_orderdate as created_at
        from lineitem join orders on o_orderkey = l_orderkey""",
    # Staged rules after normalization.
    "fx_norm": """
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity,
          lower(trim(replace(medication_generic_name, '  ', ' '))) as medication_generic_name,
          brand_name, drug_class, upper(trim(gene)) as gene, lower(replace(phenotype, '  ', ' ')) as phenotype,
          case when trim(risk_level) = '' then 'insufficient_data' else risk_level end as risk_level,
          patient_summary,
          case when trim(clinician_summary) = '' then 'Pending clinical review.'
            else replace(clinician_summary, '  ', ' ') end as clinician_summary,
          recommended_action, evidence_source, evidence_url, rule_version, review_status
        from fx_stage""",
    # Stored medications and rules before a merge; half of the staged names are known.
    "fx_store_meds": """
        select cast(p_partkey as string) as id,
          concat(case when p_size % 2 = 0 then 'med ' else 'old ' end, cast(p_partkey as string)) as generic_name,
          case when p_size % 7 = 0 then null else p_brand end as brand_name,
          case when p_size % 5 = 0 then null else p_type end as drug_class,
          p_size % 10 <> 0 as is_active,
          timestamp '2020-01-01 00:00:00' as created_at, timestamp '2020-02-01 00:00:00' as updated_at
        from part""",
    "fx_store_rules": """
        select cast(id as string) as id, cast(medication_id as string) as medication_id, gene, phenotype, risk_level,
          patient_summary, clinician_summary, recommended_action, evidence_source,
          cast(null as string) as evidence_url, 'v1.0' as rule_version, review_status,
          case when id % 3 = 0 then null else timestamp '2020-03-01 00:00:00' end as imported_at,
          timestamp '2020-01-01 00:00:00' as created_at, timestamp '2020-02-01 00:00:00' as updated_at
        from fx_rules""",
    # Results entered anew, one per line item, in the order of ship date and the l_* columns.
    "fx_pgx_in": """
        select l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity,
          case when l_quantity = 1 then null when l_quantity = 50 then -1 - o_custkey else o_custkey end as patient_id,
          case l_linenumber when 1 then ' CYP2C19 ' when 2 then 'cyp2c19' when 3 then 'SLCO1B1' when 4 then 'TPMT'
            when 5 then ' ' else 'DPYD' end as gene,
          case l_suppkey % 4 when 0 then 'poor metabolizer' when 1 then ' normal function ' when 2 then 'rapid metabolizer'
            else case when l_linestatus = 'O' then '  ' else 'decreased function' end end as phenotype,
          case l_returnflag when 'A' then ' *1/*2 ' when 'N' then ' ' else null end as genotype
        from lineitem join orders on o_orderkey = l_orderkey""",
    "fx_store_pgx": """
        select cast(id as string) as id, patient_id, gene, phenotype, genotype,
          'lab' as source, updated_at as created_at, updated_at
        from fx_pgx""",
    "fx_sessions": """
        select concat('s-', cast(user_id as string)) as id, user_id, concat('old-', cast(user_id as string)) as token_hash,
          max(ts) + interval 12 hour as expires_at, max(ts) as created_at
        from events group by user_id""",
    "fx_attempts": "select event_id, user_id as subject, ts from events",
    "fx_users": """
        select cast(floor(c_custkey / 3) as bigint) as id,
          concat(' User', cast(cast(floor(c_custkey / 3) as bigint) as string), '@Example.org ') as email,
          min(c_name) as name
        from customer group by cast(floor(c_custkey / 3) as bigint)""",
    "fx_logins": """
        select event_id, user_id, concat('token-', cast(event_id as string)) as token, ts
        from events""",
}


def _needs(name: str) -> list[str]:
    return [v for v in VIEWS if v != name and re.search(rf"\b{v}\b", VIEWS[name])]


def with_views(sql: str) -> str:
    """`sql` with the views it names put before it as common table expressions."""
    order: list[str] = []

    def visit(name: str) -> None:
        for other in _needs(name):
            visit(other)
        if name not in order:
            order.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            visit(name)
    if not order:
        return sql
    heads = ", ".join(f"{n} as ({VIEWS[n]})" for n in order)
    body = sql.strip()
    for word in ("with recursive ", "with "):
        if body.lower().startswith(word):
            return f"{word}{heads}, {body[len(word):]}"
    return f"with {heads} {body}"


_registered: WeakKeyDictionary[SparkSession, dict[str, str]] = WeakKeyDictionary()


def register(spark: SparkSession, sf_dir: str, only: list[str] | None = None) -> None:
    """Base tables as views; a table already registered from this folder is not opened again."""
    seen = _registered.setdefault(spark, {})
    for table in only or BASE:
        if seen.get(table) != sf_dir or not spark.catalog.tableExists(table):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
            seen[table] = sf_dir


def read_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    text = with_views(sql)
    register(spark, sf_dir, [t for t in BASE if re.search(rf"\b(from|join|,)\s+{t}\b", text)])
    # The tables' times have no zone; neither may the literals they meet.
    return spark.sql(text.replace("timestamp '", "timestamp_ntz '"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_sql(spark, sf_dir, f"select * from {name}")
