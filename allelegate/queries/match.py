"""Risk matching queries."""

from __future__ import annotations

import textwrap

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelegate.functions import shapes as X
from allelegate.operators import match as M
from allelegate.plans.fixtures import view
from allelegate.queries import query

RUN_TS = "2026-01-01 00:00:00"


def run_ts():
    return F.lit(RUN_TS).cast("timestamp_ntz")


def inputs(spark, sf, requests="fx_requests"):
    return tuple(view(spark, sf, v) for v in (requests, "fx_patients", "fx_meds", "fx_rules", "fx_pgx"))


def flat(decided: DataFrame) -> DataFrame:
    """Arrays and structs as plain columns."""
    return decided.select(
        "order_id",
        "line_no",
        "patient_id",
        "medication_id",
        "supported",
        "matched",
        "status",
        "risk_level",
        F.col("medication.generic_name").alias("generic_name"),
        "message",
        F.array_join("missing_genes", ", ").alias("missing_genes"),
        F.coalesce(F.size("matches"), F.lit(0)).cast("bigint").alias("n_matches"),
        F.coalesce(
            F.array_join(F.transform("matches", lambda m: m["rule_id"].cast("string")), ","), F.lit("")
        ).alias("match_rules"),
        "gene",
        "phenotype",
        "patient_summary",
        "clinician_summary",
        "recommended_action",
        "evidence_source",
        "rule_id",
        "pgx_result_id",
    )


# The decision in plain joins.  `req` gives order_id, line_no, raw ids and clean ids.
DECISION = textwrap.dedent("""
    rule_k as (
      select id as rule_id, medication_id, gene, phenotype, risk_level, patient_summary, clinician_summary,
        recommended_action, evidence_source, lower(trim(gene)) as gk, lower(trim(phenotype)) as pk,
        case risk_level when 'potential_concern' then 4 when 'caution' then 3 when 'low_risk' then 2
          when 'insufficient_data' then 1 else 0 end as rnk
      from fx_rules where review_status = 'approved'),
    res_k as (
      select patient_id, lower(trim(gene)) as gk, lower(trim(phenotype)) as pk, id,
        row_number() over (partition by patient_id, lower(trim(gene)), lower(trim(phenotype))
          order by updated_at, id) as rn
      from fx_pgx),
    need as (select medication_id, gk, min(rule_id) as ord, arg_min(gene, rule_id) as gene
      from rule_k where gk <> '' group by medication_id, gk),
    need_all as (select medication_id, string_agg(gene, ', ' order by ord) as genes from need group by medication_id),
    pairs as (select distinct pid, mid from req where pid is not null and mid is not null),
    has as (select distinct patient_id from res_k),
    has_gene as (select distinct patient_id, gk from res_k),
    gap as (
      select p.pid, p.mid, count(*) as n, string_agg(n.gene, ', ' order by n.ord) as genes
      from pairs p join need n on n.medication_id = p.mid
      left join has_gene h on h.patient_id = p.pid and h.gk = n.gk
      where h.gk is null group by p.pid, p.mid),
    hit as (
      select p.pid, p.mid, r.*, s.id as pgx_result_id,
        row_number() over (partition by p.pid, p.mid order by r.rnk desc, r.rule_id) as pos
      from pairs p join rule_k r on r.medication_id = p.mid and r.gk <> ''
      join res_k s on s.patient_id = p.pid and s.gk = r.gk and s.pk = r.pk and s.rn = 1),
    hits as (select pid, mid, count(*) as n, string_agg(cast(rule_id as varchar), ',' order by pos) as rules
      from hit group by pid, mid),
    n_rules as (select medication_id, count(*) as n from rule_k group by medication_id),
    facts as (
      select q.*, m.generic_name as med_name, g.genes as gap_genes, a.genes as all_genes, coalesce(h.n, 0) as n_hits, h.rules,
        case when q.pid is null or q.mid is null then 'missing_ids'
          when m.id is null then 'unsupported'
          when pt.id is null then 'unknown_patient'
          when nr.n is null then 'no_rules'
          when hs.patient_id is null then 'no_results'
          when g.n is not null then 'missing_genes'
          when h.n is null then 'no_match' else 'matched' end as branch
      from req q
      left join fx_meds m on m.id = q.mid and m.is_active
      left join fx_patients pt on pt.id = q.pid
      left join n_rules nr on nr.medication_id = q.mid
      left join has hs on hs.patient_id = q.pid
      left join gap g on g.pid = q.pid and g.mid = q.mid
      left join need_all a on a.medication_id = q.mid
      left join hits h on h.pid = q.pid and h.mid = q.mid),
    decided as (
      select f.order_id, f.line_no, f.patient_id, f.medication_id, f.pid, f.mid, f.branch,
        f.branch not in ('missing_ids', 'unsupported', 'unknown_patient') as supported,
        f.branch = 'matched' as matched,
        case when f.branch = 'matched' then 'matched'
          when f.branch not in ('missing_ids', 'unsupported', 'unknown_patient') then 'insufficient_data' end as status,
        case when f.branch = 'matched' then p.risk_level
          when f.branch not in ('missing_ids', 'unsupported', 'unknown_patient') then 'insufficient_data' end
          as risk_level,
        case when f.branch not in ('missing_ids', 'unsupported', 'unknown_patient') then f.med_name end
          as generic_name,
        case f.branch when 'missing_ids' then 'Provide both patientId and medicationId.'
          when 'unsupported' then 'This medication is not supported in the MVP yet.'
          when 'unknown_patient' then 'Patient was not found.'
          when 'no_rules' then 'No approved drug-gene rules found for this medication.'
          when 'no_results' then
            'No PGx data found. Please add your genetic result before checking medication risk.'
          when 'missing_genes' then concat('Missing ', f.gap_genes, ' PGx result',
            case when f.gap_genes like '%, %' then 's' else '' end, ' for this medication.')
          when 'no_match' then
            'No matching drug-gene rule was found for this medication and your saved PGx results.'
          else 'Medication risk result found.' end as message,
        case f.branch when 'no_results' then coalesce(f.all_genes, '') when 'missing_genes' then f.gap_genes
          else '' end as missing_genes,
        case when f.branch = 'matched' then f.n_hits else 0 end as n_matches,
        case when f.branch = 'matched' then f.rules else '' end as match_rules,
        p.gene, p.phenotype,
        case f.branch when 'matched' then p.patient_summary
          when 'no_results' then 'No pharmacogenetic results are on file for this patient yet.'
          when 'missing_ids' then null when 'unsupported' then null when 'unknown_patient' then null
          else 'There is not enough matching genetic information on file to assess this medication yet.' end
          as patient_summary,
        case f.branch when 'matched' then p.clinician_summary
          when 'no_rules' then 'No approved drug-gene rules found for this medication.'
          when 'no_results' then
            'Medication risk cannot be evaluated until the patient has at least one saved PGx result.'
          when 'missing_ids' then null when 'unsupported' then null when 'unknown_patient' then null
          else 'No approved drug-gene rule matched the patient''s available PGx results.' end
          as clinician_summary,
        case f.branch when 'matched' then p.recommended_action
          when 'no_results' then 'Add a gene and phenotype result before checking medication risk.'
          when 'missing_ids' then null when 'unsupported' then null when 'unknown_patient' then null
          else 'Review this result with a clinician before making medication changes.' end
          as recommended_action,
        p.evidence_source, p.rule_id, p.pgx_result_id
      from facts f left join hit p on p.pid = f.pid and p.mid = f.mid and p.pos = 1 and f.branch = 'matched')
""").strip()

REQ_PLAIN = "req as (select *, patient_id as pid, medication_id as mid from fx_requests)"
REQ_TEXT = (
    "req as (select *, try_cast(nullif(trim(patient_id), '') as bigint) as pid, "
    "case when trim(medication_id) = '' then null when trim(medication_id) = 'none' then -1 "
    "else cast(medication_id as bigint) end as mid from fx_requests_text)"
)
FLAT = (
    "select order_id, line_no, patient_id, medication_id, supported, matched, status, risk_level, generic_name, "
    "message, missing_genes, n_matches, match_rules, gene, phenotype, patient_summary, clinician_summary, "
    "recommended_action, evidence_source, rule_id, pgx_result_id from decided"
)


@query("match_risk", f"with {REQ_PLAIN}, {DECISION} {FLAT}")
def match_risk(spark, sf):
    return flat(M.match_risk(*inputs(spark, sf)))


@query("match_risk_unknown_ids", f"with {REQ_TEXT}, {DECISION} {FLAT}")
def match_risk_unknown_ids(spark, sf):
    decided = M.match_risk(*text_inputs(spark, sf))
    return flat(decided)


@query("match_risk_by_rows", f"with {REQ_PLAIN}, {DECISION} {FLAT}")
def match_risk_by_rows(spark, sf):
    return flat(M.match_risk(*inputs(spark, sf), plan="rows"))


def history_sql(req: str) -> str:
    """Kept rows without their id, from the decision in plain joins."""
    return f"""
    with {req}, {DECISION},
    history as (
      select d.order_id, d.line_no, d.pid as patient_id, d.mid as medication_id, h.pgx_result_id, h.rule_id,
        coalesce(h.risk_level, 'insufficient_data') as risk_level,
        coalesce(h.patient_summary, d.patient_summary) as patient_summary,
        case when h.rule_id is not null then h.clinician_summary when d.branch = 'missing_genes' then d.message
          else d.clinician_summary end as clinician_summary,
        coalesce(h.recommended_action, d.recommended_action) as recommended_action,
        timestamp '{RUN_TS}' as created_at
      from decided d left join hit h on h.pid = d.pid and h.mid = d.mid and d.branch = 'matched'
      where d.supported)"""


KEPT = (
    "patient_id, medication_id, pgx_result_id, rule_id, risk_level, patient_summary, clinician_summary, "
    "recommended_action, created_at"
)
HISTORY = f"{history_sql(REQ_PLAIN)} select {KEPT} from history"
REQUEST = ["order_id", "line_no"]


def history(spark, sf) -> DataFrame:
    return M.risk_history_rows(M.match_risk(*inputs(spark, sf)), "run", run_ts(), REQUEST)


@query("risk_history", HISTORY)
def risk_history(spark, sf):
    return history(spark, sf).drop("id")


@query(
    "history_ids_unique",
    # the driver's line items repeat a few (order, line) keys
    f"{history_sql(REQ_PLAIN)} select count(*) as n_rows, cast(0 as bigint) as n_null, "
    "count(distinct (order_id, line_no, patient_id, medication_id, rule_id)) as n_ids from history",
)
def history_ids_unique(spark, sf):
    return history(spark, sf).agg(
        F.count("*").alias("n_rows"), F.countDistinct("id").alias("n_ids"), F.count_if(F.col("id").isNull()).alias("n_null")
    )


def text_inputs(spark, sf):
    """Requests with padded text ids, and tables whose ids are text."""
    requests, patients, meds, rules, pgx = inputs(spark, sf, "fx_requests_text")
    as_text = lambda df, *names: df.withColumns({n: F.col(n).cast("string") for n in names})
    return requests, as_text(patients, "id"), as_text(meds, "id"), as_text(rules, "medication_id"), as_text(pgx, "patient_id")


@query(
    "history_of_padded_requests",
    f"{history_sql(REQ_TEXT)} select cast(patient_id as varchar) as patient_id, cast(medication_id as varchar) as medication_id, "
    "rule_id, pgx_result_id, risk_level, clinician_summary from history",
)
def history_of_padded_requests(spark, sf):
    rows = M.risk_history_rows(M.match_risk(*text_inputs(spark, sf)), "run", run_ts(), REQUEST)
    return rows.select("patient_id", "medication_id", "rule_id", "pgx_result_id", "risk_level", "clinician_summary")


PARTS = f"with {REQ_PLAIN}, {DECISION}"


@query(
    "matched_rules",
    f"{PARTS} select pid as patient_id, mid as medication_id, rule_id, gene, phenotype, risk_level, pgx_result_id from hit",
)
def matched_rules(spark, sf):
    requests, _, _, rules, pgx = inputs(spark, sf)
    return M.match_first(requests, rules, pgx).select(
        "patient_id", "medication_id", "rule_id", "gene", "phenotype", "risk_level", "pgx_result_id"
    )


@query(
    "required_genes",
    f"{PARTS} select medication_id, gk as gene_key, gene, ord as first_rule_id from need",
)
def required_genes(spark, sf):
    return M.required_genes(view(spark, sf, "fx_rules")).select(
        "medication_id", "gene_key", "gene", "first_rule_id"
    )


@query(
    "missing_genes",
    f"""{PARTS} select p.pid as patient_id, p.mid as medication_id, n.gene
        from pairs p join need n on n.medication_id = p.mid
        left join has_gene h on h.patient_id = p.pid and h.gk = n.gk where h.gk is null""",
)
def missing_genes(spark, sf):
    requests, _, _, rules, pgx = inputs(spark, sf)
    return M.missing_genes(requests, rules, pgx).select("patient_id", "medication_id", "gene")


@query(
    "missing_gene_message",
    f"""{PARTS} select pid as patient_id, mid as medication_id, concat('Missing ', genes, ' PGx result',
        case when n > 1 then 's' else '' end, ' for this medication.') as message from gap""",
)
def missing_gene_message(spark, sf):
    from allelegate.functions.text import missing_gene_message as message

    requests, _, _, rules, pgx = inputs(spark, sf)
    # One medication needs a few genes at most, so the gathered list is short.
    gaps = M.missing_genes(requests, rules, pgx).groupBy("patient_id", "medication_id").agg(
        F.sort_array(F.collect_list(F.struct("first_rule_id", "gene"))).alias("gaps")
    )
    genes = F.transform("gaps", lambda g: g["gene"])
    return gaps.select("patient_id", "medication_id", message(genes).alias("message"))


@query(
    "relevant_results",
    f"""{PARTS} select p.pid as patient_id, p.mid as medication_id, x.id as pgx_result_id, x.gene, x.phenotype
        from pairs p join need n on n.medication_id = p.mid
        join fx_pgx x on x.patient_id = p.pid and lower(trim(x.gene)) = n.gk""",
)
def relevant_results(spark, sf):
    requests, _, _, rules, pgx = inputs(spark, sf)
    return M.relevant_results(pgx, requests, rules).select(
        "patient_id", "medication_id", "pgx_result_id", "gene", "phenotype"
    )


@query(
    "overall_risk",
    f"""{PARTS} select pid as patient_id, mid as medication_id, max(rnk) as risk_rank,
        arg_max(risk_level, rnk) as risk_level, count(*) as n_matches from hit group by pid, mid""",
)
def overall_risk(spark, sf):
    requests, _, _, rules, pgx = inputs(spark, sf)
    return M.overall_risk(M.match_first(requests, rules, pgx))


@query(
    "collect_matches",
    f"""{PARTS} select pid as patient_id, mid as medication_id, rules as match_rules, n as n_matches from hits""",
)
def collect_matches(spark, sf):
    decided = M.match_first(*[view(spark, sf, v) for v in ("fx_requests", "fx_rules", "fx_pgx")])
    # At most one match per rule of the medication, so the gathered list is short.
    gathered = decided.groupBy("patient_id", "medication_id").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("risk_rank")).alias("falling"), "rule_id"))).alias("m")
    )
    return gathered.select(
        "patient_id",
        "medication_id",
        F.array_join(F.transform("m", lambda r: r["rule_id"].cast("string")), ",").alias("match_rules"),
        F.size("m").cast("bigint").alias("n_matches"),
    )


@query(
    "matches_by_risk",
    f"{PARTS} select pid as patient_id, mid as medication_id, rule_id, risk_level, pos as position from hit",
)
def matches_by_risk(spark, sf):
    requests, _, _, rules, pgx = inputs(spark, sf)
    return M.matches_by_risk(M.match_first(requests, rules, pgx)).select(
        "patient_id", "medication_id", "rule_id", "risk_level", "position"
    )


@query("active_medications", "select * from fx_meds where is_active")
def active_medications(spark, sf):
    return M.active_medications(view(spark, sf, "fx_meds"))


@query("approved_rules", "select * from fx_rules where review_status = 'approved'")
def approved_rules(spark, sf):
    return M.approved_rules(view(spark, sf, "fx_rules"))


@query(
    "shape_matches",
    f"""with {REQ_PLAIN}, {DECISION}
        select f.order_id, f.line_no, h.pos as position, h.gene, h.phenotype, h.risk_level as "riskLevel",
          h.patient_summary as "patientSummary", h.clinician_summary as "clinicianSummary",
          h.recommended_action as "recommendedAction", h.evidence_source as "evidenceSource", h.rule_id as "ruleId",
          h.pgx_result_id as "pgxResultId"
        from facts f join hit h on h.pid = f.pid and h.mid = f.mid where f.branch = 'matched'""",
)
def shape_matches(spark, sf):
    """All matches of every decision, under the field names that callers see."""
    decided = M.match_risk(*inputs(spark, sf))
    shaped = decided.select("order_id", "line_no", F.posexplode(X.shape_matches("matches")).alias("at", "m"))
    return shaped.select("order_id", "line_no", (F.col("at") + 1).cast("bigint").alias("position"), "m.*")
