"""Staging queries: normalization, candidates, dedupe, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from allelegate.functions import text as X
from allelegate.operators import staging as S
from allelegate.plans.fixtures import read_sql, view
from allelegate.plans.schemas import STAGED_COLUMNS
from allelegate.queries import query

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]
ORDER_SQL = ", ".join(ORDER)
PAYLOAD = ", ".join(STAGED_COLUMNS)

ALIASES = """
    select concat(case when p_size > 10 then 'med ' else 'other ' end, cast(p_partkey as string)) as alias, concat('generic ', cast(p_partkey as string)) as generic,
      p_brand as brand, p_type as class
    from part"""


@query(
    "map_aliases",
    f"""select {ORDER_SQL}, a.generic, a.brand, a.class from fx_stage
        join ({ALIASES}) a on a.alias = lower(trim(replace(medication_generic_name, '  ', ' ')))""",
)
def map_aliases(spark, sf):
    mapped = S.map_aliases(view(spark, sf, "fx_stage"), "medication_generic_name", read_sql(spark, sf, ALIASES))
    return mapped.select(*ORDER, "generic", "brand", "class")


@query(
    "known_phenotype",
    f"""select {ORDER_SQL}, lower(replace(phenotype, '  ', ' ')) as phenotype from fx_stage""",
)
def known_phenotype(spark, sf):
    rows = view(spark, sf, "fx_stage").select(*ORDER, S.known_phenotype("phenotype").alias("phenotype"))
    return rows.where("phenotype is not null")


GENE_CELLS = """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey,
      case l_linenumber % 4 when 0 then 'CYP2C19; SLCO1B1, other' when 1 then ' cyp2c19 ' when 2 then 'VKORC1;CYP2D6'
        else 'SLCO1B1,,slco1b1' end as genes
    from lineitem"""


@query(
    "split_genes",
    f"""with cells as ({GENE_CELLS}),
        parts as (select l_orderkey, l_linenumber, l_partkey, l_suppkey,
          upper(trim(unnest(string_split(replace(genes, ';', ','), ',')))) as gene from cells)
        select *, case when gene like 'CYP%' then 'normal metabolizer' else 'normal function' end as phenotype
        from parts where gene in ('CYP2C19', 'SLCO1B1')""",
)
def split_genes(spark, sf):
    cells = read_sql(spark, sf, GENE_CELLS)
    genes = cells.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.explode(X.split_genes("genes")).alias("gene")
    )
    return genes.where(S.supported_gene("gene")).withColumn("phenotype", X.default_phenotype("gene"))


RAW = f"""
    select {ORDER_SQL}, medication_generic_name as generic, brand_name as brand, drug_class as class, gene, phenotype,
      risk_level, patient_summary, clinician_summary, recommended_action, evidence_source, evidence_url, review_status
    from fx_stage"""


def raw_records(spark, sf):
    rows = read_sql(spark, sf, RAW)
    return rows.select(
        *[F.col(c).alias(f"ord_{c}") for c in ORDER],
        F.struct(F.col("generic").alias("genericName"), F.col("brand").alias("brandName"), F.col("class").alias("drugClass")).alias("medication"),
        "gene",
        "phenotype",
        F.col("risk_level").alias("riskLevel"),
        F.col("patient_summary").alias("patientSummary"),
        F.col("clinician_summary").alias("clinicianSummary"),
        F.col("recommended_action").alias("recommendedAction"),
        F.col("evidence_source").alias("sourceName"),
        F.col("evidence_url").alias("sourceUrl"),
        F.lit("table").alias("sourceType"),
        F.col("review_status").alias("reviewStatus"),
        F.lit(None).cast("string").alias("notes"),
        F.col("clinician_summary").alias("rawSummary"),
    )


ORD_AS = ", ".join(f"{c} as ord_{c}" for c in ORDER)


@query(
    "normalize_records",
    f"""select {ORD_AS}, n.medication_generic_name as "genericName", coalesce(n.brand_name, '') as "brandName",
          n.drug_class as "drugClass", n.gene, n.phenotype, n.risk_level as "riskLevel",
          n.patient_summary as "patientSummary", n.clinician_summary as "clinicianSummary",
          n.recommended_action as "recommendedAction", n.evidence_source as "sourceName",
          n.evidence_url as "sourceUrl", 'table' as "sourceType", n.review_status as "reviewStatus",
          '' as "evidenceNotes",
          case when n.clinician_summary = 'Pending clinical review.' then '' else n.clinician_summary end as "rawSummary",
          'mvp-0.1' as "ruleVersion"
        from fx_norm n""",
)
def normalize_records(spark, sf):
    return S.normalize_records(raw_records(spark, sf))


NORM_RULES = f"""select {ORD_AS}, medication_generic_name, coalesce(brand_name, '') as brand_name, drug_class, gene,
    phenotype, risk_level, patient_summary, clinician_summary, recommended_action, evidence_source, evidence_url,
    rule_version, review_status from fx_norm"""


@query("to_rules", NORM_RULES)
def to_rules(spark, sf):
    return S.to_rules(S.normalize_records(raw_records(spark, sf)))


def three_sources(spark, sf):
    return [read_sql(spark, sf, f"select * from fx_norm where evidence_source = '{s}'") for s in ("CPIC", "PharmGKB", "custom")]


SOURCE_ORD = "case evidence_source when 'CPIC' then 0 when 'PharmGKB' then 1 else 2 end"


@query("union_sources", f"select *, {SOURCE_ORD} as ord_source from fx_norm")
def union_sources(spark, sf):
    return S.union_sources(three_sources(spark, sf))


KEYS = "medication_generic_name, gk, pk, evidence_source"
DEDUPE = f"""
    s as (select *, upper(trim(gene)) as gk, lower(trim(replace(phenotype, '  ', ' '))) as pk,
        row_number() over (order by {ORDER_SQL}) as seq from {{table}}),
    l as (select *, row_number() over (partition by {KEYS} order by {{rank}}seq desc) as rn,
        min(seq) over (partition by {KEYS}) as first_seq from s)"""
FIRST_COLUMNS = ", ".join(f"f.{c} as first_{c}" for c in ORDER)


@query(
    "dedupe_last",
    f"""with {DEDUPE.format(table='fx_stage', rank='')}
        select {', '.join('l.' + c for c in STAGED_COLUMNS)}, {FIRST_COLUMNS}
        from l join s f on f.seq = l.first_seq where l.rn = 1""",
)
def dedupe_last(spark, sf):
    return S.dedupe_last(view(spark, sf, "fx_stage"), ORDER)


@query(
    "dedupe_last_approval_aware",
    f"""with {DEDUPE.format(table='fx_stage', rank="(review_status = 'approved') desc, ")}
        select {', '.join('l.' + c for c in STAGED_COLUMNS)}, {FIRST_COLUMNS}
        from l join s f on f.seq = l.first_seq where l.rn = 1""",
)
def dedupe_last_approval_aware(spark, sf):
    return S.dedupe_last(view(spark, sf, "fx_stage"), ORDER, approval_aware=True)


CANDIDATE = "concat(medication_generic_name, ' + ', gene, ' ', phenotype)"


@query(
    "review_summary",
    f"""select count(distinct medication_generic_name) as medications, count(distinct {CANDIDATE}) as candidates,
        count(*) filter (where review_status = 'pending_review') as pending from fx_norm""",
)
def review_summary(spark, sf):
    return S.review_summary(view(spark, sf, "fx_norm"))


@query("distinct_medications", "select distinct medication_generic_name from fx_norm")
def distinct_medications(spark, sf):
    return S.distinct_medications(view(spark, sf, "fx_norm"))


@query("distinct_candidates", f"select distinct {CANDIDATE} as candidate from fx_norm")
def distinct_candidates(spark, sf):
    return S.distinct_candidates(view(spark, sf, "fx_norm"))


@query("pending_count", "select count(*) filter (where review_status = 'pending_review') as pending from fx_norm")
def pending_count(spark, sf):
    return S.pending_count(view(spark, sf, "fx_norm"))


@query(
    "drop_invalid",
    f"""select {ORDER_SQL}, case when risk_level = ' ' then 'Invalid risk level:  ' end as invalid from fx_stage""",
)
def drop_invalid(spark, sf):
    flagged = S.checked(view(spark, sf, "fx_stage"), "risk_level", "review_status", strict=False)
    return flagged.select(*ORDER, "invalid")


