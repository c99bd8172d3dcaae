"""Scalar function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from allelegate.functions import text as X
from allelegate.plans.fixtures import read_sql, view
from allelegate.queries import query

SPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


@query(
    "normalize_text",
    f"""select doc_id, trim(regexp_replace(text, '{SPACE}+', ' ', 'g')) as text,
        lower(trim(regexp_replace(text, '{SPACE}+', ' ', 'g'))) as key from documents""",
)
def normalize_text(spark, sf):
    docs = read_sql(spark, sf, "select doc_id, text from documents")
    return docs.select("doc_id", X.norm_text("text").alias("text"), X.norm_key("text").alias("key"))


@query(
    "match_key",
    "select id, lower(trim(gene)) as gene_key, lower(trim(phenotype)) as phenotype_key from fx_pgx_raw",
)
def match_key(spark, sf):
    rows = view(spark, sf, "fx_pgx_raw")
    return rows.select("id", X.match_key("gene").alias("gene_key"), X.match_key("phenotype").alias("phenotype_key"))


@query("normalized_email", "select id, lower(trim(email)) as email from fx_users")
def normalized_email(spark, sf):
    return view(spark, sf, "fx_users").select("id", X.norm_email("email").alias("email"))


FILLED = """
    select p_partkey, case when p_size % 7 = 0 then '' when p_size % 5 = 0 then null else p_brand end as a,
      case when p_size % 3 = 0 then ' ' when p_size % 2 = 0 then '' else p_type end as b, p_name as c
    from part"""


@query(
    "first_filled",
    f"""select p_partkey, coalesce(nullif(a, ''), nullif(b, ''), '') as ab,
        coalesce(nullif(b, ''), nullif(a, ''), nullif(c, ''), '') as bac from ({FILLED}) t""",
)
def first_filled(spark, sf):
    rows = read_sql(spark, sf, FILLED)
    return rows.select("p_partkey", X.first_filled("a", "b").alias("ab"), X.first_filled("b", "a", "c").alias("bac"))


@query(
    "default_if_blank",
    f"""select p_partkey, coalesce(nullif(trim(b), ''), 'Pending clinical review.') as summary,
        coalesce(nullif(trim(a), ''), 'insufficient_data') as level from ({FILLED}) t""",
)
def default_if_blank(spark, sf):
    rows = read_sql(spark, sf, FILLED)
    return rows.select(
        "p_partkey",
        X.default_if_blank("b", "Pending clinical review.").alias("summary"),
        X.default_if_blank("a", "insufficient_data").alias("level"),
    )


@query(
    "first_present",
    f"select p_partkey, a as drug, c as gene from ({FILLED}) t",
)
def first_present(spark, sf):
    rows = read_sql(spark, sf, FILLED)
    headers = ["drug(s)", "other", "gene"]
    named = dict(zip(headers, ["a", "b", "c"], strict=True))
    drug, gene = X.first_present(headers, "drug", "drug(s)"), X.first_present(headers, "genes", "gene")
    return rows.select("p_partkey", F.col(named[drug]).alias("drug"), F.col(named[gene]).alias("gene"))


@query(
    "risk_rank",
    """select id, case risk_level when 'potential_concern' then 4 when 'caution' then 3 when 'low_risk' then 2
        when 'insufficient_data' then 1 else 0 end as risk_rank from fx_rules""",
)
def risk_rank(spark, sf):
    return view(spark, sf, "fx_rules").select("id", X.risk_rank("risk_level").alias("risk_rank"))


@query(
    "level_label",
    """select id, array_to_string(list_transform(list_filter(string_split(risk_level, '_'), lambda w: w <> ''),
        lambda w: concat(upper(w[1]), w[2:])), ' ') as label from fx_rules""",
)
def level_label(spark, sf):
    return view(spark, sf, "fx_rules").select("id", X.level_label("risk_level").alias("label"))


@query(
    "validity_flags",
    r"""select event_id,
        regexp_full_match(lower(patient_id), '[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}')
          as uuid_ok,
        trim(status) in ('active', 'past', 'considering') as status_ok,
        length(coalesce(notes, '')) <= 10 as notes_ok,
        event_id % 3 <> 0 as email_ok
        from fx_changes""",
)
def validity_flags(spark, sf):
    rows = view(spark, sf, "fx_changes")
    email = F.when(F.col("event_id") % 3 == 0, F.concat("op", F.lit("@nowhere"))).otherwise(F.concat("op", F.lit("@a.org")))
    return rows.select(
        "event_id",
        X.is_uuid("patient_id").alias("uuid_ok"),
        X.in_domain(X.trim_all("status"), ["active", "past", "considering"]).alias("status_ok"),
        X.within_length("notes", 10).alias("notes_ok"),
        X.is_email(email).alias("email_ok"),
    )


@query("token_hash", "select c_custkey, sha256(c_name) as token_hash from customer")
def token_hash(spark, sf):
    return read_sql(spark, sf, "select c_custkey, c_name from customer").select(
        "c_custkey", X.token_hash("c_name").alias("token_hash")
    )


@query("rule_key_label", "select id, concat(cast(medication_id as varchar), ' + ', gene, ' ', phenotype) as label from fx_rules")
def rule_key_label(spark, sf):
    rows = view(spark, sf, "fx_rules")
    return rows.select("id", X.rule_key_label(F.col("medication_id").cast("string"), "gene", "phenotype").alias("label"))


@query("expires_at", "select event_id, ts + interval 12 hour as expires_at from events")
def expires_at(spark, sf):
    return read_sql(spark, sf, "select event_id, ts from events").select("event_id", X.expires_at("ts").alias("expires_at"))


PAIRS = """
    select a.id as old_id, b.id as new_id, a.notes as old_notes, b.notes as new_notes, a.started_at as old_start,
      b.started_at as new_start, a.updated_at as old_at, b.updated_at as new_at
    from fx_list a join fx_list b on b.medication_id = a.medication_id and b.patient_id = a.patient_id + 1"""


@query(
    "merge_values",
    f"""select old_id, new_id,
        case when old_notes is null then new_notes when new_notes is null or old_notes = new_notes then old_notes
          else concat(old_notes, chr(10), '[Merged record] ', new_notes) end as notes,
        coalesce(old_start, new_start) as started_at, greatest(old_at, new_at) as updated_at
        from ({PAIRS}) t""",
)
def merge_values(spark, sf):
    rows = read_sql(spark, sf, PAIRS)
    return rows.select(
        "old_id",
        "new_id",
        X.merged_notes("old_notes", "new_notes").alias("notes"),
        F.coalesce("old_start", "new_start").alias("started_at"),
        X.latest("old_at", "new_at").alias("updated_at"),
    )


@query(
    "add_disclaimer",
    """select id, concat(patient_summary,
        ' This information is for educational MVP purposes only and is not medical advice.') as patient_summary
        from fx_rules""",
)
def add_disclaimer(spark, sf):
    return view(spark, sf, "fx_rules").select("id", X.add_disclaimer("patient_summary").alias("patient_summary"))
