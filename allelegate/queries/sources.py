"""Reader and writer queries: files are made from the driver tables, then read back.

Files go to a folder of their own below the shared folder of the session.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from allelegate.operators import match as M
from allelegate.operators import staging as S
from allelegate.plans import domains as D
from allelegate.plans.fixtures import read_sql, view
from allelegate.plans.schemas import STAGED_COLUMNS
from allelegate.plans.session import scratch_path
from allelegate.queries import query
from allelegate.queries.match import HISTORY, history
from allelegate.queries.staging import raw_records
from allelegate.sources import curated, delimited, envelopes, html_tables, routing, tables, workbook

STAGED_SQL = ", ".join(STAGED_COLUMNS)

# A source must name a brand, so items without one get a stand-in before they are written.
NORM_BRANDED = f"""select {STAGED_SQL.replace('brand_name', "coalesce(brand_name, 'none') as brand_name")} from fx_norm"""


def branded(spark, sf):
    raw = raw_records(spark, sf)
    return raw.withColumn(
        "medication",
        F.col("medication").withField("brandName", F.coalesce("medication.brandName", F.lit("none"))),
    )


@query("collected_roundtrip", NORM_BRANDED)
def collected_roundtrip(spark, sf):
    path = scratch_path(spark, "collected")
    meta = envelopes.collected_meta("2026-01-01T00:00:00+00:00")
    envelopes.write_envelope_json(branded(spark, sf), path, meta, 5_000, compression="gzip")
    records = envelopes.read_collected(spark, path, lines=True)
    return S.staged(S.to_rules(S.normalize_records(records)))


@query("normalized_roundtrip", NORM_BRANDED)
def normalized_roundtrip(spark, sf):
    path = scratch_path(spark, "normalized")
    normalized = S.normalize_records(branded(spark, sf))
    meta = envelopes.normalized_meta("2026-01-01T00:00:00+00:00", "table")
    envelopes.write_envelope_json(normalized, path, meta, 5_000, compression="gzip")
    return S.staged(envelopes.load_normalized_rules(spark, path, lines=True))


# Records of which some lack keys, as JSON text.
LACKING = """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey,
      case l_linenumber % 3 when 0 then concat('{"gene": null, "phenotype": "p", "sourceName": "', l_returnflag, '"}')
        when 1 then '{"sourceType": 1, "rawSummary": "", "gene": "g", "medication": {}, "phenotype": "", "sourceName": ""}'
        else '{}' end as record
    from lineitem"""


@query(
    "required_fields_missing",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
        case l_linenumber % 3 when 0 then 'medication,rawSummary,sourceType' when 1 then ''
          else 'gene,medication,phenotype,rawSummary,sourceName,sourceType' end as missing from lineitem""",
)
def required_fields_missing(spark, sf):
    rows = read_sql(spark, sf, LACKING)
    missing = envelopes.required_fields_missing("record", D.RAW_REQUIRED)
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(missing, ",").alias("missing")
    )


CELLS = """
    select l_orderkey as n,
      case l_partkey % 5 when 0 then 'Plavix' when 1 then ' CELEXA ' when 2 then 'zocor' when 3 then 'simvastatin'
        else 'Adderall' end as drug,
      case l_suppkey % 3 when 0 then ' cyp2c19' when 1 then 'SLCO1B1' else null end as gene,
      case l_linenumber % 4 when 0 then 'Poor  Metabolizer' when 1 then 'poor function' when 2 then 'unheard of'
        else 'Normal "Function"' end as phenotype,
      concat('say "', l_returnflag, '", twice') as remark
    from lineitem"""
STAGED_CELLS = f"""
    with cells as ({CELLS}),
    mapped as (
      select case when drug = 'Plavix' then 'clopidogrel' when drug = ' CELEXA ' then 'citalopram' else 'simvastatin' end as g,
        case when drug = 'Plavix' then 'Plavix' when drug = ' CELEXA ' then 'Celexa' else 'Zocor' end as b,
        case when drug = 'Plavix' then 'antiplatelet' when drug = ' CELEXA ' then 'antidepressant' else 'statin' end as c,
        upper(trim(gene)) as gene, lower(replace(phenotype, '  ', ' ')) as phenotype
      from cells where drug <> 'Adderall' and gene is not null
        and phenotype in ('Poor  Metabolizer', 'poor function'))
    select g as medication_generic_name, b as brand_name, c as drug_class, gene, phenotype,
      'insufficient_data' as risk_level, 'Pending clinical review.' as patient_summary,
      'Imported source candidate pending clinical review.' as clinician_summary,
      'Pending clinical review before use.' as recommended_action, '{{name}}' as evidence_source,
      '{{url}}' as evidence_url, 'source-import-v0' as rule_version, 'pending_review' as review_status
    from mapped"""


def delimited_file(spark, sf, sep):
    """The cells written with headers that the reader knows by alias."""
    path = scratch_path(spark, "delimited")
    cells = read_sql(spark, sf, CELLS).select(
        F.col("n").alias("No"),
        F.col("drug").alias("Drug  Name"),
        F.col("gene").alias("Gene Symbol"),
        F.col("remark").alias("Remark"),
        F.col("phenotype").alias("METABOLIZER status"),
    )
    (
        cells.write.option("header", True).option("sep", sep).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )
    return path


@query("delimited_roundtrip", STAGED_CELLS.format(name="list", url="https://example.org/list.csv"))
def delimited_roundtrip(spark, sf):
    path = delimited_file(spark, sf, ",")
    return S.staged(delimited.read_delimited(spark, path, ",", "list", "https://example.org/list.csv"))


@query("delimited_tsv", STAGED_CELLS.format(name="list", url="https://example.org/list.tsv"))
def delimited_tsv(spark, sf):
    path = delimited_file(spark, sf, "\t")
    return S.staged(delimited.read_delimited(spark, path, "\t", "list", "https://example.org/list.tsv"))


@query(
    "review_csv_roundtrip",
    f"""select {', '.join(f"nullif({c}, '') as {c}" for c in STAGED_COLUMNS)} from fx_stage""",
)
def review_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "review")
    delimited.write_review_csv(view(spark, sf, "fx_stage"), path)
    cells, headers = delimited.read_cells(spark, path)
    return cells.select(*[F.col(f"c{i}").alias(h) for i, h in enumerate(headers)])


def workbook_bytes(rows: list[tuple[str, str]]) -> bytes:
    """A workbook with one shared-string, one inline-string and one numeric column."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    shared = ["Genes", "Drug(s)", *[g for _, g in rows]]
    strings = "".join(f"<si><t>{s}</t></si>" for s in shared)
    lines = ['<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>']
    for i, (drug, _) in enumerate(rows):
        n = i + 2
        lines.append(
            f'<row r="{n}"><c r="A{n}" t="s"><v>{n}</v></c><c r="B{n}"><v>{i}</v></c>'
            f'<c r="C{n}" t="inlineStr"><is><t>{drug}</t></is></c></row>'
        )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {ns}>{strings}</sst>")
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(lines)}</sheetData></worksheet>")
    return out.getvalue()


PAIR_ROWS = """
    select case p_size % 5 when 0 then 'Plavix' when 1 then ' CELEXA ' when 2 then 'zocor' when 3 then 'simvastatin'
        else 'Adderall' end as drug,
      case p_partkey % 4 when 0 then 'CYP2C19; SLCO1B1, HLA-B' when 1 then ' cyp2c19' when 2 then 'VKORC1'
        else 'SLCO1B1,slco1b1' end as genes
    from part"""


STAGED_PAIRS = f"""with cells as ({PAIR_ROWS}),
    genes as (select drug, upper(trim(unnest(string_split(replace(genes, ';', ','), ',')))) as gene from cells
      where drug <> 'Adderall')
    select case drug when 'Plavix' then 'clopidogrel' when ' CELEXA ' then 'citalopram' else 'simvastatin' end
        as medication_generic_name,
      case drug when 'Plavix' then 'Plavix' when ' CELEXA ' then 'Celexa' else 'Zocor' end as brand_name,
      case drug when 'Plavix' then 'antiplatelet' when ' CELEXA ' then 'antidepressant' else 'statin' end as drug_class,
      gene, case when gene = 'CYP2C19' then 'normal metabolizer' else 'normal function' end as phenotype,
      'insufficient_data' as risk_level, 'Pending clinical review.' as patient_summary,
      'CPIC drug-gene pair candidate imported for manual review.' as clinician_summary,
      'Pending clinical review before use.' as recommended_action, 'CPIC' as evidence_source,
      'https://example.org/pairs.xlsx' as evidence_url, 'cpic-pair-import-v0' as rule_version,
      'pending_review' as review_status
    from genes where gene in ('CYP2C19', 'SLCO1B1')"""


@query("workbook_candidates", STAGED_PAIRS)
def workbook_candidates(spark, sf):
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, batch in enumerate(batches):
            rows = list(zip(batch["drug"], batch["genes"], strict=True))
            yield pd.DataFrame({"path": [f"book-{number}.xlsx"], "content": [workbook_bytes(rows)]})

    files = read_sql(spark, sf, PAIR_ROWS).mapInPandas(make, "path string, content binary")
    return S.staged(workbook.candidates_from_workbooks(files, "https://example.org/pairs.xlsx"))


@query("landed_workbooks", STAGED_PAIRS)
def landed_workbooks(spark, sf):
    """Pairs landed as workbooks, then read range by range of their sheets."""
    path = scratch_path(spark, "cpic_gene-drug_pairs")
    workbook.write_pair_workbooks(read_sql(spark, sf, PAIR_ROWS), path)
    return S.staged(workbook.read_pair_workbook(spark, path, "https://example.org/pairs.xlsx"))


@query(
    "landed_sources",
    f"""select * from ({STAGED_PAIRS.replace('pairs.xlsx', 'CPIC_gene-drug_pairs.xlsx')}) t
        union all select * from ({STAGED_CELLS.format(name="list", url="https://example.org/list.csv")}) t
        union all select * from ({STAGED_CELLS.format(name="tabs", url="https://example.org/list")}) t""",
)
def landed_sources(spark, sf):
    """A workbook folder, a CSV folder and a TSV folder, each by the reader that its address or content type names."""
    books = scratch_path(spark, "cpic_gene-drug_pairs")
    workbook.write_pair_workbooks(read_sql(spark, sf, PAIR_ROWS), books)
    sources = [
        (books, "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "pairs", "https://example.org/CPIC_gene-drug_pairs.xlsx"),
        (delimited_file(spark, sf, ","), "", "list", "https://example.org/list.csv"),
        (delimited_file(spark, sf, "\t"), "text/tab-separated-values", "tabs", "https://example.org/list"),
    ]
    return S.staged(routing.read_landed(spark, sources))


# Each page carries a table of the part with its number before its own text.
PAGES = """
    select page_id, url, concat('<table><tr><th>Drug</th><th> Gene <b>Symbol</b></th><th>Function</th></tr><tr><td>',
        case p_size % 4 when 0 then 'Plavix' when 1 then ' celexa' when 2 then 'Zocor' else 'other' end, '</td><td>',
        case p_partkey % 2 when 0 then 'cyp2c19' else '<i>SLCO1B1</i>' end, '</td><td>poor <b>function</b></td><td>x</td></tr>',
        '<tr><td>short</td></tr></table>', html) as html
    from pages join part on p_partkey = page_id"""


@query(
    "html_candidates",
    """select case p_size % 4 when 0 then 'clopidogrel' when 1 then 'citalopram' else 'simvastatin' end
            as medication_generic_name,
          case p_size % 4 when 0 then 'Plavix' when 1 then 'Celexa' else 'Zocor' end as brand_name,
          case p_size % 4 when 0 then 'antiplatelet' when 1 then 'antidepressant' else 'statin' end as drug_class,
          case p_partkey % 2 when 0 then 'CYP2C19' else 'SLCO1B1' end as gene, 'poor function' as phenotype,
          'insufficient_data' as risk_level, 'Pending clinical review.' as patient_summary,
          'Imported source candidate pending clinical review.' as clinician_summary,
          'Pending clinical review before use.' as recommended_action, 'site' as evidence_source, url as evidence_url,
          'source-import-v0' as rule_version, 'pending_review' as review_status
        from pages join part on p_partkey = page_id where p_size % 4 <> 3""",
)
def html_candidates(spark, sf):
    return S.staged(html_tables.candidates_from_html(read_sql(spark, sf, PAGES), "html", "url", "site"))


MANIFEST = """
    select page_id, concat(url, case page_id % 7 when 0 then '/CPIC_gene-drug_pairs.XLSX' when 1 then '/x.xlsx'
        when 2 then '/x.csv' when 3 then '/x.tsv' when 4 then '/' else '' end) as url,
      case page_id % 5 when 0 then 'Text/CSV; charset=utf-8' when 1 then 'text/tab-separated-values' when 2 then 'text/html'
        when 3 then null else 'application/json' end as content_type
    from pages"""


@query(
    "route_source",
    f"""with m as ({MANIFEST}), k as (select *, lower(url) as u, lower(coalesce(content_type, '')) as c from m),
        f as (select *, case when u like '%.xlsx' then case when u like '%cpic_gene-drug_pairs%' then 'workbook' end
            when u like '%.csv' or c like '%text/csv%' then 'csv'
            when u like '%.tsv' or c like '%tab-separated-values%' then 'tsv'
            when c like '%text/html%' or u like '%.html' or u like '%/' then 'html' end as format from k)
        select page_id, url, format, case when format is not null then null
          when u like '%.xlsx' then concat('No XLSX parser is configured for ', url)
          else concat('Unsupported source content type for ', url, ': ', c) end as error from f""",
)
def route_source(spark, sf):
    routed = routing.route_sources(read_sql(spark, sf, MANIFEST))
    return routed.select("page_id", "url", "format", "error")


def _text(value: str | None) -> str:
    return "null" if value is None else "'" + value.replace("'", "''") + "'"


CURATED_VALUES = ", ".join(f"({', '.join(_text(v) for v in spec)})" for spec in D.CURATED)
CURATED_SQL = f"""
    spec as (select * from (values {CURATED_VALUES}) t(generic, gene, phenotype, risk_level, patient, clinician, action)),
    named as (select s.*, case generic when 'clopidogrel' then 'Plavix' when 'citalopram' then 'Celexa' else 'Zocor' end as brand
      from spec s)"""
NOTE = " This information is for educational MVP purposes only and is not medical advice."


@query(
    "curated_rules",
    f"""with {CURATED_SQL}
        select x.id as pgx_result_id, x.patient_id, s.generic as medication_generic_name, s.brand as brand_name,
          s.risk_level, concat(s.patient, '{NOTE}') as patient_summary,
          coalesce(s.action, 'Review this result with a clinician before making medication changes.') as recommended_action,
          'mvp-v2' as rule_version, 'pending_review' as review_status
        from fx_pgx x join named s on s.gene = upper(trim(x.gene)) and s.phenotype = lower(trim(x.phenotype))""",
)
def curated_rules(spark, sf):
    """Starter rules beside every stored result that they speak of."""
    rules = curated.curated_rules(spark)
    results = view(spark, sf, "fx_pgx").select(
        F.col("id").alias("pgx_result_id"), "patient_id", S.norm_gene("gene").alias("gene"), S.norm_key("phenotype").alias("phenotype")
    )
    return results.join(rules, ["gene", "phenotype"]).select(
        "pgx_result_id", "patient_id", "medication_generic_name", "brand_name", "risk_level", "patient_summary",
        "recommended_action", "rule_version", "review_status",
    )


@query(
    "curated_records",
    f"""with {CURATED_SQL}
        select s.generic as "genericName", s.gene, s.phenotype, concat(s.clinician, '{NOTE}') as "rawSummary",
          'https://cpicpgx.org/guidelines/' as "sourceUrl", count(x.id) as n_results
        from named s left join fx_pgx x on s.gene = upper(trim(x.gene)) and s.phenotype = lower(trim(x.phenotype))
        group by all""",
)
def curated_records(spark, sf):
    """Starter records with the number of stored results for each."""
    records = curated.curated_records(spark)
    counts = (
        view(spark, sf, "fx_pgx")
        .groupBy(S.norm_gene("gene").alias("gene"), S.norm_key("phenotype").alias("phenotype"))
        .agg(F.count("id").alias("n_results"))
    )
    return records.join(counts, ["gene", "phenotype"], "left").select(
        "medication.genericName", "gene", "phenotype", "rawSummary", "sourceUrl",
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
    )


@query("load_tables", "select id, medication_id, gene, phenotype, risk_level, review_status, rule_version, imported_at from fx_store_rules")
def load_tables(spark, sf):
    root = scratch_path(spark, "store")
    tables.write_version(view(spark, sf, "fx_store_rules"), root, "drug_gene_rules", "0001")
    rules = tables.load_tables(spark, root)["drug_gene_rules"]
    return rules.select(
        "id", "medication_id", "gene", "phenotype", "risk_level", "review_status", "rule_version",
        F.col("imported_at").cast("timestamp_ntz").alias("imported_at"),
    )


@query("append_risk_results", f"select *, '2026-01-01' as run_date, 'run' as run_id from ({HISTORY}) t")
def append_risk_results(spark, sf):
    path = scratch_path(spark, "history")
    rows = history(spark, sf).drop("id")
    tables.append_risk_results(rows, path, "2026-01-01", "run")
    return tables.read_risk_results(spark, path).withColumn("run_date", F.col("run_date").cast("string"))


