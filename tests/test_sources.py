"""Readers and writers on small hand-made files."""

import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from allelegate.operators import audit as A
from allelegate.plans import domains as D
from allelegate.plans.schemas import STAGED_COLUMNS
from allelegate.sources import curated, delimited, html_tables, routing, tables, workbook

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def test_csv_aliases_padding_and_duplicates(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_text(
        'Drug,Gene,Gene Symbol,phenotype,PHENOTYPE,note\n'
        'Plavix , ,CYP2C19,ignored,Poor  Metabolizer,"two\nlines, ""quoted"""\n'
        '"",cyp2c19,,x,poor metabolizer,\n'
        'zocor,,slco1b1,x,normal function,extra,surplus\n'
        'CELEXA,cyp2c19,,x,unheard of,\n'
        'celexa,CYP2C19\n'
    )
    got = delimited.read_delimited(spark, str(path), ",", "src", "url").orderBy("ord_row").collect()
    # A gene of one space counts as filled and hides the next alias.
    assert [(r.medication_generic_name, r.gene, r.phenotype) for r in got] == [
        ("clopidogrel", "", "poor metabolizer"), ("simvastatin", "SLCO1B1", "normal function")]
    assert {(r.evidence_source, r.evidence_url, r.rule_version, r.review_status, r.risk_level) for r in got} == {
        ("src", "url", "source-import-v0", "pending_review", "insufficient_data")}


def test_tsv(spark, tmp_path):
    path = tmp_path / "list.tsv"
    path.write_text("medication\tgene_symbol\tfunction\nsimvastatin\t slco1b1 \tPoor Function\n")
    got = delimited.read_delimited(spark, str(path), "\t", "s", "u").first()
    assert (got.brand_name, got.gene, got.phenotype) == ("Zocor", "SLCO1B1", "poor function")


def book(rows, shared=(), name="xl/worksheets/sheet1.xml"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{''.join(f'<si>{s}</si>' for s in shared)}</sst>")
        z.writestr(name, f"<worksheet {NS}><sheetData>{''.join(f'<row>{r}</row>' for r in rows)}</sheetData></worksheet>")
    return out.getvalue()


def test_workbook(spark, tmp_path):
    shared = ["<t>Gene</t>", "<r><t>Drug</t></r><r><t>(s)</t></r>", "<t>CYP2C19; SLCO1B1,HLA</t>"]
    rows = [
        '<c r="B1" t="s"><v>0</v></c><c r="D1" t="s"><v>1</v></c>',
        '<c r="B2" t="s"><v>2</v></c><c r="D2" t="inlineStr"><is><t> Plavix</t></is></c>',
        '<c r="D3" t="inlineStr"><is><t>zocor</t></is></c>',
        '<c r="B4" t="inlineStr"><is><t>slco1b1,SLCO1B1</t></is></c><c/><c t="inlineStr"><is><t>ZOCOR</t></is></c>',
    ]
    path = tmp_path / "cpic_gene-drug_pairs.xlsx"
    path.write_bytes(book(rows, shared, "xl/worksheets/sheet7.xml"))
    got = workbook.read_pair_workbook(spark, str(path), "u").orderBy("ord_row", "ord_gene").collect()
    assert [(r.medication_generic_name, r.gene, r.phenotype) for r in got] == [
        ("clopidogrel", "CYP2C19", "normal metabolizer"), ("clopidogrel", "SLCO1B1", "normal function"),
        ("simvastatin", "SLCO1B1", "normal function"), ("simvastatin", "SLCO1B1", "normal function")]
    assert {(r.evidence_source, r.rule_version) for r in got} == {("CPIC", "cpic-pair-import-v0")}
    assert routing.read_source(spark, str(path)).count() == 4


def test_ranges_of_a_sheet_give_the_rows_of_the_whole(spark, tmp_path, monkeypatch):
    """Any cut of the sheet, also inside a tag, with texts in the shared table, prefixes and closed rows."""
    monkeypatch.setattr(workbook, "CHUNK", 97)
    monkeypatch.setattr(workbook, "BATCH", 3)
    shared = [f"<t>{t}</t>" for t in ("Drug", "Genes", "Plavix", "CYP2C19")]
    rows = ['<c t="s"><v>0</v></c><c t="s"><v>1</v></c>']
    rows += [f'<c t="s"><v>2</v></c><c t="inlineStr"><is><t>G{i}&lt;row&gt;</t></is></c>' if i % 3 else '<c r="B1" t="s"><v>3</v></c>' for i in range(20)]
    content = book(rows, shared)
    with zipfile.ZipFile(io.BytesIO(content)) as opened:
        sheet = opened.read("xl/worksheets/sheet1.xml").replace(b"</sheetData>", b'<row r="9"/><row><c t="s"><v>77</v></c></row></sheetData>')
    plain = sheet.replace(f"{NS}".encode(), NS.replace("xmlns=", "xmlns:x=").encode())
    prefixed = re.sub(rb"<(/?)(?=[a-z])", rb"<\1x:", plain)
    for text in (sheet, prefixed):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            strings = f"<sst {NS}>{''.join(f'<si>{s}</si>' for s in shared)}</sst>"
            z.writestr("xl/sharedStrings.xml", strings)
            z.writestr("xl/worksheets/sheet1.xml", text)
        whole_book = zipfile.ZipFile(out)
        whole = list(workbook.pair_rows(whole_book))
        assert len(whole) == 22 and whole[0] == (0, "", "CYP2C19") and whole[1] == (1, "Plavix", "G1<row>") and whole[-1] == (21, "", "")
        for step in (1, 7, 64, 500):
            cut = [r for low in range(0, len(text), step) for r in workbook.pair_rows(whole_book, low, low + step)]
            assert cut == whole
    path = tmp_path / "many.xlsx"
    path.write_bytes(out.getvalue())
    read = lambda n: spark.read.format("pair_workbook").option("splitBytes", n).load(str(path))
    workbook.read_pair_workbook(spark, str(path), "u")  # registers the source
    assert read(400).rdd.getNumPartitions() > 2
    assert sorted(map(tuple, read(400).collect())) == sorted(map(tuple, read(1 << 20).collect())) == [(str(path), *r) for r in whole]


def test_landed_workbooks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbook, "MAX_ROWS", 3)
    pairs = [("Plavix", "CYP2C19"), (None, "x"), ("a & <b>", None), ("", ""), ("\x01zocor", "slco1b1")]
    made = spark.createDataFrame(pairs, "drug string, genes string").coalesce(1)
    workbook.write_pair_workbooks(made.limit(0), f"{tmp_path}/none")
    workbook.write_pair_workbooks(made, f"file://{tmp_path}/landed")
    (tmp_path / "landed" / "_left").write_bytes(b"of a failed job")
    got = spark.read.format("pair_workbook").load(str(tmp_path / "landed")).collect()
    assert sorted((r.drug, r.genes) for r in got) == [("", ""), ("", "x"), ("Plavix", "CYP2C19"), ("a & <b>", ""), ("zocor", "slco1b1")]
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("pair_workbook").load(str(tmp_path / "nowhere")).collect()


def test_first_sheet_is_the_first_of_the_list():
    """The list decides, not the member's number."""
    out = io.BytesIO()
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006/relationships"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {NS}/>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {NS}/>")
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{office}"><sheets><sheet r:id="b"/><sheet r:id="a"/></sheets></workbook>')
        links = '<Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/>'
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}">{links}</Relationships>')
    with zipfile.ZipFile(out) as opened:
        assert workbook.first_sheet(opened) == "xl/worksheets/sheet2.xml"
        assert list(workbook.pair_rows(opened)) == []
    with zipfile.ZipFile(io.BytesIO(book([], name="xl/worksheets/sheet12.xml"))) as opened:
        assert workbook.first_sheet(opened) == "xl/worksheets/sheet12.xml"


def test_first_present_column_wins_even_when_empty():
    headers = ["drug", "genes", "gene", "gene"]
    assert workbook._first_inside(["x", "", "G"], headers, D.PAIR_GENE_HEADERS) == ""
    assert workbook._first_inside(["x"], headers, D.PAIR_GENE_HEADERS) == ""
    assert [workbook.column_number(r) for r in ("A1", "Z9", "AA10", "")] == [0, 25, 26, None]


HTML = """
<p>Drug</p><table><tr><td>no head</td></tr></table>
<table><thead><tr><th>Drug</th><th>GENE <b>symbol</b></th><th>Phenotype</th></tr></thead>
<tr><td>Plavix</td><td>cyp2c19</td><td>poor<br>metabolizer</td><td>cut</td></tr>
<tr><td>celexa</td><td>CYP2C19</td></tr>
<tr><td>other</td><td>CYP2C19</td><td>poor metabolizer</td></tr>
<tr><td>zocor &amp;</td><td>x</td><td>y</td></tr>
<tr><td>Zocor<script>var a;</script></td><td>slco1b1</td><td> poor   function </td></tr></table>"""


def test_html_tables(spark):
    pages = spark.createDataFrame([("u/", HTML), ("v/", "plain"), ("w/", None)], "url string, html string")
    got = html_tables.candidates_from_html(pages, "html", "url", "site").collect()
    assert sorted((r.medication_generic_name, r.gene, r.phenotype, r.evidence_url) for r in got) == [
        ("clopidogrel", "CYP2C19", "poor metabolizer", "u/"), ("simvastatin", "SLCO1B1", "poor function", "u/")]


def test_nested_tables_and_row_headers():
    nested = "<table><tr><th>a</th><td><table><tr><th>b</th></tr><tr><td>1</td><td>2</td></tr></table></td></tr></table>"
    found = list(html_tables.table_rows(nested))
    # The outer table counts the inner heads and rows as its own.
    assert (0, 0, {"a": "b 1 2", "b": "1"}) in found and (1, 1, {"b": "1"}) in found


@pytest.mark.parametrize(
    "url, kind, want",
    [
        ("h/CPIC_gene-drug_pairs.XLSX", "", "workbook"), ("h/x.xlsx", "text/csv", None), ("h/x.csv", None, "csv"),
        ("h/x", "text/CSV; q", "csv"), ("h/x.tsv", "", "tsv"), ("h/x", "text/tab-separated-values", "tsv"),
        ("h/x.html", "", "html"), ("h/", "", "html"), ("h/x", "text/html", "html"), ("h/x", "application/json", None),
    ],
)
def test_routes(spark, url, kind, want):
    manifest = spark.createDataFrame([(url, kind)], "url string, content_type string")
    got = routing.route_sources(manifest).first()
    assert got.format == want and (got.error is None) == (want is not None)


def test_review_file_and_versions(spark, tmp_path):
    rules = curated.curated_rules(spark).withColumn("evidence_url", F.when(F.col("gene") == "SLCO1B1", F.col("evidence_url")))
    path = str(tmp_path / "review")
    delimited.write_review_csv(rules.coalesce(1), path)
    cells, headers = delimited.read_cells(spark, path)
    assert headers == STAGED_COLUMNS and cells.count() == 14
    root = str(tmp_path / "store")
    meds = spark.createDataFrame([("1", "a")], "id string, generic_name string").selectExpr(
        "id", "generic_name", "null as brand_name", "null as drug_class", "true as is_active", "current_timestamp() as created_at", "current_timestamp() as updated_at")
    assert tables.current_version(spark, root, "medications") is None
    tables.write_version(meds, root, "medications", "0001")
    tables.write_version(meds.union(meds.withColumn("id", F.lit("2"))), root, "medications", "0002")
    assert tables.load_tables(spark, root, ["medications"])["medications"].count() == 2
    assert [r.name for r in A.missing_tables(tables.stored_tables(spark, root)).collect()] == [
        t for t in D.REQUIRED_TABLES if t != "medications"]


def test_history_of_a_run_is_replaced_not_doubled(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = spark.createDataFrame([("h1", "p")], "id string, patient_id string")
    for run in ("a", "a", "b"):
        tables.append_risk_results(rows, path, "2026-01-01", run)
    tables.append_risk_results(rows, path, "2026-01-01", "c")
    tables.append_risk_results(rows.limit(0), path, "2026-01-01", "c")
    assert sorted(r.run_id for r in tables.read_risk_results(spark, path).collect()) == ["a", "b"]


def test_audit_of_an_empty_and_a_seeded_store(spark):
    none_meds = spark.createDataFrame([], "id string, generic_name string, brand_name string, is_active boolean")
    none_rules = spark.createDataFrame([], "id string, medication_id string, gene string, phenotype string")
    names = [m for m in D.MEDICATION_ALIASES if m[0] == m[1]]
    want_meds = spark.createDataFrame([(m[1], m[2]) for m in names], "generic_name string, brand_name string")
    want_rules = spark.createDataFrame([s[:3] for s in D.CURATED], "generic_name string, gene string, phenotype string")
    all_there = spark.createDataFrame([(t,) for t in D.REQUIRED_TABLES], "name string")
    got = {r.message for r in A.audit_coverage(want_meds, want_rules, none_meds, none_rules, all_there).collect()}
    assert "Missing MVP medication: clopidogrel / Plavix" in got
    assert "Missing MVP drug-gene rule: simvastatin + SLCO1B1 poor function" in got and len(got) == 19 and "false" in got
    meds = spark.createDataFrame([(m[1], m[1].upper(), m[2].lower(), True) for m in names], none_meds.schema)
    rules = spark.createDataFrame([(str(i), s[0], s[1].lower(), s[2].upper()) for i, s in enumerate(D.CURATED)], none_rules.schema)
    got = {(r.kind, r.message) for r in A.audit_coverage(want_meds, want_rules, meds, rules, all_there).collect()}
    assert got == {("passed", "Required tables exist."), ("passed", "MVP medications exist with active rows and IDs."),
                   ("passed", "Required MVP drug-gene rules exist (14 phenotype rules)."), ("ok", "true")}
    existing = spark.createDataFrame([("users",)], "name string")
    assert A.audit_coverage(want_meds, want_rules, meds, rules, existing).first().message == (
        "Missing required tables: medications, drug_gene_rules, patients, patient_medications, user_sessions, pgx_results, risk_results")
    # with go_on, the checks of the tables that are there still run
    kept = lambda *gone: {
        (r.kind, r.message.split("(")[0])
        for r in A.audit_coverage(want_meds, want_rules, meds, rules, all_there.where(~F.col("name").isin(*gone)), go_on=True).collect()}
    meds_passed, rules_passed = ("passed", "MVP medications exist with active rows and IDs."), ("passed", "Required MVP drug-gene rules exist ")
    assert kept("users") == {("failure", "Missing required tables: users"), meds_passed, rules_passed, ("ok", "false")}
    assert kept("drug_gene_rules") == {("failure", "Missing required tables: drug_gene_rules"), meds_passed, ("ok", "false")}
    assert kept("medications") == {("failure", "Missing required tables: medications"), ("ok", "false")}
