"""Rows of HTML tables.

Spark hands batches of pages to tasks; a small parser builds the tables of one
page, and everything after the cells is columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelegate.functions.text import first_filled
from allelegate.operators.staging import candidates_from_cells, medication_aliases
from allelegate.plans import domains as D
from allelegate.sources.delimited import header_key

# Elements that never have an end tag, and text that is not shown.
VOID = set("area base br col embed hr img input keygen link meta param source track wbr".split())
HIDDEN = {"script", "style", "template"}


class _Tables(HTMLParser):
    """Collects tables; text goes to every open cell, joined by spaces.

    An end tag closes back to its start tag.  A table, row or cell left open
    goes on to the end of what contains it.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, dict | None]] = []
        self.tables: list[dict] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        node = None
        if tag == "table":
            node = {"heads": [], "rows": []}
            self.tables.append(node)
        elif tag == "tr":
            node = {"cells": []}
            for name, outer in self.open:
                if name == "table":
                    outer["rows"].append(node)
        elif tag in ("td", "th"):
            node = {"text": []}
            names = [name for name, _ in self.open]
            for name, outer in self.open:
                if tag == "td" and name == "tr":
                    outer["cells"].append(node)
                if tag == "th" and name == "table" and "tr" in names:
                    outer["heads"].append(node)
        self.open.append((tag, node))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                del self.open[at:]
                return

    def handle_data(self, data):
        if any(name in HIDDEN for name, _ in self.open[-1:]):
            return
        for name, node in self.open:
            if name in ("td", "th"):
                node["text"].append(data)


def table_rows(html: str) -> Iterator[tuple[int, int, dict[str, str]]]:
    """(table number, row number, header to cell) of every row with a cell per header."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    clean = lambda node: " ".join(" ".join(node["text"]).split())
    for t, table in enumerate(parser.tables):
        heads = [header_key(clean(h)) for h in table["heads"]]
        if not heads:
            continue
        for r, row in enumerate(table["rows"]):
            cells = [clean(c) for c in row["cells"]]
            if len(cells) >= len(heads):
                # Extra cells are cut; of equal headers the last one counts.
                yield t, r, dict(zip(heads, cells, strict=False))


def read_html_tables(pages: DataFrame, html: str, key: str) -> DataFrame:
    """(key, ord_table, ord_row, cells) for every table row of every page."""
    kind = pages.schema[key].dataType.simpleString()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for page, text in zip(batch["page"], batch["html"], strict=True):
                found = [(page, t, r, cells) for t, r, cells in table_rows(text)]
                if found:
                    yield pd.DataFrame(found, columns=[key, "ord_table", "ord_row", "cells"])

    rows = pages.select(F.col(key).alias("page"), F.col(html).alias("html"))
    return rows.mapInPandas(parse, f"{key} {kind}, ord_table int, ord_row int, cells map<string,string>")


def _cell(aliases: list[str]) -> Column:
    return first_filled(*[F.try_element_at("cells", F.lit(a)) for a in aliases])


def candidates_from_html(
    pages: DataFrame, html: str, key: str, source_name: str, source_url: str | None = None, aliases: DataFrame | None = None
) -> DataFrame:
    """Staged placeholders from the tables of pages; `source_url` is a column, by default `key`."""
    rows = read_html_tables(pages, html, key).withColumn("ord_page", F.col(key))
    aliases = aliases if aliases is not None else medication_aliases(pages.sparkSession)
    return candidates_from_cells(
        rows,
        _cell(D.DRUG_HEADERS),
        _cell(D.GENE_HEADERS),
        _cell(D.PHENOTYPE_HEADERS),
        F.lit(source_name),
        F.col(source_url or key).cast("string"),
        aliases,
    )
