"""Which reader a source gets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allelegate.plans.domains import PAIR_FILE_MARK
from allelegate.plans.schemas import STAGED_COLUMNS
from allelegate.sources.delimited import read_delimited
from allelegate.sources.html_tables import candidates_from_html
from allelegate.sources.workbook import read_pair_workbook


def source_format(url: Column | str, content_type: Column | str) -> Column:
    """`workbook`, `csv`, `tsv` or `html`; null when no reader fits.

    The ending of the address decides before the content type, and only the
    pair file is accepted as a workbook.
    """
    address = F.lower(F.col(url) if isinstance(url, str) else url)
    kind = F.lower(F.coalesce(F.col(content_type) if isinstance(content_type, str) else content_type, F.lit("")))
    workbook = address.endswith(".xlsx") | kind.contains("spreadsheetml")
    return (
        F.when(workbook & address.contains(PAIR_FILE_MARK), "workbook")
        .when(workbook, F.lit(None))
        .when(address.endswith(".csv") | kind.contains("text/csv"), "csv")
        .when(address.endswith(".tsv") | kind.contains("tab-separated-values"), "tsv")
        .when(kind.contains("text/html") | address.endswith(".html") | address.endswith("/"), "html")
    )


def route_sources(manifest: DataFrame, url: str = "url", content_type: str = "content_type") -> DataFrame:
    """The manifest with `format` and, where no reader fits, `error`."""
    address = F.lower(url)
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    workbook = address.endswith(".xlsx") | kind.contains("spreadsheetml")
    return manifest.withColumn("format", source_format(url, content_type)).withColumn(
        "error",
        F.when(
            F.col("format").isNull(),
            F.when(workbook, F.concat(F.lit("No XLSX parser is configured for "), url)).otherwise(
                F.concat(F.lit("Unsupported source content type for "), url, F.lit(": "), kind)
            ),
        ),
    )


def read_source(
    spark: SparkSession, path: str, content_type: str = "", source_name: str = "custom_public_source", source_url: str | None = None
) -> DataFrame:
    """Staged placeholders from one landed source, by its format."""
    url = source_url or path
    routed = route_sources(spark.createDataFrame([(url, content_type)], "url string, content_type string")).first()
    if routed.error:
        raise ValueError(routed.error)
    if routed.format == "workbook":
        return read_pair_workbook(spark, path, url)
    if routed.format in ("csv", "tsv"):
        return read_delimited(spark, path, "," if routed.format == "csv" else "\t", source_name, url)
    pages = spark.read.text(path, wholetext=True).select(F.lit(url).alias("url"), F.col("value").alias("html"))
    return candidates_from_html(pages, "html", "url", source_name)


def read_landed(spark: SparkSession, sources: list[tuple[str, str, str, str]]) -> DataFrame:
    """Staged placeholders of (path, content type, name, address) sources, each by its own reader, in one table.

    The manifest is a short list; `ord_source` is the place in it.  A source that no reader fits fails the read
    before any file is opened.
    """
    routed = [read_source(spark, *source).select(F.lit(at).alias("ord_source"), *STAGED_COLUMNS) for at, source in enumerate(sources)]
    return reduce(DataFrame.unionByName, routed)
