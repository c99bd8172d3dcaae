"""Delimited files with a header, and the review file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allelegate.functions.text import first_filled
from allelegate.operators.staging import candidates_from_cells, medication_aliases
from allelegate.plans import domains as D
from allelegate.plans.schemas import STAGED_COLUMNS


def header_key(name: str | None) -> str:
    return " ".join((name or "").split()).lower()


def read_cells(spark: SparkSession, path: str | list[str], sep: str = ",", multi_line: bool = True) -> tuple[DataFrame, list[str]]:
    """Cells as text columns `c0`, `c1`, ... with order columns, and the header keys.

    Every file must have the header of the first one.  `multi_line=False` lets
    Spark split large files where no quoted cell holds a line break.
    """
    reader = (
        spark.read.option("sep", sep).option("multiLine", multi_line).option("quote", '"').option("escape", '"')
    )
    first = reader.option("header", False).csv(path).head()
    if first is None:
        raise ValueError(f"No header in {path}")
    names = [h if h is not None else "" for h in first]
    plain = len({n.lower() for n in names}) == len(names) and "" not in names
    labels = names if plain else [f"c{i}" for i in range(len(names))]
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in labels)
    # Names are checked against each file's header where they can be told apart.
    cells = reader.option("header", True).option("enforceSchema", not plain).schema(schema).csv(path)
    return (
        cells.select(
            *[F.col(f"`{n.replace('`', '``')}`").alias(f"c{i}") for i, n in enumerate(labels)],
            F.col("_metadata.file_path").alias("ord_file"),
            F.col("_metadata.file_block_start").alias("ord_block"),
            F.monotonically_increasing_id().alias("ord_row"),
        ),
        [header_key(n) for n in names],
    )


def pick(headers: list[str], aliases: list[str]) -> Column:
    """First filled cell among the aliases; of equal headers the last column counts."""
    place = {h: i for i, h in enumerate(headers)}
    found = [F.col(f"c{place[a]}") for a in aliases if a in place]
    return first_filled(*found) if found else F.lit("")


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    sep: str,
    source_name: str,
    source_url: str,
    aliases: DataFrame | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Staged placeholders from a CSV or TSV file."""
    cells, headers = read_cells(spark, path, sep, multi_line)
    return candidates_from_cells(
        cells,
        pick(headers, D.DRUG_HEADERS),
        pick(headers, D.GENE_HEADERS),
        pick(headers, D.PHENOTYPE_HEADERS),
        F.lit(source_name),
        F.lit(source_url),
        aliases if aliases is not None else medication_aliases(spark),
    )


def write_review_csv(rules: DataFrame, path: str) -> None:
    """Staged rules for review: fixed columns with a header, nulls blank, padding kept."""
    (
        rules.select(*STAGED_COLUMNS)
        .write.option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
