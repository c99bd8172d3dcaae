"""Line dedup by site-relative frequency, in DataFrame functions only.

Per host, a line is boilerplate if more than `percent` of the host's different page texts hold it, and at least
`min_pages` of them.  Exact copies of a page count as one page, so copying a page makes no line of it boilerplate.
Every copy of a boilerplate line goes from every page of that host; other lines stay as they are, in order.

A host has at most (lines per page * 100 / percent) boilerplate lines, so its list is short whatever its number of
pages.  Lists are joined to pages on the host and one of SALTS numbers, so a hot host's pages go to many tasks.
Lines travel as 128-bit hashes and are counted before they are shuffled.

Nulls and odd rows: no text stays null, with 0 lines; lines without a word stay; a null host is the host ''.
A page of nothing but boilerplate keeps its row, with an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERCENT, MIN_PAGES = 8, 4
#: Parts of a host; each has a copy of the host's list.
SALTS = 64
WORD = r"[^\x20\x09-\x0D]"


def _key(value: Column) -> Column:
    return F.struct(F.xxhash64(value).alias("x"), F.xxhash64(F.lit(1), value).alias("y"))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", percent: int = PERCENT, min_pages: int = MIN_PAGES) -> DataFrame:
    """(_host, _lines): the hashes of each host's boilerplate lines."""
    worded = F.filter(F.split(F.col(text), "\n"), lambda line: line.rlike(WORD))
    pages = (
        docs.where(F.col(text).isNotNull())
        .select(
            F.coalesce(F.col(host), F.lit("")).alias("_host"),
            _key(F.col(text)).alias("_page"),
            F.array_distinct(F.transform(worded, _key)).alias("_keys"),
        )
        .dropDuplicates(["_host", "_page"])
    )
    totals = pages.groupBy("_host").agg(F.count("*").alias("_pages"))
    counts = pages.select("_host", F.explode("_keys").alias("_key")).groupBy("_host", "_key").agg(F.count("*").alias("_n"))
    return (
        counts.where(F.col("_n") >= min_pages)
        .join(totals, "_host")
        .where(100 * F.col("_n") > percent * F.col("_pages"))
        .groupBy("_host")
        .agg(F.collect_list("_key").alias("_lines"))
    )


def line_dedup(docs: DataFrame, host: str = "source", text: str = "text", percent: int = PERCENT, min_pages: int = MIN_PAGES) -> DataFrame:
    """All columns of `docs`, `text` without boilerplate lines, then n_lines and n_dropped (of the text as it was)."""
    dropped = boilerplate(docs, host, text, percent, min_pages)
    dropped = dropped.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("_host", "_of")
    rows = docs.withColumns({"_site": F.coalesce(F.col(host), F.lit("")), "_part": F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int")})
    rows = rows.join(dropped, (F.col("_site") == F.col("_of")) & (F.col("_part") == F.col("_salt")), "left")
    lines = F.split(F.col(text), "\n")
    kept = F.when(F.col("_lines").isNull(), lines).otherwise(F.filter(lines, lambda line: ~F.array_contains("_lines", _key(line))))
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return rows.withColumn("_kept", kept).select(
        *(F.array_join("_kept", "\n").alias(c) if c == text else F.col(c) for c in own),
        F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col(text).isNull(), 0).otherwise(F.size(lines) - F.size("_kept")).cast("long").alias("n_dropped"),
    )


SQL = f"""
with d as (select distinct coalesce(source, '') as host, text from documents where text is not null),
totals as (select host, count(*) as n from d group by host),
lines as (select distinct host, text, unnest(string_split(text, chr(10))) as line from d),
bad as (select l.host, l.line from lines l join totals t on t.host = l.host
        where regexp_matches(l.line, '[^ \\x09-\\x0D]')
        group by l.host, l.line, t.n having count(*) >= {MIN_PAGES} and 100 * count(*) > {PERCENT} * t.n),
o as (select row_number() over () as r, * from documents),
u as (select r, coalesce(source, '') as host, unnest(string_split(text, chr(10))) as line,
             generate_subscripts(string_split(text, chr(10)), 1) as at from o where text is not null),
k as (select u.r, count(*) as n_lines, count(b.line) as n_dropped,
             coalesce(string_agg(u.line, chr(10) order by u.at) filter (where b.line is null), '') as text
      from u left join bad b on b.host = u.host and b.line = u.line group by u.r)
select o.doc_id, k.text, coalesce(k.n_lines, 0) as n_lines, coalesce(k.n_dropped, 0) as n_dropped
from o left join k on k.r = o.r
"""
