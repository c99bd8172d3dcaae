"""A stored index for searches: names in their order, and for each token the places of the names that hold it.

    names       place in the order of (name, id), and what a result shows
    tokens      token, and how many names hold it
    postings    token, places in order; segment 0 has the first FIRST places, and up to each next one GROWTH times as many

A token is a substring of one to GRAM letters, or "at least 2 ** k letters".  Every pattern has one that all its names
hold: the rarest substring of its longest plain run, or its length if it has no plain letter.  A search whose token up to
RARE names hold reads all of its places.  Any other reads segment after segment, and stops once it has its rows: as
places are in name order, what it reads does not grow with the names.  Posting lists are cut where every BLOCK names
end, so no token is one row or one group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allelegate.operators.match import active_medications
from allelegate.plans.session import scratch_path
from allelegate.plans.skew import with_position

GRAM = 3
FIRST, GROWTH, BLOCK, RARE = 64, 256, 1024, 4096
SHOWN = ["id", "generic_name", "brand_name", "drug_class"]
#: Longest length that a token tells, as a power of two.
LENGTHS = 30


def like_pattern(query: Column | str) -> Column:
    """`%query%` for `ilike`.

    `%`, `_` and `\\` keep their meaning.  A `\\` before any other character
    stands for that character, which `ilike` would reject, so it is removed.
    """
    q = F.col(query) if isinstance(query, str) else query
    whole = F.concat(F.lit("%"), q, F.lit("%"))
    return F.regexp_replace(whole, r"(?s)(\\[%_\\])|\\(.)", "$1$2")


def matches() -> Column:
    return F.expr("generic_name ilike _pattern or coalesce(brand_name ilike _pattern, false)")


def _grams(text: Column, n: int | Column) -> Column:
    """Distinct substrings of `n` characters; empty when the text is shorter."""
    last = F.length(text) - n + 1
    places = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, n if isinstance(n, Column) else F.lit(n))))


def _length_token(k: Column) -> Column:
    # no substring of a name is that long
    return F.concat(F.lit("length " + "." * GRAM), k.cast("string"))


def _log2(n: Column) -> Column:
    """Largest k with 2 ** k <= n; -1 for 0."""
    return F.when(n > 0, F.length(F.bin(n)) - 1).otherwise(F.lit(-1))


def name_tokens() -> Column:
    names = [F.lower(F.coalesce(c, F.lit(""))) for c in ("generic_name", "brand_name")]
    grams = [_grams(t, n) for t in names for n in range(1, GRAM + 1)]
    size = F.greatest(*map(F.length, names))
    sizes = F.transform(F.sequence(F.lit(-1), _log2(size)), _length_token)
    return F.array_distinct(F.concat(*grams, sizes))


def query_tokens(query: str) -> Column:
    """Tokens that every name matching the pattern holds."""
    runs = F.split(F.lower(query), r"(?s)\\.|[%_\\]")
    longest = F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))))["run"]
    # each sign but % stands for one letter, and so does an escaped one
    least = F.length(F.replace(F.regexp_replace(query, r"(?s)\\(.)", "_"), F.lit("%"), F.lit("")))
    return F.when(longest == "", F.array(_length_token(F.least(_log2(least), F.lit(LENGTHS))))).otherwise(
        _grams(longest, F.least(F.length(longest), F.lit(GRAM)))
    )


@dataclass(frozen=True)
class SearchIndex:
    spark: SparkSession
    path: str

    @property
    def names(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/names")

    @property
    def tokens(self) -> DataFrame:
        return self.spark.read.schema("token string, n long").parquet(f"{self.path}/tokens")

    @property
    def every_posting(self) -> DataFrame:
        return self.spark.read.schema("token string, block int, places array<long>, segment int").parquet(f"{self.path}/postings")

    def postings(self, segment: int) -> DataFrame:
        """Posting blocks of a segment; the others' files are not opened."""
        return self.every_posting.where(F.col("segment") == segment)

    @classmethod
    def built(cls, meds: DataFrame, path: str) -> SearchIndex:
        """Index of the active medications, written under `path`."""
        index = cls(meds.sparkSession, path)
        active = active_medications(meds).select(*SHOWN)
        with_position(active, [], ["generic_name", "id"], "place").write.mode("overwrite").parquet(f"{path}/names")
        place = F.col("place") - 1
        # powers of GROWTH = 256 past FIRST: pairs of hexadecimal digits of what is left after its bits
        beyond = F.shiftright(place, FIRST.bit_length() - 1)
        placed = index.names.select(
            "place",
            F.when(beyond == 0, 0).otherwise(F.ceil(F.length(F.hex(beyond)) / 2)).cast("int").alias("segment"),
            F.floor(place / BLOCK).cast("int").alias("block"),
            F.explode(name_tokens()).alias("token"),
        )
        blocks = placed.groupBy("segment", "token", "block").agg(F.sort_array(F.collect_list("place")).alias("places"))
        blocks.sortWithinPartitions("segment", "token").write.mode("overwrite").partitionBy("segment").parquet(f"{path}/postings")
        every = index.every_posting
        every.groupBy("token").agg(F.sum(F.size("places")).alias("n")).write.mode("overwrite").parquet(f"{path}/tokens")
        return index

    def search(self, asked: DataFrame, top: int) -> DataFrame:
        """(query, position, *SHOWN): the first `top` names for each distinct, non-blank `query`.

        Searches that have not found `top` rows go on with the next segment, while there is one: rounds grow with the
        logarithm of the names.
        """
        parsed = asked.select("query", like_pattern("query").alias("_pattern"), F.explode(query_tokens("query")).alias("token"))
        rarest = F.min_by(F.struct("token", "n"), F.struct(F.coalesce("n", F.lit(0)), F.col("token"))).alias("t")
        best = parsed.join(self.tokens, "token", "left").groupBy("query", "_pattern").agg(rarest)
        searches = self._kept(best.where("t.n is not null").select("query", "_pattern", "t.token", "t.n"), "searches")
        common = F.col("n") > RARE
        head = self._hits(searches.where(common), self.postings(0), top)
        rows = [self._kept(self._hits(searches.where(~common), self.every_posting, top).unionByName(head), "hits")]
        waiting, segment, reach = self._unfilled(searches.where(common), rows, top), 1, FIRST
        while not waiting.isEmpty() and not self.names.where(F.col("place") > reach).isEmpty():
            rows.append(self._kept(self._hits(waiting, self.postings(segment), top), "hits"))
            waiting = self._kept(self._unfilled(waiting, rows, top), "searches")
            segment, reach = segment + 1, reach * GROWTH
        return _first(_union(rows), top).select("query", "position", *SHOWN)

    def _unfilled(self, searches: DataFrame, rows: list[DataFrame], top: int) -> DataFrame:
        full = _union(rows).groupBy("query").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= top).select("query")
        return searches.join(full, "query", "left_anti")

    def _hits(self, searches: DataFrame, postings: DataFrame, top: int) -> DataFrame:
        places = searches.join(postings, "token").select("query", "_pattern", F.explode("places").alias("place"))
        hits = places.join(self.names, "place").where(matches()).select("query", "place", *SHOWN)
        return _first(hits, top)

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0].drop("position")
    for p in parts[1:]:
        out = out.unionByName(p.drop("position"))
    return out


def _first(hits: DataFrame, top: int) -> DataFrame:
    """The first `top` rows of each query; each task keeps as many before the shuffle."""
    by_name = F.expr("row_number() over (partition by query order by place)")
    return hits.withColumn("position", by_name).where(F.col("position") <= top)
