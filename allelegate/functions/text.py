"""Text columns: the two normalizers, defaults, labels and validity tests.

Import keys collapse inner whitespace (`norm_*`); match keys keep it
(`trim_all`, `match_key`).  Both strip Unicode whitespace, which `trim` alone
does not, so the characters are written out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace of the import path and of the request path, space first.
_WIDE = "\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
IMPORT_SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85" + _WIDE
REQUEST_SPACE = " \t\n\x0b\x0c\r" + _WIDE + "\ufeff"

# Identifier and address patterns, note limit.
_NO_SPACE = "[^" + "".join(f"\\x{{{ord(c):x}}}" for c in REQUEST_SPACE) + "]+"
UUID_PATTERN = r"(?i)\A[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"
EMAIL_PATTERN = rf"\A{_NO_SPACE}@{_NO_SPACE}\.{_NO_SPACE}\z"
NOTE_LIMIT = 500


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def norm_text(value: Column | str) -> Column:
    """Null to blank, trimmed, inner whitespace runs collapsed to one space.

    Text of plain characters without a double space is only trimmed.  In other text whitespace becomes plain spaces by
    `translate`, and only what then holds a double space meets a regular expression: a third of the cost of matching
    every text against the whole class.
    """
    text = F.coalesce(_col(value).cast("string"), F.lit(""))
    spaced = F.trim(F.translate(text, IMPORT_SPACE[1:], " " * (len(IMPORT_SPACE) - 1)))
    odd = F.when(spaced.contains("  "), F.regexp_replace(spaced, " {2,}", " ")).otherwise(spaced)
    return F.when(text.contains("  ") | text.rlike("[^ -~]"), odd).otherwise(F.trim(text))


def norm_key(value: Column | str) -> Column:
    """`norm_text` in lower case; plain text without capitals is only trimmed."""
    text = F.coalesce(_col(value).cast("string"), F.lit(""))
    return F.when(text.contains("  ") | text.rlike(r"[^ -@\[-~]"), F.lower(norm_text(value))).otherwise(F.trim(text))


def norm_gene(value: Column | str) -> Column:
    return F.upper(norm_text(value))


def trim_all(value: Column | str) -> Column:
    """Null to blank, trimmed; inner whitespace is kept."""
    return F.btrim(F.coalesce(_col(value).cast("string"), F.lit("")), F.lit(REQUEST_SPACE))


def match_key(value: Column | str) -> Column:
    return F.lower(trim_all(value))


def norm_email(value: Column | str) -> Column:
    return match_key(value)


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(_col(value), F.lit(""))


def default_if_blank(value: Column | str, default: str) -> Column:
    """`norm_text`, with `default` where nothing is left."""
    return F.coalesce(blank_to_null(norm_text(value)), F.lit(default))


def first_filled(*values: Column | str) -> Column:
    """First non-empty value; a value of only spaces counts as filled."""
    return F.coalesce(*[blank_to_null(v) for v in values], F.lit(""))


def first_present(headers: list[str], *aliases: str) -> str | None:
    """First alias that is a header; on duplicate headers the first column wins.

    The choice is made while planning, so an empty cell does not fall through
    to the next alias.
    """
    return next((a for a in aliases if a in headers), None)


def default_phenotype(gene: Column | str) -> Column:
    return F.when(_col(gene).startswith("CYP"), "normal metabolizer").otherwise("normal function")


def split_genes(genes: Column | str) -> Column:
    """Array of normalized genes from a `,` or `;` separated cell."""
    parts = F.split(F.translate(_col(genes), ";", ","), ",")
    return F.transform(parts, norm_gene)


def risk_rank(level: Column | str) -> Column:
    level = _col(level)
    return (
        F.when(level == "potential_concern", 4)
        .when(level == "caution", 3)
        .when(level == "low_risk", 2)
        .when(level == "insufficient_data", 1)
        .otherwise(0)
    )


def missing_gene_message(genes: Column | str) -> Column:
    genes = _col(genes)
    noun = F.when(F.size(genes) == 1, "result").otherwise("results")
    return F.concat(
        F.lit("Missing "), F.array_join(genes, ", "), F.lit(" PGx "), noun, F.lit(" for this medication.")
    )


def add_disclaimer(summary: Column | str) -> Column:
    from allelegate.plans.domains import DISCLAIMER

    return F.concat(_col(summary), F.lit(DISCLAIMER))


def level_label(level: Column | str) -> Column:
    """`potential_concern` to `Potential Concern`; the tail of a word is kept as it is."""
    words = F.filter(F.split(F.coalesce(_col(level), F.lit("")), "_"), lambda w: w != "")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " "
    )


def is_uuid(value: Column | str) -> Column:
    return F.coalesce(_col(value).rlike(UUID_PATTERN), F.lit(False))


def is_email(value: Column | str) -> Column:
    return F.coalesce(_col(value).rlike(EMAIL_PATTERN), F.lit(False))


def in_domain(value: Column | str, allowed: list[str]) -> Column:
    return F.coalesce(_col(value).isin(allowed), F.lit(False))


def within_length(value: Column | str, limit: int = NOTE_LIMIT) -> Column:
    """At most `limit` UTF-16 units, so an emoji counts twice."""
    units = F.length(F.encode(F.coalesce(_col(value), F.lit("")), "UTF-16BE")) / 2
    return units <= limit


def token_hash(value: Column | str) -> Column:
    return F.sha2(_col(value), 256)


def rule_key_label(generic: Column | str, gene: Column | str, phenotype: Column | str) -> Column:
    return F.concat(_col(generic), F.lit(" + "), _col(gene), F.lit(" "), _col(phenotype))


def merged_notes(old: Column | str, new: Column | str) -> Column:
    """Both notes, marked, when they exist and differ."""
    old, new = _col(old), _col(new)
    return (
        F.when(old.isNull(), new)
        .when(new.isNull() | (old == new), old)
        .otherwise(F.concat(old, F.lit("\n[Merged record] "), new))
    )


def latest(old: Column | str, new: Column | str) -> Column:
    return F.greatest(_col(old), _col(new))


def expires_at(start: Column | str, hours: int = 12) -> Column:
    return _col(start) + F.make_dt_interval(hours=F.lit(hours))


def stable_id(*parts: Column | str) -> Column:
    """Id from the business key: the same on every retry, and different for different keys.

    A | or \\ inside a part is escaped and a null part is marked, so parts cannot run into each other.
    """

    def part(p: Column | str) -> Column:
        text = _col(p).cast("string")
        return F.coalesce(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\\N"))

    return F.md5(F.concat_ws("|", *[part(p) for p in parts]))
