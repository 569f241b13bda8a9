"""Small Column helpers shared by the operators and analyses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANK_PREFIXES = {"domain": "d__", "phylum": "p__", "class": "c__", "order": "o__",
                 "family": "f__", "genus": "g__", "species": "s__"}


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def lookup(col: Column, table: Mapping) -> Column:
    """Code to label by a literal map; unknown codes give null."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col)


def ordered_levels(df: DataFrame, name: str, levels: Sequence[str],
                   labels: Sequence[str] | None = None) -> DataFrame:
    """Restrict a column to a list of levels and give it an order.

    Values outside ``levels`` become null. ``<name>_ord`` is the 1-based level.
    """
    labels = list(labels or levels)
    ordinal = lookup(F.col(name), {v: i + 1 for i, v in enumerate(levels)})
    return df.withColumns({
        name + "_ord": ordinal,
        name: lookup(F.col(name), dict(zip(levels, labels))),
    })


def strip_prefix(col: Column, prefix: str) -> Column:
    return F.regexp_replace(col, "^" + re.escape(prefix), "")


def strip_rank_prefixes(df: DataFrame, prefixes: Mapping[str, str] = RANK_PREFIXES) -> DataFrame:
    """Remove the rank marker from every taxonomy column that is present."""
    return df.withColumns({c: strip_prefix(F.col(c), p)
                           for c, p in prefixes.items() if c in df.columns})


def label_blank(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Blank cells become ``Unclassified <column name>``."""
    return df.withColumns({c: F.when(F.col(c) == "", F.lit(f"Unclassified {c}"))
                           .otherwise(F.col(c)) for c in names})


def replace_each(col: Column, replacements: Mapping[str, str]) -> Column:
    """Apply an ordered list of regex replacements."""
    return reduce(lambda c, kv: F.regexp_replace(c, kv[0], kv[1]), replacements.items(), col)


def day_number(timepoint: Column) -> Column:
    """Timepoint label to days: ``21dpi`` is 21 and ``6_months`` is 180."""
    return replace_each(timepoint, {"6_months": "180", "dpi": ""}).try_cast("double")


def any_column_matches(names: Sequence[str], pattern: str) -> Column:
    """True where at least one of the columns matches the regex, ignoring case."""
    hits = [F.coalesce(F.col(c).cast("string").rlike("(?i)" + pattern), F.lit(False)) for c in names]
    return reduce(lambda a, b: a | b, hits)


def matched_terms(names: Sequence[str], terms: Sequence[str]) -> Column:
    """Which of the terms occur anywhere in the row, joined by ', '; null if none."""
    text = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in names]))
    found = [F.when(F.contains(text, F.lit(t.lower())), F.lit(t)) for t in terms]
    return F.nullif(F.concat_ws(", ", *found), F.lit(""))


def exclude_replicates(df: DataFrame, sample: str = "sample", mark: str = "Repeat") -> DataFrame:
    return df.filter(~F.contains(F.col(sample), F.lit(mark)))


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on every column name the two frames share."""
    return left.join(right, on=common_columns(left, right), how=how)


def columns_containing(df: DataFrame, parts: Sequence[str]) -> list[str]:
    """Column names that contain any of the parts, ignoring case."""
    return [c for c in df.columns if any(p.lower() in c.lower() for p in parts)]


def clean_names(df: DataFrame) -> DataFrame:
    """Replace every character other than letters, digits, '.' and '_' by '.'."""
    return df.toDF(*[re.sub(r"[^0-9A-Za-z._]", ".", c) for c in df.columns])


def p_symbol(p: Column) -> Column:
    """Significance stars."""
    return (F.when(p.isNull(), None).when(p <= 1e-4, "****").when(p <= 1e-3, "***")
            .when(p <= 1e-2, "**").when(p <= 0.05, "*").otherwise("ns"))
