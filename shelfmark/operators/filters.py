"""Search and filter transforms: DataFrame -> DataFrame, for .transform(). Columns that are absent are skipped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import columns as C
from shelfmark.functions import values


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def contains_ignoring_case(c: Column, term: str) -> Column:
    return F.coalesce(F.upper(c.cast("string")).contains(term.upper()), F.lit(False))


def search(term: str, columns: list[str] | None = None):
    """Rows in which any column contains the term, whatever its case."""

    def apply(df: DataFrame) -> DataFrame:
        names = [c for c in (columns or df.columns) if c in df.columns]
        return df.filter(any_of([contains_ignoring_case(F.col(f"`{c}`"), term) for c in names])) if term else df

    return apply


def filter_by(wanted: dict[str, list[str] | str | None], strict: bool = False):
    """Rows that pass every column's test: a list passes if any value is a case-sensitive substring, a string if it is contained whatever its case."""

    def apply(df: DataFrame) -> DataFrame:
        for name, value in wanted.items():
            if not value:
                continue
            if name not in df.columns:
                if strict:
                    raise ValueError(f"no column {name}")
                continue
            c = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
            df = df.filter(contains_ignoring_case(c, value) if isinstance(value, str) else any_of([c.contains(v) for v in value]))
        return df

    return apply


def options(pages: list[tuple[str, DataFrame, dict[str, str]]]) -> DataFrame:
    """(page, field, value, n): the values to choose from in each page's lists, given each field's delimiters, and how many records have them.

    A page's fields are taken from its rows in one pass.
    """

    def items_of(name: str, by: str) -> Column:
        return F.transform(C.split_list(F.col(f"`{name}`"), by), lambda v: F.struct(F.lit(name).alias("field"), v.alias("value")))

    parts = []
    for page, df, fields in pages:
        items = [items_of(name, by) for name, by in fields.items()]
        found = df.select(F.explode(F.concat(*items)).alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))
        parts.append(found.select(F.lit(page).alias("page"), "field", "value", "n"))
    return reduce(DataFrame.union, parts)


def relevant(c: Column, kinds: list[str]) -> Column:
    """Whether any of the kinds is a substring of the upper-cased text."""
    return any_of([F.upper(c).contains(k) for k in kinds])


def content_gate(df: DataFrame, column: str, least: int = 50) -> tuple[DataFrame, DataFrame]:
    """The rows with enough content, and the others with the reason."""
    enough = F.length(C.strip(F.coalesce(F.col(column), F.lit("")))) >= least
    return df.filter(enough), df.filter(~enough).withColumn("Issue Type", F.lit("Insufficient Content"))


def disease_terms(items: Column, repeat: bool = False) -> Column:
    """The lower-cased terms that contain a disease keyword, once, or once for each keyword hit; the first five keywords if there is none."""
    keywords = F.array(*map(F.lit, values.DISEASE_KEYWORDS))
    low = F.transform(items, F.lower)
    if repeat:
        hits = F.flatten(F.transform(low, lambda x: F.array_repeat(x, F.size(F.filter(keywords, lambda k: x.contains(k))))))
    else:
        hits = F.filter(low, lambda x: F.exists(keywords, lambda k: x.contains(k)))
    return F.when(F.size(hits) > 0, hits).otherwise(F.slice(keywords, 1, 5))
