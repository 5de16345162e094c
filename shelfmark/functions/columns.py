"""Column -> Column functions over text, lists in text, scores and links."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions import values


def strip(c: Column) -> Column:
    """Without white space at either end, non-breaking blanks included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def filled(c: Column) -> Column:
    return ~is_blank(c)


def clean_text(c: Column) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def split_list(c: Column, delimiters: str = ";") -> Column:
    """The trimmed, non-blank items of a list in text; any of the delimiters ends an item."""
    pattern = "[" + "".join("\\" + d for d in delimiters) + "]"
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), pattern), strip), lambda x: x != "")


def distinct_by(items: Column, key) -> Column:
    """The items whose key no earlier item has, in order."""
    none = F.array().cast("array<string>")

    def step(state, x):
        more = F.struct(F.concat(state["keys"], F.array(key(x))).alias("keys"), F.concat(state["kept"], F.array(x)).alias("kept"))
        return F.when(F.array_contains(state["keys"], key(x)), state).otherwise(more)

    return F.aggregate(items, F.struct(none.alias("keys"), none.alias("kept")), step, lambda state: state["kept"])


def expand_parens(items: Column) -> Column:
    """``Base (a,b)`` becomes Base, a, b: the first pair's contents, with every pair gone from the base."""

    def expand(x):
        inner = F.regexp_extract(x, r"\(([^)]+)\)", 1)
        base = strip(F.regexp_replace(x, r"\s*\([^)]*\)", ""))
        parts = F.transform(F.split(inner, ","), strip)
        return F.when(inner != "", F.filter(F.concat(F.array(base), parts), lambda y: y != "")).otherwise(F.array(x))

    return F.flatten(F.transform(items, expand))


def plain_apostrophes(c: Column) -> Column:
    return F.translate(c, values.APOSTROPHES, "'" * len(values.APOSTROPHES))


def nfkc(c: Column) -> Column:
    """Compatibility composition; the one function here that Spark has no built-in for."""

    @F.pandas_udf("string")
    def compose(text: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else unicodedata.normalize("NFKC", x) for x in text], dtype=object)

    # text in ASCII stays as it is, so only other text goes to Python and back
    return F.coalesce(compose(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


#: Between items while they are folded together: a control character, which no folding makes, takes or joins.
_BREAK = "\x1f"


def normalize_list(c: Column, delimiter: str = ";", split_on: str | None = None) -> Column:
    """Split, expand parentheses, compose (NFKC) and fold apostrophes, drop repeats whatever their case, sort by code point, join."""
    composed = F.split(nfkc(F.array_join(expand_parens(split_list(c, split_on or delimiter)), _BREAK)), _BREAK)
    items = F.transform(composed, lambda x: strip(plain_apostrophes(x)))
    kept = distinct_by(F.filter(items, lambda x: x != ""), F.lower)
    return F.array_join(F.array_sort(kept), delimiter)


def link_tokens(c: Column, delimiter: str = ";", drop_stopwords: bool = False) -> Column:
    """Items that can connect two nodes; with drop_stopwords none of the stop words and none of at most two characters."""
    items = split_list(c, delimiter)
    if not drop_stopwords:
        return items
    stop = F.array(*map(F.lit, values.LINK_STOPWORDS))
    return F.filter(items, lambda x: (F.length(x) > 2) & ~F.array_contains(stop, F.lower(x)))


def fix_pmc_link(c: Column) -> Column:
    return F.regexp_replace(c, r"PMCPMC(\d+)", "PMC$1")


def rotate_names(c: Column) -> Column:
    """Each ``First Middle Last`` as ``Last First Middle``; repeats go, compared in lower case without single inner capitals."""
    parts = lambda x: F.split(x, r"(?U)\s+")
    turned = F.transform(split_list(c), lambda x: strip(F.concat_ws(" ", F.element_at(parts(x), -1), F.array_join(F.slice(parts(x), 1, F.size(parts(x)) - 1), " "))))
    return F.array_join(distinct_by(turned, lambda x: F.lower(F.regexp_replace(x, r"(?U)\s+[A-Z]\s+", " "))), "; ")


def completeness(*columns: Column) -> Column:
    """Share of the columns that are filled, in percent."""
    count = reduce(lambda a, b: a + b, [F.when(filled(c), 1).otherwise(0) for c in columns])
    return count / F.lit(float(len(columns))) * 100


def truncate(c: Column, n: int) -> Column:
    short = strip(c)
    return F.when(F.length(short) > n, F.concat(F.substring(short, 1, n), F.lit("..."))).otherwise(short)


def within_tokens(c: Column, most: int) -> Column:
    return F.floor(F.length(c) / 4) <= most


def truncate_tokens(c: Column, most: int) -> Column:
    """At most about ``most`` tokens, four characters each."""
    return F.when(F.length(c) > 4 * most, F.concat(F.substring(c, 1, 4 * most), F.lit("..."))).otherwise(c)


def mask_key(c: Column) -> Column:
    return F.regexp_replace(c, r"api_key=[^&\s]+", "api_key=***")


def safe_id(c: Column, most: int = 64) -> Column:
    return F.substring(F.regexp_replace(c, "[^a-zA-Z0-9_-]", "_"), 1, most)


def last_segment(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def owner_repo(c: Column) -> tuple[Column, Column]:
    pattern = r"github\.com/([^/]+)/([^/]+)"
    return F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)


def first_number(c: Column) -> Column:
    """The first run of digits and commas as a number; null if there is none."""
    return F.replace(F.regexp_extract(c, "([0-9,]+)", 1), F.lit(","), F.lit("")).try_cast("double")


def level(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.contains("excellent"), "Excellent").when(low.contains("strong"), "Strong").when(low.contains("good"), "Good").otherwise("Unknown")


def grade(c: Column) -> Column:
    """3, 2, 1, 0 by keyword, 1.5 without one; the order of the tests matters."""
    low = F.lower(F.coalesce(c, F.lit("")))
    has = lambda *words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    return F.when(has("strong", "excellent"), 3.0).when(has("good"), 2.0).when(has("moderate", "fair"), 1.0).when(has("limited", "poor", "weak"), 0.0).otherwise(1.5)


def condition(c: Column, coded: str = "0", label: str = "Control/Wildtype") -> Column:
    return F.when(is_blank(c) | (strip(c) == coded), label).otherwise(c)


def clean_vocabulary(c: Column, mapping: dict[str, str] | None = None) -> Column:
    """A list without brackets and quotes, its terms mapped, those mapped to ``skip`` and repeats gone."""
    table = F.create_map(*[F.lit(x) for pair in (mapping or values.MODALITY_VOCABULARY).items() for x in pair])
    bare = F.regexp_replace(F.regexp_replace(strip(c), r"^[\[\]]+|[\[\]]+$", ""), "['\"]", "")
    terms = F.transform(split_list(bare, ","), lambda x: F.coalesce(F.try_element_at(table, x), x))
    return F.array_join(F.array_distinct(F.filter(terms, lambda x: x != "skip")), ", ")


def group_alias(c: Column, groups: dict[str, list[str]]) -> Column:
    """The group of an alias, or the value itself."""
    table = F.create_map(*[F.lit(x) for group, aliases in groups.items() for a in dict.fromkeys(aliases) for x in (a, group)])
    return F.coalesce(F.try_element_at(table, c), c)


def normalize_affiliation(c: Column) -> Column:
    chicago = F.when(c.contains("Rush Alzheimer's Disease Center") & c.contains("Chicago, IL"), F.replace(c, F.lit("Chicago, IL"), F.lit("Chicago, Illinois"))).otherwise(c)
    return F.when(chicago.contains("Mayo Clinic, Rochester, MN"), F.replace(chicago, F.lit("Rochester, MN"), F.lit("Rochester, Minnesota"))).otherwise(chicago)


def score_text(c: Column) -> Column:
    """``1`` to ``10`` as text, everything else ``N/A``."""
    number = F.when(strip(c).rlike(r"^[+-]?\d+$"), strip(c).try_cast("long"))
    return F.when(number.between(1, 10), number.cast("string")).otherwise("N/A")


def literal_list(c: Column) -> Column:
    """The quoted items of a list literal."""
    return F.regexp_extract_all(c, F.lit("'([^']*)'"), F.lit(1))


def prompt(template: str, *columns: Column, most: int = 8000) -> Column:
    """A prompt from a template with %s marks, each column cut to ``most`` characters."""
    return F.format_string(template, *[F.substring(c, 1, most) for c in columns])


def file_class(path: Column) -> Column:
    """readme, notebook, code or other, by file name."""
    name = F.lower(last_segment(path))
    code = r"\.(py|r|m|jl|java|cpp|c|js|go|rs)$"
    return F.when(name.startswith("readme"), "readme").when(name.endswith(".ipynb"), "notebook").when(name.rlike(code), "code").otherwise("other")


def in_skipped_folder(path: Column) -> Column:
    return path.rlike(r"(^|/)(\.git|node_modules|__pycache__|\.vscode|\.idea|dist|build)/")


def path_depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def publication_id(study: Column, title: Column) -> Column:
    return F.concat(study, F.lit(" - "), F.substring(title, 1, 50))


def url_encode(c: Column) -> Column:
    """Percent-encoding in which a blank is %20 and a slash stays."""
    return F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def section_header(line: Column) -> Column:
    """The section that a line opens, if any."""
    upper = F.upper(strip(line))
    out = F.lit(None).cast("string")
    for name, header in reversed(values.SECTIONS.items()):
        out = F.when(upper.contains(header), name).otherwise(out)
    return out


def fixed(number: Column, places: int) -> Column:
    """A number with that many decimals, rounded by its exact binary value, halves to even: 0.15 is a little less and gives 0.1."""
    return F.replace(F.format_number(number.cast("double"), places), F.lit(","), F.lit(""))
