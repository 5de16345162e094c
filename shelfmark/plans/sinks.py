"""Writers, text renderings and the profile of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.functions import columns as C


_RULE = "=" * 80


def banner(title: str) -> str:
    return f"{_RULE}\n{title.center(80)}\n{_RULE}\n"


def text_records(df: DataFrame, order: str, title: str = "Data Summary") -> DataFrame:
    """(row, value): under row -1 a banner with the number of records, then a record's filled columns as ``name: value`` lines.

    A value of several lines begins on the line after its name, each line
    indented by two blanks. ``order`` numbers the records.
    """
    shown = [c for c in df.columns if c != order]

    def line(c: str) -> Column:
        value = F.col(f"`{c}`").cast("string")
        several = F.concat(F.lit(f"{c}:\n  "), F.replace(value, F.lit("\n"), F.lit("\n  ")))
        return F.when(C.filled(value), F.when(value.contains("\n"), several).otherwise(F.concat(F.lit(f"{c}: "), value)))

    head = df.agg(F.count("*").alias("n")).select(F.lit(-1).cast("long").alias("row"), F.format_string(f"{banner(title)}\nTotal Records: %d\n\n{_RULE}\n", "n").alias("value"))
    name = F.format_string("Record %d:\n" + "-" * 80, F.col(order).cast("long"))
    return head.union(df.select(F.col(order).cast("long"), F.concat(F.concat_ws("\n", name, *map(line, shown)), F.lit("\n"))))


def export(df: DataFrame, path: str, fmt: str = "csv", order: str | None = None) -> None:
    """csv, tsv, json (a record a line), json_array (one array, by a unique order) or text; any other format is csv."""
    if fmt == "tsv":
        df.write.option("header", True).option("sep", "\t").csv(path)
    elif fmt == "json":
        df.write.json(path)
    elif fmt == "text":
        text_records(df, order or df.columns[0]).sort("row").select("value").write.text(path)
    elif fmt == "json_array":
        # the records as one array, a line a record: the first opens it, the last closes it
        last = df.agg(F.max(order or df.columns[0]).alias("last"), F.min(order or df.columns[0]).alias("first"))
        key = F.col(order or df.columns[0])
        marked = df.select(key.alias("row"), F.to_json(F.struct(*df.columns)).alias("value")).crossJoin(F.broadcast(last))
        marked.select("row", F.concat(F.when(F.col("row") == F.col("first"), "[").otherwise(""), "value", F.when(F.col("row") == F.col("last"), "]").otherwise(",")).alias("value")).sort("row").select("value").write.text(path)
    else:
        df.write.option("header", True).csv(path)


def profile(df: DataFrame) -> DataFrame:
    """(column, type, nulls, row_count): one row a column."""
    counted = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n_{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"n_{i}").alias("nulls"), F.col("rows").alias("row_count")) for i, (c, t) in enumerate(df.dtypes)])
    return counted.select(F.inline(rows))


def citation(authors: Column, title: Column, link: Column) -> Column:
    """``authors. title.`` and the link, if there is one."""
    return F.concat(authors, F.lit(". "), title, F.lit("."), F.when(C.filled(link), F.concat(F.lit(" "), link)).otherwise(""))


def graph_summary(statistics: DataFrame, degrees: DataFrame, details: DataFrame, shown: int = 20, top: int = 10) -> DataFrame:
    """(section, row, value): the statistics, the nodes of most connections, the first edges by weight, and how many more there are."""
    line = lambda section, row, text: [F.lit(section).alias("section"), row.cast("int").alias("row"), text.alias("value")]
    figures = [
        F.format_string("Nodes (Datasets): %d", "nodes"), F.format_string("Edges (Connections): %d", "edges"), F.concat(F.lit("Graph Density: "), C.fixed(F.col("density"), 4)),
        F.concat(F.lit("Average Connections per Node: "), C.fixed(F.col("mean_degree"), 2)), F.format_string("Maximum Connections: %d", "max_degree"), F.format_string("Connected Components: %d", "components"),
    ]
    stats = statistics.select(F.posexplode(F.array(*figures)).alias("row", "value")).select(*line(1, F.col("row"), F.col("value")))
    numbered = lambda df, keys, n: df.orderBy(*keys).limit(n).withColumn("row", F.row_number().over(W.orderBy(*keys)) - 1)
    nodes = numbered(degrees, [F.desc("degree"), F.col("node_id")], top).select(*line(2, F.col("row"), F.format_string("  %s: %d connections", "node_id", "degree")))
    edges = numbered(details, [F.desc("weight"), F.col("src"), F.col("dst")], shown)
    edges = edges.select(*line(3, F.col("row"), F.format_string("%s <-> %s\n  Weight: %d\n  Shared: %s", "src", "dst", "weight", "shared")))
    more = details.agg((F.count("*") - shown).alias("n")).filter("n > 0").select(*line(4, F.lit(0), F.format_string("... and %d more connections", "n")))
    return stats.union(nodes).union(edges).union(more)


def report(sections: list[tuple[str, DataFrame]]) -> DataFrame:
    """(section_no, section, metric, value, count, pct) of several statistics, each (metric, value, count, pct)."""
    parts = [df.select(F.lit(i).alias("section_no"), F.lit(name).alias("section"), F.col("metric").cast("string"), F.col("value").cast("double"), F.coalesce(F.col("count").cast("long"), F.lit(0)).alias("count"), F.col("pct").cast("double")) for i, (name, df) in enumerate(sections)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def wide_report(report: DataFrame, path: str) -> None:
    """The report's rows in order of sections and rows, as one CSV and one TSV file; a report has a row a statistic, so it is small."""
    rows = report.orderBy("section_no", F.desc("count"), "metric").coalesce(1).select("section", "metric", "value", "count", F.round("pct", 1).alias("percentage"))
    export(rows, f"{path}/csv", "csv")
    export(rows, f"{path}/tsv", "tsv")


def text_report(report: DataFrame, title: str) -> DataFrame:
    """(section_no, row, value) lines: a banner, then each section's name and its statistics by count and name."""
    order = W.partitionBy("section_no").orderBy(F.desc("count"), "metric")
    figure = F.when(F.col("value").isNotNull(), F.format_string("  %s: %s", "metric", C.fixed(F.col("value"), 2))).when(F.col("pct").isNotNull(), F.format_string("  %s: %d (%s%%)", "metric", "count", C.fixed(F.col("pct"), 1))).otherwise(F.format_string("  %s: %d", "metric", "count"))
    lines = report.select("section_no", F.row_number().over(order).alias("row"), figure.alias("value"))
    heads = report.select("section_no", F.lit(0).alias("row"), F.concat(F.upper("section"), F.lit("\n" + "-" * 80)).alias("value")).distinct()
    top = report.sparkSession.createDataFrame([(-1, 0, banner(title))], "section_no int, row int, value string")
    return top.union(heads).union(lines)


#: How a statistic is written in the catalog's text report, by style.
_STYLES = {
    "count": lambda: F.format_string("  %s: %d", "metric", "count"),
    "share": lambda: F.format_string("  %s: %d (%s%%)", "metric", "count", C.fixed(F.col("pct"), 1)),
    "pct": lambda: F.format_string("  %s: %s%%", "metric", C.fixed(F.col("pct"), 1)),
    "whole": lambda: F.format_string("  %s: %s", "metric", C.fixed(F.col("value"), 0)),
    "percent": lambda: F.format_string("  %s: %s%%", "metric", C.fixed(F.col("value"), 1)),
    "rated": lambda: F.format_string("  %s: %s/10 (n=%d repos)", "metric", C.fixed(F.col("value"), 2), "count"),
}


def catalog_text(groups: list[tuple[str, DataFrame, list[tuple[str, str, str, list[str] | None]]]], title: str) -> DataFrame:
    """(block, row, value): the lines of a text report; ``block`` and ``row`` give their order.

    A group is a heading, a report and its blocks: (section, title, style, names).
    The shares of ``of_records`` are of the report's section total, those of
    ``of_entries`` of the block's counts. A block's lines follow ``names``, else counts from the largest, then names, or
    for shares without a count the shares. Sections without rows leave their title.
    """
    lines = [(0, i, line) for i, line in enumerate(["=" * 80, title, "=" * 80, ""])]
    parts, at = [], 0
    for heading, rows, blocks in groups:
        at += 1
        lines += [(at, 0, heading), (at, 1, "-" * 80)]
        for section, name, style, names in blocks:
            at += 1
            lines.append((at, 0, f"{name}:"))
            given = [F.array_position(F.array(*map(F.lit, names)), F.col("metric"))] if names else []
            largest = F.desc("pct") if style == "pct" else F.desc("count")
            row = F.row_number().over(W.partitionBy("section_no").orderBy(*given, largest, "metric"))  # a section has few rows
            some = rows.filter(F.col("section") == section)
            if style == "of_entries":
                some = some.withColumn("pct", F.col("count") / F.sum("count").over(W.partitionBy("section_no")) * 100)
            elif style == "of_records":
                whole = rows.filter(F.col("section") == "total").agg(F.max("count").alias("whole"))
                some = some.crossJoin(F.broadcast(whole)).withColumn("pct", F.when(F.col("whole") > 0, F.col("count") / F.col("whole") * 100).otherwise(0.0))
            parts.append(some.select(F.lit(at).alias("block"), row.alias("row"), _STYLES[style if style in _STYLES else "share"]().alias("value")))
    out = parts[0].sparkSession.createDataFrame(lines, "block int, row int, value string")
    for part in parts:
        out = out.union(part)
    return out


def share_line(found: Column, total: Column, what: str) -> Column:
    """``Showing X of Y what (p%)``."""
    share = F.when(total > 0, found / total * 100).otherwise(0.0)
    return F.format_string(f"Showing %d of %d {what} (%s%%)", found, total, C.fixed(share, 1))


def envelope(df: DataFrame, order: str) -> DataFrame:
    """(row, value): under row -1 the profile as JSON, then one JSON text a record, under its value of order; every record is there."""
    meta = profile(df).agg(F.array_sort(F.collect_list(F.struct("column", "type", "nulls", "row_count"))).alias("metadata"))
    meta = meta.select(F.lit(-1).cast("long").alias("row"), F.to_json(F.struct("metadata")).alias("value"))
    return meta.union(df.select(F.col(order).cast("long"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def export_envelope(df: DataFrame, path: str, order: str) -> None:
    """One JSON document with ``metadata`` (total_records, columns, column_count, data_types, null_counts) and ``data``, the records by a unique order.

    It is written as text in parts, a line a record, by ranges of the order; the
    parts in the order of their names make up the document.
    """
    names = F.array(*map(F.lit, df.columns))
    counted = df.agg(F.count("*").alias("total_records"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n_{i}") for i, c in enumerate(df.columns)])
    types = F.create_map(*[x for c, t in df.dtypes for x in (F.lit(c), F.lit(t))])
    nulls = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.col(f"n_{i}"))])
    meta = F.struct("total_records", names.alias("columns"), F.lit(len(df.columns)).alias("column_count"), types.alias("data_types"), nulls.alias("null_counts"))
    head = counted.select(F.lit(0).alias("part"), F.lit(None).cast(df.schema[order].dataType).alias("at"), F.concat(F.lit('{"metadata":'), F.to_json(meta), F.lit(',"data":[')).alias("value"))
    last = df.agg(F.max(order).alias("last"))
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    rows = df.select(F.lit(1).alias("part"), F.col(order).alias("at"), record.alias("value")).crossJoin(F.broadcast(last)).select("part", "at", F.concat("value", F.when(F.col("at") == F.col("last"), "").otherwise(",")).alias("value"))
    tail = last.select(F.lit(2).alias("part"), F.lit(None).cast(df.schema[order].dataType).alias("at"), F.lit("]}").alias("value"))
    head.union(rows).union(tail).sort("part", "at").select("value").write.text(path)


def record_digest(fields: list[tuple[str, Column]]) -> Column:
    """Labelled lines of the filled fields."""
    return F.concat_ws("\n", *[F.when(C.filled(c), F.concat(F.lit(f"{label}: "), c)) for label, c in fields])


def short_list(items: Column, most: int = 3) -> Column:
    """The first items, and ``et al.`` if there are more."""
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(F.size(items) > most, " et al.").otherwise(""))


def digest_head(df: DataFrame, digest: Column, order: str, most: int) -> DataFrame:
    """(row, value): the first ``most`` digests, and under row -1 a line that says how many more there are."""
    head = df.orderBy(order).limit(most).select(F.col(order).cast("long").alias("row"), digest.alias("value"))
    more = df.agg((F.count("*") - most).alias("n")).filter("n > 0").select(F.lit(-1).cast("long").alias("row"), F.format_string("... and %d more", "n").alias("value"))
    return head.union(more)


def _line(label: str, c: Column) -> Column:
    """An indented line for a field that is not empty, else nothing."""
    return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"\n  {label}: "), c)).otherwise("")


def _short(c: Column, most: int = 200) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(F.coalesce(c, F.lit("")))


def resource_digest(name: Column, abbreviation: Column, diseases: Column, modalities: Column, size: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit(""))
    short = F.when(blank(abbreviation) != "", F.concat(F.lit(" ("), abbreviation, F.lit(")"))).otherwise("")
    return F.concat(blank(name), short, F.lit("\n  Diseases: "), blank(diseases), F.lit("\n  Modalities: "), blank(modalities), _line("Sample Size", size))


def publication_digest(title: Column, authors: Column, keywords: Column, abstract: Column) -> Column:
    names = F.split(authors, ";")
    first = F.concat(F.array_join(F.slice(names, 1, 3), "; "), F.when(F.size(names) > 3, " et al.").otherwise(""))
    return F.concat(F.lit("Title: "), F.coalesce(title, F.lit("")), F.when(F.coalesce(authors, F.lit("")) != "", F.concat(F.lit("\n  Authors: "), first)).otherwise(""), _line("Keywords", keywords), _line("Abstract", _short(abstract)))


def repository_digest(link: Column, study: Column, languages: Column, data_types: Column, tooling: Column, relevance: Column, score: Column) -> Column:
    rated = F.when(score.isNotNull(), F.concat(F.lit("\n  FAIR Score: "), score.cast("string"), F.lit("/10"))).otherwise("")
    return F.concat(C.last_segment(link), F.lit(" ("), study, F.lit(")"), _line("Languages", languages), _line("Data Types", data_types), _line("Tooling", tooling), _line("Biomedical Relevance", relevance), rated)


def cell_line_digest(code: Column, gene: Column, variant: Column, condition: Column, about_gene: Column, about_variant: Column) -> Column:
    about = lambda label, c: F.when(C.filled(c), _line(label, _short(c))).otherwise("")
    return F.concat(code, F.lit(" - "), gene, F.lit(" "), variant, F.lit("\n  Condition: "), C.condition(condition), about("About gene", about_gene), about("About variant", about_variant))
