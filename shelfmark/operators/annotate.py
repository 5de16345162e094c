"""Batch annotation: request rows, parsed responses, and their merge back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.functions import columns as C
from shelfmark.functions import values


def requests(df: DataFrame, index: str, name: Column, content: str, template: str, model: str, max_tokens: int = 1000, temperature: float = 0.1) -> DataFrame:
    """custom_id and params for every row with at least 50 characters of content."""
    kept = df.filter(F.length(C.strip(F.coalesce(F.col(content), F.lit("")))) >= 50)
    ident = C.safe_id(F.concat(F.lit("repo_"), F.col(index).cast("string"), F.lit("_"), name))
    message = F.array(F.struct(F.lit("user").alias("role"), C.prompt(template, name, F.col(content)).alias("content")))
    return kept.select(ident.alias("custom_id"), F.struct(F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens"), F.lit(temperature).alias("temperature"), message.alias("messages")).alias("params"))


def parse_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """The four sections of each response: what follows a header's first colon and the lines below it; a later repeat replaces an earlier one."""
    lines = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("n", "line"))
    run = W.partitionBy(key).orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    header = C.section_header(F.col("line"))
    after = C.strip(F.regexp_extract("line", "(?s)^[^:]*:(.*)$", 1))
    marked = (
        lines.withColumn("header", header)
        .withColumn("section", F.last("header", ignorenulls=True).over(run))
        .withColumn("turn", F.count("header").over(run))
        .withColumn("part", F.when(F.col("header").isNotNull(), after).otherwise(C.strip(F.col("line"))))
        .filter("section is not null and (header is not null or part <> '')")
    )
    texts = marked.groupBy(key, "section", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), " ").alias("text"))
    last = texts.groupBy(key).pivot("section", list(values.SECTIONS)).agg(F.max_by("text", "turn"))
    return df.select(key).distinct().join(last, key, "left").select(key, *[C.clean_text(F.coalesce(c, F.lit(""))).alias(c) for c in values.SECTIONS])


def write_requests(asked: DataFrame, path: str) -> None:
    """The requests as JSON lines, one a row."""
    asked.select("custom_id", "params").write.json(path)


def parse_results(results: DataFrame, key: str = "custom_id", text: str = "response") -> DataFrame:
    """The four sections of each result of a read results file; a failed one has its error as the first section and no others."""
    failed = F.col(text).startswith("ERROR - ")
    errors = results.filter(failed).select(key, *[(F.col(text) if c == next(iter(values.SECTIONS)) else F.lit("")).alias(c) for c in values.SECTIONS])
    return parse_sections(results.filter(~failed), key, text).union(errors)


def merge_results(df: DataFrame, results: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with the columns replaced in the rows that have a result."""
    new = results.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    merged = df.join(new, key, "left")
    return merged.withColumns({c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}).select(*df.columns)
