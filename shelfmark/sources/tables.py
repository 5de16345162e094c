"""Readers of delimited, XML, JSON-lines and log text, and the loaders of the catalog's tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.functions import columns as C
from shelfmark.functions import values
from shelfmark.operators import dedup

ARTICLE = "PMID string, MedlineCitation struct<PMID:string, Article:struct<ArticleTitle:string, Abstract:struct<AbstractText:array<struct<_Label:string, _VALUE:string>>>, AuthorList:struct<Author:array<struct<LastName:string, ForeName:string, AffiliationInfo:array<struct<Affiliation:string>>>>>>, KeywordList:struct<Keyword:array<string>>>, PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_IdType:string, _VALUE:string>>>>"
RESULT = "custom_id string, result struct<type:string, message:struct<content:array<struct<text:string>>>, error:struct<type:string, message:string>>"


def newest(spark: SparkSession, folder: str, pattern: str, deep: bool = False) -> str:
    """The newest file that matches, by time and then path; with deep in folders below, too."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", deep).load(folder)
    path = files.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]
    if path is None:
        raise FileNotFoundError(f"no file {pattern} in {folder}")
    return path


def latest_write(spark: SparkSession, folder: str, pattern: str = "*.csv") -> str:
    """The folder below that was written last, for tables that Spark wrote as folders of files."""
    return newest(spark, folder, pattern, deep=True).rpartition("/")[0]


def latest_file(spark: SparkSession, folder: str, pattern: str) -> str:
    """The newest file that matches; it must be tab-separated by name."""
    path = newest(spark, folder, pattern)
    if not path.endswith((".tsv", ".tab")):
        raise ValueError(f"not a tab-separated file: {path}")
    return path


def read_table(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, sep: str = "\t", blank: bool = True, multi_line: bool = True) -> DataFrame:
    """A delimited table of strings: header trimmed, missing-value markers missing, and missing values blank unless asked otherwise.

    Each path is read by its own header, so files whose columns differ or stand
    in another order are put together by name; ``columns`` are then chosen by
    name, absent ones missing. With ``multi_line`` a quoted value may hold line
    breaks, and a file is one task; without it large files are split.
    """
    reader = spark.read.option("sep", sep).option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"').option("ignoreCorruptFiles", True)
    tables = [reader.csv(p) for p in ([path] if isinstance(path, str) else path)]
    df = union_all([t.toDF(*[c.strip() for c in t.columns]) for t in tables])
    if columns:
        df = df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
    df = df.select(*[F.when(~F.col(f"`{c}`").isin(*values.NA_TOKENS), F.col(f"`{c}`")).alias(c) for c in df.columns])
    return df.na.fill("") if blank else df


def conform(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns in this order; absent ones are blank."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit("").alias(c) for c in columns])


def with_normalized(df: DataFrame, columns: list[str], delimiter: str = ";", split_on: str | None = None) -> DataFrame:
    return df.withColumns({c: C.normalize_list(F.col(f"`{c}`"), delimiter, split_on) for c in columns if c in df.columns})


def load_resources(df: DataFrame) -> DataFrame:
    return with_normalized(df, ["Diseases Included"], ";", ";,").drop("Notes", "Remove")


def load_code_repos(df: DataFrame) -> DataFrame:
    return with_normalized(df, ["Languages", "Data Types", "Tooling", "Diseases Included"]).drop("Content_For_Analysis")


def load_publications(df: DataFrame) -> DataFrame:
    if "PubMed Central Link" in df.columns:
        df = df.withColumn("PubMed Central Link", C.fix_pmc_link(F.col("`PubMed Central Link`")))
    if "Authors" in df.columns:
        df = df.withColumn("Authors", C.rotate_names(F.col("Authors")))
    df = with_normalized(with_normalized(df, ["Keywords"]), ["Diseases Included"], ";", ";,")
    five = ("PubMed Central Link", "Authors", "Affiliations", "Abstract", "Keywords")
    return df.withColumn("Data Completeness", C.completeness(*[F.col(f"`{c}`") if c in df.columns else F.lit("") for c in five]))


def load_compliance_log(df: DataFrame) -> DataFrame:
    """The latest row of each repository, study and issue type."""
    keys = [c for c in ("Repository", "Study", "Issue Type") if c in df.columns]
    return dedup.keep_latest(df, keys, "Timestamp", [F.col("Details")])


def read_present(spark: SparkSession, paths: list[str], **options) -> dict[int, DataFrame]:
    """The tables at those paths that exist, by their place in the list; a path that does not is passed over, but one must."""
    found = {}
    for i, path in enumerate(paths):
        try:
            found[i] = read_table(spark, path, **options)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    if not found:
        raise FileNotFoundError(f"none of {paths}")
    return found


def load_repo_batches(spark: SparkSession, paths: list[str], **options) -> tuple[DataFrame, DataFrame]:
    """The repositories of several batches, the first batch's row of each link, and a row with the counts before and after; absent batches are passed over."""
    return merge_batches(union_all([t.withColumn("batch", F.lit(i)) for i, t in read_present(spark, paths, **options).items()]))


def merge_batches(rows: DataFrame, link: str = "Repository Link", batch: str = "batch") -> tuple[DataFrame, DataFrame]:
    """The first batch's row of each link, without the column batch, and (before, after, removed)."""
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in (link, batch)]
    kept = dedup.keep_first(rows, [link], [F.col(batch), *rest])
    # one aggregate by link gives both counts
    counts = rows.groupBy(F.col(f"`{link}`")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("before"), F.count("*").alias("after"))
    return kept.drop(batch), counts.withColumn("removed", F.col("before") - F.col("after"))


def union_compliance_logs(logs: DataFrame, order: list[str]) -> DataFrame:
    """All logs' rows, the first of each repository and issue type; order (file, place in it, ...) says which is first."""
    return dedup.keep_first(logs, ["Repository", "Issue Type"], [F.col(f"`{c}`") for c in order])


def union_all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line) of text files; n orders a file's lines. Large files are split, so no file is one row or one task."""
    order = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), order.alias("n"), F.col("value").alias("line"))


def mine_logs(spark: SparkSession, path: str) -> DataFrame:
    """(url, study, abbreviation) of every skipped repository in all logs; its last mention counts, and a study holds on into the next file."""
    return skipped_urls(log_lines(spark, path), across=True)


def skipped_urls(lines: DataFrame, across: bool = False) -> DataFrame:
    """The same from (file, n, line): the study named last above a ``Skipping`` line, within its file or, with ``across``, in any file before it, too.

    Only repositories on github.com skipped for insufficient content count.
    """
    head = r"Searching GitHub for repositories related to (.+?) \((.+?)\)\.\.\."
    study = F.when(F.col("line").rlike(head), F.struct(F.regexp_extract("line", head, 1).alias("study"), F.regexp_extract("line", head, 2).alias("abbreviation")))
    marked = lines.select("file", "n", study.alias("named"), F.regexp_extract("line", r"Skipping (https://github\.com/[^\s]+) - insufficient content", 1).alias("url"))
    kept = marked.filter("url <> '' or named is not null")  # other lines name nothing and ask for nothing
    known = dedup.carried(kept, "named", ["file", "n"] if across else ["n"], [] if across else ["file"], "study")
    skips = known.filter("url <> '' and named is null and study is not null")
    last = skips.groupBy("url").agg(F.max_by("study", F.struct("file", "n")).alias("study"))
    return last.select("url", "study.study", "study.abbreviation")


def articles(spark: SparkSession, path: str) -> DataFrame:
    """A row an article of a PubMed XML file."""
    return article_rows(spark.read.format("xml").option("rowTag", "PubmedArticle").schema(ARTICLE).load(path))


def article_texts(df: DataFrame, xml: str) -> DataFrame:
    """The same from a column that holds an article's XML."""
    return article_rows(df.select(F.from_xml(xml, ARTICLE).alias("article")).select("article.*"))


def article_rows(df: DataFrame) -> DataFrame:
    """PMID, link, authors, affiliations, title, abstract, keywords; articles without a title go."""
    a = "MedlineCitation.Article."
    label = lambda x: F.when(C.filled(x["_Label"]), F.concat(x["_Label"], F.lit(": "), x["_VALUE"])).otherwise(x["_VALUE"])
    abstract = F.array_join(F.filter(F.transform(a + "Abstract.AbstractText", label), lambda x: x.isNotNull()), " ")
    name = lambda x: F.when(C.filled(x["LastName"]), F.when(C.filled(x["ForeName"]), F.concat_ws(" ", x["LastName"], x["ForeName"])).otherwise(x["LastName"]))
    authors = F.array_join(F.filter(F.transform(a + "AuthorList.Author", name), lambda x: x.isNotNull()), "; ")
    first = F.transform(a + "AuthorList.Author", lambda x: C.clean_text(F.get(x["AffiliationInfo"], 0)["Affiliation"]))
    places = F.array_join(F.array_distinct(F.filter(first, lambda x: x.isNotNull() & (x != ""))), "; ")
    ids = F.filter("PubmedData.ArticleIdList.ArticleId", lambda x: x["_IdType"] == "pmc")
    pmc = F.get(ids, 0)["_VALUE"]
    title = C.clean_text(F.regexp_extract(F.coalesce(F.col(a + "ArticleTitle"), F.lit("")), "^[^<]*", 0))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return df.select(
        F.coalesce("MedlineCitation.PMID", "PMID").alias("PMID"),
        F.when(pmc.isNotNull(), C.fix_pmc_link(F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/PMC"), F.regexp_replace(pmc, "^PMC", "")))).otherwise("").alias("PubMed Central Link"),
        blank(authors).alias("Authors"), blank(places).alias("Affiliations"), title.alias("Title"), blank(C.clean_text(abstract)).alias("Abstract"),
        blank(F.array_join("MedlineCitation.KeywordList.Keyword", "; ")).alias("Keywords"),
    ).filter("Title <> ''")


def batch_results(spark: SparkSession, path: str) -> DataFrame:
    return result_texts(spark.read.schema(RESULT).json(path))


def result_texts(df: DataFrame) -> DataFrame:
    """(custom_id, response): the answer, or ERROR with its type and message."""
    message = F.col("result.error.message")
    error = F.concat(F.lit("ERROR - "), F.col("result.type"), F.when(C.filled(message), F.concat(F.lit(": "), message)).otherwise(""))
    return df.select("custom_id", F.when(F.col("result.type") == "succeeded", F.get("result.message.content", 0)["text"]).otherwise(error).alias("response"))
