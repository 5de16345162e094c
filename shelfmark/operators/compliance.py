"""Compliance of repositories: flags from file trees, the issue log, scores and dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import values


def tree_flags(files: DataFrame, repo: str, path: str) -> DataFrame:
    """Per repository and component, whether a root-level file shows it."""
    return files.groupBy(repo).agg(*[F.bool_or(F.lower(path).isin(*names)).alias(flag) for flag, (names, _, _) in values.COMPLIANCE_FILES.items()])


def issues_from_flags(flags: DataFrame, repo: str, at: Column | None = None) -> DataFrame:
    """An issue row for every flag that is not set, with the time of the check as ISO text if it is given."""
    rows = F.array(*[F.struct(F.col(flag).alias("ok"), F.lit(issue).alias("issue_type"), F.lit(text).alias("details")) for flag, (_, issue, text) in values.COMPLIANCE_FILES.items()])
    found = flags.select(repo, F.inline(rows)).filter("not ok").drop("ok")
    return found if at is None else found.withColumn("timestamp", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))


def score_app(log: DataFrame, repo: str, issue: str, details: str, order: str) -> DataFrame:
    """Issues in the order of their first row; 10 less one for each log row with details, 0 at least."""
    first = log.groupBy(repo, issue).agg(F.min(order).alias("_first"), F.count(details).alias("_n"))
    kinds = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_first", issue))), lambda x: x[issue]), "; ")
    return first.groupBy(repo).agg(kinds.alias("issues"), F.sum("_n").alias("n_issues")).withColumn("score", F.greatest(F.lit(0), 10 - F.col("n_issues")))


def score_report(log: DataFrame, repo: str, issue: str) -> DataFrame:
    """10 less one for each distinct issue type."""
    return log.select(repo, issue).distinct().groupBy(repo).agg(F.count("*").alias("n_types")).withColumn("score", F.greatest(F.lit(0), 10 - F.col("n_types")))


def with_compliance(repos: DataFrame, summary: DataFrame, key: str, log_is_empty: bool | None = None) -> DataFrame:
    """Repositories with their issues and score; one that no log row names has none and 10, or 0 if the log is empty.

    Whether it is empty is looked up (one row, broadcast) unless the caller says.
    """
    joined = repos.join(summary, key, "left")
    if log_is_empty is None:
        joined = joined.crossJoin(F.broadcast(summary.limit(1).agg((F.count("*") == 0).alias("_empty"))))
    else:
        joined = joined.withColumn("_empty", F.lit(log_is_empty))
    score = F.coalesce(F.col("score"), F.when(F.col("_empty"), 0).otherwise(10)).cast("double")
    return joined.withColumn("issues", F.coalesce("issues", F.lit(""))).withColumn("score", score).drop("_empty")


def component_completeness(repos: DataFrame, issues: str, kinds: list[str]) -> DataFrame:
    """(component, pct): share of repositories whose issues do not name it. Repositories without issues have everything."""
    text = F.coalesce(F.col(issues), F.lit(""))
    shares = repos.agg(*[(F.avg(F.when(~text.contains(k), 1.0).otherwise(0.0)) * 100).alias(k) for k in kinds])
    return shares.select(F.inline(F.array(*[F.struct(F.lit(k).alias("component"), F.col(k).alias("pct")) for k in kinds])))


def issue_matrix(members: DataFrame, log: DataFrame, repo: str, group: str, issue: str, kinds: list[str], top: int = 8) -> DataFrame:
    """Per group, of its assessed repositories the share with each issue; the ``top`` groups by all their repositories."""
    best = members.groupBy(group).agg(F.count("*").alias("n_all")).orderBy(F.desc("n_all"), group).limit(top)
    flags = log.groupBy(repo).agg(*[F.max(F.when(F.col(issue) == k, 1.0).otherwise(0.0)).alias(k) for k in kinds])
    seen = members.join(F.broadcast(best), group).join(flags, repo)
    return seen.groupBy(group).agg(F.count("*").alias("n"), *[(F.avg(k) * 100).alias(k) for k in kinds])


def run_stats(flags: DataFrame) -> DataFrame:
    """(flag, n, pct) of the repositories with each component; percentages of at least one repository."""
    kinds = list(values.COMPLIANCE_FILES)
    counts = flags.agg(F.count("*").alias("total"), *[F.count_if(k).alias(k) for k in kinds])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("flag"), F.col(k).alias("n"), (F.col(k) / F.greatest("total", F.lit(1)) * 100).alias("pct")) for k in kinds])))
