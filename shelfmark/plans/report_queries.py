"""The reports, the dashboard and the digests, with all their blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import columns as C
from shelfmark.functions import values
from shelfmark.operators import compliance, dedup, graph, stats
from shelfmark.plans import sinks
from shelfmark.plans.book import Book, scratch, table
from shelfmark.plans.flow_queries import _code, _CODE, _papers, _PAPERS, _resources, _RESOURCES
from shelfmark.plans.stat_queries import sql_list
from shelfmark.plans.text_queries import _LEVEL, _NOTE
from shelfmark.sources import tables as S

HERE = Book()


def _counted(df, name="value", count="n", pct=None):
    share = F.lit(None).cast("double") if pct is None else F.round(pct, 6)
    return df.select(F.col(name).cast("string").alias("metric"), F.lit(None).cast("double").alias("value"), F.col(count).cast("long").alias("count"), share.alias("pct"))


def _figures(df, names):
    """The columns of a one-row table as metrics."""
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.round(F.col(n).cast("double"), 6).alias("value")) for n in names])
    return df.select(F.inline(rows)).select("metric", "value", F.lit(None).cast("long").alias("count"), F.lit(None).cast("double").alias("pct"))


def _top(df, column, k, delimiters=";"):
    return _counted(stats.top_k(stats.exploded(df, column, delimiters), F.col("value"), k))


def _words(df, doc, text, stopwords, least=3):
    return _counted(stats.word_frequencies(df, doc, text, stopwords, least=least, by_document=True), "word", "count", F.col("pct"))


_COLUMNS = "metric, value, count, pct"


def _top_sql(rows, column, k, delimiters=";"):
    return f"(SELECT trim(v) AS metric, NULL::DOUBLE AS value, count(*) AS count, NULL::DOUBLE AS pct FROM (SELECT unnest(string_split_regex({column}, '[{delimiters}]')) AS v FROM ({rows})) WHERE trim(v) <> '' GROUP BY trim(v) ORDER BY count(*) DESC, trim(v) LIMIT {k})"


def _figures_sql(rows, number, names=("n", "mean", "median", "min", "max", "std")):
    sql = {"n": "count(x)", "mean": "avg(x)", "median": "median(x)", "min": "min(x)", "max": "max(x)", "std": "stddev_pop(x)"}
    return f"(SELECT unnest([{', '.join(repr(n) for n in names)}]) AS metric, unnest([{', '.join(f'round({sql[n]}::DOUBLE, 6)' for n in names)}]) AS value, NULL::BIGINT AS count, NULL::DOUBLE AS pct FROM (SELECT ({number})::DOUBLE AS x FROM ({rows})))"


def _words_sql(rows, doc, text, stopwords, least=3):
    kept = f"SELECT doc, word FROM (SELECT {doc} AS doc, unnest(string_split_regex(lower({text}), '[;,\\s\\-_/()]+')) AS word FROM ({rows})) WHERE length(word) >= {least} AND regexp_full_match(word, '\\p{{L}}+') AND word NOT IN ({sql_list(stopwords)})"
    return f"(SELECT word AS metric, NULL::DOUBLE AS value, count(DISTINCT doc) AS count, round(count(DISTINCT doc) * 100.0::DOUBLE / (SELECT count({text}) FROM ({rows})), 6) AS pct FROM ({kept}) GROUP BY word ORDER BY count(*) DESC, word LIMIT 10)"


def _sections_sql(sections):
    return " UNION ALL ".join(f"SELECT {i} AS section_no, '{name}' AS section, metric, value::DOUBLE AS value, coalesce(count, 0)::BIGINT AS count, pct::DOUBLE AS pct FROM ({sql})" for i, (name, sql) in enumerate(sections))


_RESOURCE_BLOCKS = [
    ("total", f"SELECT 'datasets' AS metric, NULL AS value, count(*) AS count, NULL AS pct FROM ({_RESOURCES})"),
    ("types", f"SELECT lower(kind) AS metric, NULL AS value, count(*) AS count, NULL AS pct FROM ({_RESOURCES}) GROUP BY 1"),
    ("coarse", _top_sql(_RESOURCES, "coarse", 1000, ",")),
    ("granular", _top_sql(_RESOURCES, "granular", 1000)),
    ("sizes", _figures_sql("SELECT p_size FROM part WHERE p_size % 9 <> 0", "p_size * 1000")),
]


def _resource_report(spark, sf_dir):
    rows = _resources(spark, sf_dir)
    total = rows.agg(F.count("*").alias("n")).withColumn("value", F.lit("datasets"))
    kinds = stats.exploded(rows, "kind", ",").groupBy(F.lower("value").alias("value")).agg(F.count("*").alias("n"))
    text = F.expr("CASE WHEN p_size % 9 = 0 THEN 'unknown' ELSE format_number(p_size * 1000, 0) || '+ people' END")
    sizes = stats.numeric_summary(table(spark, sf_dir, "part"), C.first_number(text))
    return sinks.report([("total", _counted(total)), ("types", _counted(kinds)), ("coarse", _top(rows, "coarse", 1000, ",")), ("granular", _top(rows, "granular", 1000)), ("sizes", _figures(sizes, ["n", "mean", "median", "min", "max", "std"]))])


@HERE.add(_sections_sql(_RESOURCE_BLOCKS))
def report_resources_full(spark, sf_dir):
    return _resource_report(spark, sf_dir)


_SCORED_PAPERS = f"SELECT *, (1 + (keywords <> '')::INT + 2 + 1) / 5.0::DOUBLE * 100 AS done FROM ({_PAPERS})"


_PAPER_BLOCKS = [
    ("total", "SELECT 'publications' AS metric, NULL AS value, count(*) AS count, NULL AS pct FROM documents"),
    ("studies", _top_sql(_PAPERS, "study", 5)),
    ("authors", _top_sql("SELECT source || ' A; ' || lang || ' B' AS authors FROM documents", "authors", 5)),
    ("affiliations", "(SELECT a AS metric, NULL AS value, count(*) AS count, NULL AS pct FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'Mayo Clinic, Rochester, Minnesota' ELSE 'Inst ' || source END AS a FROM documents) GROUP BY a ORDER BY count(*) DESC, a LIMIT 5)"),
    ("keywords", _words_sql("SELECT doc_id, lang || 'words; ' || source AS k FROM documents", "doc_id", "k", values.STOPWORDS)),
    ("completeness", _figures_sql(_SCORED_PAPERS, "done", ("mean", "median", "std"))),
    ("distribution", f"SELECT bin::VARCHAR AS metric, NULL AS value, (SELECT count(*) FROM ({_SCORED_PAPERS}) WHERE least(floor(done / 25), 3) = bin) AS count, NULL AS pct FROM (SELECT unnest(range(4)) AS bin)"),
]


@HERE.add(_sections_sql(_PAPER_BLOCKS))
def report_publications_full(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = _papers(spark, sf_dir)
    names = docs.select(F.concat("source", F.lit(" A; "), "lang", F.lit(" B")).alias("authors"))
    places = docs.select(C.normalize_affiliation(F.when(F.col("doc_id") % 2 == 0, F.lit("Mayo Clinic, Rochester, MN")).otherwise(F.concat(F.lit("Inst "), F.col("source")))).alias("value"))
    keywords = docs.select("doc_id", F.concat("lang", F.lit("words; "), "source").alias("k"))
    done = rows.select(C.completeness(F.col("study"), F.col("keywords"), F.col("diseases"), F.col("coarse"), F.col("granular")).alias("done"))
    figures = stats.numeric_summary(done, F.col("done"))
    total = docs.agg(F.count("*").alias("n")).withColumn("value", F.lit("publications"))
    return sinks.report([
        ("total", _counted(total)), ("studies", _top(rows, "study", 5)), ("authors", _top(names, "authors", 5)), ("affiliations", _counted(stats.top_k(places, F.col("value"), 5))),
        ("keywords", _words(keywords, "doc_id", "k", values.STOPWORDS)), ("completeness", _figures(figures, ["mean", "median", "std"])),
        ("distribution", _counted(stats.histogram(done, F.col("done"), [0.0, 25.0, 50.0, 75.0, 100.0]), "bin")),
    ])


_EVENTS = "SELECT user_id, string_agg(DISTINCT event_type, '; ') AS issues, greatest(0, 10 - count(DISTINCT event_type)) AS score FROM events GROUP BY user_id"
_REPOS = f"SELECT c_custkey, languages, tools || ' pipeline for ' || lower(diseases) || ' analysis' AS tooling, data_types || ' imaging; ' || study AS types, 'Implements ' || lower(diseases) || ' models using ' || lower(c_name) AS summary, coalesce(e.issues, '') AS found, coalesce(e.score, 10) AS rated FROM ({_CODE}) c LEFT JOIN ({_EVENTS}) e ON e.user_id = c.c_custkey"
_PARTS = ("click", "error", "purchase", "signup", "view")


_REPO_BLOCKS = [
    ("total", f"SELECT 'repositories' AS metric, NULL AS value, count(*) AS count, NULL AS pct FROM ({_REPOS})"),
    ("languages", _top_sql(_REPOS, "languages", 10, ";,")),
    ("tooling", _words_sql(_REPOS, "c_custkey", "tooling", values.CODE_STOPWORDS)),
    ("data types", _words_sql(_REPOS, "c_custkey", "types", values.CODE_STOPWORDS)),
    ("summaries", _words_sql(_REPOS, "c_custkey", "summary", values.CODE_STOPWORDS, 4)),
    ("components", f"SELECT kind AS metric, NULL AS value, 0 AS count, round(avg(CASE WHEN contains(found, kind) THEN 0.0 ELSE 1.0 END) * 100, 6) AS pct FROM ({_REPOS}), (SELECT unnest({list(_PARTS)}) AS kind) GROUP BY kind"),
    ("scores by language", f"SELECT languages AS metric, round(avg(rated), 6) AS value, count(*) AS count, NULL AS pct FROM ({_REPOS}) WHERE languages IN ('L0', 'L1', 'L2') GROUP BY languages"),
]


@HERE.add(_sections_sql(_REPO_BLOCKS))
def report_code_full(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), "event_type")
    # one row a repository and issue first, so the list and the score come from one small aggregate
    found = log.distinct().groupBy("c_custkey").agg(F.array_join(F.array_sort(F.collect_set("event_type")), "; ").alias("found"), F.greatest(F.lit(0), 10 - F.count("*")).alias("rated"))
    text = ["c_custkey", "languages", "tools || ' pipeline for ' || lower(diseases) || ' analysis' AS tooling", "data_types || ' imaging; ' || study AS types", "'Implements ' || lower(diseases) || ' models using ' || lower(c_name) AS summary"]
    rows = _code(spark, sf_dir).selectExpr(*text).join(found, "c_custkey", "left").withColumns({"found": F.coalesce("found", F.lit("")), "rated": F.coalesce("rated", F.lit(10))})
    total = rows.agg(F.count("*").alias("n")).withColumn("value", F.lit("repositories"))
    parts = compliance.component_completeness(rows, "found", list(_PARTS)).withColumn("count", F.lit(0))
    by_language = rows.filter(F.col("languages").isin("L0", "L1", "L2")).groupBy("languages").agg(F.round(F.avg("rated"), 6).alias("value"), F.count("*").alias("count"))
    return sinks.report([
        ("total", _counted(total)), ("languages", _top(rows, "languages", 10, ";,")), ("tooling", _words(rows, "c_custkey", "tooling", values.CODE_STOPWORDS)), ("data types", _words(rows, "c_custkey", "types", values.CODE_STOPWORDS)),
        ("summaries", _words(rows, "c_custkey", "summary", values.CODE_STOPWORDS, 4)), ("components", _counted(parts, "component", "count", F.col("pct"))),
        ("scores by language", by_language.select(F.col("languages").alias("metric"), "value", "count", F.lit(None).cast("double").alias("pct"))),
    ])


_LINES = "SELECT c_custkey, c_nationkey::VARCHAR AS condition, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment || '; G1' ELSE c_mktsegment END AS gene, 'Encodes a ' || lower(c_mktsegment) || ' kinase protein' AS about_gene, 'Known ' || lower(c_mktsegment) || ' missense change' AS about_variant FROM customer"


_LINE_BLOCKS = [
    ("total", f"SELECT 'cell lines' AS metric, NULL AS value, count(*) AS count, NULL AS pct FROM ({_LINES})"),
    ("conditions", f"(SELECT condition AS metric, NULL AS value, count(*) AS count, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM customer), 6) AS pct FROM ({_LINES}) WHERE condition <> '0' GROUP BY condition ORDER BY count(*) DESC, condition LIMIT 10)"),
    ("genes", _top_sql(_LINES, "gene", 10)),
    ("gene themes", _words_sql(_LINES, "c_custkey", "about_gene", values.CELL_STOPWORDS, 4)),
    ("variant themes", _words_sql(_LINES, "c_custkey", "about_variant", values.CELL_STOPWORDS, 4)),
]


@HERE.add(_sections_sql(_LINE_BLOCKS))
def report_cell_lines_full(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "string(c_nationkey) AS condition", "CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment || '; G1' ELSE c_mktsegment END AS gene", "'Encodes a ' || lower(c_mktsegment) || ' kinase protein' AS about_gene", "'Known ' || lower(c_mktsegment) || ' missense change' AS about_variant")
    total = rows.agg(F.count("*").alias("n"))
    best = stats.top_k(rows.filter("condition <> '0'"), F.col("condition"), 10).crossJoin(F.broadcast(total.withColumnRenamed("n", "total")))
    return sinks.report([
        ("total", _counted(total.withColumn("value", F.lit("cell lines")))), ("conditions", _counted(best, "value", "n", F.col("n") / F.col("total") * 100)), ("genes", _top(rows, "gene", 10)),
        ("gene themes", _words(rows, "c_custkey", "about_gene", values.CELL_STOPWORDS, 4)), ("variant themes", _words(rows, "c_custkey", "about_variant", values.CELL_STOPWORDS, 4)),
    ])


@HERE.add(f"SELECT section, metric, value, count, round(pct, 1) AS percentage FROM ({_sections_sql(_RESOURCE_BLOCKS)})")
def report_wide(spark, sf_dir):
    path = scratch(spark)
    sinks.wide_report(_resource_report(spark, sf_dir), path)
    schema = "section string, metric string, value double, count long, percentage double"
    both = [spark.read.option("header", True).option("sep", sep).schema(schema).csv(f"{path}/{kind}") for kind, sep in (("csv", ","), ("tsv", "\t"))]
    return both[0].intersectAll(both[1])


_TEXT = f"SELECT section_no, row_number() OVER (PARTITION BY section_no ORDER BY count DESC, metric) AS \"row\", '  ' || metric || ': ' || CASE WHEN value IS NOT NULL THEN format('{{:.2f}}', value) ELSE count::VARCHAR END AS value FROM ({_sections_sql(_RESOURCE_BLOCKS)}) UNION ALL SELECT DISTINCT section_no, 0, upper(section) || E'\\n' || repeat('-', 80) FROM ({_sections_sql(_RESOURCE_BLOCKS)}) UNION ALL SELECT -1, 0, repeat('=', 80) || E'\\n' || repeat(' ', 35) || 'Statistics' || repeat(' ', 35) || E'\\n' || repeat('=', 80) || E'\\n'"


@HERE.add(_TEXT)
def report_text(spark, sf_dir):
    return sinks.text_report(_resource_report(spark, sf_dir), "Statistics")


_ISSUES = f"SELECT c_custkey, issues, score FROM ({_CODE})"


@HERE.add(_sections_sql([
    ("scores", _figures_sql(_ISSUES, "score", ("mean", "median", "min", "max"))),
    ("kinds", f"SELECT unnest(['perfect', 'with issues']) AS metric, NULL AS value, unnest([count(*) FILTER (score = 10), count(*) FILTER (score < 10)]) AS count, NULL AS pct FROM ({_ISSUES})"),
    ("histogram", f"SELECT score::INT::VARCHAR AS metric, NULL AS value, count(*) AS count, NULL AS pct FROM ({_ISSUES}) GROUP BY 1"),
    ("issues", _top_sql(_ISSUES, "issues", 10)),
    ("best", f"(SELECT c_custkey::VARCHAR AS metric, score AS value, NULL AS count, NULL AS pct FROM ({_ISSUES}) ORDER BY score DESC, c_custkey LIMIT 5)"),
]))
def dashboard_full(spark, sf_dir):
    rows = _code(spark, sf_dir).select("c_custkey", "issues", F.col("score").cast("double").alias("score"))
    figures = stats.numeric_summary(rows, F.col("score"))
    kinds = rows.groupBy(F.when(F.col("score") == 10, "perfect").otherwise("with issues").alias("value")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.createDataFrame([("perfect",), ("with issues",)], "value string").join(kinds, "value", "left").na.fill(0)
    bars = rows.groupBy(F.col("score").cast("int").alias("value")).agg(F.count("*").alias("n"))
    best = dedup.largest(rows, "score", 5, "c_custkey").select(F.col("c_custkey").cast("string").alias("metric"), F.col("score").alias("value"), F.lit(None).cast("long").alias("count"), F.lit(None).cast("double").alias("pct"))
    return sinks.report([("scores", _figures(figures, ["mean", "median", "min", "max"])), ("kinds", _counted(every)), ("histogram", _counted(bars)), ("issues", _top(rows, "issues", 10)), ("best", best)])


_METHOD = "SELECT o_orderstatus AS method, o_custkey::VARCHAR AS study, o_orderpriority || '; C' || o_orderkey % 7 AS authors FROM orders"


@HERE.add(f"SELECT method, kind, place, value, n FROM (SELECT method, kind, value, count(*) AS n, row_number() OVER (PARTITION BY method, kind ORDER BY count(*) DESC, value) AS place FROM (SELECT method, 'study' AS kind, study AS value FROM ({_METHOD}) UNION ALL SELECT method, 'author', trim(unnest(string_split(authors, ';'))) FROM ({_METHOD})) GROUP BY method, kind, value) WHERE place <= CASE kind WHEN 'study' THEN 10 ELSE 5 END")
def method_tops(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderstatus AS method", "o_custkey AS study", "o_orderpriority || '; C' || o_orderkey % 7 AS authors")
    return stats.method_tops(rows, "method", "study", "authors")


@HERE.add("SELECT count(*) FILTER (p_size > 25) AS subset, count(*) AS \"full\", count(*) FILTER (p_size > 25) * 100.0::DOUBLE / count(*) AS pct FROM part")
def subset_share(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return stats.subset_share(part, part.filter("p_size > 25"))


@HERE.add("SELECT 'resource' AS kind, p_partkey AS id, p_name || CASE WHEN p_size % 2 = 0 THEN ' (P' || p_size || ')' ELSE '' END || E'\\n  Diseases: ' || p_type || E'\\n  Modalities: ' || p_brand || CASE WHEN p_size % 3 = 0 THEN '' ELSE E'\\n  Sample Size: ' || p_size END AS digest FROM part UNION ALL SELECT 'publication', doc_id, 'Title: ' || source || E'\\n  Authors: a b;  c;  d et al.' || CASE WHEN doc_id % 2 = 0 THEN E'\\n  Keywords: ' || lang ELSE '' END || CASE WHEN text = '' THEN '' ELSE E'\\n  Abstract: ' || CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END END FROM documents UNION ALL SELECT 'repository', page_id, string_split(url, '/')[-1] || ' (S' || page_id % 9 || ')' || E'\\n  Languages: Python' || CASE WHEN page_id % 2 = 0 THEN E'\\n  Tooling: t' ELSE '' END || E'\\n  FAIR Score: ' || page_id % 11 || '/10' FROM pages UNION ALL SELECT 'cell line', c_custkey, c_custkey || ' - ' || c_mktsegment || ' v' || c_nationkey || E'\\n  Condition: ' || CASE WHEN c_nationkey = 0 THEN 'Control/Wildtype' ELSE c_nationkey::VARCHAR END || E'\\n  About gene: ' || repeat('x', 200) || '...' FROM customer")
def digests(spark, sf_dir):
    none = F.lit("")
    part = table(spark, sf_dir, "part").select(F.lit("resource").alias("kind"), F.col("p_partkey").alias("id"), sinks.resource_digest(F.col("p_name"), F.expr("CASE WHEN p_size % 2 = 0 THEN 'P' || p_size ELSE '' END"), F.col("p_type"), F.col("p_brand"), F.expr("CASE WHEN p_size % 3 <> 0 THEN string(p_size) END")).alias("digest"))
    docs = table(spark, sf_dir, "documents").select(F.lit("publication"), "doc_id", sinks.publication_digest(F.col("source"), F.lit("a b; c; d; e"), F.expr("CASE WHEN doc_id % 2 = 0 THEN lang END"), F.col("text")))
    repos = table(spark, sf_dir, "pages").select(F.lit("repository"), "page_id", sinks.repository_digest(F.col("url"), F.expr("'S' || page_id % 9"), F.lit("Python"), none, F.expr("CASE WHEN page_id % 2 = 0 THEN 't' ELSE '' END"), none, F.col("page_id") % 11))
    lines = table(spark, sf_dir, "customer").select(F.lit("cell line"), "c_custkey", sinks.cell_line_digest(F.col("c_custkey").cast("string"), F.col("c_mktsegment"), F.expr("'v' || c_nationkey"), F.col("c_nationkey").cast("string"), F.lit("x" * 201), F.lit(" ")))
    return part.union(docs).union(repos).union(lines)


@HERE.add(f"SELECT c_custkey, 'repository' AS kind, score / 10 * 3 AS colour, (c_custkey % 101)::DOUBLE / 100 * 3 AS by_completeness FROM ({_CODE})")
def node_colours(spark, sf_dir):
    rows = _code(spark, sf_dir).select("c_custkey", F.col("c_name").alias("Repository Link"), F.col("languages").alias("Languages"), F.col("score").alias("FAIR Score"), (F.col("c_custkey") % 101).alias("Data Completeness"))
    kind = graph.node_kind(rows.columns)
    return rows.select("c_custkey", F.lit(kind).alias("kind"), graph.node_colour(kind, rows.columns).alias("colour"), graph.node_colour(kind, rows.columns, True).alias("by_completeness"))


@HERE.add("SELECT DISTINCT ON (o_orderkey, c_name) o_orderkey, c_name, '' AS \"Keywords\" FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 5) JOIN customer ON o_custkey = c_custkey")
def harvest_written(spark, sf_dir):
    path = scratch(spark)
    capped = dedup.top_n_per(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 5)
    attached = capped.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = dedup.keep_first(S.conform(attached, ["o_orderkey", "c_name", "Keywords"]), ["o_orderkey", "c_name"], [F.col("o_orderkey")])
    sinks.export(rows, path, "tsv")
    return S.read_table(spark, path, multi_line=False).withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


_LEVELS = ["Excellent", "Strong", "Good"]
_LEVEL_BLOCK = ("levels", f"SELECT l AS metric, NULL AS value, count(part.l2) AS count, round(coalesce(count(part.l2) * 100.0::DOUBLE / nullif(sum(count(part.l2)) OVER (), 0), 0), 6) AS pct FROM (SELECT unnest({_LEVELS}) AS l) LEFT JOIN (SELECT {_LEVEL} AS l2 FROM part) part ON part.l2 = l GROUP BY l")


def _levels(spark, sf_dir):
    """Counts and shares of the compliance levels, those without a resource too."""
    known = spark.createDataFrame([(x,) for x in _LEVELS], "value string")
    counted = table(spark, sf_dir, "part").select(C.level(F.expr(_NOTE)).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    rows = known.join(counted, "value", "left").na.fill(0, ["n"])
    total = rows.agg(F.sum("n").alias("total"))
    return _counted(rows.crossJoin(F.broadcast(total)), pct=F.when(F.col("total") > 0, F.col("n") * 100.0 / F.col("total")).otherwise(0.0))


@HERE.add(_sections_sql([_LEVEL_BLOCK]))
def report_levels(spark, sf_dir):
    return sinks.report([("levels", _levels(spark, sf_dir))])


#: Heading, report, and for each block its section, title, style and order: fixed texts of the catalog's text report.
_CATALOG = [
    ("DATASETS", report_resources_full, _RESOURCE_BLOCKS, [("total", "Total Number of Datasets", "count", None), ("types", "Resource Types Distribution", "of_records", None), ("coarse", "Coarse Data Types", "of_entries", None), ("sizes", "Sample Size Statistics", "whole", ["mean", "median", "min", "max", "std", "n"])]),
    ("COMPLIANCE", report_levels, [_LEVEL_BLOCK], [("levels", "FAIR Compliance Levels", "share", _LEVELS)]),
    ("PUBLICATIONS", report_publications_full, _PAPER_BLOCKS, [("total", "Total Publications", "count", None), ("studies", "Five Most Prolific Studies", "count", None), ("authors", "Five Most Occurring Authors", "count", None), ("affiliations", "Five Most Occurring Affiliations", "count", None), ("keywords", "Top 10 Keywords", "share", None), ("completeness", "Data Completeness Distribution from PubMed API", "percent", ["mean", "median", "std"]), ("distribution", "Distribution", "count", ["0", "1", "2", "3"])]),
    ("CODE REPOSITORIES", report_code_full, _REPO_BLOCKS, [("total", "Total Repositories", "count", None), ("languages", "Top Programming Languages", "of_records", None), ("tooling", "Top 10 Keywords from Tooling", "share", None), ("data types", "Top 10 Keywords from Data Types", "share", None), ("summaries", "Top 10 Keywords from Code Summary", "share", None), ("components", "FAIR Component Completeness (% with component)", "pct", None), ("scores by language", "Mean FAIR Score by Language (0-10 scale)", "rated", ["L0", "L1", "L2"])]),
    ("HUMAN CELLULAR MODELS", report_cell_lines_full, _LINE_BLOCKS, [("total", "Total Cell Models", "count", None), ("conditions", "Cell Models per Condition", "share", None), ("genes", "Most Common Genes", "count", None), ("gene themes", "Top Themes from Gene Descriptions", "share", None), ("variant themes", "Top Themes from Variant Descriptions", "share", None)]),
]


def _catalog_sql():
    style = {
        "count": "count", "share": "count || ' (' || format('{:.1f}', pct) || '%)'", "pct": "format('{:.1f}', pct) || '%'",
        "whole": "format('{:.0f}', value)", "percent": "format('{:.1f}', value) || '%'", "rated": "format('{:.2f}', value) || '/10 (n=' || count || ' repos)'",
    }
    parts, at = ["SELECT 0 AS block, unnest(range(4))::INT AS \"row\", unnest([repeat('=', 80), 'Statistics', repeat('=', 80), '']) AS value"], 0
    for heading, _, sections, blocks in _CATALOG:
        at += 1
        parts.append(f"SELECT {at}, unnest([0, 1])::INT, unnest(['{heading}', repeat('-', 80)])")
        for section, name, kind, names in blocks:
            at += 1
            given = f"list_position({names}, metric), " if names else ""
            parts.append(f"SELECT {at}, 0, '{name}:'")
            rows = f"SELECT metric, value::DOUBLE AS value, coalesce(count, 0)::BIGINT AS count, pct::DOUBLE AS pct FROM ({dict(sections)[section]})"
            if kind.startswith("of_"):
                whole = f"(SELECT max(count) FROM ({dict(sections)['total']}))" if kind == "of_records" else "sum(count) OVER ()"
                rows = f"SELECT metric, value, count, count::DOUBLE / {whole} * 100 AS pct FROM ({rows})"
            parts.append(f"SELECT {at}, (row_number() OVER (ORDER BY {given}{'pct' if kind == 'pct' else 'count'} DESC, metric))::INT, '  ' || metric || ': ' || {style.get(kind, style['share'])} FROM ({rows})")
    return " UNION ALL ".join(parts)


@HERE.add(_catalog_sql())
def report_catalog_text(spark, sf_dir):
    return sinks.catalog_text([(heading, report(spark, sf_dir), blocks) for heading, report, _, blocks in _CATALOG], "Statistics")
