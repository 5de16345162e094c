"""Queries of counts, rankings, summaries, deduplication and compliance."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import columns as C
from shelfmark.functions import values
from shelfmark.operators import compliance, dedup, stats
from shelfmark.plans.book import Book, table
from shelfmark.plans.text_queries import _LEVEL, _NOTE, sql_list

HERE = Book()
KINDS = ["click", "error", "purchase", "signup", "view"]


@HERE.add("SELECT count(*) AS n, round(avg(x), 6) AS mean, median(x) AS median, min(x) AS min, max(x) AS max, round(stddev_pop(x), 6) AS std FROM (SELECT p_size::DOUBLE AS x FROM part)")
def numeric_summary(spark, sf_dir):
    return stats.numeric_summary(table(spark, sf_dir, "part"), C.first_number(F.concat(F.lit("n="), F.col("p_size").cast("string")))).withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@HERE.add("SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY value ORDER BY n DESC, value LIMIT 3")
def value_counts_topk(spark, sf_dir):
    return stats.top_k(table(spark, sf_dir, "customer"), F.col("c_mktsegment"), 3)


@HERE.add("SELECT o_orderpriority AS value, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM orders), 6) AS pct FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY value ORDER BY n DESC, value LIMIT 10")
def code_counts_excluding(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    best = stats.top_k(orders.filter("o_orderpriority <> '5-LOW'"), F.col("o_orderpriority"), 10)
    return best.crossJoin(F.broadcast(orders.agg(F.count("*").alias("total")))).select("value", "n", F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("pct"))


@HERE.add("SELECT count(DISTINCT p_name) AS names, count(DISTINCT p_brand) AS brands, count(*) AS parts FROM part")
def distinct_counts(spark, sf_dir):
    return table(spark, sf_dir, "part").agg(F.count_distinct("p_name").alias("names"), F.count_distinct("p_brand").alias("brands"), F.count("*").alias("parts"))


@HERE.add("SELECT 'resources' AS counter, count(*) AS n FROM part UNION ALL SELECT 'publications', count(DISTINCT doc_id) FROM documents UNION ALL SELECT 'repositories', count(DISTINCT url) FROM pages UNION ALL SELECT 'models', count(*) FROM customer")
def landing_counts(spark, sf_dir):
    each = (("resources", "part", F.count("*")), ("publications", "documents", F.count_distinct("doc_id")), ("repositories", "pages", F.count_distinct("url")), ("models", "customer", F.count("*")))
    one = [table(spark, sf_dir, t).agg(n.alias("n")).select(F.lit(name).alias("counter"), "n") for name, t, n in each]
    return one[0].union(one[1]).union(one[2]).union(one[3])


_WORDS = f"WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[;,\\s\\-_/()]+')) AS word FROM documents), k AS (SELECT * FROM w WHERE length(word) >= 3 AND regexp_full_match(word, '\\p{{L}}+') AND word NOT IN ({sql_list(values.STOPWORDS)}))"


@HERE.add(_WORDS + " SELECT word, count(*) AS count, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM k), 6) AS pct FROM k GROUP BY word ORDER BY count DESC, word LIMIT 10")
def word_frequencies_words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return stats.word_frequencies(docs, "doc_id", "text", values.STOPWORDS).withColumn("pct", F.round("pct", 6))


@HERE.add(_WORDS + " SELECT word, count(DISTINCT doc_id) AS count, round(count(DISTINCT doc_id) * 100.0::DOUBLE / (SELECT count(text) FROM documents), 6) AS pct FROM k GROUP BY word ORDER BY count(*) DESC, word LIMIT 10")
def word_frequencies_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return stats.word_frequencies(docs, "doc_id", "text", values.STOPWORDS, by_document=True).withColumn("pct", F.round("pct", 6))


@HERE.add("SELECT 'mean' AS stat, round(avg(value), 6) AS x FROM events UNION ALL SELECT 'median', median(value) FROM events UNION ALL SELECT 'min', min(value) FROM events UNION ALL SELECT 'max', max(value) FROM events")
def score_stats(spark, sf_dir):
    s = stats.numeric_summary(table(spark, sf_dir, "events"), F.col("value").cast("string").try_cast("double"))
    return s.select(F.inline(F.array(*[F.struct(F.lit(k).alias("stat"), (F.round("mean", 6) if k == "mean" else F.col(k)).alias("x")) for k in ("mean", "median", "min", "max")])))


@HERE.add("SELECT n::INT AS score, count(*) AS repos FROM (SELECT user_id, greatest(0, 10 - count(DISTINCT event_type)) AS n FROM events GROUP BY user_id) GROUP BY n")
def score_histogram(spark, sf_dir):
    scores = compliance.score_report(table(spark, sf_dir, "events"), "user_id", "event_type")
    return scores.groupBy(F.col("score").cast("int").alias("score")).agg(F.count("*").alias("repos")).orderBy("score")


@HERE.add("SELECT count(*) FILTER (score = 10) AS perfect, count(*) FILTER (score < 10) AS with_issues FROM (SELECT c_custkey, CASE WHEN n IS NULL THEN 10 ELSE greatest(0, 10 - n) END AS score FROM customer LEFT JOIN (SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY user_id) ON c_custkey = user_id)")
def perfect_vs_issues(spark, sf_dir):
    scores = compliance.score_report(table(spark, sf_dir, "events"), "user_id", "event_type").select(F.col("user_id").alias("c_custkey"), "score").withColumn("issues", F.lit(""))
    joined = compliance.with_compliance(table(spark, sf_dir, "customer"), scores, "c_custkey")
    return joined.agg(F.count_if(F.col("score") == 10).alias("perfect"), F.count_if(F.col("score") < 10).alias("with_issues"))


@HERE.add("SELECT bin, bin * 25.0::DOUBLE AS low, bin * 25.0::DOUBLE + 25 AS high, count(x) AS n FROM (SELECT unnest([0, 1, 2, 3])::INT AS bin) LEFT JOIN (SELECT p_size * 2.0::DOUBLE AS x FROM part) ON bin = least(floor(x / 25), 3) AND x <= 100 GROUP BY bin")
def fixed_bins(spark, sf_dir):
    return stats.histogram(table(spark, sf_dir, "part"), F.col("p_size") * 2.0, [0.0, 25.0, 50.0, 75.0, 100.0])


_COMPLETE = "SELECT kind AS component, round(avg(CASE WHEN contains(coalesce(issues, ''), kind) THEN 0.0 ELSE 1.0 END) * 100, 6) AS pct FROM customer LEFT JOIN (SELECT user_id, string_agg(DISTINCT event_type, '; ') AS issues FROM events GROUP BY user_id) ON c_custkey = user_id, (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS kind) GROUP BY kind"


@HERE.add(_COMPLETE)
def component_completeness(spark, sf_dir):
    issues = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.array_join(F.collect_set("event_type"), "; ").alias("issues"))
    repos = table(spark, sf_dir, "customer").join(issues, "c_custkey", "left")
    return compliance.component_completeness(repos, "issues", KINDS).withColumn("pct", F.round("pct", 6))


@HERE.add("SELECT event_type, round(avg(value), 6) AS mean, count(*) AS n FROM events WHERE event_type IN ('click', 'error', 'view') GROUP BY event_type")
def mean_score_by_group(spark, sf_dir):
    some = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "error", "view"))
    return some.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


@HERE.add("WITH t AS (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3), f AS (SELECT user_id, " + ", ".join(f"max((event_type = '{k}')::INT) AS {k}" for k in KINDS) + " FROM events GROUP BY user_id) SELECT c_mktsegment, count(*) AS n, " + ", ".join(f"round(avg({k}) * 100, 6) AS {k}" for k in KINDS) + " FROM customer JOIN t USING (c_mktsegment) JOIN f ON c_custkey = user_id GROUP BY c_mktsegment")
def issue_matrix(spark, sf_dir):
    log = table(spark, sf_dir, "events").withColumnRenamed("user_id", "c_custkey")
    m = compliance.issue_matrix(table(spark, sf_dir, "customer"), log, "c_custkey", "c_mktsegment", "event_type", KINDS, 3)
    return m.withColumns({k: F.round(k, 6) for k in KINDS})


_APP = "SELECT user_id, string_agg(event_type, '; ' ORDER BY first_id) AS issues, sum(n)::BIGINT AS n_issues, greatest(0, 10 - sum(n))::BIGINT AS score FROM (SELECT user_id, event_type, min(event_id) AS first_id, count(CASE WHEN value > 20 THEN props END) AS n FROM events GROUP BY ALL) GROUP BY user_id"


def _app_scores(spark, sf_dir):
    log = table(spark, sf_dir, "events").withColumn("details", F.when(F.col("value") > 20, F.col("props")))
    return compliance.score_app(log, "user_id", "event_type", "details", "event_id")


@HERE.add(_APP)
def compliance_score_app(spark, sf_dir):
    return _app_scores(spark, sf_dir)


@HERE.add("SELECT user_id, count(DISTINCT event_type) AS n_types, greatest(0, 10 - count(DISTINCT event_type)) AS score FROM events GROUP BY user_id")
def compliance_score_report(spark, sf_dir):
    return compliance.score_report(table(spark, sf_dir, "events"), "user_id", "event_type")


@HERE.add(f"SELECT c_custkey, coalesce(issues, '') AS issues, coalesce(score, 10)::DOUBLE AS score FROM customer LEFT JOIN ({_APP}) ON c_custkey = user_id")
def compliance_left_join(spark, sf_dir):
    return compliance.with_compliance(table(spark, sf_dir, "customer"), _app_scores(spark, sf_dir).withColumnRenamed("user_id", "c_custkey"), "c_custkey").select("c_custkey", "issues", "score")


_FILES = "(SELECT string_split(url, '/')[3] AS repo, CASE page_id % 7 WHEN 0 THEN 'README.md' WHEN 1 THEN 'setup.py' WHEN 2 THEN 'Dockerfile' WHEN 3 THEN 'environment.yml' WHEN 4 THEN 'docs/README.md' WHEN 5 THEN 'runtime.txt' ELSE 'x.py' END AS path FROM pages)"
_FLAGS = "SELECT repo, " + ", ".join(f"bool_or(lower(path) IN ({sql_list(names)})) AS {flag}" for flag, (names, _, _) in values.COMPLIANCE_FILES.items()) + f" FROM {_FILES} GROUP BY repo"


def _flags(spark, sf_dir):
    path = F.expr("CASE page_id % 7 WHEN 0 THEN 'README.md' WHEN 1 THEN 'setup.py' WHEN 2 THEN 'Dockerfile' WHEN 3 THEN 'environment.yml' WHEN 4 THEN 'docs/README.md' WHEN 5 THEN 'runtime.txt' ELSE 'x.py' END")
    files = table(spark, sf_dir, "pages").select(F.get(F.split("url", "/"), 2).alias("repo"), path.alias("path"))
    return compliance.tree_flags(files, "repo", "path")


@HERE.add(_FLAGS)
def tree_flags(spark, sf_dir):
    return _flags(spark, sf_dir)


@HERE.add(" UNION ALL ".join(f"SELECT repo, '{issue}' AS issue_type, '{text}' AS details, '2026-03-11T08:30:00' AS timestamp FROM ({_FLAGS}) WHERE NOT {flag}" for flag, (_, issue, text) in values.COMPLIANCE_FILES.items()))
def flags_to_issues(spark, sf_dir):
    return compliance.issues_from_flags(_flags(spark, sf_dir), "repo", F.lit("2026-03-11 08:30:00").cast("timestamp"))


@HERE.add(" UNION ALL ".join(f"SELECT '{flag}' AS flag, count(*) FILTER ({flag}) AS n, round(count(*) FILTER ({flag}) * 100.0::DOUBLE / greatest(count(*), 1), 6) AS pct FROM ({_FLAGS})" for flag in values.COMPLIANCE_FILES))
def run_stats(spark, sf_dir):
    return compliance.run_stats(_flags(spark, sf_dir)).withColumn("pct", F.round("pct", 6))


@HERE.add(f"PIVOT (SELECT p_type AS \"row\", {_LEVEL} AS level FROM part) ON level IN ('Excellent', 'Strong', 'Good', 'Unknown') USING count(*) GROUP BY \"row\"".replace("PIVOT", "SELECT *, Excellent + Strong + Good + \"Unknown\" AS total FROM (PIVOT", 1) + ")")
def pivot_level(spark, sf_dir):
    return stats.pivot_counts(table(spark, sf_dir, "part"), F.col("p_type"), C.level(F.expr(_NOTE)), ["Excellent", "Strong", "Good", "Unknown"])


@HERE.add("WITH t AS (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5) SELECT p_type, count(*) AS total, count(*) FILTER (p_size > 10) AS with_size, count(*) FILTER (p_size <= 10) AS missing, round(count(*) FILTER (p_size <= 10) * 100.0::DOUBLE / count(*), 6) AS pct FROM part JOIN t USING (p_type) GROUP BY p_type")
def coverage_by_type(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    best = stats.top_k(part, F.col("p_type"), 5).select(F.col("value").alias("p_type"))
    size = F.when(F.col("p_size") > 10, F.col("p_size"))
    counted = part.join(F.broadcast(best), "p_type").groupBy("p_type").agg(F.count("*").alias("total"), F.count(size).alias("with_size"))
    return counted.withColumn("missing", F.col("total") - F.col("with_size")).withColumn("pct", F.round(F.col("missing") * 100.0 / F.col("total"), 6))


@HERE.add("WITH l AS (SELECT p_type AS grp, log10(p_retailprice) AS v FROM part), s AS (SELECT grp, count(*) AS n, stddev_samp(v) AS sd FROM l GROUP BY grp), e AS (SELECT min(v) AS lo, max(v) AS hi FROM l) SELECT grp, point::INT AS point, round(lo + (hi - lo) * point / 199, 6) AS x, round(sum(exp(-0.5 * power((lo + (hi - lo) * point / 199 - v) / (sd * power(n, -0.2)), 2)) / (n * sd * power(n, -0.2) * sqrt(2 * pi()))), 6) AS density FROM l JOIN s USING (grp), e, range(200) r(point) GROUP BY grp, point, lo, hi")
def density_grid(spark, sf_dir):
    d = stats.density(table(spark, sf_dir, "part"), F.col("p_type"), F.col("p_retailprice"))
    return d.withColumn("x", F.round("x", 6)).withColumn("density", F.round("density", 6))


_METRICS = "SELECT o_orderstatus, studies, most, median, records, unique_ids, round(unique_ids * 100.0::DOUBLE / records, 6) AS unique_pct FROM (SELECT o_orderstatus, count(*) AS studies, max(n) AS most, median(n) AS median, sum(n)::BIGINT AS records FROM (SELECT o_orderstatus, o_custkey, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1) JOIN (SELECT o_orderstatus, count(DISTINCT o_totalprice) AS unique_ids FROM orders GROUP BY 1) USING (o_orderstatus)"


def _metrics(spark, sf_dir):
    return stats.method_metrics(table(spark, sf_dir, "orders"), "o_orderstatus", "o_custkey", "o_totalprice").withColumn("unique_pct", F.round("unique_pct", 6))


@HERE.add(_METRICS)
def method_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)


@HERE.add(f"SELECT metric, max(value) FILTER (o_orderstatus = 'F') AS f, max(value) FILTER (o_orderstatus = 'O') AS o, max(value) FILTER (o_orderstatus = 'P') AS p FROM (SELECT o_orderstatus, unnest(['records', 'studies', 'most', 'median', 'unique_pct']) AS metric, unnest([records::DOUBLE, studies, most, median, unique_pct]) AS value FROM ({_METRICS})) GROUP BY metric")
def transpose_metrics(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    names = ["records", "studies", "most", "median", "unique_pct"]
    long = m.select("o_orderstatus", *[F.col(c).cast("double").alias(c) for c in names]).unpivot("o_orderstatus", names, "metric", "value")
    return long.groupBy("metric").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.max("value")).toDF("metric", "f", "o", "p")


@HERE.add("WITH a AS (SELECT o_custkey, count(*) AS a FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey, count(*) AS b FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), d AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b ON a.o_custkey = b.o_custkey) SELECT o_custkey, a, b, abs(a - b) AS diff, CASE WHEN a > b THEN 'a' WHEN a < b THEN 'b' ELSE 'tie' END AS winner, abs(a - b) >= (SELECT quantile_cont(abs(a - b), 0.85) FROM d WHERE a <> b) AS top, a = 0 OR b = 0 AS one_sided FROM d")
def pairwise_divergence(spark, sf_dir):
    counts = lambda s: table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return stats.divergence(counts("F"), counts("O"), "o_custkey")


@HERE.add("(SELECT p_brand AS value, count(*) AS n, 'subset' AS scope FROM part WHERE p_size > 25 GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5) UNION ALL (SELECT p_brand, count(*), 'full' FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)")
def subset_vs_full(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return stats.subset_vs_full(part, part.filter("p_size > 25"), F.col("p_brand"))


@HERE.add("SELECT l_suppkey, arg_max(l_returnflag, struct_pack(q := q, f := l_returnflag)) AS primary_flag FROM (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) GROUP BY l_suppkey")
def primary_by_weight(spark, sf_dir):
    weights = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    return weights.groupBy("l_suppkey").agg(F.max_by("l_returnflag", F.struct("q", "l_returnflag")).alias("primary_flag"))


@HERE.add("SELECT user_id, event_type, max(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS turn FROM events) WHERE turn = 1 GROUP BY ALL")
def keep_latest(spark, sf_dir):
    return dedup.keep_latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", [F.desc("event_id")]).select("user_id", "event_type", "event_id")


@HERE.add("SELECT url, min(page_id) AS page_id FROM pages GROUP BY url")
def keep_first(spark, sf_dir):
    return dedup.keep_first(table(spark, sf_dir, "pages"), ["url"], [F.col("page_id")]).select("url", "page_id")


@HERE.add("SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 30")
def top_n_per_study(spark, sf_dir):
    return dedup.top_n_per(table(spark, sf_dir, "documents"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 30).select("source", "doc_id", "n_chars")


@HERE.add("SELECT event_id, value FROM events WHERE value IS NOT NULL ORDER BY value DESC, event_id LIMIT 5")
def nlargest(spark, sf_dir):
    return dedup.largest(table(spark, sf_dir, "events"), "value", 5, "event_id").select("event_id", "value")


@HERE.add("SELECT * FROM nation WHERE n_nationkey >= 5 AND n_nationkey < 15")
def row_slice(spark, sf_dir):
    return dedup.row_slice(table(spark, sf_dir, "nation"), "n_nationkey", 5, 15)


@HERE.add("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20")
def head_n(spark, sf_dir):
    return table(spark, sf_dir, "customer").orderBy("c_custkey").limit(20).select("c_custkey", "c_name")


@HERE.add("WITH f AS (SELECT conv_id, CASE turn WHEN 0 THEN 'README.md' WHEN 1 THEN 'setup.py' WHEN 2 THEN 'package.json' ELSE 'x' END AS name, text FROM conversations), p AS (SELECT conv_id, min(CASE WHEN name = 'README.md' THEN E'README:\\n' || text END) AS r, coalesce(min(CASE WHEN name = 'package.json' THEN E'package.json:\\n' || substr(text, 1, 1000) END), min(CASE WHEN name = 'setup.py' THEN E'setup.py:\\n' || substr(text, 1, 1000) END)) AS m FROM f GROUP BY conv_id) SELECT conv_id, concat_ws(E'\\n\\n', r, CASE WHEN r IS NULL OR length(r) < 200 THEN m END) AS content FROM p")
def fallback_pick(spark, sf_dir):
    files = table(spark, sf_dir, "conversations").withColumn("name", F.expr("CASE turn WHEN 0 THEN 'README.md' WHEN 1 THEN 'setup.py' WHEN 2 THEN 'package.json' ELSE 'x' END"))
    return dedup.fallback_content(files, "conv_id", "name", "text")


@HERE.add("SELECT l_suppkey, string_agg(l_partkey::VARCHAR, '; ' ORDER BY l_partkey) AS parts FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem QUALIFY dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) <= 10) GROUP BY l_suppkey")
def first_n_joined(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    first = dedup.top_n_per(pairs, ["l_suppkey"], [F.col("l_partkey")], 10)
    return first.groupBy("l_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_partkey")), lambda x: x.cast("string")), "; ").alias("parts"))


@HERE.add("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current FROM events")
def carry_forward(spark, sf_dir):
    marked = table(spark, sf_dir, "events").withColumn("mark", F.when(F.col("event_type") == "signup", F.col("props")))
    return marked.select("event_id", dedup.carry_forward(marked, "mark", ["user_id"], "event_id").alias("current"))


@HERE.add("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN props END IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current FROM events")
def carry_over_all(spark, sf_dir):
    marked = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "signup", F.col("props")).alias("mark"))
    return dedup.carried(marked, "mark", ["event_id"], name="current").select("event_id", "current")


@HERE.add("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current FROM events")
def carry_by_ranges(spark, sf_dir):
    marked = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type") == "signup", F.col("props")).alias("mark"))
    return dedup.carried(marked, "mark", ["event_id"], ["user_id"], "current").select("event_id", "current")


_QUANTILES = "round(quantile_cont(l_extendedprice::DOUBLE, 0.5), 6) AS median, round(quantile_cont(l_extendedprice::DOUBLE, 0.85), 6) AS high"


@HERE.add(f"SELECT 'all' AS flag, {_QUANTILES} FROM lineitem UNION ALL SELECT l_returnflag, {_QUANTILES} FROM lineitem GROUP BY 1")
def exact_quantiles(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice")
    found = [stats.quantiles(lines.withColumn("flag", flag), price, [0.5, 0.85], ["flag"], small=500, accuracy=200) for flag in (F.lit("all"), F.col("l_returnflag"))]
    at = lambda i: F.round(F.get("quantiles", i), 6)
    return found[0].union(found[1]).select("flag", at(0).alias("median"), at(1).alias("high"))


@HERE.add("SELECT l_suppkey AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def heavy_values(spark, sf_dir):
    return stats.heavy_top_k(table(spark, sf_dir, "lineitem"), F.col("l_suppkey"), 10, 2000)


@HERE.add("SELECT event_type, count(DISTINCT user_id) AS exact, true AS near FROM events GROUP BY 1")
def distinct_by_sketches(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    by_day = stats.distinct_sketches(events.withColumn("day", F.to_date("ts")), ["event_type", "day"], F.col("user_id"))
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"))
    return stats.distinct_from(by_day, ["event_type"]).join(exact, "event_type").select("event_type", "exact", (F.abs(F.col("distinct") - F.col("exact")) <= 0.08 * F.col("exact") + 1).alias("near"))


@HERE.add("WITH l AS (SELECT l_returnflag AS grp, log10(l_extendedprice::DOUBLE) AS v FROM lineitem), s AS (SELECT grp, count(*) AS n, stddev_samp(v) AS sd FROM l GROUP BY grp), e AS (SELECT min(v) AS lo, max(v) AS hi FROM l) SELECT grp, point::INT AS point, round(sum(exp(-0.5 * power((lo + (hi - lo) * point / 39 - v) / (sd * power(n, -0.2)), 2)) / (n * sd * power(n, -0.2) * sqrt(2 * pi()))), 4) AS density FROM l JOIN s USING (grp), e, range(40) r(point) GROUP BY grp, point")
def density_binned(spark, sf_dir):
    d = stats.binned_density(table(spark, sf_dir, "lineitem"), F.col("l_returnflag"), F.col("l_extendedprice").cast("double"), 40)
    return d.select("grp", "point", F.round("density", 4).alias("density"))
