"""Queries of sources and sinks, joins, harvest and annotation, and the composed pages and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import columns as C
from shelfmark.operators import annotate, compliance, dedup, filters, graph, harvest, stats
from shelfmark.plans import sinks
from shelfmark.plans.book import Book, scratch, table
from shelfmark.plans.graph_queries import _EDGES, _graph
from shelfmark.plans.stat_queries import _APP, _app_scores
from shelfmark.plans.text_queries import _LEVEL, _NOTE, SQL_BLANKS
from shelfmark.sources import tables as S

HERE = Book()


def _landed(df, sep="\t"):
    path = scratch(df.sparkSession)
    df.write.option("header", True).option("sep", sep).option("quoteAll", True).option("escape", '"').csv(path)
    return path


@HERE.add("SELECT p_partkey::VARCHAR AS key, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END AS name, p_brand AS brand FROM part")
def tsv_load(spark, sf_dir):
    raw = table(spark, sf_dir, "part").selectExpr("p_brand AS brand", "p_partkey AS ` key `", "p_type AS other", "CASE WHEN p_size % 5 = 0 THEN 'N/A' ELSE p_name END AS name")
    return S.read_table(spark, _landed(raw), ["key", "name", "brand"])


@HERE.add("SELECT 'part' AS kind, count(*) AS n FROM part")
def latest_file(spark, sf_dir):
    path = scratch(spark)
    part = table(spark, sf_dir, "part").select("p_partkey")
    for name, rows in (("old", part.filter("p_partkey % 2 = 0")), ("new", part)):
        rows.write.option("header", True).option("sep", "\t").csv(f"{path}/{name}")
    read = S.read_table(spark, S.latest_write(spark, path), ["p_partkey"], multi_line=False)
    return read.agg(F.count("*").alias("n")).select(F.lit("part").alias("kind"), "n")


@HERE.add("SELECT c_custkey::VARCHAR AS key, c_name AS name, '' AS extra FROM customer UNION ALL SELECT s_suppkey::VARCHAR, '', s_name FROM supplier")
def multi_file_union(spark, sf_dir):
    paths = [_landed(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))), _landed(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("extra"), F.col("s_suppkey").alias("key")))]
    return S.read_table(spark, paths, ["key", "name", "extra"])


_BATCHES = "SELECT o_custkey % 1000 AS link, o_orderkey, o_orderkey % 4 AS batch FROM orders"


def _batches(spark, sf_dir):
    return S.merge_batches(table(spark, sf_dir, "orders").select((F.col("o_custkey") % 1000).alias("Repository Link"), "o_orderkey", (F.col("o_orderkey") % 4).alias("batch")))


@HERE.add(f"SELECT link AS \"Repository Link\", o_orderkey FROM ({_BATCHES}) QUALIFY row_number() OVER (PARTITION BY link ORDER BY batch, o_orderkey) = 1")
def merge_batches(spark, sf_dir):
    return _batches(spark, sf_dir)[0]


@HERE.add(f"SELECT count(*) AS before, count(DISTINCT link) AS after, count(*) - count(DISTINCT link) AS removed FROM ({_BATCHES})")
def merge_batches_counts(spark, sf_dir):
    return _batches(spark, sf_dir)[1]


@HERE.add("SELECT user_id AS \"Repository\", event_type AS \"Issue Type\", event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 7, event_id) = 1")
def union_compliance_logs(spark, sf_dir):
    logs = table(spark, sf_dir, "events").select(F.col("user_id").alias("Repository"), F.col("event_type").alias("Issue Type"), "event_id", (F.col("event_id") % 7).alias("file"))
    return S.union_compliance_logs(logs, ["file", "event_id"]).drop("file")


@HERE.add("SELECT p_name, '' AS absent, p_partkey FROM part")
def conform_columns(spark, sf_dir):
    return S.conform(table(spark, sf_dir, "part"), ["p_name", "absent", "p_partkey"])


@HERE.add("SELECT p_name AS \"Resource Name\", array_to_string(list_sort(list_distinct([p_brand, p_type])), ';') AS \"Diseases Included\" FROM part")
def load_resources(spark, sf_dir):
    raw = table(spark, sf_dir, "part").select(F.col("p_name").alias("Resource Name"), F.expr("p_type || '; ' || p_brand || ', ' || lower(p_brand)").alias("Diseases Included"), F.lit("x").alias("Notes"), F.lit("").alias("Remove"))
    return S.load_resources(S.read_table(spark, _landed(raw), raw.columns))


@HERE.add("SELECT p_name AS \"Repository Link\", array_to_string(list_sort([p_brand, p_type]), ';') AS \"Languages\" FROM part")
def load_code_repos(spark, sf_dir):
    raw = table(spark, sf_dir, "part").select(F.col("p_name").alias("Repository Link"), F.expr("p_type || '; ' || p_brand || ';' || lower(p_type)").alias("Languages"), F.lit("text").alias("Content_For_Analysis"))
    return S.load_code_repos(raw)


@HERE.add("SELECT doc_id, 'PMC' || doc_id AS \"PubMed Central Link\", 'Z ' || source AS \"Authors\", lang AS \"Keywords\", text AS \"Abstract\", 'B; b' AS \"Affiliations\", 'AD;' || lang AS \"Diseases Included\", 100.0::DOUBLE AS \"Data Completeness\" FROM documents")
def load_publications(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("PMCPMC"), F.col("doc_id").cast("string")).alias("PubMed Central Link"), F.concat(F.col("source"), F.lit(" Z")).alias("Authors"), F.col("lang").alias("Keywords"), F.col("text").alias("Abstract"), F.lit("B; b").alias("Affiliations"), F.concat(F.lit("AD, "), F.col("lang"), F.lit("; ad")).alias("Diseases Included"))
    return S.load_publications(raw)


_LOG_SQL = "SELECT user_id::VARCHAR AS \"Repository\", event_type AS \"Issue Type\", regexp_replace(strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f'), '\\.?0+$', '') AS \"Timestamp\" FROM events GROUP BY ALL"


@HERE.add(_LOG_SQL)
def load_compliance_log(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("Repository"), F.col("event_type").alias("Issue Type"), F.col("props").alias("Details"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("Timestamp"))
    return S.load_compliance_log(raw).select("Repository", "Issue Type", F.regexp_replace("Timestamp", r"\.?0+$", "").alias("Timestamp"))


@HERE.add("SELECT user_id AS \"Repository\", event_type AS \"Issue Type\", arg_max(event_id, ts)::VARCHAR AS \"Details\" FROM events WHERE event_id % 50 <> 0 GROUP BY ALL")
def load_newest_compliance_log(spark, sf_dir):
    path = scratch(spark)
    log = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("Repository"), F.col("event_type").alias("Issue Type"), F.col("event_id").alias("Details"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("Timestamp"))
    for name, rows in (("fair_compliance_log_1", log), ("fair_compliance_log_2", log.filter("`Details` % 50 <> 0"))):
        rows.write.option("header", True).option("sep", "\t").csv(f"{path}/{name}")
    newest = S.load_compliance_log(S.read_table(spark, S.latest_write(spark, path), multi_line=False))
    return newest.select(F.col("Repository").cast("long").alias("Repository"), "Issue Type", "Details")


@HERE.add(f'SELECT src AS "row", dst AS col, weight FROM ({_EDGES}) UNION ALL SELECT dst, src, weight FROM ({_EDGES})')
def export_adjacency(spark, sf_dir):
    path = scratch(spark)
    sinks.export(graph.adjacency(*_graph(spark, sf_dir)), path, "csv")
    return spark.read.option("header", True).schema("row string, col string, weight long").csv(path)


@HERE.add("SELECT c_custkey::VARCHAR AS product, c_mktsegment AS gene, CASE WHEN c_nationkey = 0 THEN 'Control/Wildtype' ELSE c_nationkey::VARCHAR END AS condition FROM customer")
def load_cell_lines(spark, sf_dir):
    raw = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("product"), F.col("c_mktsegment").alias("gene"), F.col("c_nationkey").alias("condition"))
    return S.read_table(spark, _landed(raw), raw.columns).withColumn("condition", C.condition(F.col("condition")))


@HERE.add("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def export_roundtrip(spark, sf_dir):
    path = scratch(spark)
    part = table(spark, sf_dir, "part")
    for fmt in ("csv", "tsv", "json"):
        sinks.export(part, f"{path}/{fmt}", fmt)
    by = [spark.read.option("header", True).schema(part.schema).csv(f"{path}/csv"), spark.read.option("header", True).option("sep", "\t").schema(part.schema).csv(f"{path}/tsv"), spark.read.schema(part.schema).json(f"{path}/json")]
    return by[0].intersectAll(by[1]).intersectAll(by[2])


@HERE.add(f"SELECT src, dst, weight, shared FROM ({_EDGES})")
def export_edges(spark, sf_dir):
    path = scratch(spark)
    sinks.export(graph.edge_details(_graph(spark, sf_dir)[1]), path, "csv")
    return spark.read.option("header", True).schema("src string, dst string, weight long, shared string").csv(path)


@HERE.add("SELECT unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) AS \"column\", unnest(['bigint', 'string', 'string', 'string', 'int', 'double']) AS type, 0::BIGINT AS nulls, (SELECT count(*) FROM part) AS row_count")
def profile(spark, sf_dir):
    return sinks.profile(table(spark, sf_dir, "part"))


@HERE.add("SELECT doc_id, source || '. ' || text || '.' || CASE WHEN doc_id % 2 = 0 THEN ' http://x/' || doc_id ELSE '' END AS citation FROM documents")
def citations(spark, sf_dir):
    link = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("http://x/"), F.col("doc_id").cast("string"))).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", sinks.citation(F.col("source"), F.col("text"), link).alias("citation"))


@HERE.add("SELECT -1::BIGINT AS \"row\", repeat('=', 80) || E'\\n' || repeat(' ', 34) || 'All of parts' || repeat(' ', 34) || E'\\n' || repeat('=', 80) || E'\\n\\nTotal Records: ' || count(*) || E'\\n\\n' || repeat('=', 80) || E'\\n' AS value FROM part UNION ALL SELECT p_partkey, 'Record ' || p_partkey || E':\\n' || repeat('-', 80) || E'\\np_name: ' || p_name || E'\\np_brand: ' || p_brand || E'\\nnote:\\n  a\\n  b\\n' FROM part")
def text_records(spark, sf_dir):
    return sinks.text_records(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", F.lit("").alias("blank"), F.lit("a\nb").alias("note")), "p_partkey", "All of parts")


@HERE.add("SELECT doc_id::VARCHAR AS \"PMID\", 'https://www.ncbi.nlm.nih.gov/pmc/articles/PMC' || doc_id AS \"PubMed Central Link\", source || ' ' || lang AS \"Authors\", 'Inst ' || source AS \"Affiliations\", 'Title ' || doc_id AS \"Title\", 'AIM: n' || n_chars || ' end' AS \"Abstract\", lang || '; ' || source AS \"Keywords\" FROM documents WHERE doc_id % 10 <> 0")
def xml_articles(spark, sf_dir):
    xml = F.format_string(
        "<PubmedArticle><MedlineCitation><PMID>%d</PMID><Article><ArticleTitle>%s<i>x</i> y</ArticleTitle><Abstract><AbstractText Label=\"AIM\">n%d</AbstractText><AbstractText>end</AbstractText></Abstract><AuthorList><Author><LastName>%s</LastName><ForeName>%s</ForeName><AffiliationInfo><Affiliation>Inst  %s</Affiliation></AffiliationInfo></Author></AuthorList></Article><KeywordList><Keyword>%s</Keyword><Keyword>%s</Keyword></KeywordList></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType=\"doi\">d</ArticleId><ArticleId IdType=\"pmc\">PMC%d</ArticleId></ArticleIdList></PubmedData></PubmedArticle>",
        "doc_id", F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.concat(F.lit("Title "), F.col("doc_id").cast("string"))), "n_chars", "source", "lang", "source", "lang", "source", "doc_id",
    )
    return S.article_texts(table(spark, sf_dir, "documents").select(xml.alias("xml")), "xml")


_LINES = "SELECT user_id || '' AS file, event_id AS n, CASE WHEN event_type = 'signup' THEN '[1/2] Searching GitHub for repositories related to Study ' || user_id || ' (S' || user_id || ')...' WHEN event_id % 11 = 0 THEN '  Skipping https://github.com/g/' || event_id % 500 || ' - no licence' WHEN event_id % 11 = 1 THEN '  Skipping https://example.org/g/1 - insufficient content' ELSE '  Skipping https://github.com/g/' || event_id % 500 || ' - insufficient content' END AS line FROM events"
_SKIPS = f"WITH l AS ({_LINES}), s AS (SELECT *, last_value(CASE WHEN line LIKE '[1/2]%' THEN regexp_extract(line, 'related to (.+?) \\((.+?)\\)\\.\\.\\.', ['study', 'abbreviation']) END IGNORE NULLS) OVER (PARTITION BY file ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS found FROM l), k AS (SELECT *, regexp_extract(line, 'Skipping (https://github\\.com/\\S+) - insufficient content', 1) AS url FROM s) SELECT url, arg_max(found.study, struct_pack(f := file, n := n)) AS study, arg_max(found.abbreviation, struct_pack(f := file, n := n)) AS abbreviation FROM k WHERE url <> '' AND found IS NOT NULL GROUP BY url"


_LOG_LINE = "CASE WHEN event_type = 'signup' THEN '[1/2] Searching GitHub for repositories related to Study ' || user_id || ' (S' || user_id || ')...' WHEN event_id % 11 = 0 THEN '  Skipping https://github.com/g/' || event_id % 500 || ' - no licence' WHEN event_id % 11 = 1 THEN '  Skipping https://example.org/g/1 - insufficient content' ELSE '  Skipping https://github.com/g/' || event_id % 500 || ' - insufficient content' END AS line"


def _log_lines(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("string(user_id) AS file", "event_id AS n", _LOG_LINE)


@HERE.add(_SKIPS)
def log_carry_forward(spark, sf_dir):
    return S.skipped_urls(_log_lines(spark, sf_dir))


@HERE.add(_SKIPS.replace("PARTITION BY file ORDER BY n", "ORDER BY file, n"))
def log_carry_across(spark, sf_dir):
    return S.skipped_urls(_log_lines(spark, sf_dir), across=True)


@HERE.add("SELECT conv_id || '_' || turn AS key, 'YES a: b' AS biomedical_relevance, 's' || turn AS summary, 'MRI' AS data_types, 'Python ' || conv_id AS tools FROM conversations")
def parse_sections(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id || '_' || turn AS key", "concat('Biomedical Relevance: YES\\na: b\\nnote CODE SUMMARY: s', turn, '\\n\\nData Types: MRI\\nTooling: R\\ntooling: Python ', conv_id) AS text")
    return annotate.parse_sections(rows, "key", "text")


_IDENT = "substr(regexp_replace('repo_' || conv_id || '_' || turn, '[^a-zA-Z0-9_-]', '_', 'g'), 1, 64)"


@HERE.add(f"SELECT {_IDENT} AS custom_id, 'm' AS model, 1000 AS max_tokens, 'user' AS role, 'Repository ' || turn || ': ' || substr(text, 1, 8000) AS content FROM conversations WHERE length(trim(text)) >= 50")
def request_table(spark, sf_dir):
    r = annotate.requests(table(spark, sf_dir, "conversations"), "conv_id", F.col("turn").cast("string"), "text", "Repository %s: %s", "m")
    return r.select("custom_id", "params.model", "params.max_tokens", F.get("params.messages", 0)["role"].alias("role"), F.get("params.messages", 0)["content"].alias("content"))


@HERE.add("SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'new ' || c_custkey ELSE c_mktsegment END AS c_mktsegment FROM customer")
def merge_results(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    results = customer.filter("c_custkey % 3 = 0").select("c_custkey", F.concat(F.lit("new "), F.col("c_custkey").cast("string")).alias("c_mktsegment"))
    return annotate.merge_results(customer, results, "c_custkey", ["c_mktsegment"])


@HERE.add("SELECT conv_id || '_' || turn AS custom_id, CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN 'ERROR - errored: bad ' || role ELSE 'ERROR - expired' END AS response FROM conversations")
def batch_errors(spark, sf_dir):
    result = F.expr("named_struct('type', CASE turn % 3 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'errored' ELSE 'expired' END, 'message', CASE WHEN turn % 3 = 0 THEN named_struct('content', array(named_struct('text', text))) END, 'error', CASE WHEN turn % 3 = 1 THEN named_struct('type', 'x', 'message', 'bad ' || role) END)")
    path = scratch(spark)
    table(spark, sf_dir, "conversations").select(F.expr("conv_id || '_' || turn").alias("custom_id"), result.alias("result")).write.json(path)
    return S.batch_results(spark, path)


@HERE.add("SELECT c_custkey, coalesce(s_name, '') AS s_name FROM customer LEFT JOIN (SELECT s_nationkey, arg_max(s_name, s_suppkey) AS s_name FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey")
def lookup_last_wins(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "c_nationkey")
    return dedup.lookup(table(spark, sf_dir, "customer"), suppliers, "c_nationkey", "s_name", "s_suppkey").select("c_custkey", "s_name")


@HERE.add("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def attach_metadata(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "c_mktsegment")


@HERE.add("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti_missing(spark, sf_dir):
    has = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(has, "c_custkey", "left_anti").select("c_custkey")


@HERE.add("SELECT n_name, word, n_name || ' ' || word AS search FROM nation, (SELECT unnest(['alzheimer', 'parkinson', 'dementia', 'brain']) AS word)")
def search_grid(spark, sf_dir):
    return harvest.search_grid(table(spark, sf_dir, "nation"), "n_name", ["alzheimer", "parkinson", "dementia", "brain"]).select("n_name", "word", "search")


@HERE.add("WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') SELECT 'both' AS op, count(*) AS n FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'either', count(*) FROM (FROM a UNION FROM b) UNION ALL SELECT 'first', count(*) FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'all', count(*) FROM (FROM a UNION ALL FROM b)")
def set_ops(spark, sf_dir):
    keys = lambda s: table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")).distinct()
    a, b = keys("F"), keys("P")
    each = [("both", a.intersect(b)), ("either", a.union(b).distinct()), ("first", a.subtract(b)), ("all", a.union(b))]
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n") for op, df in each]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


def _resources(spark, sf_dir):
    """Parts as resources: name, and lists of diseases, coarse and granular data, types."""
    return table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name", "p_type || ';' || p_brand AS diseases", "p_type || ',' || p_size AS coarse", "p_brand || ';' || p_size % 7 AS granular", "p_type AS kind")


_RESOURCES = "SELECT p_partkey, p_name, p_type || ';' || p_brand AS diseases, p_type || ',' || p_size AS coarse, p_brand || ';' || p_size % 7 AS granular, p_type AS kind FROM part"
_BROWSE_RESOURCES = f"SELECT p_partkey, p_name, diseases, coarse, granular, kind FROM ({_RESOURCES}) WHERE (p_name ILIKE '%ring%' OR diseases ILIKE '%ring%' OR coarse ILIKE '%ring%' OR granular ILIKE '%ring%' OR kind ILIKE '%ring%' OR p_partkey::VARCHAR ILIKE '%ring%') AND (contains(diseases, 'ECONOMY') OR contains(diseases, 'PROMO')) AND contains(coarse, '1') AND (contains(granular, ';1') OR contains(granular, ';2')) AND contains(kind, 'O')"


@HERE.add(_BROWSE_RESOURCES)
def browse_resources(spark, sf_dir):
    wanted = {"diseases": ["ECONOMY", "PROMO"], "coarse": ["1"], "granular": [";1", ";2"], "kind": ["O"]}
    return _resources(spark, sf_dir).transform(filters.search("ring")).transform(filters.filter_by(wanted))


_PAPERS = "SELECT d.doc_id, d.text, d.source AS study, d.lang || ';' || d.source AS diseases, d.lang AS coarse, d.lang || ',' || d.n_chars % 5 AS granular, CASE WHEN l.quality = 1 THEN 'good; checked' ELSE '' END AS keywords FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"
_BROWSE_PAPERS = f"SELECT doc_id, study, diseases, coarse, granular, keywords FROM ({_PAPERS}) WHERE text ILIKE '%tion%' AND contains(study, 'src1') AND contains(diseases, 'en') AND (contains(coarse, 'en') OR contains(coarse, 'fr')) AND contains(granular, ',1') AND contains(keywords, 'good')"


def _papers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.selectExpr("doc_id", "text", "source AS study", "lang || ';' || source AS diseases", "lang AS coarse", "lang || ',' || n_chars % 5 AS granular", "CASE WHEN quality = 1 THEN 'good; checked' ELSE '' END AS keywords")


@HERE.add(_BROWSE_PAPERS)
def browse_publications(spark, sf_dir):
    wanted = {"study": ["src1"], "diseases": ["en"], "coarse": ["en", "fr"], "granular": [",1"], "keywords": ["good"], "absent": ["x"]}
    return _papers(spark, sf_dir).transform(filters.search("TION", ["text"])).transform(filters.filter_by(wanted)).drop("text")


_CODE = f"SELECT c_custkey, c_name, c_mktsegment AS diseases, 'L' || c_nationkey % 4 AS languages, 'T' || c_nationkey % 3 AS tools, 'D' || c_nationkey % 5 AS data_types, 'Study ' || c_nationkey AS study, CASE c_custkey % 3 WHEN 0 THEN 'YES it is' WHEN 1 THEN 'Partial' ELSE 'NO' END AS relevance, coalesce(issues, '') AS issues, coalesce(score, 10)::DOUBLE AS score FROM customer LEFT JOIN ({_APP}) ON c_custkey = user_id"
_BROWSE_CODE = f"SELECT * FROM ({_CODE}) WHERE c_name ILIKE '%1%' AND contains(diseases, 'BUILD') AND contains(languages, 'L') AND (contains(tools, 'T1') OR contains(tools, 'T2')) AND contains(data_types, 'D') AND contains(study, '1') AND (contains(upper(relevance), 'YES') OR contains(upper(relevance), 'PARTIAL')) AND score >= 5"


def _code(spark, sf_dir):
    repos = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name", "c_mktsegment AS diseases", "'L' || c_nationkey % 4 AS languages", "'T' || c_nationkey % 3 AS tools", "'D' || c_nationkey % 5 AS data_types", "'Study ' || c_nationkey AS study", "CASE c_custkey % 3 WHEN 0 THEN 'YES it is' WHEN 1 THEN 'Partial' ELSE 'NO' END AS relevance")
    return compliance.with_compliance(repos, _app_scores(spark, sf_dir).withColumnRenamed("user_id", "c_custkey"), "c_custkey").select(*repos.columns, "issues", "score")


@HERE.add(_BROWSE_CODE)
def browse_code(spark, sf_dir):
    wanted = {"diseases": ["BUILD"], "languages": ["L"], "tools": ["T1", "T2"], "data_types": ["D"], "study": ["1"]}
    found = _code(spark, sf_dir).transform(filters.search("1", ["c_name"])).transform(filters.filter_by(wanted))
    return found.filter(filters.relevant(F.col("relevance"), ["YES", "PARTIAL"])).filter(F.col("score") >= 5)


_OPTIONS = (("resources", _RESOURCES, {"diseases": ";", "coarse": ",", "granular": ";,", "kind": ","}), ("publications", _PAPERS, {"study": ";", "diseases": ";,", "coarse": ",", "granular": ";,", "keywords": ";"}), ("code", _CODE, {"diseases": ";", "languages": ";", "tools": ";", "data_types": ";", "study": ";"}))


@HERE.add(" UNION ALL ".join(f"SELECT '{page}' AS page, '{column}' AS field, trim(v) AS value, count(*) AS n FROM (SELECT unnest(string_split_regex({column}, '[{by}]')) AS v FROM ({sql})) WHERE trim(v) <> '' GROUP BY trim(v)" for page, sql, fields in _OPTIONS for column, by in fields.items()))
def browse_options(spark, sf_dir):
    pages = {"resources": _resources(spark, sf_dir), "publications": _papers(spark, sf_dir), "code": _code(spark, sf_dir)}
    return filters.options([(page, pages[page], fields) for page, _, fields in _OPTIONS])


def _share_sql(page, found, every):
    return f"SELECT '{page}' AS page, 'Showing ' || f || ' of ' || t || ' {page} (' || format('{{:.1f}}', CASE WHEN t > 0 THEN f * 100.0::DOUBLE / t ELSE 0 END) || '%)' AS line FROM (SELECT (SELECT count(*) FROM ({found})) AS f, (SELECT count(*) FROM ({every})) AS t)"


@HERE.add(" UNION ALL ".join([_share_sql("resources", _BROWSE_RESOURCES, _RESOURCES), _share_sql("publications", _BROWSE_PAPERS, _PAPERS), _share_sql("code", _BROWSE_CODE, _CODE)]))
def browse_shares(spark, sf_dir):
    pages = (("resources", browse_resources, _resources), ("publications", browse_publications, _papers), ("code", browse_code, _code))
    lines = []
    for page, found, every in pages:
        both = found(spark, sf_dir).agg(F.count("*").alias("f")).crossJoin(every(spark, sf_dir).agg(F.count("*").alias("t")))
        lines.append(both.select(F.lit(page).alias("page"), sinks.share_line(F.col("f"), F.col("t"), page).alias("line")))
    return lines[0].union(lines[1]).union(lines[2])


@HERE.add("SELECT c_mktsegment AS gene, count(*) AS n, count(DISTINCT c_nationkey) AS conditions FROM customer WHERE c_nationkey <> 0 AND c_name ILIKE '%7%' GROUP BY 1")
def browse_cell_lines(spark, sf_dir):
    found = table(spark, sf_dir, "customer").transform(filters.search("7", ["c_name"])).filter(F.col("c_nationkey") != 0)
    return found.groupBy(F.col("c_mktsegment").alias("gene")).agg(F.count("*").alias("n"), F.count_distinct("c_nationkey").alias("conditions"))


@HERE.add("SELECT s::BIGINT AS score, count(*) AS n FROM (SELECT user_id, greatest(0, 10 - count(DISTINCT event_type)) AS s FROM events GROUP BY 1) GROUP BY 1")
def dashboard(spark, sf_dir):
    return compliance.score_report(table(spark, sf_dir, "events"), "user_id", "event_type").groupBy("score").agg(F.count("*").alias("n"))


_REPORT = f"SELECT 0 AS section_no, 'modalities' AS section, p_type AS metric, NULL::DOUBLE AS value, count(*) AS count, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM part), 6) AS pct FROM part GROUP BY p_type UNION ALL SELECT 1, 'levels', l, NULL, count(*), round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) FROM (SELECT {_LEVEL} AS l FROM part) WHERE l <> 'Unknown' GROUP BY l UNION ALL SELECT 2, 'sizes', unnest(['n', 'mean', 'median', 'min', 'max', 'std']), unnest([n, m, d, a, b, s]), 0, NULL FROM (SELECT count(*)::DOUBLE AS n, round(avg(p_size), 6) AS m, median(p_size)::DOUBLE AS d, min(p_size)::DOUBLE AS a, max(p_size)::DOUBLE AS b, round(stddev_pop(p_size), 6) AS s FROM part)"


@HERE.add(_REPORT)
def report_resources(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    share = lambda df: df.select(F.col("label").alias("metric"), F.lit(None).cast("double").alias("value"), F.col("n").alias("count"), F.round("pct", 6).alias("pct"))
    s = stats.numeric_summary(part, F.col("p_size").cast("double"))
    names = ["n", "mean", "median", "min", "max", "std"]
    sizes = s.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.round(F.col(k).cast("double"), 6).alias("value")) for k in names]))).select("metric", "value", F.lit(None).cast("long").alias("count"), F.lit(None).cast("double").alias("pct"))
    return sinks.report([("modalities", share(stats.shares(part, F.col("p_type")))), ("levels", share(stats.shares(part, C.level(F.expr(_NOTE)), "Unknown"))), ("sizes", sizes)])


@HERE.add("SELECT DISTINCT ON (o_orderkey, c_name) o_orderkey, c_name, '' AS \"Keywords\" FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 5) JOIN customer ON o_custkey = c_custkey")
def harvest_pipeline(spark, sf_dir):
    capped = dedup.top_n_per(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 5)
    attached = capped.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return dedup.keep_first(S.conform(attached, ["o_orderkey", "c_name", "Keywords"]), ["o_orderkey", "c_name"], [F.col("o_orderkey")])


@HERE.add(f"SELECT {_IDENT} AS custom_id, text, CASE WHEN length(trim(text)) >= 50 AND turn % 2 = 0 THEN 'got ' || turn ELSE '' END AS summary FROM conversations")
def annotation_pipeline(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("custom_id", C.safe_id(F.expr("'repo_' || conv_id || '_' || turn"))).withColumn("summary", F.lit(""))
    asked = annotate.requests(rows, "conv_id", F.col("turn").cast("string"), "text", "Repository %s: %s", "m")
    answers = asked.join(rows.select("custom_id", "turn"), "custom_id").filter("turn % 2 = 0").selectExpr("custom_id", "'CODE SUMMARY: got ' || turn AS response")
    parsed = annotate.parse_sections(answers, "custom_id", "response").select("custom_id", "summary")
    return annotate.merge_results(rows.select("custom_id", "text", "summary"), parsed, "custom_id", ["summary"])


@HERE.add(f"SELECT {_IDENT} AS custom_id, CASE WHEN length(trim(text)) < 50 THEN '' WHEN turn % 3 = 0 THEN 'YES ' || role WHEN turn % 3 = 1 THEN 'ERROR - errored: busy ' || turn ELSE 'ERROR - expired' END AS biomedical_relevance, CASE WHEN length(trim(text)) >= 50 AND turn % 3 = 0 THEN 'about ' || length('Repository ' || turn || ': ' || substr(text, 1, 8000)) ELSE '' END AS summary FROM conversations")
def annotation_files(spark, sf_dir):
    """The annotation run through its files: requests written, a service's results written for them, those read and merged back."""
    rows = table(spark, sf_dir, "conversations").withColumn("custom_id", C.safe_id(F.expr("'repo_' || conv_id || '_' || turn"))).withColumns({"biomedical_relevance": F.lit(""), "summary": F.lit("")})
    sent, received = scratch(spark), scratch(spark)
    annotate.write_requests(annotate.requests(rows, "conv_id", F.col("turn").cast("string"), "text", "Repository %s: %s", "m"), sent)
    asked = spark.read.schema("custom_id string, params struct<model:string, messages:array<struct<role:string, content:string>>>").json(sent).join(rows.select("custom_id", "turn", "role"), "custom_id")
    answer = "named_struct('type', CASE turn % 3 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'errored' ELSE 'expired' END, 'message', CASE WHEN turn % 3 = 0 THEN named_struct('content', array(named_struct('text', 'Biomedical Relevance: YES ' || role || '\\nCODE SUMMARY: about ' || length(params.messages[0].content)))) END, 'error', CASE WHEN turn % 3 = 1 THEN named_struct('type', 'x', 'message', 'busy ' || turn) END)"
    asked.select("custom_id", F.expr(answer).alias("result")).write.json(received)
    parsed = annotate.parse_results(S.batch_results(spark, received)).select("custom_id", "biomedical_relevance", "summary")
    return annotate.merge_results(rows.select("custom_id", "biomedical_relevance", "summary"), parsed, "custom_id", ["biomedical_relevance", "summary"])


_CONTENT = "SELECT 'https://github.com/g/' || page_id % 500 AS url, string_agg(regexp_extract(url, '[^/]+$'), ' ' ORDER BY page_id) AS content FROM pages WHERE page_id % 3 <> 0 GROUP BY 1"


@HERE.add(f"SELECT u.url, u.abbreviation, coalesce(c_mktsegment, '') AS diseases, coalesce(content, '') AS content, CASE WHEN length(trim(coalesce(content, ''))) >= 50 THEN '' ELSE 'Insufficient Content' END AS issue FROM ({_SKIPS}) u LEFT JOIN customer ON 'S' || c_custkey = u.abbreviation LEFT JOIN ({_CONTENT}) f ON f.url = u.url")
def reprocess_pipeline(spark, sf_dir):
    skipped = log_carry_forward(spark, sf_dir)
    known = table(spark, sf_dir, "customer").select(F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("abbreviation"), F.col("c_mktsegment").alias("diseases"), F.col("c_custkey").alias("at"))
    rows = dedup.lookup(skipped, known, "abbreviation", "diseases", "at").select("url", "abbreviation", "diseases")
    # the content is the names of a repository's files, in order
    files = table(spark, sf_dir, "pages").filter("page_id % 3 <> 0").select(F.expr("'https://github.com/g/' || page_id % 500").alias("url"), "page_id", F.regexp_extract("url", "[^/]+$", 0).alias("name"))
    content = files.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("page_id", "name"))).alias("names")).select("url", F.array_join("names.name", " ").alias("content"))
    enough, short = filters.content_gate(rows.join(content, "url", "left").na.fill("", ["content"]), "content")
    return enough.withColumn("issue", F.lit("")).union(short.withColumnRenamed("Issue Type", "issue"))


@HERE.add("SELECT c_custkey AS \"row\", c_name AS name, NULL::BIGINT AS n FROM customer UNION ALL SELECT -1, 'c_acctbal', count(*) FROM customer")
def envelope_json(spark, sf_dir):
    text = sinks.envelope(table(spark, sf_dir, "customer"), "c_custkey")
    read = F.from_json("value", "metadata array<struct<column:string,row_count:bigint>>, c_name string")
    first = F.get("x.metadata", 0)
    return text.select("row", read.alias("x")).select("row", F.coalesce("x.c_name", first["column"]).alias("name"), first["row_count"].alias("n"))


@HERE.add("SELECT 'total_records' AS field, count(*)::VARCHAR AS value FROM customer UNION ALL SELECT 'column_count', '3' UNION ALL SELECT 'null_counts', '{\"c_custkey\":0,\"c_name\":' || count(*) FILTER (c_custkey % 7 = 0) || ',\"c_acctbal\":0}' FROM customer UNION ALL SELECT c_custkey::VARCHAR, CASE WHEN c_custkey % 7 <> 0 THEN c_name END FROM customer UNION ALL SELECT 'braces', '[0, 0]'")
def envelope_document(spark, sf_dir):
    """The written envelope, read back as text: its metadata, every record, and how many braces and brackets stay open over the whole document."""
    path = scratch(spark)
    sinks.export_envelope(table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("c_name"), "c_acctbal"), path, "c_custkey")
    lines = spark.read.text(path)
    open_ = lambda a, b: (F.sum(F.length("value") - F.length(F.replace("value", F.lit(a), F.lit("")))) - F.sum(F.length("value") - F.length(F.replace("value", F.lit(b), F.lit(""))))).cast("string")
    braces = lines.agg(F.concat(F.lit("["), open_("{", "}"), F.lit(", "), open_("[", "]"), F.lit("]")).alias("value")).select(F.lit("braces").alias("field"), "value")
    head = lines.filter(F.col("value").startswith('{"metadata"')).select(F.get_json_object(F.concat("value", F.lit("]}")), "$.metadata").alias("m"))
    meta = head.select(F.inline(F.array(*[F.struct(F.lit(k).alias("field"), F.get_json_object("m", f"$.{k}").alias("value")) for k in ("total_records", "column_count", "null_counts")])))
    records = lines.filter(F.col("value").startswith('{"c_custkey"')).select(F.from_json(F.regexp_replace("value", ",$", ""), "c_custkey string, c_name string").alias("r")).select("r.c_custkey", "r.c_name")
    return meta.union(records).union(braces)


@HERE.add("SELECT c_custkey, c_name FROM customer")
def export_json_array(spark, sf_dir):
    path = scratch(spark)
    sinks.export(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), path, "json_array", "c_custkey")
    lines = spark.read.text(path).select(F.regexp_replace("value", r"^\[|[,\]]$", "").alias("line"))
    return lines.select(F.from_json("line", "c_custkey bigint, c_name string").alias("x")).select("x.*")


@HERE.add("(SELECT c_custkey AS \"row\", 'Gene: ' || c_mktsegment || E'\\nName: ' || c_name AS value FROM customer ORDER BY c_custkey LIMIT 10) UNION ALL SELECT -1, '... and ' || (count(*) - 10) || ' more' FROM customer")
def digest_head(spark, sf_dir):
    digest = sinks.record_digest([("Gene", F.col("c_mktsegment")), ("Blank", F.lit(" ")), ("Name", F.col("c_name"))])
    return sinks.digest_head(table(spark, sf_dir, "customer"), digest, "c_custkey", 10)


@HERE.add(
    f"SELECT doc_id, concat_ws(E'\\n', CASE WHEN trim(source, {SQL_BLANKS}) <> '' THEN 'Study: ' || source END, 'Authors: ' || concat_ws(', ', source, lang, 'x') || ' et al.', "
    f"CASE WHEN t <> '' THEN 'Abstract: ' || CASE WHEN length(t) > 200 THEN substr(t, 1, 200) || '...' ELSE t END END) AS digest FROM (SELECT *, trim(text, {SQL_BLANKS}) AS t FROM documents)"
)
def record_digests(spark, sf_dir):
    authors = sinks.short_list(F.array("source", "lang", F.lit("x"), F.lit("y")))
    return table(spark, sf_dir, "documents").select("doc_id", sinks.record_digest([("Study", F.col("source")), ("Authors", authors), ("Abstract", C.truncate(F.col("text"), 200))]).alias("digest"))


def _lines(df, name, count="count", pct="pct"):
    return df.select(F.col(name).cast("string").alias("metric"), F.lit(None).cast("double").alias("value"), F.col(count).cast("long").alias("count"), F.round(pct, 6).alias("pct"))


@HERE.add("SELECT 0 AS section_no, 'studies' AS section, source AS metric, NULL::DOUBLE AS value, count(*) AS count, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct FROM documents GROUP BY source UNION ALL SELECT 1, 'completeness', b::VARCHAR, NULL, (SELECT count(*) FROM (SELECT doc_id, ((quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT + 2) / 4.0::DOUBLE * 100 AS p FROM documents LEFT JOIN labels USING (doc_id)) WHERE least(floor(p / 25), 3) = b), NULL FROM (SELECT unnest([0, 1, 2, 3]) AS b)")
def report_publications(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    both = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("pct", C.completeness(*[F.col(c).cast("string") for c in ("lang", "source", "quality", "toxic")]))
    bins = stats.histogram(both, F.col("pct"), [0.0, 25.0, 50.0, 75.0, 100.0]).withColumn("pct", F.lit(None).cast("double"))
    return sinks.report([("studies", _lines(stats.shares(docs, F.col("source")), "label", "n")), ("completeness", _lines(bins, "bin", "n"))])


@HERE.add("SELECT 0 AS section_no, 'components' AS section, component AS metric, NULL::DOUBLE AS value, 0::BIGINT AS count, pct FROM (SELECT kind AS component, round(avg(CASE WHEN contains(coalesce(issues, ''), kind) THEN 0.0 ELSE 1.0 END) * 100, 6) AS pct FROM customer LEFT JOIN (SELECT user_id, string_agg(DISTINCT event_type, '; ') AS issues FROM events GROUP BY user_id) ON c_custkey = user_id, (SELECT unnest(['click', 'error', 'view']) AS kind) GROUP BY kind)")
def report_code(spark, sf_dir):
    issues = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.array_join(F.collect_set("event_type"), "; ").alias("issues"))
    repos = table(spark, sf_dir, "customer").join(issues, "c_custkey", "left")
    parts = compliance.component_completeness(repos, "issues", ["click", "error", "view"]).withColumn("count", F.lit(0))
    return sinks.report([("components", _lines(parts, "component"))])


@HERE.add("SELECT 0 AS section_no, 'genes' AS section, c_mktsegment AS metric, NULL::DOUBLE AS value, count(*) AS count, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct FROM customer GROUP BY 3 UNION ALL SELECT 1, 'conditions', CASE WHEN c_nationkey = 0 THEN 'Control/Wildtype' ELSE c_nationkey::VARCHAR END, NULL, count(*), round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) FROM customer GROUP BY 3")
def report_cell_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "customer")
    kinds = C.condition(F.col("c_nationkey").cast("string"))
    return sinks.report([("genes", _lines(stats.shares(lines, F.col("c_mktsegment")), "label", "n")), ("conditions", _lines(stats.shares(lines, kinds), "label", "n"))])
