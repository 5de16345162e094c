"""Queries of text columns, filters and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import columns as C
from shelfmark.functions import values
from shelfmark.operators import dedup, filters, harvest, stats
from shelfmark.plans.book import Book, table

HERE = Book()

#: What ``columns.strip`` takes off, as DuckDB's trim wants it (its E'' strings have no \v: that is the letter v).
SQL_BLANKS = "'" + "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "'"


def sql_list(items) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


@HERE.add("SELECT value, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS value FROM part WHERE p_name ILIKE '%r%' AND contains(p_type, 'ECONOMY')) WHERE value <> '' GROUP BY value ORDER BY n DESC, value LIMIT 5")
def search_filter_topk(spark, sf_dir):
    found = table(spark, sf_dir, "part").transform(filters.search("R", ["p_name"])).transform(filters.filter_by({"p_type": ["ECONOMY"]}))
    return stats.top_k(stats.exploded(found, "p_name", " "), F.col("value"), 5)


@HERE.add("SELECT * FROM customer WHERE c_custkey::VARCHAR ILIKE '%91%' OR c_name ILIKE '%91%' OR c_nationkey::VARCHAR ILIKE '%91%' OR c_acctbal::VARCHAR ILIKE '%91%' OR c_mktsegment ILIKE '%91%'")
def keyword_search_all_columns(spark, sf_dir):
    return table(spark, sf_dir, "customer").transform(filters.search("91"))


@HERE.add("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring') OR contains(p_name, 'red')")
def filter_any_substring(spark, sf_dir):
    return table(spark, sf_dir, "part").transform(filters.filter_by({"p_name": ["ring", "red"], "absent": ["x"]})).select("p_partkey", "p_name")


@HERE.add("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (1, 5, 7)")
def filter_isin(spark, sf_dir):
    return table(spark, sf_dir, "supplier").filter(F.col("s_nationkey").isin(1, 5, 7)).select("s_suppkey", "s_nationkey")


@HERE.add("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal >= 5000")
def filter_min_score(spark, sf_dir):
    return table(spark, sf_dir, "supplier").filter(F.col("s_acctbal") >= 5000).select("s_suppkey", "s_acctbal")


@HERE.add("SELECT doc_id FROM documents WHERE contains(upper(text), 'YES') OR contains(upper(text), 'UNCLEAR')")
def relevance_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(filters.relevant(F.col("text"), ["YES", "UNCLEAR"])).select("doc_id")


@HERE.add("SELECT doc_id, length(trim(coalesce(text, ''), E' \\t\\n\\r\\f\\v')) >= 50 AS enough FROM documents")
def content_gate(spark, sf_dir):
    kept, dropped = filters.content_gate(table(spark, sf_dir, "documents"), "text")
    return kept.select("doc_id", F.lit(True).alias("enough")).union(dropped.select("doc_id", F.lit(False)))


@HERE.add("SELECT DISTINCT unnest(string_split_regex(p_name, '[ ,]')) AS value FROM part ORDER BY value")
def distinct_delimited_values(spark, sf_dir):
    return stats.distinct_values(table(spark, sf_dir, "part"), "p_name", " ,")


_MIXED = "p_name || ' (' || p_brand || ', ' || lower(p_brand) || '); ' || upper(p_type) || ';' || p_type || '; ' || p_name"


def _mixed(spark, sf_dir):
    return table(spark, sf_dir, "part").withColumn("field", F.expr(_MIXED))


@HERE.add("SELECT p_partkey, array_to_string(list_sort(list_distinct([p_name, p_brand, upper(p_type)])), ';') AS field FROM part")
def normalize_list_field(spark, sf_dir):
    return _mixed(spark, sf_dir).select("p_partkey", C.normalize_list(F.col("field")).alias("field"))


@HERE.add("SELECT p_partkey, array_to_string([p_name, p_brand, lower(p_brand), upper(p_type), p_type, p_name], '|') AS items FROM part")
def paren_expand(spark, sf_dir):
    return _mixed(spark, sf_dir).select("p_partkey", F.array_join(C.expand_parens(C.split_list(F.col("field"))), "|").alias("items"))


@HERE.add(f"SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda x: length(x) > 2 AND lower(x) NOT IN ({sql_list(values.LINK_STOPWORDS)})), '|') AS items FROM part")
def strip_stopwords(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(C.link_tokens(F.col("p_name"), " ", True), "|").alias("items"))


@HERE.add("SELECT word, CASE WHEN kind = 0 THEN nfc_normalize(word) ELSE 'file' || c || chr(39) || 's' END AS folded FROM (SELECT DISTINCT word, kind, c FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS word, 0 AS kind, NULL AS c FROM documents UNION ALL SELECT '\uFB01le' || c_custkey || '\u2019s\u00A0', 1, c_custkey FROM customer) WHERE regexp_matches(word, '[^\\x00-\\x7F]'))")
def unicode_fold(spark, sf_dir):
    made = table(spark, sf_dir, "customer").select(F.concat(F.lit("\uFB01le"), F.col("c_custkey").cast("string"), F.lit("\u2019s\u00A0")))
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"\s+")).alias("word")).union(made).filter(F.col("word").rlike(r"[^\x00-\x7F]")).distinct()
    return words.select("word", C.strip(C.plain_apostrophes(C.nfkc(F.col("word")))).alias("folded"))


@HERE.add("SELECT page_id, regexp_replace(replace(url, 'http://', 'PMCPMC12'), 'PMCPMC([0-9]+)', 'PMC\\1') AS link FROM pages")
def fix_link(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.fix_pmc_link(F.replace("url", F.lit("http://"), F.lit("PMCPMC12"))).alias("link"))


@HERE.add("SELECT page_id, string_split(url, '/')[-1] AS name FROM pages")
def url_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.last_segment(F.col("url")).alias("name"))


@HERE.add("SELECT page_id, regexp_extract(u, 'github\\.com/([^/]+)/([^/]+)', 1) AS owner, regexp_extract(u, 'github\\.com/([^/]+)/([^/]+)', 2) AS repo FROM (SELECT page_id, regexp_replace(url, '^http://[^/]+', 'https://github.com') AS u FROM pages)")
def url_owner_repo(spark, sf_dir):
    owner, repo = C.owner_repo(F.regexp_replace("url", "^http://[^/]+", "https://github.com"))
    return table(spark, sf_dir, "pages").select("page_id", owner.alias("owner"), repo.alias("repo"))


@HERE.add("SELECT page_id, regexp_replace(replace(url, 'page=', 'api_key='), 'api_key=[^&\\s]+', 'api_key=***', 'g') AS url FROM pages")
def mask_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.mask_key(F.replace("url", F.lit("page="), F.lit("api_key="))).alias("url"))


@HERE.add("SELECT page_id, substr(regexp_replace('repo_' || page_id || '_' || url, '[^a-zA-Z0-9_-]', '_', 'g'), 1, 64) AS ident FROM pages")
def safe_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.safe_id(F.concat(F.lit("repo_"), F.col("page_id").cast("string"), F.lit("_"), F.col("url"))).alias("ident"))


@HERE.add("SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.clean_text(F.col("text")).alias("text"))


@HERE.add("SELECT page_id, replace(url_encode(url), '%2F', '/') AS url FROM pages")
def url_encode_expr(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.url_encode(F.col("url")).alias("url"))


@HERE.add("SELECT c_custkey, c_mktsegment || ' Ann B; ' || c_name || ' Eve' AS names FROM customer")
def rotate_names(spark, sf_dir):
    names = F.concat(F.lit("Ann B "), F.col("c_mktsegment"), F.lit("; Eve "), F.col("c_name"), F.lit("; Ann B "), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", C.rotate_names(names).alias("names"))


@HERE.add("SELECT doc_id, ((trim(coalesce(lang, '')) <> '')::INT + (trim(coalesce(source, '')) <> '')::INT + (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT) / 4.0::DOUBLE * 100 AS pct FROM documents LEFT JOIN labels USING (doc_id)")
def row_completeness(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return both.select("doc_id", C.completeness(*[F.col(c).cast("string") for c in ("lang", "source", "quality", "toxic")]).alias("pct"))


@HERE.add("SELECT count(*) AS n, count(quality) AS with_quality, count(toxic) AS with_toxic, round(count(quality) * 100.0::DOUBLE / count(*), 6) AS pct_quality FROM documents LEFT JOIN labels USING (doc_id)")
def availability_counts(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return both.agg(F.count("*").alias("n"), F.count("quality").alias("with_quality"), F.count("toxic").alias("with_toxic"), F.round(F.count("quality") * 100.0 / F.count("*"), 6).alias("pct_quality"))


@HERE.add(f"SELECT doc_id, CASE WHEN length(t) > 200 THEN substr(t, 1, 200) || '...' ELSE t END AS text FROM (SELECT doc_id, trim(text, {SQL_BLANKS}) AS t FROM documents)")
def truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.truncate(F.col("text"), 200).alias("text"))


@HERE.add("SELECT doc_id, length(text) // 4 <= 500 AS fits, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '...' ELSE text END AS text FROM documents")
def token_budget(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.within_tokens(F.col("text"), 500).alias("fits"), C.truncate_tokens(F.col("text"), 500).alias("text"))


@HERE.add("SELECT doc_id, 'Source: ' || source || E'\\nLanguage: ' || lang || E'\\nText: ' || substr(text, 1, 200) AS digest FROM documents")
def digest_lines(spark, sf_dir):
    lines = [F.concat(F.lit(label), F.col(c)) for label, c in (("Source: ", "source"), ("Language: ", "lang"))]
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", *lines, F.concat(F.lit("Text: "), F.substring("text", 1, 200))).alias("digest"))


@HERE.add("SELECT doc_id, 'Describe ' || source || ': ' || substr(text, 1, 8000) AS prompt FROM documents")
def prompt_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.prompt("Describe %s: %s", F.col("source"), F.col("text")).alias("prompt"))


_SIZES = "concat(p_size, ',', 100 + p_size, ' participants, ', p_brand)"


@HERE.add(f"SELECT p_partkey, try_cast(replace(regexp_extract({_SIZES}, '([0-9,]+)', 1), ',', '') AS DOUBLE) AS n FROM part")
def first_number(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.first_number(F.expr(_SIZES)).alias("n"))


_NOTE = "CASE p_size % 6 WHEN 0 THEN 'Excellent: strong' WHEN 1 THEN 'strong FAIR' WHEN 2 THEN 'Good FAIR' WHEN 3 THEN 'limited FAIR' WHEN 4 THEN 'poor' ELSE 'none' END"
_LEVEL = f"CASE WHEN lower({_NOTE}) LIKE '%excellent%' THEN 'Excellent' WHEN lower({_NOTE}) LIKE '%strong%' THEN 'Strong' WHEN lower({_NOTE}) LIKE '%good%' THEN 'Good' ELSE 'Unknown' END"


@HERE.add(f"SELECT p_partkey, {_LEVEL} AS level FROM part")
def level_classify(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.level(F.expr(_NOTE)).alias("level"))


@HERE.add("SELECT p_partkey, [3.0, 3.0, 2.0, 1.0, 0.0, 1.5][p_size % 6 + 1]::DOUBLE AS grade FROM part")
def grade_classify(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.grade(F.expr(_NOTE)).alias("grade"))


@HERE.add(f"SELECT level AS label, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct FROM (SELECT {_LEVEL} AS level FROM part) WHERE level <> 'Unknown' GROUP BY level")
def level_distribution(spark, sf_dir):
    return stats.shares(table(spark, sf_dir, "part"), C.level(F.expr(_NOTE)), "Unknown").withColumn("pct", F.round("pct", 6))


@HERE.add("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'Control/Wildtype' ELSE o_orderstatus END AS condition FROM orders")
def recode_value(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", C.condition(F.col("o_orderstatus"), "P").alias("condition"))


@HERE.add("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Python' WHEN 1 THEN 'JavaScript' WHEN 2 THEN 'C++' ELSE 'Perl' END AS tool FROM part")
def alias_group(spark, sf_dir):
    alias = F.expr("CASE p_size % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'js' WHEN 2 THEN 'cpp' ELSE 'Perl' END")
    return table(spark, sf_dir, "part").select("p_partkey", C.group_alias(alias, values.TOOLING_GROUPS).alias("tool"))


@HERE.add("SELECT p_partkey, 'clinical, genetics, ' || p_type AS terms FROM part")
def vocab_cleanup(spark, sf_dir):
    raw = F.concat(F.lit("['Clinical', 'omics', 'Genomics', 'genetic', '"), F.col("p_type"), F.lit("']"))
    return table(spark, sf_dir, "part").select("p_partkey", C.clean_vocabulary(raw).alias("terms"))


@HERE.add("SELECT p_partkey AS key, p_name AS resource, p_type AS kind FROM part")
def rename_columns(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type").withColumnsRenamed({"p_partkey": "key", "p_name": "resource", "p_type": "kind"})


@HERE.add("SELECT p_partkey, p_type || ', Rush Alzheimer''s Disease Center, Chicago, Illinois; Mayo Clinic, Rochester, Minnesota' AS place FROM part")
def affiliation_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.normalize_affiliation(F.concat("p_type", F.lit(", Rush Alzheimer's Disease Center, Chicago, IL; Mayo Clinic, Rochester, MN"))).alias("place"))


@HERE.add("SELECT value, count(*) AS n FROM (SELECT unnest(string_split_regex(p_type || ';' || p_brand || ', ' || p_type, '[;,]')) AS v, trim(v) AS value FROM part) GROUP BY value")
def language_list(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("field", F.expr("p_type || ';' || p_brand || ', ' || p_type"))
    return stats.exploded(rows, "field", ";,").groupBy("value").agg(F.count("*").alias("n"))


_DATES = "(2023/01/02:2026/01/01[Date - Publication])"
_DEFAULTS = " OR ".join(f'"{k}"[All Fields]' for k in values.DISEASE_KEYWORDS[:5])
_STUDIES = "SELECT n_nationkey, n_name || ' (cohort)' AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'map' ELSE 'N' || n_nationkey END AS abbr, CASE WHEN n_nationkey % 2 = 0 THEN 'Dementia; Flu; Brain ' || r_name ELSE r_name END AS diseases, 'a, ' || r_name || ' b' AS modalities FROM nation JOIN region ON n_regionkey = r_regionkey"
_D1 = f"CASE WHEN n_nationkey % 2 = 0 THEN '\"dementia\"[All Fields] OR \"' || lower(string_split(diseases, '; ')[3]) || '\"[All Fields]' ELSE '{_DEFAULTS}' END"
_M1 = "'(\"a\"[All Fields] OR \"' || substr(modalities, 4) || '\"[All Fields])'"
_N2 = "'(\"' || substr(name, 1, length(name) - 9) || '\"[tiab]' || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE ' OR \"' || abbr || '\"[tiab]' END || ')'"


def _studies(spark, sf_dir):
    both = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.selectExpr("n_nationkey", "n_name || ' (cohort)' AS name", "CASE WHEN n_nationkey % 3 = 0 THEN 'map' ELSE 'N' || n_nationkey END AS abbr", "CASE WHEN n_nationkey % 2 = 0 THEN 'Dementia; Flu; Brain ' || r_name ELSE r_name END AS diseases", "'a, ' || r_name || ' b' AS modalities", "date'2026-01-01' AS as_of")


@HERE.add(f"SELECT n_nationkey, '(\"' || name || '\"[All Fields] OR \"' || abbr || '\"[All Fields]) AND (' || {_D1} || ') AND {_DATES} AND ' || {_M1} AS search FROM ({_STUDIES})")
def search_expr_v1(spark, sf_dir):
    return _studies(spark, sf_dir).select("n_nationkey", harvest.search_v1(*map(F.col, ("name", "abbr", "diseases", "modalities", "as_of"))).alias("search"))


@HERE.add(f"SELECT n_nationkey, {_N2} || ' AND {_DATES}' AS search FROM ({_STUDIES})")
def search_expr_v2(spark, sf_dir):
    return _studies(spark, sf_dir).select("n_nationkey", harvest.search_v2(*map(F.col, ("name", "abbr", "as_of"))).alias("search"))


@HERE.add(f"SELECT n_nationkey, {_N2} || ' AND (' || {_D1} || ') AND {_DATES} AND ' || {_M1} AS search FROM ({_STUDIES})")
def search_expr_v3(spark, sf_dir):
    return _studies(spark, sf_dir).select("n_nationkey", harvest.search_v3(*map(F.col, ("name", "abbr", "diseases", "modalities", "as_of"))).alias("search"))


@HERE.add(f"SELECT n_nationkey, 'a,' || substr(modalities, 4) || ',x,y' AS modalities FROM ({_STUDIES})")
def search_modalities(spark, sf_dir):
    return _studies(spark, sf_dir).select("n_nationkey", harvest.search_modalities(F.col("modalities"), F.lit("x; y")).alias("modalities"))


@HERE.add("SELECT DISTINCT doc_id, item_id FROM documents JOIN benchmark ON contains(lower(documents.text), lower(benchmark.text))")
def corpus_match(spark, sf_dir):
    return harvest.corpus_match(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


_CORPUS = "SELECT doc_id, lower(text) AS t, DATE '2022-01-01' + (doc_id * 7 % 1500)::INT AS day FROM documents"
_PHRASES = "SELECT item_id, 'names' AS grp, lower(array_to_string(string_split(text, ' ')[2:3], ' ')) AS phrase FROM benchmark UNION SELECT item_id, 'names', lower(string_split(text, ' ')[5]) FROM benchmark UNION SELECT item_id, 'words', w FROM benchmark, (SELECT unnest(['the', 'der', 'les dans']) AS w) WHERE item_id % 2 = 0"


@HERE.add(f"WITH d AS ({_CORPUS}), p AS (SELECT * FROM ({_PHRASES}) WHERE phrase <> ''), a AS (SELECT item_id, count(DISTINCT grp) AS asked FROM p GROUP BY 1) SELECT doc_id, p.item_id FROM d JOIN p ON contains(t, phrase) JOIN a ON a.item_id = p.item_id WHERE day BETWEEN DATE '2025-06-30' - 1095 AND DATE '2025-06-30' GROUP BY doc_id, p.item_id, asked HAVING count(DISTINCT grp) = asked")
def corpus_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("day", F.expr("date_add(DATE '2022-01-01', int(doc_id * 7 % 1500))"))
    words = F.split("text", " ")
    groups = {
        "names": F.array(F.array_join(F.slice(words, 2, 2), " "), F.coalesce(F.get(words, 4), F.lit(""))),
        "words": F.when(F.col("item_id") % 2 == 0, F.array(*map(F.lit, ("the", "der", "les dans")))).otherwise(F.array().cast("array<string>")),
    }
    return harvest.corpus_search(docs, "doc_id", "text", "day", table(spark, sf_dir, "benchmark"), "item_id", groups, F.lit("2025-06-30").cast("date"))


_TOPIC = "CASE doc_id % 5 WHEN 0 THEN ' Dementia care' WHEN 1 THEN ' PARKINSON' WHEN 2 THEN ' the brain' WHEN 3 THEN ' tremor' ELSE '' END"
_COHORT = (
    "item_id",
    "w2 || ' ' || w3 || CASE WHEN item_id % 2 = 0 THEN ' (cohort)' ELSE '' END AS name",
    "CASE item_id % 3 WHEN 0 THEN 'map' WHEN 1 THEN w5 ELSE '' END AS abbr",
    "CASE WHEN item_id % 4 = 0 THEN w4 ELSE 'Dementia; ' || w4 || '; the BRAIN' END AS diseases",
    "w6 || ', ' || w7 || ',x,y,z, ' || w8 AS modalities",
)
_CASES = {
    "names1": "list_filter([name, CASE WHEN abbr <> name THEN abbr END], lambda x: x <> '')",
    "names2": f"list_filter([trim(regexp_replace(name, '\\s*\\([^)]*\\)\\s*$', '')), CASE WHEN trim(abbr) <> name AND lower(trim(abbr)) NOT IN ({sql_list(values.NOISY_ABBREVIATIONS)}) THEN trim(abbr) END], lambda x: x <> '')",
    "diseases": f"CASE WHEN len(list_filter(string_split(lower(diseases), '; '), lambda d: len(list_filter([{sql_list(values.DISEASE_KEYWORDS)}], lambda k: contains(d, k))) > 0)) > 0 THEN list_filter(string_split(lower(diseases), '; '), lambda d: len(list_filter([{sql_list(values.DISEASE_KEYWORDS)}], lambda k: contains(d, k))) > 0) ELSE [{sql_list(values.DISEASE_KEYWORDS[:5])}] END",
    "modalities": "list_filter(list_transform(string_split(modalities, ','), lambda m: trim(m)), lambda m: m <> '')[1:5]",
}


def _criteria_sql(version):
    asked = {1: ("names1", "diseases", "modalities"), 2: ("names2",), 3: ("names2", "diseases", "modalities")}[version]
    words = ", ".join(f"string_split(translate(text, chr(10), ' '), ' ')[{i}] AS w{i}" for i in range(2, 9))
    phrases = " UNION ".join(f"SELECT item_id, '{g}' AS grp, lower(unnest({_CASES[g]})) AS phrase FROM s" for g in asked)
    return f"WITH d AS (SELECT doc_id, lower(text || {_TOPIC}) AS t, DATE '2022-01-01' + (doc_id * 7 % 1500)::INT AS day FROM documents), s AS (SELECT {', '.join(_COHORT)} FROM (SELECT item_id, {words} FROM benchmark)), p AS (SELECT * FROM ({phrases}) WHERE phrase <> ''), a AS (SELECT item_id, count(DISTINCT grp) AS asked FROM p GROUP BY 1) SELECT doc_id, p.item_id FROM d JOIN p ON contains(t, phrase) JOIN a ON a.item_id = p.item_id WHERE day BETWEEN DATE '2025-06-30' - 1095 AND DATE '2025-06-30' GROUP BY doc_id, p.item_id, asked HAVING count(DISTINCT grp) = asked"


def _criteria(spark, sf_dir, version):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(f"text || {_TOPIC}").alias("text"), F.expr("date_add(DATE '2022-01-01', int(doc_id * 7 % 1500))").alias("day"))
    words = [f"split(translate(text, chr(10), ' '), ' ')[{i - 1}] AS w{i}" for i in range(2, 9)]
    studies = table(spark, sf_dir, "benchmark").selectExpr("item_id", *words).selectExpr(*_COHORT)
    return harvest.criteria_search(version, docs, "doc_id", "text", "day", studies, "item_id", "name", "abbr", "diseases", "modalities", F.lit("2025-06-30").cast("date"))


@HERE.add(_criteria_sql(1))
def corpus_criteria_v1(spark, sf_dir):
    return _criteria(spark, sf_dir, 1)


@HERE.add(_criteria_sql(2))
def corpus_criteria_v2(spark, sf_dir):
    return _criteria(spark, sf_dir, 2)


@HERE.add(_criteria_sql(3))
def corpus_criteria_v3(spark, sf_dir):
    return _criteria(spark, sf_dir, 3)


@HERE.add("SELECT p_partkey, array_to_string(list_sort(list_distinct(['Fibrosis' || p_size, 'A1', p_brand || ' x', p_name || chr(39) || 's'])), ';') AS folded FROM part")
def normalize_compatible(spark, sf_dir):
    text = F.concat(F.lit("\uFB01brosis"), F.col("p_size").cast("string"), F.lit("; Fibrosis"), F.col("p_size").cast("string"), F.lit("; \uFF21\uFF11;A1; "), F.col("p_brand"), F.lit("\u00A0x;"), F.col("p_name"), F.lit("\u2019s;"), F.col("p_name"), F.lit("'s"))
    # the first spelling is kept, so the ligature comes second here
    text = F.concat(F.lit("Fibrosis"), F.col("p_size").cast("string"), F.lit(";"), text)
    return table(spark, sf_dir, "part").select("p_partkey", C.normalize_list(text).alias("folded"))


@HERE.add("SELECT doc_id, source || ' - ' || substr(text, 1, 50) AS ident FROM documents")
def publication_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.publication_id(F.col("source"), F.col("text")).alias("ident"))


@HERE.add("SELECT o_orderstatus AS value, count(*) AS n FROM orders WHERE trim(o_orderstatus) <> '' AND o_orderstatus <> 'P' GROUP BY o_orderstatus")
def blank_and_coded_values(spark, sf_dir):
    kept = table(spark, sf_dir, "orders").filter(C.filled(F.col("o_orderstatus")) & (F.col("o_orderstatus") != "P"))
    return kept.groupBy(F.col("o_orderstatus").alias("value")).agg(F.count("*").alias("n"))


@HERE.add("SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer")
def sort_values(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return dedup.numbered(rows, [F.desc("c_acctbal"), F.col("c_custkey")]).drop("c_acctbal")


@HERE.add("SELECT page_id, array_to_string(regexp_extract_all('[''' || url || ''', ''https://x.org'']', '''([^'']*)''', 1), '|') AS urls FROM pages")
def list_literal(spark, sf_dir):
    raw = F.concat(F.lit("['"), F.col("url"), F.lit("', 'https://x.org']"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(C.literal_list(raw), "|").alias("urls"))


@HERE.add("SELECT page_id, url, unnest([url, url || '#' || page_id % 3]) AS alternative FROM pages WHERE page_id % 5 <> 0 UNION ALL SELECT page_id, url, NULL FROM pages WHERE page_id % 5 = 0")
def list_literal_explode(spark, sf_dir):
    raw = F.expr("CASE WHEN page_id % 5 <> 0 THEN concat('[''', url, ''', ''', url, '#', page_id % 3, ''']') END")
    return table(spark, sf_dir, "pages").select("page_id", "url", F.explode_outer(C.literal_list(raw)).alias("alternative"))


@HERE.add("SELECT page_id FROM pages WHERE NOT contains(html, string_split(url, '/')[-1])")
def url_containment_violations(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter(~F.col("html").contains(C.last_segment(F.col("url")))).select("page_id")


_PATH = "regexp_replace(regexp_replace(url, '^http://', ''), '[?].*$', '') || CASE page_id % 5 WHEN 0 THEN '/README.md' WHEN 1 THEN '/a.ipynb' WHEN 2 THEN '/x.py' WHEN 3 THEN '/dist/x.py' ELSE '' END"


@HERE.add(f"SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'readme' WHEN 1 THEN 'notebook' WHEN 2 THEN 'code' ELSE 'other' END AS kind, len(string_split({_PATH}, '/')) - 1 AS depth FROM pages WHERE page_id % 5 <> 3")
def extension_class(spark, sf_dir):
    files = table(spark, sf_dir, "pages").withColumn("path", F.expr(_PATH)).filter(~C.in_skipped_folder(F.col("path")))
    return files.select("page_id", C.file_class(F.col("path")).alias("kind"), C.path_depth(F.col("path")).alias("depth"))


@HERE.add("SELECT conv_id, turn, CASE WHEN length(text) % 12 BETWEEN 1 AND 10 THEN (length(text) % 12)::VARCHAR ELSE 'N/A' END AS score FROM conversations")
def parse_score_text(spark, sf_dir):
    raw = F.concat(F.lit(" "), (F.length("text") % 12).cast("string"), F.lit(" "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.score_text(raw).alias("score"))
