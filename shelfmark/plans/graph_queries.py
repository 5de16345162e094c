"""Queries of the shared-feature graph of parts, and of a sparse graph of suppliers and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import graph
from shelfmark.plans import sinks
from shelfmark.plans.book import Book, table
from shelfmark.plans.text_queries import _NOTE

HERE = Book()
FEATURES = ["p_brand", "p_type", "p_size", "absent"]

_NODES = f"SELECT p_name AS node_id, min(p_partkey) AS node_idx, arg_max(p_brand, p_partkey) AS p_brand, arg_max(p_type, p_partkey) AS p_type, arg_max(p_size, p_partkey) AS p_size, arg_max({_NOTE}, p_partkey) AS note FROM part GROUP BY p_name"
_TOKENS = f"SELECT node_id, node_idx, unnest(['p_brand', 'p_type', 'p_size']) AS feature, unnest([p_brand, p_type, p_size::VARCHAR]) AS token FROM ({_NODES})"


def _edges_sql(least: int) -> str:
    return f"SELECT src, dst, count(*) AS weight, string_agg(feature || ': ' || token, '; ' ORDER BY feature) AS shared FROM (SELECT a.node_id AS src, b.node_id AS dst, feature, token FROM ({_TOKENS}) a JOIN ({_TOKENS}) b USING (feature, token) WHERE a.node_idx < b.node_idx) GROUP BY src, dst HAVING count(*) >= {least}"


_EDGES = _edges_sql(2)
_DEGREES = f"SELECT n.node_id, count(e.node_id) AS degree FROM ({_NODES}) n LEFT JOIN (SELECT src AS node_id FROM ({_EDGES}) UNION ALL SELECT dst FROM ({_EDGES})) e ON n.node_id = e.node_id GROUP BY n.node_id"
_REACH = f"WITH RECURSIVE e AS MATERIALIZED (SELECT src AS a, dst AS b FROM ({_EDGES}) UNION SELECT dst, src FROM ({_EDGES})), r AS (SELECT node_id AS a, node_id AS b FROM ({_NODES}) UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS node_id, min(b) AS component FROM r GROUP BY a"


def _graph(spark, sf_dir, least=2):
    part = table(spark, sf_dir, "part").withColumn("note", F.expr(_NOTE)).select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "note")
    node = graph.nodes(part, "p_name", "p_partkey")
    return node, graph.edges(node, FEATURES, ";", least)


@HERE.add(f"SELECT node_id, node_idx, p_brand, p_type, p_size FROM ({_NODES})")
def graph_nodes(spark, sf_dir):
    return _graph(spark, sf_dir)[0].select("node_id", "node_idx", "p_brand", "p_type", "p_size")


@HERE.add(f"SELECT src, dst, weight FROM ({_EDGES})")
def graph_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[1].select("src", "dst", "weight")


@HERE.add(_EDGES)
def graph_edge_details(spark, sf_dir):
    return graph.edge_details(_graph(spark, sf_dir)[1])


@HERE.add(f'SELECT src AS "row", dst AS col, weight FROM ({_EDGES}) UNION ALL SELECT dst, src, weight FROM ({_EDGES})')
def graph_adjacency(spark, sf_dir):
    return graph.adjacency(*_graph(spark, sf_dir))


@HERE.add(f"SELECT split_part(f, ': ', 1) AS feature, count(*) AS n FROM (SELECT unnest(string_split(shared, '; ')) AS f FROM ({_EDGES})) GROUP BY feature ORDER BY n DESC, feature LIMIT 3")
def graph_drivers(spark, sf_dir):
    return graph.drivers(_graph(spark, sf_dir)[1])


@HERE.add(_DEGREES)
def graph_degree(spark, sf_dir):
    return graph.degrees(*_graph(spark, sf_dir))


@HERE.add(f"WITH k AS (SELECT node_id FROM ({_DEGREES}) WHERE degree >= 2) SELECT src, dst, weight FROM ({_EDGES}) WHERE src IN (FROM k) AND dst IN (FROM k)")
def graph_min_degree(spark, sf_dir):
    return graph.min_degree(*_graph(spark, sf_dir), 2)[1].select("src", "dst", "weight")


@HERE.add(_REACH)
def graph_components(spark, sf_dir):
    return graph.components(*_graph(spark, sf_dir))


_STATS = f"SELECT count(*) AS nodes, (sum(degree) / 2)::BIGINT AS edges, round(sum(degree)::DOUBLE / (count(*) * (count(*) - 1)), 6) AS density, round(avg(degree), 6) AS mean_degree, max(degree) AS max_degree, (SELECT count(DISTINCT component) FROM ({_REACH})) AS components FROM ({_DEGREES})"


@HERE.add(_STATS)
def graph_stats(spark, sf_dir):
    return graph.statistics(*_graph(spark, sf_dir)).withColumn("density", F.round("density", 6)).withColumn("mean_degree", F.round("mean_degree", 6))


@HERE.add(f"SELECT node_id, degree FROM ({_DEGREES}) ORDER BY degree DESC, node_id LIMIT 10")
def graph_top_degree(spark, sf_dir):
    return graph.degrees(*_graph(spark, sf_dir)).orderBy(F.desc("degree"), "node_id").limit(10)


@HERE.add(f"SELECT component, count(*) AS size FROM ({_REACH}) GROUP BY component")
def graph_component_sizes(spark, sf_dir):
    return graph.components(*_graph(spark, sf_dir)).groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component")


_GRADE = "CASE WHEN contains(lower(note), 'strong') OR contains(lower(note), 'excellent') THEN 3 WHEN contains(lower(note), 'good') THEN 2 WHEN contains(lower(note), 'fair') THEN 1 WHEN contains(lower(note), 'poor') THEN 0 ELSE 1.5 END::DOUBLE"


@HERE.add(f"SELECT node_id, degree, round(10 + degree * 20.0::DOUBLE / greatest(max(degree) OVER (), 1), 6) AS size, {_GRADE} AS colour FROM ({_DEGREES}) JOIN ({_NODES}) USING (node_id)")
def node_attributes(spark, sf_dir):
    return graph.node_attributes(*_graph(spark, sf_dir), "note").withColumn("size", F.round("size", 6))


@HERE.add(f"SELECT src, dst, 0.5 + least((weight - 1) / 4.0::DOUBLE, 1) * 2.5 AS width FROM ({_EDGES})")
def edge_attributes(spark, sf_dir):
    return _graph(spark, sf_dir)[1].select("src", "dst", (0.5 + F.least((F.col("weight") - 1) / 4.0, F.lit(1.0)) * 2.5).alias("width"))


_PATHS = f"WITH RECURSIVE e AS MATERIALIZED (SELECT src AS a, dst AS b FROM ({_EDGES}) UNION SELECT dst, src FROM ({_EDGES})), n AS MATERIALIZED ({_NODES}), bfs AS (SELECT node_id AS s, node_id AS v, 0 AS d FROM n UNION SELECT s, e.b, d + 1 FROM bfs JOIN e ON v = e.a WHERE d < 12), dist AS MATERIALIZED (SELECT s, v, min(d) AS d FROM bfs GROUP BY s, v), walk AS (SELECT node_id AS s, node_id AS v, 0 AS d, 1.0::DOUBLE AS p FROM n UNION ALL SELECT w.s, dist.v, dist.d, w.p FROM walk w JOIN e ON w.v = e.a JOIN dist ON dist.s = w.s AND dist.v = e.b AND dist.d = w.d + 1), c AS MATERIALIZED (SELECT s, v, d, sum(p) AS p FROM walk GROUP BY s, v, d) SELECT n.node_id, round(coalesce(sum(part), 0) / ((SELECT count(*) FROM n) - 1) / ((SELECT count(*) FROM n) - 2), 6) AS centrality FROM n LEFT JOIN (SELECT x.v AS node_id, x.p * y.p / z.p AS part FROM c x JOIN c y ON x.v = y.s AND x.s <> x.v AND y.v <> y.s AND x.s <> y.v JOIN c z ON z.s = x.s AND z.v = y.v AND z.d = x.d + y.d) q ON q.node_id = n.node_id GROUP BY n.node_id"


@HERE.add(_PATHS)
def graph_betweenness(spark, sf_dir):
    return graph.betweenness(*_graph(spark, sf_dir)).withColumn("centrality", F.round("centrality", 6))


@HERE.add(_edges_sql(1))
def graph_edges_any(spark, sf_dir):
    return graph.edge_details(_graph(spark, sf_dir, 1)[1])


_PLACES = f"SELECT node_id, row_number() OVER (ORDER BY node_idx, node_id) - 1 AS place FROM ({_NODES})"


@HERE.add(f"SELECT a.place // 16 AS row_block, b.place // 16 AS col_block, string_agg(a.place % 16 || ',' || b.place % 16 || ',' || weight, ';' ORDER BY a.place, b.place) AS entries FROM (SELECT src, dst, weight FROM ({_EDGES}) UNION ALL SELECT dst, src, weight FROM ({_EDGES})) JOIN ({_PLACES}) a ON src = a.node_id JOIN ({_PLACES}) b ON dst = b.node_id GROUP BY ALL")
def graph_adjacency_blocks(spark, sf_dir):
    blocks = graph.adjacency_blocks(*_graph(spark, sf_dir), side=16)
    entries = F.transform(F.arrays_zip("rows", "cols", "weights"), lambda e: F.concat_ws(",", e["rows"].cast("string"), e["cols"].cast("string"), e["weights"].cast("string")))
    return blocks.select("row_block", "col_block", F.array_join(entries, ";").alias("entries"))


_SUMMARY = f"""
WITH s AS ({_STATS}), e AS MATERIALIZED ({_EDGES}), d AS ({_DEGREES}),
f AS (SELECT unnest(range(6)) AS "row", unnest(['Nodes (Datasets): ' || nodes, 'Edges (Connections): ' || edges, 'Graph Density: ' || format('{{:.4f}}', density), 'Average Connections per Node: ' || format('{{:.2f}}', mean_degree), 'Maximum Connections: ' || max_degree, 'Connected Components: ' || components]) AS value FROM s)
SELECT 1 AS section, "row", value FROM f
UNION ALL SELECT 2, r - 1, '  ' || node_id || ': ' || degree || ' connections' FROM (SELECT *, row_number() OVER (ORDER BY degree DESC, node_id) AS r FROM d) WHERE r <= 10
UNION ALL SELECT 3, r - 1, src || ' <-> ' || dst || E'\\n  Weight: ' || weight || E'\\n  Shared: ' || shared FROM (SELECT *, row_number() OVER (ORDER BY weight DESC, src, dst) AS r FROM e) WHERE r <= 20
UNION ALL SELECT 4, 0, '... and ' || (count(*) - 20) || ' more connections' FROM e HAVING count(*) > 20
"""


@HERE.add(_SUMMARY)
def graph_text_summary(spark, sf_dir):
    node, edge = _graph(spark, sf_dir)
    return sinks.graph_summary(graph.statistics(node, edge), graph.degrees(node, edge), graph.edge_details(edge))


@HERE.add("WITH n AS (SELECT regexp_extract(url, '^http://([^/.]+)', 1) AS node_id, min(page_id) AS node_idx, arg_max(split_part(url, '/', 4), page_id) AS lang, arg_max(regexp_extract(url, '/([0-9]+)\\?', 1), page_id) AS no FROM pages GROUP BY 1), t AS (SELECT node_id, node_idx, 'lang' AS feature, lang AS token FROM n WHERE length(lang) > 0 UNION ALL SELECT node_id, node_idx, 'no', no FROM n WHERE no <> '') SELECT a.node_id AS src, b.node_id AS dst, count(*) AS weight FROM t a JOIN t b USING (feature, token) WHERE a.node_idx < b.node_idx GROUP BY ALL HAVING count(*) >= 2")
def graph_code_page(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^http://([^/.]+)", 1).alias("repo"), F.split_part("url", F.lit("/"), F.lit(4)).alias("lang"), F.regexp_extract("url", r"/([0-9]+)\?", 1).alias("no"))
    return graph.edges(graph.nodes(pages, "repo", "page_id"), ["lang", "no"], ",").select("src", "dst", "weight")


@HERE.add(f"SELECT n.node_id AS \"row\", coalesce(max(e.weight) FILTER (e.dst = 'small ring'), 0) AS ring, coalesce(max(e.weight) FILTER (e.dst = 'red widget'), 0) AS widget FROM ({_NODES}) n LEFT JOIN (SELECT src, dst, weight FROM ({_EDGES}) UNION ALL SELECT dst, src, weight FROM ({_EDGES})) e ON n.node_id = e.src GROUP BY n.node_id")
def graph_adjacency_matrix(spark, sf_dir):
    dense = graph.adjacency_matrix(*_graph(spark, sf_dir))
    return dense.select("row", F.col("small ring").cast("long").alias("ring"), F.col("red widget").cast("long").alias("widget"))


@HERE.add("WITH n AS (SELECT source || ' - ' || lang AS node_id, min(doc_id) AS node_idx, arg_max(source, doc_id) AS study, arg_max(lang, doc_id) AS disease, arg_max(n_chars % 7, doc_id)::VARCHAR AS kind FROM documents GROUP BY 1), t AS (SELECT node_id, node_idx, unnest(['study', 'disease', 'kind']) AS feature, unnest([study, disease, kind]) AS token FROM n) SELECT a.node_id AS src, b.node_id AS dst, count(*) AS weight FROM t a JOIN t b USING (feature, token) WHERE a.node_idx < b.node_idx GROUP BY ALL HAVING count(*) >= 2")
def graph_publication_page(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" - ", "source", "lang").alias("name"), F.col("source").alias("study"), F.col("lang").alias("disease"), (F.col("n_chars") % 7).cast("string").alias("kind"))
    return graph.edges(graph.nodes(docs, "name", "doc_id"), ["study", "disease", "kind"]).select("src", "dst", "weight")
