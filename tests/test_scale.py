"""Operators that have to hold at size, against brute force on rows that strain them."""

import itertools
import json
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.functions import columns as C
from shelfmark.operators import dedup, graph, harvest, stats
from shelfmark.plans import sinks
from shelfmark.sources import tables as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fixed_rounds_as_python_does(spark):
    random.seed(1)
    numbers = [0.15, 0.25, 0.05, 2.5, 0.35, 99.95, 100.0, 0.0, 1234567.85, -0.15, -2.25, 1e-9, 3 / 2000 * 100] + [random.randint(0, 4000) / random.choice([2000, 400, 16, 7]) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    for places in (1, 2, 4):
        assert [r.t for r in df.select(C.fixed(F.col("x"), places).alias("t")).collect()] == [f"{x:.{places}f}" for x in numbers]


def test_phrases_in_one_automaton_and_in_many(spark):
    random.seed(2)
    letters = "abé ½-"
    texts = [(i, "".join(random.choices(letters, k=random.randint(0, 60)))) for i in range(200)] + [(5, "again abé"), (900, None), (901, "ABÉ")]
    phrases = [(i, "".join(random.choices(letters, k=random.randint(0, 4)))) for i in range(150)] + [(7, "ABÉ"), (8, None), (9, "abé"), (9, "ABÉ")]
    docs = spark.createDataFrame(texts, "doc long, text string")
    items = spark.createDataFrame(phrases, "ident long, phrase string")
    want = sorted({(d, i) for d, t in texts if t is not None for i, p in phrases if p is not None and p.lower() in t.lower()})
    for most in (2_000_000, 500):
        found = harvest.corpus_match(docs, "doc", "text", items, "ident", "phrase", most)
        assert sorted(map(tuple, found.collect())) == want
        assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    assert harvest.corpus_match(docs, "doc", "text", items.filter("false"), "ident", "phrase").count() == 0
    assert harvest.corpus_match(docs.filter("false"), "doc", "text", items, "ident", "phrase").count() == 0


def test_phrases_of_a_size(spark):
    """The phrases of ten thousand names take one walk; the plan holds no join of texts with phrases."""
    docs = spark.range(2000).selectExpr("id AS doc", "concat('study number ', id, ' of the north') AS text")
    items = spark.range(10_000).selectExpr("id AS ident", "concat('number ', id, ' of') AS phrase")
    found = harvest.corpus_match(docs, "doc", "text", items, "ident", "phrase", 50_000)
    assert sorted(map(tuple, found.collect())) == [(i, i) for i in range(2000)]
    assert "Join" not in plan(found)


def graph_of(spark, pairs, nodes):
    node = spark.createDataFrame([(f"n{i:06d}", i) for i in nodes], "node_id string, node_idx long")
    edge = spark.createDataFrame([(f"n{a:06d}", f"n{b:06d}", 1) for a, b in pairs], "src string, dst string, weight int")
    return node, edge


def roots(pairs, nodes):
    parent = {i: i for i in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    return {i: root(i) for i in nodes}


@pytest.mark.parametrize("hub_rows", [5, 10_000])
def test_components_of_hubs_paths_and_rings(spark, hub_rows):
    random.seed(3)
    pairs = [(900, i) for i in range(300)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2001), (2001, 2002), (2002, 2000), (2000, 2000)]
    pairs += [(random.randint(3000, 3400), random.randint(3000, 3400)) for _ in range(180)] + [(17, 900), (900, 17)]
    nodes = sorted({x for p in pairs for x in p} | {5000})
    want = {f"n{i:06d}": f"n{r:06d}" for i, r in roots(pairs, nodes).items()}
    assert {r.node_id: r.component for r in graph.components(*graph_of(spark, pairs, nodes), hub_rows).collect()} == want
    alone = graph.components(*graph_of(spark, [(1, 1)], [1, 2])).collect()
    assert sorted((r.node_id, r.component) for r in alone) == [("n000001", "n000001"), ("n000002", "n000002")]


def test_a_hub_is_in_no_key(spark):
    """A star whose centre has the largest name: its edges are looked up by broadcast, and the result is one component."""
    pairs = [(99_999, i) for i in range(20_000)]
    node, edge = graph_of(spark, pairs, [*range(20_000), 99_999])
    found = graph.components(node, edge, 1000)
    assert found.select("component").distinct().count() == 1 and found.count() == 20_001


def paths_by_hand(pairs, nodes, sources=None):
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    total = dict.fromkeys(nodes, 0.0)
    for s in sources or nodes:
        level, paths, order, at = {s: 0}, {s: 1.0}, [s], 0
        while at < len(order):
            v = order[at]
            at += 1
            for w in near[v]:
                if w not in level:
                    level[w], paths[w] = level[v] + 1, 0.0
                    order.append(w)
                if level[w] == level[v] + 1:
                    paths[w] += paths[v]
        owed = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if level[v] == level[w] - 1:
                    owed[v] += paths[v] / paths[w] * (1 + owed[w])
            if w != s:
                total[w] += owed[w]
    n = len(nodes)
    return {v: x * n / len(sources or nodes) / ((n - 1) * (n - 2)) for v, x in total.items()}


def test_betweenness_exact_in_batches_and_sampled_within_its_error(spark):
    random.seed(4)
    nodes = list(range(120))
    pairs = sorted({tuple(sorted(random.sample(nodes, 2))) for _ in range(150)} | {(0, i) for i in range(1, 40)})
    want = paths_by_hand(pairs, nodes)
    node, edge = graph_of(spark, pairs, nodes)
    for options in ({}, {"state_rows": 5000}):
        got = {int(r.node_id[1:]): r.centrality for r in graph.betweenness(node, edge, **options).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[v], want[v], abs_tol=1e-9) for v in nodes)
    assert graph.pivots_for(120, 0.2, 0.9) < 120
    sampled = {int(r.node_id[1:]): r.centrality for r in graph.betweenness(node, edge, exact_nodes=50, error=0.2).collect()}
    errors = [abs(sampled[v] - want[v]) for v in nodes]
    assert 0 < max(errors) <= 0.2, max(errors)
    some = [3, 5, 9]
    chosen = {int(r.node_id[1:]): r.centrality for r in graph.betweenness(node, edge, node.filter("node_idx in (3, 5, 9)")).collect()}
    by_hand = paths_by_hand(pairs, nodes, some)
    assert all(math.isclose(chosen[v], by_hand[v], abs_tol=1e-9) for v in nodes)


def test_edges_of_hot_tokens_and_wide_nodes(spark):
    random.seed(5)
    rows = [(f"n{i:03d}", i, ";".join({"hot", *(f"a{random.randint(0, 30)}" for _ in range(random.randint(0, 9)))}), f"b{random.randint(0, 12)}; warm" if i % 2 else f"b{random.randint(0, 12)}") for i in range(90)]
    node = spark.createDataFrame(rows, "node_id string, node_idx long, f string, g string")
    tokens = {r[0]: {(k, t.strip()) for k, text in (("f", r[2]), ("g", r[3])) for t in text.split(";")} for r in rows}
    for least in (1, 2):
        want = {}
        for a, b in itertools.combinations(sorted(tokens), 2):
            same = sorted(tokens[a] & tokens[b])
            if len({k for k, _ in same}) >= least:
                want[a, b] = same
        for options in ({}, {"block_rows": 7, "wide": 4}):
            got = {(r.src, r.dst): sorted((x.feature, t) for x in r.shared for t in x.shared_values) for r in graph.edges(node, ["f", "g"], ";", least, **options).collect()}
            assert got == want


def test_matrix_in_blocks(spark):
    random.seed(6)
    nodes = list(range(50))
    pairs = sorted({tuple(sorted(random.sample(nodes, 2))) for _ in range(80)})
    node, edge = graph_of(spark, pairs, nodes)
    for side in (1, 7, 1024):
        got = [(r.row_block * side + i, r.col_block * side + j, w) for r in graph.adjacency_blocks(node, edge, side=side).collect() for i, j, w in zip(r.rows, r.cols, r.weights)]
        assert sorted(got) == sorted([(a, b, 1) for a, b in pairs] + [(b, a, 1) for a, b in pairs])


PROBABILITIES = [0.0, 0.31, 0.5, 0.85, 1.0]


def test_quantiles_are_exact(spark):
    """Groups of several shapes and sizes side by side, a null one too: even, long tails, ties, one value, values at the ends of doubles."""
    rng = np.random.default_rng(7)
    made = {
        "even": lambda n: rng.random(n),
        "tails": lambda n: np.exp(rng.standard_normal(n) * 60),
        "ties": lambda n: rng.integers(0, 4, n).astype(float),
        "one": lambda n: np.full(n, 2.5),
        "ends": lambda n: np.where(rng.random(n) < 0.2, rng.choice([-1.7e308, 1.7e308, np.inf, -np.inf], n), rng.random(n)),
    }
    rows = [(f"{kind}{n}" if n != 77 or kind != "ties" else None, float(x)) for kind, make in made.items() for n in (2000, 77, 1) for x in make(n)]
    df = spark.createDataFrame([*rows, ("even1", None), ("none", None)], "k string, x double").repartition(5)
    want = {r.k: r.q for r in df.filter("x is not null").groupBy("k").agg(F.percentile("x", F.array(*map(F.lit, PROBABILITIES))).alias("q")).collect()}
    for options in ({"small": 10, "accuracy": 5, "bins": 4}, {}):
        got = {r.k: r.quantiles for r in stats.quantiles(df, F.col("x"), PROBABILITIES, ["k"], **options).collect()}
        assert str(got) == str({k: want[k] for k in got}) and got.keys() == want.keys()
    some = df.filter("k = 'tails2000'")
    whole = stats.quantiles(some, F.col("x"), [0.5, 0.85], small=10, accuracy=50, bins=16).collect()
    assert str([r.quantiles for r in whole]) == str([r.q for r in some.agg(F.percentile("x", F.array(F.lit(0.5), F.lit(0.85))).alias("q")).collect()])


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, x double")
    assert stats.quantiles(empty, F.col("x"), [0.5], ["k"]).count() == 0
    assert stats.quantiles(empty, F.col("x"), [0.5]).first().quantiles is None


def test_carried_over_ranges(spark):
    random.seed(8)
    rows = [(random.choice(["a", "b", "c", None]), i, f"v{i}" if random.random() < 0.02 else None) for i in range(800)]
    rows += [("hot", 1000 + i, "first" if i == 0 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, n long, v string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        for keys in ([], ["k"]):
            last, want = {}, {}
            for k, n, v in sorted(rows, key=lambda r: r[1]):
                at = k if keys else 0
                last[at] = v if v is not None else last.get(at)
                want[n] = last[at]
            assert {r.n: r.c for r in dedup.carried(df, "v", ["n"], keys, "c").collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert dedup.carried(df.filter("false"), "v", ["n"]).count() == 0


def test_a_study_holds_on_into_the_next_log(spark, tmp_path):
    head = "Searching GitHub for repositories related to {} ({})...\n"
    skip = "  Skipping https://github.com/g/{} - insufficient content\n"
    (tmp_path / "batch1.log").write_text(skip.format(0) + "x\n" * 50 + head.format("A", "AA") + skip.format(1))
    (tmp_path / "batch2.log").write_text(skip.format(2) + head.format("B", "BB") + "line\n" * 3000 + skip.format(3) + skip.format(1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2048)
    try:
        lines = S.log_lines(spark, str(tmp_path))
        got = sorted(map(tuple, S.mine_logs(spark, str(tmp_path)).collect()))
        parts = lines.select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert parts > 4
    assert got == [("https://github.com/g/1", "B", "BB"), ("https://github.com/g/2", "A", "AA"), ("https://github.com/g/3", "B", "BB")]


def test_heavy_values_with_and_without_proof(spark):
    random.seed(9)
    frequent = [random.choice("abcdef") for _ in range(3000)] + [f"v{i}" for i in range(2000)]
    rare = [f"v{i % 1700}" for i in range(3000)]
    for values in (frequent, rare, ["x"], []):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v string").repartition(4)
        for tracked in (64, 1000):
            want = [tuple(r) for r in stats.top_k(df, F.col("v"), 4).collect()]
            assert [tuple(r) for r in stats.heavy_top_k(df, F.col("v"), 4, tracked).collect()] == want


def test_merged_sketches_count_distinct_values(spark):
    df = spark.range(200_000).selectExpr("id % 10 AS day", "id % 2 AS k", "id % 30000 AS v")
    sketches = stats.distinct_sketches(df, ["day", "k"], F.col("v"))
    got = {r.k: r.distinct for r in stats.distinct_from(sketches, ["k"]).collect()}
    assert all(abs(got[k] - 15000) <= 0.06 * 15000 for k in (0, 1)), got


def test_binned_density_is_the_density(spark):
    rng = np.random.default_rng(11)
    rows = [("a", float(x)) for x in 10 ** rng.standard_normal(2000)] + [("b", float(x)) for x in rng.integers(1, 9, 500)] + [("c", 5.0)] * 9 + [("d", 1.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    exact = {(r.grp, r.point): (r.x, r.density) for r in stats.density(df, F.col("g"), F.col("x")).collect()}
    for fineness, most in ((4096, 1e-6), (64, 1e-3)):
        got = {(r.grp, r.point): (r.x, r.density) for r in stats.binned_density(df, F.col("g"), F.col("x"), fineness=fineness).collect()}
        assert got.keys() == exact.keys()
        assert max(abs(got[k][1] - exact[k][1]) for k in exact) <= most and max(abs(got[k][0] - exact[k][0]) for k in exact) < 1e-9


def test_envelope_is_one_document(spark, tmp_path):
    rows = [(i, None if i % 3 else f'say "{i}"\n{{[', i / 4) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, text string, x double").repartition(4)
    sinks.export_envelope(df, str(tmp_path / "e"), "id")
    whole = json.loads("".join(p.read_text() for p in sorted((tmp_path / "e").glob("part-*"))))
    assert whole["data"] == [{"id": i, "text": t, "x": x} for i, t, x in rows]
    assert whole["metadata"] == {"total_records": 50, "columns": ["id", "text", "x"], "column_count": 3, "data_types": {"id": "bigint", "text": "string", "x": "double"}, "null_counts": {"id": 0, "text": 33, "x": 0}}
    sinks.export_envelope(df.filter("false"), str(tmp_path / "none"), "id")
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "none").glob("part-*"))))["data"] == []
