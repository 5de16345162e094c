"""Similar documents, near-duplicate vectors and nearest neighbours against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pandas as pd

from shelfmark.llm import neighbours, vector_dedup, vectors
from shelfmark.llm.components import components
from shelfmark.llm.jaccard import keep_one, similar_groups
from shelfmark.llm.neighbours import nearest
from shelfmark.llm.vector_dedup import near_duplicates


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_similar_groups(spark):
    random.seed(1)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    at = 5000
    for i in range(0, 100, 10):
        w = docs[i][1].split(" ")
        for _ in range(6):
            v = w[:]
            for _ in range(int(len(v) * random.choice([0, 0.01, 0.02, 0.03, 0.04, 0.05]))):
                v[random.randrange(len(v))] = random.choice(["foo", "bar", "baz"])
            docs.append((at, " ".join(v)))
            at += 1
    docs += [(9000, None), (9001, ""), (9002, "one two"), (9003, "ONE  two"), (9004, " \n"), (9005, "x " * 50), (9006, "X " * 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'clash' AS n", "'clash' AS rep")
    got = {r.doc_id: r for r in similar_groups(df).collect()}
    sets = {i: shingles(t) for i, t in docs}
    where = {}
    for i, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in where[g] if j > i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert all(got[i].n_shingles == len(sets[i]) for i in sets)
    assert all(got[i].component_id == root(i) for i in sets)
    assert sorted(r.doc_id for r in keep_one(df).collect()) == sorted(i for i in sets if root(i) == i)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert similar_groups(docs).count() == 0 and near_duplicates(vectors).count() == 0 and nearest(vectors).count() == 0


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(7, 7), (None, 3), (100, 101), (101, 100)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def odd_vectors():
    return [(1500, None), (1501, [0.0] * 16), (1502, [float("nan")] + [1.0] * 15), (1503, [1.0, 2.0]), (1504, [2.0, 4.0]), (1505, [None, 1.0])]


def test_near_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((100, 16))
    rows = [(i, [float(x) for x in base[i % 100] + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.3])]) for i in range(500)]
    df = spark.createDataFrame(rows + odd_vectors(), "vec_id long, embedding array<float>").selectExpr("*", "'clash' AS rep")
    got = {r.vec_id: r for r in near_duplicates(df, leaf_rows=64, tile_rows=50).collect()}
    e = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    u = e / np.linalg.norm(e, axis=1)[:, None]
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    assert all(got[i].n_links <= linked[i].sum() for i in range(500))
    assert sum(got[i].n_links for i in range(500)) >= 0.98 * linked.sum()
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in (1500, 1501, 1502, 1504, 1505)] == [(0, 1500, True), (0, 1501, True), (0, 1502, True), (1, 1503, False), (0, 1505, True)]


def test_nearest(spark):
    rng = np.random.default_rng(4)
    e = rng.standard_normal((600, 16)).astype(np.float32)
    e[300:330] = e[0]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(e)]
    df = spark.createDataFrame(rows + odd_vectors()[:3], "vec_id long, embedding array<float>")
    got = {}
    for r in nearest(df, shard_values=300 * 16, block_rows=7).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    scores = e.astype(float) @ e.astype(float).T
    hits = 0
    for q in range(0, 600, 20):
        order = sorted((i for i in range(600) if i != q), key=lambda i: (-scores[q, i], i))[:20]
        assert sorted(got[q]) == list(range(1, 21)) and all(abs(s - scores[q, i]) < 1e-9 for i, s in got[q].values())
        hits += len(set(order) & {i for i, _ in got[q].values()})
    assert hits >= 0.9 * 600 and [got[0][k][0] for k in range(1, 21)] == list(range(300, 320))


def test_deep_trees_keep_near_pairs_together():
    """At the depth of a thousand million vectors; the pairs counted here are not those that chose the number of trees."""
    rng = np.random.default_rng(12)
    sample = vectors.unit(rng.standard_normal((4000, 64)))
    recalls = {}
    for depth in (7, 14, 22):
        trees = vector_dedup.forest(sample, depth, 0.9, recall=0.97, least=8, most=64, seed=1)
        a, b = vector_dedup.planted(vectors.unit(rng.standard_normal((1000, 64))), 0.9, 1000, 99)
        assert np.allclose((a * b).sum(axis=1), 0.9)
        codes = [np.stack([t.leaves(x) for t in trees], axis=1) for x in (a, b)]
        recalls[depth] = (codes[0][:, :, :, None] == codes[1][:, :, None, :]).any(axis=(1, 2, 3)).mean(), len(trees)
    assert all(r >= 0.94 for r, _ in recalls.values()) and recalls[7][1] == 8 < recalls[22][1] < 64, recalls


def test_too_few_trees_get_shallower(spark):
    """Where the trees that are allowed do not reach the recall, fewer levels do, down to one leaf, which finds every link."""
    rng = np.random.default_rng(21)
    sample = vectors.unit(rng.standard_normal((2000, 64)))
    trees = vector_dedup.forest(sample, 12, 0.9, recall=0.97, least=1, most=4, seed=1)
    a, b = vector_dedup.planted(sample, 0.9, 1000, 99)
    met = [(t.leaves(a)[:, :, None] == t.leaves(b)[:, None, :]).any(axis=(1, 2)) for t in trees]
    assert len(trees) <= 4 and len(trees[0].directions) < 12 and np.any(met, axis=0).mean() >= 0.94
    a, b = vector_dedup.planted(sample[:150], 0.9001, 150, 5)
    rows = np.concatenate([a, b])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    exact = vectors.unit(rows.astype(np.float32).astype(np.float64))
    links = (exact @ exact.T >= 0.9).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in near_duplicates(df, trees=1, most_trees=1, leaf_rows=2, recall=1.0).collect()}
    assert got == dict(enumerate(links.tolist()))


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(3 + i % 3)]) for i in range(60)]
    rows += [(100 + i, [x * 2 for x in v]) for i, v in rows[:30]] + [(7, rows[0][1]), (7, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.n_links) for r in vector_dedup.near_duplicates(df, sample_rows=24).collect())
    units = [np.asarray(v, np.float32).astype(float) / np.linalg.norm(np.asarray(v, np.float32).astype(float)) for _, v in rows]
    want = sorted((i, sum(k != j and len(units[k]) == len(u) and float(units[k] @ u) >= 0.9 for k in range(len(rows)))) for j, ((i, _), u) in enumerate(zip(rows, units)))
    assert got == want


def recall_of(spark, rows, **options):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    got = {}
    for r in nearest(df, **options).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    exact = np.asarray(rows, np.float32).astype(float)
    hits = 0
    for q in range(0, len(rows), 20):
        scores = exact @ exact[q]
        scores[q] = -np.inf
        want = np.lexsort((np.arange(len(rows)), -scores))[:20]
        found = sorted(got[q])
        assert [rank for rank, _, _ in found] == list(range(1, 21)) and all(abs(s - exact[i] @ exact[q]) < 1e-9 for _, i, s in found)
        hits += len(set(want.tolist()) & {i for _, i, _ in found})
    return hits / (20 * len(got))


def test_nearest_over_many_cells(spark):
    """Vectors that gather, and vectors that do not, in three shards and more; either way what is found is nearly all."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((8, 16)) * 3
    gathered = centres[rng.integers(0, 8, 4200)] + rng.standard_normal((4200, 16)) * 0.5
    assert recall_of(spark, gathered, shard_values=1024 * 16) >= 0.9
    assert recall_of(spark, rng.standard_normal((3200, 16)), shard_values=1024 * 16) >= 0.9


def test_cells_to_visit():
    order = np.array([[2, 0, 1], [1, 2, 0]])
    found = pd.DataFrame({"query": [0] * 10 + [1] * 10, "cell": [2] * 10 + [1] * 9 + [0]})
    assert neighbours.cells_to_visit(found, order, 0.9) == 1 and neighbours.cells_to_visit(found, order, 1.0) == 3
    assert neighbours.cells_to_visit(found.iloc[:0], order, 0.9) == 3
