"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search.

Vectors are dealt into shards of a bounded number of values. Up to one shard's
worth they are all together. Beyond that, coarse cells (k-means directions of a
bounded sample) gather vectors that lie alike, and a cell too large for a shard
is dealt by hash into several. Within a shard, small random-projection leaves
give every vector its first neighbours. Then each round joins neighbour lists
with neighbour lists (a vector's own and a few that list it): the neighbours of
neighbours are scored and the best kept.

A query visits the cells that lie nearest to it. How many is measured: for a
bounded sample of queries the true neighbours are found by brute force over all
vectors, and as many cells are visited as hold the share ``recall`` of them; if
vectors do not gather at all, that is every cell. In each of their shards the
query searches the graph greedily: from the best of some entry points it expands
the best unexpanded node until none of the ``width`` best is left, and the
shards' finds are merged. Queries come to a shard in blocks of bounded size.

Equal vectors are one node; of its members the smallest ids are enough, as many
as a query can return. Vectors that are null, empty, zero or hold null or
non-finite components take no part; vectors of different lengths are not
compared; rows with a null id take no part. Repeated ids are vectors of their
own, though never a neighbour of a query with the same id. Ties go to the
smaller id. Only the id and the vector are read. An empty table gives an empty
table.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.common import cut
from shelfmark.llm.vectors import matrix, unit, valid

GRAPH = "d int, shard long, node long, near array<long>"


def _best(rows: np.ndarray, candidates: np.ndarray, own: int, keep: int) -> np.ndarray:
    """Indexes of the candidates with the largest inner products with row own."""
    candidates = candidates[candidates != own]
    scores = rows[candidates] @ rows[own]
    if len(candidates) > keep:
        some = np.argpartition(-scores, keep - 1)[:keep]
        candidates, scores = candidates[some], scores[some]
    return candidates[np.argsort(-scores, kind="stable")]


def first_neighbours(pdf: pd.DataFrame, keep: int, leaf: int, trees: int) -> pd.DataFrame:
    """Each vector's best neighbours within the leaves of a few random splits of its shard."""
    pdf = pdf.sort_values("node").reset_index(drop=True)
    rows, ids = matrix(pdf["v"]).astype(np.float32), pdf["node"].to_numpy()
    rng = np.random.default_rng(7)
    found: list[list[np.ndarray]] = [[] for _ in ids]
    for _ in range(trees):
        open_leaves = [np.arange(len(ids))]
        while open_leaves:
            part = open_leaves.pop()
            if len(part) > leaf:
                order = part[np.argsort(rows[part] @ rng.standard_normal(rows.shape[1]).astype(np.float32), kind="stable")]
                open_leaves += [order[: len(order) // 2], order[len(order) // 2 :]]
                continue
            scores = rows[part] @ rows[part].T
            np.fill_diagonal(scores, -np.inf)
            top = np.argsort(-scores, axis=1, kind="stable")[:, : min(keep, len(part) - 1)]
            for i, t in zip(part, top):
                found[i].append(part[t])
    near = [ids[_best(rows, np.unique(np.concatenate(f)), i, keep)] for i, f in enumerate(found)]
    return pd.DataFrame({"d": pdf["d"], "shard": pdf["shard"], "node": ids, "near": near})


def joined_neighbours(graph: DataFrame, forward: int, backward: int) -> DataFrame:
    """(d, shard, node, near): each node's best neighbours and a few nodes that list it, chosen by hash."""
    own = graph.select("d", "shard", "node", F.explode(F.slice("near", 1, forward)).alias("other"))
    turned = own.select("d", "shard", F.col("other").alias("node"), F.col("node").alias("other"))
    drawn = F.row_number().over(W.partitionBy("d", "shard", "node").orderBy(F.xxhash64("node", "other"), "other"))
    back = turned.withColumn("turn", drawn).filter(F.col("turn") <= backward).drop("turn")
    return own.union(back).groupBy("d", "shard", "node").agg(F.array_sort(F.collect_set("other")).alias("near"))


def descend(graph: DataFrame, vectors: DataFrame, keep: int, forward: int, backward: int) -> DataFrame:
    """One round: neighbours of neighbours by a join of the lists, scored against the vectors of the shard."""
    lists = cut(joined_neighbours(graph, forward, backward), "lists")
    steps = lists.select("d", "shard", "node", F.explode("near").alias("via"))
    second = steps.join(lists.select("d", "shard", F.col("node").alias("via"), F.col("near").alias("beyond")), ["d", "shard", "via"])
    candidates = second.groupBy("d", "shard", "node").agg(F.array_distinct(F.flatten(F.collect_list("beyond"))).alias("beyond"))
    known = graph.join(candidates, ["d", "shard", "node"], "left")

    def score(lists: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        vectors = vectors.sort_values("node")
        rows, ids = matrix(vectors["v"]).astype(np.float32), vectors["node"].to_numpy()
        near = []
        for node, old, new in zip(lists["node"], lists["near"], lists["beyond"]):
            every = np.concatenate([old, new]) if new is not None else old
            own, *at = np.searchsorted(ids, np.concatenate([[node], np.unique(every)]).astype(np.int64)).tolist()
            near.append(ids[_best(rows, np.array(at, dtype=np.int64), own, keep)])
        return pd.DataFrame({"d": lists["d"], "shard": lists["shard"], "node": lists["node"], "near": near})

    return known.groupBy("d", "shard").cogroup(vectors.groupBy("d", "shard")).applyInPandas(score, GRAPH)


def neighbour_graph(vectors: DataFrame, keep: int = 24, rounds: int = 3, leaf: int = 96, trees: int = 4, forward: int = 14, backward: int = 10) -> DataFrame:
    """(d, shard, node, near) from (d, shard, node, v)."""
    graph = cut(vectors.groupBy("d", "shard").applyInPandas(lambda pdf: first_neighbours(pdf, keep, leaf, trees), GRAPH), "graph")
    for _ in range(rounds):
        graph = cut(descend(graph, vectors, keep, forward, backward), "graph")
    return graph


def greedy(rows: np.ndarray, edges: list[np.ndarray], query: np.ndarray, entries: np.ndarray, width: int) -> list[tuple[float, int]]:
    """(inner product, row) of the best rows that a greedy search from the entry points finds, unordered."""
    seen = np.zeros(len(rows), dtype=bool)
    seen[entries] = True
    start = sorted(zip((rows[entries] @ query).tolist(), entries.tolist()), reverse=True)[:width]
    best = [(s, i) for s, i in start]
    heapq.heapify(best)
    todo = [(-s, i) for s, i in start]
    heapq.heapify(todo)
    while todo:
        s, i = heapq.heappop(todo)
        if len(best) >= width and -s < best[0][0]:
            break
        new = edges[i][~seen[edges[i]]]
        if not len(new):
            continue
        seen[new] = True
        for score, j in zip((rows[new] @ query).tolist(), new.tolist()):
            if len(best) < width:
                heapq.heappush(best, (score, j))
                heapq.heappush(todo, (-score, j))
            elif score > best[0][0]:
                heapq.heapreplace(best, (score, j))
                heapq.heappush(todo, (-score, j))
    return best


FOUND = "query_id long, node long, score double"


def search_shard(graph: pd.DataFrame, queries: pd.DataFrame, keep: int, width: int, entries: int) -> pd.DataFrame:
    """Each query's best nodes of a shard, with exact scores."""
    if not len(graph) or not len(queries):
        return pd.DataFrame({"query_id": [], "node": [], "score": []}).astype({"query_id": "int64", "node": "int64", "score": "float64"})
    graph = graph.sort_values("node").reset_index(drop=True)
    exact, ids = matrix(graph["v"]), graph["node"].to_numpy()
    rows = exact.astype(np.float32)
    edges = [np.searchsorted(ids, np.asarray(n, dtype=np.int64)) for n in graph["near"]]
    start = np.random.default_rng(11).permutation(len(ids))[:entries]
    out = []
    for query_id, v, at in zip(queries["query_id"], queries["v"], queries["rep"]):
        query = np.asarray(v, dtype=np.float64)
        own = np.searchsorted(ids, at)
        begin = np.append(start[start != own], own) if own < len(ids) and ids[own] == at else start
        found = np.array([i for _, i in greedy(rows, edges, query.astype(np.float32), begin, width)])
        scores = exact[found] @ query
        top = np.lexsort((ids[found], -scores))[:keep]
        out.append(pd.DataFrame({"query_id": query_id, "node": ids[found[top]], "score": scores[top]}))
    return pd.concat(out)


def directions(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit directions of cells: k-means by cosine over a sample."""
    rows = unit(sample)
    centres = rows[np.random.default_rng(17).permutation(len(rows))[:cells]]
    for _ in range(rounds):
        own = np.argmax(rows @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(length > 1e-9, sums / np.maximum(length, 1e-9), centres)
    return centres


def visited(queries: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each query the cells in the order in which it visits them."""
    return np.argsort(-(queries @ centres.T), axis=1, kind="stable")


def true_neighbours(nodes: DataFrame, d: int, queries: np.ndarray, reps: np.ndarray, k: int) -> pd.DataFrame:
    """(query, cell, score) of the k best nodes of length d for each of a bounded number of queries, by brute force over all nodes."""

    def look(batches):
        best = [[] for _ in queries]
        for batch in (b for b in batches if len(b)):
            rows, node, cell = matrix(batch["v"]), batch["node"].to_numpy(), batch["cell"].to_numpy()
            scores = queries @ rows.T
            scores[reps[:, None] == node[None, :]] = -np.inf
            top = np.argpartition(-scores, min(k, scores.shape[1]) - 1, axis=1)[:, :k]
            for i, t in enumerate(top):
                best[i] = heapq.nlargest(k, [*best[i], *zip(scores[i, t].tolist(), cell[t].tolist())])
        rows = [(i, c, s) for i, found in enumerate(best) for s, c in found if s > -np.inf]
        if rows:
            yield pd.DataFrame(rows, columns=["query", "cell", "score"])

    found = nodes.filter(F.col("d") == d).mapInPandas(look, "query int, cell int, score double")
    turn = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "cell"))
    return found.withColumn("turn", turn).filter(F.col("turn") <= k).select("query", "cell").toPandas()  # k rows a sampled query


def cells_to_visit(found: pd.DataFrame, order: np.ndarray, recall: float) -> int:
    """The least number of cells that hold the share ``recall`` of what was found."""
    if not len(found):
        return order.shape[1]
    place = np.argsort(order, axis=1)[found["query"].to_numpy(), found["cell"].to_numpy()]
    return int(np.sort(place)[min(len(place) - 1, int(np.ceil(recall * len(place))) - 1)]) + 1


def nearest(
    vectors: DataFrame,
    every: int = 20,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_values: int = 1 << 22,
    block_rows: int = 1 << 15,
    width: int = 400,
    entries: int = 256,
    backward: int = 16,
    sample_rows: int = 20_000,
    sample_queries: int = 200,
    recall: float = 0.97,
) -> DataFrame:
    """The k nearest of each vector whose id is divisible by ``every``: query_id, rank, vec_id, score.

    ``shard_values`` (65,536 vectors of 64) and ``block_rows`` bound what one
    task holds of the vectors and of the queries; ``width`` and ``entries`` set
    how far a search looks. ``sample_rows`` bounds what the cells' directions are
    learned from and ``sample_queries`` those whose true neighbours are found.
    """
    good = valid(vectors, id_col, vector_col)
    groups = cut(good.groupBy("v").agg(F.min("vec_id").alias("rep")).withColumn("d", F.size("v")), "nodes")
    sizes = {r["d"]: r["n"] for r in groups.groupBy("d").agg(F.count("*").alias("n")).collect()}  # a row a length
    turn = F.row_number().over(W.partitionBy("rep").orderBy("vec_id"))
    named = good.join(groups.select("v", "rep"), "v")
    members = named.select("rep", "vec_id", turn.alias("turn")).filter(F.col("turn") <= k + 1).select(F.col("rep").alias("node"), "vec_id")
    asked = cut(named.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "rep", "v", F.size("v").alias("d")), "queries")

    most = {d: max(256, shard_values // d) for d in sizes}
    wanted = {d: min(1024, sample_rows // 8, -(-n // most[d])) for d, n in sizes.items() if n > most[d]}
    centres: dict[int, np.ndarray] = {}
    if wanted:
        place = F.row_number().over(W.partitionBy("d").orderBy(F.xxhash64("rep"), "rep"))
        drawn = groups.filter(F.col("d").isin(*wanted)).select("d", "v", place.alias("place")).filter(F.col("place") <= max(8, sample_rows // len(wanted))).toPandas()
        centres = {int(d): directions(matrix(part["v"]), wanted[int(d)]) for d, part in drawn.groupby("d")}

    def gather(batches):
        for batch in (b for b in batches if len(b)):
            cell = np.zeros(len(batch), dtype=np.int32)
            for d, at in batch.groupby("d").indices.items():
                if int(d) in centres:
                    cell[at] = np.argmax(matrix(batch["v"].iloc[at]) @ centres[int(d)].T, axis=1)
            yield batch.assign(cell=cell)

    celled = cut(groups.select("d", F.col("rep").alias("node"), "v").mapInPandas(gather, "d int, node long, v array<float>, cell int"), "cells")
    parts = celled.groupBy("d", "cell").agg(F.count("*").alias("n"))
    room = F.create_map(*[F.lit(x) for d, n in most.items() for x in (d, n)]) if most else F.lit(None).cast("map<int,int>")
    parts = parts.select("d", "cell", F.ceil(F.col("n") / room[F.col("d")]).cast("int").alias("parts"))  # at most 1,024 rows a length
    dealt = celled.join(F.broadcast(parts), ["d", "cell"])
    nodes = cut(dealt.select("d", shard_of(F.col("cell"), F.pmod(F.xxhash64("node"), F.col("parts"))).alias("shard"), "node", "v"), "shards")
    graph = neighbour_graph(nodes)
    linked = cut(joined_neighbours(graph, 1 << 20, backward).join(nodes, ["d", "shard", "node"], "right").withColumn("near", F.coalesce("near", F.array().cast("array<long>"))), "linked")

    visits = {}
    for d, c in centres.items():
        some = asked.filter(F.col("d") == d).orderBy(F.xxhash64("query_id"), "query_id").limit(sample_queries).toPandas()
        if len(some):
            queries = matrix(some["v"])
            visits[d] = cells_to_visit(true_neighbours(celled, d, queries, some["rep"].to_numpy(), k), visited(queries, c), recall)

    def route(batches):
        for batch in (b for b in batches if len(b)):
            cells = [np.zeros(1, dtype=np.int64)] * len(batch)
            for d, at in batch.groupby("d").indices.items():
                if int(d) in centres:
                    for i, row in zip(at, visited(matrix(batch["v"].iloc[at]), centres[int(d)])[:, : visits.get(int(d), len(centres[int(d)]))]):
                        cells[i] = row
            yield batch.assign(cells=cells)

    routed = asked.mapInPandas(route, "query_id long, rep long, v array<float>, d int, cells array<int>").withColumn("cell", F.explode("cells")).drop("cells")
    routed = routed.join(F.broadcast(parts), ["d", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    routed = cut(routed.select("query_id", "rep", "v", "d", shard_of(F.col("cell"), F.col("part")).alias("shard")), "routed")
    blocks = routed.groupBy("d", "shard").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    asked = routed.join(blocks, ["d", "shard"]).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks")
    left = linked.join(blocks, ["d", "shard"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    key = ["d", "shard", "block"]
    found = left.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(lambda g, q: search_shard(g, q, k + 1, width, entries), FOUND)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    every_find = cut(found, "found").join(members, "node").filter("vec_id <> query_id").select("query_id", "vec_id", "score").distinct()
    return every_find.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def shard_of(cell, part):
    """A shard's number, from its cell and its part of the cell."""
    return cell.cast("long") * (1 << 32) + part.cast("long")
