"""Near-duplicate embeddings by a forest of random-projection trees.

Each tree splits the vectors again and again by a random direction at the
median of a bounded sample, until leaves are small. A vector also spills into
the leaf on the other side of the split that it lies closest to. Within a leaf
all pairs are compared in double precision; a pair that several leaves hold is
counted in the first of them. Leaves that stay large are compared in tiles.
Equal vectors are compared once, for all of them.

The deeper the trees, the likelier each parts a near pair, so their number
follows from the depth: pairs planted at the threshold around sampled vectors
are sent through the trees, and trees are added until at least ``recall`` of the
pairs meet in a leaf. Where ``most_trees`` do not reach that, trees of one level
less are grown, and so on down to a single leaf, in which all vectors meet. Each length of vectors has a sample and a forest of its own.

Vectors that are null, empty, zero or hold null or non-finite components link
with nothing; vectors of different lengths do not link. Repeated ids are
vectors of their own. Only the id and the vector are read, so other columns
may have any name. An empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.common import cut
from shelfmark.llm.components import components
from shelfmark.llm.vectors import matrix, takes_part, unit, valid


class Tree:
    """A direction for each level, and a threshold for each node that the sample reaches."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int):
        self.directions = np.random.default_rng(seed).standard_normal((depth, sample.shape[1]))
        projected = sample @ self.directions.T
        self.default = np.median(projected, axis=0) if len(sample) else np.zeros(depth)
        self.thresholds: list[dict[int, float]] = []
        node = np.zeros(len(sample), dtype=np.int64)
        for level in range(depth):
            order = np.argsort(node, kind="stable")
            ids, starts = np.unique(node[order], return_index=True)
            groups = np.split(projected[order, level], starts[1:]) if len(ids) else []
            known = {int(i): float(np.median(g)) for i, g in zip(ids, groups) if len(g) >= 8}
            self.thresholds.append(known)
            node = node * 2 + (projected[:, level] > self._at(node, level))

    def _at(self, node: np.ndarray, level: int) -> np.ndarray:
        known = self.thresholds[level]
        ids, inverse = np.unique(node, return_inverse=True)
        return np.array([known.get(int(i), self.default[level]) for i in ids])[inverse] if len(ids) else np.zeros(0)

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """Two leaves for each row: its own, and the one beyond its closest split."""
        projected = rows @ self.directions.T
        margin = np.full(len(rows), np.inf)
        closest = np.zeros(len(rows), dtype=np.int64)
        node = np.zeros(len(rows), dtype=np.int64)
        for level in range(projected.shape[1]):
            gap = projected[:, level] - self._at(node, level)
            near = np.abs(gap) < margin
            margin, closest = np.where(near, np.abs(gap), margin), np.where(near, level, closest)
            node = node * 2 + (gap > 0)
        spilled = np.zeros(len(rows), dtype=np.int64)
        for level in range(projected.shape[1]):
            right = projected[:, level] > self._at(spilled, level)
            spilled = spilled * 2 + np.where(closest == level, ~right, right)
        return np.stack([node, spilled], axis=1)


def planted(sample: np.ndarray, threshold: float, pairs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors whose cosine is the threshold: sampled ones, each with one beside it in a random direction."""
    rng = np.random.default_rng(seed)
    a = sample[rng.integers(0, len(sample), pairs)]
    aside = rng.standard_normal(a.shape)
    aside -= (aside * a).sum(axis=1, keepdims=True) * a
    length = np.sqrt((aside * aside).sum(axis=1, keepdims=True))
    return a, threshold * a + math.sqrt(1 - threshold**2) * aside / np.maximum(length, 1e-12)


def forest(sample: np.ndarray, depth: int, threshold: float, recall: float, least: int, most: int, seed: int, pairs: int = 2000) -> list[Tree]:
    """At least ``least`` trees, and as many more, up to ``most``, as it takes for the share ``recall`` of planted pairs to meet in a leaf.

    Where that many do not reach it, a forest of one level less is tried; without levels there is one tree of one leaf.
    """
    a, b = planted(sample, threshold, pairs, seed)
    for levels in range(depth, 0, -1):
        met = np.zeros(pairs, dtype=bool)
        trees: list[Tree] = []
        while len(trees) < least or met.mean() < recall and len(trees) < most:
            trees.append(Tree(sample, levels, seed + 1000 * len(trees)))
            met |= (trees[-1].leaves(a)[:, :, None] == trees[-1].leaves(b)[:, None, :]).any(axis=(1, 2))
        if met.mean() >= recall:
            return trees
    return [Tree(sample, 0, seed)]


def first_shared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of leaf numbers in trees (rows, trees, 2): the first tree in which a's row and b's row share a leaf, and the smallest leaf they share there."""
    same = (a[:, :, :, None] == b[:, :, None, :]).any(axis=3)
    tree = same.any(axis=2).argmax(axis=1)
    at = np.arange(len(a))
    return tree, np.where(same[at, tree], a[at, tree], np.iinfo(np.int64).max).min(axis=1)


def labels_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n rows over the pairs (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


LEAF_LINKS = "rep long, links long, hub long"


def compare_tile(rows: pd.DataFrame, threshold: float, block_rows: int = 1024) -> pd.DataFrame:
    """Links of one tile: for each vector that has any, the vectors it newly links with, and one of its component here."""
    tree, one, two = (int(rows[c].iat[0]) for c in ("tree", "one", "two"))
    unit_rows = unit(matrix(rows["v"]))
    codes = np.stack(rows["codes"].to_numpy()).astype(np.int64).reshape(len(rows), -1, 2)
    leaf = rows["leaf"].to_numpy()
    count = rows["n"].to_numpy()
    part = rows["part"].to_numpy()
    left, right = np.flatnonzero(part == one), np.flatnonzero(part == two)
    links = np.zeros(len(rows), dtype=np.int64)
    pairs_i, pairs_j = [], []
    for at in range(0, len(left), block_rows):
        some = left[at : at + block_rows]
        i, j = np.nonzero(unit_rows[some] @ unit_rows[right].T >= threshold - 1e-9)
        i, j = some[i], right[j]
        keep = i < j if one == two else np.ones(len(i), dtype=bool)
        i, j = i[keep], j[keep]
        for k in range(0, len(i), 1 << 16):
            a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            exact = np.einsum("ij,ij->i", unit_rows[a], unit_rows[b]) >= threshold
            a, b = a[exact], b[exact]
            pairs_i.append(a)
            pairs_j.append(b)
            first, smallest = first_shared(codes[a], codes[b])
            new = (first == tree) & (smallest == leaf[a])
            np.add.at(links, a[new], count[b[new]])
            np.add.at(links, b[new], count[a[new]])
    i, j = (np.concatenate([*x, np.zeros(0, dtype=np.int64)]).astype(np.int64) for x in (pairs_i, pairs_j))
    some = np.unique(np.concatenate([i, j]))
    label = labels_of(len(rows), i, j)
    rep = rows["rep"].to_numpy()
    return pd.DataFrame({"rep": rep[some], "links": links[some], "hub": rep[label[some]]})


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.9,
    trees: int = 8,
    leaf_rows: int = 256,
    tile_rows: int = 2048,
    sample_rows: int = 20_000,
    recall: float = 0.97,
    most_trees: int = 64,
) -> DataFrame:
    """For each row: vec_id, n_links, component_id, kept.

    ``sample_rows`` bounds the sample from which thresholds are taken (for each
    of several lengths its share, eight rows at least); every vector is put into
    the trees. ``trees`` and ``most_trees`` bound their number, ``recall`` is what
    they must reach on pairs planted at the threshold, else they get shallower. ``tile_rows`` bounds what one task compares at
    once: larger leaves are cut into blocks, and each pair of blocks is a tile.
    """
    everything = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("v"))
    good = valid(vectors, id_col, vector_col)
    groups = cut(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("d", F.size("v")), "vectors")
    members = cut(good.join(groups, "v").select("vec_id", "rep", "n"), "members")
    total = groups.count()
    lengths = max(1, groups.select("d").distinct().count())
    turn = F.row_number().over(W.partitionBy("d").orderBy(F.xxhash64("rep"), "rep"))
    sample = groups.select("d", "v", turn.alias("turn")).filter(F.col("turn") <= max(8, sample_rows // lengths)).select("d", "v").toPandas()
    depth = max(1, math.ceil(math.log2(max(2, total / leaf_rows))))
    forests = {int(d): forest(unit(matrix(part["v"])), depth, threshold, recall, trees, most_trees, int(d)) for d, part in sample.groupby("d")}

    def route(batches):
        for batch in (b for b in batches if len(b)):
            for d, part in batch.groupby("d"):
                rows = unit(matrix(part["v"]))
                codes = np.stack([t.leaves(rows) for t in forests[int(d)]], axis=1).reshape(len(part), -1).astype(np.int32)
                yield pd.DataFrame({"rep": part["rep"].to_numpy(), "n": part["n"].to_numpy(), "d": part["d"].to_numpy(), "v": part["v"].to_numpy(), "codes": list(codes)})

    routed = cut(groups.mapInPandas(route, "rep long, n long, d int, v array<float>, codes array<int>"), "routed")
    slots = routed.select("rep", "d", F.posexplode("codes").alias("slot", "leaf")).select("rep", "d", F.expr("int(slot div 2)").alias("tree"), "leaf").distinct()
    counts = slots.groupBy("d", "tree", "leaf").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("parts"))
    placed = slots.join(counts, ["d", "tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("rep", "tree"), F.col("parts")).cast("int"))
    other = placed.select("rep", "d", "tree", "leaf", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    tiles = other.select("rep", "d", "tree", "leaf", "part", F.least("part", "with").alias("one"), F.greatest("part", "with").alias("two"))
    rows = tiles.join(routed.drop("d"), "rep")
    found = cut(rows.groupBy("d", "tree", "leaf", "one", "two").applyInPandas(lambda pdf: compare_tile(pdf, threshold), LEAF_LINKS), "tile-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.select("rep", "hub").distinct(), "rep", "hub")
    known = members.join(links, "rep", "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    alone = everything.filter(~takes_part(F.col("v")) | F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
