"""Hard-negative mining by threshold joins on inner products.

All rows lie in tiles and all anchors in blocks, and each tile meets each block
once for the positives and once for the negatives. Within a tile the rows form
an index by dimension, the dimensions of most weight first. A row's last
dimensions are left out of the index where the norm of what they hold, times
the largest such norm of a query, stays below the threshold: they cannot bring
a pair over it alone, and rows that are left out wholly never become
candidates. Scores are added up dimension by dimension; a pair goes as soon as
its score so far and the product of both remaining norms stay below its
threshold, and what is left is evaluated exactly.

A window asks for the best few rows whose score lies between two bounds. Its
threshold starts high and is lowered until the window is full or its lower
bound is reached, so nothing that belongs into it is missed. For positives the
lower bound comes from a bounded sample of all rows: at least as many rows of
the label reach the score of the sample's fifth best. The windows' rows of all
tiles are then ranked.

Rows with a null label, a null vector or null or non-finite components take no
part; zero vectors do. Vectors of different lengths are not compared. Repeated
rows are rows of their own, and a row is only not its own partner; ties in
score and id come in the order of the rows as first read. Null ids are no
anchors and come last among ties. Scaled components stop at 2**24 on either
side. Columns other than the id, the vector and the label are not read, so
their names cannot clash. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.common import cut
from shelfmark.llm.vectors import finite, scaled

FAR = 1 << 62
#: Dimensions that are added up between two looks at the bounds.
STEP = 8


def suffix_norms(rows: np.ndarray) -> np.ndarray:
    """Column b: norm of a row's dimensions from b * STEP on; the last column is zero."""
    squares = (rows.astype(np.float64) ** 2)[:, ::-1].cumsum(axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([squares[:, ::STEP], np.zeros((len(rows), 1))], axis=1))


class Index:
    """The rows of a tile by dimension, to find those whose inner product with a query reaches a threshold."""

    def __init__(self, rows: np.ndarray):
        self.order = np.argsort(-(rows.astype(np.float64) ** 2).sum(axis=0), kind="stable")
        self.rows = rows[:, self.order]
        self.norms = suffix_norms(self.rows)
        largest = float(np.abs(rows).max(initial=0))
        self.exact = largest * largest * rows.shape[1] < 2**52  # so are all queries', which come from the same table

    def pairs(self, queries: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of every pair that reaches its query's threshold."""
        queries = queries[:, self.order]
        norms = suffix_norms(queries)
        slack = 1e-9 * norms[:, 0].max(initial=0) * self.norms[:, 0].max(initial=0) + 0.5
        bounds = thresholds.astype(np.float64) - slack
        # The number of steps that are indexed of each row: from there on it cannot reach the least threshold.
        held = (self.norms[:, :-1] * norms[:, :-1].max(axis=0, initial=0) >= bounds.min(initial=FAR)).sum(axis=1)
        if bounds.min(initial=FAR) <= 0:
            held[:] = self.norms.shape[1] - 1
        alive = np.flatnonzero(held)
        alive = alive[np.argsort(-held[alive], kind="stable")]
        some = np.arange(len(queries))
        rows, q = self.rows[alive].astype(np.float64), queries.astype(np.float64)
        score = np.zeros((len(some), len(alive)))
        for step in range(self.norms.shape[1] - 1):
            here = slice(step * STEP, (step + 1) * STEP)
            n = int(np.searchsorted(-held[alive], -step, side="left"))  # rows that hold this step
            if not n or not len(some):
                break
            score[:, :n] += q[:, here] @ rows[:n, here].T
            if step % 2 and step + 2 < self.norms.shape[1]:
                left = score + norms[some, step + 1][:, None] * self.norms[alive, step + 1] >= bounds[some][:, None]
                left[:, n:] = score[:, n:] + norms[some, :][:, held[alive[n:]]] * self.norms[alive[n:], held[alive[n:]]] >= bounds[some][:, None]
                keep, stay = left.any(axis=0), left.any(axis=1)
                if keep.mean() < 0.8 or stay.mean() < 0.8:
                    score, rows, alive = score[stay][:, keep], rows[keep], alive[keep]
                    some, q = some[stay], q[stay]
        i, j = np.nonzero(score + norms[some, :][:, held[alive]] * self.norms[alive, held[alive]] >= bounds[some][:, None])
        exact = score[i, j]
        i, j = some[i], alive[j]
        whole = (held[j] == self.norms.shape[1] - 1) & self.exact
        found = np.empty(len(i), dtype=np.int64)
        found[whole] = np.rint(exact[whole])
        rest = np.flatnonzero(~whole)
        for at in range(0, len(rest), 1 << 15):
            part = rest[at : at + (1 << 15)]
            found[part] = np.einsum("ij,ij->i", queries[i[part]], self.rows[j[part]])
        reached = found >= thresholds[i]
        return i[reached], j[reached], found[reached]


def best_in_windows(index: Index, queries: np.ndarray, low: np.ndarray, high: np.ndarray, most: int, allowed, order: np.ndarray, shares=(0.5, 0.2, 0.0), block: int = 256) -> list[tuple[np.ndarray, ...]]:
    """(query, window, row, score) of the best ``most`` rows of each window, in blocks.

    ``low`` and ``high``: bounds of the windows, a column for each; a window with
    high below low has no rows. ``allowed(query, row)`` tells which pairs count,
    ``order`` ranks rows of one score. The thresholds lie at ``shares`` of the way
    from the lower bound to the largest score that norms allow.
    """
    out = []
    reach = np.linalg.norm(queries.astype(np.float64), axis=1) * index.norms[:, 0].max(initial=0) + 1
    reach = np.minimum(np.ceil(reach * (1 + 1e-9)), FAR).astype(np.int64)[:, None]
    top, bottom = np.minimum(high, reach), np.maximum(low, -reach)
    waiting = top >= bottom
    for share in shares:
        at = np.where(waiting, bottom + np.floor((top - bottom) * share).astype(np.int64), FAR)
        least = at.min(axis=1)
        who = np.flatnonzero(waiting.any(axis=1))
        who = who[np.argsort(-least[who], kind="stable")]
        for first in range(0, len(who), block):
            some = who[first : first + block]
            i, j, score = index.pairs(queries[some], least[some])
            i = some[i]
            keep = allowed(i, j)
            i, j, score = i[keep], j[keep], score[keep]
            for window in range(low.shape[1]):
                fits = waiting[i, window] & (score >= at[i, window]) & (score <= high[i, window])
                a, b, s = i[fits], j[fits], score[fits]
                by = np.lexsort((order[b], -s, a))
                a, b, s = a[by], b[by], s[by]
                count = np.bincount(a, minlength=len(queries))
                starts = np.concatenate([[0], np.cumsum(count)[:-1]])
                full = (count >= most) | (at[:, window] == bottom[:, window])
                take = (np.arange(len(a)) - starts[a] < most) & full[a]
                out.append((a[take], np.full(int(take.sum()), window), b[take], s[take]))
                done = some[full[some]]
                waiting[done, window] = False
    return out


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def rank_of(rows: pd.DataFrame) -> np.ndarray:
    """The order of a tile's rows among ties: by id, null last, then as read."""
    ids = rows["vec_id"].astype("Int64")
    by = np.lexsort((rows["row"].to_numpy(), ids.fillna(0).to_numpy().astype(np.int64), ids.isna().to_numpy()))
    rank = np.empty(len(rows), dtype=np.int64)
    rank[by] = np.arange(len(rows))
    return rank


FOUND = "anchor long, window int, partner long, partner_id long, score long"


def _found(rows: pd.DataFrame, anchors: pd.DataFrame, parts: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
    i, window, j, score = (np.concatenate([p[k] for p in parts] or [np.zeros(0, dtype=np.int64)]) for k in range(4))
    ids = rows["vec_id"].astype("Int64").reset_index(drop=True)
    return pd.DataFrame({"anchor": anchors["row"].to_numpy()[i], "window": window, "partner": rows["row"].to_numpy()[j], "partner_id": ids.iloc[j].array, "score": score})


def positives_of(rows: pd.DataFrame, anchors: pd.DataFrame, most: int) -> pd.DataFrame:
    """The best other rows of each anchor's label within a tile, from the anchor's lower bound on."""
    parts = []
    labels, q = rows["label"].to_numpy(), stacked(rows["q"]) if len(rows) else None
    wanted, queries = anchors["label"].to_numpy(), stacked(anchors["q"]) if len(anchors) else None
    row, anchor, rank = rows["row"].to_numpy(), anchors["row"].to_numpy(), rank_of(rows)
    low = anchors["low"].astype("Int64").fillna(-FAR).to_numpy().astype(np.int64)
    for label in np.intersect1d(wanted, labels):
        these, of = np.flatnonzero(labels == label), np.flatnonzero(wanted == label)
        other = lambda i, j, these=these, of=of: anchor[of[i]] != row[these[j]]
        for i, window, j, score in best_in_windows(Index(q[these]), queries[of], low[of][:, None], np.full((len(of), 1), FAR), most, other, rank[these]):
            parts.append((of[i], window, these[j], score))
    return _found(rows, anchors, parts)


def negatives_of(rows: pd.DataFrame, anchors: pd.DataFrame, most: int) -> pd.DataFrame:
    """The best rows of other labels within a tile for each window of an anchor."""
    if not len(rows) or not len(anchors):
        return _found(rows, anchors, [])
    labels, wanted = rows["label"].to_numpy(), anchors["label"].to_numpy()
    low, high = stacked(anchors["low"]), stacked(anchors["high"])
    return _found(rows, anchors, best_in_windows(Index(stacked(rows["q"])), stacked(anchors["q"]), low, high, most, lambda i, j: wanted[i] != labels[j], rank_of(rows)))


def met(rows: DataFrame, anchors: DataFrame, kernel, most: int, tiles: int, blocks: int) -> DataFrame:
    """The kernel's rows of each tile with each block of anchors; every row is copied for each block and every anchor for each tile."""
    dealt = F.pmod(F.xxhash64("row"), F.lit(tiles)).cast("int")  # both sides' keys must be of one type to meet
    left = rows.select("*", dealt.alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = anchors.select("*", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))
    key = ["d", "tile", "block"]

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return kernel(a, b, most)

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(work, FOUND)


def ranked(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows of each window over all tiles, with ``rank``."""
    order = W.partitionBy("anchor", "window").orderBy(F.desc("score"), F.col("partner_id").asc_nulls_last(), "partner")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def with_low(anchors: DataFrame, rows: DataFrame, most: int, sample_rows: int) -> DataFrame:
    """anchors with ``low``: the score that at least ``most`` rows of the label reach, by a sample of ``sample_rows`` rows; null if it has fewer."""
    sample = rows.select("row", "label", "d", "q").orderBy(F.xxhash64("row"), "row").limit(sample_rows).toPandas()
    groups = {k: (g["row"].to_numpy(), stacked(g["q"])) for k, g in sample.groupby(["d", "label"])}
    shape = anchors.withColumn("low", F.lit(None).cast("long")).schema

    def look(batches):
        for batch in batches:
            low = pd.Series(pd.NA, index=batch.index, dtype="Int64")
            for key, part in batch.groupby(["d", "label"]):
                if key in groups:
                    row, q = groups[key]
                    for at in range(0, len(part), 256):
                        some = part.iloc[at : at + 256]
                        scores = np.where(some["row"].to_numpy()[:, None] == row, -FAR, stacked(some["q"]) @ q.T)
                        if scores.shape[1] >= most:
                            fifth = -np.partition(-scores, most - 1, axis=1)[:, most - 1]
                            low[some.index[fifth > -FAR]] = fifth[fifth > -FAR]
            batch["vec_id"] = batch["vec_id"].astype("Int64")
            yield batch.assign(low=low)

    return anchors.mapInPandas(look, shape)


def mine(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    every: int = 50,
    noisy: int = 7,
    labels: int = 10,
    positives: int = 5,
    negatives: int = 3,
    window: tuple[int, int] = (50, 95),
    tile_rows: int = 8192,
    anchor_rows: int = 4096,
    sample_rows: int = 4096,
) -> DataFrame:
    """For each anchor and positive the first negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id ``every`` divides; where ``noisy`` divides it the
    label first moves on by one of ``labels``. ``window``: a negative's score in
    per cent of its positive's. ``tile_rows`` and ``anchor_rows`` bound what a task
    holds, ``sample_rows`` the sample that lower bounds come from; none changes
    the result.
    """
    v, label = F.col(vector_col), F.col(label_col).cast("long")
    chosen = vectors.filter(finite(v) & label.isNotNull())
    moved = F.when(F.coalesce(F.col(id_col) % noisy == 0, F.lit(False)), (label + 1) % labels).otherwise(label)
    rows = cut(chosen.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), moved.alias("label"), F.size(v).alias("d"), scaled(v).alias("q")).filter(F.size("q") > 0), "rows")
    anchors = cut(with_low(rows.filter(F.col("vec_id") % every == 0), rows, positives, sample_rows), "anchors")
    n, a = (t.count() for t in (rows, anchors))
    tiles, blocks = max(1, -(-n // tile_rows)), max(1, -(-a // anchor_rows))
    best = cut(ranked(met(rows, anchors, positives_of, positives, tiles, blocks), positives), "positives")
    score = F.col("score")
    low = F.ceil(score * window[0] / F.lit(100)).cast("long")
    high = F.floor(score * window[1] / F.lit(100)).cast("long")
    windows = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", low.alias("low"), high.alias("high")))).alias("w"))
    filled = lambda name, none: F.concat(F.transform("w", lambda x: x[name]), F.array_repeat(F.lit(none).cast("long"), F.lit(positives) - F.size("w")))
    asked = windows.select(F.col("anchor").alias("row"), filled("low", FAR).alias("low"), filled("high", -FAR).alias("high"))
    found = ranked(met(rows, anchors.drop("low").join(asked, "row"), negatives_of, negatives, tiles, blocks), negatives)
    of = best.select("anchor", (F.col("rank") - 1).alias("window"), F.col("partner_id").alias("positive_id"), score.alias("positive_score"))
    named = found.join(of, ["anchor", "window"]).join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", "rank", F.col("partner_id").alias("negative_id"), "positive_score", score.alias("negative_score"))


#: For vectors of one length with distinct ids, as the given tables hold.
ORACLE = """
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM kept a JOIN kept b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
