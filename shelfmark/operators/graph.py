"""Graphs of rows that share values: nodes, weighted edges, degrees, components, centrality.

Edges come from an equi-join on shared tokens, not from comparing all pairs; a
token that very many nodes share makes as many pairs as it has, which is the
result itself, and it is cut into blocks that meet as tiles, so no task holds
it whole. ``max_token_nodes`` leaves such tokens out where the caller accepts
fewer edges. Iterations keep their tables in the shared folder and drop each as
soon as it is no longer read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.folders import steps, written
from shelfmark.functions import columns as C
from shelfmark.functions import values
from shelfmark.operators import dedup


def nodes(df: DataFrame, name: str, order: str) -> DataFrame:
    """One node a distinct name: its place is its first row's, its attributes are its last row's."""
    last = df.groupBy(name).agg(F.min(order).alias("node_idx"), F.max_by(F.struct(*[c for c in df.columns if c != name]), order).alias("row"))
    return last.select(F.col(name).alias("node_id"), "node_idx", "row.*")


def edges(node: DataFrame, features: list[str], delimiter: str = ";", least: int = 2, max_token_nodes: int | None = None, strict: bool = False, block_rows: int = 4096, wide: int = 64) -> DataFrame:
    """(src, dst, weight, shared): pairs that share values in at least ``least`` features; weight counts features.

    Where two features are asked for, nodes meet on two values of different
    features at once, so a value that very many nodes have makes no pairs by
    itself. That takes a row for each two values of a node; nodes of more than
    ``wide`` values meet on single ones. ``block_rows``: a token of more nodes is
    cut into blocks. The tokens are written once when this is called.
    Absent features are skipped; with ``strict`` they are an error.
    """
    if strict and (absent := [f for f in features if f not in node.columns]):
        raise ValueError(f"no columns {absent}")
    parts = []
    for f in (f for f in features if f in node.columns):
        drop = any(t in f for t in values.TEXT_FIELDS)
        parts.append(node.select("node_id", "node_idx", F.lit(f).alias("feature"), F.explode(F.array_distinct(C.link_tokens(F.col(f"`{f}`").cast("string"), delimiter, drop))).alias("token")))
    token = parts[0]
    for part in parts[1:]:
        token = token.union(part)
    if max_token_nodes is not None:
        few = token.groupBy("feature", "token").count().filter(F.col("count") <= max_token_nodes).select("feature", "token")
        token = token.join(few, ["feature", "token"], "left_semi")
    token = written(token)
    hot = hot_tokens(token, block_rows)
    if least >= 2:
        return _edges_of_two(token, least, hot, block_rows, wide)
    pairs = _oriented(meeting(token, hot, block_rows))
    per_feature = pairs.groupBy("src", "dst", "feature").agg(F.array_sort(F.collect_list("token")).alias("shared_values"))
    per_pair = per_feature.groupBy("src", "dst").agg(F.count("*").cast("int").alias("weight"), F.array_sort(F.collect_list(F.struct("feature", "shared_values"))).alias("shared"))
    return per_pair.filter(F.col("weight") >= least)


def hot_tokens(token: DataFrame, block_rows: int) -> DataFrame:
    """(feature, token, blocks) of the tokens that hold more than ``block_rows`` nodes and a thousandth of all rows: fewer than a thousand tokens."""
    total = token.count()
    counts = token.groupBy("feature", "token").agg(F.count("*").alias("n")).filter(F.col("n") > max(block_rows, total // 1000))
    return written(counts.select("feature", "token", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")))


def _dealt(token: DataFrame, hot: DataFrame) -> DataFrame:
    """token with its number of blocks, 1 for all but hot tokens, and a node's block."""
    with_blocks = token.join(F.broadcast(hot), ["feature", "token"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return with_blocks.withColumn("block", F.pmod(F.xxhash64("node_id"), F.col("blocks")).cast("int"))


def meeting(token: DataFrame, hot: DataFrame, block_rows: int) -> DataFrame:
    """(feature, token, a, i, b, j): each two nodes of a token once; the blocks of a hot token meet two by two, each two in a key of their own."""
    dealt = _dealt(token, hot)
    one = dealt.select("feature", "token", F.col("node_id").alias("a"), F.col("node_idx").alias("i"), F.col("block").alias("p"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("q"))
    two = dealt.select("feature", "token", F.col("node_id").alias("b"), F.col("node_idx").alias("j"), F.explode(F.sequence(F.lit(0), "block")).alias("p"), F.col("block").alias("q"))
    return one.join(two, ["feature", "token", "p", "q"]).filter((F.col("p") < F.col("q")) & (F.col("i") != F.col("j")) | (F.col("i") < F.col("j"))).drop("p", "q")


def _oriented(pairs: DataFrame) -> DataFrame:
    """(src, dst, feature, token), the node of the lower place first."""
    first = F.col("i") < F.col("j")
    return pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("dst"), "feature", "token")


def _edges_of_two(token: DataFrame, least: int, hot: DataFrame, block_rows: int, wide: int) -> DataFrame:
    """The edges of nodes that share values in two features at least, from (node_id, node_idx, feature, token).

    A node makes a row for each two of its values; one of more than ``wide``
    values, whose rows would grow with their square, is instead met on each of its
    values by all other nodes, and pairs of one feature go.
    """
    held = token.groupBy("node_id", "node_idx").agg(F.array_sort(F.collect_set(F.struct("feature", "token"))).alias("items"))
    large = written(held.filter(F.size("items") > wide).select("node_id", "node_idx", F.explode("items").alias("x")).select("node_id", "node_idx", "x.feature", "x.token"))

    def with_later(x: Column, i: Column) -> Column:
        later = F.filter(F.slice("items", i + 2, F.size("items")), lambda y: y["feature"] != x["feature"])
        return F.transform(later, lambda y: F.xxhash64(x["feature"], x["token"], y["feature"], y["token"]))

    two = held.filter(F.size("items") <= wide).select("node_id", "node_idx", F.explode(F.flatten(F.transform("items", with_later))).alias("two"))
    a = two.select("two", F.col("node_id").alias("src"), F.col("node_idx").alias("i"))
    b = two.select("two", F.col("node_id").alias("dst"), F.col("node_idx").alias("j"))
    pairs = a.join(b, "two").filter("i < j").select("src", "dst").distinct()
    if not large.isEmpty():
        small = _dealt(token, hot).select("feature", "token", "block", F.col("node_id").alias("b"), F.col("node_idx").alias("j"))
        all_blocks = _dealt(large, hot).select("feature", "token", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("node_id").alias("a"), F.col("node_idx").alias("i"))
        met = _oriented(all_blocks.join(small, ["feature", "token", "block"]).filter("i <> j")).groupBy("src", "dst").agg(F.count_distinct("feature").alias("n"))
        pairs = pairs.union(met.filter("n >= 2").select("src", "dst")).distinct()
    both = pairs.join(held.select(F.col("node_id").alias("src"), F.col("items").alias("left")), "src").join(held.select(F.col("node_id").alias("dst"), F.col("items").alias("right")), "dst")
    both = both.withColumn("same", F.array_sort(F.array_intersect("left", "right")))
    features = F.array_distinct(F.transform("same", lambda x: x["feature"]))
    shared = F.transform(features, lambda f: F.struct(f.alias("feature"), F.transform(F.filter("same", lambda x: x["feature"] == f), lambda x: x["token"]).alias("shared_values")))
    return both.select("src", "dst", F.size(features).cast("int").alias("weight"), shared.alias("shared")).filter(F.col("weight") >= least)


def degrees(node: DataFrame, edge: DataFrame) -> DataFrame:
    ends = edge.select(F.col("src").alias("node_id")).union(edge.select("dst")).groupBy("node_id").agg(F.count("*").alias("degree"))
    return node.select("node_id").join(ends, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def min_degree(node: DataFrame, edge: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of at least that degree, once, and the edges between them."""
    kept = degrees(node, edge).filter(F.col("degree") >= least).select("node_id")
    inside = edge.join(kept.withColumnRenamed("node_id", "src"), "src", "left_semi").join(kept.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return node.join(kept, "node_id", "left_semi"), inside


def components(node: DataFrame, edge: DataFrame, hub_rows: int = 10_000) -> DataFrame:
    """(node_id, component): the smallest name reachable, by turning each component into a star around it.

    Two steps alternate until nothing changes: the larger neighbours of every node
    are linked to its smallest one, then its smaller neighbours and itself are. A
    node of more than ``hub_rows`` edges and a thousandth of all, of which there
    are fewer than two thousand, is looked up by broadcast, so no task gathers a hub's
    edges. Runs when called; the rounds' tables are dropped.
    """
    with steps(node.sparkSession) as at:
        link = at.write(edge.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u <> v").distinct())
        seen = None
        while True:
            state = link.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
            if state == seen:
                break
            seen = state
            both = link.union(link.select("v", "u"))
            large = at.write(_to_smallest(at, both, hub_rows).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v").distinct())
            low = _to_smallest(at, large, hub_rows)
            ends = low.select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", "low"))
            new = at.write(ends.filter("u <> v").distinct())
            at.drop(link)
            at.drop(large)
            link = new
        root = written(link.groupBy("u").agg(F.min("v").alias("component")))
    named = node.select("node_id").join(root, node["node_id"] == root["u"], "left")
    return named.select("node_id", F.coalesce("component", "node_id").alias("component"))


def _to_smallest(at, link: DataFrame, hub_rows: int) -> DataFrame:
    """(u, v, low): each link with the smallest of u and all v that u is linked to."""
    low = at.write(link.groupBy("u").agg(F.count("*").alias("n"), F.least("u", F.min("v")).alias("low")))
    limit = max(hub_rows, (low.agg(F.sum("n")).first()[0] or 0) // 1000)
    hubs = F.broadcast(low.filter(F.col("n") > limit).drop("n"))
    rest = low.filter(F.col("n") <= limit).drop("n")
    return link.join(hubs, "u").unionByName(link.join(hubs.select("u"), "u", "left_anti").join(rest, "u"))


def statistics(node: DataFrame, edge: DataFrame) -> DataFrame:
    """Nodes, edges, density, mean and largest degree, number of components."""
    degree = degrees(node, edge).agg(F.count("*").alias("nodes"), F.sum("degree").alias("ends"), F.avg("degree").alias("mean_degree"), F.max("degree").alias("max_degree"))
    groups = components(node, edge).select("component").distinct().agg(F.count("*").alias("components"))
    n, m = F.col("nodes"), F.col("ends") / 2
    density = F.when(n > 1, 2 * m / (n * (n - 1))).otherwise(0.0)
    return degree.crossJoin(groups).select("nodes", m.cast("long").alias("edges"), density.alias("density"), "mean_degree", "max_degree", "components")


def edge_details(edge: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("shared", lambda x: F.concat(x["feature"], F.lit(": "), F.array_join(x["shared_values"], ", "))), "; ")
    return edge.select("src", "dst", "weight", text.alias("shared"))


def adjacency(node: DataFrame, edge: DataFrame) -> DataFrame:
    """Coordinate rows (row, col, weight) of the symmetric matrix; what is not listed is 0."""
    return edge.select(F.col("src").alias("row"), F.col("dst").alias("col"), "weight").union(edge.select("dst", "src", "weight"))


def drivers(edge: DataFrame, k: int = 3) -> DataFrame:
    """The features that connect most pairs."""
    return edge.select(F.explode("shared.feature").alias("feature")).groupBy("feature").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "feature").limit(k)


def node_kind(columns: list[str]) -> str:
    """publication, repository or resource, by the columns that a node has."""
    if {"Repository Link", "Languages"} <= set(columns):
        return "repository"
    return "publication" if {"Title", "Authors"} <= set(columns) else "resource"


def node_colour(kind: str, columns: list[str], by_completeness: bool = False) -> Column:
    """The colour value of a node, 0 to 3: completeness, a repository's score, or the grade of its note."""
    of = lambda name, default: F.coalesce(F.col(f"`{name}`").try_cast("double"), F.lit(default)) if name in columns else F.lit(default)
    if by_completeness:
        return of("Data Completeness", 50.0) / 100 * 3
    if kind == "repository" and "FAIR Score" in columns:
        return of("FAIR Score", 5.0) / 10 * 3
    return C.grade(F.col("`FAIR Compliance Notes`") if "FAIR Compliance Notes" in columns else F.lit(""))


def node_attributes(node: DataFrame, edge: DataFrame, note: str) -> DataFrame:
    """Display size by degree and colour value by grade."""
    degree = degrees(node, edge)
    most = degree.agg(F.greatest(F.max("degree"), F.lit(1)).alias("most"))
    sized = degree.crossJoin(F.broadcast(most)).withColumn("size", 10 + F.col("degree") / F.col("most") * 20).drop("most")
    return sized.join(node.select("node_id", C.grade(F.col(note)).alias("colour")), "node_id")


def pivots_for(nodes: int, error: float, confidence: float) -> int:
    """How many sources of a random sample keep every node's centrality within ``error``, with that confidence.

    A source lends a node a share between 0 and 1 of its pairs, so by Hoeffding's
    bound, over all nodes, ln(2 nodes / (1 - confidence)) / (2 error^2) suffice.
    """
    return min(nodes, math.ceil(math.log(2 * max(1, nodes) / (1 - confidence)) / (2 * error**2)))


def betweenness(node: DataFrame, edge: DataFrame, sources: DataFrame | None = None, exact_nodes: int = 2_000, error: float = 0.05, confidence: float = 0.9, state_rows: int = 50_000_000) -> DataFrame:
    """(node_id, centrality) of the undirected graph, normalised, by level-synchronous searches from many sources at once.

    Exact up to ``exact_nodes`` nodes; beyond, from ``pivots_for`` sources, taken
    by a hash of their names and scaled up, so that every node is within ``error``
    with that confidence; an ``error`` of 0 asks for all sources. ``sources`` takes
    others. Sources go in batches, of which each holds about ``state_rows`` rows;
    a level is compared with the two before it alone, and is written once on the
    way out and once on the way back. Runs when called; what a batch wrote is dropped.
    """
    n = node.count()
    if sources is not None:
        start = sources.select(F.col("node_id").alias("s"))
    else:
        k = n if n <= exact_nodes or error <= 0 else pivots_for(n, error, confidence)
        names = node.select(F.col("node_id").alias("s"))
        start = names if k == n else names.orderBy(F.xxhash64("s"), "s").limit(k)
    start = written(start)
    count = max(1, start.count())
    batches = -(-count * max(1, n) // state_rows)
    both = written(edge.select(F.col("src").alias("v"), F.col("dst").alias("w")).union(edge.select("dst", "src")))
    owed = [_owed_of(start.filter(F.pmod(F.xxhash64("s", F.lit(1)), F.lit(batches)) == i), both) for i in range(batches)]
    total = owed[0]
    for part in owed[1:]:
        total = total.union(part)
    total = total.groupBy("v").agg(F.sum("owed").alias("owed"))
    scale = n / count / ((n - 1) * (n - 2) if n > 2 else 1)
    joined = node.select("node_id").join(total, node["node_id"] == total["v"], "left")
    return joined.select("node_id", (F.coalesce("owed", F.lit(0.0)) * scale).alias("centrality"))


def _owed_of(start: DataFrame, both: DataFrame) -> DataFrame:
    """(v, owed): what the shortest paths from these sources owe to each node, written."""
    with steps(start.sparkSession) as at:
        levels = [at.write(start.select("s", F.col("s").alias("v"), F.lit(1.0).alias("paths")))]
        while True:
            reached = levels[-1].join(both, "v").groupBy("s", F.col("w").alias("v")).agg(F.sum("paths").alias("paths"))
            before = levels[-1].select("s", "v")
            if len(levels) > 1:  # a neighbour of a level is in it, the one before or the next
                before = before.union(levels[-2].select("s", "v"))
            new = at.write(reached.join(before, ["s", "v"], "left_anti"))
            if new.isEmpty():
                break
            levels.append(new)
        here = levels[-1].withColumn("owed", F.lit(0.0))
        sums = [here.select("v", "owed").limit(0)]
        for above in levels[-2::-1]:
            sums.append(here.groupBy("v").agg(F.sum("owed").alias("owed")))
            if above is levels[0]:
                break
            unit = here.select("s", F.col("v").alias("w"), ((1 + F.col("owed")) / F.col("paths")).alias("unit"))
            gained = unit.join(both, "w").groupBy("s", "v").agg(F.sum("unit").alias("unit"))
            here = at.write(above.join(gained, ["s", "v"], "left").select("s", "v", "paths", (F.coalesce("unit", F.lit(0.0)) * F.col("paths")).alias("owed")))
        total = sums[0]
        for part in sums[1:]:
            total = total.union(part)
        return written(total.groupBy("v").agg(F.sum("owed").alias("owed")))


def adjacency_blocks(node: DataFrame, edge: DataFrame, order: str = "node_idx", side: int = 1024) -> DataFrame:
    """(row_block, col_block, rows, cols, weights): the symmetric matrix in blocks of ``side`` rows and columns, for any number of nodes.

    Rows and columns are the places of the nodes in the order, from 0; a block
    lists the entries that are not 0 by row, then column, as places within it, and
    blocks without any are left out. ``numbered_nodes`` gives each place's node.
    """
    place = numbered_nodes(node, order)
    ends = adjacency(node, edge).join(place.select(F.col("node_id").alias("row"), F.col("place").alias("r")), "row").join(place.select(F.col("node_id").alias("col"), F.col("place").alias("c")), "col")
    block = lambda x: F.floor(F.col(x) / side).cast("long")
    entry = F.struct((F.col("r") % side).cast("int").alias("r"), (F.col("c") % side).cast("int").alias("c"), F.col("weight").cast("long").alias("w"))
    grouped = ends.groupBy(block("r").alias("row_block"), block("c").alias("col_block")).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return grouped.select("row_block", "col_block", F.col("entries.r").alias("rows"), F.col("entries.c").alias("cols"), F.col("entries.w").alias("weights"))


def numbered_nodes(node: DataFrame, order: str = "node_idx") -> DataFrame:
    """(node_id, place): each node's place in the order, from 0, written."""
    found = dedup.numbered(node.select("node_id", order), [F.col(order), F.col("node_id")])
    return found.select("node_id", (F.col("place") - 1).alias("place"))


def adjacency_matrix(node: DataFrame, edge: DataFrame, most: int = 1_000) -> DataFrame:
    """The dense matrix, zeros included, for at most ``most`` nodes: a column a node, which is why it is bounded."""
    names = [r["node_id"] for r in node.select("node_id").orderBy("node_idx").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} nodes; use the coordinate rows of adjacency()")
    dense = adjacency(node, edge).groupBy("row").pivot("col", names).agg(F.max("weight"))
    return node.select(F.col("node_id").alias("row")).join(dense, "row", "left").na.fill(0, names)
