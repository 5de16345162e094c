"""Mix sources to target weights with a multivariate-hypergeometric splitting tree.

Targets: sources in code-point order, null last, weigh 3, 1, 2, repeating; they
share ``share`` of all words, and none gets more than ``most`` times its own.

Every source's documents fall by hash into blocks, 256 for a source, 4,096 or
65,536 when there are very many rows. A source's target is so many whole passes
over its blocks and a rest; the rest takes blocks in a hashed order, the last of
them in part. Each block taken is one unit of the source's quota. A binary tree
over the output shards splits the units: at each node a random half of its
units, all sources together, goes left, which draws the sources' counts from the
multivariate hypergeometric distribution. Each shard then draws, for its count
of a source, the next blocks of the source's hashed permutation, so the shards'
draws are disjoint, and shuffles its documents. The tree's depth follows from
the number of rows, so a shard stays near ``SHARD_ROWS`` rows.

Where whole documents are wanted (``mix_documents``), a draw of a part of a
document is none or whole, whichever is nearer. Only the last document of a
source's last block can be drawn in part, so a source's words then miss its
target by half a document at most. Documents without words are never drawn.

All choices hash ids with the seed, so reruns agree. A null text has no words;
a null id hashes like an empty one; a null source is a source. Repeated rows
are documents of their own. Only the named columns are read. An empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WEIGHTS = (3, 1, 2)

#: Rows for each shard, and up to how many rows blocks are named by two or by three hexadecimal digits.
SHARD_ROWS = 1 << 14
BLOCK_ROWS = (1 << 22, 1 << 28)


def tree_depth(rows: int) -> int:
    """Levels of the tree: 4 at least, 16 at most."""
    return max(4, min(16, max(0, -(-rows // SHARD_ROWS) - 1).bit_length()))


def block_digits(rows: int) -> int:
    return 2 + sum(rows > most for most in BLOCK_ROWS)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(*parts) -> Column:
    return F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, (str, int)) else p.cast("string") for p in parts]).cast("binary"))


def source_targets(sizes: DataFrame, share: float, most: float, weights=WEIGHTS) -> DataFrame:
    """(src, source_size, target) from (src, source, source_size): weighted shares, with what goes beyond a source's limit shared again.

    Sources are few, so the windows here are over the table of sources alone.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("place", F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
    )
    order = W.orderBy(F.col("cap") / F.col("weight"), "place")
    ranked = (
        ranked.withColumn("rank", F.row_number().over(order))
        .withColumn("capped", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("all_words", F.sum("source_size").over(W.partitionBy()))
        .withColumn("level", (F.col("all_words") * F.lit(float(share)) - F.col("capped")) / F.col("left_weight"))
    )
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("rank", "level"))
    level = F.min(fits).over(W.partitionBy())["level"]
    return ranked.withColumn("water", level).select("src", "source_size", F.least("cap", F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target"))


def split_quotas(units: DataFrame, depth: int, seed: str) -> DataFrame:
    """(src, slot, shard): the shard of every unit of every source's quota, given (src, slot).

    At each level a random half of a node's units goes left. The table has at
    most sources x 65,536 x 3 rows, whatever the number of documents.
    """
    node = units.withColumn("shard", F.lit(0))
    for level in range(depth):
        here = W.partitionBy("shard")
        drawn = F.row_number().over(here.orderBy(_key(seed, level, F.col("src"), F.col("slot")), "src", "slot"))
        right = (drawn * 2 > F.count("*").over(here) + 1).cast("int")
        node = node.withColumn("right", right).withColumn("shard", F.col("shard") * 2 + F.col("right")).drop("right")
    return node


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    most: float = 2.0,
    depth: int | None = None,
    seed: str = "mix",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """For each row: doc_id, size, source_size, target, draws (array of its shard and words for each time it is taken), taken (the words of its draws), and the columns of keep, under their names after kept_.

    ``depth``: the shards are 2 ** depth; by default it follows from the number of rows.
    """
    n_rows = docs.count()
    depth = tree_depth(n_rows) if depth is None else depth
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("src"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        *[F.col(c).alias(f"kept_{c}") for c in keep],
    ).withColumn("hash", _key(seed, "doc", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("block", F.substring("hash", 1, block_digits(n_rows)))
    blocks = rows.groupBy("src", "source", "block").agg(F.sum("size").alias("words"))
    targets = source_targets(blocks.groupBy("src", "source").agg(F.sum("words").alias("source_size")), share, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("passes", passes.cast("int")).withColumn("need", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
    order = W.partitionBy("src").orderBy(_key(seed, "rest", F.col("src"), F.col("block")), "block")
    drawn = (
        blocks.join(targets, "src")
        .withColumn("before", F.coalesce(F.sum("words").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest", F.greatest(F.lit(0), F.least("words", F.col("need") - F.col("before"))))
        .withColumn("copies", F.col("passes") + F.when(F.col("rest") > 0, 1).otherwise(0))
    )
    units = drawn.filter("copies > 0").select("src", "block", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    slot = F.row_number().over(W.partitionBy("src").orderBy(_key(seed, "unit", F.col("src"), F.col("block"), F.col("copy")), "block", "copy"))
    units = units.withColumn("slot", slot)
    quotas = split_quotas(units.select("src", "slot"), depth, seed)
    ranges = quotas.withColumn("turn", F.row_number().over(W.partitionBy("src").orderBy("shard", "slot"))).select("src", F.col("turn").alias("slot"), "shard")
    shards = units.join(ranges, ["src", "slot"]).groupBy("src", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("shards"))
    plan = drawn.drop("source", "words", "before", "need").join(shards, ["src", "block"], "left")
    within = W.partitionBy("src", "block").orderBy("hash", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.coalesce(F.sum("size").over(within), F.lit(0))))
    draws = F.filter(
        F.transform(F.coalesce(F.col("shards"), F.array().cast("array<struct<copy:int,shard:int>>")), lambda x: F.struct(x["shard"].alias("shard"), F.when(x["copy"] <= F.col("passes"), F.col("size")).otherwise(F.col("part")).alias("words"))),
        lambda x: x["words"] > 0,
    )
    return (
        rows.join(plan, ["src", "block"])
        .withColumn("part", part.cast("long"))
        .withColumn("draws", draws)
        .withColumn("taken", F.aggregate("draws", F.lit(0).cast("long"), lambda words, x: words + x["words"]))
        .select("doc_id", "size", "source_size", "target", "taken", "draws", *[F.col(f"kept_{c}") for c in keep])
    )


def mix_documents(docs: DataFrame, id_col: str = "doc_id", depth: int | None = None, **options) -> DataFrame:
    """The rows of docs, each once for every time that the mix takes half of it or more, with its shard, shuffled within shards; a partition a shard."""
    keep = tuple(docs.columns)
    depth = tree_depth(docs.count()) if depth is None else depth
    plan = mix_plan(docs, id_col=id_col, keep=keep, depth=depth, **options)
    copies = plan.withColumn("draw", F.explode("draws")).filter(F.col("draw.words") * 2 >= F.col("size"))
    names = [F.col(f"kept_{c}").alias(c) for c in keep]
    key = _key(options.get("seed", "mix"), "order", F.col("draw.shard"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return copies.withColumn("mix_shard", F.col("draw.shard")).repartition(1 << depth, "mix_shard").withColumn("mix_key", key).sortWithinPartitions("mix_shard", "mix_key").select(*names, *([] if "mix_shard" in keep else ["mix_shard"]))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, and shards: shard:words of every draw, comma-joined. taken adds up what the shards draw."""
    draws = F.array_join(F.transform("draws", lambda x: F.concat_ws(":", x["shard"].cast("string"), x["words"].cast("string"))), ",")
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken", draws.alias("shards"))


#: The same in SQL, the tree over the shards as a recursion.
ORACLE = r"""
WITH RECURSIVE total AS (
  SELECT 2 + (count(*) > 4194304)::INT + (count(*) > 268435456)::INT AS digits,
         greatest(4, least(16, ceil(log2(greatest(1, ceil(count(*) / 16384.0))))))::INT AS depth
  FROM documents
), d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce('=' || source, '') AS src, md5('mix:doc:' || coalesce(doc_id::VARCHAR, '')) AS hash,
         row_number() OVER () AS nth
  FROM documents
), e AS (
  SELECT d.*, substr(hash, 1, (SELECT digits FROM total)) AS block FROM d
), b AS (
  SELECT src, source, block, sum(size)::BIGINT AS words FROM e GROUP BY ALL
), s AS (
  SELECT src, source, sum(words)::BIGINT AS source_size FROM b GROUP BY ALL
), w AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight,
         row_number() OVER (ORDER BY source IS NULL, source) AS place, source_size * 2.0::DOUBLE AS cap
  FROM s
), r AS (
  SELECT *, row_number() OVER o AS rank,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight,
         sum(source_size) OVER () AS all_words
  FROM w WINDOW o AS (ORDER BY cap / weight, place)
), l AS (
  SELECT *, (all_words * 1.5::DOUBLE - capped) / left_weight AS level FROM r
), t AS (
  SELECT src, source_size, least(cap, coalesce((SELECT arg_min(level, rank) FROM l WHERE level * weight <= cap) * weight, cap)) AS target FROM l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM t
), n AS (
  SELECT *, round(target - passes * source_size)::BIGINT AS need FROM p
), x AS (
  SELECT b.src, b.block, b.words, n.source_size, n.target, n.passes, n.need,
         coalesce(sum(b.words) OVER (PARTITION BY b.src ORDER BY md5('mix:rest:' || b.src || ':' || b.block), b.block
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM b JOIN n ON b.src = n.src
), y AS (
  SELECT *, greatest(0, least(words, need - before)) AS rest FROM x
), u AS (
  SELECT src, block, copy, row_number() OVER (PARTITION BY src ORDER BY md5('mix:unit:' || src || ':' || block || ':' || copy), block, copy) AS slot
  FROM (SELECT src, block, unnest(range(1, passes + 1 + (rest > 0)::INT)) AS copy FROM y)
), tree AS (
  SELECT 0 AS lev, src, slot, 0::BIGINT AS shard FROM u
  UNION ALL
  SELECT lev + 1, src, slot,
         shard * 2 + (2 * row_number() OVER (PARTITION BY shard ORDER BY md5('mix:' || lev || ':' || src || ':' || slot), src, slot) > count(*) OVER (PARTITION BY shard) + 1)::INT
  FROM tree WHERE lev < (SELECT depth FROM total)
), q AS (
  SELECT src, shard, row_number() OVER (PARTITION BY src ORDER BY shard, slot) AS slot FROM tree WHERE lev = (SELECT depth FROM total)
), g AS (
  SELECT u.src, u.block, u.copy, q.shard FROM u JOIN q ON u.src = q.src AND u.slot = q.slot
), z AS (
  SELECT e.nth, e.doc_id, e.src, e.block, e.size, y.source_size, y.target, y.passes,
         greatest(0, least(e.size, y.rest - coalesce(sum(e.size) OVER (
            PARTITION BY e.src, e.block ORDER BY e.hash, e.doc_id, e.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS part
  FROM e JOIN y ON e.src = y.src AND e.block = y.block
), h AS (
  SELECT z.nth, g.copy, g.shard, CASE WHEN g.copy <= z.passes THEN z.size ELSE z.part END AS words
  FROM z JOIN g ON z.src = g.src AND z.block = g.block
), f AS (
  SELECT nth, sum(words)::BIGINT AS taken, string_agg(shard || ':' || words::BIGINT, ',' ORDER BY copy) AS shards FROM h WHERE words > 0 GROUP BY nth
)
SELECT z.doc_id, z.size, z.source_size, z.target, coalesce(f.taken, 0)::BIGINT AS taken, coalesce(f.shards, '') AS shards FROM z LEFT JOIN f ON z.nth = f.nth
"""
