"""Groups of similar documents by an n-gram Jaccard join with rare-first prefix filtering.

A document is the set of its word shingles. Two documents link when
``100 * intersection >= percent * union``. Shingles are ordered rare first:
those that are frequent in the corpus come last, by their counts. Linked
documents share a shingle within the first ``n - ceil(percent / 100 * n) + 1``
of that order, so only these prefixes are joined. A pair is dropped if its
sizes, the position of its first common shingle, or the counts of its shingles
by hash range (a bound on what the rest of the sets can share) rule a link out;
what is left is verified once, on whole texts.

Documents with equal sets are one from the start. In the first round every
prefix shingle's documents are paired with one of them alone; in the second,
documents that are still apart and share a prefix shingle are paired, all of
them. So no link between different components is lost, and a large group of
near copies costs a pair a document instead of all its pairs.

Null and empty texts have no shingles and link with nothing. Repeated rows are
copies; ids may be null (such a row can belong to a group, and never names it
unless the whole group has null ids). Only the id and the text are read. An
empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.common import cut, frequent, give_back, release, stretches
from shelfmark.llm.components import components
from shelfmark.llm.shingles import mix, shingle_sets

#: Hash ranges of the suffix filter.
RANGES = 256


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set alone."""
    with np.errstate(over="ignore"):
        m = mix(s + np.uint64(0x632BE59BD9B4E019))
        return int(s.sum(dtype=np.uint64).astype(np.int64)), int(m.sum(dtype=np.uint64).astype(np.int64))


SCAN = "doc_id long, n long, k1 long, k2 long, shingle long, seen long"
PREFIXES = "doc_id long, n long, k1 long, k2 long, prefix array<long>, ranges array<smallint>"


def frame(schema: str, **columns) -> pa.RecordBatch:
    """A batch with the schema's columns; absent ones are null."""
    kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<smallint>": pa.list_(pa.int16())}
    fields = [f.split(" ") for f in schema.split(", ")]
    rows = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[k]) if n in columns else pa.nulls(rows, kinds[k]) for n, k in fields], [n for n, _ in fields])


def scan(docs: DataFrame, width: int, flush: int = 1 << 21) -> DataFrame:
    """Two kinds of rows: each document's set size and key, and the shingles that come again within a stretch of a partition, with their counts."""

    def look(batches):
        release()
        held, size = [], 0

        def repeated():
            shingles, seen = np.unique(np.concatenate(held), return_counts=True)
            again = seen > 1
            return frame(SCAN, shingle=signed(shingles[again]), seen=seen[again])

        for batch in batches:
            ids = batch.column("doc_id")
            for first, texts in stretches(batch.column("text")):
                sets = shingle_sets(texts, width)
                keys = np.array([set_key(s) for s in sets])
                yield frame(SCAN, doc_id=ids.slice(first, len(sets)), n=[len(s) for s in sets], k1=keys[:, 0], k2=keys[:, 1])
                held += sets
                size += sum(map(len, sets))
                if size >= flush:
                    yield repeated()
                    held, size = [], 0
        if held:
            yield repeated()
        give_back()

    return docs.mapInArrow(look, SCAN)


def frequent_shingles(repeated: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles and their counts: the most frequent ones, at most ``most`` of them."""
    counts = repeated.groupBy("shingle").agg(F.sum("seen").alias("seen"))  # few rows beside the texts, so it is cheaper made twice than written
    found = frequent(counts, "seen", most).toPandas()  # at most ``most`` rows
    shingles = found["shingle"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], found["seen"].to_numpy(dtype=np.int64)[order]


def range_counts(s: np.ndarray) -> np.ndarray | None:
    """How many shingles of a set fall in each hash range; None where a count is beyond 16 bits, and no bound is taken then."""
    counts = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=RANGES)
    return counts.astype(np.int16) if counts.max() < 1 << 15 else None


def prefixes(docs: DataFrame, width: int, percent: int, shingles: np.ndarray, seen: np.ndarray) -> DataFrame:
    """Each document's prefix in the rare-first order, and its shingle counts by hash range. shingles: frequent ones, sorted; seen: their counts."""

    def look(batches):
        release()
        for batch in batches:
            ids = batch.column("doc_id")
            for first, texts in stretches(batch.column("text")):
                rows = []
                for at, s in enumerate(shingle_sets(texts, width)):
                    if not len(s):
                        continue
                    place = np.searchsorted(shingles, s)
                    count = np.where(shingles[np.minimum(place, len(shingles) - 1)] == s, seen[np.minimum(place, len(seen) - 1)], 0) if len(shingles) else np.zeros(len(s), np.int64)
                    take = len(s) - -(-percent * len(s) // 100) + 1
                    rows.append((first + at, len(s), *set_key(s), signed(s[np.lexsort((s, count))[:take]]), range_counts(s)))
                if rows:
                    at, n, k1, k2, prefix, ranges = zip(*rows)
                    yield frame(PREFIXES, doc_id=ids.take(pa.array(at)), n=n, k1=k1, k2=k2, prefix=prefix, ranges=ranges)
        give_back()

    return docs.mapInArrow(look, PREFIXES)


def _bounded(percent: int) -> Column:
    """The length and positional filters on a pair (na, pa, nb, pb): pa and pb are the positions of its first common shingle."""
    length = F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")
    shared = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    return length & (shared * (100 + percent) >= F.lit(percent) * (F.col("na") + F.col("nb")))


def _ranges_bound(percent: int) -> Column:
    """The suffix filter: two sets share no more than the smaller count in every hash range."""
    shared = F.aggregate(F.zip_with("ra", "rb", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return F.coalesce(shared * (100 + percent) >= F.lit(percent) * (F.col("na") + F.col("nb")), F.lit(True))


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int, slots: int = 1 << 23) -> DataFrame:
    """The pairs (a, b) of ids that link, by the shingle sets of their whole texts."""
    spark = pairs.sparkSession
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    slot = F.pmod(F.xxhash64(F.col("id")), F.lit(slots))
    maps = ids.select((slot + 1).alias("slot")).groupBy(F.expr("bitmap_bucket_number(slot)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits"))
    bits = bytearray(slots // 8 + 4096)  # a bounded bitmap of the ids in pairs: it only spares the shuffle of other texts
    for row in maps.collect():
        bits[(row["k"] - 1) * 4096 : row["k"] * 4096] = row["bits"]
    shared = spark.sparkContext.broadcast(np.unpackbits(np.frombuffer(bytes(bits), np.uint8), bitorder="little"))

    @F.pandas_udf("boolean")
    def wanted(slots: pd.Series) -> pd.Series:
        return pd.Series(shared.value[slots.to_numpy()].astype(bool))

    texts = docs.withColumn("slot", F.expr(f"pmod(xxhash64(doc_id), {slots}L)")).filter("doc_id is not null").filter(wanted("slot")).select("doc_id", "text")
    texts = cut(texts, "texts")
    both = pairs.select("a", "b").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")

    def check(batches):
        release()
        for batch in batches:
            a, b, lefts = (batch.column(c) for c in ("a", "b", "text_a"))
            for first, texts in stretches(batch.column("text_b")):
                ids = a.slice(first, len(texts)).to_pylist()
                at = {}
                for i, x in enumerate(ids):
                    at.setdefault(x, first + i)
                left = dict(zip(at, shingle_sets(lefts.take(pa.array(list(at.values()))).cast(pa.binary()).to_pylist(), width)))
                keep = []
                for x, right in zip(ids, shingle_sets(texts, width)):
                    same = len(np.intersect1d(left[x], right, assume_unique=True))
                    keep.append(100 * same >= percent * (len(left[x]) + len(right) - same) and same > 0)
                mask = pa.array(keep)
                yield pa.RecordBatch.from_arrays([c.slice(first, len(texts)).filter(mask) for c in (a, b)], ["a", "b"])
        give_back()

    return both.mapInArrow(check, "a long, b long")


def similar_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 75,
    most_frequent: int = 1 << 18,
) -> DataFrame:
    """For each row: doc_id, n_shingles, component_id.

    ``most_frequent`` bounds the table of frequent shingles that orders the sets; it
    changes the work and not the result, as any one order gives all links.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seen = cut(scan(docs, width), "scan")
    key = ["n", "k1", "k2"]
    sets = seen.filter("n is not null").select("doc_id", *key)
    reps = sets.filter("n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"))
    ranked = prefixes(docs, width, percent, *frequent_shingles(seen.filter("shingle is not null"), most_frequent))
    one = cut(ranked.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"), F.first("ranges").alias("ranges")).filter("rep is not null"), "prefixes")
    info = one.select("rep", "n", "ranges")
    within = W.partitionBy("shingle").orderBy("rep")
    entry = one.select("rep", "n", F.posexplode("prefix").alias("pos", "shingle"))
    shared = (
        entry.withColumn("hub", F.first(F.struct("rep", "n", "pos")).over(within))
        .withColumn("before", F.lag("rep").over(within))
        .withColumn("after", F.lead("rep").over(within))
        .filter("before is not null or after is not null")
        .select("shingle", "rep", "n", "pos", "hub")
    )
    shared = cut(shared, "shared")

    def candidates(rows: DataFrame) -> DataFrame:
        """Pairs that pass the filters, from (a, na, pa, b, nb, pb) for every prefix shingle that a and b share."""
        pairs = rows.groupBy("a", "b", "na", "nb").agg(F.min(F.struct("pa", "pb")).alias("p")).select("a", "b", "na", "nb", "p.pa", "p.pb").filter(_bounded(percent))
        pairs = pairs.join(info.select(F.col("rep").alias("a"), F.col("ranges").alias("ra")), "a").join(info.select(F.col("rep").alias("b"), F.col("ranges").alias("rb")), "b")
        return cut(pairs.filter(_ranges_bound(percent)).select("a", "b"), "pairs")

    near = candidates(shared.filter("rep <> hub.rep").select(F.col("hub.rep").alias("a"), F.col("hub.n").alias("na"), F.col("hub.pos").alias("pa"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb")))
    links = cut(verified(near, docs, width, percent), "verified")
    joined = components(links)
    labelled = shared.drop("hub").join(joined.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    apart = labelled.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("shingle")
    labelled = cut(labelled.join(apart, "shingle"), "apart")
    # sizes that can link are in one band or in two that adjoin, so a shingle's documents meet by band and not all with all
    band = F.floor(F.log(F.col("n")) / math.log(100 / min(percent, 99)))
    a, b = (labelled.select("shingle", band.alias("band"), F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p{x}"), F.col("component").alias(f"c{x}")) for x in "ab")
    b = b.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    rest = candidates(a.join(b, ["shingle", "band"]).filter(F.col("ca") != F.col("cb")).filter("a < b").filter(_bounded(percent)))
    more = verified(rest.join(near, ["a", "b"], "left_anti"), docs, width, percent)
    joined = components(links.union(more))
    member = reps.join(joined.withColumnRenamed("id", "rep"), "rep", "left").select(*key, F.coalesce("component", "rep").alias("component_id"))
    return sets.join(member, key, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that belong to a group under another id."""
    groups = similar_groups(docs, id_col, text_col, **options)
    away = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(away, id_col, "left_anti").select(*docs.columns)
