"""Counts, rankings, word frequencies and numeric summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.folders import steps, written
from shelfmark.functions import columns as C


def top_k(df: DataFrame, value: Column, k: int, first_seen: Column | None = None) -> DataFrame:
    """(value, n) of the k most frequent values; ties to the one seen first, or else to the smaller."""
    seen = first_seen if first_seen is not None else F.lit(0)
    counted = df.select(value.alias("value"), seen.alias("seen")).filter("value is not null").groupBy("value").agg(F.count("*").alias("n"), F.min("seen").alias("seen"))
    return counted.orderBy(F.desc("n"), "seen", "value").limit(k).select("value", "n")


def heavy_top_k(df: DataFrame, value: Column, k: int, tracked: int = 10_000) -> DataFrame:
    """The same rows as ``top_k``, ties to the smaller value, without a shuffle of all distinct values where few are frequent.

    Tasks keep frequent-item summaries of ``tracked`` values, which merge; what
    they name is counted again, exactly. A value that they do not name occurs less
    often than their bound, 3.5 / tracked of the rows, so if the k-th count is
    above that, none was missed; if not, all values are counted. Runs when called.
    """
    x = df.select(value.alias("value")).filter("value is not null")
    sketch = x.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(value, {tracked}, {tracked}).item").alias("named")).first()
    named = sketch["named"] or []  # at most ``tracked`` values
    if len(named) >= k:
        wanted = df.sparkSession.createDataFrame([(v,) for v in named], x.schema)
        counted = x.join(F.broadcast(wanted), "value").groupBy("value").agg(F.count("*").alias("n"))
        best = written(counted.orderBy(F.desc("n"), "value").limit(k))
        if best.agg(F.min("n")).first()[0] > 3.5 * sketch["n"] / tracked:
            return best
    return top_k(df, value, k)


def distinct_sketches(df: DataFrame, by: list[str], value: Column, lg: int = 12) -> DataFrame:
    """(by..., sketch): a mergeable summary of each group's distinct values, a few kilobytes each, to be stored and merged later."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(value, F.lit(lg)).alias("sketch"))


def distinct_from(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by..., distinct): about how many distinct values the sketches of each group saw together, within 1.04 / sqrt(2 ** lg) in one standard deviation."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


def exploded(df: DataFrame, column: str, delimiters: str = ";", keep_blank: bool = False) -> DataFrame:
    """df with ``value``, one row an item of a list in text; blank items stay only if asked for."""
    if keep_blank:
        pattern = "[" + "".join("\\" + d for d in delimiters) + "]"
        return df.withColumn("value", F.explode(F.transform(F.split(column, pattern), C.strip)))
    return df.withColumn("value", F.explode(C.split_list(F.col(column), delimiters)))


def distinct_values(df: DataFrame, column: str, delimiters: str = ";,") -> DataFrame:
    return exploded(df, column, delimiters).select("value").distinct().orderBy("value")


def word_frequencies(df: DataFrame, doc: str, text: str, stopwords: list[str], least: int = 3, k: int = 10, by_document: bool = False) -> DataFrame:
    """The k words that occur most, with (occurrences, % of words) or (documents, % of documents with a text)."""
    words = F.explode(F.split(F.lower(text), r"[;,\s\-_/()]+"))
    kept = df.filter(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), words.alias("word")).filter((F.length("word") >= least) & F.col("word").rlike(r"^\p{L}+$") & ~F.col("word").isin(*stopwords))
    # one row a word and document, so the distinct count needs no second shuffle of all words
    per_doc = kept.groupBy("word", "doc").agg(F.count("*").alias("n"))
    counted = per_doc.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    documents = df.agg(F.count(text).alias("documents"))
    total = counted.agg(F.sum("n").alias("total"))
    value = F.col("docs") if by_document else F.col("n")
    whole = F.col("documents") if by_document else F.col("total")
    best = counted.orderBy(F.desc("n"), "word").limit(k)
    return best.crossJoin(F.broadcast(documents)).crossJoin(F.broadcast(total)).select("word", value.alias("count"), (value / whole * 100).alias("pct"))


def numeric_summary(df: DataFrame, number: Column, accuracy: int | None = None) -> DataFrame:
    """n, mean, median, least, largest and population deviation.

    The exact median comes from ``quantiles``, which runs when this is called;
    ``accuracy`` asks for an approximate one instead, within a share of
    1 / accuracy of the rows, in one pass.
    """
    x = df.select(number.alias("x")).filter("x is not null")
    rest = [F.count("x").alias("n"), F.avg("x").alias("mean")], [F.min("x").alias("min"), F.max("x").alias("max"), F.stddev_pop("x").alias("std")]
    if accuracy is not None:
        return x.agg(*rest[0], F.percentile_approx("x", F.lit(0.5), F.lit(accuracy)).alias("median"), *rest[1])
    median = quantiles(x, F.col("x"), [0.5]).select(F.get("quantiles", 0).alias("median"))
    return x.agg(*rest[0], *rest[1]).crossJoin(F.broadcast(median)).select("n", "mean", "median", "min", "max", "std")


def quantiles(df: DataFrame, value: Column, probabilities: list[float], by: list[str] | None = None, small: int = 100_000, bins: int = 1024, accuracy: int = 10_000) -> DataFrame:
    """(by..., quantiles): exact quantiles of each group, interpolated between neighbours, NaN above all numbers, null left out.

    A sketch says where each lies. Rows are counted in bins between the two values
    it names, and below and above; the bin that holds the wanted rank gives the
    next two values, until two neighbours or one value are left, or at most
    ``small`` rows, which are then sorted. Nothing holds all distinct values, and
    a bad sketch costs rounds and not the result. Runs when called; a table of at
    most ``small`` rows takes one pass.
    """
    by = by or []
    x = df.select(*by, value.cast("double").alias("_x")).filter("_x is not null")
    if x.count() <= small:
        return x.groupBy(*by).agg(F.percentile("_x", F.array(*map(F.lit, probabilities))).alias("quantiles"))
    ends = [end for p in probabilities for end in (max(0.0, p - 2 / accuracy), min(1.0, p + 2 / accuracy))]
    known = x.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("_x", F.array(*map(F.lit, ends)), F.lit(accuracy)).alias("ends"))
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.lit(float(p)).alias("p"), F.get("ends", 2 * i).alias("low"), F.get("ends", 2 * i + 1).alias("high")) for i, p in enumerate(probabilities)]))
    place = F.col("p") * (F.col("n") - 1)
    state = known.withColumn("q", asked).select(*by, "n", "q.*").withColumns({"place": place, "first": F.floor(place), "last": F.ceil(place), "below": F.lit(0).cast("long"), "a": F.lit(None).cast("double"), "b": F.lit(None).cast("double"), "inside": F.col("n")})
    with steps(df.sparkSession) as at:
        state = at.write(state)
        whole = True
        while True:
            state = at.write(_narrowed(x, state, by, bins, whole, small))
            whole = False
            if state.filter((F.col("inside") > small) & F.col("a").isNull()).isEmpty():
                break
        left = _with_state(x, state.filter("a is null"), by).filter("_x between low and high").groupBy(*by, "t").agg(F.array_sort(F.collect_list("_x")).alias("sorted"))
        joined = state.join(left, [*by, "t"], "left") if not by else state.join(left.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("t").alias("_t"), "sorted"), _same(by) & (F.col("t") == F.col("_t")), "left")
        at_rank = lambda r: F.get("sorted", (F.col(r) - F.col("below")).cast("int"))
        a, b = F.coalesce("a", at_rank("first")), F.coalesce("b", at_rank("last"))
        exact = F.when(F.col("first") == F.col("last"), a).otherwise((F.col("last") - F.col("place")) * a + (F.col("place") - F.col("first")) * b)
        found = joined.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("t", exact.alias("v")))).alias("q"))
        return written(found.select(*by, F.col("q.v").alias("quantiles")))


def _same(by: list[str]) -> Column:
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return on


def _with_state(x: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """x with each of the states of its group."""
    if not by:
        return x.crossJoin(F.broadcast(state))  # a row a quantile
    return x.join(state.select(*[F.col(c).alias(f"_{c}") for c in by], *[c for c in state.columns if c not in by]), _same(by))


def _narrowed(x: DataFrame, state: DataFrame, by: list[str], bins: int, whole: bool, small: int) -> DataFrame:
    """The states after counting rows in bins between low and high; with ``whole`` also what is below and above."""
    open_states = state.filter("a is null") if whole else state.filter((F.col("inside") > small) & F.col("a").isNull())
    largest = 1.7e308
    low, high = F.greatest("low", F.lit(-largest)) / 2, F.least("high", F.lit(largest)) / 2
    inner = F.least(F.floor((F.col("_x") / 2 - low) / (high - low) * bins), F.lit(bins - 1))
    bin_of = F.when(F.col("_x") < F.col("low"), -1).when(F.col("_x") > F.col("high"), bins).when(F.col("_x") == F.col("low"), 0).when(F.col("_x") == F.col("high"), bins - 1).otherwise(F.greatest(inner, F.lit(0)))
    rows = _with_state(x, open_states, by)
    rows = rows if whole else rows.filter("_x between low and high")
    counted = rows.groupBy(*by, "t", bin_of.cast("int").alias("bin")).agg(F.count("*").alias("m"), F.min("_x").alias("least"), F.max("_x").alias("most"), F.first("first").alias("first"), F.first("last").alias("last"), F.first("below").alias("below"))
    before = F.coalesce(F.sum("m").over(W.partitionBy(*by, "t").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    here = counted.withColumn("before", before)
    holds = lambda r: (F.col("before") <= F.col(r) - F.col("below")) & (F.col(r) - F.col("below") < F.col("before") + F.col("m"))
    of = lambda c, r: F.max(F.when(holds(r), F.col(c)))
    ends = here.groupBy(*by, "t").agg(of("least", "first").alias("_low"), of("most", "last").alias("_high"), of("most", "first").alias("_a"), of("least", "last").alias("_b"), of("before", "first").alias("_before"), of("bin", "first").alias("_bin"), of("bin", "last").alias("_bin2"), of("before", "last").alias("_before2"), of("m", "last").alias("_m2"))
    named = ends.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("t").alias("_t"), *[c for c in ends.columns if c.startswith("_")])
    joined = state.join(named, _same(by) & (F.col("t") == F.col("_t")), "left")
    apart, one = F.col("_bin") != F.col("_bin2"), F.col("_low") == F.col("_high")
    was = F.col("_bin").isNull()
    pick = lambda new, old: F.when(was, F.col(old)).otherwise(new).alias(old)
    return joined.select(
        *by, "n", "t", "p", pick(F.col("_low"), "low"), pick(F.col("_high"), "high"), "place", "first", "last", pick(F.col("below") + F.col("_before"), "below"),
        pick(F.when(apart, F.col("_a")).when(one, F.col("_low")), "a"), pick(F.when(apart, F.col("_b")).when(one, F.col("_low")), "b"), pick(F.col("_before2") + F.col("_m2") - F.col("_before"), "inside"),
    )


def histogram(df: DataFrame, number: Column, edges: list[float]) -> DataFrame:
    """(bin, low, high, n) on fixed edges of equal width; the last bin is closed, empty bins stay."""
    bins = df.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, low double, high double")
    width = edges[1] - edges[0]
    place = F.least(F.floor((number - edges[0]) / width), F.lit(len(edges) - 2)).cast("int")
    counted = df.select(number.alias("x"), place.alias("bin")).filter((F.col("x") >= edges[0]) & (F.col("x") <= edges[-1])).groupBy("bin").agg(F.count("*").alias("n"))
    return bins.join(counted, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def shares(df: DataFrame, label: Column, skip: str | None = None) -> DataFrame:
    """(label, n, pct) over the rows whose label is not the one to skip."""
    counted = df.select(label.alias("label")).filter(F.lit(True) if skip is None else F.col("label") != skip).groupBy("label").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("total") * 100).alias("pct"))


def pivot_counts(df: DataFrame, row: Column, label: Column, labels: list[str]) -> DataFrame:
    """A row a value, a column a label, by row total."""
    counted = df.select(row.alias("row"), label.alias("label")).groupBy("row").pivot("label", labels).count().na.fill(0)
    total = sum((F.col(x) for x in labels[1:]), F.col(labels[0]))
    return counted.withColumn("total", total).orderBy(F.desc("total"), "row")


def method_metrics(df: DataFrame, method: str, study: str, ident: str) -> DataFrame:
    """Per method: records, unique ids, their share, studies hit, most and median records a study."""
    per_study = written(df.groupBy(method, study).agg(F.count("*").alias("n")))
    median = quantiles(per_study, F.col("n"), [0.5], [method]).select(F.col(method).alias("_method"), F.get("quantiles", 0).alias("median"))
    studies = per_study.groupBy(method).agg(F.count("*").alias("studies"), F.max("n").alias("most"), F.sum("n").alias("records"))
    studies = studies.join(median, F.col(method).eqNullSafe(F.col("_method"))).drop("_method")
    unique = df.groupBy(method, ident).agg(F.lit(1).alias("one")).groupBy(method).agg(F.count("*").alias("unique_ids"))
    return studies.join(unique, method).withColumn("unique_pct", F.col("unique_ids") / F.col("records") * 100)


def method_tops(df: DataFrame, method: str, study: str, authors: str, studies: int = 10, names: int = 5) -> DataFrame:
    """(method, kind, place, value, n): each method's studies with most records, and the authors named most."""

    def top(values: DataFrame, kind: str, k: int) -> DataFrame:
        counted = values.groupBy(method, "value").agg(F.count("*").alias("n"))
        place = F.row_number().over(W.partitionBy(method).orderBy(F.desc("n"), "value"))
        return counted.withColumn("place", place).filter(F.col("place") <= k).select(F.col(method).alias("method"), F.lit(kind).alias("kind"), "place", "value", "n")

    by_study = df.select(method, F.col(study).cast("string").alias("value")).filter("value is not null")
    by_author = df.select(method, F.explode(C.split_list(F.col(authors))).alias("value"))
    return top(by_study, "study", studies).union(top(by_author, "author", names))


def divergence(a: DataFrame, b: DataFrame, key: str, quantile: float = 0.85) -> DataFrame:
    """Two count tables side by side: winner, difference, and whether it is among the largest or one-sided."""
    both = a.withColumnRenamed("n", "a").join(b.withColumnRenamed("n", "b"), key, "full_outer").na.fill(0, ["a", "b"])
    both = both.withColumn("diff", F.abs(F.col("a") - F.col("b"))).withColumn("winner", F.when(F.col("a") > F.col("b"), "a").when(F.col("a") < F.col("b"), "b").otherwise("tie"))
    both = written(both)
    cutoff = quantiles(both, F.when(F.col("diff") > 0, F.col("diff")), [quantile]).select(F.get("quantiles", 0).alias("cutoff"))
    return both.crossJoin(F.broadcast(cutoff)).select(key, "a", "b", "diff", "winner", (F.col("diff") >= F.col("cutoff")).alias("top"), ((F.col("a") == 0) | (F.col("b") == 0)).alias("one_sided"))


def subset_vs_full(full: DataFrame, subset: DataFrame, value: Column, k: int = 5) -> DataFrame:
    """The k most frequent values of a subset and of the whole, with their counts."""
    return top_k(subset, value, k).withColumn("scope", F.lit("subset")).union(top_k(full, value, k).withColumn("scope", F.lit("full")))


def subset_share(full: DataFrame, subset: DataFrame) -> DataFrame:
    """(subset, full, pct): how many records of all are looked at."""
    both = subset.agg(F.count("*").alias("subset")).crossJoin(full.agg(F.count("*").alias("full")))
    return both.withColumn("pct", F.when(F.col("full") > 0, F.col("subset") / F.col("full") * 100).otherwise(0.0))


def density(df: DataFrame, group: Column, number: Column, points: int = 200, least: int = 3) -> DataFrame:
    """(group, point, x, density) of the base-10 logs on an even grid over all of them, with Scott's bandwidth.

    The grid is small and fixed, so the sum is one aggregate over values times points.
    """
    logs = df.select(group.alias("grp"), F.log10(number).alias("v")).filter("v is not null")
    spans = logs.groupBy("grp").agg(F.count("*").alias("n"), F.stddev_samp("v").alias("sd")).filter((F.col("n") >= least) & (F.col("sd") > 0))
    ends = logs.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    distinct = logs.groupBy("grp", "v").agg(F.count("*").alias("m"))
    grid = distinct.join(F.broadcast(spans), "grp").crossJoin(F.broadcast(ends)).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    grid = grid.withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / (points - 1)).withColumn("h", F.col("sd") * F.pow("n", F.lit(-0.2)))
    kernel = F.col("m") * F.exp(-0.5 * F.pow((F.col("x") - F.col("v")) / F.col("h"), F.lit(2))) / (F.col("n") * F.col("h") * (2 * 3.141592653589793) ** 0.5)
    return grid.groupBy("grp", "point").agg(F.first("x").alias("x"), F.sum(kernel).alias("density"))


def binned_density(df: DataFrame, group: Column, number: Column, points: int = 200, least: int = 3, fineness: int = 4096, reach: float = 8.0) -> DataFrame:
    """The same as ``density``, for any number of distinct values: rows follow bins, not values.

    Each value is shared between the two nearest of the bins, ``fineness`` to a
    bandwidth h, and each bin reaches the grid points within ``reach`` bandwidths.
    The first is off by at most 0.05 / fineness**2 / h, the second by less than
    0.4 exp(-reach**2 / 2) / h.
    """
    logs = df.select(group.alias("grp"), F.log10(number).alias("v")).filter("v is not null")
    spans = logs.groupBy("grp").agg(F.count("*").alias("n"), F.stddev_samp("v").alias("sd")).filter((F.col("n") >= least) & (F.col("sd") > 0))
    ends = logs.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    known = written(spans.crossJoin(ends).withColumn("h", F.col("sd") * F.pow("n", F.lit(-0.2))).withColumn("width", F.col("h") / fineness))
    place = (F.col("v") - F.col("lo")) / F.col("width")
    shared = logs.join(F.broadcast(known), "grp").select("grp", F.floor(place).alias("bin"), (place - F.floor(place)).alias("f"))
    counted = shared.groupBy("grp", "bin").agg(F.sum(1 - F.col("f")).alias("near"), F.sum("f").alias("far"))
    ends_of = F.explode(F.array(F.struct(F.col("bin").alias("at"), F.col("near").alias("m")), F.struct((F.col("bin") + 1).alias("at"), F.col("far").alias("m"))))
    nodes = counted.select("grp", ends_of.alias("b")).groupBy("grp", F.col("b.at").alias("at")).agg(F.sum("b.m").alias("m")).filter("m > 0")
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    v = F.col("lo") + F.col("at") * F.col("width")
    first = F.greatest(F.ceil((v - reach * F.col("h") - F.col("lo")) / step), F.lit(0))
    last = F.least(F.floor((v + reach * F.col("h") - F.col("lo")) / step), F.lit(points - 1))
    met = nodes.join(F.broadcast(known), "grp").withColumn("v", v).withColumn("first", first).withColumn("last", last).filter("first <= last").withColumn("point", F.explode(F.sequence("first", "last")))
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / (points - 1)
    kernel = F.col("m") * F.exp(-0.5 * F.pow((x - F.col("v")) / F.col("h"), F.lit(2))) / (F.col("n") * F.col("h") * (2 * 3.141592653589793) ** 0.5)
    summed = met.groupBy("grp", F.col("point").cast("int").alias("point")).agg(F.sum(kernel).alias("density"))
    grid = known.select("grp", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"), "lo", "hi")
    filled = grid.join(summed, ["grp", "point"], "left")
    return filled.select("grp", "point", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / (points - 1)).alias("x"), F.coalesce("density", F.lit(0.0)).alias("density"))
