"""Personal data: fixed patterns, and contextual extraction bootstrapped from them.

The fixed patterns find emails, IP addresses, card and phone numbers. Their
whole matches are the seeds, blanks included. Every other run of
identifier-like tokens (with a digit, @, an underscore or a dot inside) is a
candidate, and so is every token of such a run; seeds and candidates are the
instances, and the words outside an occurrence are its lexical patterns. On the
graph of patterns and instances, a pattern's confidence is the share of its
distinct instances that are known, kept low while they are few; an instance's
is the noisy or of its patterns'. Instances that reach the threshold are known
in the next round. Candidates that a high-confidence pattern surrounds, or whose
instance became known, are added as ``context`` spans where no other span is;
of spans in one another the longest stays. What became known is looked for in
other places only if it has an @ or four digits: less does not tell who it is.

All steps are DataFrame operations. Positions are code points, end exclusive.
Null and empty texts have no spans. Repeated rows are occurrences of their own
and get equal spans; null ids are passed through. Only the id and the text are
read. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import cut

#: In the order in which spans with one start are listed; the last is the bootstrapped one.
KINDS = ("email", "ip", "card", "phone", "context")

#: The kind's pattern, written so that no text makes the engine go back over it again and again:
#: runs are taken whole, and start only where no run goes on or where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: A kind is looked for only in texts with this.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}

_SPACE = r"[\x20\x09-\x0D]"
_TOKEN = r"[^\x20\x09-\x0D]"
#: Stands for each character of the fixed patterns' matches while candidates are looked for.
_MASK = "\uE000"
_PLAIN = rf"[^\x20\x09-\x0D{_MASK}]"
_LIKE = rf"(?=(?:[^\x20\x09-\x0D{_MASK}0-9@_.]|\.(?![A-Za-z0-9]))*+[0-9@_.]){_PLAIN}++"
#: A masked match, or a run of identifier-like tokens.
INSTANCE = rf"{_MASK}++|(?<!{_PLAIN}){_LIKE}(?:{_SPACE}{_LIKE})*+"

SPAN = "struct<start:int,end:int,kind:int,text:string>"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    values = F.split(F.reverse(number), "")
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0))) % 10 == 0


def _keeps(kind: str, text: Column) -> Column:
    n = F.length(digits(text))
    if kind == "ip":
        part = F.split(text, r"\.")
        return ~F.exists(part, lambda p: p.rlike("^0*+[0-9]{4}") | (F.right(p, F.lit(3)).cast("int") > 255))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits(text))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def located(text: Column, pattern: str) -> Column:
    """An array of (start, end, before, text, after) for every match: before and after are what stands up to the neighbouring matches.

    Matches and what is between them are zipped once and placed by a running
    sum. What is placed is held in stretches of 64, so that a text with very
    many matches is not copied again for each of them.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    apart = F.split(text, pattern, -1)
    items = F.filter(F.arrays_zip(apart.alias("before"), found.alias("text"), F.slice(apart, 2, 1 << 30).alias("after")), lambda m: m["text"].isNotNull())
    kind = "array<struct<start:int,end:int,before:string,text:string,after:string>>"

    def step(state, m):
        start = state["at"] + F.length(m["before"])
        end = start + F.length(m["text"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), m["before"].alias("before"), m["text"].alias("text"), m["after"].alias("after")))
        full = F.size(state["some"]) >= 64
        return F.struct(
            end.alias("at"),
            F.when(full, one).otherwise(F.concat(state["some"], one)).alias("some"),
            F.when(full, F.concat(state["done"], F.array(state["some"]))).otherwise(state["done"]).alias("done"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("some"), F.array().cast(f"array<{kind}>").alias("done"))
    return F.aggregate(items, start, step, lambda s: F.concat(F.flatten(s["done"]), s["some"]))


def base_spans(text: Column) -> Column:
    """An array of (start, end, kind number, text) of the fixed patterns' matches, by start and then kind."""
    nothing = F.array().cast(f"array<{SPAN}>")

    def of(number: int, kind: str) -> Column:
        kept = F.filter(located(text, PATTERNS[kind]), lambda m: _keeps(kind, m["text"]))
        spans = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(number).alias("kind"), m["text"].alias("text")))
        return F.when(F.coalesce(text.rlike(HINTS[kind]), F.lit(False)), spans).otherwise(nothing)

    return F.array_sort(F.concat(*[of(k, kind) for k, kind in enumerate(PATTERNS)]))


_WORD, _APART = r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]"


def masked(text: Column, spans: Column) -> Column:
    """text with each character that a span covers replaced by the mask."""

    def cover(state: Column, s: Column) -> Column:
        return F.concat(state.substr(F.lit(1), s["start"]), F.repeat(F.lit(_MASK), s["end"] - s["start"]), state.substr(s["end"] + 1, F.length(state)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, text, cover)).otherwise(text)


def words_before(before: Column) -> tuple[Column, Column]:
    """The last word of a text and the one before it, in lower case, each whole however long it or the blanks around it are.

    They are looked for near the end first; where they are not complete there, in all of it.
    """
    near = F.right(before, F.lit(100))

    def word(rest: str) -> Column:
        close = F.regexp_extract(near, rf"{_APART}({_WORD}++){rest}{_APART}*+$", 1)
        return F.lower(F.when(close != "", close).otherwise(F.regexp_extract(before, rf"(?<!{_WORD})({_WORD}++){rest}{_APART}*+$", 1)))

    return word(""), word(rf"{_APART}++{_WORD}++")


def instances(text: Column, hidden: Column) -> Column:
    """An array of (start, end, text, seed, second, left, right) of the instances of a text, hidden being the masked text: the two words before, and the one after."""

    def one(m: Column) -> Column:
        seed = m["text"].startswith(_MASK)
        left, second = words_before(m["before"])
        return F.struct(
            m["start"].alias("start"),
            m["end"].alias("end"),
            F.when(seed, text.substr(m["start"] + 1, m["end"] - m["start"])).otherwise(m["text"]).alias("text"),
            seed.alias("seed"),
            second.alias("second"),
            left.alias("left"),
            F.lower(F.regexp_extract(m["after"], rf"^{_APART}*+({_WORD}++)", 1)).alias("right"),
        )

    some = F.coalesce(hidden.rlike(rf"[0-9@_{_MASK}]|\.[A-Za-z0-9]"), F.lit(False))
    return F.when(some, F.transform(located(hidden, INSTANCE), one))


def occurrences(rows: DataFrame) -> DataFrame:
    """(row, start, end, instance, seed, patterns) of every instance and of every token of a run of several, from (row, instances).

    Of the tokens of a run only the first has words on a side of its own, those before.
    """
    whole = rows.select("row", F.explode("instances").alias("m")).select("row", "m.*")
    patterns = F.array(F.concat_ws(" ", "second", "left", F.lit("*")), F.concat_ws(" ", "left", F.lit("*"), "right"))
    none = F.array().cast("array<string>")
    whole = whole.withColumn("patterns", F.when(F.col("left") == "", none).otherwise(patterns)).select("row", "start", "end", "text", "seed", "patterns")
    runs = whole.filter(~F.col("seed") & F.col("text").rlike(_SPACE))
    parts = runs.withColumn("m", F.explode(located(F.col("text"), rf"{_TOKEN}++")))
    first = F.when(F.col("m.start") == 0, F.slice("patterns", 1, 1)).otherwise(none)
    parts = parts.select("row", (F.col("start") + F.col("m.start")).alias("start"), (F.col("start") + F.col("m.end")).alias("end"), F.col("m.text").alias("text"), "seed", first.alias("patterns"))
    both = whole.union(parts)
    core = F.when(F.col("seed"), F.col("text")).otherwise(F.regexp_extract("text", r"(?s)[A-Za-z0-9](?:.*[A-Za-z0-9])?", 0))
    lead = F.when(F.col("seed"), 0).otherwise(F.length(F.regexp_extract("text", r"^[^A-Za-z0-9]*+", 0)))
    both = both.withColumn("instance", core).withColumn("start", F.col("start") + lead).filter("instance <> ''")
    return both.select("row", "start", (F.col("start") + F.length("instance")).alias("end"), "instance", "seed", "patterns")


def pattern_scores(links: DataFrame, known: DataFrame) -> DataFrame:
    """(pattern, confidence) from distinct (pattern, instance) and the known instances: the lower bound of known / all, one of each being unseen yet."""
    marked = links.join(known.withColumn("known", F.lit(1)), "instance", "left")
    return marked.groupBy("pattern").agg(F.count("*").alias("n"), F.sum(F.coalesce("known", F.lit(0))).alias("k")).select("pattern", "n", "k", (F.col("k") / (F.col("n") + 1)).alias("confidence"))


def bootstrap(found: DataFrame, rounds: int = 2, threshold: float = 0.8, support: int = 4) -> tuple[DataFrame, DataFrame]:
    """High-confidence patterns, and the instances that became known, from occurrences."""
    links = cut(found.select(F.explode("patterns").alias("pattern"), "instance").distinct(), "patterns")
    known = seeds = found.filter("seed").select("instance").distinct()
    for _ in range(rounds):
        scores = pattern_scores(links, known).filter(f"k >= {support}")
        weight = F.sum(F.log(F.lit(1.0) - F.least(F.col("confidence"), F.lit(0.999))))
        reached = links.join(scores, "pattern").groupBy("instance").agg((1 - F.exp(weight)).alias("score")).filter(F.col("score") >= threshold).select("instance")
        known = cut(seeds.union(reached).distinct(), "known")
    patterns = pattern_scores(links, known).filter(f"k >= {support} and confidence >= {threshold}").select("pattern")
    return patterns, known.join(seeds, "instance", "left_anti")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """For each row: doc_id and spans, an array of (start, end, kind) by start and then kind."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    plain = F.transform(base_spans(F.col("text")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    rows = rows.withColumn("spans", plain).withColumn("hidden", masked(F.col("text"), F.col("spans")))
    based = cut(rows.select("doc_id", "row", "spans", instances(F.col("text"), F.col("hidden")).alias("instances")), "based")
    found = cut(occurrences(based), "occurrences")
    patterns, reached = bootstrap(found, **options)
    free = found.filter("not seed").select("row", "start", "end", "instance", F.explode_outer("patterns").alias("pattern"))
    by_pattern = free.join(patterns, "pattern", "left_semi").select("row", "start", "end")
    telling = reached.filter(F.col("instance").contains("@") | (F.length(digits(F.col("instance"))) >= 4))
    by_instance = free.join(telling, "instance", "left_semi").select("row", "start", "end")
    added = by_pattern.union(by_instance).distinct().groupBy("row").agg(F.collect_list(F.struct("start", "end", F.lit(len(KINDS) - 1).alias("kind"))).alias("more"))
    inside = lambda x, y: (y["start"] <= x["start"]) & (x["end"] <= y["end"]) & (y["end"] - y["start"] > x["end"] - x["start"])
    added = added.withColumn("more", F.filter("more", lambda x: ~F.exists("more", lambda y: inside(x, y))))
    spans = F.array_sort(F.concat("spans", F.coalesce("more", F.array().cast("array<struct<start:int,end:int,kind:int>>"))), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))
    name = F.array(*map(F.lit, KINDS))
    return based.join(added, "row", "left").select("doc_id", F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(name, s["kind"]).alias("kind"))).alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: counts by kind, the digest of the base spans, all spans."""
    found = find_pii(docs)
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "context")
    return found.select("doc_id", *map(of, KINDS[:4]), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), of("context"))
