"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of a lexicon of words and word beginnings, how near its
hits stand to the second person, capitals, punctuation, and signs of obfuscated
words. The lexicon is learned: terms that documents labelled toxic hold far
more often than others, by the z-score of the log odds.

The model is fitted on a bounded sample of labelled rows, ``sample_rows``, the
first by hash of the id; every whole text is scored. Of sampled documents that
share their smallest shingle and their label, the one with the smallest id is
learned from, so that copies do not lend one text's words the weight of many.
Labels of rows that are held out are never used. A null text is an empty one; empty texts are scored
too. Null labels and labels without a document are ignored; of several labels
of one id the largest counts. Repeated rows get equal scores; rows with a null
id are scored and are not held out. Without labels of both kinds the score is
the share of toxic labels, 0 without any. Only the named columns are read. An
empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.boosting import BoostedTrees, Isotonic
from shelfmark.llm.common import release, where_texts
from shelfmark.llm.shingles import shingle_sets

_WORD = re.compile(r"\w+")
_ODD = re.compile(r"[^\W\d_]+[0-9@$*#!|]+[^\W\d_]+")
_LONG = re.compile(r"(\w)\1\1")
_MASK = str.maketrans("013457@$!|", "oieastasil")

#: Second-person words of the languages covered.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton vous votre tú ti usted ustedes vosotros".split())

PREFIXES = (4, 5, 6)


def terms(text: str) -> set[str]:
    """The distinct words of a text, and the beginnings of its longer words, marked with a star."""
    found = set(_WORD.findall(text.lower()))
    return found | {w[:n] + "*" for w in found for n in PREFIXES if len(w) > n}


def smallest_shingle(text: Column) -> Column:
    @F.pandas_udf("long")
    def smallest(texts: pd.Series) -> pd.Series:
        release()
        return pd.Series([int(s[0].astype(np.int64)) if len(s) else 0 for s in shingle_sets(texts.tolist())])

    return smallest(text)


class Lexicon:
    """Terms with their weights."""

    def __init__(self, weights: dict[str, float]):
        self.words = {t: w for t, w in weights.items() if not t.endswith("*")}
        self.starts = {t[:-1]: w for t, w in weights.items() if t.endswith("*")}
        self.first = {s[: min(PREFIXES)] for s in self.starts}

    def weight(self, word: str) -> float:
        """The weight of a word, or of its longest known beginning; 0 if there is none."""
        found = self.words.get(word, 0.0)
        if not found and word[: min(PREFIXES)] in self.first:
            found = next((self.starts[word[:n]] for n in reversed(PREFIXES) if word[:n] in self.starts), 0.0)
        return found


NAMES = ("words", "hits", "hit_density", "weight", "weight_density", "heaviest", "distinct", "near_you", "near_share", "you_density", "capitals", "shouted", "exclaimed", "asked", "punctuation", "digits", "odd", "stretched", "masked")


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The values of NAMES for a text."""
    text = text or ""
    low = text.lower()
    words = _WORD.findall(low)
    n = max(1, len(words))
    at = [(i, x) for i, w in enumerate(words) if (x := lexicon.weight(w))]
    near = sum(1 for i, _ in at if not SECOND_PERSON.isdisjoint(words[max(0, i - 3) : i + 4]))
    total = sum(x for _, x in at)
    size = max(1, len(text))
    odd = [m[0] for m in _ODD.finditer(text)] if any(c in text for c in "013457@$*#!|") else []
    shouted = sum(1 for w in text.split() if len(w) > 2 and w.isupper())
    masked = sum(1 for w in odd if lexicon.weight(w.lower().translate(_MASK)))
    capitals = sum(w[:1].isupper() for w in text.split())
    marks = sum(map(text.count, ".,;:!?-()\"'"))
    return [
        math.log1p(len(words)), len(at), len(at) / n, total, total / n, max((x for _, x in at), default=0.0), len({words[i] for i, _ in at}),
        near, near / max(1, len(at)), sum(map(words.count, ("you", "your"))) / n, capitals / n, shouted / n, text.count("!") / n, text.count("?") / n,
        marks / size, sum(map(text.count, "0123456789")) / size, len(odd) / n, (1 if _LONG.search(low) else 0) / n, masked / n,
    ]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


class Model:
    def __init__(self, lexicon: Lexicon, trees: BoostedTrees, calibration: Isotonic | None, share: float):
        self.lexicon, self.trees, self.calibration, self.share = lexicon, trees, calibration, share

    def score(self, texts) -> np.ndarray:
        if self.calibration is None:
            return np.full(len(texts), self.share)
        x = np.array([features(t, self.lexicon) for t in texts]).reshape(len(texts), len(NAMES))
        return self.calibration(self.trees.raw(x))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 30_000, lexicon_size: int = 400) -> Model:
    """The model, from at most sample_rows labelled rows that are not held out."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    chosen = marked.filter(~held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    sample = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    # copies would lend the words of one text the weight of many: one document stays of those with one smallest shingle
    row = F.struct("id", "text", "y")
    sample = sample.groupBy(smallest_shingle(F.col("text")).alias("key"), "y").agg(F.min_by(row, "id").alias("row")).select("row.*")

    def count(batches):
        seen = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"]):
                seen[y].update(terms(text))
                seen[y][""] += 1
            if len(seen[0]) + len(seen[1]) > 400_000:
                yield from flush(seen)
        yield from flush(seen)

    def flush(seen):
        for y, c in ((y, c) for y, c in seen.items() if c):
            yield pd.DataFrame({"term": list(c), "n0": [n * (y == 0) for n in c.values()], "n1": [n * (y == 1) for n in c.values()]})
            c.clear()

    counted = sample.mapInPandas(count, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).cache()
    totals = counted.filter("term = ''").first()
    n0, n1 = (totals["n0"], totals["n1"]) if totals else (0, 0)
    if not n0 or not n1:
        counted.unpersist()
        return Model(Lexicon({}), BoostedTrees(), None, n1 / max(1, n0 + n1))
    odds = F.log((F.col("n1") + 0.5) / (n1 - F.col("n1") + 0.5)) - F.log((F.col("n0") + 0.5) / (n0 - F.col("n0") + 0.5))
    z = F.col("odds") / F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    least = max(4, math.ceil(0.01 * n1))
    best = counted.filter(f"term <> '' and n1 >= {least}").withColumn("odds", odds).withColumn("z", z).filter(f"z >= 2.8 and odds >= {math.log(6)}").orderBy(F.desc("z"), "term").limit(lexicon_size).collect()
    counted.unpersist()
    lexicon = Lexicon({r["term"]: float(r["odds"]) for r in best})

    def measure(batches):
        for batch in (b for b in batches if len(b)):
            x = [features(t, lexicon) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"].astype(str), "y": batch["y"], "x": x})

    rows = sample.mapInPandas(measure, "id string, y int, x array<double>").toPandas().sort_values("id")
    x, y = np.stack(rows["x"].to_numpy()), rows["y"].to_numpy(dtype=float)
    fold = np.arange(len(y)) % 3
    raw = np.zeros(len(y))
    for f in range(3):
        raw[fold == f] = BoostedTrees().fit(x[fold != f], y[fold != f]).raw(x[fold == f])
    return Model(lexicon, BoostedTrees().fit(x, y), Isotonic().fit(raw, y), n1 / (n0 + n1))


def score_column(text: Column, model: Model) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts.tolist()))

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """For each row: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, id_col, text_col, **options)
    scored = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score_column(F.col(text_col), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows whose score reaches the threshold."""
    model = fit(docs, labels, id_col, text_col, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return where_texts(docs, text_col, lambda: lambda texts: (shared.value.score(texts) < threshold).tolist())
