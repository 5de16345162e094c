"""Literature-search expressions, and their match against a local corpus."""

from __future__ import annotations

from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from shelfmark.folders import written
from shelfmark.functions import columns as C
from shelfmark.functions import values
from shelfmark.operators.filters import disease_terms


def quoted(items: Column, field: str) -> Column:
    """("a"[field] OR "b"[field]), null if there is no item."""
    text = F.array_join(F.transform(items, lambda x: F.concat(F.lit('"'), x, F.lit(f'"[{field}]'))), " OR ")
    return F.when(F.size(items) > 0, F.concat(F.lit("("), text, F.lit(")")))


def date_range(as_of: Column, years: int = 3) -> Column:
    day = lambda c: F.date_format(c, "yyyy/MM/dd")
    return F.concat(F.lit("("), day(F.date_sub(as_of, 365 * years)), F.lit(":"), day(as_of), F.lit("[Date - Publication])"))


def names_v1(name: Column, abbreviation: Column) -> Column:
    terms = F.array(F.when(name != "", name), F.when((abbreviation != "") & (abbreviation != name), abbreviation))
    return F.filter(terms, lambda x: x.isNotNull())


def names_v2(name: Column, abbreviation: Column) -> Column:
    """Without a bracketed end of the name, and without abbreviations that are common words."""
    clean = C.strip(F.regexp_replace(name, r"\s*\([^)]*\)\s*$", ""))
    short = C.strip(abbreviation)
    terms = F.array(F.when(clean != "", clean), F.when((short != "") & (short != name) & ~F.lower(short).isin(*values.NOISY_ABBREVIATIONS), short))
    return F.filter(terms, lambda x: x.isNotNull())


def search_v1(name: Column, abbreviation: Column, diseases: Column, modalities: Column, as_of: Column) -> Column:
    terms = disease_terms(C.split_list(diseases))
    return F.concat_ws(" AND ", quoted(names_v1(name, abbreviation), "All Fields"), quoted(terms, "All Fields"), date_range(as_of), quoted(F.slice(C.split_list(modalities, ","), 1, 5), "All Fields"))


def search_v2(name: Column, abbreviation: Column, as_of: Column) -> Column:
    return F.concat_ws(" AND ", quoted(names_v2(name, abbreviation), "tiab"), date_range(as_of))


def search_v3(name: Column, abbreviation: Column, diseases: Column, modalities: Column, as_of: Column) -> Column:
    """The names of v2 with the diseases (one for each keyword they hold) and modalities of v1."""
    terms = disease_terms(C.split_list(diseases), repeat=True)
    return F.concat_ws(" AND ", quoted(names_v2(name, abbreviation), "tiab"), quoted(terms, "All Fields"), date_range(as_of), quoted(F.slice(C.split_list(modalities, ","), 1, 5), "All Fields"))


def search_modalities(coarse: Column, granular: Column) -> Column:
    """Coarse items (on commas) and granular ones (on semicolons), joined."""
    return F.array_join(F.concat(C.split_list(coarse, ","), C.split_list(granular, ";")), ",")


def corpus_match(docs: DataFrame, doc: str, text: str, phrases: DataFrame, ident: str, phrase: str, most_chars: int = 2_000_000) -> DataFrame:
    """(doc, ident) where the text contains the phrase whatever its case, each pair once.

    Texts stay where they are: each task runs them through one automaton of all
    phrases, in time that follows the texts and the matches and not the number of
    phrases. ``most_chars`` bounds the phrases of an automaton; more of them are
    dealt by hash into several, and the texts pass once for each. Null texts and
    phrases match nothing; an empty phrase is in every text.
    """
    wanted = written(phrases.select(F.col(ident).alias("ident"), F.lower(F.col(phrase)).alias("phrase")).filter("phrase is not null").distinct())
    size = wanted.agg(F.sum(F.length("phrase") + 16)).first()[0] or 0
    parts = max(1, -(-size // most_chars))
    texts = docs.select(F.col(doc).alias("doc"), F.lower(F.col(text)).alias("text")).filter("text is not null")
    some = lambda i: wanted.filter(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == i)
    found = reduce(DataFrame.union, [phrase_hits(texts, some(i)) for i in range(parts)])
    return found.select(F.col("doc").alias(doc), F.col("ident").alias(ident)).distinct()


def phrase_hits(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, ident) for (doc, text) and (ident, phrase), the latter few enough to be sent to every task."""
    sent = texts.sparkSession.sparkContext.broadcast(wanted.select("ident", "phrase").toArrow().combine_chunks())
    shape = StructType([texts.schema["doc"], wanted.schema["ident"]])

    def run(batches):
        idents, held = sent.value.column("ident"), PhraseSet(sent.value.column("phrase").to_pylist())
        idents = idents.chunk(0) if idents.num_chunks else None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [held.rows_in(t) for t in part.column(1).to_pylist()]
                place = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int32())
                if len(place):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(place), idents.take(pa.array([r for rows in found for r in rows], pa.int32()))], ["doc", "ident"])

    return texts.select("doc", "text").mapInArrow(run, shape)


class PhraseSet:
    """An automaton that finds all of many phrases in one walk through a text."""

    def __init__(self, phrases: list[str]):
        rows: dict[str, list[int]] = {}
        for row, phrase in enumerate(phrases):
            rows.setdefault(phrase, []).append(row)
        self.always = rows.pop("", [])
        self.rows = list(rows.values())
        self.automaton = ahocorasick.Automaton()
        for number, phrase in enumerate(rows):
            self.automaton.add_word(phrase, number)
        self.automaton.make_automaton()

    def rows_in(self, text: str) -> list[int]:
        """The rows of the phrases that the text contains."""
        numbers = {number for _, number in self.automaton.iter(text)} if self.rows else ()
        return [*self.always, *(row for number in sorted(numbers) for row in self.rows[number])]


def found_phrases(texts: DataFrame, phrases: DataFrame, most_chars: int = 2_000_000) -> DataFrame:
    """(doc, numbers) for (doc, text) and (number, phrase), each phrase once: what a text contains, a row for each text and automaton that finds something."""
    size = phrases.agg(F.sum(F.length("phrase") + 16)).first()[0] or 0
    parts = max(1, -(-size // most_chars))
    lower = texts.select("doc", F.lower("text").alias("text")).filter("text is not null")
    shape = StructType([texts.schema["doc"], StructField("numbers", ArrayType(LongType()))])

    def hits(some: DataFrame) -> DataFrame:
        sent = texts.sparkSession.sparkContext.broadcast(some.select("number", "phrase").toArrow())

        def run(batches):
            numbers, held = sent.value.column("number").to_numpy(), PhraseSet(sent.value.column("phrase").to_pylist())
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    found = [held.rows_in(t) for t in part.column(1).to_pylist()]
                    place = pa.array([i for i, rows in enumerate(found) if rows], pa.int32())
                    if len(place):
                        lists = pa.array([numbers[rows] for rows in found if rows], pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_arrays([part.column(0).take(place), lists], ["doc", "numbers"])

        return lower.mapInArrow(run, shape)

    return reduce(DataFrame.union, [hits(phrases.filter(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == i)) for i in range(parts)])


class Searches:
    """Studies by the clause of theirs that the fewest texts meet; those that ask for the same are looked at once."""

    def __init__(self, clauses: list[list[list[int]]]):
        same: dict[tuple, list[int]] = {}
        for row, found in enumerate(clauses):
            same.setdefault(tuple(map(tuple, found)), []).append(row)
        self.rows = [np.array(rows) for rows in same.values()]
        self.others = [[frozenset(c) for c in found[1:]] for found in same]
        self.by_number: dict[int, list[int]] = {}
        for search, (first, *_) in enumerate(same):
            for number in first:
                self.by_number.setdefault(number, []).append(search)

    def met(self, numbers: list[int]) -> list[np.ndarray]:
        """The rows of the studies all of whose clauses hold one of the numbers."""
        some = {search for n in numbers for search in self.by_number.get(n, ())}
        return [self.rows[search] for search in sorted(some) if not any(c.isdisjoint(numbers) for c in self.others[search])]


def studies_met(found: DataFrame, asked: DataFrame, most_pairs: int = 1 << 16) -> DataFrame:
    """(doc, ident) for (doc, numbers), each doc once, and (ident, clauses), few enough of these to be sent to every task."""
    sent = found.sparkSession.sparkContext.broadcast(asked.select("ident", "clauses").toArrow().combine_chunks())
    shape = StructType([found.schema["doc"], asked.schema["ident"]])

    def run(batches):
        if not sent.value.num_rows:
            return
        idents, held = sent.value.column("ident").chunk(0), Searches(sent.value.column("clauses").to_pylist())

        def batch_of(docs, places, rows):
            place = np.repeat(places, [len(r) for r in rows])
            return pa.RecordBatch.from_arrays([docs.take(pa.array(place)), idents.take(pa.array(np.concatenate(rows)))], ["doc", "ident"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                places, rows, size = [], [], 0
                for place, numbers in enumerate(part.column(1).to_pylist()):
                    for some in held.met(numbers):
                        places.append(place)
                        rows.append(some)
                        size += len(some)
                        if size >= most_pairs:
                            yield batch_of(part.column(0), places, rows)
                            places, rows, size = [], [], 0
                if rows:
                    yield batch_of(part.column(0), places, rows)

    return found.mapInArrow(run, shape)


def corpus_search(docs: DataFrame, doc: str, text: str, day: str, studies: DataFrame, ident: str, groups: dict[str, Column], as_of: Column, years: int = 3, most_asked: int = 1 << 20) -> DataFrame:
    """(doc, ident) where a text passes a study's search: one phrase at least of each of its groups, and a day within the last years.

    ``groups``: arrays of phrases (names, diseases, modalities, ...); an empty
    group asks for nothing, and a study without any group is left out. Texts of
    one doc count together.

    The phrases that a text contains, each once and numbered, stay one row a
    text. The searches are looked up from them in the same place, each by the
    group that the fewest texts meet, so no row is made for a study of which
    only a part is met, and nothing but the result grows with texts times
    studies. ``most_asked`` bounds the phrases of the studies that are sent to a
    task; the rows pass once for each part of more of them.
    """
    parts = [studies.select(F.col(ident).alias("ident"), F.lit(name).alias("grp"), F.explode(phrases).alias("phrase")) for name, phrases in groups.items()]
    wanted = written(reduce(DataFrame.union, parts).select("ident", "grp", F.lower("phrase").alias("phrase")).filter("phrase <> '' and ident is not null").distinct())
    numbered = written(wanted.select("phrase").distinct().withColumn("number", F.monotonically_increasing_id()))
    recent = docs.filter(F.col(day).between(F.date_sub(as_of, 365 * years), as_of)).select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    found = written(found_phrases(recent, numbered))
    again = written(found.groupBy("doc").count().filter("count > 1").select(F.col("doc").alias("again")))
    if not again.isEmpty():
        same = F.col("doc").eqNullSafe(F.col("again"))
        joined = found.join(again, same, "left_semi").select("doc", F.explode("numbers").alias("number")).distinct().groupBy("doc").agg(F.collect_list("number").alias("numbers"))
        found = found.join(again, same, "left_anti").union(joined)
    spread = found.select(F.explode("numbers").alias("number")).groupBy("number").agg(F.count("*").alias("texts"))
    clauses = wanted.join(numbered, "phrase").join(spread, "number", "left").groupBy("ident", "grp").agg(F.coalesce(F.sum("texts"), F.lit(0)).alias("texts"), F.sort_array(F.collect_list("number")).alias("numbers"))
    asked = clauses.groupBy("ident").agg(F.sort_array(F.collect_list(F.struct("texts", "numbers"))).alias("found"), F.sum(F.size("numbers")).alias("size"))
    asked = written(asked.filter(F.col("found")[0]["texts"] > 0).select("ident", F.col("found")["numbers"].alias("clauses"), "size"))
    turns = max(1, -(-(asked.agg(F.sum("size")).first()[0] or 0) // most_asked))
    met = reduce(DataFrame.union, [studies_met(found, asked.filter(F.pmod(F.xxhash64("ident"), F.lit(turns)) == i)) for i in range(turns)])
    return met.select(F.col("doc").alias(doc), F.col("ident").alias(ident))


def criteria_search(version: int, docs: DataFrame, doc: str, text: str, day: str, studies: DataFrame, ident: str, name: str, abbreviation: str, diseases: str, modalities: str, as_of: Column, years: int = 3) -> DataFrame:
    """(doc, ident) where a text meets what the search expression of version 1, 2 or 3 of a study asks for."""
    return corpus_search(docs, doc, text, day, studies, ident, search_groups(version, *map(F.col, (name, abbreviation, diseases, modalities))), as_of, years)


def search_groups(version: int, name: Column, abbreviation: Column, diseases: Column, modalities: Column) -> dict[str, Column]:
    """The groups of phrases that the search expressions of version 1, 2 or 3 ask for; terms for diseases are the expressions'."""
    names = names_v1(name, abbreviation) if version == 1 else names_v2(name, abbreviation)
    if version == 2:
        return {"names": names}
    return {"names": names, "diseases": disease_terms(C.split_list(diseases)), "modalities": F.slice(C.split_list(modalities, ","), 1, 5)}


def search_grid(studies: DataFrame, abbreviation: str, words: list[str]) -> DataFrame:
    """Every study with an abbreviation, once a word: "{abbreviation} {word}"."""
    each = F.explode(F.array(*map(F.lit, words)))
    return studies.filter(C.filled(F.col(abbreviation))).withColumn("word", each).withColumn("search", F.concat_ws(" ", abbreviation, "word"))
