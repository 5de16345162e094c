"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.folders import shared_dir


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Cuts lineage in a way that survives lost executors, and lets several later
    jobs read the same intermediate rows without computing them again. The table
    goes when the driver ends, as results may read it until then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark._jvm.org.apache.hadoop.fs.Path(path)
    written.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(written)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """What runs within the block sends its Python tasks at most so many rows at once.

    Spark builds a batch in buffers outside the heap that double as they fill, and
    the worker holds it again, so with batches of 10,000 texts every core needs
    several times their size.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """Return what a finished task held to the system, as its worker is kept for others: Arrow's pool, then malloc's free pages where it can (glibc)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_kept: dict[tuple, object] = {}


def kept(make, *args):
    """make(*args), kept by this process for its next tasks; what another operator kept goes first, as workers outlive operators."""
    if (make, args) not in _kept:
        release()
        _kept[make, args] = make(*args)
    return _kept[make, args]


def release() -> None:
    """Drop what another operator's tasks kept in this process."""
    if _kept:
        _kept.clear()
        give_back()


def frequent(counts: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of a table, read twice, whose count reaches the least threshold that at most ``most`` rows reach.

    The threshold comes from a histogram of the counts (sixteen steps for each
    doubling), so nothing is ranked and little is sent to the driver.
    """
    level = F.floor(F.log2(F.greatest(F.col(count), F.lit(1))) * 16).cast("int")
    bins = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()  # at most 64 * 16 rows
    least, total = None, 0
    for row in bins:
        total += row["n"]
        if total > most:
            break
        least = row["level"]
    return counts.filter(F.lit(False) if least is None else level >= least)


def ascii_lower(text):
    """Column: A-Z to a-z, all else unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stretches(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts in UTF-8) of consecutive stretches of a string column with about ``most`` bytes each; null is empty.

    Python objects are made for one stretch at a time, so memory does not grow
    with the batch; a longer text is a stretch of its own.
    """
    raw = texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary())
    for first, rows in spans_of(texts, most):
        yield first, [x or b"" for x in raw.slice(first, rows).to_pylist()]


def with_text(docs: DataFrame, text_col: str, change) -> DataFrame:
    """docs with every text replaced: ``change()``, called once a task, gives a function from a list of texts, null as None, to new ones.

    Rows are worked on in stretches of a megabyte of text and the other columns
    pass through as they are, so a task holds little beside the batch it reads;
    what it held is given back at its end, as workers are kept for other tasks.
    """
    place = docs.columns.index(text_col)

    def rewrite(batches):
        new = change()
        for batch in batches:
            for first, rows in spans_of(batch.column(place)):
                part = batch.slice(first, rows)
                texts = pa.array(new(part.column(place).to_pylist()), part.schema.field(place).type)
                yield pa.RecordBatch.from_arrays([texts if i == place else c for i, c in enumerate(part.columns)], schema=part.schema)
        give_back()

    return docs.mapInArrow(rewrite, docs.schema)


def where_texts(docs: DataFrame, text_col: str, keeps) -> DataFrame:
    """The rows of docs whose text is kept: ``keeps()``, called once a task, gives a function from a list of texts to booleans."""
    place = docs.columns.index(text_col)

    def choose(batches):
        release()
        chosen = keeps()
        for batch in batches:
            for first, rows in spans_of(batch.column(place)):
                part = batch.slice(first, rows)
                yield part.filter(pa.array(chosen(part.column(place).to_pylist()), pa.bool_()))
        give_back()

    return docs.mapInArrow(choose, docs.schema)


def spans_of(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(first row, rows) of consecutive stretches of a string column with about ``most`` bytes each."""
    first = held = 0
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    for row, size in enumerate(sizes):
        if held and held + size > most:
            yield first, row - first
            first, held = row, 0
        held += size + 1
    if first < len(sizes):
        yield first, len(sizes) - first
