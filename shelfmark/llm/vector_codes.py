"""Vector code compression: a codebook entry's number for each part of a vector, by memoised grid cells.

Components become integers, vectors are cut into equal parts, and each part
position has a codebook that a few rounds of assigning and averaging improve.
An assignment need not look at all entries: the space of a part is cut into a
grid of cells, and in one cell only those entries can be nearest that are not
farther from all of it than some other entry is at most: entries whose least
distance from the cell exceeds the smallest largest distance of any entry are
left out. The entries that are left are kept by cell, and only they are
evaluated, exactly, for the parts that fall into that cell.

Vectors that are null or hold null or non-finite components are dropped; zero
vectors stay. Vectors of each length have codebooks of their own; a length that
the parts do not divide is filled up with zeros, and an empty vector has the
code of zeros alone. With fewer vectors than entries there are fewer entries.
Null ids come last where the smallest ids are taken, equal ids by vector.
Scaled components stop at 2**24 on either side. Sums of errors beyond a long
are null. Repeated rows are rows of their own. Columns other than the id, the
vector and the label are not read, so their names cannot clash. An empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.common import cut
from shelfmark.llm.vectors import finite, scaled


class Cells:
    """Nearest entries of one part's codebook; the entries that can be nearest in a cell are kept, for ``most`` cells."""

    def __init__(self, book: np.ndarray, width: int, most: int):
        self.book, self.width, self.most = book, width, most
        self.kept: dict[bytes, np.ndarray] = {}
        self.mix = np.random.default_rng(1).integers(1, 1 << 62, book.shape[1]) | 1

    def distinct(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A row of each distinct cell, and each row's place among these: by hash, and by the cells themselves should two share one."""
        _, first, place = np.unique((cells * self.mix).sum(axis=1), return_index=True, return_inverse=True)
        if not np.array_equal(cells[first][place], cells):
            _, first, place = np.unique(cells, axis=0, return_index=True, return_inverse=True)
        return first, place.reshape(-1)

    def undominated(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each cell the numbers of the entries that no entry is always nearer than."""
        low = (cells * self.width)[:, None, :]
        high = low + self.width - 1
        least = np.maximum(np.maximum(low - self.book, self.book - high), 0)
        most = np.maximum(np.abs(self.book - low), np.abs(self.book - high))
        least, most = (least * least).sum(axis=2), (most * most).sum(axis=2)
        return [np.flatnonzero(x) for x in least <= most.min(axis=1, keepdims=True)]

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry, ties to the lower one, and squared distance."""
        cells = rows // self.width
        first, place = self.distinct(cells)
        names = [x.tobytes() for x in cells[first]]
        new = [i for i, name in enumerate(names) if name not in self.kept]
        if new:
            if len(self.kept) + len(new) > self.most:
                self.kept = {name: self.kept[name] for name in names if name in self.kept}
            for at in range(0, len(new), 1024):
                some = new[at : at + 1024]
                self.kept.update(zip((names[i] for i in some), self.undominated(cells[first][some])))
        entries = [self.kept[name] for name in names]
        sizes = np.array([len(x) for x in entries])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        count = sizes[place]
        begin = np.concatenate([[0], np.cumsum(count)[:-1]])
        row = np.repeat(np.arange(len(rows)), count)
        entry = np.concatenate(entries)[np.arange(len(row)) - np.repeat(begin - starts[place], count)]
        away = rows[row] - self.book[entry]
        distance = (away * away).sum(axis=1)
        best = np.minimum.reduceat(distance, begin)
        return np.minimum.reduceat(np.where(distance == best[row], entry, len(self.book)), begin), best


class Assigner:
    """Assigns the parts of vectors of one length."""

    def __init__(self, books: np.ndarray, width: int, most: int):
        self.parts = [Cells(book, width, most) for book in books]

    def assign(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and squared distances, a column for each part."""
        split = rows.reshape(len(rows), len(self.parts), -1)
        found = [part.nearest(split[:, i]) for i, part in enumerate(self.parts)]
        return np.stack([n for n, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int) -> DataFrame:
    """(vec_id, label, d, q): the vectors that are kept, as integers, filled up to a multiple of ``parts``."""
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v")).filter(finite(F.col("v")))
    missing = F.pmod(-F.size("v"), F.lit(parts))
    return rows.select("vec_id", "label", F.size("v").alias("d"), F.concat(scaled(F.col("v")), F.array_repeat(F.lit(0), missing)).alias("q"))


def batches_of(batches, rows: int):
    """(columns before the last two, d, matrix) of the rows of one length in stretches of Arrow batches whose last columns are d and q."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            d = part.column(part.num_columns - 2).to_numpy()
            for length in np.unique(d):
                some = part.filter(pa.array(d == length))
                flat = some.column(some.num_columns - 1).flatten().to_numpy(zero_copy_only=False)
                yield some.columns[:-2], int(length), flat.astype(np.int64).reshape(some.num_rows, -1)


SUMS = "d int, part int, entry int, n long, sums array<long>"


def train(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, width: int = 32, cells: int = 16_384) -> dict[int, np.ndarray]:
    """Codebooks by length (part, entry, position), from all rows of ``integers``.

    They start as the parts of the smallest ids. Each round assigns all parts,
    adds them up within tasks, then over all, and floors the averages; an entry
    that no part chose stays. Only codebooks and their sums reach the driver.
    """
    turn = F.row_number().over(W.partitionBy("d").orderBy(F.col("vec_id").asc_nulls_last(), "q"))
    first = rows.select("d", "q", turn.alias("turn")).filter(F.col("turn") <= entries).orderBy("d", "turn").collect()
    books = {}
    for d in sorted({r["d"] for r in first}):
        q = np.array([r["q"] for r in first if r["d"] == d], dtype=np.int64)
        books[d] = q.reshape(len(q), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        add = adder(books, width, cells)
        sums = rows.select("d", "q").mapInArrow(add, SUMS)
        total = sums.select("d", "part", "entry", "n", F.posexplode_outer("sums").alias("at", "sum"))
        total = total.groupBy("d", "part", "entry", F.coalesce("at", F.lit(-1)).alias("at")).agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"))
        for r in total.collect():  # as many rows as the codebooks have components
            if r["at"] >= 0:
                books[r["d"]][r["part"], r["entry"], r["at"]] = r["sum"] // r["n"]
    return books


def adder(books: dict[int, np.ndarray], width: int, cells: int):
    """For mapInArrow: a task's number and sums of the parts nearest to each entry."""

    def add(batches):
        by = {d: Assigner(b, width, cells) for d, b in books.items()}
        n = {d: np.zeros(b.shape[:2], dtype=np.int64) for d, b in books.items()}
        sums = {d: np.zeros_like(b) for d, b in books.items()}
        for _, d, q in batches_of(batches, 4096):
            chosen = by[d].assign(q)[0]
            split = q.reshape(len(q), *np.array(books[d].shape)[[0, 2]])
            for part in range(chosen.shape[1]):
                np.add.at(sums[d][part], chosen[:, part], split[:, part])
                n[d][part] += np.bincount(chosen[:, part], minlength=n[d].shape[1])
        for d in books:
            part, entry = np.nonzero(n[d])
            if len(part):
                columns = [pa.array(np.full(len(part), d), pa.int32()), pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[d][part, entry]), pa.array(list(sums[d][part, entry]), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["d", "part", "entry", "n", "sums"])

    return add


def encode(rows: DataFrame, books: dict[int, np.ndarray], width: int = 32, cells: int = 16_384) -> DataFrame:
    """(vec_id, label, d, code, error) for every row of ``integers``: a byte for each part, and the squared distances added up."""
    shape = rows.select("vec_id", "label", "d", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")).schema
    names = shape.names

    def run(batches):
        by = {d: Assigner(b, width, cells) for d, b in books.items()}
        for kept, d, q in batches_of(batches, 4096):
            chosen, distance = by[d].assign(q)
            codes = [x.tobytes() for x in chosen.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.full(len(q), d), pa.int32()), pa.array(codes, pa.binary()), pa.array(distance.sum(axis=1))], names)

    return rows.select("vec_id", "label", "d", "q").mapInArrow(run, shape)


def decode(coded: DataFrame, books: dict[int, np.ndarray]) -> DataFrame:
    """(vec_id, vector): what is left of each vector, the chosen entries divided by 256."""

    def run(batches):
        for batch in batches:
            ids, lengths, codes = (batch.column(i).to_pylist() for i in range(3))
            vectors = [books[d][np.arange(len(c)), np.frombuffer(c, np.uint8)].reshape(-1)[:d] / 256 for d, c in zip(lengths, codes)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([v.tolist() for v in vectors], pa.list_(pa.float64()))], ["vec_id", "vector"])

    return coded.select("vec_id", "d", "code").mapInArrow(run, "vec_id long, vector array<double>")


def books_digest(book: np.ndarray) -> str:
    """SHA-256 of a codebook's components, by part, entry and position, as decimals."""
    return hashlib.sha256(",".join(map(str, book.reshape(-1).tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame, salts: int = 16) -> DataFrame:
    """coded with ``label_error``, the errors of its label's rows added up, null labels together.

    The sums go to ``salts`` copies, as one label may hold most rows.
    """
    sums = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    sums = sums.select(F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    salted = coded.withColumn("_salt_of", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)).cast("int"))
    joined = salted.join(sums, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt_of") == F.col("_salt")))
    return joined.drop("_label", "_salt", "_salt_of")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, width: int = 32, cells: int = 16_384) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """Codes of all kept vectors, as a written table, and the codebooks.

    ``entries``: of each codebook, 256 at most. ``width``: of a cell; ``cells``: as
    many of them are kept for each part, a bound on memory alone.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is a byte, so a codebook has 1 to 256 entries")
    rows = cut(integers(vectors, id_col, vector_col, label_col, parts), "integers")
    books = train(rows, parts, entries, rounds, width, cells)
    return cut(encode(rows, books, width, cells), "codes"), books


def digest(vectors: DataFrame) -> DataFrame:
    """The contract's columns."""
    coded, books = compress(vectors)
    digests = F.lit(None).cast("string")
    for d, book in books.items():
        digests = F.when(F.col("d") == d, books_digest(book)).otherwise(digests)
    found = with_label_error(coded)
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", digests.alias("codebooks_sha256"))


def _assigned(name: str, book: str) -> str:
    """SQL: the nearest entry of each part, as table ``name``; x1 to x4 are a part's components, c1 to c4 an entry's."""
    distance = " + ".join(f"(x{i} - c{i}) * (x{i} - c{i})" for i in range(1, 5))
    return f"""{name} AS (SELECT vec_id, label, p, x1, x2, x3, x4, arg_min(e, (d, e)) AS e, min(d) AS d FROM
  (SELECT parts.*, {book}.e, {distance} AS d FROM parts JOIN {book} USING (p)) GROUP BY vec_id, label, p, x1, x2, x3, x4)"""


def _averaged(name: str, book: str, assigned: str) -> str:
    """SQL: the codebook after a round."""
    new = ", ".join(f"coalesce(m{i}, c{i}) AS c{i}" for i in range(1, 5))
    means = ", ".join(f"CAST(floor(sum(x{i}) / count(*)) AS BIGINT) AS m{i}" for i in range(1, 5))
    return f"{name} AS (SELECT {book}.p, {book}.e, {new} FROM {book} LEFT JOIN (SELECT p, e, {means} FROM {assigned} GROUP BY p, e) USING (p, e))"


#: For vectors of 64 components, as the given tables hold, with distinct ids.
ORACLE = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, p, q[4 * p + 1] AS x1, q[4 * p + 2] AS x2, q[4 * p + 3] AS x3, q[4 * p + 4] AS x4 FROM kept, range(16) AS r(p)),
first AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x1 AS c1, x2 AS c2, x3 AS c3, x4 AS c4 FROM parts QUALIFY e < 64),
{_assigned("near_first", "first")},
{_averaged("second", "first", "near_first")},
{_assigned("near_second", "second")},
{_averaged("third", "second", "near_second")},
{_assigned("near_third", "third")},
books AS (SELECT sha256(string_agg(concat_ws(',', c1, c2, c3, c4), ',' ORDER BY p, e)) AS codebooks_sha256 FROM third),
codes AS (SELECT vec_id, label, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near_third GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes, books
"""
