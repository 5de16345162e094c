"""Vector codes and hard negatives against brute force, with odd rows, ties, repeated ids and several lengths."""

import math
from collections import defaultdict

import numpy as np
import pytest

from shelfmark.llm import hard_negatives, vector_codes


def whole(x):
    return [max(-(1 << 24), min(1 << 24, math.floor(256 * float(np.float32(y))))) for y in x]


def good(x):
    return x is not None and all(y is not None and math.isfinite(y) for y in x)


def odd_table(spark, seed=0, n=300):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.standard_normal(16) * rng.choice([0.1, 0.3])], int(rng.integers(0, 4))) for i in range(n)]
    rows += [(1000 + i, rows[100][1], 1) for i in range(30)] + [(2000 + i, rows[7][1], None) for i in range(5)]
    rows += [(3000 + i, [0.5 * ((i + j) % 3) for j in range(5)], i % 3) for i in range(60)]
    rows += [(50, rows[3][1], 2), (50, rows[4][1], 2), (None, rows[5][1], 1), (None, rows[5][1], 0), (4000, [], 1), (4050, [], 1), (4100, [0.0] * 16, 1)]
    rows += [(5000, None, 1), (5050, [float("nan")] * 16, 1), (5100, [None] * 16, 2), (5150, [float("inf")] + [0.0] * 15, 3), (5200, [1e30, -1e30] * 8, 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'clash' AS d", "'clash' AS q", "'clash' AS row")


def key(r):
    return tuple((x is None, x) for x in r)


def codes_by_hand(rows):
    by_length = defaultdict(list)
    for i, x, label in rows:
        if good(x):
            by_length[len(x)].append((i, whole(x) + [0] * (-len(x) % 16), label))
    coded = []
    digests = {}
    for d, kept in by_length.items():
        kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        w = len(kept[0][1]) // 16
        parts = [[r[1][p * w : p * w + w] for r in kept] for p in range(16)]
        books = [[list(x) for x in part[:64]] for part in parts]
        nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
        for _ in range(2):
            for p in range(16):
                of = defaultdict(list)
                for x in parts[p]:
                    of[nearest(x, books[p])[1]].append(x)
                for e, xs in of.items():
                    books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
        digests[d] = vector_codes.books_digest(np.array(books, dtype=object).reshape(16, len(books[0]), w))
        for k, (i, _, label) in enumerate(kept):
            found = [nearest(parts[p][k], books[p]) for p in range(16)]
            coded.append((i, "".join(f"{e:02x}" for _, e in found), sum(x for x, _ in found), label, digests[d]))
    total = defaultdict(int)
    for _, _, error, label, _ in coded:
        total[label] += error
    return [(i, code, error, total[label], text) for i, code, error, label, text in coded]


def test_vector_codes(spark):
    rows, df = odd_table(spark)
    got = [tuple(r) for r in vector_codes.digest(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]
    assert sorted(got, key=key) == sorted(codes_by_hand(rows), key=key)
    assert vector_codes.digest(df.filter("false")).count() == 0


def test_cells_change_nothing():
    """Cells of any width, kept or not, give the nearest entry; on most rows far fewer entries are evaluated than there are."""
    rng = np.random.default_rng(2)
    book = rng.integers(-90, 90, (64, 4))
    book[40] = book[3]
    rows = rng.integers(-120, 120, (3000, 4))
    away = ((rows[:, None] - book) ** 2).sum(axis=2)
    for width, most in ((1, 10), (16, 100_000), (32, 50), (1000, 10)):
        cells = vector_codes.Cells(book, width, most)
        for part in np.array_split(rows, 5):
            index, distance = cells.nearest(part)
            want = ((part[:, None] - book) ** 2).sum(axis=2)
            assert (index == want.argmin(axis=1)).all() and (distance == want.min(axis=1)).all()
    kept = vector_codes.Cells(book, 16, 100_000)
    kept.nearest(rows)
    assert away.shape[1] == 64 and np.mean([len(x) for x in kept.kept.values()]) < 20


def test_decoded_vectors_are_near(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(32) * 0.2], 0) for i in range(400)]
    coded, books = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    errors = {r.vec_id: r.error for r in coded.collect()}
    for r in vector_codes.decode(coded, books).collect():
        exact = np.array(whole(rows[r.vec_id][1])) - np.array(r.vector) * 256
        assert round(float((exact * exact).sum())) == errors[r.vec_id]


def negatives_by_hand(rows):
    kept = []
    for i, x, label in rows:
        if good(x) and x and label is not None:
            kept.append((i, whole(x), (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = []
    for k, (a, q, label) in enumerate(kept):
        if a is None or a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i is None, i or 0, n, i, lab) for n, (i, v, lab) in enumerate(kept) if n != k and len(v) == len(q))
        for p in [s for s in scored if s[5] == label][:5]:
            fits = [s for s in scored if s[5] != label and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]]
            out += [(a, p[4], r + 1, s[4], -p[0], -s[0]) for r, s in enumerate(fits[:3])]
    return out


@pytest.mark.parametrize("options", [{}, {"tile_rows": 40, "anchor_rows": 3, "sample_rows": 10}, {"tile_rows": 100, "sample_rows": 200}])
def test_hard_negatives(spark, options):
    rows, df = odd_table(spark, 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # tiles and anchors have to meet in several partitions
    try:
        got = [tuple(r) for r in hard_negatives.mine(df, **options).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = negatives_by_hand(rows)
    assert len(want) > 60 and sorted(got, key=key) == sorted(want, key=key)
    assert hard_negatives.mine(df.filter("false")).count() == 0


@pytest.mark.parametrize("scale", [1, 1 << 20])
def test_index_finds_all_pairs(scale):
    """Skewed dimensions, so that dimensions are left out and rows pruned, at thresholds from high to none."""
    rng = np.random.default_rng(8)
    weight = np.geomspace(100, 1, 40) * scale
    rows = (rng.standard_normal((500, 40)) * weight * rng.choice([0.1, 1, 2], (500, 1))).astype(np.int64)
    queries = (rng.standard_normal((30, 40)) * weight).astype(np.int64)
    index = hard_negatives.Index(rows)
    scores = queries @ rows.T
    for share in (1.0, 0.7, 0.3, 0.0, -1.0):
        limits = (scores.max(axis=1) * share).astype(np.int64)
        i, j, s = index.pairs(queries, limits)
        want = {(a, b) for a, b in zip(*np.nonzero(scores >= limits[:, None]))}
        assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want) and (s == scores[i, j]).all()


def test_windows():
    """Windows above, below and beyond all scores; ties at a window's last place come by order."""
    rows = np.array([[10, 0], [9, 0], [9, 0], [9, 1], [5, 0], [0, 5]] + [[1, 1]] * 10)
    index = hard_negatives.Index(rows)
    low, high = np.array([[50, 95, -hard_negatives.FAR]]), np.array([[90, 94, 5]])
    parts = hard_negatives.best_in_windows(index, np.array([[10, 0]]), low, high, 2, lambda i, j: j != 3, np.arange(len(rows))[::-1])
    found = sorted((w, j, s) for p in parts for w, j, s in zip(p[1].tolist(), p[2].tolist(), p[3].tolist()))
    assert found == [(0, 1, 90), (0, 2, 90), (2, 5, 0)]
