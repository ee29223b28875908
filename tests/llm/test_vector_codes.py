import random

import numpy as np
import pytest

from churnforge.llm.vector_codes import Balls, compress_vectors, squared_distances


def brute(rows, parts, entries, rounds, scale):
    """Every part against every entry, in Python integers."""
    kept = [(i, [int(np.floor(float(np.float32(x)) * scale)) for x in v]) for i, v in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], []
    dims = len(kept[0][1])
    whole = [r for r in kept if len(r[1]) == dims]
    w = dims // parts
    books = [[list(v[p * w:(p + 1) * w]) for _, v in whole[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for n in range(rounds + 1):
        codes = [[nearest(v[p * w:(p + 1) * w], books[p]) for p in range(parts)] for _, v in whole]
        if n < rounds:
            for p in range(parts):
                for k in range(len(books[p])):
                    mine = [v[p * w:(p + 1) * w] for (_, v), c in zip(whole, codes) if c[p][1] == k]
                    if mine:
                        books[p][k] = [sum(col) // len(mine) for col in zip(*mine)]
    out = [(i, [k for _, k in c], sum(d for d, _ in c)) for (i, _), c in zip(whole, codes)]
    return out + [(i, None, None) for i, v in kept if len(v) != dims], books


SCHEMA = "vec_id bigint, embedding array<float>, code string, v int, row int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    hubs = [[rng.uniform(-2, 2) for _ in range(8)] for _ in range(7)]
    rows = [(None, [0.5] * 8), (1, None), (2, [0.0] * 7 + [None]), (3, [float("nan")] + [0.0] * 7), (4, [float("inf")] * 8),
            (5, [-0.0001] * 8), (5, [-0.0001] * 8), (5, [0.25] * 8), (6, [0.1] * 4), (7, []), (8, [3.0] * 12)]
    rows += [(20 + i, [1.0, -1.0] * 4) for i in range(300)]                      # one vector in a third of the rows
    rows += [(1000 + i, [h + rng.choice([0, 0.01, -0.01, 0.5]) for h in rng.choice(hubs)]) for i in range(500)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("parts,entries,rounds", [(4, 16, 4), (2, 64, 3), (1, 5000, 1), (4, 3, 0)])
def test_equals_brute_force(spark, rows, parts, entries, rounds):
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA)
    coded, books = compress_vectors(df, parts=parts, entries=entries, rounds=rounds, carry=["code"])
    want, want_books = brute(rows, parts, entries, rounds, 1024)
    assert sorted(str((r["vec_id"], r["code"], r["error"])) for r in coded.collect()) == sorted(map(str, want))
    assert [b.tolist() for b in books] == want_books
    assert {r["row"]["code"] for r in coded.collect()} == {"x"}


def test_balls_skip_work_and_lose_nothing():
    rng = np.random.default_rng(0)
    hubs = rng.integers(-4000, 4000, (64, 4))
    x = hubs[rng.integers(0, 64, 20_000)] + rng.integers(-60, 60, (20_000, 4))
    balls = Balls(hubs.astype(np.int64))
    want, d2 = balls.all_pairs(x)
    entry, best, pairs = balls.reassign(x, want)
    assert (entry == want).all() and (best == d2).all() and pairs < 0.1 * x.shape[0] * len(hubs)
    entry, best, _ = balls.reassign(x, rng.integers(0, 64, len(x)))              # any ball leads to the same entry
    assert (entry == want).all() and (best == d2).all()


def test_large_components_stay_exact(spark):
    x = np.array([[2**27, -2**27 + 1], [3, 5]], np.int64)
    y = np.array([[-2**27, 2**27], [2**27, 1]], np.int64)
    assert squared_distances(x, y).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v)) for v in y] for u in x]
    df = spark.createDataFrame([(1, [1e30] * 4, "x", 1, 2)], SCHEMA)
    with pytest.raises(Exception, match="larger|OVERFLOW|overflow"):
        compress_vectors(df, parts=2)[0].collect()


def test_empty_table(spark):
    coded, books = compress_vectors(spark.createDataFrame([], SCHEMA))
    assert coded.columns == ["vec_id", "row", "code", "error"] and coded.count() == 0
    assert all(len(b) == 0 for b in books)
