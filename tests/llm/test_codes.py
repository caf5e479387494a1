"""Vector codes against brute force, with awkward rows."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from abyssal.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error, label_error, digest) of each kept row, every part against every entry."""
    kept = [(i, [math.floor(1024 * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    n = len(kept[0][1])
    first = {}
    for i, v, _ in kept:
        first[i] = min(first.get(i, v), v)
    order = sorted(first, key=lambda i: (i is None, i or 0))[:entries]
    books = [[first[i][a:b] for i in order] for a, b in ((p * n // parts, (p + 1) * n // parts) for p in range(parts))]
    pieces = lambda v: [v[p * n // parts : (p + 1) * n // parts] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(pieces(v)[p], books[p])[1], []).append(pieces(v)[p])
            books[p] = [[sum(c) // len(c) for c in zip(*groups[e])] if e in groups else c for e, c in enumerate(books[p])]
    final = [[near(x, book) for x, book in zip(pieces(v), books)] for _, v, _ in kept]
    errors, labels = [sum(d for d, _ in f) for f in final], {}
    for (_, _, y), e in zip(kept, errors):
        labels[y] = labels.get(y, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in f), d, labels[y], digest) for (i, _, y), f, d in zip(kept, final, errors)]


def vectors(n=400, dim=12, seed=3):
    rng = random.Random(seed)
    centre = [rng.gauss(0, 1) for _ in range(dim)]
    f32 = lambda x: float(np.float32(x))
    rows = [(i, [f32(c + rng.gauss(0, 0.003) if i % 3 == 0 else rng.gauss(0, 0.2)) for c in centre], i % 5 if i % 7 else None) for i in range(n)]
    rng.shuffle(rows)
    nan, inf = float("nan"), float("inf")
    bad = [(1000, None, 1), (1001, [None] * dim, 1), (1002, [nan] * dim, 1), (1003, [0.0] * (dim - 1) + [inf], 2), (1004, [-inf] + [0.0] * (dim - 1), None)]
    return rows + bad + [(5, rows[3][1], 1), (5, rows[3][1], 1), (None, rows[9][1], 2), (None, rows[10][1], None), (2000, [0.0] * dim, 3), (-4, rows[0][1], 3)]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_codes_are_those_of_brute_force(spark):
    rows = vectors()
    given = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("code", "error", "part", "entry", "v", "_label", "trees")})
    got = [tuple(r) for r in codes.encode(given).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_fewer_vectors_than_entries_and_uneven_parts(spark):
    rows = vectors(30, 7, 8)[:30]
    got = [tuple(r) for r in codes.encode(spark.createDataFrame(rows, SCHEMA), entries=8, rounds=3).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, entries=8, rounds=3), key=key)


def test_each_length_has_its_codebooks(spark):
    short, long = vectors(20, 4, 1)[:20], [(i + 100, v, y) for i, v, y in vectors(20, 8, 2)[:20]]
    got = [tuple(r)[:3] for r in codes.encode(spark.createDataFrame(short + long + [(7, [], 1)], SCHEMA)).collect()]
    want = [r[:3] for r in brute(short) + brute(long)] + [(7, "00000000", 0)]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_no_rows(spark):
    assert codes.encode(spark.createDataFrame([], SCHEMA)).collect() == []
    assert codes.encode(spark.createDataFrame([(1, None, None)], SCHEMA)).collect() == []


def test_pruned_trees_agree_with_all_pairs():
    rng = np.random.default_rng(4)
    for n, width, k, high in ((1, 3, 5, 4), (17, 1, 9, 3), (3000, 4, 64, 1000), (500, 2, 256, 6), (40, 0, 3, 2)):
        x, book = rng.integers(-high, high, (n, width)), rng.integers(-high, high, (k, width))
        tree = codes.Tree.over(x)
        label, counts, sums = tree.assigned(book)
        want = ((x[:, None] - book[None]) ** 2).sum(2).argmin(1)
        assert (label == want[tree.order]).all() and (counts == np.bincount(want, minlength=k)).all()
        assert all((sums[e] == x[want == e].sum(0)).all() for e in range(k))


def test_large_components_are_refused(spark):
    import pytest

    with pytest.raises(Exception, match="exact"):
        codes.encode(spark.createDataFrame([(1, [3e8, 0.0], 1)], SCHEMA)).collect()
