import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import vector_codes as vc

TABLE = "vec_id long, embedding array<float>, label int"


def coded(rows, rounds=6):
    """The contract in plain Python over the kept rows."""
    def cuts(v):
        return [v[p * len(v) // 8:(p + 1) * len(v) // 8] for p in range(8)]
    whole = lambda v: [math.floor(min(max(4096 * float(x), -2 ** 27), 2 ** 27)) for x in v]
    kept = [(i, whole(v), y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    books = [[list(cuts(v)[p]) for _, v, _ in kept[:16]] for p in range(8)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda part, book: min(range(len(book)), key=lambda e: (apart(part, book[e]), e))
    for _ in range(rounds):
        moved = []
        for p, book in enumerate(books):
            of = {}
            for _, v, _ in kept:
                of.setdefault(best(cuts(v)[p], book), []).append(cuts(v)[p])
            moved.append([[sum(x) // len(of[e]) for x in zip(*of[e])] if e in of else book[e] for e in range(len(book))])
        books = moved
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, per_label = [], {}
    for i, v, y in kept:
        at = [best(part, books[p]) for p, part in enumerate(cuts(v))]
        error = sum(apart(part, books[p][at[p]]) for p, part in enumerate(cuts(v)))
        per_label[y] = per_label.get(y, 0) + error
        out.append((i, "".join(f"{e:02x}" for e in at), error, y))
    return sorted(((i, c, e, per_label[y], digest) for i, c, e, y in out), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def table(spark, rows, parts=5):
    clash = {c: F.lit("x") for c in ("id", "vector", "code", "error", "part", "entry", "trees", "ids", "n", "total", "_label")}
    return spark.createDataFrame(rows, TABLE).withColumns(clash).repartition(parts)


def vectors(n, dim, seed=1):
    r = random.Random(seed)
    f32 = lambda x: float(np.float32(x))
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, [f32(c + r.gauss(0, 0.15)) for c in r.choice(centres)], r.choice([None, 0, 1, 2])) for i in range(n)]


def test_codes_equal_brute_force(spark):
    rows = vectors(700, 16)
    rows += [(1000 + i, rows[3][1], 9) for i in range(350)]                 # copies: a third of the rows
    rows += [(None, rows[5][1], None), (None, rows[6][1], 1), (4, rows[7][1], 2), (4, rows[4][1], 2)]
    rows += [(2000, None, 1), (2001, [None] + rows[0][1][1:], 1), (2002, [float("nan")] + rows[0][1][1:], 1),
             (2003, [float("inf")] + rows[0][1][1:], 1), (-1, [-float("inf")] * 16, 1), (-2, None, 1),
             (2004, [1.0] * 8, 0), (2005, [], 0), (2006, [1e30] + rows[0][1][1:], 5), (2007, [-0.00001] * 16, 5)]
    assert got(vc.compress(table(spark, rows))) == coded(rows)


@pytest.mark.parametrize("dim", [0, 3, 8, 19])
def test_awkward_lengths(spark, dim):
    rows = vectors(60, dim, seed=dim)
    assert got(vc.compress(table(spark, rows))) == coded(rows)


def test_few_rows_and_ties(spark):
    assert vc.compress(table(spark, [])).count() == 0
    assert vc.compress(table(spark, [(1, None, 1)])).count() == 0
    for rows in ([(5, [0.5] * 8, None)], [(i, [0.25 * (i % 3)] * 16, 0) for i in range(40)],
                 [(i, [float(i % 4), float(i % 5)] * 8, i % 2) for i in range(64)]):
        assert got(vc.compress(table(spark, rows))) == coded(rows)


def test_trees_are_cover_trees():
    r = np.random.default_rng(5)
    points = np.concatenate([r.integers(-900, 900, (400, 4)), np.tile(r.integers(-9, 9, (1, 4)), (300, 1)), r.integers(-20, 20, (300, 4))])
    t = vc.build_tree(points)
    assert sorted(t.order) == list(range(1000)) and (points[t.order] == t.points).all()
    for node in range(len(t.start)):
        mine, centre = t.points[t.start[node]:t.end[node]], t.points[t.centre[node]]
        far = np.sqrt(vc._squared(mine, centre)).max()
        assert far <= t.radius[node] + 1e-9 and t.start[node] <= t.centre[node] < t.end[node]
        below = range(t.child[node], t.child[node] + t.children[node])
        if len(below):
            assert [t.start[c] for c in below] == [t.start[node], *(t.end[c] for c in below)][:len(below)] and t.end[below[-1]] == t.end[node]
            assert t.centre[below[0]] in range(t.start[node], t.end[node]) and (t.points[t.centre[below[0]]] == centre).all()
            centres = t.points[t.centre[list(below)]]
            gaps = [2 * math.dist(a, b) for k, a in enumerate(centres) for b in centres[:k]]
            assert min(gaps) > t.radius[node] - 1e-9 and all(2 * t.radius[c] <= t.radius[node] + 1e-9 for c in below)


def test_subtrees_go_as_a_whole_and_right():
    r = np.random.default_rng(6)
    points = np.concatenate([r.normal(c, 40, (500, 3)) for c in (-2000, 0, 2000)]).round().astype("int64")
    t, entries = vc.build_tree(points), np.array([[-2000] * 3, [0] * 3, [2000] * 3, [0] * 3])
    nodes, _, places, _ = vc.descend(t, entries)
    assert len(places) < 0.4 * len(points) and (t.end[nodes] - t.start[nodes]).max() > 100     # two equal entries: theirs descend
    apart = vc._nearest(points, entries)[1]
    assert (vc.codes(t, entries)[0] == apart).all() and 3 not in apart
    n, s = vc.entry_sums(t, entries)
    assert [int(x) for x in n] == [int((apart == e).sum()) for e in range(4)]
    assert (s == np.stack([points[apart == e].sum(axis=0) for e in range(4)])).all()
