"""Compression of vectors to product codes by cover-tree Lloyd.

A vector is scaled to whole numbers and cut into ``PARTS`` equal parts; every part position has
a codebook of up to ``ENTRIES`` entries, which rounds of Lloyd's algorithm move: each part goes
to the nearest entry, each entry to the (floored) mean of its parts.

Each task builds cover trees over the vectors it holds, one for every part and ``TREE_ROWS``
vectors: a node is a ball around one of its points, its children cover it with balls of at
most half the radius, around centres further apart than that, one of them the node's own
centre.  Points lie in tree order, so a subtree is a range and its sum a difference of two
cumulative sums.  The trees are written once.  A round sends the codebooks to the trees: where
the centre of a ball is nearer to its nearest entry than to any other by more than twice the
radius, the triangle inequality gives the whole subtree to that entry; only ambiguous nodes
descend, at last to exact comparisons of whole numbers.  What comes back is a count and a sum
for every entry, added up by Spark; the driver holds codebooks alone.

Defined cases: rows whose vector is null or holds a null or non-finite component are dropped,
and so are vectors whose length is not that of the first kept vector by id; components beyond
+-LIMIT / SCALE are taken as that; vectors of no length get code zero and error 0; where the
length is no multiple of ``PARTS``, parts differ by one component.  Null ids come last, rows of
one id are ordered by vector and each counts.  With fewer than ``ENTRIES`` kept rows there are as
many entries.  Null labels are equal to each other.  Other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import checked_broadcast, materialise

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
LIMIT = 1 << 27        # of a scaled component: squared distances stay within a long
TREE_ROWS = 2048       # vectors of a tree
LEAF = 8               # points that are not divided further
_TREE = "order array<int>, points array<int>, start array<int>, end array<int>, centre array<int>, radius array<double>, " \
        "child array<int>, children array<int>"
_FIELDS = tuple(x.split()[0] for x in _TREE.split(", "))


@dataclass
class CoverTree:
    """``points`` in tree order, ``order`` their rows; nodes level by level: the range of their
    points, the place of their centre, their radius, their first child and number of children."""
    order: np.ndarray
    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    children: np.ndarray


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=-1)


def build_tree(points: np.ndarray) -> CoverTree:
    """The cover tree of a few points (n x d whole numbers, n > 0)."""
    points = points.astype("int64")
    order = np.arange(len(points))
    # (first, last + 1, row of the centre, largest squared distance from it), level by level
    nodes = [(0, len(points), 0, int(_squared(points, points[0]).max(initial=0)))]
    child, children, at = [], [], 0
    while at < len(nodes):
        first, last, centre, wide = nodes[at]
        at += 1
        child.append(len(nodes))
        if last - first <= LEAF or wide == 0:
            children.append(0)
            continue
        left, place, before = order[first:last].copy(), first, len(nodes)
        while len(left):
            apart = _squared(points[left], points[centre])
            near = 4 * apart <= wide
            mine = left[near]
            order[place:place + len(mine)] = mine
            nodes.append((place, place + len(mine), centre, int(apart[near].max())))
            place += len(mine)
            left = left[~near]
            centre = left[0] if len(left) else centre
        children.append(len(nodes) - before)
    start, end, centre, wide = (np.array(x, "int64") for x in zip(*nodes))
    place_of = np.empty(len(points), "int64")
    place_of[order] = np.arange(len(points))
    return CoverTree(order, points[order], start, end, place_of[centre], np.sqrt(wide.astype("float64")),
                     np.array(child, "int64"), np.array(children, "int64"))


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All of first, first + 1, ... first + count - 1, for each pair."""
    shift = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) if len(first) else first
    return shift + np.arange(len(shift))


def _nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances to all entries, and the nearest (the first of equals)."""
    apart = np.stack([_squared(points, e) for e in entries], axis=1)
    return apart, apart.argmin(axis=1)


def descend(tree: CoverTree, entries: np.ndarray):
    """(nodes, their entry, places, their entry): subtrees that go to one entry as a whole, and
    the points of leaves that were compared one by one."""
    sure, sure_entry, leaf_nodes = [], [], []
    level = np.array([0], "int64")
    while len(level):
        apart, best = _nearest(tree.points[tree.centre[level]], entries)
        far = np.sqrt(apart.astype("float64"))
        rows = np.arange(len(level))
        nearest = far[rows, best]
        far[rows, best] = np.inf
        second = far.min(axis=1)
        # a margin for rounding: a node is given away only where no doubt is left
        radius = tree.radius[level]
        whole = (radius == 0) | (second - nearest > 2 * radius + 1e-9 * (nearest + radius + 1))
        sure.append(level[whole])
        sure_entry.append(best[whole])
        open_nodes = level[~whole]
        leaf = tree.children[open_nodes] == 0
        leaf_nodes.append(open_nodes[leaf])
        inner = open_nodes[~leaf]
        level = _ranges(tree.child[inner], tree.children[inner])
    leaves = np.concatenate(leaf_nodes)
    places = _ranges(tree.start[leaves], tree.end[leaves] - tree.start[leaves])
    return np.concatenate(sure), np.concatenate(sure_entry), places, _nearest(tree.points[places], entries)[1]


def entry_sums(tree: CoverTree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, component sums) of the points of every entry."""
    nodes, node_entry, places, place_entry = descend(tree, entries)
    upto = np.concatenate([np.zeros((1, tree.points.shape[1]), "int64"), np.cumsum(tree.points, axis=0)])
    counts, sums = np.zeros(len(entries), "int64"), np.zeros(entries.shape, "int64")
    np.add.at(counts, node_entry, tree.end[nodes] - tree.start[nodes])
    np.add.at(sums, node_entry, upto[tree.end[nodes]] - upto[tree.start[nodes]])
    np.add.at(counts, place_entry, 1)
    np.add.at(sums, place_entry, tree.points[places])
    return counts, sums


def codes(tree: CoverTree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every point, by row."""
    nodes, node_entry, places, place_entry = descend(tree, entries)
    size = tree.end[nodes] - tree.start[nodes]
    code = np.empty(len(tree.order), "int64")
    code[tree.order[_ranges(tree.start[nodes], size)]] = np.repeat(node_entry, size)
    code[tree.order[places]] = place_entry
    error = np.empty(len(tree.order), "int64")
    error[tree.order] = _squared(tree.points, entries[code[tree.order]])
    return code, error


# --- tasks ---------------------------------------------------------------------------

def _cuts(length: int) -> list[int]:
    return [i * length // PARTS for i in range(PARTS + 1)]


def _plant(length: int):
    """(id, label, vector) -> a row of trees for every ``TREE_ROWS`` vectors or fewer."""
    def run(batches):
        import pyarrow as pa
        cuts = _cuts(length)
        tree_type = pa.list_(pa.struct([(f, pa.list_(pa.float64() if f == "radius" else pa.int32())) for f in _FIELDS]))
        for batch in batches:
            for at in range(0, batch.num_rows, TREE_ROWS):
                rows = batch.slice(at, TREE_ROWS)
                flat = np.asarray(rows.column("vector").flatten()).reshape(rows.num_rows, length)
                trees = [build_tree(flat[:, a:z]) for a, z in zip(cuts, cuts[1:])]
                whole = [0, rows.num_rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(whole, rows.column("id")), pa.ListArray.from_arrays(whole, rows.column("label")),
                     pa.array([[{f: np.asarray(getattr(t, f)).ravel() for f in _FIELDS} for t in trees]], tree_type)],
                    names=["ids", "labels", "trees"])
    return run


def _trees_of(column, row: int, length: int) -> list[CoverTree]:
    parts, cuts, out = column[row].values, _cuts(length), []
    for p in range(PARTS):
        f = {name: np.asarray(parts.field(name)[p].values) for name in _FIELDS}
        f = {name: x if name == "radius" else x.astype("int64") for name, x in f.items()}
        f["points"] = f["points"].reshape(len(f["order"]), cuts[p + 1] - cuts[p])
        out.append(CoverTree(**f))
    return out


def _sum_kernel(books: list[np.ndarray], length: int):
    """Trees -> (part, entry, place, total, n): one row per component of a used entry and task."""
    def run(batches):
        import pyarrow as pa
        counts = [np.zeros(len(b), "int64") for b in books]
        sums = [np.zeros(b.shape, "int64") for b in books]
        for batch in batches:
            for row in range(batch.num_rows):
                for p, tree in enumerate(_trees_of(batch.column("trees"), row, length)):
                    n, s = entry_sums(tree, books[p])
                    counts[p] += n
                    sums[p] += s
        for p, (n, s) in enumerate(zip(counts, sums)):
            entry, place = (x.ravel() for x in np.indices(s.shape))
            used = n[entry] > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(used.sum(), p, "int32")), pa.array(entry[used].astype("int32")), pa.array(place[used].astype("int32")),
                 pa.array(s.ravel()[used]), pa.array(n[entry][used])], names=["part", "entry", "place", "total", "n"])
    return run


def _code_kernel(books: list[np.ndarray], length: int):
    """Trees -> (id, label, code, error)."""
    def run(batches):
        import pyarrow as pa
        digits = np.array([f"{e:02x}" for e in range(max(len(books[0]), 1))])
        for batch in batches:
            for row in range(batch.num_rows):
                found = [codes(t, b) for t, b in zip(_trees_of(batch.column("trees"), row, length), books)]
                code = ["".join(x) for x in digits[np.stack([c for c, _ in found], axis=1)]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[row].values, batch.column("labels")[row].values, pa.array(code, pa.string()),
                     pa.array(sum(e for _, e in found))], names=["id", "label", "code", "error"])
    return run


# --- the operator ------------------------------------------------------------------------

def whole_vectors(table: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, label, vector array<int>) of the rows that are kept, whatever their length."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    edge = float(LIMIT)
    return rows.filter(F.col("vector").isNotNull() & finite).withColumn("vector", F.transform("vector", lambda x: F.floor(
        F.least(F.greatest(x * F.lit(float(scale)), F.lit(-edge)), F.lit(edge))).cast("int")))


def compress(table: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
             rounds: int = ROUNDS) -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256) of every kept row."""
    spark = table.sparkSession
    kept = whole_vectors(table, id_col, label_col, vector_col)
    by_id = [F.col("id").asc_nulls_last(), "vector"]
    first = kept.orderBy(*by_id).select(F.size("vector")).first()
    length = first[0] if first else 0
    kept = kept.filter(F.size("vector") == length)
    seeds = kept.orderBy(*by_id).limit(ENTRIES).collect()
    seeds = np.array([r["vector"] for r in seeds], "int64").reshape(len(seeds), length)
    cuts = _cuts(length)
    books = [seeds[:, a:z].copy() for a, z in zip(cuts, cuts[1:])]

    id_type, label_type = kept.schema["id"].dataType, kept.schema["label"].dataType
    tree_schema = T.StructType([T.StructField("ids", T.ArrayType(id_type)), T.StructField("labels", T.ArrayType(label_type)),
                                T.StructField("trees", T.ArrayType(T.StructType.fromDDL(_TREE)))])
    trees = materialise(kept.mapInArrow(_plant(length), tree_schema), "cover-trees")
    for _ in range(rounds if len(seeds) else 0):
        sums = trees.select("trees").mapInArrow(_sum_kernel(books, length), "part int, entry int, place int, total bigint, n bigint")
        # at most PARTS x ENTRIES x length rows
        moved = [b.copy() for b in books]
        for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            moved[r["part"]][r["entry"], r["place"]] = r["total"] // r["n"]
        books = moved

    code_schema = T.StructType([T.StructField("id", id_type), T.StructField("label", label_type),
                                T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = materialise(trees.mapInArrow(_code_kernel(books, length), code_schema), "vector-codes")
    per_label = materialise(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    digest = hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()
    out = coded.join(checked_broadcast(per_label), F.col("label").eqNullSafe(F.col("_label")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    cut = f"[i for i in range(1, len(v) // {PARTS} + 1)]"
    steps = [f"""
kept as (select vec_id, label, [cast(floor(cast(x as double) * {SCALE}) as bigint) for x in embedding] as v from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
parts as materialized (select vec_id, label, p, [v[p * (len(v) // {PARTS}) + i] for i in {cut}] as c
  from kept, range({PARTS}) t(p)),
b0 as (select p, e, c from (select p, c, row_number() over (partition by p order by vec_id) - 1 as e from parts) where e < {ENTRIES})"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""
a{r} as materialized (select vec_id, label, p, c, min_by(e, [d, e]) as e, min(d) as d from (
    select x.vec_id, x.label, x.p, x.c, b.e,
      cast(list_sum([(x.c[i] - b.c[i]) * (x.c[i] - b.c[i]) for i in range(1, len(x.c) + 1)]) as bigint) as d
    from parts x join b{r} b on b.p = x.p) group by vec_id, label, p, c)""")
        if r < ROUNDS:
            steps.append(f"""
m{r} as (select p, e, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as c from (
    select p, e, i, cast(sum(c[i]) as bigint) as s, count(*) as n from a{r}, range(1, (select max(len(c)) from parts) + 1) t(i)
    group by p, e, i) group by p, e),
b{r + 1} as (select b.p, b.e, coalesce(m.c, b.c) as c from b{r} b left join m{r} m on m.p = b.p and m.e = b.e)""")
    last = ROUNDS
    return f"""with {','.join(steps)},
coded as (select vec_id, label, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error
  from a{last} group by vec_id, label)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) from b{last}) as codebooks_sha256
from coded
"""


CODES_SQL = _sql()
