"""Nearest-neighbour retrieval.

Exact k-NN: when the query matrix is small (a checked count and size), it is
broadcast and every corpus partition is scored where it lies (``mapInArrow``,
NumPy), keeping exactly k rows per query and partition, so the corpus is never
shuffled.  Otherwise the corpus is cut into cells, each a ball around a centroid
(``quantise``): every query is scored against its nearest cell first, and then only against
the cells whose ball can still hold a score that beats its k-th (``pruned_topk``), exact for any
cells.  Queries and corpus are packed into blocks, one row each (``_packed``), and every query
block meets every part of the corpus in one task (``_scan_pairs``), which reads both from the
checkpoint folder: the bounds are kept there, and neither a pair nor a copy of a vector is ever
shuffled.  A final ``row_number() <= k`` per query (planned with a partial
``WindowGroupLimit``) merges the local lists.

Approximate k-NN probes the ``nprobe`` best cells per query and scores only those.
Cells come from a two-level quantiser: a few parents over a sample, then the cells
inside each parent, all of them rows of a written table whose size follows the store.
``nprobe`` is set by measurement: the number of cells at which a sample of stored
vectors finds the wanted share of its exact neighbours.

Scores are cosine similarities of unit vectors (dot products), in DOUBLE; ties are
broken by ``round(score, 9)`` descending, then id ascending.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import text as tx
from parley.functions.text import _col
from parley.operators.embed import Embedder, hashed_embedder
from parley.operators.joins import broadcast_checked
from parley.operators.order import first_rows
from parley.session import ensure_checkpoint_dir

# --- fixed values -----------------------------------------------------------
DEFAULT_K = 6               # neighbours per chat turn
DEFAULT_RERANK_POOL = 20    # over-fetch before reranking
BLOCK_ROWS = 4096           # corpus vectors per scoring block
QUERY_BLOCK_ROWS = 1024     # query vectors per scoring block
MAX_BROADCAST_GROUPS = 1 << 16
MAX_BROADCAST_QUERIES = 8192        # query vectors broadcast to score the corpus in place
MAX_BROADCAST_QUERY_FLOATS = 1 << 22  # and at most this many floats (32 MB as doubles)
MAX_BROADCAST_HITS = 1 << 18        # hit rows broadcast to fetch their payload
MAX_BROADCAST_CELL_FLOATS = 1 << 26 # centroid floats sent to every task (256 MB); more go by a join
SAMPLE_PER_CELL = 64                # training vectors per cell (a sample; every vector is assigned)
MAX_CHILDREN = 1024                 # cells of one parent
RECALL = 0.95                       # share of exact neighbours that ``nprobe`` is set for, on a sample
RECALL_SAMPLE = 256                 # vectors of that sample
SCORE_SLICE = 512                   # corpus rows scored at once against all queries
PACK_FLOATS = 1 << 21               # floats of a packed block
TASKS_PER_CORE = 4                  # of the scan of packed blocks
PAIR_FLOATS = 1 << 16               # floats of single pairs that are scored at once
TILE_QUERIES, TILE_ROWS = 512, 1024 # of one matrix product of the scan
CROWD_QUERIES = 64                  # queries scored in double precision with all rows of a tile at once
FOLD_WIDTHS = (48, 64, 96, 128, 160, 192, 256)  # of the bounds that the scan may choose
PAIR_COST = 12000                   # of scoring a single pair, in dimensions of a product of a tile
CHOOSE_BLOCKS = 4                   # the choice is made anew after so many blocks
SCAN_ROWS = 1 << 18                 # corpus vectors that a task of the scan reads at most, or about
BOUND_ROWS = 64                     # queries whose cells are listed at once
SCORE_MARGIN = 1e-8                 # above the rounding of a score
SCORE_DIGITS = 9            # tie-break precision
# ---------------------------------------------------------------------------


# B25
def cosine(a, b) -> Column:
    """Cosine similarity of two float arrays (built-ins only)."""
    a, b = _col(a), _col(b)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                      lambda s, v: s + v)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.when((na > 0) & (nb > 0), dot / (na * nb)).otherwise(F.lit(0.0))


def _nth(ranked: np.ndarray) -> np.ndarray:
    """The number of every entry among those of its query; they follow one another."""
    at = np.arange(len(ranked))
    return at - np.maximum.accumulate(np.where(np.r_[True, ranked[1:] != ranked[:-1]], at, 0)) if len(at) else at


def _first_k(q: np.ndarray, rounded: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` entries of every query, by rounded score descending, then id."""
    _, place = np.unique(ids, return_inverse=True)
    order = np.lexsort((place, -rounded, q))
    return order[_nth(q[order]) < k]


def _reach(rounded: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, column) of the scores of a query-by-row matrix that reach its k-th best."""
    kk = min(k, rounded.shape[1])
    kth = -np.partition(-rounded, kk - 1, axis=1)[:, kk - 1]
    return np.nonzero(rounded >= kth[:, None])


def _local_topk(k: int):
    def run(qdf: pd.DataFrame, cdf: pd.DataFrame) -> pd.DataFrame:
        if qdf.empty or cdf.empty:
            return pd.DataFrame({"query_id": pd.Series([], dtype=object), "id": pd.Series([], dtype=object),
                                 "score": pd.Series([], dtype="float64")})
        qm = np.stack(qdf["qvec"].to_numpy()).astype(np.float64)
        cm = np.stack(cdf["vec"].to_numpy()).astype(np.float64)
        if qm.shape[1] != cm.shape[1]:
            raise ValueError(f"query vectors have {qm.shape[1]} dimensions, stored vectors {cm.shape[1]}")
        scores = qm @ cm.T
        rounded = np.round(scores, SCORE_DIGITS)
        qi, ci = _reach(rounded, k)
        ids = cdf["id"].to_numpy()[ci]
        keep = _first_k(qi, rounded[qi, ci], ids, k)
        return pd.DataFrame({"query_id": qdf["query_id"].to_numpy()[qi[keep]], "id": ids[keep],
                             "score": scores[qi[keep], ci[keep]]})
    return run


def _sizes(df: DataFrame, group: str, per_block: int, name: str) -> DataFrame:
    return (df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
              .select(group, F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(per_block))).cast("int").alias(name)))


def _scan_topk(k: int, bc, qid_type: T.DataType, id_type: T.DataType):
    """mapInArrow kernel: score every corpus batch against the broadcast query matrix
    and keep the best ``k`` rows of every query so far.  Ties are settled at once, by id,
    which is the final order too, so at most ``k`` rows per query leave a partition."""
    from pyspark.sql.pandas.types import to_arrow_type
    qid_arrow, id_arrow = to_arrow_type(qid_type), to_arrow_type(id_type)

    def run(batches):
        qids, qm = bc.value
        q, s, r = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        held = np.zeros(0, dtype=object)
        worst = np.full(qm.shape[0], -np.inf)      # k-th best so far
        for rb in batches:
            n = rb.num_rows
            if n == 0:
                continue
            vec = rb.column("vec")
            if isinstance(vec, pa.ChunkedArray):
                vec = vec.combine_chunks()
            flat = np.asarray(vec.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
            if flat.size != n * qm.shape[1]:
                raise ValueError(f"stored vectors must have {qm.shape[1]} dimensions")
            cm = flat.reshape(n, qm.shape[1])
            for lo in range(0, n, SCORE_SLICE):
                scores = qm @ cm[lo:lo + SCORE_SLICE].T
                rounded = np.round(scores, SCORE_DIGITS)
                qi, ci = _reach(rounded, k)
                fits = rounded[qi, ci] >= worst[qi]
                qi, ci = qi[fits], ci[fits]
                if not len(qi):
                    continue
                ids = np.asarray(rb.column("id").take(pa.array(lo + ci)).to_pylist(), dtype=object)
                q, r = np.concatenate([q, qi]), np.concatenate([r, rounded[qi, ci]])
                s, held = np.concatenate([s, scores[qi, ci]]), np.concatenate([held, ids])
                keep = _first_k(q, r, held, k)
                q, r, s, held = q[keep], r[keep], s[keep], held[keep]
                full = np.bincount(q, minlength=len(worst)) >= k
                last = np.full(len(worst), np.inf)
                np.minimum.at(last, q, r)
                worst = np.where(full, last, -np.inf)
        if len(q):
            yield pa.RecordBatch.from_arrays(
                [pa.array(qids[q].tolist(), qid_arrow), pa.array(held.tolist(), id_arrow), pa.array(s, pa.float64())],
                names=["query_id", "id", "score"])
    return run


def _broadcast_topk(queries: DataFrame, corpus: DataFrame, k: int, rows: list) -> DataFrame:
    """Exact top-k with the (size-checked) query matrix broadcast: the corpus is
    scored where it lies and never shuffled; only k-ish rows per query and
    partition move to the final merge."""
    spark = queries.sparkSession
    qids = np.asarray([r["query_id"] for r in rows], dtype=object)
    qm = np.asarray([r["qvec"] for r in rows], dtype=np.float64).reshape(len(rows), -1)
    bc = spark.sparkContext.broadcast((qids, qm))
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType),
                           T.StructField("id", corpus.schema["id"].dataType),
                           T.StructField("score", T.DoubleType())])
    kernel = _scan_topk(k, bc, queries.schema["query_id"].dataType, corpus.schema["id"].dataType)
    return corpus.select("id", "vec").mapInArrow(kernel, schema)


def blocked_topk(queries: DataFrame, corpus: DataFrame, k: int, group: str | None = None,
                 block_rows: int = BLOCK_ROWS, query_block_rows: int = QUERY_BLOCK_ROWS) -> DataFrame:
    """Exact top-k by dot product of ``queries(query_id, qvec[, group])`` against
    ``corpus(id, vec[, group])`` within equal ``group`` values.

    Returns ``(query_id, rank, id, score)``."""
    k = int(k)
    if k <= 0:
        raise ValueError("k must be > 0")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", SCORE_DIGITS)), F.asc("id"))
    if group is None:
        # one bounded look at the queries decides between broadcast and grid
        few = queries.select("query_id").limit(MAX_BROADCAST_QUERIES + 1).count() <= MAX_BROADCAST_QUERIES
        head = queries.select("query_id", "qvec").limit(MAX_BROADCAST_QUERIES + 1).collect() if few else []
        dim = max((len(r["qvec"] or []) for r in head), default=0)
        if few and len(head) * dim <= MAX_BROADCAST_QUERY_FLOATS:
            if not head:
                return queries.select("query_id", F.lit(0).alias("rank"),
                                      F.lit(None).cast(corpus.schema["id"].dataType).alias("id"),
                                      F.lit(0.0).alias("score")).limit(0)
            local = _broadcast_topk(queries, corpus, k, head)
            return (local.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
                         .select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score"))
        return pruned_topk(queries, corpus, k, block_rows=block_rows, query_block_rows=query_block_rows)
    g = group
    sizes = (_sizes(corpus, g, block_rows, "_nc")
             .join(_sizes(queries, g, query_block_rows, "_nq"), g, "inner"))
    n_groups = sizes.count()
    sizes_j = F.broadcast(sizes) if n_groups <= MAX_BROADCAST_GROUPS else sizes
    c = (corpus.join(sizes_j, g, "inner")
               .withColumn("_cb", F.pmod(F.xxhash64("id"), F.col("_nc")).cast("int"))
               .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1)))
               .select(g, "_cb", "_qb", "id", "vec"))
    q = (queries.join(sizes_j, g, "inner")
                .withColumn("_qb", F.pmod(F.xxhash64("query_id"), F.col("_nq")).cast("int"))
                .withColumn("_cb", F.explode(F.sequence(F.lit(0), F.col("_nc") - 1)))
                .select(g, "_cb", "_qb", "query_id", "qvec"))
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType),
                           T.StructField("id", corpus.schema["id"].dataType),
                           T.StructField("score", T.DoubleType())])
    local = (q.groupBy(g, "_cb", "_qb").cogroup(c.groupBy(g, "_cb", "_qb"))
              .applyInPandas(_local_topk(k), schema))
    return (local.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
                 .select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score"))


# --- packed blocks ----------------------------------------------------------------

def _singles(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)


def _packed(rows: DataFrame, id_col: str, vec_col: str, extra: list[str], kind, block_rows: int) -> DataFrame:
    """``(block, ids, vecs, extra)``: the rows of every partition in their order, ``block_rows`` to a
    row; ``vecs`` holds raw floats (doubles, if the column does), ``extra`` the other columns as ``kind``."""
    from pyspark.sql.pandas.types import to_arrow_type
    id_type, vec_kind = rows.schema[id_col].dataType, np.float32 if _singles(rows.schema[vec_col].dataType) else np.float64
    id_arrow, step = to_arrow_type(id_type), max(1, int(block_rows))
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_type)),
                           T.StructField("vecs", T.BinaryType()), T.StructField("extra", T.BinaryType())])

    def pack(batches):
        at, ids, vecs, more, held = TaskContext.get().partitionId() << 32, [], [], [], 0

        def row(n):
            nonlocal at, ids, vecs, more, held
            i, v, e = pa.concat_arrays(ids), np.concatenate(vecs), np.concatenate(more)
            out = pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int64()), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.concat_arrays([i.slice(0, n)])),
                 pa.array([v[:n].tobytes()], pa.binary()), pa.array([e[:n].tobytes()], pa.binary())], names=schema.names)
            at, ids, vecs, more, held = at + 1, [i.slice(n)], [v[n:]], [e[n:]], held - n
            return out

        for rb in batches:
            if not rb.num_rows:
                continue
            vec = rb.column(vec_col)
            lengths = set(vec.value_lengths().unique().to_pylist())
            if len(lengths) > 1 or (vecs and vecs[0].shape[1] not in lengths):
                raise ValueError(f"vectors must have one number of dimensions, not {sorted(lengths)[:5]}")
            flat = np.asarray(vec.flatten().to_numpy(zero_copy_only=False), dtype=vec_kind)
            ids.append(rb.column(id_col).cast(id_arrow))
            vecs.append(flat.reshape(rb.num_rows, -1))
            more.append(np.array([rb.column(c).to_numpy(zero_copy_only=False) for c in extra], dtype=kind).T)
            held += rb.num_rows
            while held >= step:
                yield row(step)
        if held:
            yield row(held)

    return rows.select(id_col, vec_col, *extra).mapInArrow(pack, schema)


def _scores(qm: np.ndarray, cm: np.ndarray, qi: np.ndarray, ci: np.ndarray, kind=np.float64) -> np.ndarray:
    """Scores of single (query, row) pairs in ``kind``, so many at a time that they stay in a core's cache."""
    out, step = np.empty(len(qi), kind), max(1, PAIR_FLOATS // max(1, qm.shape[1]))
    for a in range(0, len(qi), step):
        out[a:a + step] = np.einsum("ij,ij->i", qm[qi[a:a + step]].astype(kind, copy=False), cm[ci[a:a + step]].astype(kind, copy=False))
    return out


class _Fold:
    """Short vectors whose products bound the scores: some dimensions as they are, the others in groups of which
    only the length is kept (Cauchy-Schwarz in every group).  Close for sparse vectors, as a group seldom holds more
    than one value of both sides."""

    def __init__(self, order: np.ndarray, width: int):
        single, dim = width // 5, len(order)
        groups, at = width - single, np.arange(dim - single)
        nth = at % (2 * groups)
        self.width, self.single = width, order[:single]
        self.groups = np.zeros((dim, groups), np.float32)
        self.groups[order[single:], np.where(nth < groups, nth, 2 * groups - 1 - nth)] = 1.0    # there and back: even groups

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), self.width), np.float32)
        for a in range(0, len(x), QUERY_BLOCK_ROWS):
            part = x[a:a + QUERY_BLOCK_ROWS]
            out[a:a + QUERY_BLOCK_ROWS, :len(self.single)] = part[:, self.single]
            np.sqrt((part * part) @ self.groups, out=out[a:a + QUERY_BLOCK_ROWS, len(self.single):])
        return out


class _Best:
    """The best ``k`` rows so far of every query of a block."""

    def __init__(self, k: int, ids, vecs: np.ndarray, floor: np.ndarray):
        self.k, self.ids, self.qm, self.floor = k, ids, vecs, floor - SCORE_MARGIN
        self.q32 = self.qm.astype(np.float32, copy=False)
        n, self.dim = self.qm.shape
        self.norm = np.concatenate([np.zeros(0), *[np.linalg.norm(self.qm[a:a + SCORE_SLICE].astype(np.float64), axis=1) for a in range(0, n, SCORE_SLICE)]])
        self.rounded, self.score = np.full((n, k), -np.inf), np.zeros((n, k))
        self.row, self.place = np.full((n, k), -1, np.int64), np.zeros((n, k), np.int64)
        self.seen, self.first = [], [0]      # ids of the corpus blocks, and the number of their first rows
        self.folds, self.fold, self.qf, self.balls = None, None, self.q32, True
        self.out = np.empty(TILE_QUERIES * TILE_ROWS, np.float32)

    def wanted(self) -> np.ndarray:
        """A score below this cannot count."""
        return np.maximum(self.rounded[:, -1] - SCORE_MARGIN, self.floor)

    def _margin(self, width: int) -> float:
        """Above the rounding of single-precision products of unit vectors."""
        return 1.5e-7 * (width + 4) + 1e-6

    def _choose(self, c32: np.ndarray, longest: float) -> None:
        """The width of the bounds for rows like these, by what would be left to score of a sample."""
        if self.folds is None:
            # the dimensions by their weight in the products
            weight = np.sqrt(np.mean(np.square(self.q32[::8]), axis=0) * np.mean(np.square(c32[::8]), axis=0))
            order = np.argsort(-np.where(np.isnan(weight), np.inf, weight), kind="stable")
            self.folds = [_Fold(order, w) for w in FOLD_WIDTHS if w < self.dim]
        if not self.folds:
            return
        qs = np.linspace(0, len(self.q32) - 1, min(128, len(self.q32))).astype(np.int64)
        cs = np.linspace(0, len(c32) - 1, min(256, len(c32))).astype(np.int64)
        q, c, least = self.q32[qs], c32[cs], self.wanted()[qs]
        best, at = self.dim + 0.0, None
        for fold in self.folds:
            bar = least - SCORE_MARGIN - self._margin(fold.width) * self.norm[qs] * longest
            cost = fold.width + PAIR_COST * np.mean(~(fold(q) @ fold(c).T < bar[:, None]))
            if cost < best:
                best, at = cost, fold
        if at is not self.fold:
            self.fold, self.qf = at, at(self.q32) if at else self.q32

    def add(self, ids, cm: np.ndarray, cell: np.ndarray, place: np.ndarray, segment: int, mine=None) -> None:
        """Score the queries with a block of rows in the order of their cells (``mine``: of a cell, only these)."""
        first = self.first[-1]
        self.seen.append(ids)
        self.first.append(first + len(ids))
        c32 = cm.astype(np.float32, copy=False)
        with np.errstate(invalid="ignore", over="ignore"):
            length = np.linalg.norm(c32, axis=1)
            longest = float(length.max()) * (1 + 1e-5)
            again = len(self.seen) <= CHOOSE_BLOCKS or len(self.seen) % CHOOSE_BLOCKS == 0
            if again:
                self._choose(c32, longest)
            cf = self.fold(c32) if self.fold else c32
            cuts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
            cuts = np.unique(np.concatenate([cuts, *[np.arange(a, z, segment) for a, z in zip(cuts[:-1], cuts[1:])]]))
            if again or self.balls:
                can = self._in_reach(c32, cuts, longest)
                self.balls = can.mean() < 0.95       # where balls rule out next to nothing, the next blocks go without
            else:
                can = np.ones((len(self.qm), len(cuts) - 1), dtype=bool)
            if mine is not None:
                can &= np.stack([mine(int(cell[a])) for a in cuts[:-1]], axis=1)
            if can.mean() > 0.5:         # most pieces are to be read: rows of some cells at once
                runs = [(lo, min(lo + TILE_ROWS, len(cm))) for lo in range(0, len(cm), TILE_ROWS)]
            else:
                runs = [(lo, min(lo + TILE_ROWS, z)) for a, z in zip(cuts[:-1], cuts[1:]) for lo in range(a, z, TILE_ROWS)]
            of = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            for lo, hi in runs:
                part = can[:, of[lo]:of[hi - 1] + 1]
                sel = np.flatnonzero(part.any(axis=1))
                if len(sel):
                    self._scan(cm, c32, cf, place, first, lo, hi, longest, sel, None if part.all() else (can, of))

    def _in_reach(self, c32: np.ndarray, cuts: np.ndarray, longest: float) -> np.ndarray:
        """Of every query, which pieces of the block can hold a score that counts: their ball says so."""
        centre = np.add.reduceat(c32, cuts[:-1], axis=0, dtype=np.float64) / np.diff(cuts)[:, None]
        reach = np.array([np.linalg.norm(c32[a:z] - m, axis=1).max() for a, z, m in zip(cuts[:-1], cuts[1:], centre)])
        least = (self.wanted() - SCORE_MARGIN - self._margin(self.dim) * self.norm * longest)[:, None]
        return ~(self.q32 @ centre.astype(np.float32).T + self.norm[:, None] * (reach * (1 + 1e-5)) < least)      # a NaN stays

    def _scan(self, cm, c32, cf, place, first, lo, hi, longest, sel, allowed) -> None:
        n, least, found = hi - lo, self.wanted(), []
        every = len(sel) == len(self.qm)
        bar = least - SCORE_MARGIN - self._margin(max(self.dim, cf.shape[1])) * self.norm * longest
        low = bar.astype(np.float32)
        for a in range(0, len(sel), TILE_QUERIES):
            q = sel[a:a + TILE_QUERIES]
            near = np.matmul(self.qf[a:a + TILE_QUERIES] if every else self.qf[q], cf[lo:hi].T, out=self.out[:len(q) * n].reshape(len(q), n))
            qi, ci = np.divmod(np.flatnonzero(~(near < low[q, None])), n)
            if self.fold and len(qi):
                # for queries that many rows are left for, the product of all of them is less work
                many = np.bincount(qi, minlength=len(q)) > max(8, n // 32)
                if many.any():
                    at = np.flatnonzero(many)
                    near = np.matmul(self.q32[q[at]], c32[lo:hi].T, out=self.out[:len(at) * n].reshape(len(at), n))
                    more, cj = np.divmod(np.flatnonzero(~(near < low[q[at], None])), n)
                    few = ~many[qi]
                    qi, ci = qi[few], ci[few]
                if len(qi):
                    ok = ~(_scores(self.q32, c32, q[qi], lo + ci, np.float32) < low[q[qi]])
                    qi, ci = qi[ok], ci[ok]
                if many.any():
                    qi, ci = np.concatenate([qi, at[more]]), np.concatenate([ci, cj])
            if not len(qi):
                continue
            crowd = np.bincount(qi, minlength=len(q)) > 4 * self.k
            if crowd.any():
                found += self._crowd(cm[lo:hi], place[lo:hi], lo, q[crowd], longest, allowed)
                few = ~crowd[qi]
                qi, ci = qi[few], ci[few]
            qi, ci = q[qi], lo + ci
            if allowed is not None:
                ok = allowed[0][qi, allowed[1][ci]]
                qi, ci = qi[ok], ci[ok]
            found.append((qi, ci))
        qi, ci = (np.concatenate([f[n] for f in found]) if found else np.zeros(0, np.int64) for n in (0, 1))
        if len(qi):
            self._merge(qi, ci, _scores(self.qm, cm, qi, ci), place[ci], first + ci)

    def _crowd(self, cm, place, lo, q, longest, allowed) -> list:
        """(query, row) pairs among which the best ``k`` of these queries are; equal scores go by place."""
        wide, found = cm.astype(np.float64), []
        for a in range(0, len(q), CROWD_QUERIES):
            mine = q[a:a + CROWD_QUERIES]
            s = self.qm[mine].astype(np.float64) @ wide.T
            slack = 1e-12 * (1 + self.norm[mine] * longest)[:, None]
            low, high = np.round(s - slack, SCORE_DIGITS), np.round(s + slack, SCORE_DIGITS)
            last = self.rounded[mine, -1:]
            hit = ~(high < np.maximum(last, np.round(self.floor[mine, None] - SCORE_MARGIN, SCORE_DIGITS)))
            hit &= ~((high == last) & (place > self.place[mine, -1:]))
            if allowed is not None:
                hit &= allowed[0][mine][:, allowed[1][lo:lo + len(cm)]]
            qi, ci = np.nonzero(hit)
            r, unsure = low[qi, ci], low[qi, ci] != high[qi, ci]
            order = np.lexsort((place[ci], -r, qi))
            order = order[(_nth(qi[order]) < self.k) | unsure[order]]
            found.append((mine[qi[order]], lo + ci[order]))
        return found

    def _merge(self, qi, ci, s, place, rows) -> None:
        r = np.round(s, SCORE_DIGITS)
        ok = (r >= self.rounded[qi, -1]) & (s >= self.floor[qi])
        if not ok.any():
            return
        qi, s, r, place, rows = qi[ok], s[ok], r[ok], place[ok], rows[ok]
        u = np.unique(qi)
        held = self.row[u].ravel() >= 0
        q = np.concatenate([np.repeat(u, self.k)[held], qi])
        s, r = np.concatenate([self.score[u].ravel()[held], s]), np.concatenate([self.rounded[u].ravel()[held], r])
        place, row = np.concatenate([self.place[u].ravel()[held], place]), np.concatenate([self.row[u].ravel()[held], rows])
        order = np.lexsort((place, -r, q))
        nth = _nth(q[order])
        keep = nth < self.k
        order, nth = order[keep], nth[keep]
        for mine, value in ((self.rounded, r), (self.score, s), (self.place, place), (self.row, row)):
            mine[q[order], nth] = value[order]

    def hits(self, qid_arrow, id_arrow):
        q, n = np.nonzero(self.row >= 0)
        rows = self.row[q, n]
        all_ids = pa.chunked_array(self.seen, type=id_arrow)
        for a in range(0, len(q), 1 << 16):
            part = slice(a, a + (1 << 16))
            ids = all_ids.take(pa.array(rows[part])).combine_chunks()
            yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(q[part])).cast(qid_arrow), ids, pa.array(self.score[q, n][part])],
                                             names=["query_id", "id", "score"])


def _own(a: pa.Array) -> pa.Array:
    """A copy that does not keep the batch it came in."""
    return pa.concat_arrays([a, a.slice(0, 0)])


def _scan_pairs(queries: DataFrame, corpus: DataFrame, k: int, segment: int, qid_type: T.DataType, id_type: T.DataType,
                single: tuple[bool, bool], probes=None) -> DataFrame:
    """Local top-k ``(query_id, id, score)`` of packed queries in every partition of the packed corpus."""
    from pyspark.sql.pandas.types import to_arrow_type
    qid_arrow, id_arrow = to_arrow_type(qid_type), to_arrow_type(id_type)
    q_kind, c_kind = (np.float32 if one else np.float64 for one in single)

    def run(batches):
        best = {}
        for rb in batches:
            for n in range(rb.num_rows):
                key = rb.column("block")[n].as_py()
                if key not in best:          # its vectors come with the first corpus block only
                    ids = _own(rb.column("ids")[n].values)
                    vecs = np.frombuffer(rb.column("vecs")[n].as_buffer(), q_kind).reshape(len(ids), -1)
                    held = _Best(k, ids, vecs, np.frombuffer(rb.column("extra")[n].as_buffer(), np.float64))
                    best[key] = held, probes(held.qm) if probes else None
                held, mine = best[key]
                ids = rb.column("c_ids")[n].values
                cm = np.frombuffer(rb.column("c_vecs")[n].as_buffer(), c_kind).reshape(len(ids), -1)
                if cm.shape[1] != held.qm.shape[1]:
                    raise ValueError(f"query vectors have {held.qm.shape[1]} dimensions, stored vectors {cm.shape[1]}")
                cell, place = np.frombuffer(rb.column("c_extra")[n].as_buffer(), np.int64).reshape(-1, 2).T
                held.add(_own(ids), cm, cell, place, segment, mine)
        for held, _mine in best.values():
            yield from held.hits(qid_arrow, id_arrow)

    schema = T.StructType([T.StructField("query_id", qid_type), T.StructField("id", id_type), T.StructField("score", T.DoubleType())])
    lead = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    c = corpus.select(lead.alias("lead"), *[F.col(x).alias(f"c_{x}") for x in ("ids", "vecs", "extra")])
    # the corpus is streamed, a partition of queries (a block) is held: a product of partitions, nothing is broadcast
    pairs = c.hint("shuffle_replicate_nl").crossJoin(queries.hint("shuffle_replicate_nl"))
    once = [F.when(F.col("lead"), F.col(x)).alias(x) for x in ("ids", "vecs", "extra")]
    return pairs.select("block", *once, "c_ids", "c_vecs", "c_extra").mapInArrow(run, schema)


def _scan_cells(queries: DataFrame, assigned: DataFrame, k: int, probes=None, block_rows: int = BLOCK_ROWS,
                query_block_rows: int = QUERY_BLOCK_ROWS) -> DataFrame:
    """Local top-k of ``queries(query_id, qvec, kth, cell)`` in ``assigned(id, vec, cell)``: rows whose cell a
    query probes (all cells without ``probes``) and that can reach ``kth``, a score that the query is known to reach.

    Both sides are written as blocks, in the order of their cells, and moved no more."""
    spark = queries.sparkSession
    ensure_checkpoint_dir(spark)
    dim = max(1, (assigned.select(F.size("vec")).first() or [1])[0])
    cores = spark.sparkContext.defaultParallelism
    n_queries, n_rows = queries.count(), assigned.count()
    per_block = max(1, min(8 * query_block_rows, PACK_FLOATS // dim))
    blocks = max(1, math.ceil(n_queries / per_block))
    q = _packed(queries.repartitionByRange(blocks, "cell", F.xxhash64("query_id")), "query_id", "qvec", ["kth"], np.float64, 2 * per_block).checkpoint(eager=True)
    # the place of an id among all ids settles ties
    parts = max(1, min(TASKS_PER_CORE * cores, n_rows // block_rows) if n_rows <= TASKS_PER_CORE * cores * SCAN_ROWS else math.ceil(n_rows / SCAN_ROWS))
    placed = assigned.repartitionByRange(parts, "id").sortWithinPartitions("id").withColumn("place", F.monotonically_increasing_id())
    c = _packed(placed.repartitionByRange(parts, "cell", F.xxhash64("id")).sortWithinPartitions("cell", "place"), "id", "vec", ["cell", "place"],
                np.int64, max(1, min(block_rows, PACK_FLOATS // dim))).checkpoint(eager=True)
    tasks = max(math.ceil(TASKS_PER_CORE * cores / blocks), math.ceil(n_rows / SCAN_ROWS))
    return _scan_pairs(q, c.coalesce(max(1, min(tasks, parts))), k, max(1, block_rows // 4), queries.schema["query_id"].dataType, assigned.schema["id"].dataType,
                       (_singles(queries.schema["qvec"].dataType), _singles(assigned.schema["vec"].dataType)), probes)


def _few_hits(queries: DataFrame, k: int) -> bool:
    """Whether ``k`` hits of every query are few enough for a broadcast."""
    return (k * MAX_BROADCAST_QUERIES <= MAX_BROADCAST_HITS
            and queries.select("query_id").limit(MAX_BROADCAST_QUERIES + 1).count() <= MAX_BROADCAST_QUERIES)


# V2
def knn(queries: DataFrame, store: DataFrame, k: int = DEFAULT_K, with_payload: bool = True,
        **blocking) -> DataFrame:
    """Exact k-NN of ``queries(query_id, qvec)`` against ``store(id, embedding, ...)``.

    Returns ``(query_id, rank, id, score[, text, metadata])`` ordered by rank."""
    hits = blocked_topk(queries.select("query_id", "qvec"),
                        store.select("id", F.col("embedding").alias("vec")), k, **blocking)
    if not with_payload:
        return hits
    payload = store.drop("embedding")
    # at most k rows per query: few queries bound the hits, so the payload is not shuffled
    return (F.broadcast(hits) if _few_hits(queries, k) else hits).join(payload, "id", "inner")


# --- cells ---------------------------------------------------------------------

@dataclass(frozen=True)
class Cells:
    """``table(cell BIGINT, parent INT, vec ARRAY<DOUBLE>)``, written; ``parents`` the matrix of the
    parents' unit vectors (row = parent), None for cells that were given without."""
    table: DataFrame
    parents: np.ndarray | None = None


def given_cells(table: DataFrame) -> Cells:
    """Cells from a table ``(cell, vec)``."""
    ensure_checkpoint_dir(table.sparkSession)
    return Cells(table.select(F.col("cell").cast("bigint").alias("cell"), F.lit(0).alias("parent"),
                              F.col("vec").cast("array<double>").alias("vec")).checkpoint(eager=True))


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1.0)


def _spherical_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k unit centroids of unit vectors; a centroid that loses its vectors is dropped."""
    x = _unit(x)
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        best = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, best, x)
        centres = _unit(sums[np.bincount(best, minlength=len(centres)) > 0])
    return centres


def quantise(corpus: DataFrame, nlist: int | None = None, seed: int = 1337, rounds: int = 20) -> Cells:
    """Cells for ``corpus(id, vec)``: about ``nlist``, by default the root of its size.

    Parents (the root of ``nlist``) are trained on a sample of ``SAMPLE_PER_CELL`` vectors for
    each of them; the cells of a parent, its share of ``nlist``, on the sampled vectors that
    are nearest to it, ``SAMPLE_PER_CELL`` for each cell, in one task per parent."""
    spark = corpus.sparkSession
    ensure_checkpoint_dir(spark)
    n = corpus.count()
    nlist = max(1, min(int(nlist or round(math.sqrt(n))), max(n, 1)))
    k1 = max(1, round(math.sqrt(nlist)))
    share = min(1.0, SAMPLE_PER_CELL * nlist / max(n, 1))
    drawn = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)
    sample = corpus.filter(drawn & F.col("vec").isNotNull()).select("id", F.col("vec").cast("array<double>").alias("vec")).checkpoint(eager=True)
    # at most about SAMPLE_PER_CELL x k1 vectors, k1 the fourth root of the store
    seeds = sample.orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id").limit(SAMPLE_PER_CELL * k1).collect()
    table_type = "cell bigint, parent int, vec array<double>"
    if not seeds:
        return Cells(spark.createDataFrame([], table_type))
    parents = _spherical_means(np.array([r["vec"] for r in seeds]), k1, rounds, seed)

    def train(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_h", kind="stable")
        k = min(MAX_CHILDREN, max(1, round(nlist * int(pdf["_all"].iloc[0]) / int(pdf["_sampled"].iloc[0]))))
        centres = _spherical_means(np.stack(pdf["vec"].to_numpy())[:SAMPLE_PER_CELL * k], k, rounds, seed)
        parent = int(key[0])
        return pd.DataFrame({"cell": parent * (1 << 32) + np.arange(len(centres), dtype=np.int64), "parent": parent, "vec": list(centres)})

    placed = sample.mapInArrow(_nearest(parents, np.arange(len(parents))),
                               _placed_schema(sample.schema["id"].dataType)).checkpoint(eager=True)
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("_all"))
    sampled = placed.count()
    nth = F.row_number().over(Window.partitionBy("cell").orderBy("_h", "id"))
    rows = placed.withColumn("_h", F.xxhash64(F.lit(seed + 2), "id")).withColumn("_n", nth) \
                 .filter(F.col("_n") <= SAMPLE_PER_CELL * min(MAX_CHILDREN, nlist)) \
                 .join(F.broadcast(sizes), "cell").withColumn("_sampled", F.lit(sampled))
    table = rows.select("cell", "vec", "_h", "_all", "_sampled").groupBy("cell").applyInPandas(train, table_type)
    return Cells(table.checkpoint(eager=True), parents)


def _placed_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("id", id_type), T.StructField("vec", T.ArrayType(T.DoubleType())),
                         T.StructField("cell", T.LongType()), T.StructField("far", T.DoubleType())])


def _nearest(matrix: np.ndarray, names: np.ndarray):
    """mapInArrow kernel: (id, vec) -> (id, vec, the name of the row of the matrix with the highest
    score, the distance to it); equal scores (rounded) go to the first row."""
    def run(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            vec = rb.column("vec")
            x = np.asarray(vec.flatten(), dtype=np.float64).reshape(rb.num_rows, -1)
            best = np.concatenate([np.round(x[a:a + SCORE_SLICE] @ matrix.T, SCORE_DIGITS).argmax(axis=1) for a in range(0, len(x), SCORE_SLICE)])
            far = np.linalg.norm(x - matrix[best], axis=1)
            yield pa.RecordBatch.from_arrays(
                [rb.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel())),
                 pa.array(names[best].astype(np.int64)), pa.array(far)], names=["id", "vec", "cell", "far"])
    return run


def assign_cells(corpus: DataFrame, cells: Cells) -> DataFrame:
    """``(id, vec, cell, far)``: every vector of ``corpus(id, vec)`` with its nearest cell and the
    distance to that centroid; written.

    The centroids are sent to the tasks while they are small (checked), and are joined to the
    vectors block by block beyond that."""
    spark = corpus.sparkSession
    ensure_checkpoint_dir(spark)
    rows = corpus.select("id", F.col("vec").cast("array<double>").alias("vec")).filter(F.col("vec").isNotNull())
    id_type = rows.schema["id"].dataType
    dim = (cells.table.select(F.size("vec")).first() or [0])[0]
    fits = cells.table.limit(MAX_BROADCAST_CELL_FLOATS // max(dim, 1) + 1).count() <= MAX_BROADCAST_CELL_FLOATS // max(dim, 1)
    if fits:
        held = cells.table.orderBy("cell").collect()
        if not held:
            return rows.select("id", "vec", F.lit(None).cast("bigint").alias("cell"), F.lit(None).cast("double").alias("far")).limit(0)
        matrix, names = np.array([r["vec"] for r in held]), np.array([r["cell"] for r in held])
        return rows.mapInArrow(_nearest(matrix, names), _placed_schema(id_type)).checkpoint(eager=True)
    best = blocked_topk(rows.select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"), F.lit(0).alias("_g")),
                        cells.table.select(F.col("cell").alias("id"), "vec", F.lit(0).alias("_g")), 1, group="_g")
    placed = rows.join(best.select(F.col("query_id").alias("id"), F.col("id").alias("cell")), "id") \
                 .join(cells.table.select("cell", F.col("vec").alias("_c")), "cell")
    far = F.sqrt(F.aggregate(F.zip_with("vec", "_c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))
    return placed.select("id", "vec", "cell", far.alias("far")).checkpoint(eager=True)


def _merge(local: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", SCORE_DIGITS)), F.asc("id"))
    return (local.select("query_id", "id", "score").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
                 .select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score"))


def topk_in_cells(probed: DataFrame, assigned: DataFrame, k: int, **blocking) -> DataFrame:
    """Exact top-k of ``probed(query_id, qvec, cell)`` within the cells that each query probes."""
    return _merge(blocked_topk(probed, assigned.select("id", "vec", "cell"), k, group="cell", **blocking), k)


def _nearest_first(queries: DataFrame, assigned: DataFrame, cells: Cells, k: int, **blocking) -> tuple[DataFrame, DataFrame]:
    """``(query_id, qvec, cell)`` with every query's nearest cell, and its top-k there ``(query_id, rank, id, score)``."""
    ensure_checkpoint_dir(queries.sparkSession)
    held = cells.table.join(assigned.select("cell").distinct(), "cell", "left_semi").orderBy("cell").collect()
    names, centres = np.array([r["cell"] for r in held], dtype=np.int64), np.array([r["vec"] for r in held])

    def probe(batches):
        for rb in batches:
            if not rb.num_rows:
                continue
            x = np.asarray(rb.column("qvec").flatten(), dtype=np.float64).reshape(rb.num_rows, -1)
            best = np.concatenate([(x[a:a + SCORE_SLICE] @ centres.T).argmax(axis=1) for a in range(0, len(x), SCORE_SLICE)])
            yield pa.RecordBatch.from_arrays([rb.column("query_id"), rb.column("qvec"), pa.array(names[best])], names=["query_id", "qvec", "cell"])

    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("qvec", queries.schema["qvec"].dataType),
                           T.StructField("cell", T.LongType())])
    nearest = queries.select("query_id", "qvec").mapInArrow(probe, schema).checkpoint(eager=True)
    return nearest, topk_in_cells(nearest, assigned, k, **blocking).checkpoint(eager=True)


def _with_kth(nearest: DataFrame, first: DataFrame, k: int) -> DataFrame:
    kth = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    return nearest.join(kth, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf"))))


# J4
def cells_that_matter(queries: DataFrame, assigned: DataFrame, cells: Cells, k: int, **blocking) -> tuple[DataFrame, DataFrame]:
    """``(first, rest)``: the top-k of every query in its nearest cell ``(query_id, rank, id, score)``,
    and the ``(query_id, qvec, cell)`` of all other cells whose ball can hold a score as high as
    its k-th there: ``q . centroid + |q| radius`` bounds every score in a cell.

    ``rest`` is a row per query and cell; the search itself keeps its bounds to the blocks."""
    nearest, first = _nearest_first(queries, assigned, cells, k, **blocking)
    balls = assigned.groupBy("cell").agg(F.max("far").alias("radius")).join(cells.table.select("cell", "vec"), "cell").orderBy("cell").collect()
    names = np.array([r["cell"] for r in balls], dtype=np.int64)
    centres, radius = np.array([r["vec"] for r in balls]), np.array([r["radius"] for r in balls])

    def bound(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BOUND_ROWS):      # a few rows at a time: each may leave with every cell
                rb = whole.slice(at, BOUND_ROWS)
                x = np.asarray(rb.column("qvec").flatten(), dtype=np.float64).reshape(rb.num_rows, -1)
                most = x @ centres.T + np.linalg.norm(x, axis=1)[:, None] * radius
                # rounding of scores and bounds is far below this margin
                hit = most >= rb.column("kth").to_numpy(zero_copy_only=False)[:, None] - 10.0 ** (1 - SCORE_DIGITS)
                hit &= names[None, :] != rb.column("cell").to_numpy()[:, None]
                row, cell = np.nonzero(hit)
                yield pa.RecordBatch.from_arrays([rb.column("query_id").take(pa.array(row)), rb.column("qvec").take(pa.array(row)), pa.array(names[cell])],
                                                 names=["query_id", "qvec", "cell"])

    return first, _with_kth(nearest, first, k).mapInArrow(bound, nearest.schema)


def _first_of_equals(corpus: DataFrame, k: int) -> DataFrame:
    """``corpus(id, vec)``, written, without what cannot be a hit: of equal vectors only the first ``k`` ids can.
    Only vectors whose hash is met more than ``k`` times are compared."""
    hashed = corpus.withColumn("_h", F.xxhash64("vec"))
    crowded = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > k).select("_h").checkpoint(eager=True)
    if crowded.isEmpty():
        return corpus
    crowded = broadcast_checked(crowded)
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    firsts = hashed.join(crowded, "_h", "left_semi").select("id", "vec").withColumn("_n", nth).filter(F.col("_n") <= k).drop("_n")
    return hashed.join(crowded, "_h", "left_anti").select("id", "vec").unionByName(firsts).checkpoint(eager=True)


def pruned_topk(queries: DataFrame, corpus: DataFrame, k: int, cells: Cells | None = None, **blocking) -> DataFrame:
    """Exact top-k of ``queries(query_id, qvec)`` against ``corpus(id, vec)``, for query tables of any
    size: blocks of a cell that cannot hold a hit are not scored."""
    ensure_checkpoint_dir(queries.sparkSession)
    single = corpus.schema["vec"].dataType
    queries = queries.select("query_id", "qvec").filter(F.col("qvec").isNotNull()).checkpoint(eager=True)
    corpus = _first_of_equals(corpus.select("id", "vec").filter(F.col("vec").isNotNull()).checkpoint(eager=True), k)
    cells = cells or quantise(corpus)
    if cells.table.isEmpty() or corpus.isEmpty() or queries.isEmpty():
        return queries.select("query_id", F.lit(0).alias("rank"), F.lit(None).cast(corpus.schema["id"].dataType).alias("id"),
                              F.lit(0.0).alias("score")).limit(0)
    dim = (cells.table.select(F.size("vec")).first() or [0])[0]
    if cells.table.count() * dim > MAX_BROADCAST_CELL_FLOATS:      # so many centroids go to no task: the blocks' own balls are left
        q = queries.withColumn("cell", F.lit(0).cast("bigint")).withColumn("kth", F.lit(float("-inf")))
        return _merge(_scan_cells(q, corpus.withColumn("cell", F.lit(0).cast("bigint")), k, **blocking), k)
    assigned = assign_cells(corpus, cells)
    nearest, first = _nearest_first(queries, assigned, cells, k, **blocking)
    rows = assigned.select("id", F.col("vec").cast(single).alias("vec"), "cell")
    return _merge(_scan_cells(_with_kth(nearest, first, k), rows, k, **blocking), k)


# V3
def probes_for_recall(corpus: DataFrame, assigned: DataFrame, cells: Cells, k: int, recall: float = RECALL,
                      sample: int = RECALL_SAMPLE, seed: int = 1337) -> int:
    """The number of cells to probe so that a sample of stored vectors finds the share ``recall`` of
    its exact ``k`` neighbours (itself left out)."""
    drawn = corpus.filter(F.col("vec").isNotNull()).orderBy(F.xxhash64(F.lit(seed + 3), "id"), "id").limit(sample) \
                  .select(F.col("id").alias("query_id"), F.col("vec").alias("qvec")).checkpoint(eager=True)
    exact = blocked_topk(drawn, assigned.select("id", "vec"), k + 1).filter(F.col("query_id") != F.col("id"))
    cell_of = assigned.select("id", F.col("cell"))
    ranked = blocked_topk(drawn, cells.table.select(F.col("cell").alias("id"), "vec"), max(1, cells.table.count()))
    rank = exact.select("query_id", "id").join(cell_of, "id").join(
        ranked.select("query_id", F.col("id").alias("cell"), F.col("rank").alias("probe")), ["query_id", "cell"])
    got = rank.agg(F.expr(f"percentile_disc({float(recall)}) within group (order by probe)").alias("n")).first()["n"]
    return max(1, int(got or 1))


def _probing(cells: Cells, nprobe: int):
    """For the queries of a block, which of them probe a cell: it is among their ``nprobe`` best."""
    rows = cells.table.orderBy("cell").collect()
    bc = cells.table.sparkSession.sparkContext.broadcast((np.array([r["cell"] for r in rows], dtype=np.int64), np.array([r["vec"] for r in rows])))

    def of(qm: np.ndarray):
        names, centres = bc.value
        query, cell = [], []
        for a in range(0, len(qm), SCORE_SLICE):
            rounded = np.round(qm[a:a + SCORE_SLICE] @ centres.T, SCORE_DIGITS)
            q, c = _reach(rounded, nprobe)
            keep = _first_k(q, rounded[q, c], c, nprobe)
            query.append(a + q[keep])
            cell.append(c[keep])
        query, cell = np.concatenate(query).astype(np.int32), np.concatenate(cell).astype(np.int32)
        order = np.argsort(cell, kind="stable")
        query, ends = query[order], np.searchsorted(cell[order], np.arange(len(names) + 1))

        def mine(name: int) -> np.ndarray:
            at, out = np.searchsorted(names, name), np.zeros(len(qm), dtype=bool)
            out[query[ends[at]:ends[at + 1]]] = True
            return out
        return mine
    return of


def knn_approx(queries: DataFrame, store: DataFrame, k: int = DEFAULT_K, nlist: int | None = None,
               nprobe: int | None = None, seed: int = 1337, recall: float = RECALL, cells: Cells | None = None, **blocking) -> DataFrame:
    """Approximate k-NN: the ``nprobe`` best cells per query, exact inside them.  Without ``nprobe``,
    as many as a sample needs for ``recall``."""
    vecs = store.select("id", F.col("embedding").alias("vec"))
    cells = cells or quantise(vecs, nlist, seed)
    if cells.table.isEmpty():
        return knn(queries, store, k, **blocking)
    assigned = assign_cells(vecs, cells)
    nprobe = int(nprobe) if nprobe else probes_for_recall(vecs, assigned, cells, k, recall, seed=seed)
    queries = queries.select("query_id", "qvec").filter(F.col("query_id").isNotNull() & F.col("qvec").isNotNull()).checkpoint(eager=True)

    def listed(some: DataFrame) -> DataFrame:       # a row per query and cell
        probes = blocked_topk(some, cells.table.select(F.col("cell").alias("id"), "vec"), max(1, nprobe))
        probed = probes.select("query_id", F.col("id").alias("cell")).join(some, "query_id")
        return topk_in_cells(probed, assigned, k, **blocking)

    dim = (cells.table.select(F.size("vec")).first() or [0])[0]
    if dim and cells.table.limit(MAX_BROADCAST_CELL_FLOATS // dim + 1).count() <= MAX_BROADCAST_CELL_FLOATS // dim:
        # rows of one query id share its probes: such ids go the longer way
        again = queries.groupBy("query_id").count().filter("count > 1").select("query_id").checkpoint(eager=True)
        repeated = not again.isEmpty()
        once = queries.join(again, "query_id", "left_anti") if repeated else queries
        q = once.withColumn("cell", F.lit(0).cast("bigint")).withColumn("kth", F.lit(float("-inf")))
        rows = assigned.select("id", F.col("vec").cast(vecs.schema["vec"].dataType).alias("vec"), "cell")
        hits = _merge(_scan_cells(q, rows, k, _probing(cells, max(1, nprobe)), **blocking), k)
        if repeated:
            hits = hits.unionByName(listed(queries.join(again, "query_id", "left_semi")))
    else:
        hits = listed(queries)
    return hits.join(store.drop("embedding"), "id", "inner")


# V4 default scorer
def _words(text: Column) -> Column:
    """The distinct lower-cased word tokens."""
    return F.array_distinct(tx.word_tokens(F.lower(text)))


def _word_overlap(a: Column, b: Column) -> Column:
    # the common words are counted once: the lambda only refers to their number
    share = F.transform(F.array(F.size(F.array_intersect(a, b))),
                        lambda n: F.when((n >= 0) & (F.size(a) + F.size(b) > 0), n / (F.size(a) + F.size(b) - n)))[0]
    return F.coalesce(share.cast("double"), F.lit(0.0))


def token_overlap(query: Column, text: Column) -> Column:
    """Jaccard overlap of lower-cased word-token sets (0.0 when both are empty)."""
    return _word_overlap(_words(query), _words(text))


def _reranked(scored: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.asc("rank"))
    return scored.withColumn("rank", F.row_number().over(w).cast("int"))


def _score(scorer, query: str, text: str) -> Column:
    return F.coalesce(scorer(F.col(query), F.col(text)).cast("double"), F.lit(0.0)).alias("rerank_score")


def rerank(hits: DataFrame, queries: DataFrame, scorer=token_overlap) -> DataFrame:
    """Add ``rerank_score`` (unscorable -> 0.0) and re-rank each query's
    hits by it, descending, stable on the previous rank."""
    j = hits.join(queries.select("query_id", F.col("query").alias("_q")), "query_id", "inner")
    return _reranked(j.withColumn("rerank_score", _score(scorer, "_q", "text")).drop("_q"))


def _rerank_payload(hits: DataFrame, queries: DataFrame, payload: DataFrame, scorer=token_overlap) -> DataFrame:
    """``rerank`` of ``hits(query_id, rank, id, score)`` whose texts are in ``payload(id, text, ...)``.

    The queries, the shorter texts, go to the hits first, and the scores are made where these meet
    their payload, so what is not asked for is moved no further.  The default scorer splits every text once,
    not once per hit."""
    cols, text = ["query_id", "id", "rank", "score", *[c for c in payload.columns if c != "id"]], "text"
    q = queries.select("query_id", F.col("query").alias("_q"))
    if scorer is token_overlap:
        q, payload = q.withColumn("_q", _words(F.col("_q"))), payload.withColumn("_t", _words(F.col("text")))
        scorer, text = _word_overlap, "_t"
    j = hits.join(q, "query_id", "inner").join(payload, "id", "inner")
    return _reranked(j.select(*cols, _score(scorer, "_q", text)))


def embed_queries(queries: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    embedder = embedder or hashed_embedder()
    return queries.withColumn("qvec", embedder(F.col("query")))


# V5
def retrieve(queries: DataFrame, store: DataFrame, k: int = DEFAULT_K, rerank_hits: bool = False,
             rerank_top_k: int | None = DEFAULT_RERANK_POOL, embedder: Embedder | None = None,
             scorer=token_overlap, approx: dict | None = None) -> DataFrame:
    """Embed ``queries(query_id, query)``, over-fetch ``max(k, rerank_top_k)``,
    optionally rerank, cut to ``k``."""
    k = int(k)
    first = max(k, int(rerank_top_k)) if (rerank_top_k is not None and rerank_hits) else k
    q = embed_queries(queries, embedder)
    if rerank_hits and not approx and not _few_hits(queries, first):
        return _rerank_payload(knn(q, store, first, with_payload=False), queries, store.drop("embedding"), scorer).filter(F.col("rank") <= k)
    hits = knn_approx(q, store, first, **approx) if approx else knn(q, store, first)
    if rerank_hits:
        hits = rerank(hits, queries, scorer)
    return hits.filter(F.col("rank") <= k)


# T3
def sample_messages(corpus: DataFrame, n: int, seed: int | None = 1337) -> DataFrame:
    """Repeatable pseudo-random sample of ``n`` messages without replacement;
    ``n <= 0`` -> empty; ``n >= size`` -> every message."""
    n = int(n)
    if n <= 0:
        return corpus.limit(0)
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("source").cast("string"), F.col("line_no").cast("string")))
    return corpus.orderBy(key, "source", "line_no").limit(n)


# T2
def first_messages(corpus: DataFrame, n: int | None) -> DataFrame:
    """First ``n`` messages in corpus order (negative -> 0); None -> all."""
    return corpus if n is None else first_rows(corpus, n)


# V6
def export_retrieval(corpus: DataFrame, store: DataFrame, queries: list[str] | None = None,
                     samples: int = 10, k: int = 5, seed: int | None = None,
                     embedder: Embedder | None = None, fail_on_empty: bool = False) -> DataFrame:
    """Retrieval samples ``(query_id, query, results ARRAY<STRUCT<id, score, text, metadata>>)``.

    Explicit non-blank ``queries`` replace sampling; otherwise ``samples``
    messages are drawn (T3).  ``fail_on_empty`` raises when the corpus has no
    message or no query is left."""
    spark = corpus.sparkSession
    if fail_on_empty and corpus.isEmpty():
        raise ValueError("the corpus has no non-blank message")
    if queries:
        picked = [q for q in (str(x) for x in queries) if q.strip()]
        if not picked:
            if fail_on_empty:
                raise ValueError("all queries are blank")
            return spark.createDataFrame([], "query_id long, query string")
        qdf = spark.createDataFrame(list(enumerate(picked, start=1)), "query_id long, query string")
    else:
        s = sample_messages(corpus, samples, seed)
        qdf = s.select(F.concat_ws(":", F.col("source").cast("string"), F.col("line_no").cast("string"))
                       .alias("query_id"), F.col("text").alias("query"))
    hits = retrieve(qdf, store, k, embedder=embedder)
    cols = [c for c in ("id", "score", "text", "metadata") if c in hits.columns]
    res = (hits.groupBy("query_id")
               .agg(F.sort_array(F.collect_list(F.struct("rank", *cols))).alias("_r"))
               .select("query_id", F.transform("_r", lambda s: F.struct(*[s[c].alias(c) for c in cols]))
                       .alias("results")))
    return qdf.join(res, "query_id", "left").withColumn(
        "results", F.coalesce("results", F.array().cast(res.schema["results"].dataType)))
