"""Exact and near-duplicate removal.

Order matters: the first item in ``order_cols`` order wins.

* exact (A5): winners = ``min(order)`` per content hash (map-side partial
  aggregate), joined back on ``(hash, order...)`` so a hot hash never lands in
  one task.
* near pairs (J3): two items match when they share any 16-bit band value (value
  only, any band position) and their SimHashes differ in at most ``t`` bits.
* blocks: items are keyed on their (at most four) band values, and the items of a
  value are gathered in chunks of about ``CHUNK``, one row each (node and hash, 16
  bytes an item).  Chunks of a value meet pairwise and are compared in NumPy, so a
  candidate is never a row.  A pair that shares several values is written under the
  smallest of them: no ``distinct`` over pairs.
* fuzzy keep (A6): "drop an item iff an earlier *kept* item matches it" is the
  greedy lexicographically-first maximal independent set of the match graph.  It
  is computed by prefixes of the order, each some times the one before: edges are
  only listed inside a prefix (shortened while its candidates are too many), its
  kept items then drop their later matches among all that is left, which thins out
  crowds before the next prefix.  Lineage is cut each round by ``checkpoint()`` to
  the shared checkpoint folder.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import hashing as H
from parley.functions import text as tx
from parley.session import ensure_checkpoint_dir

_log = logging.getLogger("parley.dedupe")


def exact_keep(items: DataFrame, key: str, order_cols: list[str], seen: DataFrame | None = None,
               out: str = "exact_keep") -> DataFrame:
    """A5 (+ J2 when ``seen`` holds a ``key`` column of stored hashes)."""
    # one order column: its plain minimum (a struct would force a sort-based aggregate)
    order = F.struct(F.min(order_cols[0]).alias(order_cols[0])) if len(order_cols) == 1 else F.min(F.struct(*order_cols))
    first = items.groupBy(key).agg(order.alias("_first"))
    if seen is not None:
        first = first.join(seen.select(key).distinct(), key, "left_anti")
    winners = first.select(key, *[F.col("_first")[c].alias(c) for c in order_cols]).withColumn("_win", F.lit(True))
    return (items.join(winners, [key, *order_cols], "left")
                 .withColumn(out, F.coalesce(F.col("_win"), F.lit(False)))
                 .drop("_win"))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _pieces(bits: list[int], count: int) -> list[int]:
    """Masks of ``count`` nearly equal runs of a list of bit positions."""
    cuts = [round(i * len(bits) / count) for i in range(count + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:])]


SMALL_BLOCK = 1024   # members of a refined block
LEVELS = 4           # pieces that may be added to a crowded key
CHUNK = 4096         # members of a band value that are one row
COMPARED = 1 << 20   # hashes compared at once
FRONT = 2048         # items of the first prefix
GROWTH = 8           # times the prefix before
MAX_CANDIDATES = 1 << 27   # pairs of a prefix that share a band value; more shorten it


def _refining_masks(max_hamming: int) -> list[int]:
    """Masks of the pieces of the hash, ``t + LEVELS`` of them as far as there are bits."""
    return _pieces(list(range(64)), min(64, max(0, int(max_hamming)) + LEVELS))


def _blocks(nodes: DataFrame, max_hamming: int, small: int = SMALL_BLOCK) -> tuple[DataFrame, DataFrame]:
    """``(blocks, hot)``, each ``(g, node, h)``: the members of blocks of 2 to ``small``, and of
    those that are larger after all refinement.  Two nodes that match share a block of either
    kind.  (A view of the crowds in a table; the searches below compare whole band values.)  ``g`` is a hash of what a block has in common; a collision only adds candidates."""
    t = max(0, int(max_hamming))
    masks = _refining_masks(t)
    levels = max(0, len(masks) - t)
    # level 0: the distinct band values of a node; ``last`` is the last piece in the key
    rows = nodes.select(F.explode(F.array_distinct(H.simhash_bands("simhash"))).alias("v"), "node", F.col("simhash").alias("h")) \
                .select(F.xxhash64("v").alias("g"), "node", "h", F.lit(-1).alias("last"))
    found = []
    for level in range(levels + 1):
        sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        met = rows.join(sizes, "g").checkpoint(eager=True)
        found.append(met.filter(F.col("n") <= small).select("g", "node", "h"))
        crowded = met.filter(F.col("n") > small).drop("n")
        if level == levels or crowded.isEmpty():
            break
        # the next piece; enough pieces must follow for the levels to come
        room = len(masks) - (levels - level - 1)
        pieces = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(_signed(m)).cast("bigint").alias("mask")) for i, m in enumerate(masks[:room])])
        rows = crowded.withColumn("_p", F.explode(F.filter(pieces, lambda p: p["i"] > F.col("last")))).select(
            F.xxhash64("g", "_p.i", F.col("h").bitwiseAND(F.col("_p.mask"))).alias("g"), "node", "h", F.col("_p.i").alias("last"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, crowded.select("g", "node", "h")


def near_duplicate_pairs(nodes: DataFrame, node_col: str = "node", hash_col: str = "simhash",
                         max_hamming: int = H.DEFAULT_MAX_HAMMING, cut: bool = True) -> DataFrame:
    """``(a, b, distance)`` with ``a < b`` for every matching pair of nodes.

    ``nodes`` must hold one row per node; equal hashes should be collapsed first
    (``fuzzy_keep`` does).  With ``cut`` the narrow node table is checkpointed
    first, so the hashing upstream runs once for both sides of the self-join."""
    t = int(max_hamming)
    spark = nodes.sparkSession
    if cut:
        ensure_checkpoint_dir(spark)
        nodes = nodes.select(node_col, hash_col).checkpoint(eager=True)
    if t < 0:
        return spark.createDataFrame([], nodes.select(F.col(node_col).alias("a"), F.col(node_col).alias("b"),
                                                      F.lit(0).alias("distance")).schema)
    nodes = nodes.select(F.col(node_col).alias("node"), F.col(hash_col).alias("simhash"))
    x, y = F.col("x"), F.col("y")
    pairs = _matches(nodes, t).filter(x != y).select(F.when(x < y, x).otherwise(y).alias("a"), F.when(x < y, y).otherwise(x).alias("b"), "distance")
    # a node is one row: where it is not, its pairs may repeat
    return pairs if nodes.groupBy("node").count().filter("count > 1").isEmpty() else pairs.distinct()


def _banded(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.explode(F.array_distinct(H.simhash_bands("simhash"))).alias("v"), "node", F.col("simhash").alias("h"))


def _chunks(rows: DataFrame, least: int, chunk: int) -> DataFrame:
    """``(v, c, n, m)``: the members ``(node, h)`` of every band value of at least ``least``, in ``n`` chunks."""
    # at most 65,536 band values
    sizes = rows.groupBy("v").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least) \
                .select("v", F.ceil(F.col("_n") / chunk).cast("int").alias("n"))
    c = F.pmod(F.xxhash64("node", "h"), F.col("n")).cast("int")
    return rows.join(F.broadcast(sizes), "v").groupBy("v", c.alias("c"), "n").agg(F.collect_list(F.struct("node", "h")).alias("m"))


def _near_rows(a: np.ndarray, b: np.ndarray, t: int, later: bool):
    """(i, j, distance) of the hashes within ``t``, some rows of ``a`` at a time; ``later``: only j > i."""
    step = max(1, COMPARED // max(1, len(b)))
    for lo in range(0, len(a), step):
        far = np.bitwise_count(a[lo:lo + step, None] ^ b[None, :])
        near = far <= t
        if later:
            near &= np.arange(len(b))[None, :] > np.arange(lo, lo + len(near))[:, None]
        i, j = np.nonzero(near)
        if len(i):
            yield i + lo, j, far[i, j]


def _smallest_common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest band value that two hashes share."""
    cut = lambda h: [(h >> np.uint64(H.BAND_BITS * k)) & np.uint64(0xFFFF) for k in range(H.BANDS)]
    out = np.full(len(x), 1 << H.BAND_BITS, dtype=np.uint64)
    mine, theirs = cut(x), cut(y)
    for p in mine:
        for q in theirs:
            out = np.where((p == q) & (p < out), p, out)
    return out


def _members(rb, name: str, i: int):
    m = rb.column(name)[i].values
    return m.field(0), m.field(1).to_numpy(zero_copy_only=False).view(np.uint64)


def _matches(nodes: DataFrame, t: int, chunk: int | None = None) -> DataFrame:
    """``(x, y, distance)``: every matching pair of the rows of ``nodes(node, simhash)`` once, in any order."""
    chunks = _chunks(_banded(nodes), 2, chunk or CHUNK)
    # a chunk goes to every later chunk of its value, and to itself
    left = chunks.select("v", F.col("c").alias("_c"), F.explode(F.sequence(F.col("c"), F.col("n") - 1)).alias("c"), F.col("m").alias("mx"))
    met = left.join(chunks.select("v", "c", F.col("m").alias("my")), ["v", "c"]).select("v", (F.col("_c") == F.col("c")).alias("same"), "mx", "my")
    node = nodes.schema["node"].dataType
    schema = T.StructType([T.StructField("x", node), T.StructField("y", node), T.StructField("distance", T.IntegerType())])

    def run(batches):
        for rb in batches:
            for n in range(rb.num_rows):
                (xs, hx), (ys, hy) = _members(rb, "mx", n), _members(rb, "my", n)
                v = rb.column("v")[n].as_py()
                for i, j, far in _near_rows(hx, hy, t, rb.column("same")[n].as_py()):
                    here = _smallest_common(hx[i], hy[j]) == v
                    yield pa.RecordBatch.from_arrays([xs.take(pa.array(i[here])), ys.take(pa.array(j[here])), pa.array(far[here].astype(np.int32))],
                                                     names=["x", "y", "distance"])
    return met.mapInArrow(run, schema)


def _near_any(rest: DataFrame, kept: DataFrame, t: int, chunk: int) -> DataFrame:
    """``n``: the nodes of ``rest(node, simhash)`` that match one of ``kept``; may repeat."""
    a, b = _chunks(_banded(rest), 1, chunk), _chunks(_banded(kept), 1, chunk)
    # every chunk of the rest takes its turn with the chunks of the kept
    wide = b.groupBy("v").agg(F.max("n").alias("k"))
    left = a.join(wide, "v").select("v", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("c"), F.col("m").alias("mx"))
    met = left.join(b.select("v", "c", F.col("m").alias("my")), ["v", "c"]).select("mx", "my")

    def run(batches):
        for rb in batches:
            for n in range(rb.num_rows):
                (xs, hx), (_ys, hy) = _members(rb, "mx", n), _members(rb, "my", n)
                got = [np.unique(i) for i, _j, _far in _near_rows(hx, hy, t, False)]
                if got:
                    yield pa.RecordBatch.from_arrays([xs.take(pa.array(np.concatenate(got)))], names=["n"])
    return met.mapInArrow(run, T.StructType([T.StructField("n", rest.schema["node"].dataType)]))


def greedy_dropped(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Nodes dropped by the sequential rule, from edges ``(a, b)`` with ``a`` earlier.

    Each round: nodes that are only an edge source are kept; their targets are
    dropped; edges touching a decided node go.  The minimum remaining node is
    always decided, so the loop ends; no node is left undecided."""
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    e = edges.select("a", "b").distinct().checkpoint(eager=True)
    parts = []
    rounds = 0
    while not e.isEmpty():
        rounds += 1
        if max_rounds is not None and rounds > max_rounds:
            raise RuntimeError(f"greedy dedupe did not settle in {max_rounds} rounds")
        targets = e.select(F.col("b").alias("n")).distinct()
        kept_now = e.select(F.col("a").alias("n")).distinct().join(targets, "n", "left_anti")
        dropped_now = (e.join(kept_now.withColumnRenamed("n", "a"), "a", "left_semi")
                        .select(F.col("b").alias("n")).distinct().checkpoint(eager=True))
        parts.append(dropped_now)
        e = (e.join(kept_now.withColumnRenamed("n", "a"), "a", "left_anti")
              .join(dropped_now.withColumnRenamed("n", "a"), "a", "left_anti")
              .join(dropped_now.withColumnRenamed("n", "b"), "b", "left_anti")
              .checkpoint(eager=True))
    _log.info("greedy dedupe settled in %d rounds", rounds)
    if not parts:
        return spark.createDataFrame([], edges.select(F.col("a").alias("n")).schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def greedy_dropped_blocks(nodes: DataFrame, max_hamming: int = H.DEFAULT_MAX_HAMMING,
                          small: int = SMALL_BLOCK, front: int = FRONT) -> DataFrame:
    """Nodes dropped by the sequential rule, from ``nodes(node, simhash)``.

    The first ``front`` nodes in order are settled by their edges, and the kept ones drop
    their matches among all the others; then a longer prefix of what is left, until nothing
    is.  Band values are compared in chunks of up to ``4 * small`` members."""
    t = int(max_hamming)
    spark = nodes.sparkSession
    ensure_checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunk = max(1, 4 * int(small))
    # numbers in the order of the nodes
    names = nodes.select("node").distinct().repartitionByRange(parts, "node").sortWithinPartitions("node") \
                 .withColumn("n", F.monotonically_increasing_id()).checkpoint(eager=True)
    left = nodes.join(names, "node").select(F.col("n").alias("node"), "simhash").checkpoint(eager=True)
    dropped, size, rounds = [], max(1, int(front)), 0
    count = left.count()
    while count and t >= 0:
        rounds += 1
        prefix, mine, cut = left, count, None
        while mine > 1 and (mine > size or (mine > front and _candidates(prefix) > MAX_CANDIDATES)):
            share = size / mine if mine > size else 1 / GROWTH
            lower = prefix.agg(F.percentile_approx("node", F.lit(share), F.lit(10_000)).alias("p")).first()["p"]
            if lower == cut:
                break
            cut, prefix = lower, left.filter(F.col("node") <= lower)
            mine = prefix.count()
            size = max(min(size, mine), 1)
        prefix = prefix.checkpoint(eager=True)
        gone = greedy_dropped(_matches(prefix, t, chunk).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct().checkpoint(eager=True)
        dropped.append(gone)
        if cut is None:
            break
        kept = prefix.join(gone.withColumnRenamed("n", "node"), "node", "left_anti")
        rest = left.filter(F.col("node") > cut)
        near = _near_any(rest, kept, t, chunk).distinct().checkpoint(eager=True)
        dropped.append(near)
        left = rest.join(near.withColumnRenamed("n", "node"), "node", "left_anti").checkpoint(eager=True)
        count, size = left.count(), GROWTH * size
    _log.info("block dedupe settled in %d prefixes", rounds)
    if not dropped:
        return nodes.select(F.col("node").alias("n")).limit(0)
    out = dropped[0]
    for more in dropped[1:]:
        out = out.unionByName(more)
    return names.join(out, "n").select(F.col("node").alias("n"))


def _candidates(nodes: DataFrame) -> int:
    sizes = _banded(nodes).groupBy("v").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return int(sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0)


def fuzzy_keep_hashes(items: DataFrame, simhash: F.Column, order_cols: list[str], max_hamming: int = H.DEFAULT_MAX_HAMMING,
                      out: str = "fuzzy_keep") -> DataFrame:
    """A6 over hashes: add boolean ``out``.  Rows whose ``simhash`` is null are dropped and
    never match anything."""
    ensure_checkpoint_dir(items.sparkSession)
    # narrow table of candidates, hashed once and cut from the lineage
    cand = items.select(F.struct(*order_cols).alias("node"), simhash.alias("simhash")).filter("simhash is not null").checkpoint(eager=True)
    if int(max_hamming) < 0:
        kept = cand.select("node")
    else:
        # equal hashes: only the first can survive (hamming 0 matches every later one)
        reps = cand.groupBy("simhash").agg(F.min("node").alias("node")).checkpoint(eager=True)
        dropped = greedy_dropped_blocks(reps, max_hamming)
        kept = reps.join(dropped.withColumnRenamed("n", "node"), "node", "left_anti").select("node")
    kept = kept.select(*[F.col("node")[c].alias(c) for c in order_cols], F.lit(True).alias("_k"))
    return (items.join(kept, order_cols, "left")
                 .withColumn(out, F.coalesce(F.col("_k"), F.lit(False)))
                 .drop("_k"))


def fuzzy_keep(items: DataFrame, text_col: str, order_cols: list[str], max_hamming: int = H.DEFAULT_MAX_HAMMING,
               eligible_col: str | None = None, out: str = "fuzzy_keep") -> DataFrame:
    """Add boolean ``out``.  Blank texts (and rows with ``eligible_col`` false)
    are dropped and never match anything."""
    elig = tx.strip_ws(F.col(text_col)) != ""
    if eligible_col is not None:
        elig = elig & F.col(eligible_col)
    return fuzzy_keep_hashes(items, F.when(elig, H.simhash64(F.col(text_col))), order_cols, max_hamming, out)
