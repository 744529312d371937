"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits meet at a variant that is within half the radius
of both, so every distinct fingerprint emits the variants around it, rows are grouped by
variant, and fingerprints that meet are candidates, verified on all 64 bits.

The whole-word ball of radius 2 has 2,081 variants.  With ``blocks=2`` the same ball
hashing runs on the two 32-bit halves: of 4 differing bits one half holds at most 2
(pigeonhole), so a ball of radius 1 per half, 2 x 33 variants, loses no pair.  What meets
at a variant is then handled without ever listing the pairs of a large group:

* two or three fingerprints: their pairs, read off ``min``, ``max`` and the xor of all;
* more: a star from the smallest to those within ``radius`` of it.  Where the stars
  together leave all fingerprints of a variant in one component, nothing more can be
  gained there; elsewhere up to ``CROWD`` fingerprints are compared within one row, and beyond
  that these fingerprints emit their whole-word balls.  All
  members of a whole-word variant are within ``radius`` of each other, so a star around
  the smallest holds every link that matters to the components.

Equal fingerprints are one node, whatever the number of their documents.  Components come
from alternating large and small stars, each round written to the shared folder.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any
other; documents with equal ids keep a row each; a null id never names a component unless
all ids of the component are null; an empty table gives no rows; other columns are
ignored.  Texts are hashed in slices of bounded size, whatever their length.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import checked_broadcast, materialise

SEED = 42
SHINGLE = 4
RADIUS = 4
BLOCKS = 2
CROWD = 1024
BROADCAST_GROUPS = 500_000   # rows of 28 bytes that one broadcast may hold
_VOTES = 1 << 17   # shingle hashes voted on at once (8 MB of bits)


def shingle_hashes(text: str, n: int) -> np.ndarray:
    """XXH64 of every word shingle of a text, repeats kept (big-endian words)."""
    words = text.encode("utf-8").lower().split()   # bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, dtype=">u8")
    line = b" ".join(words)
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    k = min(n, len(words))
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(line[s:e], SEED) for s, e in
                                   zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist(), strict=True)]),
                         dtype=">u8")


def majority_bits(hashes: np.ndarray) -> int:
    """Signed 64-bit value of the bits that are set in over half of the hashes."""
    votes = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _VOTES):
        part = np.ascontiguousarray(hashes[i:i + _VOTES]).view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes)).view(">i8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    @F.arrow_udf(T.LongType())
    def fingerprints(texts: pa.Array) -> pa.Array:
        return pa.array([majority_bits(shingle_hashes(t.as_py() or "", shingle)) for t in texts], type=pa.int64())

    return fingerprints(text)


def _flips(places: range, most: int) -> list[int]:
    return [sum(1 << p for p in c) for k in range(most + 1) for c in combinations(places, k)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def emitted(fps: DataFrame, blocks: int, radius: int) -> DataFrame:
    """(block, variant, fp): the ball around every fingerprint, block by block."""
    width = 64 // blocks
    half = (radius // blocks + 1) // 2
    out = None
    for b in range(blocks):
        places = range(b * width, (b + 1) * width)
        care = _signed(sum(1 << p for p in places))
        flips = F.explode(F.array(*[F.lit(_signed(f)).cast("bigint") for f in _flips(places, half)]))
        part = fps.select("fp", flips.alias("flip")).select(
            F.lit(b).alias("block"), F.col("fp").bitwiseAND(F.lit(care)).bitwiseXOR(F.col("flip")).alias("variant"), "fp")
        out = part if out is None else out.unionAll(part)
    return out


def _near(a: str, b: str, radius: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """(a, b): links between distinct fingerprints that give the same components as all
    pairs within ``radius`` bits."""
    if radius // blocks % 2 and blocks > 1:
        raise ValueError("the radius within a block must be even, or blocks must be 1")
    if blocks == 1:
        return _stars(fps, radius)
    met = materialise(emitted(fps, blocks, radius).groupBy("block", "variant")
                      .agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"), F.bit_xor("fp").alias("x"))
                      .filter("n > 1"), "ball-met")
    third = F.col("x").bitwiseXOR(F.col("a")).bitwiseXOR(F.col("b"))
    few = met.filter("n <= 3").select(F.explode(F.when(F.col("n") == 2, F.array(F.struct("a", "b"))).otherwise(F.array(
        F.struct("a", "b"), F.struct(F.col("a"), third.alias("b")), F.struct(third.alias("a"), F.col("b"))))).alias("p")).select("p.*")
    groups = met.filter("n > 3").select("block", "variant", "n", "a")
    members = materialise(emitted(fps, blocks, radius).join(checked_broadcast(groups, BROADCAST_GROUPS), ["block", "variant"])
                          .withColumnRenamed("fp", "b"), "ball-members")
    first = materialise(few.unionAll(members.select("a", "b")).filter("a <> b").filter(_near("a", "b", radius)).distinct(), "ball-links")

    roots = components(first)
    placed = members.select("block", "variant", "n", F.col("b").alias("fp")).join(
        roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = materialise(placed, "ball-placed")
    open_groups = (placed.groupBy("block", "variant").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
                   .filter("lo <> hi").select("block", "variant"))
    left = materialise(placed.join(open_groups, ["block", "variant"], "left_semi"), "ball-open")
    listed = (left.filter(F.col("n") <= crowd).groupBy("block", "variant")
              .agg(F.array_sort(F.collect_list(F.struct("root", "fp"))).alias("all")))
    # sorted by component: a fingerprint is compared, inside its row, with those behind it that
    # are of another component; only links become rows
    behind = F.filter(F.slice("all", F.col("i") + 2, F.lit(crowd)), lambda o: (o["root"] != F.col("one.root")) & (
        F.bit_count(o["fp"].bitwiseXOR(F.col("one.fp"))) <= radius))
    pairs = (listed.select("all", F.posexplode("all").alias("i", "one"))
             .select(F.col("one.fp").alias("a"), F.explode(F.transform(behind, lambda o: o["fp"])).alias("b")))
    hot = left.filter(F.col("n") > crowd).select("fp").distinct()
    return (roots.select(F.col("root").alias("a"), F.col("node").alias("b")).filter("a <> b")
            .unionAll(pairs).unionAll(_stars(hot, radius)).distinct())


def _stars(fps: DataFrame, radius: int) -> DataFrame:
    """Links by whole-word balls: whatever shares a variant is linked to the smallest there."""
    balls = emitted(fps, 1, radius)
    hubs = balls.groupBy("variant").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    found = balls.select("variant", F.col("fp").alias("b")).join(hubs, "variant").filter("a < b").select("a", "b").distinct()
    # for an odd radius two members of a variant may be one bit further apart
    return found if radius % 2 == 0 else found.filter(_near("a", "b", radius))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node of the component, for all nodes of ``edges``
    (a, b).  Alternates large stars (neighbours above a node move to the smallest around it)
    and small stars (neighbours below move to the smallest) until nothing changes."""
    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    # b is the larger end
    now = materialise(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                      .distinct(), "star")
    before = state(now)
    for _ in range(rounds):
        if before[0] == 0:
            break
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        moved = small.filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        now = materialise(moved.unionAll(low.select(F.col("m").alias("a"), "b")).distinct(), "star")
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return nodes.unionAll(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id, text_hash, keeper_hash) of every document; component_id is the
    smallest id that is reachable over links of at most ``radius`` differing bits, and
    keeper_hash the (smallest) hash of a text that has this id there: two components may have
    the same smallest id where ids repeat."""
    prints = materialise(docs.select(F.col(id_col), F.xxhash64(F.col(text_col)).alias("text_hash"),
                                     fingerprint(F.col(text_col), shingle).alias("fp")), "simhash")
    # in order of id, null ids last
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("text_hash").alias("hash")))
    classes = materialise(prints.groupBy("fp").agg(first.alias("first")), "simhash-classes")
    roots = components(links(classes.select("fp"), radius, blocks))
    # first document of each component of two or more fingerprints
    linked = classes.join(roots.withColumnRenamed("node", "fp"), "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    linked = linked.join(least, "root").select("fp", "least")
    named = classes.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("first"))
    named = named.select("fp", F.col("first.id").alias("component_id"), F.col("first.hash").alias("keeper_hash"))
    return prints.join(materialise(named, "simhash-named"), "fp").select(id_col, "fp", "component_id", "text_hash", "keeper_hash")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_first(docs: DataFrame, marked: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component: the one whose id names it.  ``marked`` is the result
    of ``near_duplicates`` for ``docs``.  Rows are told by id and hash of the text, so rows that
    repeat an id, or have none, are judged each by its own component; of linked rows with the
    same smallest id one stays, and a document without an id stays only where all ids of its
    component are null."""
    stays = F.col(id_col).eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("keeper_hash"))
    marked = materialise(marked.select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash"), stays.alias("stays")), "simhash-marked")
    gone = materialise(marked.filter("not stays").select("_id", "_hash").distinct(), "simhash-gone")
    rows = docs.withColumn("_text_hash", F.xxhash64(F.col(text_col)))
    kept = rows.join(checked_broadcast(gone), rows[id_col].eqNullSafe(gone["_id"]) & (rows["_text_hash"] == gone["_hash"]), "left_anti")
    if marked.filter("stays").groupBy("_id", "_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        kept = kept.dropDuplicates([id_col, "_text_hash"])
    return kept.drop("_text_hash")
