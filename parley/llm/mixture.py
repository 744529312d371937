"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target of words: a weighted share of all words, at most
``max_copies`` times what it has, the excess shared again by weight.  A document of a
source with ratio ``r = target / size`` expects ``e = r * weight`` copies: its whole
part is allocated for certain, and the fraction ``p`` is the inclusion probability of one
more copy.  Documents are ranked by random odds over inclusion odds,
``(u / (1 - u)) / (p / (1 - p))``, and the first ones are taken until the words left of the
target are used up (the document at the border only if that comes closer).

The rank is cut into fine buckets; bucket totals (aggregated before any shuffle) tell
in which bucket the border of a source lies, so only the documents of that one bucket are
ever sorted together, however large the source is.  Random numbers are hashes of the id,
so reruns agree.

Defined cases: null text has size 0; a null source is a source of its own, the last in
order; documents without words take 0 words; an empty table gives no rows; repeated rows
are separate documents that share their random number, which the text decides where the id
is null; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import WORD, materialise

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
RANK_BUCKETS = 1 << 14
BROADCAST_SOURCES = 100_000   # sources (short rows) that one broadcast may hold
SALTS = 64
SEED = "mix-1"


def random_unit(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), doc_id.cast("string")).cast("binary"), 256)
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def ordered_blocks(rows: DataFrame, order: list[Column], label: str) -> DataFrame:
    """``rows`` as a written table cut by ranges of ``order``: ``block`` grows with the order."""
    return materialise(rows.repartitionByRange(*order).withColumn("block", F.spark_partition_id()), label)


def sums_before(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` (with ``block``) and, per name, the sum of a column over all rows before.

    Running sums inside every block, and behind them the totals of the blocks before, of
    which there are as many as the range partitions that wrote ``rows``."""
    totals = rows.groupBy("block").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("block", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy("block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (rows.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in sums.items()])
            .join(F.broadcast(offsets), "block")
            .select(*rows.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums]))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS,
                   max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size) -> the same with ``target``.

    Targets are ``least(max_copies * source_size, weight * level)`` for the one level
    that shares out all words; sources that reach their limit are a prefix in order of
    limit over weight, so running sums in that order find it.  Both orders (of names, and
    of limits) are cut into ranges, so any number of sources is spread over the tasks."""
    named = [F.col("source").asc_nulls_last()]
    per = sums_before(ordered_blocks(sizes.select("source", "source_size"), named, "mix-names"), named,
                      {"place": F.lit(1).cast("bigint")})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % F.lit(len(weights))).cast("int") + 1)
    per = per.drop("block").withColumn("weight", weight.cast("bigint"))
    per = per.withColumn("most", F.col("source_size") * F.lit(max_copies))
    per = per.withColumn("ratio", F.col("most") / F.col("weight"))
    limits = [F.col("ratio"), F.col("place")]
    per = ordered_blocks(per, limits, "mix-limits")
    whole = per.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    level = (F.lit(whole["words"]) - F.col("full_words")) / (F.lit(whole["weight"]) - F.col("full_weight"))
    cut = (sums_before(per, limits, {"full_words": F.col("most"), "full_weight": F.col("weight")})
           .withColumn("level", level).filter("level <= ratio")
           .agg(F.min(F.struct("ratio", "place", "level")).alias("cut")).first()["cut"])
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.lit(float("inf") if cut is None else cut["level"]))
    return per.select("source", "source_size", target.alias("target"))


def shared_again(narrow: DataFrame, per: DataFrame, max_copies: int) -> DataFrame:
    """``per`` (source, source_size, target, weighted) with ``share``, the copies that a
    weight of one expects, such that the expected words of a source, every document limited to
    ``max_copies``, are its target.

    Raising the share of what is left can only bring more documents to the limit, so a pass
    (one aggregation per source) is repeated until none of them reaches it anew."""
    share = F.when(F.col("weighted") > 0, F.col("target") / F.col("weighted")).otherwise(F.lit(0.0))
    per = materialise(per.withColumn("share", share).withColumn("full", F.lit(0).cast("bigint")), "mix-share")
    while True:
        limited = F.col("w") * F.col("share") >= F.lit(float(max_copies))
        now = attach_per_source(narrow, per.select("source", "share")).groupBy("source").agg(
            F.sum(limited.cast("bigint")).alias("_full"), F.sum(F.when(limited, F.col("size")).otherwise(0)).alias("_words"),
            F.sum(F.when(limited, F.lit(0.0)).otherwise(F.col("w") * F.col("size"))).alias("_left"))
        now = now.withColumnRenamed("source", "_source")
        again = F.when(F.col("_left") > 0, F.greatest(
            F.col("share"), (F.col("target") - F.col("_words") * max_copies) / F.col("_left"))).otherwise(F.col("share"))
        grown = materialise(per.join(now, F.col("source").eqNullSafe(F.col("_source"))).select(
            "source", "source_size", "target", "weighted", again.alias("share"), F.col("_full").alias("full"),
            (F.col("_full") > F.col("full")).alias("more")), "mix-share")
        per = grown.drop("more")
        if not grown.filter("more").limit(1).count():
            return per.drop("full")


def attach_per_source(rows: DataFrame, per: DataFrame) -> DataFrame:
    """``rows`` with the columns of the one-row-per-source table.

    A checked small table is broadcast; a larger one is joined on (source, salt), its rows
    repeated per salt, so a hot source is spread over ``SALTS`` tasks."""
    per = per.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if per.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(per), same).drop("_source")
    salted = per.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_s", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, same & (F.col("_s") == F.col("_salt"))).drop("_source", "_salt", "_s")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES,
        weight: Column | None = None, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken) of every document.

    ``weight`` (not negative, null as 0, over the columns of ``docs``) makes expected copies inside
    a source proportional to it, up to ``max_copies``, and what documents at that limit leave
    is shared again among the others of the source; without it they are equal."""
    size = F.size(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD), F.lit(0))).cast("bigint")
    # without an id, the text decides
    drawn = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)))
    narrow = materialise(docs.select(
        "doc_id", "source", size.alias("size"), random_unit(drawn, seed).alias("u"),
        (F.lit(1.0) if weight is None else F.coalesce(weight.cast("double"), F.lit(0.0))).alias("w")), "mix-sizes")
    totals = narrow.groupBy("source").agg(F.sum("size").alias("source_size"),
                                          F.sum(F.col("w") * F.col("size")).alias("weighted"))
    totals = materialise(totals, "mix-totals")
    per = materialise(source_targets(totals.select("source", "source_size"), weights, max_copies)
                      .join(totals.select(F.col("source").alias("_s"), "weighted"), F.col("source").eqNullSafe(F.col("_s")))
                      .drop("_s"), "mix-targets")
    expected = F.when(F.col("weighted") > 0, F.col("target") * F.col("w") / F.col("weighted")).otherwise(F.lit(0.0))
    if weight is not None:
        per, expected = shared_again(narrow, per, max_copies), F.col("w") * F.col("share")

    rows = attach_per_source(narrow, per)
    rows = rows.withColumn("expected", F.least(expected, F.lit(float(max_copies))))
    rows = rows.withColumn("whole", F.floor("expected")).withColumn("p", F.col("expected") - F.col("whole"))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    rows = rows.withColumn("rank", F.when(F.col("p") > 0, odds))
    # rank / (1 + rank) lies in (0, 1) and keeps the order
    rows = rows.withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * F.lit(RANK_BUCKETS)).cast("int"))

    # bucket null: nothing but whole copies
    used = rows.groupBy("source", "bucket").agg(
        F.sum("size").alias("words"), F.sum(F.col("size") * F.col("whole")).alias("certain"), F.first("target").alias("target"))
    used = materialise(used, "mix-buckets")
    left = used.groupBy("source").agg((F.first("target") - F.sum("certain")).alias("budget"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cuts = (used.filter(F.col("bucket").isNotNull())
            .withColumn("ends", F.sum("words").over(upto))
            .join(left.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
            .groupBy("source").agg(
                F.first("budget").alias("budget"),
                F.min(F.when(F.col("ends") >= F.col("budget"),
                             F.struct("bucket", (F.col("ends") - F.col("words")).alias("before")))).alias("cut")))
    cuts = materialise(cuts.select("source", "budget", F.coalesce("cut.bucket", F.lit(RANK_BUCKETS)).alias("cut"),
                                   F.coalesce("cut.before", F.lit(0)).alias("before")), "mix-cuts")

    cuts = cuts.unionByName(  # sources without a fraction have no cut of their own
        left.join(cuts.select(F.col("source").alias("_s")), F.col("source").eqNullSafe(F.col("_s")), "left_anti")
        .select("source", "budget", F.lit(-1).alias("cut"), F.lit(0).cast("bigint").alias("before")))
    rows = attach_per_source(rows, cuts)
    columns = ["doc_id", "size", "source", "source_size", "target", "whole"]
    at_border = rows.filter(F.col("bucket") == F.col("cut"))
    running = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    at_border = at_border.withColumn("ends", F.col("before") + F.sum("size").over(running))
    begins = F.col("ends") - F.col("size")
    extra = (F.col("ends") <= F.col("budget")) | (
        (begins < F.col("budget")) & (F.col("ends") - F.col("budget") < F.col("budget") - begins))
    clear = rows.filter(F.col("bucket").isNull() | (F.col("bucket") != F.col("cut")))
    taken = clear.select(*columns, F.coalesce(F.col("bucket") < F.col("cut"), F.lit(False)).alias("extra")).unionByName(
        at_border.select(*columns, extra.alias("extra")))
    copies = F.col("whole") + F.col("extra").cast("bigint")
    return taken.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"),
                        (F.col("size") * copies).alias("taken"))


# the same mix, without buckets
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST(CAST('0x' || substr(sha256('mix-1:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5)
           / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, [5, 2, 1][place % 3 + 1] AS weight FROM p),
r AS (SELECT *, 3 * source_size AS most, 3 * source_size / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER b, 0))
                / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM r WINDOW b AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT level AS cut FROM l WHERE level <= ratio ORDER BY ratio, place LIMIT 1),
t AS (SELECT source, source_size, least(CAST(most AS DOUBLE), weight * (SELECT cut FROM c)) AS target FROM l),
e AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0) ELSE 0.0 END AS expected
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, CAST(floor(expected) AS BIGINT) AS whole, expected - floor(expected) AS p FROM e),
g AS (SELECT *, target - sum(size * whole) OVER (PARTITION BY source) AS budget,
             sum(size) OVER (PARTITION BY source ORDER BY u, doc_id, size ROWS UNBOUNDED PRECEDING) AS ends
      FROM f),
h AS (SELECT *, whole + CASE WHEN p > 0 AND (ends <= budget OR (ends - size < budget AND ends - budget < budget - (ends - size)))
                         THEN 1 ELSE 0 END AS copies FROM g)
SELECT doc_id, size, source, source_size, target, CAST(copies AS BIGINT) AS copies, CAST(size * copies AS BIGINT) AS taken FROM h
"""
