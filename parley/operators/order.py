"""Order-aware building blocks that never put a whole source into one task.

A corpus is ordered by ``(source, line_no)``.  A single source may hold a third
of all rows, so nothing here uses a window partitioned by ``source`` alone:

* ``running_sum``    running sum per key: a window inside fixed blocks of
                     ``line_no`` (bounded partitions) plus a prefix sum over the
                     (much smaller) block-total table; ``dense_seq`` is the
                     running count, ``running_last`` the last value so far.
* ``next_rows``      each row with the next rows of its key: one window inside
                     blocks of ``line_no``, and the first rows after every block from
                     a table of one row per block.
* ``first_rows``     the first n rows of a table as a plain filter, cut at a place that
                     is found from counts per block.
* ``global_offsets`` exclusive running sum of a length over the whole table in
                     ``(source, line_no)`` order: a window inside line blocks, then
                     the narrow block-total table range-partitioned with one total
                     per partition to the driver (like ``zipWithIndex``) and an
                     Arrow running sum inside each partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.session import ensure_checkpoint_dir

BLOCK = 1 << 20      # line_no values per ranking block (<= rows per window partition)
TEXT_BLOCK = 1 << 16 # the same where rows carry texts


def running_sum(df: DataFrame, keys: list[str], value: str, out: str, order: str = "line_no",
                block: int = BLOCK, inclusive: bool = True) -> DataFrame:
    """Add ``out`` = running sum of ``value`` inside each ``keys`` group in
    ``order`` order (inclusive of the row unless ``inclusive=False``).

    Two levels: a window inside blocks of ``block`` consecutive ``order`` values
    (at most ``block`` rows each), plus the sum of all earlier blocks of the same
    key from the block-total table (``rows / block`` rows)."""
    d = df.withColumn("_blk", F.floor(F.col(order) / F.lit(block)))
    frame = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_inc", F.coalesce(F.sum(value).over(frame), F.lit(0)))
    d = d.withColumn("_in", F.col("_inc") if inclusive else F.col("_inc") - F.coalesce(F.col(value), F.lit(0)))
    # block totals read off the windowed rows (the running sum at each block's last row)
    totals = d.groupBy(*keys, "_blk").agg(F.max_by("_inc", order).alias("_t"))
    w_blk = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.withColumn("_off", F.coalesce(F.sum("_t").over(w_blk), F.lit(0))).drop("_t")
    return (d.join(offs, on=[*keys, "_blk"], how="inner")
             .withColumn(out, F.col("_off") + F.col("_in"))
             .drop("_blk", "_in", "_inc", "_off"))


def dense_seq(df: DataFrame, keys: list[str], order: str = "line_no", out: str = "seq",
              block: int = BLOCK) -> DataFrame:
    """Add ``out`` = dense 0-based position of the row inside its ``keys`` group,
    ordered by the unique integer column ``order``."""
    return running_sum(df.withColumn("_one", F.lit(1)), keys, "_one", out, order, block,
                       inclusive=False).drop("_one")


def running_last(df: DataFrame, keys: list[str], value: str, out: str, order: str = "line_no",
                 block: int = BLOCK, inclusive: bool = True) -> DataFrame:
    """Add ``out`` = the last non-null ``value`` of the ``keys`` group up to the row (before
    the row if not ``inclusive``), in two levels as ``running_sum``."""
    d = df.withColumn("_blk", F.floor(F.col(order) / F.lit(block)))
    w = Window.partitionBy(*keys, "_blk").orderBy(order)
    d = d.withColumn("_inc", F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if not inclusive:
        d = d.withColumn("_exc", F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    ends = d.groupBy(*keys, "_blk").agg(F.max_by("_inc", order).alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_off", F.last("_t", True).over(before)).drop("_t")
    return (d.join(carried, on=[*keys, "_blk"], how="inner")
             .withColumn(out, F.coalesce("_inc" if inclusive else "_exc", "_off"))
             .drop("_blk", "_inc", "_exc", "_off"))


def _after_blocks(df: DataFrame, keys: list[str], cols: list[str], n: int, order: str, block: int) -> DataFrame:
    """``(keys, _blk, _after)``: the first ``n`` rows after a block of the same key, as
    structs, for every block that has a later one.

    Only the first ``n`` rows of a block are shuffled, and those of a key's block 0 not at
    all, so keys that fit into one block cost a filter."""
    blk = F.greatest(F.floor(F.col(order) / F.lit(block)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy(*keys, "_blk").orderBy(order))
    heads = (df.select(*keys, blk.alias("_blk"), F.col(order).alias("_o"), F.struct(*cols).alias("_s"), order)
               .filter(F.col("_blk") > 0).withColumn("_n", nth).filter(F.col("_n") <= n)
               .groupBy(*keys, "_blk").agg(F.sort_array(F.collect_list(F.struct("_o", "_s"))).alias("_h"))
               .withColumn("_h", F.transform("_h", lambda x: x["_s"])))
    later = Window.partitionBy(*keys).orderBy("_blk")
    following = F.slice(F.flatten(F.collect_list("_h").over(later.rowsBetween(1, n))), 1, n)
    heads = heads.withColumn("_f", following).withColumn("_nth", F.row_number().over(later))
    # a key's first block after block 0 is what follows block 0
    out = F.array(F.struct(F.col("_blk").alias("b"), F.col("_f").alias("f")),
                  F.when(F.col("_nth") == 1, F.struct(F.lit(0).cast("bigint").alias("b"), F.slice(F.concat("_h", "_f"), 1, n).alias("f"))))
    return (heads.select(*keys, F.explode(F.array_compact(out)).alias("_x"))
                 .select(*keys, F.col("_x.b").alias("_blk"), F.col("_x.f").alias("_after")))


def next_rows(df: DataFrame, keys: list[str], cols: list[str], n: int, order: str = "line_no",
              name: str = "_win", block: int = TEXT_BLOCK) -> DataFrame:
    """For every row, ``name`` = array of structs(cols) of this row and the next
    ``n - 1`` rows of the same key (fewer at the end of the key).

    Rows are shuffled once, on (keys, block), and read their followers inside the block by a
    window; the rows that follow a block come from ``_after_blocks``.  No key is a single task."""
    n = max(1, int(n))
    blk = F.greatest(F.floor(F.col(order) / F.lit(block)), F.lit(0))
    w = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(0, n - 1)
    d = df.withColumn("_blk", blk).withColumn(name, F.collect_list(F.struct(*[F.col(c) for c in cols])).over(w))
    if n > 1:
        after = _after_blocks(df, keys, cols, n - 1, order, block)
        d = d.join(after, [*keys, "_blk"], "left")
        short = (F.size(name) < n) & F.col("_after").isNotNull()
        d = d.withColumn(name, F.when(short, F.slice(F.concat(name, "_after"), 1, n)).otherwise(F.col(name))).drop("_after")
    return d.drop("_blk")


def lead_within(df: DataFrame, keys: list[str], col: str, out: str, order: str = "line_no",
                block: int = TEXT_BLOCK) -> DataFrame:
    """``out`` = value of ``col`` on the next row of the same key (NULL on the last)."""
    d = next_rows(df, keys, [col], 2, order, "_pair", block)
    return d.withColumn(out, F.get("_pair", F.lit(1))[col]).drop("_pair")


def first_rows(df: DataFrame, n: int, key: str = "source", order: str = "line_no", block: int = TEXT_BLOCK) -> DataFrame:
    """The first ``n`` rows in ``(key, order)`` order (nulls first; the pair is unique), in no
    particular order: a filter on the two columns.

    The place of the cut comes from counts per (key, block): range-partitioned, one total per
    partition to the driver, then the one partition, and the one block, that hold the place."""
    n = int(n)
    if n <= 0:
        return df.limit(0)
    ensure_checkpoint_dir(df.sparkSession)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blk = F.floor(F.col(order) / F.lit(block))
    counts = (df.groupBy(F.col(key).alias("k"), blk.alias("b")).agg(F.count(F.lit(1)).alias("n"))
                .repartitionByRange(parts, F.col("k").asc_nulls_first(), "b")
                .withColumn("part", F.spark_partition_id()).checkpoint(eager=True))
    before = 0
    for part, here in sorted(counts.groupBy("part").agg(F.sum("n")).collect()):
        if before + here >= n:
            break
        before += here
    else:
        return df
    upto = F.sum("n").over(Window.orderBy(F.col("k").asc_nulls_first(), "b").rowsBetween(Window.unboundedPreceding, 0))
    cut = counts.filter(F.col("part") == part).withColumn("upto", upto + F.lit(before)).filter(F.col("upto") >= n) \
                .orderBy("upto").first()
    same = F.col(key).eqNullSafe(F.lit(cut["k"]))
    nth = F.row_number().over(Window.orderBy(order))
    last = df.filter(same & (blk == cut["b"])).select(order, nth.alias("_n")) \
             .filter(F.col("_n") == n - (cut["upto"] - cut["n"])).first()[order]
    earlier = F.lit(False) if cut["k"] is None else F.col(key).isNull() | (F.col(key) < F.lit(cut["k"]))
    return df.filter(earlier | (same & (F.col(order) <= F.lit(last))))


def _partition_cumsum(length_col: str, out: str, offsets_bc):
    def run(batches):
        pid = TaskContext.get().partitionId()
        acc = offsets_bc.value.get(pid, 0)
        for rb in batches:
            lens = rb.column(length_col).cast(pa.int64()).fill_null(0)
            cum = pc.cumulative_sum(lens)
            excl = np.asarray(cum) - np.asarray(lens) + acc
            if len(lens):
                acc = int(acc + np.asarray(cum)[-1])
            yield rb.append_column(out, pa.array(excl, type=pa.int64()))
    return run


def global_offsets_total(df: DataFrame, order_cols: list[str], length_col: str, out: str = "offset",
                         block: int = BLOCK, partitions: int | None = None) -> tuple[DataFrame, int]:
    """``(df + out, total)``: ``out`` = exclusive running sum of ``length_col`` over
    the whole table in ``order_cols`` order (the character offset of each line in
    one logical stream); ``total`` = the sum of all lengths.

    The last order column must be an integer.  Rows get an exclusive running sum
    inside blocks of ``block`` consecutive values of it (one window, one shuffle of
    the table); the narrow block-total table is range-partitioned, each partition
    sends one number to the driver (as ``zipWithIndex`` does) and an Arrow running
    sum gives each block its offset."""
    spark = df.sparkSession
    if partitions is None:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    *outer, inner = order_cols
    d = df.withColumn("_blk", F.floor(F.col(inner) / F.lit(block)))
    w = (Window.partitionBy(*outer, "_blk").orderBy(inner)
         .rowsBetween(Window.unboundedPreceding, 0))
    ln = F.coalesce(F.col(length_col).cast("long"), F.lit(0))
    d = d.withColumn("_inc", F.sum(ln).over(w)).withColumn("_in", F.col("_inc") - ln)
    blocks = d.groupBy(*outer, "_blk").agg(F.max_by("_inc", inner).alias("_t"))
    keys = [*outer, "_blk"]
    ensure_checkpoint_dir(spark)
    ranged = blocks.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).checkpoint(eager=True)
    totals = (ranged.groupBy(F.spark_partition_id().alias("pid")).agg(F.sum("_t").alias("n")).collect())
    by_pid = {int(r["pid"]): int(r["n"] or 0) for r in totals}
    offsets, acc = {}, 0
    for pid in range(max(by_pid, default=-1) + 1):
        offsets[pid] = acc
        acc += by_pid.get(pid, 0)
    bc = spark.sparkContext.broadcast(offsets)
    schema = T.StructType(ranged.schema.fields + [T.StructField("_boff", T.LongType(), False)])
    boffs = ranged.mapInArrow(_partition_cumsum("_t", "_boff", bc), schema).drop("_t")
    res = (d.join(boffs, keys, "inner")
            .withColumn(out, F.col("_boff") + F.col("_in"))
            .drop("_blk", "_inc", "_in", "_boff"))
    return res, acc


def global_offsets(df: DataFrame, order_cols: list[str], length_col: str, out: str = "offset",
                   partitions: int | None = None) -> DataFrame:
    """``global_offsets_total`` without the total."""
    return global_offsets_total(df, order_cols, length_col, out, partitions=partitions)[0]
