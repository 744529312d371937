"""Document fingerprints by winnowing.

Every run of ``k`` code points is hashed; of each window of ``w`` neighbouring hashes the
smallest is chosen, the rightmost among equals, with its position.  Two texts that share a
run of ``k + w - 1`` code points share a whole window, hence a chosen hash, and the two
positions give the place of the match.

A text is encoded with four bytes a code point, so that a gram is a constant-time slice, and
is cut into slices of ``SLICE`` window starts, so that the arrays of one slice are all that is
held besides the text and the chosen grams.  A gram is one long: 31 bits of its XXH64, times
2^32, less its place in the encoded text (4 * position + 1); the smallest such long is the
rightmost smallest hash.  The minimum over a window is taken by doubling: windows of 1, 2, 4,
... ``w`` grams.

``compare_with_next`` fingerprints each document, the text whose last quarter is replaced by the
start of the next document, and the next document.  Rows are cut into runs of ids with the
first row of each run copied to the run before it, so whole texts are shuffled once and no
window of rows is longer than a run.

Defined cases: null is the empty text, whose fingerprint is empty; a text of fewer than ``k``
code points is one gram, one of fewer than ``k + w - 1`` one window; two empty fingerprints are
alike to 1, an empty and another to 0.  Documents are ordered by id, nulls first, and rows of
one id by the XXH64 of their text; rows that agree in both are each other's next.  A single
document is its own next.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import checked_broadcast, let, materialise

GRAM = 16          # code points of a gram
WINDOW = 32        # grams of a window, a power of two
SLICE = 1024       # window starts that are worked on at a time
RUN_ROWS = 256     # rows of a run of ids
MOST_RUNS = 100_000   # bound on the runs, whose borders are sent to every task
_HASH = 0x7FFFFFFF00000000
_PLACES = 0xFFFFFFFF


def code_points(text: Column) -> Column:
    """A text as binary, four bytes a code point."""
    return F.encode(text, "UTF-32")


def _length(points: Column) -> Column:
    return (F.length(points) / 4).cast("int")


def _grams(points: Column, k: int) -> Column:
    """The grams of a slice as packed longs; a slice of fewer than ``k`` points is one gram."""
    places = F.sequence(F.lit(1), F.greatest(F.length(points) - (4 * k - 1), F.lit(1)), F.lit(4))
    return F.transform(places, lambda i: F.xxhash64(F.substring(points, i, 4 * k)).bitwiseAND(F.lit(_HASH)) - i)


def _window_minima(grams: Column, w: int, step: int = 1) -> Column:
    """At every place the minimum of the ``w`` longs from there on, of fewer at the end."""
    if step == w:
        return grams
    # zip_with pads with nulls, which least() passes over
    doubled = F.zip_with(grams, F.slice(grams, F.lit(step + 1), F.greatest(F.size(grams) - step, F.lit(0))), lambda x, y: F.least(x, y))
    return let(doubled, lambda d: _window_minima(d, w, 2 * step))


def winnow(points: Column, k: int = GRAM, w: int = WINDOW, first: Column | int = 0, last: Column | None = None) -> Column:
    """The chosen grams (packed longs, by position) of the windows that start at ``first`` to
    ``last``, by default at all; a window is cut off at the end of the text only where the
    text has fewer than ``w`` grams."""
    if w & (w - 1):
        raise ValueError("the window must be a power of two")
    first = F.lit(first) if isinstance(first, int) else first
    # encoded once, not for every slice
    return let(points, lambda p: _winnow(p, k, w, first, last))


def _winnow(points: Column, k: int, w: int, first: Column, last: Column | None) -> Column:
    end = F.greatest(_length(points) - (k + w - 1), F.lit(0))   # the last start of a window
    last = end if last is None else F.least(last, end)

    def chosen(start):
        here = F.least(F.lit(SLICE), last - start + 1)           # window starts of this slice
        piece = F.substring(points, start * 4 + 1, (here + (k + w - 2)) * 4)
        smallest = let(piece, lambda p: F.array_distinct(F.slice(
            let(_grams(p, k), lambda g: _window_minima(g, w)), F.lit(1), here)))
        return F.transform(smallest, lambda g: g - start * 4)    # places in the text

    starts = F.when((_length(points) > 0) & (first <= last), F.sequence(first, last, F.lit(SLICE)))
    return F.array_distinct(F.flatten(F.transform(F.coalesce(starts, F.array().cast("array<int>")), chosen)))


def gram_hash(gram: Column) -> Column:
    return F.shiftright(gram + F.lit(_PLACES), 32)


def position(gram: Column) -> Column:
    """Code point at which a chosen gram starts, from 0."""
    return F.shiftright(F.shiftleft(gram_hash(gram), 32) - gram, 2).cast("int")


def fingerprint_text(grams: Column) -> Column:
    """The chosen grams in decimal, space-joined, by position."""
    return F.array_join(grams.cast("array<string>"), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of the chosen hashes of two fingerprints."""
    def hashes(grams):
        return F.array_distinct(F.transform(grams, gram_hash))
    return let(F.struct(hashes(a).alias("x"), hashes(b).alias("y")), lambda s: let(
        F.size(F.array_intersect(s["x"], s["y"])), lambda both: let(
            F.size(s["x"]) + F.size(s["y"]) - both, lambda either: F.when(either == 0, F.lit(1.0)).otherwise(both / either))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """(id_col, grams array<struct<hash bigint, position int>>): the fingerprint of every row."""
    points = code_points(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(id_col, F.transform(winnow(points, k, w), lambda g: F.struct(
        gram_hash(g).alias("hash"), position(g).alias("position"))).alias("grams"))


# --- the next document ------------------------------------------------------------

def _run_of(key: Column, tie: Column, borders: Column, null_runs: int) -> Column:
    """Number of the run of a row; monotone in (key, tie).

    Borders are quantiles of the ids, so a run begins at each of them; an id that fills
    several quantiles is cut by its text hash instead, and so are null ids, below zero."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(MOST_RUNS.bit_length()))])

    def below(holds):   # how many borders from the left hold, by bisection
        return F.aggregate(steps, F.lit(0), lambda at, s: F.when(
            (at + s <= F.size(borders)) & holds(F.get(borders, at + s - 1)), at + s).otherwise(at))

    def nth(parts):     # part of the hash range, from 0
        return F.least(((tie / F.lit(2.0 ** 64) + 0.5) * parts).cast("int"), parts - 1)

    lo, hi = below(lambda b: b < key), below(lambda b: b <= key)
    return F.when(key.isNull(), nth(F.lit(null_runs)) - null_runs) \
            .otherwise(F.when(hi > lo, lo + 1 + nth(hi - lo)).otherwise(lo))


def _run_count(rows: int) -> int:
    return max(1, min(MOST_RUNS, -(-rows // RUN_ROWS)))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_each=None) -> DataFrame:
    """(id_col, text, ..., next): ``next`` is a struct of the next document's text and of what
    ``with_each`` (a function from the text column to further named columns) gives for it.
    Ids are integers."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_tie", F.xxhash64("_text"))
    ids = docs.select(F.col(id_col).cast("bigint").alias("_id"))
    seen = ids.agg(F.count("_id").alias("ids"), F.count_if(F.col("_id").isNull()).alias("nulls")).first()
    runs = _run_count(seen["ids"])
    shares = np.arange(1, runs) / runs
    borders = ids.agg(F.percentile_approx("_id", F.lit(shares), F.lit(10 * runs)).alias("b")).first()["b"] if runs > 1 else []
    rows = rows.withColumn("_run", _run_of(F.col("_id").cast("bigint"), F.col("_tie"), F.lit(np.array(borders, dtype="int64")),
                                           _run_count(seen["nulls"])))

    # the first row of every run (at most 2 x MOST_RUNS short rows), to be copied to the run before it
    order = F.struct(F.col("_id").isNotNull().alias("has"), F.col("_id").alias("id"), F.col("_tie").alias("tie"))
    firsts = materialise(rows.groupBy("_run").agg(F.min(order).alias("_first")), "first-of-run")
    whole = Window.orderBy("_run")
    firsts = firsts.select("_first", F.col("_run").alias("_own"), F.lag("_run").over(whole).alias("_before"),
                           F.max("_run").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_end"))
    firsts = firsts.select(F.col("_own"), F.col("_first")["tie"].alias("_first_tie"), F.col("_first")["id"].alias("_first_id"),
                           F.coalesce("_before", "_end").alias("_to"))
    rows = rows.join(checked_broadcast(firsts), (rows["_run"] == firsts["_own"]) & (rows["_tie"] == firsts["_first_tie"])
                     & rows["_id"].eqNullSafe(firsts["_first_id"]), "left")
    places = F.array(F.struct(F.col("_run").alias("run"), F.lit(False).alias("copy")),
                     F.when(F.col("_to").isNotNull(), F.struct(F.col("_to").alias("run"), F.lit(True).alias("copy"))))
    rows = rows.select("_id", "_tie", "_text", F.explode(F.array_compact(places)).alias("_at")) \
               .select("_id", "_tie", "_text", "_at.run", "_at.copy")
    # sorted before the grams are made, as the window below needs it: only texts are moved
    rows = rows.repartition("run").sortWithinPartitions("run", "copy", F.col("_id").asc_nulls_first(), "_tie")
    extra = with_each(F.col("_text")) if with_each else {}
    rows = rows.select("*", *[c.alias(n) for n, c in extra.items()])
    following = F.lead(F.struct(F.col("_text").alias("text"), *extra)).over(
        Window.partitionBy("run").orderBy("copy", F.col("_id").asc_nulls_first(), "_tie"))
    rows = rows.select("*", following.alias("next")).filter(~F.col("copy"))
    return rows.select(F.col("_id").alias(id_col), F.col("_text").alias("text"), *extra, "next")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Windows that end before the edited quarter are the same in both texts and winnowed once."""
    size = F.col("n_chars")
    kept = size - F.floor(size / 4).cast("int")           # code points that stay

    def parts(text):
        n = F.length(text)
        same = (n - F.floor(n / 4).cast("int")) - (k + w - 1)   # the last window start of unedited windows
        raw = code_points(text)
        return {"head": winnow(raw, k, w, 0, same), "tail": winnow(raw, k, w, F.greatest(same + 1, F.lit(0)))}

    rows = with_next(docs, id_col, text_col, parts)
    whole = F.array_distinct(F.concat("head", "tail"))
    rows = rows.select(
        id_col, F.length("text").alias("n_chars"), "text", "head", whole.alias("own"), F.col("next.text").alias("_next_text"),
        F.array_distinct(F.concat("next.head", "next.tail")).alias("next_own"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), kept), F.substring("_next_text", F.lit(1), size - kept)))
    rows = rows.withColumn("edited_own", F.array_distinct(F.concat("head", winnow(
        code_points(F.col("edited")), k, w, F.greatest(kept - (k + w - 1) + 1, F.lit(0))))))
    return rows.select(
        id_col, size.cast("bigint").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint_text(F.col("own")).alias("fingerprint"), fingerprint_text(F.col("edited_own")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited_own")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"))
