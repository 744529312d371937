"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.session import ensure_checkpoint_dir

# ASCII white space, as a Java class: a word is a run of anything else
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends in files
    that every executor sees, so a lost executor costs no recomputation upstream."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_KEYS = 1_000_000   # short key rows that one broadcast may hold


def checked_broadcast(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """``keys``, marked for broadcast if it has at most ``most`` rows; else it is left to a
    shuffle join.  ``keys`` must be cheap to read (a written table)."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def space_words(text: Column) -> Column:
    """Words of a text (runs outside ASCII white space); null gives no words."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_BLOCK = 512


def running_totals(values: Column) -> Column:
    """Inclusive running totals of an array of longs.

    Two levels (totals inside blocks of 512, then block offsets), so the repeated
    copying of a growing array stays small for very long arrays."""
    none = F.array().cast("array<bigint>")

    def scan(arr):
        return F.aggregate(arr, none, lambda acc, v: F.concat(
            acc, F.array(F.when(F.size(acc) > 0, F.element_at(acc, -1)).otherwise(F.lit(0).cast("bigint")) + v)))

    def blocked(vals):
        starts = F.sequence(F.lit(1), F.size(vals), F.lit(_BLOCK))
        blocks = F.transform(starts, lambda s: scan(F.slice(vals, s, _BLOCK)))
        return let(blocks, lambda bs: let(
            scan(F.transform(bs, lambda b: F.element_at(b, -1))),
            lambda ends: F.flatten(F.transform(bs, lambda b, i: F.transform(
                b, lambda v: v + F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0).cast("bigint")))))))

    return let(values, lambda vals: F.when(F.size(vals) <= _BLOCK, scan(vals)).otherwise(blocked(vals)))


SPANS = "array<struct<start:bigint,end:bigint,found:string>>"


def found_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of a Java pattern as
    ``array<struct<start, end, found>>`` (code points, end exclusive).

    ``split`` gives the gaps around the matches that ``regexp_extract_all`` gives,
    and running totals of gap and match lengths are the positions.  The pattern
    must not match the empty string."""
    def placed(found):
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found,
                           lambda g, m: (F.length(g) + F.length(m)).cast("bigint"))
        return F.zip_with(running_totals(steps), found, lambda e, m: F.struct(
            (e - F.length(m)).alias("start"), e.alias("end"), m.alias("found")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
               lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(F.array().cast(SPANS)))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
