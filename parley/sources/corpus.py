"""Canonical corpus tables.

``corpus(source, line_no BIGINT, text STRING)``: one message per row, ``line_no``
1-based and counting blank lines too (gaps stay), ``(source, line_no)`` unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.operators.joins import broadcast_checked
from parley.session import ensure_checkpoint_dir


def lines_of(df: DataFrame, source_col: str, text_col: str) -> DataFrame:
    """Split each text into raw lines (newlines unified first); 1-based line_no,
    blank lines kept."""
    return (df.select(F.col(source_col).alias("source"),
                      F.posexplode(F.split(tx.normalize_newlines(F.col(text_col)), "\n", -1)))
              .select("source", (F.col("pos") + 1).cast("bigint").alias("line_no"),
                      F.col("col").alias("text")))


def plain_lines(raw_lines: DataFrame) -> DataFrame:
    """Stripped, non-blank lines."""
    return (raw_lines.withColumn("text", tx.strip_ws("text")).filter(F.col("text") != ""))


def message_lines(raw_lines: DataFrame, collapse: bool = False, emoji: bool = False) -> DataFrame:
    """Numbered, normalised (B5), non-blank messages."""
    # what would be blank is told from the raw text, so the cleaning runs once per row
    raw = tx.strip_emoji("text") if emoji else F.col("text")
    return (raw_lines.filter(tx.strip_ws(raw) != "")
                     .withColumn("text", tx.normalize_message_line("text", collapse, emoji)))


def browse_lines(raw_lines: DataFrame) -> DataFrame:
    """Drop only empty lines; whitespace-only lines stay, nothing is stripped."""
    return raw_lines.filter(F.col("text") != "")


def corpus_from_table(df: DataFrame, source_col: str, order_col: str, text_col: str,
                      split_lines: bool = False, line_offset: int = 0) -> DataFrame:
    """A corpus from a table that already carries an order column.

    ``split_lines=False``: one row = one message, ``line_no = order + line_offset``.
    ``split_lines=True``: the text is split into raw lines (blank ones kept)."""
    if split_lines:
        return lines_of(df, source_col, text_col)
    return df.select(F.col(source_col).alias("source"),
                     (F.col(order_col) + F.lit(line_offset)).cast("bigint").alias("line_no"),
                     F.col(text_col).alias("text"))


def read_text_files(spark: SparkSession, paths, line_sep: str | None = None) -> DataFrame:
    """Raw lines of text files: ``(source=path, line_no, text)``, 1-based line
    numbers counting blank lines, bad bytes replaced.

    Files are read split by split (a huge export is many tasks; ``\n``, ``\r\n``
    and ``\r`` all end a line, or ``line_sep`` alone).  A row's number is its position inside
    its split (low bits of ``monotonically_increasing_id``) plus the line count of the
    earlier splits of the same file, from the one-row-per-split table, which is counted
    once and sent to the rows where it is small."""
    if isinstance(paths, str):
        paths = [paths]
    reader = spark.read if line_sep is None else spark.read.option("lineSep", line_sep)
    raw = reader.text(list(paths)).select(
        F.input_file_name().alias("source"), F.input_file_block_start().alias("_blk"),
        F.monotonically_increasing_id().alias("_mid"),
        F.call_function("make_valid_utf8", F.col("value")).alias("text"))
    raw = raw.withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    splits = raw.groupBy("source", "_blk").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("source").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    ensure_checkpoint_dir(spark)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n").checkpoint(eager=True)
    return (raw.join(broadcast_checked(splits), ["source", "_blk"], "inner")
               .select("source", (F.col("_before") + F.col("_pos") - F.col("_first") + 1).cast("bigint").alias("line_no"),
                       "text"))


def read_corpus(spark: SparkSession, paths, collapse: bool = False, emoji: bool = False) -> DataFrame:
    """Numbered, normalised, non-blank messages of one-message-per-line files."""
    return message_lines(read_text_files(spark, paths), collapse, emoji)


# the canonical shapes of the test tables -------------------------------------

def conversation_messages(conversations: DataFrame) -> DataFrame:
    """``conversations`` as a corpus: source = conv_id, line_no = turn + 1, text
    cleaned by B6, blanks dropped."""
    return (corpus_from_table(conversations, "conv_id", "turn", "text", line_offset=1)
            .filter(tx.strip_ws(F.col("text")) != "")
            .withColumn("text", tx.clean_line("text")))


def document_raw_lines(documents: DataFrame) -> DataFrame:
    return lines_of(documents, "doc_id", "text")
