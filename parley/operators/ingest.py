"""Ingest (V7, A8, P2): corpus -> chunks -> dedupe -> embed -> store.

The plan is one DataFrame of flagged chunks; a dry run aggregates it, a real run
embeds only the rows to add (the Python embedder stays last in the plan, after
every filter) and appends them to the store in one write.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions import hashing as H
from parley.functions import text as tx
from parley.operators import chunk as ch
from parley.operators import dedupe as dd
from parley.operators.embed import Embedder, hashed_embedder
from parley.operators.retrieve import first_messages
from parley.session import ensure_checkpoint_dir
from parley.sources.corpus import message_lines
from parley.sources.store import METADATA_TYPE, ParquetStore, SCHEMA_VERSION


@dataclass
class IngestOptions:
    chunking: str = "message"
    window_size: int = 4
    max_messages: int | None = None
    exact_dedupe: bool = True
    fuzzy_dedupe: bool = False
    fuzzy_max_hamming: int = 6
    redact: bool = False
    redact_types: list[str] | None = None
    collapse_whitespace: bool = False
    strip_emoji: bool = False


def messages_of(corpus: DataFrame, o: IngestOptions) -> DataFrame:
    """S6 + F1 + F4: normalised non-blank messages, first ``max_messages`` of them."""
    return first_messages(message_lines(corpus, o.collapse_whitespace, o.strip_emoji), o.max_messages)


def flag_chunks(corpus: DataFrame, store: ParquetStore | None = None, opts: IngestOptions | None = None,
                stored: DataFrame | None = None) -> DataFrame:
    """Flagged chunk table: ``source, start_line, end_line, raw, text, id,
    content_hash, exact_keep, fuzzy_keep, keep, existing, add``.

    ``stored`` (``id, content_hash``) stands in for a store's rows when given."""
    o = opts or IngestOptions()
    mode = ch.chunk_mode(o.chunking)
    msgs = messages_of(corpus, o)
    chunks = ch.with_ids(ch.build_chunks(msgs, mode, o.window_size), mode).withColumnRenamed("text", "raw")
    text = tx.redact(F.col("raw"), o.redact_types) if o.redact else F.col("raw")
    chunks = chunks.withColumn("text", text).withColumn("content_hash", H.content_hash("text"))
    # written once; every check runs on a narrow table of keys and hashes, whose flags are
    # joined back in the end, so the texts are moved once
    ensure_checkpoint_dir(chunks.sparkSession)
    chunks = chunks.checkpoint(eager=True)
    order = ["source", "start_line"]
    narrow = chunks.select(*order, "id", "content_hash")
    if o.fuzzy_dedupe:
        blank = tx.strip_ws(F.col("text")) == ""
        narrow = chunks.select(*order, "id", "content_hash", F.when(~blank, H.simhash64("text")).alias("_simhash")).checkpoint(eager=True)
    if stored is None and store is not None:
        r = store.read()
        stored = r.select("id", F.col("metadata.content_hash").alias("content_hash"))
    if o.exact_dedupe:
        seen = stored.select("content_hash") if stored is not None else None
        narrow = dd.exact_keep(narrow, "content_hash", order, seen=seen)
    else:
        narrow = narrow.withColumn("exact_keep", F.lit(True))
    if o.fuzzy_dedupe:
        narrow = dd.fuzzy_keep_hashes(narrow, F.when(F.col("exact_keep"), F.col("_simhash")), order, o.fuzzy_max_hamming)
    else:
        narrow = narrow.withColumn("fuzzy_keep", F.lit(True))
    narrow = narrow.withColumn("keep", F.col("exact_keep") & F.col("fuzzy_keep"))
    if stored is not None:
        ids = stored.select("id").distinct().withColumn("existing", F.lit(True))
        narrow = narrow.join(ids, "id", "left").withColumn("existing", F.coalesce("existing", F.lit(False)))
    else:
        narrow = narrow.withColumn("existing", F.lit(False))
    flags = narrow.select(*order, "exact_keep", "fuzzy_keep", "keep", "existing", (F.col("keep") & ~F.col("existing")).alias("add"))
    return chunks.join(flags, order)


def ingest_summary(flagged: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """One row of dry-run counts (skip_other may be negative, as in the reference)."""
    agg = flagged.agg(
        F.count(F.lit(1)).alias("chunks"),
        F.sum(F.col("keep").cast("long")).alias("kept"),
        F.sum(F.col("existing").cast("long")).alias("skip_existing"),
        F.sum(F.col("add").cast("long")).alias("would_add"),
    )
    agg = agg.select(
        "chunks", F.coalesce("kept", F.lit(0)).alias("kept"),
        (F.col("chunks") - F.coalesce("kept", F.lit(0))).alias("skip_dedupe"),
        F.coalesce("skip_existing", F.lit(0)).alias("skip_existing"),
        F.coalesce("would_add", F.lit(0)).alias("would_add"))
    agg = agg.withColumn("skip_other", F.col("kept") - F.col("would_add") - F.col("skip_existing"))
    agg = agg.withColumn("dedupe_rate", F.when(F.col("chunks") > 0,
                                               F.round(1.0 - F.col("would_add") / F.col("chunks"), 6)))
    if messages is not None:
        agg = agg.withColumn("messages", F.lit(messages.count()).cast("long"))
    return agg


def ingest_examples(flagged: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` chunks that would be added, in corpus order."""
    return (flagged.filter("add").orderBy("source", "start_line").limit(n)
                   .select("start_line", "end_line", "text"))


def store_rows(flagged: DataFrame, opts: IngestOptions | None = None, embedder: Embedder | None = None) -> DataFrame:
    """Rows to add, cleaned (B12), embedded (V1) and with their metadata struct."""
    o = opts or IngestOptions()
    mode = ch.chunk_mode(o.chunking)
    win = int(o.window_size) if mode == "window" else 1
    embedder = embedder or hashed_embedder()
    c = flagged.filter("add").withColumn("_c", tx.clean_for_embedding("text"))
    meta = F.struct(
        F.col("end_line").cast("long").alias("line"), F.col("start_line").cast("long").alias("start_line"),
        F.col("end_line").cast("long").alias("end_line"), F.lit(mode).alias("chunking"),
        F.lit(win).alias("window_size"), F.col("source").cast("string").alias("source"),
        F.col("content_hash").alias("content_hash"),
        *[F.col("_c")[f].alias(f) for f in ("speaker", "timestamp", "start_speaker", "end_speaker",
                                              "start_timestamp", "end_timestamp")],
    ).cast(METADATA_TYPE)
    rows = c.select("id", F.col("_c.text").alias("text"), meta.alias("metadata"))
    return rows.withColumn("embedding", embedder(F.col("text"))).select("id", "text", "embedding", "metadata")


def ingest(corpus: DataFrame, store: ParquetStore, opts: IngestOptions | None = None,
           embedder: Embedder | None = None, dry_run: bool = False) -> DataFrame:
    """V7: returns the one-row summary; a real run also writes the new rows."""
    o = opts or IngestOptions()
    msgs = messages_of(corpus, o)
    if msgs.isEmpty():
        raise ValueError("the corpus has no non-blank message")
    if dry_run:
        store.check_version(SCHEMA_VERSION)
    else:
        store.ensure_version(SCHEMA_VERSION)
    flagged = flag_chunks(corpus, store, o).checkpoint(eager=True)
    if flagged.isEmpty():
        raise ValueError("chunking gave nothing: every source is shorter than the window")
    summary = ingest_summary(flagged, msgs)
    if dry_run:
        return summary.withColumn("added", F.lit(0).cast("long"))
    added = store.add(store_rows(flagged, o, embedder))
    return summary.withColumn("added", F.lit(int(added)).cast("long"))


# S14 with V7
def rebuild_from_corpus(corpus: DataFrame, store: ParquetStore, opts: IngestOptions | None = None,
                        embedder: Embedder | None = None, confirm: bool = False) -> DataFrame:
    """Drop this collection's rows (needs ``confirm=True``), then ingest ``corpus``."""
    store.rebuild(None, confirm=confirm)
    return ingest(corpus, store, opts, embedder)
