"""Chunking (W2, W3) and chunk ids.

``chunks(source, start_line, end_line, text, id, content_hash)``.  Window chunks
take ``n`` consecutive messages of one source (step 1, joined by newlines); a
source with fewer than ``n`` messages yields none.  Windows run per block of
lines (``order.next_rows``), never per whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions import hashing as H
from parley.operators.order import next_rows

# --- fixed values -----------------------------------------------------------
MESSAGE_MODES = ("message", "per-message", "per_message", "line")
WINDOW_MODES = ("window", "sliding", "sliding-window", "sliding_window")
DEFAULT_WINDOW = 4
# ---------------------------------------------------------------------------


def chunk_mode(chunking: str | None) -> str:
    """Canonical mode name, or ValueError."""
    m = str(chunking or "message").strip().lower()
    if m in MESSAGE_MODES:
        return "message"
    if m in WINDOW_MODES:
        return "window"
    raise ValueError(f"unknown way to cut chunks {chunking!r}: message or window")


def build_chunks(corpus: DataFrame, chunking: str = "message", window_size: int = DEFAULT_WINDOW) -> DataFrame:
    """(source, start_line, end_line, text)."""
    mode = chunk_mode(chunking)
    if mode == "message":
        return corpus.select("source", F.col("line_no").alias("start_line"),
                             F.col("line_no").alias("end_line"), "text")
    n = max(1, int(window_size))
    win = next_rows(corpus, ["source"], ["line_no", "text"], n)
    return (win.filter(F.size("_win") == n)
               .select("source", F.col("line_no").alias("start_line"),
                       F.element_at("_win", -1)["line_no"].alias("end_line"),
                       F.array_join(F.transform("_win", lambda s: s["text"]), "\n").alias("text")))


def with_ids(chunks: DataFrame, chunking: str = "message") -> DataFrame:
    """B14/B15 on the unredacted chunk text: ``sha1:line`` or ``sha1:start-end``."""
    mode = chunk_mode(chunking)
    if mode == "message":
        cid = H.stable_id("text", "end_line")
    else:
        cid = H.stable_window_id("text", "start_line", "end_line")
    return chunks.withColumn("id", cid)
