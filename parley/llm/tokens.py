"""Token counts of byte-level BPE by rank-synchronous array merging.

Pre-tokens of a bounded slice of texts are held as one ragged numpy array of
symbols.  In every round each still active pre-token merges all occurrences of its
own lowest-rank pair at once; a pre-token without a mergeable pair leaves the array
and its surviving symbols are its token count.  Each distinct pre-token of a slice
is merged once.

Exactness: applying one pair everywhere at once equals the usual one-at-a-time order
because a pair that a merge creates always ranks after that merge; ``BpeTables``
verifies this for the given vocabulary when it is loaded.

Defined cases: null and empty texts have 0 bytes and 0 tokens; every row is counted
by itself, so repeated rows and ids keep their own counts; other columns of the input
are ignored; an empty table gives no rows.  A text of any length is worked off in
pieces of at most ``SLICE_TOKENS`` pre-tokens and about ``SLICE_CHARS`` characters, and a
single pre-token longer than ``LONG_RUN`` (a run of letters without end) in pieces of itself.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values of the public byte-level BPE format -------------------------
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# ------------------------------------------------------------------------------

SLICE_TOKENS = 200_000     # pre-tokens merged in one array
SLICE_CHARS = 2_000_000    # characters of whole texts looked at together
LONG_RUN = 1 << 18         # length from which one pre-token is merged piece by piece
STEPS_BACK = 64            # earlier borders that a piece may begin at instead
MEMO_CHUNKS = 400_000
TOKEN_LIMIT = 512
_NONE = np.int64(1) << 60


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte: itself
    where printable in Latin-1, else the next letter from U+0100 on."""
    shown = {b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class BpeTables:
    """Merge table of a byte-level BPE tokenizer file, as plain arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pre = spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") \
                or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain byte-level BPE without normalizer or prefix space is supported")
        vocab = model["vocab"]
        letters = _byte_letters()
        self.byte_symbol = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        self.base = np.int64(max(vocab.values()) + 1)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        first = np.full(int(self.base), -1, dtype=np.int64)   # rank that makes a symbol, -1: a byte
        first[made[::-1]] = np.arange(len(made))[::-1]
        rank = np.arange(len(made))
        if (np.maximum(first[left], first[right]) >= rank).any():
            raise ValueError("a merge ranks before a part of it; ranks cannot be applied at once")
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], rank[order].astype(np.int64), made
        self.length = np.zeros(int(self.base), dtype=np.int64)   # bytes of a symbol
        self.length[list(vocab.values())] = [len(v) for v in vocab]
        self.special = sorted((t["content"] for t in spec.get("added_tokens") or []), key=len, reverse=True)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)


def surviving_symbols(tables: BpeTables, tokens: list[bytes], last: list[np.ndarray] | None = None) -> np.ndarray:
    """Number of BPE symbols of each (non-empty) pre-token; their symbols are appended to
    ``last``, if given, as they leave the arrays."""
    counts = np.array([len(t) for t in tokens], dtype=np.int64)
    sym = tables.byte_symbol[np.frombuffer(b"".join(tokens), dtype=np.uint8)]
    seq = np.repeat(np.arange(len(tokens)), counts)
    # rank of the pair that starts at each symbol; none at the end of a sequence
    rank = np.full(len(sym), _NONE)
    inside = np.flatnonzero(seq[:-1] == seq[1:])
    rank[inside] = tables.rank_of(sym[inside], sym[inside + 1])
    while len(sym):
        starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
        lens = np.diff(np.r_[starts, len(seq)])
        lowest = np.minimum.reduceat(rank, starts)
        counts[seq[starts]] = lens
        going = lowest < _NONE
        if not going.all():           # finished sequences leave the arrays
            keep = np.repeat(going, lens)
            if last is not None:
                last.append(sym[~keep])
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            lens, lowest = lens[going], lowest[going]
            if not len(sym):
                break
        hit = rank == np.repeat(lowest, lens)
        # of overlapping hits (a run of one repeated symbol) every second one from the left merges
        at = np.flatnonzero(hit)
        run_start = np.r_[True, (np.diff(at) != 1) | (seq[at[1:]] != seq[at[:-1]])]
        place = np.arange(len(at)) - np.maximum.accumulate(np.where(run_start, np.arange(len(at)), 0))
        at = at[place % 2 == 0]
        sym[at] = tables.made[rank[at]]
        keep = np.ones(len(sym), dtype=bool)
        keep[at + 1] = False
        now = at - np.arange(len(at))  # place of the merged symbols after the removal
        sym, seq, rank = sym[keep], seq[keep], rank[keep]
        for side in (now, now[now > 0] - 1):
            pair = side[side + 1 < len(sym)]
            pair = pair[seq[pair] == seq[pair + 1]]
            rank[side] = _NONE
            rank[pair] = tables.rank_of(sym[pair], sym[pair + 1])
        # a left neighbour of another sequence keeps no pair: set to none above
    return counts


def symbols_of(tables: BpeTables, run: bytes) -> np.ndarray:
    last: list[np.ndarray] = []
    surviving_symbols(tables, [run], last)
    return last[0]


def long_run_symbols(tables: BpeTables, run: bytes, piece: int) -> int:
    """Number of BPE symbols of one long pre-token, with arrays of ``piece`` bytes.

    Two runs whose border no merge crosses keep their own symbols when they are joined, and
    whether one crosses it shows in the two symbols at the border alone: by ranks, all that
    happens inside a symbol is the same with and without its neighbours.  So the symbols of
    the first half of a piece are kept, and the next piece starts behind them if the symbols
    at that border, merged together, stay two; else at the border before.  A run in
    which no such border is found is merged as a whole."""
    cuts, done = [0], 0      # borders between kept symbols, and how many end at the last one
    while True:
        start = cuts[-1]
        sym = symbols_of(tables, run[start:start + piece])
        ends = start + np.cumsum(tables.length[sym])
        if start:
            pair = symbols_of(tables, run[cuts[-2]:ends[0]])
            if len(pair) != 2 or tables.length[pair[0]] != start - cuts[-2]:
                cuts.pop()
                done -= 1
                if len(cuts) < 2:
                    return len(symbols_of(tables, run))
                continue
        if start + piece >= len(run):
            return done + len(sym)
        kept = max(1, int(np.searchsorted(ends, start + piece // 2, side="right")))
        cuts = [start, *ends[:kept].tolist()][-STEPS_BACK:]
        done += kept


def bounded_parts(tokens):
    """Lists of successive pre-tokens, bounded in number and length."""
    part: list[str] = []
    size = 0
    for t in tokens:
        part.append(t)
        size += len(t)
        if len(part) >= SLICE_TOKENS or size >= SLICE_CHARS:
            yield part
            part, size = [], 0
    yield part


class TokenCounter:
    """Counts the tokens of texts, slice by slice.

    A pre-token never spans the border before a space (unless white space stands on
    both sides of it), so a text is cut there, and the counts of cut chunks are
    remembered, up to ``MEMO_CHUNKS`` of them; new chunks of a slice are pre-tokenised
    and merged together."""

    def __init__(self, tables: BpeTables):
        self.tables = tables
        self.pre = regex.compile(PRE_TOKEN)
        self.special = regex.compile("|".join(map(regex.escape, tables.special))) if tables.special else None
        self.uncut = re.compile(r"\s \s|\x00")
        self.memo: dict[str, int] = {}

    def merged(self, chunks: list[str]) -> np.ndarray:
        """Token counts of non-empty chunks: pre-tokens of all of them, merged in bounded arrays."""
        out = np.zeros(len(chunks), dtype=np.int64)
        index: dict[str, int] = {}
        used: list[int] = []
        owners: list[tuple[int, int]] = []
        size = 0

        def flush() -> None:
            if used:
                each = surviving_symbols(self.tables, [t.encode("utf-8") for t in index])
                owner = np.repeat([c for c, _ in owners], [n for _, n in owners])
                np.add.at(out, owner, each[np.array(used, dtype=np.int64)])
            index.clear(), used.clear(), owners.clear()

        for c, chunk in enumerate(chunks):
            if len(chunk) <= min(SLICE_TOKENS, LONG_RUN):
                parts = [self.pre.findall(chunk)]
            else:
                parts = bounded_parts(m[0] for m in self.pre.finditer(chunk))
            for tokens in parts:
                if len(chunk) > LONG_RUN:
                    out[c] += sum(long_run_symbols(self.tables, t.encode("utf-8"), LONG_RUN) for t in tokens if len(t) > LONG_RUN)
                    tokens = [t for t in tokens if len(t) <= LONG_RUN]
                used.extend([index.setdefault(t, len(index)) for t in tokens])
                owners.append((c, len(tokens)))
                size += sum(map(len, tokens))
                if len(used) >= SLICE_TOKENS or size >= SLICE_CHARS:
                    flush()
                    size = 0
        flush()
        return out

    def count(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), dtype=np.int64)
        start = 0
        while start < len(texts):    # a slice of whole texts at a time
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size < SLICE_CHARS):
                size += len(texts[stop] or "")
                stop += 1
            self.count_slice(texts[start:stop], out[start:stop])
            start = stop
        return out

    def count_slice(self, texts: list[str | None], out: np.ndarray) -> None:
        plain: list[tuple[int, list[str]]] = []
        for row, text in enumerate(texts):
            if not text:
                continue
            pieces = self.special.split(text) if self.special else [text]
            out[row] += len(pieces) - 1
            for piece in pieces:
                if not piece:
                    continue
                if self.uncut.search(piece):
                    out[row] += self.merged([piece])[0]
                    continue
                head, *rest = piece.split(" ")
                # the memo knows a first chunk, which no space precedes, under a leading NUL
                plain.append((row, ["\0" + head, *rest] if head else rest))
        memo = self.memo
        if len(memo) > MEMO_CHUNKS:
            memo.clear()
        new = list({c for _, chunks in plain for c in chunks} - memo.keys())
        if new:
            whole = [c[1:] if c[:1] == "\0" else " " + c for c in new]
            memo.update(zip(new, self.merged(whole).tolist(), strict=True))
        for row, chunks in plain:
            out[row] += sum(map(memo.__getitem__, chunks))


def token_count(text, spark, vocab_path: str):
    """Column with the token count of ``text`` under the byte-level BPE at ``vocab_path``
    (a file that the driver reads; its tables, about 2 MB, are broadcast)."""
    tables = spark.sparkContext.broadcast(BpeTables(vocab_path))
    cache: dict[str, TokenCounter] = {}

    @F.arrow_udf(T.LongType())
    def count(texts: pa.Array) -> pa.Array:
        counter = cache.setdefault("c", TokenCounter(tables.value)) if not cache else cache["c"]
        parts = [counter.count(texts.slice(i, 1024).to_pylist()) for i in range(0, len(texts), 1024)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64), type=pa.int64())

    return count(text)


def count_tokens(docs: DataFrame, vocab_path: str, limit: int = TOKEN_LIMIT, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (docs.select(F.col(id_col), F.octet_length(text).cast("bigint").alias("n_bytes"),
                        token_count(text, docs.sparkSession, vocab_path).alias("n_tokens"))
                .withColumn("over_limit", F.col("n_tokens") > F.lit(limit)))
