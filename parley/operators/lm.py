"""Language-model corpora.

The training stream is the corpus lines in ``(source, line_no)`` order, each
carrying its newline, never one array: every line keeps its ids and its global
character ``offset`` (``order.global_offsets``).  Fixed-length sequences are cut
by re-blocking the stream into blocks of ``block`` characters and joining each
sequence to the (at most two) blocks it touches.

The held-out scorer is a character n-gram model with add-alpha smoothing counted
by Spark (map-side partial aggregation), standing in for the reference's neural
net; its result columns are those of the reference evaluation.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import text as tx
from parley.operators.order import global_offsets_total, lead_within
from parley.session import ensure_checkpoint_dir

# --- fixed values -----------------------------------------------------------
SMALL_CORPUS_CHARS = 50_000     # warn below this many characters
MIN_SEQ_LEN = 16
EVAL_MIN_SEQ_LEN = 8
MAX_FRACTION = 0.5
MAX_CODEPOINT = 0x110000
SLICE_CHARS = 1 << 20           # characters that are worked on at once
PAIR_EMPTY = "USER: \nYOU: \n"
# ---------------------------------------------------------------------------


# L1 / S7
def stream_lines(raw_lines: DataFrame, collapse: bool = False, emoji: bool = False, redact: bool = False,
                 redact_types=None) -> DataFrame:
    """``(source, line_no, text)``: every raw line normalised (B4), optionally
    redacted, with its newline appended."""
    t = tx.normalize_text("text", collapse, emoji)
    if redact:
        t = tx.redact(t, redact_types)
    return raw_lines.select("source", "line_no", F.concat(t, F.lit("\n")).alias("text"))


# S7 (lines form) + L2 / W4
def pairs_corpus(raw_lines: DataFrame, redact: bool = False, redact_types=None) -> DataFrame:
    """``(source, line_no, block)``: ``USER: a\\nYOU: b\\n\\n`` for consecutive
    stripped non-blank lines of a source; a source with one line gives one
    ``USER: \\nYOU: \\n`` block."""
    t = tx.strip_ws(tx.normalize_newlines("text"))
    lines = raw_lines.withColumn("text", t).filter(F.col("text") != "")
    if redact:
        lines = lines.withColumn("text", tx.redact("text", redact_types))
    nxt = lead_within(lines.select("source", "line_no", "text"), ["source"], "text", "_next")
    pairs = nxt.filter(F.col("_next").isNotNull()).select(
        "source", "line_no", F.concat(F.lit("USER: "), "text", F.lit("\nYOU: "), "_next", F.lit("\n\n")).alias("block"))
    singles = (lines.groupBy("source").agg(F.count(F.lit(1)).alias("_n"), F.min("line_no").alias("line_no"))
                    .filter(F.col("_n") < 2).select("source", "line_no", F.lit(PAIR_EMPTY).alias("block")))
    return pairs.unionByName(singles)


# A7 / L3
def build_vocab(lines: DataFrame, text_col: str = "text") -> DataFrame:
    """``vocab(char, id)``: distinct code points sorted by code point; empty -> newline.

    At most 0x110000 rows exist, so the sorted list is assigned ids on the driver."""
    chars = (lines.select(F.explode(F.array_distinct(F.split(F.col(text_col), ""))).alias("char"))
                  .filter(F.col("char") != "").distinct())
    got = sorted(r["char"] for r in chars.collect())
    if len(got) > MAX_CODEPOINT:
        raise ValueError("vocabulary larger than the code space")
    if not got:
        got = ["\n"]
    spark = lines.sparkSession
    return spark.createDataFrame([(c, i) for i, c in enumerate(got)], "char string, id int")


def vocab_list(vocab: DataFrame) -> list[str]:
    """The vocabulary in id order (at most 0x110000 entries, one per code point)."""
    rows = vocab.orderBy("id").collect()
    return [r["char"] for r in rows]


@lru_cache(maxsize=8)
def _lookup(chars: tuple[str, ...]) -> np.ndarray:
    table = np.full(MAX_CODEPOINT, -1, dtype=np.int32)
    for i, c in enumerate(chars):
        table[ord(c)] = i
    return table


def _codepoints(texts: pa.Array):
    """(flat code points, per-row offsets) of a string array, vectorised."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    py = texts.to_pylist()
    lens = np.fromiter((len(s) if s is not None else 0 for s in py), dtype=np.int64, count=len(py))
    joined = "".join(s for s in py if s is not None)
    cps = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    offs = np.zeros(len(py) + 1, dtype=np.int64)
    np.cumsum(lens, out=offs[1:])
    return cps, offs, texts.is_null()


def row_slices(batch, sizes, most: int):
    """Slices of a batch (or array) whose rows have ``most`` in all, or are single."""
    ends, start = np.cumsum(np.asarray(sizes, dtype=np.int64)), 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def char_slices(batch, texts):
    """Slices of ``batch`` with at most ``SLICE_CHARS`` characters of ``texts``, or of one row: what is
    made of them by the character stays small, however long the batch."""
    return row_slices(batch, pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False), SLICE_CHARS)


def _sliced(texts: pa.Array, one, kind: pa.DataType) -> pa.Array:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pa.concat_arrays([pa.array([], kind), *[one(t) for t in char_slices(texts, texts)]])


def _encode_batch(texts: pa.Array, chars: tuple[str, ...], oov_zero: bool) -> pa.Array:
    cps, offs, nulls = _codepoints(texts)
    ids = _lookup(chars)[cps]
    if oov_zero:
        keep = np.ones(len(ids), dtype=bool)
        ids = np.where(ids < 0, 0, ids)
    else:
        keep = ids >= 0
    kept_before = np.zeros(len(keep) + 1, dtype=np.int64)
    np.cumsum(keep, out=kept_before[1:])
    new_offs = kept_before[offs].astype(np.int32)
    has_null = bool(pc.any(nulls).as_py())
    return pa.ListArray.from_arrays(pa.array(new_offs), pa.array(ids[keep].astype(np.int32)),
                                    mask=nulls if has_null else None)


def _oov_batch(texts: pa.Array, chars: tuple[str, ...]) -> pa.Array:
    cps, offs, nulls = _codepoints(texts)
    miss = (_lookup(chars)[cps] < 0).astype(np.int64)
    csum = np.zeros(len(miss) + 1, dtype=np.int64)
    np.cumsum(miss, out=csum[1:])
    return pa.array(csum[offs[1:]] - csum[offs[:-1]], type=pa.int64(), mask=np.asarray(nulls))


def _decode_batch(ids: pa.Array, chars: tuple[str, ...]) -> pa.Array:
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    offs = np.asarray(ids.offsets, dtype=np.int64)
    vals = np.asarray(ids.values.to_numpy(zero_copy_only=False), dtype=np.int64)[offs[0]:offs[-1]]
    offs = offs - offs[0]
    cp = np.fromiter((ord(c) for c in chars), dtype=np.uint32, count=len(chars))
    s = cp[vals].tobytes().decode("utf-32-le")
    out = [s[offs[i]:offs[i + 1]] for i in range(len(offs) - 1)]
    return pa.array(out, type=pa.string(), mask=np.asarray(ids.is_null()))


# B26 / B27
def encode_chars(col, vocab_chars: list[str], oov: str = "drop") -> F.Column:
    """chars -> ids; ``oov='drop'`` removes unknown chars, ``'zero'`` maps them to 0."""
    chars = tuple(vocab_chars)
    zero = oov == "zero"
    fn = F.arrow_udf(lambda t: _sliced(t, lambda part: _encode_batch(part, chars, zero), pa.list_(pa.int32())), T.ArrayType(T.IntegerType()))
    return fn(tx._col(col))


def oov_count(col, vocab_chars: list[str]) -> F.Column:
    """Number of characters of ``col`` missing from the vocabulary."""
    chars = tuple(vocab_chars)
    return F.arrow_udf(lambda t: _sliced(t, lambda part: _oov_batch(part, chars), pa.int64()), T.LongType())(tx._col(col))


# B28
def decode_ids(col, vocab_chars: list[str]) -> F.Column:
    chars = tuple(vocab_chars)
    return F.arrow_udf(lambda i: _decode_batch(i, chars), T.StringType())(tx._col(col))


# B29
def prompt_seed(col, vocab_chars: list[str]) -> F.Column:
    """Encodable part of a prompt; an empty result becomes the newline id (or 0)."""
    nl = vocab_chars.index("\n") if "\n" in vocab_chars else 0
    ids = encode_chars(col, vocab_chars)
    return F.when(F.size(ids) == 0, F.array(F.lit(nl))).otherwise(ids)


# B30
def perplexity(loss) -> F.Column:
    loss = tx._col(loss)
    finite = ~F.isnan(loss) & (F.abs(loss) != F.lit(float("inf")))
    return F.when(~finite, F.lit(float("nan"))).when(loss > 709.0, F.lit(float("inf"))).otherwise(F.exp(loss))


# L5
def fit_seq_len(n_chars: int, seq_len: int) -> tuple[int, bool]:
    """Cap ``seq_len`` at ``max(16, n_chars // 8)``; second value: small-corpus warning."""
    max_reasonable = max(MIN_SEQ_LEN, int(n_chars) // 8)
    s = int(seq_len)
    if s > max_reasonable:
        s = max(MIN_SEQ_LEN, min(s, max_reasonable))
    return s, int(n_chars) < SMALL_CORPUS_CHARS


def clamp_fraction(f: float) -> float:
    return min(max(float(f), 0.0), MAX_FRACTION)


# L4 (offsets)
def with_offsets(stream: DataFrame, length_col: str | None = None) -> tuple[DataFrame, int]:
    """``(stream + length + offset, total)``: ``length`` in characters (or ids when
    ``length_col`` is given), ``offset`` the global exclusive running sum in stream
    order, ``total`` the stream length."""
    ln = F.char_length("text") if length_col is None else F.size(length_col)
    return global_offsets_total(stream.withColumn("length", ln.cast("long")), ["source", "line_no"], "length")


# L4
def encode_corpus(stream: DataFrame, vocab_chars: list[str]) -> tuple[DataFrame, int]:
    """``(source, line_no, ids, length, offset)`` of every line, and the number of ids.

    A stream of fewer than two ids is too short for a sequence: the ids of two newlines stand
    for it, as one line (none if the vocabulary has no newline)."""
    ids = stream.select("source", "line_no", encode_chars("text", vocab_chars).alias("ids"))
    out, total = with_offsets(ids, length_col="ids")
    if total >= 2:
        return out, total
    newline = [vocab_chars.index("\n")] * 2 if "\n" in vocab_chars else []
    schema = out.schema
    row = {"ids": newline, "length": len(newline), "offset": 0, "line_no": 1}
    return stream.sparkSession.createDataFrame([tuple(row.get(f.name) for f in schema.fields)] if newline else [], schema_nullable(schema)), len(newline)


def schema_nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])


# L6 / W8
def tail_split(with_off: DataFrame, total: int, val_fraction: float = 0.05, seq_len: int = 256) -> tuple[DataFrame, int]:
    """Per line: ``train_chars`` and ``val_chars`` of a tail split at character
    ``total - val``; ``val`` is 0 when below ``seq_len + 2``.  Returns (frame, val)."""
    val = int(total * clamp_fraction(val_fraction))
    if val < int(seq_len) + 2:
        val = 0
    boundary = total - val
    tr = F.least(F.col("length"), F.greatest(F.lit(0), F.lit(boundary) - F.col("offset")))
    return (with_off.withColumn("train_chars", tr.cast("long"))
                    .withColumn("val_chars", (F.col("length") - tr).cast("long")), val)


# L7
def stream_blocks(id_lines: DataFrame, block: int) -> DataFrame:
    """Re-block an id stream ``(offset, ids)`` into ``(blk, ids)`` of ``block`` ids."""
    segs = id_lines.select(
        "offset", "ids",
        F.explode(F.sequence(F.floor(F.col("offset") / block),
                             F.floor((F.col("offset") + F.greatest(F.size("ids"), F.lit(1)) - 1) / block))).alias("blk"))
    lo = F.greatest(F.col("offset"), F.col("blk") * block)
    hi = F.least(F.col("offset") + F.size("ids"), (F.col("blk") + 1) * block)
    segs = segs.filter(hi > lo).select("blk", lo.alias("lo"), F.slice("ids", (lo - F.col("offset") + 1).cast("int"),
                                                                      (hi - lo).cast("int")).alias("part"))
    return (segs.groupBy("blk").agg(F.sort_array(F.collect_list(F.struct("lo", "part"))).alias("_p"))
                .select("blk", F.flatten(F.transform("_p", lambda s: s["part"])).alias("ids")))


def sequences_at(blocks: DataFrame, starts: DataFrame, seq_len: int, block: int) -> DataFrame:
    """``(seq_id, x, y)`` for ``starts(seq_id, start)``: x = ids[start:start+T],
    y = ids[start+1:start+T+1]."""
    T_ = int(seq_len)
    s = starts.withColumn("blk", F.explode(F.sequence(F.floor(F.col("start") / block),
                                                       F.floor((F.col("start") + T_) / block))))
    j = s.join(blocks, "blk", "inner")
    lo = F.greatest(F.col("start"), F.col("blk") * block)
    hi = F.least(F.col("start") + T_ + 1, F.col("blk") * block + F.size("ids"))
    j = j.filter(hi > lo).select("seq_id", lo.alias("lo"),
                                 F.slice("ids", (lo - F.col("blk") * block + 1).cast("int"), (hi - lo).cast("int")).alias("part"))
    w = (j.groupBy("seq_id").agg(F.sort_array(F.collect_list(F.struct("lo", "part"))).alias("_p"))
          .select("seq_id", F.flatten(F.transform("_p", lambda p: p["part"])).alias("w")))
    return w.filter(F.size("w") == T_ + 1).select("seq_id", F.slice("w", 1, T_).alias("x"),
                                                  F.slice("w", 2, T_).alias("y"))


def pack_sequences(id_lines: DataFrame, total: int, seq_len: int) -> DataFrame:
    """Deterministic packed form: starts 0, T, 2T, ... while a full x/y pair fits.

    Every line is cut into its pieces of the sequences (T + 1 ids each, the last one shared
    with the next), so the ids are shuffled once, to their sequences."""
    T_ = int(seq_len)
    n = max(0, (int(total) - 1) // T_)
    size = F.size("ids")
    seqs = F.sequence(F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("offset") - 1) / T_)),
                      F.least(F.lit(n - 1).cast("bigint"), F.floor((F.col("offset") + size - 1) / T_)))

    def piece(seq):
        lo = F.greatest(F.col("offset"), seq * T_)
        hi = F.least(F.col("offset") + size, seq * T_ + T_ + 1)
        return F.struct(seq.alias("seq_id"), lo.alias("lo"), F.slice("ids", (lo - F.col("offset") + 1).cast("int"), (hi - lo).cast("int")).alias("part"))

    pieces = id_lines.filter((size > 0) & (F.col("offset") < n * T_ + 1) & F.lit(n > 0)).select(F.explode(F.transform(seqs, piece)).alias("p"))
    w = (pieces.groupBy("p.seq_id").agg(F.sort_array(F.collect_list(F.struct("p.lo", "p.part"))).alias("_p"))
               .select("seq_id", F.flatten(F.transform("_p", lambda x: x["part"])).alias("w")))
    return w.filter(F.size("w") == T_ + 1).select("seq_id", F.slice("w", 1, T_).alias("x"), F.slice("w", 2, T_).alias("y"))


def sample_sequences(id_lines: DataFrame, total: int, n: int, seq_len: int, seed: int = 1337) -> DataFrame:
    """``n`` seeded random windows with starts in ``[0, total - seq_len - 1)``:
    start i = (first 60 bits of ``md5("seed:i")``) mod the range."""
    T_ = int(seq_len)
    max_start = int(total) - (T_ + 1)
    if max_start <= 0:
        raise ValueError(f"{total} characters do not fill one sequence of {T_ + 1}")
    block = max(4096, 2 * (T_ + 1))
    spark = id_lines.sparkSession
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(int(seed))), F.col("id").cast("string"))), 1, 15),
                  16, 10).cast("long")
    starts = spark.range(int(n)).select(F.col("id").alias("seq_id"), F.pmod(draw, F.lit(max_start)).alias("start"))
    return sequences_at(stream_blocks(id_lines, block), starts, T_, block)


# L8
def ngram_rows(lines: DataFrame, order: int) -> DataFrame:
    """One row per character: ``(pos, ctx, c)`` where pos is the global stream
    position; the context is the ``order - 1`` previous characters of the line,
    left-padded with newlines."""
    k = int(order) - 1
    padded = F.concat(F.lit("\n" * k), F.col("text")) if k > 0 else F.col("text")
    ex = lines.select("offset", padded.alias("_pad"), F.posexplode(F.split("text", "")).alias("i", "c")) \
        .filter(F.col("c") != "")
    ctx = F.substring("_pad", F.col("i") + 1, k) if k > 0 else F.lit("")
    return ex.select((F.col("offset") + F.col("i")).alias("pos"), ctx.alias("ctx"), "c")


_CP_BITS = 21
_CP_MASK = (1 << _CP_BITS) - 1
_NL = 10


def _ngram_counts_kernel(order: int, boundary: int, head: bool, vocab_cps=None, first_cp: int = 0):
    """mapInArrow kernel over ``(text, offset)`` lines: per batch, the counts of
    n-gram codes ``c | prev1 << 21 | prev2 << 42`` (contexts restart at each line,
    padded with newlines) for positions before (head) or from (tail) ``boundary``.
    The tail form maps out-of-vocabulary code points to ``first_cp`` and reports
    how many it mapped."""
    vocab_arr = None if vocab_cps is None else np.asarray(vocab_cps, dtype=np.uint32)

    def run(batches):
        for rb in (part for whole in batches for part in char_slices(whole, whole.column("text"))):
            cps, offs, _nulls = _codepoints(rb.column("text"))
            n = len(cps)
            if n == 0:
                continue
            line_of = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
            local = np.arange(n, dtype=np.int64) - offs[:-1][line_of]
            pos = np.asarray(rb.column("offset").to_numpy(zero_copy_only=False), dtype=np.int64)[line_of] + local
            sel = pos < boundary if head else pos >= boundary
            oov = 0
            if vocab_arr is not None:
                miss = ~np.isin(cps, vocab_arr)
                oov = int((miss & sel).sum())
                cps = np.where(miss, np.uint32(first_cp), cps)
            code = cps.astype(np.int64)
            for j in range(1, order):
                prev = np.full(n, _NL, dtype=np.int64)
                prev[j:] = cps[:-j]
                prev[local < j] = _NL
                code |= prev << (_CP_BITS * j)
            u, cnt = np.unique(code[sel], return_counts=True)
            oovs = np.zeros(len(u), dtype=np.int64)
            if len(u):
                oovs[0] = oov
            elif oov:
                u, cnt, oovs = np.array([-1]), np.array([0]), np.array([oov])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(cnt.astype(np.int64)),
                                              pa.array(oovs)], names=["code", "n", "oov"])
    return run


_CODES_SCHEMA = T.StructType([T.StructField("code", T.LongType()), T.StructField("n", T.LongType()),
                              T.StructField("oov", T.LongType())])


def _heldout_codes(lines: DataFrame, boundary: int, held: int, order: int, alpha: float) -> DataFrame:
    """Vectorised form of ``heldout_eval`` for order <= 3."""
    head = lines.filter(F.col("offset") < boundary).select("text", "offset")
    tail = lines.filter(F.col("offset") + F.char_length("text") > boundary).select("text", "offset")
    counts = (head.mapInArrow(_ngram_counts_kernel(order, boundary, True), _CODES_SCHEMA)
                  .groupBy("code").agg(F.sum("n").alias("n_cc"))
                  .checkpoint(eager=True))
    # the vocabulary is bounded by the code space
    vocab = sorted(r["c"] for r in counts.select(F.col("code").bitwiseAND(F.lit(_CP_MASK)).alias("c"))
                   .distinct().collect())
    v_size = len(vocab)
    test = (tail.mapInArrow(_ngram_counts_kernel(order, boundary, False, vocab, vocab[0]), _CODES_SCHEMA)
                .groupBy("code").agg(F.sum("n").alias("m"), F.sum("oov").alias("oov")))
    ctx = counts.groupBy(F.call_function("shiftright", F.col("code"), F.lit(_CP_BITS)).alias("ctx")) \
                .agg(F.sum("n_cc").alias("n_c"))
    scored = (test.withColumn("ctx", F.call_function("shiftright", F.col("code"), F.lit(_CP_BITS)))
                  .join(counts, "code", "left").join(ctx, "ctx", "left")
                  .select("m", "oov", ((F.coalesce("n_cc", F.lit(0)) + float(alpha)) /
                                       (F.coalesce("n_c", F.lit(0)) + float(alpha) * v_size)).alias("p")))
    agg = scored.agg((F.sum(F.col("m") * -F.log("p")) / F.sum("m")).alias("loss"),
                     F.sum("oov").cast("long").alias("oov_chars"))
    return agg.select(F.lit(held).cast("long").alias("heldout_chars"), "oov_chars", "loss",
                      perplexity("loss").alias("perplexity"))


def heldout_eval(lines_with_offsets: DataFrame, total: int, order: int = 3, alpha: float = 0.1,
                 heldout_fraction: float = 0.05, seq_len: int = 256) -> DataFrame:
    """``(heldout_chars, oov_chars, loss, perplexity)`` of an add-alpha character
    n-gram model counted on the stream head and scored on its tail.

    Characters absent from the head are out of vocabulary: they can only occur in
    the tail, where they are counted and scored as the first vocabulary character
    (id 0).  Only the counting pass reads the head; everything else reads the
    lines that reach into the tail.  For order <= 3 the n-grams are 63-bit codes
    pre-counted per Arrow batch before the shuffle."""
    ensure_checkpoint_dir(lines_with_offsets.sparkSession)
    use_seq = max(EVAL_MIN_SEQ_LEN, int(seq_len))
    held = int(total * clamp_fraction(heldout_fraction))
    if held < use_seq + 2:
        held = 0
    if held <= 0:
        raise ValueError("the held-out tail is shorter than one sequence")
    boundary = total - held
    if 1 <= int(order) <= 3:
        return _heldout_codes(lines_with_offsets, boundary, held, int(order), alpha)
    spark = lines_with_offsets.sparkSession
    head_lines = lines_with_offsets.filter(F.col("offset") < boundary)
    tail_lines = lines_with_offsets.filter(F.col("offset") + F.char_length("text") > boundary)
    counts = (ngram_rows(head_lines, order).filter(F.col("pos") < boundary)
              .groupBy("ctx", "c").agg(F.count(F.lit(1)).alias("n_cc"))
              .checkpoint(eager=True))
    # the vocabulary is bounded by the code space
    vocab = sorted(r["c"] for r in counts.select("c").distinct().collect())
    v_size, first_char = len(vocab), vocab[0]
    tail = ngram_rows(tail_lines, order).filter(F.col("pos") >= boundary)
    vocab_df = F.broadcast(spark.createDataFrame([(c,) for c in vocab], "c string"))
    oov_rows = tail.join(vocab_df, "c", "left_anti").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()
    oov_chars = [r["c"] for r in oov_rows]
    oov = sum(int(r["n"]) for r in oov_rows)
    if oov_chars:
        tail_lines = tail_lines.withColumn("text", F.translate("text", "".join(oov_chars),
                                                                  first_char * len(oov_chars)))
    test = ngram_rows(tail_lines, order).filter(F.col("pos") >= boundary)
    ctx_counts = counts.groupBy("ctx").agg(F.sum("n_cc").alias("n_c"))
    scored = (test.join(counts, ["ctx", "c"], "left").join(ctx_counts, "ctx", "left")
                  .select(((F.coalesce("n_cc", F.lit(0)) + float(alpha)) /
                           (F.coalesce("n_c", F.lit(0)) + float(alpha) * v_size)).alias("p")))
    loss = scored.agg(F.avg(-F.log(F.col("p"))).alias("loss"))
    return loss.select(F.lit(held).cast("long").alias("heldout_chars"), F.lit(int(oov)).cast("long").alias("oov_chars"),
                       "loss", perplexity("loss").alias("perplexity"))


# A12
def corpus_meta(total: int, train: int, val: int, vocab_size: int, seq_len: int) -> dict:
    return {"chars_total": int(total), "chars_train": int(train), "chars_val": int(val),
            "vocab_size": int(vocab_size), "seq_len": int(seq_len)}

