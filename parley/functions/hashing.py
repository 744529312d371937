"""Hash columns (B13-B18): content hash, stable ids, SimHash, Hamming, bands.

Built-ins, except the SimHash bit vote, which runs vectorised over whole Arrow
batches (no per-row Python); nothing here needs a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.text import W, _col

# --- fixed values -----------------------------------------------------------
SIMHASH_BITS = 64
BAND_BITS = 16          # four bands of 16 bits
BANDS = 4
DEFAULT_MAX_HAMMING = 6
# ---------------------------------------------------------------------------


# B13
def content_hash(c) -> Column:
    """SHA-1 hex of the UTF-8 text."""
    return F.sha1(F.encode(_col(c), "UTF-8"))


# B14
def stable_id(c, line) -> Column:
    return F.concat(content_hash(c), F.lit(":"), _col(line).cast("string"))


# B15
def stable_window_id(c, start, end) -> Column:
    return F.concat(content_hash(c), F.lit(":"), _col(start).cast("string"), F.lit("-"),
                    _col(end).cast("string"))


def md5_low64(c) -> Column:
    """Low 64 bits of the MD5 of ``c`` as a signed BIGINT (two 32-bit halves, so
    no decimal conversion can overflow under ANSI mode)."""
    m = F.md5(F.encode(_col(c), "UTF-8"))
    hi = F.conv(F.substring(m, 17, 8), 16, 10).cast("bigint")
    lo = F.conv(F.substring(m, 25, 8), 16, 10).cast("bigint")
    return F.shiftleft(hi, 32).bitwiseOR(lo)


# B16
def token_hashes(c) -> Column:
    """md5-low-64 of every lower-cased ``\\w+`` token, repeats kept."""
    toks = F.regexp_extract_all(F.lower(_col(c)), F.lit(f"{W}+"), 0)
    return F.transform(toks, md5_low64)


def simhash64(c) -> Column:
    """64-bit SimHash as a signed BIGINT; texts without word tokens hash to 0."""
    return simhash_of_hashes(token_hashes(c))


_SLICE_TOKENS = 1 << 20  # token hashes voted at once (a 64 MB bit matrix)


def _vote_rows(offs: np.ndarray, vals: np.ndarray) -> np.ndarray:
    """SimHash of every row of one slice: ``offs`` are row offsets into ``vals``."""
    out = np.zeros(len(offs) - 1, dtype=np.int64)
    lens = np.diff(offs)
    nz = lens > 0
    if not nz.any():
        return out
    seg = vals[offs[0]:offs[-1]]
    starts = offs[:-1][nz] - offs[0]
    bits = np.unpackbits(seg.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    keep = 2 * ones >= lens[nz][:, None]
    out[nz] = np.packbits(keep.astype(np.uint8), axis=1, bitorder="little").view("<i8").ravel()
    return out


def _vote_batch(hashes: pa.Array) -> pa.Array:
    """Bit i set when at least half of a row's token hashes have bit i set; rows
    without tokens -> 0, NULL -> NULL.  Vectorised over the whole Arrow batch."""
    if isinstance(hashes, pa.ChunkedArray):
        hashes = hashes.combine_chunks()
    n_rows = len(hashes)
    out = np.zeros(n_rows, dtype=np.int64)
    if n_rows:
        offs = np.asarray(hashes.offsets, dtype=np.int64)
        vals = np.asarray(hashes.values.to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < n_rows:
            stop = int(np.searchsorted(offs, offs[start] + _SLICE_TOKENS, side="right")) - 1
            stop = min(max(stop, start + 1), n_rows)
            out[start:stop] = _vote_rows(offs[start:stop + 1], vals)
            start = stop
    return pa.array(out, type=pa.int64(), mask=np.asarray(hashes.is_null()))


_vote = F.arrow_udf(_vote_batch, T.LongType())


def simhash_of_hashes(hashes: Column) -> Column:
    """SimHash from an array of 64-bit token hashes (Arrow-batched vote)."""
    return _vote(hashes)


# B17
def hamming64(a, b) -> Column:
    return F.bit_count(_col(a).bitwiseXOR(_col(b)))


# B18
def simhash_bands(h) -> Column:
    """The four 16-bit band values (low band first) as INTs."""
    h = _col(h)
    mask = F.lit(0xFFFF).cast("bigint")
    return F.array(*[F.call_function("shiftrightunsigned", h, F.lit(BAND_BITS * k)).bitwiseAND(mask).cast("int")
                     for k in range(BANDS)])


def simhash_hex(h) -> Column:
    """Unsigned 16-digit lower-case hex of a SimHash (for reports and oracles)."""
    return F.lpad(F.lower(F.hex(_col(h))), 16, "0")
