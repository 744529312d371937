"""Text Column functions.

Every function takes and returns ``pyspark.sql.Column`` and is built from Spark
built-ins only, so it stays inside whole-stage code generation.

Python's ``re``/``str`` semantics are the contract; Java regex differs in a few
places (``\\w``, ``\\b``, ``\\s``, ``\\d``, IGNORECASE), so the classes are spelled
out below.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Patterns in Python ``re`` syntax, exactly as the reference applies them; the
# email and address patterns run with re.IGNORECASE.  The Java forms used by
# Spark are derived below by ``java_regex``.
EMAIL_PATTERN = r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE_PATTERN = r"\b(?:\+?\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)[\s.-]?)?\d{3,4}[\s.-]?\d{3,4}\b"
ADDRESS_PATTERN = (
    r"\b\d{1,6}\s+[A-Z0-9][A-Z0-9'\-\.]+(?:\s+[A-Z0-9][A-Z0-9'\-\.]+){0,4}\s+"
    r"(?:ST|STREET|AVE|AVENUE|RD|ROAD|BLVD|BOULEVARD|DR|DRIVE|LN|LANE|WAY|CT|COURT|PL|PLACE)\b"
)
INLINE_META_PATTERN = r"^\[(?P<ts>[^\]]+)\]\s+(?P<speaker>[^:]{1,80}):\s*(?P<msg>.*)$"
# Runs collapsed inside a line.
HSPACE_PATTERN = r"[\t\f\v ]+"
# Emoji code-point ranges removed by strip_emoji.
EMOJI_CLASS = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}]+"
# Replacement tokens.
EMAIL_TOKEN, PHONE_TOKEN, ADDRESS_TOKEN = "<EMAIL>", "<PHONE>", "<ADDRESS>"
# Prompt / reply fixed strings.
PREVIEW_LIMIT = 140
# ---------------------------------------------------------------------------

# Translation rules from Python ``re`` (str patterns) to Java regex.
# Python's str.isspace() set (29 code points), as a Java regex class body.
WS_CLASS = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# The same 29 characters as a literal set for btrim().
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
# Same set without the newline (per-line stripping).
WS_CLASS_NO_NL = (
    r"\t\x{0b}-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# Python's \w on str patterns.
W = r"[\p{L}\p{N}_]"
# Python's \b for that \w.
BOUNDARY = rf"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"
# Python's \d on str patterns.
DIGIT = r"\p{Nd}"
# [A-Z] under Python re.IGNORECASE also takes these four code points.
AZ_CI = r"A-Za-z\x{130}\x{131}\x{17f}\x{212a}"
# Letters that Python's IGNORECASE folds onto an ASCII letter.
_CASE_EXTRA = {"S": r"\x{17f}", "K": r"\x{212a}", "I": r"\x{130}\x{131}"}


def _ci(word: str) -> str:
    """Case-insensitive spelling of an ASCII word with Python's folding."""
    out = []
    for ch in word:
        up = ch.upper()
        out.append(f"[{up}{up.lower()}{_CASE_EXTRA.get(up, '')}]")
    return "".join(out)


def java_regex(pattern: str, ignorecase: bool = False) -> str:
    """Rewrite a Python ``re`` pattern (the subset used here) for Java regex:
    ``\\b \\w \\s \\d \\f \\v``, named groups and IGNORECASE letters get the rules above.
    ``.``/``$`` need the caller's ``(?d)`` flag when the text may hold ``\\r``."""
    out, i, n, in_class = [], 0, len(pattern), False
    while i < n:
        c = pattern[i]
        if c == "\\" and i + 1 < n:
            e = pattern[i + 1]
            if e == "b" and not in_class:
                out.append(BOUNDARY)
            elif e == "d":
                out.append(DIGIT)
            elif e == "s":
                out.append(WS_CLASS if in_class else f"[{WS_CLASS}]")
            elif e == "w":
                out.append(W[1:-1] if in_class else W)
            elif e == "f":
                out.append(r"\x{0c}")
            elif e == "v":
                out.append(r"\x{0b}")
            else:
                out.append(c + e)
            i += 2
            continue
        if in_class:
            if c == "]":
                in_class = False
                out.append(c)
            elif ignorecase and pattern.startswith("A-Z", i):
                out.append(AZ_CI)
                i += 3
                continue
            elif c == "-" and i + 1 < n and pattern[i + 1] == "]":
                out.append(r"\-")
            else:
                out.append(c)
            i += 1
            continue
        if c == "[":
            in_class = True
            out.append(c)
            if i + 1 < n and pattern[i + 1] == "^":
                out.append("^")
                i += 1
            i += 1
            continue
        if pattern.startswith("(?P<", i):
            j = pattern.index(">", i)
            out.append("(?<" + pattern[i + 4:j] + ">")
            i = j + 1
            continue
        if ignorecase and c.isascii() and c.isalpha():
            out.append(_ci(c))
        else:
            out.append(c)
        i += 1
    return "".join(out)


H_SPACE = java_regex(HSPACE_PATTERN)
EMAIL_RE = java_regex(EMAIL_PATTERN, ignorecase=True)
PHONE_RE = java_regex(PHONE_PATTERN)
ADDRESS_RE = java_regex(ADDRESS_PATTERN, ignorecase=True)
INLINE_META_RE = "(?d)" + java_regex(INLINE_META_PATTERN)
# the street suffixes, read off the address pattern (used by the SQL twins)
STREET_SUFFIXES = tuple(ADDRESS_PATTERN.rsplit("(?:", 1)[1].split(")")[0].split("|"))

_REDACT_ALIASES = {
    "email": "email", "emails": "email",
    "phone": "phone", "phones": "phone", "tel": "phone", "telephone": "phone",
    "address": "address", "addresses": "address", "addr": "address",
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# B1
def normalize_newlines(c) -> Column:
    return F.regexp_replace(_col(c), r"\r\n?", "\n")


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove the 29 whitespace code points at both ends."""
    return F.btrim(_col(c), F.lit(WS_CHARS))


# B2
def collapse_whitespace(c) -> Column:
    """Per line: runs of [\\t\\f\\v ] become one space, then the line is stripped.
    Newlines stay."""
    x = F.regexp_replace(_col(c), H_SPACE, " ")
    return F.regexp_replace(x, rf"(?md)^[{WS_CLASS_NO_NL}]+|[{WS_CLASS_NO_NL}]+$", "")


# B3
def strip_emoji(c) -> Column:
    return F.regexp_replace(_col(c), EMOJI_CLASS, "")


# B4
def normalize_text(c, collapse: bool = False, emoji: bool = False) -> Column:
    out = normalize_newlines(c)
    if emoji:
        out = strip_emoji(out)
    if collapse:
        out = collapse_whitespace(out)
    return out


# B5
def normalize_message_line(c, collapse: bool = False, emoji: bool = False) -> Column:
    """One message per line: newlines become spaces, [\\t\\f\\v ] runs collapse and
    the result is stripped (the collapse flag cannot change the outcome)."""
    out = normalize_text(c, collapse=collapse, emoji=emoji)
    out = strip_ws(F.translate(out, "\n", " "))
    return strip_ws(F.regexp_replace(out, H_SPACE, " "))


# B6
def clean_line(c) -> Column:
    """Collapse every whitespace run to one space and trim (Python ' '.join(s.split()))."""
    return F.regexp_replace(strip_ws(c), f"[{WS_CLASS}]+", " ")


# B7-B10
def redact_email(c) -> Column:
    return F.regexp_replace(_col(c), EMAIL_RE, EMAIL_TOKEN)


def redact_phone(c) -> Column:
    return F.regexp_replace(_col(c), PHONE_RE, PHONE_TOKEN)


def redact_address(c) -> Column:
    return F.regexp_replace(_col(c), ADDRESS_RE, ADDRESS_TOKEN)


def redact_kinds(types=None) -> list[str]:
    """Canonical kinds in application order; unknown or empty -> all three."""
    chosen = set()
    for t in types or []:
        k = _REDACT_ALIASES.get(str(t).strip().lower())
        if k:
            chosen.add(k)
    if not chosen:
        chosen = {"email", "phone", "address"}
    return [k for k in ("email", "phone", "address") if k in chosen]


def redact(c, types=None) -> Column:
    out = _col(c)
    fns = {"email": redact_email, "phone": redact_phone, "address": redact_address}
    for k in redact_kinds(types):
        out = fns[k](out)
    return out


# B11
def inline_metadata(c) -> Column:
    """``[ts] Speaker: msg`` -> struct(msg, speaker, ts); otherwise (text, NULL, NULL).
    The input is stripped first."""
    t = strip_ws(c)
    hit = t.rlike(INLINE_META_RE)
    ts = strip_ws(F.regexp_extract(t, INLINE_META_RE, 1))
    sp = strip_ws(F.regexp_extract(t, INLINE_META_RE, 2))
    msg = strip_ws(F.regexp_extract(t, INLINE_META_RE, 3))
    return F.struct(
        F.when(hit, msg).otherwise(t).alias("msg"),
        F.when(hit, F.nullif(sp, F.lit(""))).alias("speaker"),
        F.when(hit, F.nullif(ts, F.lit(""))).alias("timestamp"),
    )


# B12
def clean_for_embedding(c) -> Column:
    """Strip inline metadata from each line of a chunk.

    Returns struct(text, speaker, timestamp, start_speaker, end_speaker,
    start_timestamp, end_timestamp); the start/end fields only for chunks of more
    than one line."""
    lines = F.split(_col(c), "\n", -1)
    metas = F.transform(lines, lambda ln: inline_metadata(ln))
    text = strip_ws(F.array_join(F.transform(metas, lambda m: m["msg"]), "\n"))
    speakers = F.filter(metas, lambda m: m["speaker"].isNotNull())
    stamps = F.filter(metas, lambda m: m["timestamp"].isNotNull())
    multi = F.size(lines) > 1
    first, last = F.element_at(metas, 1), F.element_at(metas, -1)
    return F.struct(
        text.alias("text"),
        F.try_element_at(speakers, F.lit(1))["speaker"].alias("speaker"),
        F.try_element_at(stamps, F.lit(1))["timestamp"].alias("timestamp"),
        F.when(multi, first["speaker"]).alias("start_speaker"),
        F.when(multi, last["speaker"]).alias("end_speaker"),
        F.when(multi, first["timestamp"]).alias("start_timestamp"),
        F.when(multi, last["timestamp"]).alias("end_timestamp"),
    )


# B20
def metadata_prefix(ts, name) -> Column:
    """``[ts] `` and ``name: `` each only when a non-blank string."""
    ts_s, nm_s = strip_ws(_col(ts)), strip_ws(_col(name))
    return F.concat(
        F.when(ts_s != "", F.concat(F.lit("["), ts_s, F.lit("] "))).otherwise(F.lit("")),
        F.when(nm_s != "", F.concat(nm_s, F.lit(": "))).otherwise(F.lit("")),
    )


# B21
_ROLE_PREFIX = rf"^(?i:you:|user:)[{WS_CLASS}]*"


def strip_role_prefix(c) -> Column:
    """Strip, then drop a leading ``you:`` / ``user:`` (any case) and the
    whitespace after it."""
    return F.regexp_replace(strip_ws(c), _ROLE_PREFIX, "")


# B22
def clean_answer(c) -> Column:
    """One line, role prefix dropped, cut at the first `` user:`` (else `` you:``).

    Each stage refers to the previous one at most three times, so the regex work
    per row stays small."""
    one_line = strip_ws(F.translate(strip_ws(normalize_newlines(c)), "\n", " "))
    t = F.regexp_replace(one_line, _ROLE_PREFIX, "")
    cut_user = F.rtrim(F.regexp_replace(t, r"(?is) user:.*$", ""), F.lit(WS_CHARS))
    cut_you = F.rtrim(F.regexp_replace(t, r"(?is) you:.*$", ""), F.lit(WS_CHARS))
    return F.when(t.rlike(r"(?i) user:"), cut_user).otherwise(cut_you)


# B23
def truncate_at_stops(c, start, stops: list[str]) -> Column:
    """Cut at the earliest stop string found at or after 0-based ``start``."""
    c = _col(c)
    start = start if isinstance(start, Column) else F.lit(int(start))
    stops = [s for s in stops if isinstance(s, str) and s]
    if not stops:
        return c
    hits = F.array(*[F.call_function("locate", F.lit(s), c, start + 1) for s in stops])
    first = F.array_min(F.filter(hits, lambda i: i > 0))
    return F.when(first.isNotNull(), F.substring(c, F.lit(1), first - 1)).otherwise(c)


# B24
def preview(c, limit: int = PREVIEW_LIMIT) -> Column:
    t = strip_ws(F.translate(_col(c), "\n", " "))
    return F.when(
        F.char_length(t) > limit, F.concat(F.substring(t, 1, limit - 3), F.lit("..."))
    ).otherwise(t)


# tokens, shared by profiling, SimHash, the default embedder and the scorer
def word_tokens(c) -> Column:
    """Python ``re.findall(r'\\w+', text)``."""
    return F.regexp_extract_all(_col(c), F.lit(f"{W}+"), 0)
