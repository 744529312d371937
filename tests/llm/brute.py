"""Plain Python restatements of the result contracts, and a table of awkward documents."""

from __future__ import annotations

import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                    T.StructField("n_chars", T.LongType())])
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def awkward(extra: list[str] = (), seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "Mi", "ßu", "é") for b in ("r", "tt", "N", "sé")]
    long = " ".join(r.choice(words) for _ in range(12_000))
    texts = [None, "", "  \n\t ", "one", "One  two\u000bthree\u0085x four five six", "a a a a a a a a a a a a",
             long, long, "line\nline\n \nline\r\nend", "日本語 テキスト 😀 \x00 nul", *extra]
    rows = [(i, t, "en" if i % 2 else None, None if i % 5 == 4 else f"s{i % 3}", None if t is None else len(t))
            for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[4], (None, "no id here", None, None, 10)]


CLASHES = ("words", "size", "u", "rank", "bucket", "hash", "fp", "a", "b", "n", "label", "score", "spans", "blob", "row", "grams",
           "target", "upper", "kept", "component_id", "start", "kind")


def frame(spark, rows, clash: bool = True):
    df = spark.createDataFrame(rows, DOC)
    return df.withColumns({c: F.lit("x") for c in CLASHES}) if clash else df


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits: str) -> bool:
    doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def pii(text: str | None) -> list[tuple]:
    t = text or ""
    out = [(0, m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end(), "card"))
    out += [(3, m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def secrets(text: str | None) -> list[tuple]:
    t = text or ""
    key = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key"))
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t)
           if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def rules(text: str | None) -> tuple:
    t = text or ""
    w = SPACE.findall(t)
    grams: dict[tuple, list[int]] = {}
    for i in range(len(w) - 4):
        grams.setdefault(tuple(w[i:i + 5]), []).append(i)
    hit = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in t.split("\n") if SPACE.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def fingerprint(text: str | None) -> int:
    w = SPACE.findall((text or "").translate(UP))
    grams = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def least_reachable(prints: dict[int, int], radius: int = 4) -> dict[int, int]:
    """Smallest id reachable from each id, by comparing everything."""
    ids = sorted(prints)
    near = {i: [j for j in ids if (prints[i] ^ prints[j]).bit_count() <= radius] for i in ids}
    label: dict[int, int] = {}
    for i in ids:
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = i
                todo += near[x]
    return label


def hits(text: str | None, items: list[tuple], window: int = 10) -> tuple:
    w = PLAIN.findall((text or "").translate(UP))
    covered, found = set(), set()
    at: dict[tuple, list[int]] = {}
    for n in {min(window, len(PLAIN.findall((x or "").translate(UP)))) for _, x in items} - {0}:
        for i in range(len(w) - n + 1):
            at.setdefault(tuple(w[i:i + n]), []).append(i)
    for item, x in items:
        v = PLAIN.findall((x or "").translate(UP))
        n = min(window, len(v))
        for j in range(len(v) - n + 1 if n else 0):
            for i in at.get(tuple(v[j:j + n]), ()):
                covered |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(covered), sorted(found)
