import random
import re
from collections import Counter, defaultdict

from brute import UP, awkward, frame

from parley.llm import divergence as dv

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audited(rows, min_docs=3, top=200):
    """The contract, term by term and pair by pair."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(UP))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        total = {t: sum(counts[lang, s][t] for s in sources) for t in kept}

        def shares(of):
            n = sum(of[t] for t in kept)
            return {t: 1 + 10 ** 9 * (of[t] + 1) // (n + len(kept)) for t in kept}

        q, p = shares(total), {s: shares(counts[lang, s]) for s in sources}
        f = lambda x, y: (x - y) * (x - y) // y
        for s in sources:
            parts = {"pair": [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s],
                     "term": [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(items, 1) if part == "pair" or i <= top]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(sources=9, seed=2):
    r = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bdf" for b in ("a", "é", "Ü") for c in ("n", "st", "😀", "R")]
    rows = []
    for i in range(150):
        s = r.randrange(sources) if i % 3 else 0       # one source holds a third and more
        text = " ".join(r.choices(words[:6 + 4 * (s % 7)], k=r.choice([0, 1, 3, 40])))
        rows.append((i, text + r.choice(["", ".", " x1y2z", "\tnul\x00l"]), r.choice(["en", "de", None]), f"s{s}" if s else None, 0))
    return [*rows, *rows[:5], (900, None, "xx", "a", 0), (901, "", "xx", "b", 0), (902, "lonely words here", "yy", "a", 0)]


def test_audit_equals_brute_force(spark):
    for rows in (awkward(), corpus()):
        assert got(dv.audit(frame(spark, rows))) == audited(rows)


def test_cut_inside_equal_values(spark):
    rows = corpus()
    for top in (1, 4, 11):
        assert got(dv.audit(frame(spark, rows), top=top)) == audited(rows, top=top)
    many = [(i, " ".join(f"w{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(600)), "en", "ab"[i % 2], 0) for i in range(6)]
    many += [(9, "other words other words", "en", "c", 0)] * 3
    assert got(dv.audit(frame(spark, many))) == audited(many)


def test_blocks_flushes_and_pieces_do_not_show(spark):
    """Kernels are run here with tiny limits (workers import the module afresh)."""
    import pyarrow as pa
    rows = corpus(12)
    table = pa.table({"lang": [d[2] or "" for d in rows], "source": [d[3] or "" for d in rows], "text": [d[1] or "" for d in rows]})
    old = dv.HELD_TERMS, dv.PIECE
    try:
        sums = []
        for dv.HELD_TERMS, dv.PIECE in (old, (3, 5)):
            n, d = Counter(), Counter()
            for b in dv._count_kernel(table.to_batches(max_chunksize=70)):
                for r in b.to_pylist():
                    n[r["lang"], r["source"], r["term"]] += r["n"]
                    d[r["lang"], r["source"], r["term"]] += r["docs"]
            sums.append((n, d))
        assert sums[0] == sums[1] and sums[0][0]
    finally:
        dv.HELD_TERMS, dv.PIECE = old


def test_more_sources_than_a_block_holds(spark):
    r = random.Random(3)
    words = [f"w{a}{b}" for a in "abcdefgh" for b in "xyz"]
    rows = [(i, " ".join(r.choices(words, k=r.choice([1, 2, 9]))), "en", f"src{i % 140}", 0) for i in range(420)]
    assert got(dv.audit(frame(spark, rows))) == audited(rows)


def test_shares_are_exact(spark):
    import numpy as np
    r = random.Random(1)
    cases = [(r.randrange(10 ** r.randint(1, 15)), r.randrange(1, 10 ** r.randint(1, 15)), r.randrange(1, 10 ** 6)) for _ in range(200)]
    want = [1 + 10 ** 9 * (n + 1) // (of + v) for n, of, v in cases]
    assert [int(dv._shares(np.array([n]), np.array([of]), v)[0]) for n, of, v in cases] == want
    from pyspark.sql import functions as F
    df = spark.createDataFrame(cases, "n long, o long, v long").select(dv.share(F.col("n"), F.col("o"), F.col("v")).alias("p"))
    assert [x["p"] for x in df.collect()] == want


def test_empty_table(spark):
    assert dv.audit(frame(spark, [])).count() == 0
