import hashlib
import random

import pytest
import xxhash
from brute import awkward, frame, sha
from pyspark.sql import functions as F

from parley.llm import fingerprints as fp


def chosen(text, k, w):
    """Winnowing by its definition: every window, the rightmost of the smallest hashes."""
    if not text:
        return []
    grams = [xxhash.xxh64_intdigest(text[i:i + k].encode("utf-32-be"), 42) >> 32 & 0x7FFFFFFF for i in range(max(1, len(text) - k + 1))]
    out = []
    for s in range(max(1, len(grams) - w + 1)):
        window = grams[s:s + w]
        at = s + max(i for i, h in enumerate(window) if h == min(window))
        if (grams[at], at) not in out[-w:]:
            out.append((grams[at], at))
    return out


def alike(a, b):
    x, y = {h for h, _ in a}, {h for h, _ in b}
    return len(x & y) / len(x | y) if x | y else 1.0


def compared(rows, k, w):
    key = lambda d: (d[0] is not None, d[0] or 0, (lambda v: v - 2 ** 64 if v >> 63 else v)(xxhash.xxh64_intdigest((d[1] or "").encode(), 42)))
    ordered = sorted(rows, key=key)
    say = lambda grams: " ".join(str((h << 32) - 4 * p - 1) for h, p in grams)
    out = []
    for d, e in zip(ordered, ordered[1:] + ordered[:1]):
        t, n = d[1] or "", e[1] or ""
        cut = len(t) // 4
        edited = t[:len(t) - cut] + n[:cut]
        a, b, c = chosen(t, k, w), chosen(edited, k, w), chosen(n, k, w)
        out.append((d[0], len(t), sha(edited), say(a), say(b), round(alike(a, b), 9), round(alike(a, c), 9)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"],
                    round(r["near_edited"], 9), round(r["near_next"], 9)) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    out = ["".join(r.choice("ab é😀") for _ in range(r.choice([1, 5, 15, 16, 17, 40, 46, 47, 48, 63, 64, 200]))) for _ in range(60)]
    return [*out, "a" * 300, "ab" * 3000, "x" * 46, "x" * 47, out[0], out[0] + " ", "é" * 16]


@pytest.mark.parametrize("k,w", [(16, 32), (3, 4), (1, 1)])
def test_compare_equals_brute_force(spark, texts, k, w):
    rows = awkward(texts)
    rows += [(None, "", None, None, 0), (None, "another", None, None, 0), (7, "same id", None, None, 0), (7, None, None, None, None)]
    assert got(fp.compare_with_next(frame(spark, rows), k=k, w=w)) == compared(rows, k, w)


def test_slices_and_runs_do_not_show(spark, texts, monkeypatch):
    """Short slices, short runs of ids, one id on a third of the rows, many null ids."""
    monkeypatch.setattr(fp, "SLICE", 7)
    monkeypatch.setattr(fp, "RUN_ROWS", 4)
    r = random.Random(8)
    rows = [(r.choice([5, 5, None, r.randint(-40, 40)]), t, None, None, 0) for t in texts for _ in range(2)]
    assert got(fp.compare_with_next(frame(spark, rows), k=4, w=8)) == compared(rows, 4, 8)


def test_small_tables(spark):
    assert fp.compare_with_next(frame(spark, [])).count() == 0
    assert fp.fingerprints(frame(spark, [])).count() == 0
    only = fp.compare_with_next(frame(spark, [(3, "all alone in a table, its own next document of all", None, None, 0)])).first()
    assert only["near_next"] == 1.0
    empty = fp.compare_with_next(frame(spark, [(3, None, None, None, None), (None, "", None, None, 0)])).collect()
    assert {(r["fingerprint"], r["near_edited"], r["near_next"], r["edited_sha256"]) for r in empty} == {("", 1.0, 1.0, hashlib.sha256(b"").hexdigest())}


def test_shared_run_shares_a_gram_at_its_place(spark):
    """The guarantee: any shared run of k + w - 1 code points gives a common hash inside it."""
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abcdefghij kl") for _ in range(n))
    run = [word(47) for _ in range(30)]
    rows = [(i, word(r.randint(0, 90)) + s + word(r.randint(0, 90)), None, None, 0) for i, s in enumerate(run) for _ in range(2)]
    found = {}
    for row, d in zip(fp.fingerprints(frame(spark, rows)).withColumn("n", F.monotonically_increasing_id()).orderBy("n").collect(), rows):
        s = run[d[0]]
        at = d[1].index(s)
        found.setdefault(d[0], []).append({(g["hash"], g["position"] - at) for g in row["grams"] if at <= g["position"] <= at + 47 - 16})
    assert all(a & b for a, b in found.values())


def test_window_must_double(spark):
    with pytest.raises(ValueError):
        fp.fingerprints(frame(spark, []), w=3)


def test_no_sort_or_shuffle_besides_the_run_exchange(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = fp.compare_with_next(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [run") == 1 and "Python" not in plan
