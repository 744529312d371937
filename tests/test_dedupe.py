import random

import numpy as np
from pyspark.sql import functions as F

from parley.functions import hashing as H
from parley.operators import dedupe as dd


def signed(u):
    return u - (1 << 64) if u >> 63 else u


def bands(u):
    return [u >> (16 * k) & 0xFFFF for k in range(4)]


def match(a, b, t):
    return (a ^ b).bit_count() <= t and bool(set(bands(a)) & set(bands(b)))


def _items(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")


def _keep(spark, texts, t):
    got = dd.fuzzy_keep(_items(spark, texts), "text", ["i"], t).collect()
    m = {r["i"]: r["fuzzy_keep"] for r in got}
    return [m[i] for i in range(len(texts))]


def test_near_duplicate_texts(spark):
    texts = ["hello world how are you", "Hello, world! How are you?", "completely different words here"]
    assert _keep(spark, texts, 10) == [True, False, True]


def test_blank_and_no_word_texts(spark):
    texts = ["", "  ", "!!!", "???", "real words"]
    assert _keep(spark, texts, 6) == [False, False, True, False, True]
    assert _keep(spark, texts, -1) == [False, False, True, True, True]


def test_greedy_chain(spark):
    # a~b, b~c, a!~c: a kept, b dropped, c kept
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 6), (6, 7), (4, 7)], "a long, b long")
    dropped = sorted(r["n"] for r in dd.greedy_dropped(edges).collect())
    assert dropped == [2, 5, 7]


def test_fuzzy_matches_sequential_loop(spark):
    rnd = random.Random(2)
    vocab = ["w%d" % i for i in range(12)]
    base = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 8))) for _ in range(40)]
    texts = []
    for _ in range(250):
        b = rnd.choice(base).split()
        if rnd.random() < 0.5 and b:
            b[rnd.randrange(len(b))] = rnd.choice(vocab)
        texts.append(" ".join(b) if rnd.random() > 0.05 else "")
    hashes = [r["h"] % (1 << 64) for r in _items(spark, texts).select("i", H.simhash64("text").alias("h")).orderBy("i").collect()]
    for t in (3, 6, 10):
        kept = _keep(spark, texts, t)
        # what is kept are the blank-free texts without an earlier kept match: no two kept ones match,
        # and everything dropped has an earlier kept match
        alive = [i for i, x in enumerate(texts) if x.strip()]
        assert not any(kept[i] for i in range(len(texts)) if not texts[i].strip())
        for i in alive:
            assert kept[i] != any(kept[j] and match(hashes[i], hashes[j], t) for j in alive if j < i), (i, t)


def test_pairs_band_value_any_position(spark):
    # band 0 of a equals band 3 of b, everything else far apart unless t is large
    a = 0x1234_0000_0000_ABCD
    b = 0xABCD_0000_0000_1234 ^ 0
    nodes = spark.createDataFrame([(1, signed(a)), (2, signed(b))], "node long, simhash long")
    d = bin(a ^ b).count("1")
    assert dd.near_duplicate_pairs(nodes, max_hamming=d - 1).count() == 0
    got = dd.near_duplicate_pairs(nodes, max_hamming=d).collect()
    assert [(r["a"], r["b"], r["distance"]) for r in got] == [(1, 2, d)]


def test_pairs_match_brute_force(spark):
    rnd = random.Random(9)
    base = [rnd.getrandbits(64) for _ in range(30)]
    hs = []
    for _ in range(300):
        h = rnd.choice(base)
        for _ in range(rnd.randint(0, 9)):
            h ^= 1 << rnd.randrange(64)
        hs.append(h)
    hs = list(dict.fromkeys(hs))
    nodes = spark.createDataFrame([(i, signed(h)) for i, h in enumerate(hs)], "node long, simhash long")
    for t in (0, 3, 6, 7, 9, 21):
        got = {(r["a"], r["b"]) for r in dd.near_duplicate_pairs(nodes, max_hamming=t).collect()}
        exp = {(i, j) for i in range(len(hs)) for j in range(i + 1, len(hs))
               if match(hs[i], hs[j], t)}
        assert got == exp, t


def test_exact_keep_first_wins(spark):
    df = spark.createDataFrame([("s", 3, "x"), ("s", 1, "x"), ("r", 9, "x"), ("s", 2, "y")],
                               "source string, start_line long, text string")
    df = df.withColumn("h", H.content_hash("text"))
    got = {(r["source"], r["start_line"]): r["exact_keep"] for r in dd.exact_keep(df, "h", ["source", "start_line"]).collect()}
    assert got == {("r", 9): True, ("s", 1): False, ("s", 3): False, ("s", 2): True}
    seen = df.filter(F.col("text") == "y").select("h")
    got = {(r["source"], r["start_line"]): r["exact_keep"] for r in dd.exact_keep(df, "h", ["source", "start_line"], seen).collect()}
    assert got[("s", 2)] is False


def test_block_rounds_equal_edge_rounds(spark):
    rnd = random.Random(4)
    base = [rnd.getrandbits(64) for _ in range(12)]
    hs = []
    for _ in range(400):
        h = rnd.choice(base)
        for _ in range(rnd.randint(0, 8)):
            h ^= 1 << rnd.randrange(64)
        hs.append(h)
    hs = list(dict.fromkeys(hs))
    nodes = spark.createDataFrame([(i, signed(h)) for i, h in enumerate(hs)], "node long, simhash long")
    for t in (2, 6, 9):
        a = {r["n"] for r in dd.greedy_dropped_blocks(nodes, t, small=3, front=4).collect()}
        a2 = {r["n"] for r in dd.greedy_dropped_blocks(nodes, t, small=20).collect()}
        a3 = {r["n"] for r in dd.greedy_dropped_blocks(nodes, t).collect()}
        assert a == a2 == a3, t
        b = {r["n"] for r in dd.greedy_dropped(dd.near_duplicate_pairs(nodes, max_hamming=t)).collect()}
        keep, seen = [], {}
        for i, h in enumerate(hs):
            if any(match(h, k, t) for k in keep):
                continue
            keep.append(h)
        exp = {i for i, h in enumerate(hs)} - {i for i, h in enumerate(hs) if h in set(keep)}
        assert a == b == exp, t


def test_one_big_cluster(spark):
    # 300 distinct hashes all within distance 2 of each other: one pivot drops the rest
    base = 0x0F0F_F0F0_1234_5678
    hs = [base] + [base ^ (1 << i) for i in range(64)] + [base ^ (1 << i) ^ (1 << j) for i in range(8) for j in range(i + 1, 64)][:235]
    nodes = spark.createDataFrame([(i, signed(h)) for i, h in enumerate(hs)], "node long, simhash long")
    dropped = {r["n"] for r in dd.greedy_dropped_blocks(nodes, 6, small=50, front=10).collect()}
    assert dropped == set(range(1, len(hs)))


def _rounds(caplog):
    return int(caplog.messages[-1].split(" in ")[1].split()[0])


def test_far_hashes_that_share_bits_settle_at_once(spark, caplog):
    """24 hashes that share 16 or 28 bits and are far apart: no pair, hardly a round."""
    rnd = random.Random(6)
    for common, t in ((16, 3), (28, 6)):
        hs = [(0xABCDEF1 << 36 >> (28 - common) << (28 - common)) | rnd.getrandbits(64 - common) for _ in range(24)]
        nodes = spark.createDataFrame([(i, signed(h)) for i, h in enumerate(hs)], "node long, simhash long")
        far = {(i, j) for i in range(24) for j in range(i) if match(hs[i], hs[j], t)}
        with caplog.at_level("INFO", "parley.dedupe"):
            assert dd.greedy_dropped_blocks(nodes, t, small=8).count() == len({i for i, _ in far})
        assert _rounds(caplog) <= 3


def test_a_hot_block_of_far_members_is_kept_by_the_front(spark, caplog):
    """Hashes with 44 common bits, at pairwise distance above t: a block through all levels."""
    code = [w for w in range(1 << 12) if w.bit_count() % 4 == 0][:200]
    hs = [0xFEDCBA98765 << 20 | w << 4 for w in code]
    nodes = spark.createDataFrame([(i, signed(h)) for i, h in enumerate(hs)], "node long, simhash long")
    keep = []
    for h in hs:
        if not any(match(h, k, 2) for k in keep):
            keep.append(h)
    with caplog.at_level("INFO", "parley.dedupe"):
        got = {r["n"] for r in dd.greedy_dropped_blocks(nodes, 2, small=6, front=64).collect()}
    assert got == {i for i, h in enumerate(hs) if h not in set(keep)} and _rounds(caplog) <= 12


def test_lone_keys_are_not_written(spark):
    """Far hashes: no row for a key of one member, whatever the level."""
    nodes = spark.range(3000).withColumnRenamed("id", "node").withColumn("simhash", F.xxhash64(F.lit("far"), "node"))
    blocks, hot = dd._blocks(nodes.checkpoint(), 6)
    assert hot.count() == 0 and blocks.count() < 4 * 3000
    assert blocks.groupBy("g").count().agg(F.min("count"), F.max("count")).first()[0] >= 2


def test_candidates_stay_few_and_planted_pairs_are_found(spark):
    n = 1 << 16
    h = F.xxhash64(F.lit("seed"), "node")
    nodes = spark.range(n).withColumnRenamed("id", "node").withColumn("simhash", h)
    flipped = F.col("simhash").bitwiseXOR(F.call_function("shiftleft", F.lit(7).cast("bigint"), (F.col("node") % 45).cast("int")))
    planted = nodes.filter("node % 64 = 0").select((F.col("node") + n).alias("node"), flipped.alias("simhash"))
    every = nodes.unionByName(planted).checkpoint()
    blocks, hot = dd._blocks(every, 6)
    assert hot.count() == 0
    found = blocks.groupBy("g").count().agg(F.sum("count"), F.sum(F.expr("count * (count - 1) / 2"))).first()
    assert found[0] < 12 * n and found[1] < 40 * n        # rows written and pairs compared
    pairs = dd.near_duplicate_pairs(every, max_hamming=6)
    assert pairs.filter(f"b = a + {n}").count() == n // 64


def test_crowds_are_compared_in_chunks(spark, monkeypatch):
    """Band values that all items share: as many rows as items times values, and every pair once."""
    rng = np.random.default_rng(8)
    low = rng.integers(0, 1 << 16, 1500)
    hashes = sorted({int(0x1234_5678_9ABC_0000 | int(x)) for x in low})
    nodes = spark.createDataFrame([(i, h) for i, h in enumerate(hashes)], "node long, simhash long")
    assert dd._chunks(dd._banded(nodes), 2, 100).agg(F.sum(F.size("m"))).first()[0] <= 4 * len(hashes)

    def refined(*_args):
        raise AssertionError("rows for refined keys")

    monkeypatch.setattr(dd, "_blocks", refined)
    monkeypatch.setattr(dd, "CHUNK", 100)
    pairs = dd.near_duplicate_pairs(nodes, max_hamming=4).collect()
    want = {(i, j): (a ^ b).bit_count() for i, a in enumerate(hashes) for j, b in enumerate(hashes) if i < j and (a ^ b).bit_count() <= 4}
    assert len(pairs) == len(want) and {(r["a"], r["b"]): r["distance"] for r in pairs} == want
    kept = []
    for i, h in enumerate(hashes):
        if not any((hashes[k] ^ h).bit_count() <= 4 for k in kept):
            kept.append(i)
    gone = [r["n"] for r in dd.greedy_dropped_blocks(nodes, 4, small=16, front=50).collect()]
    assert sorted(gone) == sorted(set(range(len(hashes))) - set(kept))
