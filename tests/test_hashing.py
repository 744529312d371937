import hashlib
import random

from pyspark.sql import functions as F

from parley.functions import hashing as H


def test_content_hash_and_ids(spark):
    df = spark.createDataFrame([("héllo", 3, 5)], "t string, s int, e int")
    r = df.select(H.content_hash("t").alias("h"), H.stable_id("t", "e").alias("i"),
                  H.stable_window_id("t", "s", "e").alias("w")).first()
    h = hashlib.sha1("héllo".encode()).hexdigest()
    assert (r["h"], r["i"], r["w"]) == (h, f"{h}:5", f"{h}:3-5")


def _low64(word):
    return int.from_bytes(hashlib.md5(word.encode()).digest()[8:], "big")


def test_simhash_of_single_words_and_ties(spark):
    a, b = _low64("ox"), _low64("elk")
    cases = [("", 0), ("!!!", 0), ("ox", a), ("Ox, OX", a), ("ox ox elk", a), ("ox elk", a | b), ("γάμμα", _low64("γάμμα"))]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string")
    got = df.select(H.simhash_hex(H.simhash64("t")).alias("x"), H.simhash64("t").alias("h"), H.simhash_bands(H.simhash64("t")).alias("b")).collect()
    assert [r["x"] for r in got] == [f"{u:016x}" for _, u in cases]      # a bit with half of the votes is set
    for r in got:
        u = r["h"] % (1 << 64)
        assert sum(v << (16 * i) for i, v in enumerate(r["b"])) == u and all(0 <= v < 65536 for v in r["b"])


def test_simhash_ignores_order_and_case(spark):
    rnd = random.Random(5)
    words = ["alpha", "Beta", "délta", "x1", "_u", "İnce", "ﬁne"]
    texts = [[rnd.choice(words) for _ in range(rnd.randint(1, 40))] for _ in range(100)]
    df = spark.createDataFrame([(" ".join(t), "; ".join(sorted(t))) for t in texts], "t string, u string")
    assert df.filter(H.simhash64("t") != H.simhash64("u")).count() == 0
    assert df.filter(H.simhash64("t") != H.simhash64(F.concat("t", F.lit(" "), "t"))).count() == 0


def test_hamming(spark):
    df = spark.createDataFrame([(0, -1), (5, 6), (-9223372036854775808, 1)], "a long, b long")
    assert [r[0] for r in df.select(H.hamming64("a", "b")).collect()] == [64, 2, 2]
