import random

import pytest
from pyspark.sql import functions as F

from parley.operators import chunk as ch
from parley.operators import order as od
from conftest import rows


def _corpus(spark, items, source="s"):
    return spark.createDataFrame([(source, ln, t) for ln, t in items], "source string, line_no long, text string")


def test_windows_with_gaps(spark):
    c = _corpus(spark, [(3, "fog"), (10, "rain"), (11, "sun"), (40, "wind")])
    w2 = ch.build_chunks(c, "window", 2).orderBy("start_line")
    assert rows(w2, "start_line", "end_line", "text") == [(3, 10, "fog\nrain"), (10, 11, "rain\nsun"), (11, 40, "sun\nwind")]
    w4 = ch.build_chunks(c, "sliding", 4)
    assert rows(w4, "start_line", "end_line", "text") == [(3, 40, "fog\nrain\nsun\nwind")]
    assert ch.build_chunks(c, "window", 9).count() == 0
    for mode, size in (("window", 0), ("per-message", 5)):
        one = ch.build_chunks(c, mode, size).orderBy("start_line")
        assert rows(one, "start_line", "end_line") == [(3, 3), (10, 10), (11, 11), (40, 40)]
    with pytest.raises(ValueError):
        ch.build_chunks(c, "chapter")


def test_chunk_ids(spark):
    c = _corpus(spark, [(1, "a"), (2, "b")])
    ids = rows(ch.with_ids(ch.build_chunks(c, "window", 2), "window"), "id")
    import hashlib
    assert ids == [(hashlib.sha1(b"a\nb").hexdigest() + ":1-2",)]


def test_next_rows_equal_plain_windows(spark):
    rnd = random.Random(11)
    data = []
    for s in range(4):
        ln = 0
        for _ in range(rnd.randint(0, 40)):
            ln += rnd.choice([1, 1, 2, 3, 17])      # some blocks are missing, some hold one row
            data.append((f"s{s}", ln, f"t{s}-{ln}"))
    df = spark.createDataFrame(data, "source string, line_no long, text string").repartition(3)
    for n in (1, 2, 3, 5, 11):
        got = od.next_rows(df, ["source"], ["line_no", "text"], n, block=4)
        got = {(r["source"], r["line_no"]): [x["text"] for x in r["_win"]] for r in got.collect()}
        by = {}
        for s, ln, t in sorted(data):
            by.setdefault(s, []).append(t)
        exp = {}
        for s, ln, t in sorted(data):
            i = by[s].index(t)
            exp[(s, ln)] = by[s][i:i + n]
        assert got == exp
    lead = od.lead_within(df, ["source"], "text", "nxt", block=3)
    got = {(r["source"], r["line_no"]): r["nxt"] for r in lead.collect()}
    for (s, ln), v in got.items():
        seq = by[s]
        i = seq.index(f"t{s[1:]}-{ln}")
        assert v == (seq[i + 1] if i + 1 < len(seq) else None)


def test_running_sum_and_dense_seq(spark):
    data = [("a", i * 2 + 1, i % 3) for i in range(30)] + [("b", i + 1, 1) for i in range(7)]
    df = spark.createDataFrame(data, "source string, line_no long, v long")
    rs = od.running_sum(df, ["source"], "v", "cum", block=4)
    got = {(r["source"], r["line_no"]): r["cum"] for r in rs.collect()}
    acc = {}
    for s, ln, v in data:
        acc[s] = acc.get(s, 0) + v
        assert got[(s, ln)] == acc[s]
    ds = od.dense_seq(df, ["source"], block=4)
    got = sorted((r["source"], r["line_no"], r["seq"]) for r in ds.collect())
    exp = sorted([(s, ln, i) for s in ("a", "b") for i, ln in enumerate(sorted(x[1] for x in data if x[0] == s))])
    assert got == exp


def test_global_offsets(spark):
    data = [(s, ln, "x" * ((s * 7 + ln) % 5)) for s in range(5) for ln in range(1, 9)]
    df = spark.createDataFrame(data, "source int, line_no long, text string").repartition(4)
    got = od.global_offsets(df.withColumn("len", F.char_length("text")), ["source", "line_no"], "len", partitions=3)
    got = {(r["source"], r["line_no"]): r["offset"] for r in got.collect()}
    acc = 0
    for s, ln, t in sorted(data):
        assert got[(s, ln)] == acc
        acc += len(t)


def test_running_last(spark):
    rnd = random.Random(3)
    data = [(s, ln, rnd.choice([None, None, None, ln])) for s in ("a", "b") for ln in range(1, 40, rnd.choice([1, 3]))]
    df = spark.createDataFrame(data, "source string, line_no long, v long").repartition(3)
    for inclusive in (True, False):
        got = {(r["source"], r["line_no"]): r["last"] for r in od.running_last(df, ["source"], "v", "last", block=5, inclusive=inclusive).collect()}
        last = {}
        for s, ln, v in data:
            seen = last.get(s)
            last[s] = seen if v is None else v
            assert got[s, ln] == (last[s] if inclusive else seen)


def test_first_rows_is_a_filter(spark):
    data = [(s, ln, f"{s}{ln}") for s in (None, "a", "b", "c") for ln in range(2, 90, 3)]
    df = spark.createDataFrame(data, "source string, line_no long, text string").repartition(5)
    ordered = sorted(data, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    for n in (-1, 0, 1, 29, 30, 58, 87, len(data) // 2, len(data) - 1, len(data), 10_000):
        out = od.first_rows(df, n, block=16)
        assert sorted((r["text"] for r in out.collect())) == sorted(r[2] for r in ordered[:max(n, 0)])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrdered" not in plan and "Window" not in plan


def test_windows_move_the_text_once(spark):
    c = spark.range(2000).select((F.col("id") % 3).alias("source"), F.col("id").alias("line_no"), F.col("id").cast("string").alias("text"))
    df = ch.build_chunks(c, "window", 4)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # the rows' own exchange, then the first rows of later blocks: cut to n - 1 a block before they move
    assert plan.count("Exchange hashpartitioning(source") - plan.count("WindowGroupLimit [source") // 2 <= 3
    assert "WindowGroupLimit" in plan and df.count() == 3 * 666 - 9 + 2
