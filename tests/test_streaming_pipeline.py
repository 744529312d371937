import json

from parley.operators import ingest as ing
from parley.operators.embed import hashed_embedder
from parley.plans.pipeline import run_pipeline
from parley.sources.store import ParquetStore
from parley.streaming.streams import CORPUS_DDL, QUERY_DDL, answer_stream, ingest_stream


def test_ingest_stream_is_idempotent(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    spark.createDataFrame([("f", 1, "hello there"), ("f", 2, "general kenobi"), ("f", 3, "hello there")],
                          CORPUS_DDL).write.parquet(str(src / "b1"))
    st = ParquetStore(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(CORPUS_DDL).parquet(str(src / "*"))
    q = ingest_stream(stream, st, str(tmp_path / "ck"), embedder=hashed_embedder(8), available_now=True)
    q.awaitTermination(120)
    assert st.ids().count() == 2
    spark.createDataFrame([("f", 4, "new line"), ("f", 1, "hello there")], CORPUS_DDL).write.parquet(str(src / "b2"))
    q = ingest_stream(stream, st, str(tmp_path / "ck"), embedder=hashed_embedder(8), available_now=True)
    q.awaitTermination(120)
    assert st.ids().count() == 3


def test_answer_stream(spark, tmp_path):
    corpus = spark.createDataFrame([("f", 1, "how are you"), ("f", 2, "fine thanks")], CORPUS_DDL)
    st = ParquetStore(spark, str(tmp_path / "store"))
    ing.ingest(corpus, st, ing.IngestOptions(), hashed_embedder(16))
    qdir = tmp_path / "q"
    spark.createDataFrame([("1", "how are you"), ("2", "   ")], QUERY_DDL).write.parquet(str(qdir / "b1"))
    stream = spark.readStream.schema(QUERY_DDL).parquet(str(qdir / "*"))
    q = answer_stream(stream, st, corpus, str(tmp_path / "out"), str(tmp_path / "ck"), embedder=hashed_embedder(16),
                      available_now=True)
    q.awaitTermination(120)
    events = [json.loads(line) for p in (tmp_path / "out").glob("epoch=*/part-*") for line in p.read_text().splitlines()]
    assert len(events) == 1 and events[0]["answer"] == "fine thanks" and events[0]["used_strategy"] == "corpus"


def test_pipeline(spark, tmp_path):
    p = tmp_path / "chat.txt"
    p.write_text("\n".join(f"line number {i} says {'hi' if i % 2 else 'hello'} there" for i in range(400)), encoding="utf-8")
    res = run_pipeline(spark, str(p), "plain", str(tmp_path / "work"), embedder=hashed_embedder(16), seq_len=32,
                       smoke_prompt="hello there", k=3)
    assert res.messages == 400 and res.added == 400 and res.vocab_size > 10
    assert res.eval["heldout_chars"] > 0 and len(res.smoke) == 3
    assert spark.read.parquet(res.sequences_path).count() > 0
    seen = []
    run_pipeline(spark, str(p), "plain", str(tmp_path / "work2"), embedder=hashed_embedder(16), seq_len=32,
                 ingest_stage=lambda c, s, o, e: seen.append(c.count()) or 0)
    assert seen == [400]
    res = run_pipeline(spark, str(p), "plain", str(tmp_path / "work3"), smoke_prompt="x",
                       parse=lambda sp, paths, fmt, meta: sp.createDataFrame([("p", 1, "only line")], CORPUS_DDL),
                       ingest_stage=lambda *a: 5, sequences_stage=lambda stream, n, path: (stream.count(), n, 9),
                       evaluate_stage=lambda stream, n: {"seq": n}, smoke_stage=lambda sp, store, prompt, k, e: [prompt, k])
    assert (res.messages, res.added, res.vocab_size, res.chars, res.eval, res.smoke) == (1, 5, 1, 256, {"seq": 9}, ["x", 6])


def test_pipeline_whatsapp_with_metadata(spark, tmp_path):
    p = tmp_path / "wa.txt"
    rows = []
    for i in range(300):
        rows.append(f"1/{i % 28 + 1}/24, {i % 12 + 1}:{i % 60:02d} PM - {'Ann' if i % 2 else 'Bob'}: message {i} here")
        if i % 7 == 0:
            rows.append(f"continued {i}")
    p.write_text("\n".join(rows), encoding="utf-8")
    res = run_pipeline(spark, str(p), "whatsapp", str(tmp_path / "w"), with_metadata=True,
                       embedder=hashed_embedder(16), seq_len=32)
    assert res.messages == 300 and res.added == 300
    st = ParquetStore(spark, res.store_path.rsplit("/", 1)[0])
    r = st.read().filter("metadata.line = 1").first()
    assert r["text"] == "message 0 here continued 0" and r["metadata"]["speaker"] == "Bob"
    assert r["metadata"]["timestamp"] == "1/1/24, 1:00 PM"


def test_ingest_stream_window_mode_and_empty_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    # one file per micro-batch
    spark.createDataFrame([("f", i, f"line {i}") for i in range(1, 6)], CORPUS_DDL).coalesce(1) \
        .write.parquet(str(src / "b1"))
    spark.createDataFrame([("f", 9, "   ")], CORPUS_DDL).coalesce(1).write.parquet(str(src / "b2"))
    st = ParquetStore(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(CORPUS_DDL).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    opts = ing.IngestOptions(chunking="window", window_size=2)
    q = ingest_stream(stream, st, str(tmp_path / "ck"), opts, embedder=hashed_embedder(8), available_now=True)
    q.awaitTermination(120)
    got = sorted((r["metadata"]["start_line"], r["metadata"]["end_line"]) for r in st.read().collect())
    assert got == [(1, 2), (2, 3), (3, 4), (4, 5)]


def test_windows_reach_across_micro_batches(spark, tmp_path, monkeypatch):
    """Three batches, one of them run twice, equal one batch run over all lines."""
    import random

    from parley.streaming.streams import WindowTail
    monkeypatch.setattr(WindowTail, "SNAPSHOT", 2)
    r = random.Random(7)
    lines = [(s, i + 1, r.choice(["", f"{s} says {i}", f"word {i % 7}"])) for s, n in (("a", 31), ("b", 12), ("c", 2)) for i in range(n)]
    cuts = {"a": (9, 20, 25), "b": (5, 5, 11), "c": (1, 1, 1)}      # b is silent in the second batch, c in two
    def batch(k):
        lo = lambda s: cuts[s][k - 1] if k else 0
        hi = lambda s: cuts[s][k] if k < 3 else 99
        return [x for x in lines if lo(x[0]) < x[1] <= hi(x[0])]
    src, st = tmp_path / "in", ParquetStore(spark, str(tmp_path / "store"))
    opts = ing.IngestOptions(chunking="window", window_size=4, exact_dedupe=False)
    src.mkdir()
    stream = spark.readStream.schema(CORPUS_DDL).parquet(str(src / "*"))
    for k in range(4):
        spark.createDataFrame(batch(k), CORPUS_DDL).write.parquet(str(src / f"b{k}"))
        ingest_stream(stream, st, str(tmp_path / "ck"), opts, hashed_embedder(8), available_now=True).awaitTermination(120)
    once = ParquetStore(spark, str(tmp_path / "once"))
    ing.ingest(spark.createDataFrame(lines, CORPUS_DDL), once, opts, hashed_embedder(8))
    key = lambda s: sorted((x["id"], x["text"], x["metadata"]["start_line"], x["metadata"]["end_line"]) for x in s.read().collect())
    assert key(st) == key(once) and len(key(st)) > 10
    # an epoch that runs again reads the same earlier rows
    tail = WindowTail(spark, str(tmp_path / "ck" / "window-tail"), 3)
    schema = spark.createDataFrame([], CORPUS_DDL).schema
    shown = [sorted(map(tuple, tail.before(e, schema).collect())) for e in range(5)]
    assert shown[0] == [] and shown[1] != shown[2] and all(len([x for x in got if x[0] == s]) <= 3 for got in shown for s in "abc")
    assert [x for x in shown[2] if x[0] == "b"] == [x for x in shown[1] if x[0] == "b"]
