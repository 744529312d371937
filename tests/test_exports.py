import json
import random

import pytest
from pyspark.sql import functions as F

from parley.sources import exports as ex
from conftest import rows

WA = """3/7/23, 6:02 AM - Marek: Train leaves soon
from platform two
3/7/23, 6:05 AM - Ida joined using an invite link
3/7/23, 6:09 AM - Ida: On   my way
3/7/23, 6:10 AM - Marek: <Media omitted>
3/8/23, 11:45 PM - Ida: Home 🙂
3/8/23, 11:59 PM - Marek: Sleep well"""


def test_whatsapp_golden(spark, tmp_path):
    p = tmp_path / "wa.txt"
    p.write_text(WA.replace("\n", "\r\n"), encoding="utf-8")
    got = ex.read_export(spark, str(p), "WhatsApp").orderBy("line_no")
    assert [r[0] for r in rows(got, "text")] == ["Train leaves soon from platform two", "On my way", "Home 🙂", "Sleep well"]
    meta = ex.read_export(spark, str(p), "wa", with_metadata=True).orderBy("line_no")
    assert [r[0] for r in rows(meta, "text")] == [
        "[3/7/23, 6:02 AM] Marek: Train leaves soon from platform two", "[3/7/23, 6:09 AM] Ida: On my way",
        "[3/8/23, 11:45 PM] Ida: Home 🙂", "[3/8/23, 11:59 PM] Marek: Sleep well"]


def test_whatsapp_system_line_drops_continuations(spark):
    lines = ["1/2/24, 9:00 - A: first", "cont", "1/2/24, 9:01 - system notice", "orphan", "1/2/24, 9:02 - B:   ",
             "lost", "1/2/24, 9:03 - C: last", "", "  tail  "]
    df = spark.createDataFrame([("x", i + 1, t) for i, t in enumerate(lines)], "source string, line_no long, text string")
    assert [r[0] for r in rows(ex.parse_whatsapp(df).orderBy("line_no"), "text")] == ["first cont", "last tail"]


TG = {"name": "chat", "type": "personal_chat", "messages": [
    {"id": 1, "type": "message", "date": "2025-01-01T10:00:00", "from": "Ann", "text": "Hi   there"},
    {"id": 2, "type": "service", "text": "joined"},
    {"id": 3, "type": "message", "from": " ", "text": ["Rich ", {"type": "bold", "text": "text"}, "!", {"type": "x"}, 5]},
    {"id": 4, "text": "  spaced\n out  ", "date": 7},
    {"id": 5, "type": "message", "text": {"odd": 1}},
    "not a dict",
]}


def test_telegram_golden(spark, tmp_path):
    p = tmp_path / "result.json"
    p.write_text(json.dumps(TG), encoding="utf-8")
    got = ex.read_export(spark, str(p), "telegram-json").orderBy("line_no")
    assert [r[0] for r in rows(got, "text")] == ["Hi there", "Rich text!", "spaced out"]
    meta = ex.read_export(spark, str(p), "tg", with_metadata=True).orderBy("line_no")
    assert [r[0] for r in rows(meta, "text")] == ["[2025-01-01T10:00:00] Ann: Hi there", "Rich text!", "spaced out"]


def test_telegram_errors(spark, tmp_path):
    p = tmp_path / "bad.json"
    p.write_text('{"messages": {"a": 1}}', encoding="utf-8")
    with pytest.raises(ex.ParseError):
        ex.read_export(spark, str(p), "telegram").collect()
    with pytest.raises(ex.ParseError):
        ex.parse_telegram(ex.read_json_docs(spark, str(p))).collect()
    with pytest.raises(ex.ParseError):
        ex.export_format("csv")


def test_plain_lines(spark, tmp_path):
    p = tmp_path / "m.txt"
    p.write_text("a\n\n b \r c\n", encoding="utf-8")
    got = ex.read_export(spark, str(p), " TXT ").orderBy("line_no")
    assert rows(got, "line_no", "text") == [(1, "a"), (3, "b"), (4, "c")]


def test_canonical_sink(spark, tmp_path):
    df = spark.createDataFrame([("s", 2, " b\t c "), ("s", 1, "a"), ("s", 3, "   ")], "source string, line_no long, text string")
    out = tmp_path / "corpus"
    ex.write_corpus(df, str(out), "text", partitions=1)
    text = "".join(p.read_text() for p in sorted(out.glob("part-*")))
    assert text == "a\nb c\n"


def test_line_numbers_across_splits(spark, tmp_path):
    from parley.sources.corpus import read_text_files
    lines = [("x" * (i % 37)) if i % 5 else "" for i in range(3000)]
    p = tmp_path / "big.txt"
    p.write_text("\r\n".join(lines[:1500]) + "\r" + "\n".join(lines[1500:]) + "\n", encoding="utf-8")
    q = tmp_path / "small.txt"
    q.write_text("a\n\nb", encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = read_text_files(spark, [str(p), str(q)])
        assert df.rdd.getNumPartitions() > 5
        got = {(r["source"].rsplit("/", 1)[-1], r["line_no"]): r["text"] for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    raw = p.read_text(encoding="utf-8").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    exp = {("big.txt", i + 1): t for i, t in enumerate(raw) if not (i == len(raw) - 1 and t == "")}
    exp.update({("small.txt", 1): "a", ("small.txt", 2): "", ("small.txt", 3): "b"})
    assert got == exp


def test_read_corpus(spark, tmp_path):
    from parley.sources.corpus import read_corpus
    p = tmp_path / "m.txt"
    p.write_text("  hi\tthere \n\n\U0001F600 smile\r\nlast", encoding="utf-8")
    got = [(r["line_no"], r["text"]) for r in read_corpus(spark, str(p), emoji=True).orderBy("line_no").collect()]
    assert got == [(1, "hi there"), (3, "smile"), (4, "last")]


def test_write_samples(spark, tmp_path):
    df = spark.createDataFrame([("q1", [("a", 0.5, "t", None)])],
                               "query string, results array<struct<id:string,score:double,text:string,metadata:string>>")
    ex.write_samples(df, str(tmp_path / "l"), "jsonl")
    lines = [json.loads(x) for p in (tmp_path / "l").glob("part-*") for x in p.read_text().splitlines()]
    assert lines == [{"query": "q1", "results": [{"id": "a", "score": 0.5, "text": "t"}]}]
    ex.write_samples(df, str(tmp_path / "j"), " JSON ")
    doc = json.loads("".join(p.read_text() for p in sorted((tmp_path / "j").glob("part-*"))))
    assert isinstance(doc, list) and doc[0]["query"] == "q1"
    many = df.crossJoin(spark.range(500)).withColumn("query", F.concat("query", F.lit(" ],[\n"), "id")).drop("id").repartition(6)
    for rows_ in (many, many.limit(1), many.limit(0)):
        out = tmp_path / f"m{rows_.count()}"
        ex.write_samples(rows_, str(out), "json")
        doc = json.loads("".join(p.read_text() for p in sorted(out.glob("part-*"))))
        assert sorted(x["query"] for x in doc) == sorted(r["query"] for r in rows_.collect())
        assert json.loads((out / "_manifest.json").read_text())["rows"] == len(doc)
        back = ex.read_samples(spark, str(out), df._jdf.schema().toDDL(), "json")
        assert sorted(map(repr, back.collect())) == sorted(map(repr, rows_.collect()))
    assert len(list((tmp_path / "m500").glob("part-*"))) > 1
    with pytest.raises(ValueError):
        ex.write_samples(df, str(tmp_path / "x"), "csv")


def test_whatsapp_headers(spark):
    heads = ["1/2/24, 9:00 - ", "11/22/2024,  12:59 PM - ", "1/2/07, 9:00PM - ", "1/2/24,\t9:00 AM - "]
    lines, want = [], []
    for i, h in enumerate(heads * 50):
        lines.append(f"{h}P{i}: text {i}")
        want.append(f"text {i}")
        if i % 3 == 0:
            lines += ["", f"  more  {i} "]
            want[-1] += f" more {i}"
        if i % 7 == 0:
            lines += [f"{h}a notice without a sender", "its second line"]
    df = spark.createDataFrame([("x", i + 1, t) for i, t in enumerate(lines)], "source string, line_no long, text string").repartition(3)
    assert [r[0] for r in rows(ex.parse_whatsapp(df).orderBy("line_no"), "text")] == want


def test_telegram_text_forms(spark):
    cases = [("plain", "plain"), ("  a \n b ", "a b"), (["x ", {"type": "bold", "text": "y"}, " z"], "x y z"), ([{"type": "link"}, "k"], "k"),
             ("", None), ([], None), (None, None), ([7, "n"], "n")]
    msgs = [{"id": i, "type": "message", "text": t} for i, (t, _) in enumerate(cases)] + [{"id": 90, "type": "service", "text": "gone"}, "odd", 5]
    df = spark.createDataFrame([("d", json.dumps({"name": "c", "messages": msgs}))], "source string, json string")
    assert [r[0] for r in rows(ex.parse_telegram(df).orderBy("line_no"), "text")] == [w for _, w in cases if w is not None]


def _read_in_splits(spark, path, size, fn):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        return fn()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_telegram_file_in_many_splits_equals_the_whole_document(spark, tmp_path):
    r = random.Random(5)
    odd = ['}', '{', '"', '\\', '},{', '"messages": [', ']', '[', ',', ' \u00e9 ', '\n', '{"a":1}', 'x', '\\"', '😀', "\\}"]
    word = lambda: "".join(r.choice(odd + list("abc ")) for _ in range(r.randint(0, 12)))
    def message(i):
        text = r.choice([word(), [word(), {"type": "bold", "text": word()}, 3, None], {"no": [word()]}, None, 7])
        m = {"id": i, "type": r.choice(["message", "message", "service", None]), "date": word(), "from": word(), "text": text,
             "extra": {"messages": [{"text": word()}], "deep": [[{"x": word()}], []]}}
        return m if r.random() < 0.8 else {k: v for k, v in m.items() if r.random() < 0.7}
    entries = lambda n: [message(i) if r.random() < 0.8 else r.choice([word(), 5, None, True, [word(), {"text": "in a list"}], [], {}, [[], [1]]]) for i in range(n)]
    docs = {
        "plain": json.dumps({"name": word(), "type": "chat", "messages": entries(120)}),
        "spread": json.dumps({"about": {"messages": [1, {"text": "no"}]}, "list": [[{"messages": [{"text": "no"}]}]], "messages": entries(80),
                              "tail": {"x": [{"messages": [3]}]}, "end": ["messages", 1]}, indent=2, ensure_ascii=False),
        "empty": '{"messages": []}', "first": '{"messages":[{"text":"one"}]}\n', "strings": '{"messages": ["}", "{", {"text": "two }{ "}, "x"] }',
    }
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(doc, encoding="utf-8")
    want = ex.parse_telegram(ex.read_json_docs(spark, str(tmp_path)), True)
    want = sorted(tuple(x) for x in want.collect())
    for size in (97, 1000, 1 << 27):
        got = _read_in_splits(spark, tmp_path, size, lambda: sorted(tuple(x) for x in ex.read_export(spark, str(tmp_path), "tg", True).collect()))
        assert got == want and len(got) > 30
    pieces = _read_in_splits(spark, tmp_path, 1000, lambda: ex.read_text_files(spark, str(tmp_path), line_sep="}").rdd.getNumPartitions())
    assert pieces > 20


def test_telegram_file_with_a_broken_message(spark, tmp_path):
    p = tmp_path / "bad.json"
    p.write_text('{"messages": [{"text": "ok"}, {"text": nonsense}]}', encoding="utf-8")
    with pytest.raises(Exception, match="MALFORMED"):
        ex.read_export(spark, str(p), "telegram").collect()


def test_dropped_island_leaves_before_the_gather(spark):
    """A notice followed by very many lines: they never reach the aggregate."""
    n = 300_000
    lines = spark.range(n).select(F.lit("x").alias("source"), (F.col("id") + 3).alias("line_no"), F.concat(F.lit("line "), "id").alias("text"))
    head = spark.createDataFrame([("x", 1, "1/2/24, 9:00 - A: first"), ("x", 2, "1/2/24, 9:01 - a notice"), ("x", n + 5, "1/2/24, 9:02 - B: last")],
                                 "source string, line_no long, text string")
    out = ex.parse_whatsapp(head.unionByName(lines).repartition(6))
    assert sorted(tuple(r) for r in out.collect()) == [("x", 1, "first"), ("x", n + 5, "last")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("collect_list"):]
    assert ".opens" in below[:below.index("Window")]      # the condition stands between the gather and the windows
