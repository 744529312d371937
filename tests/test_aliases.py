import pytest

from parley.operators import chunk as ch
from parley.operators import reply as rp
from parley.sources import corpus as C
from parley.sources import exports as ex
from conftest import rows


def test_format_aliases():
    assert [ex.export_format(f) for f in ("plain", " TXT", "lines")] == ["plain"] * 3
    assert [ex.export_format(f) for f in ("whatsapp", "WA")] == ["whatsapp"] * 2
    assert [ex.export_format(f) for f in ("telegram", "telegram-json", "telegram_json", "TG")] == ["telegram"] * 4
    with pytest.raises(ex.ParseError):
        ex.export_format("")


def test_chunk_template_strategy_aliases():
    assert [ch.chunk_mode(m) for m in ("message", "per-message", "per_message", "LINE", None)] == ["message"] * 5
    assert [ch.chunk_mode(m) for m in ("window", "sliding", "sliding-window", "sliding_window")] == ["window"] * 4
    assert [rp.template_name(t) for t in ("min", "minimal")] == ["minimal"] * 2
    assert [rp.template_name(t) for t in ("scaffold", "conversation-scaffold", "conversation")] == ["scaffold"] * 3
    assert [rp.template_name(t) for t in ("few-shot", "fewshot", "retrieval-few-shot", None)] == ["few-shot"] * 4
    assert [rp.strategy_name(s) for s in (" Hybrid", "generate", "corpus")] == ["hybrid", "generate", "corpus"]
    with pytest.raises(ValueError):
        rp.strategy_name("auto")


def test_corpus_from_table(spark):
    df = spark.createDataFrame([(7, 0, "a\r\n\nb"), (7, 1, "c")], "cid long, turn long, body string")
    assert rows(C.corpus_from_table(df, "cid", "turn", "body", line_offset=1).orderBy("line_no")) == \
        [(7, 1, "a\r\n\nb"), (7, 2, "c")]
    split = C.corpus_from_table(df.filter("turn = 0"), "cid", "turn", "body", split_lines=True).orderBy("line_no")
    assert rows(split) == [(7, 1, "a"), (7, 2, ""), (7, 3, "b")]


def test_invalid_telegram_json(spark, tmp_path):
    p = tmp_path / "bad.json"
    p.write_text("{not json", encoding="utf-8")
    with pytest.raises(ex.ParseError):
        ex.read_export(spark, str(p), "telegram")
