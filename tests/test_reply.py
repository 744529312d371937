import json

import pytest
from pyspark.sql import functions as F

from parley.operators import reply as rp


def _corpus(spark):
    lines = ["how are you", "fine thanks", "you: what now", "User: nothing much", "how are you", "how are you"]
    return spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(lines)], "source string, line_no long, text string")


def _hits(spark, items):
    return spark.createDataFrame(
        [(q, r, f"id{r}", t, s, (line, "f") if line is not None else None) for q, r, t, s, line in items],
        "query_id string, rank int, id string, text string, score double, metadata struct<line:long,source:string>")


def _q(spark):
    return spark.createDataFrame([("q", "hello")], "query_id string, query string")


def test_templates(spark):
    q = _q(spark)
    assert rp.build_prompt(q, None, None, "min").first()["prompt"] == "USER: hello\nYOU: "
    assert rp.build_prompt(q, None, None, "conversation").first()["prompt"] == \
        "This is a chat. Reply as YOU. Keep it short.\n\nUSER: hello\nYOU: "
    with pytest.raises(ValueError):
        rp.build_prompt(q, None, None, "fancy")
    empty = _hits(spark, [])
    assert rp.build_prompt(q, empty, _corpus(spark), "few-shot").first()["prompt"] == "USER: hello\nYOU: "


def test_fewshot_uses_next_messages(spark):
    hits = _hits(spark, [("q", 1, "how are you", 0.9, 1), ("q", 2, "x", 0.8, None), ("q", 3, "you: what now", 0.7, 3),
                         ("q", 4, "tail", 0.6, 6)])
    p = rp.build_prompt(_q(spark), hits, _corpus(spark), "fewshot").first()["prompt"]
    assert p == "USER: how are you\nYOU: fine thanks\n\nUSER: what now\nYOU: nothing much\n\nUSER: hello\nYOU: "


def test_corpus_reply_rules(spark):
    corpus = _corpus(spark)
    hits = _hits(spark, [("q", 1, "how are you", 0.5, 1), ("q", 2, "fine thanks", 0.9, 4),
                         ("q", 3, "how are you", 0.9, 5), ("q", 4, "low", 0.1, 1)])
    r = rp.corpus_reply(hits, corpus, "hybrid", 0.35).collect()
    # rank 2: next of line 4 is "how are you" (score .9); rank 3: next of line 5 is an echo
    assert [(x["reply"], x["reply_score"]) for x in r] == [("how are you", 0.9)]
    low = _hits(spark, [("q", 1, "a", 0.1, 1)])
    assert rp.corpus_reply(low, corpus, "hybrid", 0.35).count() == 0
    assert rp.corpus_reply(low, corpus, "corpus", 0.35).first()["reply"] == "fine thanks"
    with pytest.raises(ValueError):
        rp.corpus_reply(low, corpus, "random")


def test_turns_and_events(spark):
    corpus = _corpus(spark)
    hits = _hits(spark, [("q", 1, "how are you", 0.9, 1)])
    t = rp.turns(_q(spark), hits, corpus, "hybrid", "few-shot").first()
    assert (t["used_strategy"], t["answer"], t["prompt"]) == ("corpus", "fine thanks", None)
    g = rp.turns(_q(spark), hits, corpus, "generate", "minimal",
                 generator=lambda p: F.lit("You: sure thing\nUSER: more")).first()
    assert (g["used_strategy"], g["answer"], g["prompt"]) == ("generate", "sure thing", "USER: hello\nYOU: ")
    c = rp.turns(_q(spark), _hits(spark, []), corpus, "corpus", "minimal").first()
    assert (c["used_strategy"], c["answer"]) == ("corpus", "")
    ev = json.loads(rp.turn_events(rp.turns(_q(spark), hits, corpus)).first()["value"])
    assert ev["type"] == "turn" and ev["retrieved"][0]["text"] == "how are you" and ev["answer"] == "fine thanks"


def test_replies_come_from_the_line_after_a_hit(spark):
    import random
    rnd = random.Random(5)
    lines = {i: f"line {i} says {rnd.choice('pqrst')}" for i in range(1, 41)}
    corpus = spark.createDataFrame([("f", ln, t) for ln, t in lines.items()], "source string, line_no long, text string")
    hits, best = [], {}
    for q in range(25):
        scores = rnd.sample(range(40, 99), 6)
        for r, (line, score) in enumerate(zip(rnd.sample(range(1, 41), 6), scores)):
            hits.append((f"q{q}", r + 1, f"id{q}-{r}", lines[line], score / 100, (line, "f")))
            if line < 40 and score > best.get(f"q{q}", (0, None))[0]:
                best[f"q{q}"] = (score, line + 1)
    hdf = spark.createDataFrame(hits, "query_id string, rank int, id string, text string, score double, "
                                      "metadata struct<line:long,source:string>")
    got = {r["query_id"]: (r["reply"], r["reply_score"]) for r in rp.corpus_reply(hdf, corpus).collect()}
    assert got == {q: (lines[line], score / 100) for q, (score, line) in best.items()}
    qdf = spark.createDataFrame([(f"q{q}", f"question {q}") for q in range(25)], "query_id string, query string")
    for r in rp.build_prompt(qdf, hdf, corpus, "few-shot").collect():
        blocks = r["prompt"].split("\n\n")
        assert blocks[-1] == f"USER: question {r['query_id'][1:]}\nYOU: "
        for block in blocks[:-1]:
            user, you = block.split("\n")
            ln = int(user.split()[2])
            assert user == f"USER: {lines[ln]}" and you == f"YOU: {lines[ln + 1]}"


def test_texts_are_cleaned_once(spark):
    corpus = _corpus(spark)
    hits = _hits(spark, [("q", 1, "you: how are you", 0.9, 1), ("q", 2, "x", 0.8, None), ("q", 3, "tail", 0.6, 6)])
    said = rp._said(hits, corpus)
    assert [tuple(r) for r in said.orderBy("rank").collect()] == [("q", 1, 0.9, "how are you", "fine thanks"), ("q", 3, 0.6, "tail", None)]
    assert [tuple(r) for r in rp._said_of(rp.next_message(hits, corpus)).collect()] == [("q", 1, 0.9, "how are you", "fine thanks")]
    for df in (rp.corpus_reply(hits, corpus, "corpus"), rp.build_prompt(_q(spark), hits, corpus)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        # the cut at " user:" stands once in the cleaning of a text, and there are two texts
        assert plan.count("(?is) user:") == 2, plan
