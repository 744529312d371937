import math

import pytest
from pyspark.sql import functions as F

from parley.operators import lm


def _raw(spark, texts, source="f"):
    return spark.createDataFrame([(source, i + 1, t) for i, t in enumerate(texts)], "source string, line_no long, text string")


def test_vocab_codecs(spark):
    s = lm.stream_lines(_raw(spark, ["ba", "é\tc"]))
    v = lm.build_vocab(s)
    chars = lm.vocab_list(v)
    assert chars == sorted(set("ba\né\tc\n"))
    e = s.select("line_no", "text", lm.encode_chars("text", chars).alias("ids"))
    for r in e.collect():
        assert [chars[i] for i in r["ids"]] == list(r["text"])
    d = e.select("text", lm.decode_ids("ids", chars).alias("back")).collect()
    assert all(r["text"] == r["back"] for r in d)
    small = ["a", "\n"]
    x = s.select(lm.encode_chars("text", small).alias("drop"), lm.encode_chars("text", small, "zero").alias("zero"),
                 lm.oov_count("text", small).alias("oov")).orderBy(F.size("drop")).collect()
    assert [list(r["drop"]) for r in x] == [[1], [1, 0]] or [list(r["drop"]) for r in x] == [[1], [0, 1]]
    assert sum(r["oov"] for r in x) == 4
    seed = spark.createDataFrame([("zzz",), ("ab",)], "p string").select(lm.prompt_seed("p", ["\n", "a"]).alias("s")).collect()
    assert [list(r["s"]) for r in seed] == [[0], [1]]
    assert lm.vocab_list(lm.build_vocab(_raw(spark, [""]).filter("false"))) == ["\n"]


def test_fit_seq_len_and_split(spark):
    assert lm.fit_seq_len(1000, 256) == (125, True)
    assert lm.fit_seq_len(10, 256) == (16, True)
    assert lm.fit_seq_len(10**6, 256) == (256, False)
    s, total = lm.with_offsets(lm.stream_lines(_raw(spark, ["x" * 99, "y" * 99, "z" * 99])))
    assert total == 300
    out, val = lm.tail_split(s, total, 0.9, 8)           # clamped to 0.5
    assert val == 150
    got = {r["line_no"]: (r["train_chars"], r["val_chars"]) for r in out.collect()}
    assert got == {1: (100, 0), 2: (50, 50), 3: (0, 100)}
    _o, val0 = lm.tail_split(s, total, 0.01, 8)
    assert val0 == 0


def test_pairs_corpus(spark):
    p = lm.pairs_corpus(_raw(spark, ["a", " ", "b", "c"]).unionByName(_raw(spark, ["solo"], "g")))
    got = sorted((r["source"], r["line_no"], r["block"]) for r in p.collect())
    assert got == [("f", 1, "USER: a\nYOU: b\n\n"), ("f", 3, "USER: b\nYOU: c\n\n"), ("g", 1, "USER: \nYOU: \n")]


def _stream_ids(spark, texts):
    s = lm.stream_lines(_raw(spark, texts))
    chars = lm.vocab_list(lm.build_vocab(s))
    ids, _n = lm.with_offsets(s.select("source", "line_no", lm.encode_chars("text", chars).alias("ids")), length_col="ids")
    flat = [chars.index(c) for c in "".join(t + "\n" for t in texts)]
    assert _n == len(flat)
    return ids, flat


def test_pack_and_sample_sequences(spark):
    texts = ["abcdefghij" * 3, "", "klmno", "pqrstuvwxyz" * 2]
    ids, flat = _stream_ids(spark, texts)
    total = len(flat)
    packed = {r["seq_id"]: (list(r["x"]), list(r["y"])) for r in lm.pack_sequences(ids, total, 7).collect()}
    n = (total - 1) // 7
    assert len(packed) == n
    for j in range(n):
        assert packed[j] == (flat[7 * j:7 * j + 7], flat[7 * j + 1:7 * j + 8])
    sampled = lm.sample_sequences(ids, total, 30, 5, seed=3).collect()
    assert len(sampled) == 30
    windows = {tuple(flat[i:i + 6]) for i in range(total - 6)}
    for r in sampled:
        assert tuple(list(r["x"]) + [r["y"][-1]]) in windows and list(r["x"][1:]) == list(r["y"][:-1])
    with pytest.raises(ValueError):
        lm.sample_sequences(ids, 5, 3, 10)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_heldout_eval_matches_python(spark, order):
    texts = ["the cat sat on the mat", "the dog sat", "a cat ran", "the end q!"]
    s, total = lm.with_offsets(lm.stream_lines(_raw(spark, texts)))
    r = lm.heldout_eval(s, total, order=order, alpha=0.5, heldout_fraction=0.3, seq_len=8).first()
    # brute force
    k = order - 1
    lines = [t + "\n" for t in texts]
    rows, off = [], 0
    for t in lines:
        pad = "\n" * k + t
        for i, c in enumerate(t):
            rows.append((off + i, pad[i:i + k], c))
        off += len(t)
    held = int(total * 0.3)
    b = total - held
    vocab = sorted({c for p, _, c in rows if p < b})
    oov = sum(1 for _, _, c in rows if c not in vocab)
    fix = lambda s_: "".join(ch if ch in vocab else vocab[0] for ch in s_)
    rows = [(p, fix(x), fix(c)) for p, x, c in rows]
    cc, cx = {}, {}
    for p, x, c in rows:
        if p < b:
            cc[(x, c)] = cc.get((x, c), 0) + 1
            cx[x] = cx.get(x, 0) + 1
    losses = [-math.log((cc.get((x, c), 0) + 0.5) / (cx.get(x, 0) + 0.5 * len(vocab))) for p, x, c in rows if p >= b]
    loss = sum(losses) / len(losses)
    assert r["heldout_chars"] == held and r["oov_chars"] == oov
    assert abs(r["loss"] - loss) < 1e-9 and abs(r["perplexity"] - math.exp(loss)) < 1e-6
    with pytest.raises(ValueError):
        lm.heldout_eval(s, total, heldout_fraction=0.01, seq_len=256)


def test_perplexity_edges(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (1000.0,), (float("inf"),)], "l double")
    got = [r[0] for r in df.select(lm.perplexity("l")).collect()]
    assert abs(got[0] - math.e) < 1e-12 and math.isnan(got[1]) and got[2] == float("inf") and math.isnan(got[3])


def test_pairs_corpus_random(spark):
    import random
    rnd = random.Random(3)
    sources = {f"s{i}": [rnd.choice(["a", " b ", "", "  ", "c d", "\t", "e"]) for _ in range(rnd.randint(0, 9))]
               for i in range(15)}
    df = spark.createDataFrame([(s, i + 1, t) for s, ls in sources.items() for i, t in enumerate(ls)],
                               "source string, line_no long, text string").repartition(3)
    got = {}
    for r in lm.pairs_corpus(df).collect():
        got.setdefault(r["source"], []).append((r["line_no"], r["block"]))
    for s, ls in sources.items():
        lines = [x.strip() for x in ls if x.strip()]
        if not lines:
            exp = ""
        elif len(lines) < 2:
            exp = "USER: \nYOU: \n"
        else:
            exp = "".join(f"USER: {lines[i]}\nYOU: {lines[i + 1]}\n\n" for i in range(len(lines) - 1))
        assert "".join(b for _, b in sorted(got.get(s, []))) == exp, s


def test_batches_are_worked_on_in_slices(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from parley.operators import lm, profile
    seen, inner = [], lm._codepoints

    def watched(texts):
        out = inner(texts)
        seen.append(len(out[0]))
        return out

    monkeypatch.setattr(lm, "_codepoints", watched)
    monkeypatch.setattr(lm, "SLICE_CHARS", 100)
    texts = [None, "", "a" * 250, *["abcé" * 5] * 40, None]
    chars = tuple("abc")
    got = lm._sliced(pa.array(texts), lambda t: lm._encode_batch(t, chars, False), pa.list_(pa.int32())).to_pylist()
    assert got == [None if t is None else ["abc".index(c) for c in t if c in "abc"] for t in texts]
    assert max(seen) == 250 and sorted(seen)[-2] <= 100
    seen.clear()
    rb = pa.RecordBatch.from_pydict({"source": [1] * len(texts), "line_no": list(range(len(texts))), "text": pa.array(texts)})
    out = pa.Table.from_batches(profile._char_kernel(pa.int64())([rb])).to_pandas()
    assert out.groupby("item").n.sum().to_dict() == {"a": 450, "b": 200, "c": 200, "é": 200}
    assert max(seen) == 250 and sorted(seen)[-2] <= 100 and np.sum(seen) == 1050


def test_packed_sequences_shuffle_the_ids_once(spark):
    from parley.operators import lm
    ids = list(range(1000))
    cuts = [0, 1, 1, 5, 130, 131, 400, 1000]
    lines = spark.createDataFrame([(a, ids[a:z]) for a, z in zip(cuts, cuts[1:])], "offset long, ids array<int>").repartition(3)
    out = lm.pack_sequences(lines, 1000, 16)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0      # no blocks joined to sequences
    got = {r["seq_id"]: (r["x"], r["y"]) for r in out.collect()}
    assert got == {s: (ids[16 * s:16 * s + 16], ids[16 * s + 1:16 * s + 17]) for s in range(62)}
    assert lm.pack_sequences(lines, 1, 16).count() == 0
