import json
import random

import pytest
from brute import DOC, awkward, fingerprint, frame, hits, least_reachable, secrets
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm import decontaminate, langid, mixture, quality_model, simhash_balls
from parley.llm.trees import Leaf, path_condition, tree_value

ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def prose(r, n, words=None):
    words = words or [f"{a}{b}" for a in ("ka", "lo", "mi", "su", "te") for b in ("r", "tt", "n", "se", "va")]
    return " ".join(r.choice(words) for _ in range(n))


def near_copies(seed=2):
    r = random.Random(seed)
    texts = []
    for _ in range(12):
        base = prose(r, 160).split()
        for _ in range(r.randint(1, 5)):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = r.choice(["zz", "qq", "Ka"])
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("blocks", [2, 1])
def test_simhash_against_all_pairs(spark, blocks):
    docs = [d for d in awkward(near_copies()) if d[0] is not None]
    got = simhash_balls.near_duplicates(frame(spark, docs), blocks=blocks).collect()
    prints = {d[0]: fingerprint(d[1]) for d in docs}
    least = least_reachable(prints)
    assert len(got) == len(docs) and len(set(least.values())) < len(least) - 8
    assert all(r["fp"] % (1 << 64) == prints[r["doc_id"]] and r["component_id"] == least[r["doc_id"]] for r in got)


def test_links_of_crowded_fingerprints(spark):
    r = random.Random(3)
    centre = r.getrandbits(64)
    fps = {centre}
    for _ in range(250):
        x = centre
        for _ in range(r.randint(0, 5)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    fps |= {centre ^ (r.getrandbits(32) << 32) for _ in range(60)}     # the same half, far apart
    want = least_reachable({simhash_balls._signed(x): x for x in fps})
    df = spark.createDataFrame([(simhash_balls._signed(x),) for x in fps], "fp bigint")
    for crowd in (1024, 8):
        got = {r["node"]: r["root"] for r in simhash_balls.components(simhash_balls.links(df, crowd=crowd)).collect()}
        assert all(got.get(x, x) == want[x] for x in want)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (200, 200)]
    got = {r["node"]: r["root"] for r in simhash_balls.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 95: 90, 90: 90}


def test_simhash_empty_table_and_nulls(spark):
    assert simhash_balls.near_duplicates(frame(spark, [])).count() == 0
    docs = frame(spark, awkward())
    marked = simhash_balls.near_duplicates(docs)
    blank = [r for r in marked.collect() if r["fp"] == 0]
    assert {r["doc_id"] for r in blank} == {0, 1, 2} and {r["component_id"] for r in blank} == {0}
    kept = simhash_balls.keep_first(docs, marked)
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and kept.columns == docs.columns
    assert sorted(i for i in ids if i is not None) == sorted({r["component_id"] for r in marked.collect() if r["component_id"] is not None})


def test_keep_first_judges_rows(spark):
    r = random.Random(12)
    base = [prose(r, 160) for _ in range(9)]
    like = lambda t: t.replace(" ", "  ")     # another text with the same fingerprint
    rows = [(5, base[0]), (None, like(base[0])), (None, base[1]), (None, base[2]), (None, like(base[2])),
            (7, base[3]), (9, like(base[3])), (12, base[3]), (3, base[4]), (7, like(base[4])),
            (20, base[5]), (20, base[6]), (30, base[7]), (30, base[7]), (30, like(base[7])), (31, base[8]), (31, base[8])]
    docs = [(i, t, "en", "s", 0) for i, t in rows]
    df = frame(spark, docs)
    kept = simhash_balls.keep_first(df, simhash_balls.near_duplicates(df))
    got = sorted((x["doc_id"] is None, x["doc_id"] or 0, fingerprint(x["text"])) for x in kept.collect())
    prints = dict(enumerate(fingerprint(t) for _, t in rows))
    groups: dict[int, list] = {}
    for n, root in least_reachable(prints).items():
        groups.setdefault(root, []).append((rows[n][0] is None, rows[n][0] or 0, prints[n]))
    assert len(groups) == 9 and got == sorted(min(g) for g in groups.values()) and kept.columns == df.columns


def bench_items(r):
    items = [(i, prose(r, n)) for i, n in enumerate((15, 30, 10, 9, 4, 1, 12, 60))]
    return [*items, (20, None), (21, "  ..."), (22, items[0][1].upper()), (None, "unnamed item " + items[1][1]), (1, items[6][1])]


@pytest.mark.parametrize("short", [True, False])
def test_decontamination_against_all_windows(spark, short):
    r = random.Random(8)
    items = [i for i in bench_items(r) if short or len((i[1] or "").split()) >= 10]
    texts = [f"{prose(r, r.randint(0, 40))} {t[1] or ''}, {prose(r, 12)}" for t in items for _ in range(2)]
    texts += [" ".join(items[0][1].split()[:11]) + " xx " + " ".join(items[0][1].split()[3:13]), (items[1][1] + " ") * 40, "ka " * 400,
              ", ".join(items[0][1].title().split())]
    docs = awkward(texts)
    got = decontaminate.find_hits(frame(spark, docs), spark.createDataFrame(items, ITEMS).withColumn("words", F.lit(1))).collect()
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in got)
    want = []
    for d in docs:
        n, covered, ids = hits(d[1], items)
        ids = [i for i in ids if i != "None"]
        want.append((d[0] is None, d[0] or 0, n, covered, ids, covered > 0))
    assert found == sorted(want) and any(x[3] for x in found)


def test_decontamination_of_empty_tables(spark):
    docs = frame(spark, awkward())
    none = spark.createDataFrame([], ITEMS)
    assert decontaminate.find_hits(docs, none).filter("contaminated").count() == 0
    assert decontaminate.find_hits(frame(spark, []), spark.createDataFrame(bench_items(random.Random(1)), ITEMS)).count() == 0


def test_mixture_targets(spark):
    sizes = spark.createDataFrame([("b", 1000), ("a", 10), (None, 600), ("c", 0), ("d", 5000)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixture.source_targets(sizes).collect()}
    # weights: a 5, b 2, c 1, d 5, null 2; a and c stop at three times their size
    level = (6610 - 30) / (2 + 5 + 2)
    assert got["a"] == 30 and got["c"] == 0
    assert got["b"] == pytest.approx(2 * level) and got["d"] == pytest.approx(5 * level) and got[None] == pytest.approx(2 * level)


def test_mixture_targets_of_many_sources(spark):
    r = random.Random(11)
    rows = [(None if i == 5 else f"s{i}", r.choice([0, 1, 3, 50, 4000])) for i in range(700)]
    sizes = spark.createDataFrame(rows, "source string, source_size long").repartition(7)
    got = {x["source"]: x["target"] for x in mixture.source_targets(sizes).collect()}
    names = sorted((s for s, _ in rows if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    size = dict(rows)
    total, full = sum(size.values()), set()
    while True:    # raise the level until no further source stops at three times its size
        level = (total - sum(3 * size[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and 3 * size[s] < weight[s] * level}
        if not more:
            break
        full |= more
    assert len(got) == len(rows)
    assert all(got[s] == pytest.approx(min(3 * size[s], weight[s] * level)) for s in names)
    assert sum(got.values()) == pytest.approx(total)


def test_mixture_by_weights(spark):
    r = random.Random(8)
    docs = [(i, prose(r, r.choice([20, 40, 80])), None, f"s{i % 3}", int(r.paretovariate(0.5))) for i in range(1500)]
    docs += [(None, f"text {i} without an id", None, "s1", 3) for i in range(60)] + [(9000, "a b", None, "s1", None)]
    df = frame(spark, docs)
    rows = mixture.mix(df, weight=F.col("n_chars")).collect()
    weight = {d[0]: d[4] for d in docs}
    taken, target, largest = {}, {}, {}
    for x in rows:
        assert 0 <= x["copies"] <= 3
        taken[x["source"]] = taken.get(x["source"], 0) + x["taken"]
        target[x["source"]] = x["target"]
        largest[x["source"]] = max(largest.get(x["source"], 0), x["size"])
    # heavy weights stop at three copies; the others get what these leave
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in target)
    assert next(x["copies"] for x in rows if x["doc_id"] == 9000) == 0
    for s in target:
        by = [(weight[x["doc_id"]], x["copies"]) for x in rows if x["source"] == s and x["doc_id"] is not None and x["size"] > 2]
        heavy, light = [c for w, c in by if w >= 50], [c for w, c in by if w <= 2]
        assert sum(heavy) / len(heavy) > sum(light) / len(light)
    # rows without an id are drawn one by one
    assert len({x["copies"] for x in rows if x["doc_id"] is None}) > 1


def test_mixture(spark, monkeypatch):
    r = random.Random(4)
    docs = [(i, prose(r, r.choice([0, 5, 40, 80])), None, None if i % 9 == 0 else f"s{min(i % 7, 3)}", 0) for i in range(900)]
    docs += [(3, docs[3][1], None, "s3", 0), (None, "no id", None, "s1", 0), (950, None, None, "s2", 0)]
    df = frame(spark, docs)
    first = sorted(map(str, mixture.mix(df).collect()))
    monkeypatch.setattr(mixture, "BROADCAST_SOURCES", 0)       # the salted way
    rows = mixture.mix(df.repartition(5)).collect()
    assert sorted(map(str, rows)) == first and len(rows) == len(docs)
    taken, target, largest = {}, {}, {}
    for x in rows:
        assert 0 <= x["taken"] <= 3 * x["size"] and x["taken"] == x["size"] * x["copies"]
        taken[x["source"]] = taken.get(x["source"], 0) + x["taken"]
        target[x["source"]] = x["target"]
        largest[x["source"]] = max(largest.get(x["source"], 0), x["size"])
    for s in target:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1
    assert mixture.mix(frame(spark, [])).count() == 0
    assert mixture.mix(frame(spark, [(1, "", None, None, 0)])).first()["taken"] == 0


def test_trees_compile(spark):
    leaves = [Leaf(((0, True, 1.0), (1, True, 2.0)), 10.0), Leaf(((0, True, 1.0), (1, False, 2.0)), 20.0), Leaf(((0, False, 1.0),), 30.0)]
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 3.0), (2.0, 0.0)], "a double, b double")
    assert [r[0] for r in df.select(tree_value(leaves, [F.col("a"), F.col("b")])).collect()] == [10.0, 20.0, 30.0]
    cond = path_condition(((0, True, 1.0), (0, True, 5.0), (1, False, 2.0)), [F.col("a"), F.col("b")])
    assert [r[0] for r in df.select(cond).collect()] == [False, True, False]


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_model.fit(docs, labels.filter(~quality_model.held_out()))
    got = quality_model.score(docs, model, ["doc_id"]).join(labels.filter(quality_model.held_out()), "doc_id").collect()
    assert auc([(r["score"], r["quality"]) for r in got]) > 0.95
    assert sum(r["predicted"] for r in got if r["quality"]) >= 0.97 * sum(r["quality"] for r in got)
    # scores of awkward rows exist, and scores look at the text alone
    odd = frame(spark, awkward())
    scores = [r["score"] for r in quality_model.score(odd, model, ["doc_id"]).collect()]
    assert len(scores) == len(awkward()) and all(0 <= s <= 1 for s in scores)
    assert model.describe()


def test_quality_without_usable_labels(spark):
    docs = frame(spark, awkward())
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality_model.score(docs, quality_model.fit(docs, none), ["doc_id"]).collect()} == {0.5}
    one = spark.createDataFrame([(3, 1), (4, 1), (5, None)], "doc_id long, quality int")
    scores = {r["score"] for r in quality_model.score(docs, quality_model.fit(docs, one), ["doc_id"]).collect()}
    assert len(scores) == 1 and scores.pop() > 0.5
    assert quality_model.score(frame(spark, []), quality_model.fit(frame(spark, []), none), ["doc_id"]).count() == 0


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, logp = langid.learn(docs.filter(~langid.held_out()))
    got = langid.predict_languages(docs.filter(langid.held_out()), langs, logp).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.98 * len(got)
    odd = langid.predict_languages(frame(spark, awkward()), langs, logp).collect()
    assert len(odd) == len(awkward()) and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["lang_pred"] for r in odd if r["doc_id"] in (0, 1, 2)} == {"und"}
    two = {r["lang"]: max((x["text"] for x in docs.filter("length(text) between 900 and 1500").filter(F.col("lang") == r["lang"]).limit(3).collect()))
           for r in docs.select("lang").distinct().filter("lang in ('en', 'de')").collect()}
    both = langid.predict_languages(frame(spark, [(1, two["en"] + " " + two["de"], None, None, 0)]), langs, logp).first()
    assert {x.split(":")[0] for x in both["languages"].split(",")} == {"en", "de"}
    assert [r["lang_pred"] for r in langid.predict_languages(frame(spark, awkward()), *langid.learn(frame(spark, []))).collect()] == ["und"] * len(awkward())


def test_pipeline_on_a_small_table(spark, tmp_path):
    import corpus_pipeline
    r = random.Random(12)
    items = [(i, prose(r, 20)) for i in range(6)]
    copies = near_copies(5)
    texts = [*copies, *(f"{prose(r, 60)} {t} {prose(r, 30)}" for _, t in items), *(f"{prose(r, 50)} password = hunter{i}22 {prose(r, 50)}" for i in range(8))]
    good = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    junk = [(500 + i, " | ".join(prose(r, 120).split()), "en", "s0", 0) for i in range(60)]
    plain = [(800 + i, prose(r, 120) + ".", "en", "s1", 0) for i in range(150)]
    rows = [*good, *junk, *plain]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(d[0], 0 if 500 <= d[0] < 800 else 1, 0) for d in rows if d[0] >= 500], "doc_id long, quality int, toxic int") \
        .write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)), f"test-{name}")
        seen.append({r["doc_id"]: r for r in out.collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and len(seen[-1]) == out.count()
        docs = out
    quality, near, bench, clean, mixed = seen
    assert set(quality) == {d[0] for d in [*good, *plain]}
    least = least_reachable({i: fingerprint(d["text"]) for i, d in quality.items()})
    assert set(near) == set(least.values()) and len(near) < len(quality)
    assert set(bench) == {i for i, d in near.items() if not hits(d["text"], items)[1]}
    assert set(clean) == set(bench)
    for i, d in clean.items():
        before = bench[i]["text"]
        spans = secrets(before)
        assert (d["text"] == before) == (not spans) and not secrets(d["text"]) and d["n_chars"] == len(d["text"])
    assert set(mixed) <= set(clean) and all(r["copies"] in (1, 2, 3) for r in mixed.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dups", "benchmark", "secrets", "mixture"]
    assert json.dumps(sorted(mixed)) == json.dumps(sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()))


def test_pipeline_defined_cases(spark, tmp_path):
    """Null and empty texts, null and repeated ids, equal rows, clashing columns, empty tables."""
    import corpus_pipeline
    r = random.Random(21)
    rows = awkward([prose(r, 60) for _ in range(6)])
    rows += [(50, prose(r, 70), None, None, None), (50, prose(r, 70), None, None, None)]          # one id, two texts
    for name, docs in (("some", rows), ("none", [])):
        folder = tmp_path / name
        frame(spark, docs).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame(bench_items(r), ITEMS).write.parquet(str(folder / "benchmark.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        got = spark.read.parquet(str(folder / "documents.parquet"))
        columns, kept = got.columns, []
        for stage, fn in corpus_pipeline.STAGES:
            got = corpus_pipeline.materialise(fn(spark, got, str(folder)), f"cases-{stage}")
            kept.append([x.asDict() for x in got.collect()])
            assert stage == "mixture" or got.columns == columns
        if not docs:
            assert all(k == [] for k in kept)
            continue
        quality, near = kept[0], kept[1]
        assert sorted(map(str, quality)) == sorted(map(str, (x.asDict() for x in frame(spark, rows).collect())))
        # one row of each group of linked fingerprints: the blank texts, the two long ones, the repeats
        prints = dict(enumerate(fingerprint(x["text"]) for x in quality))
        assert sorted(fingerprint(x["text"]) for x in near) == sorted({prints[i] for i in set(least_reachable(prints).values())}) or \
            len(near) == len(set(least_reachable(prints).values()))
        assert sum(x["doc_id"] == 50 for x in near) == 2 and sum(x["text"] is None or not x["text"].strip() for x in near) == 1
        assert len(kept[3]) == len(kept[2]) <= len(near) and sorted(x["doc_id"] or -1 for x in kept[4]) == sorted(
            x["doc_id"] or -1 for x in kept[4] if x["copies"] > 0)


def test_rules_are_walked_as_written(spark):
    """Scores against a plain walk of the rules over plain statistics."""
    import math
    import re
    space = re.compile(r"[^\x20\x09-\x0D]+")

    def statistics(t):
        t = t or ""
        words, lines = space.findall(t), t.split("\n")
        n, c = max(len(words), 1), max(len(t) - sum(ch in " \t\n\x0b\x0c\r" for ch in t), 1)
        many = lambda chars: sum(ch in chars for ch in t)
        return [math.log(n), c / n, math.log1p(len(set(words))) / math.log1p(n), n / len(lines), len(set(lines)) / len(lines),
                many("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / c, many("0123456789") / c, many("#*$%&^~=_\\@") / c, many("|") / n, many("!?") / n,
                many(".,;:") / n, many("<>{}[]()") / c]

    r = random.Random(17)
    docs = awkward(["".join(r.choice("aB1 |!.,(#\n") for _ in range(r.randint(1, 90))) for _ in range(60)])
    plain = [statistics(d[1]) for d in docs]
    paths = []
    for _ in range(25):
        path = []
        for _ in range(r.randint(1, 4)):
            f = r.randrange(len(quality_model.STATISTICS))
            path.append((f, r.random() < 0.5, r.choice(plain)[f] + 1e-7))
        paths.append(tuple(path))
    weights = [r.uniform(-2, 2) for _ in paths]
    got = quality_model.score(frame(spark, docs), quality_model.RuleModel(0.3, tuple(weights), tuple(paths)), ["doc_id"])
    want = []
    for d, x in zip(docs, plain):
        margin = 0.3 + sum(w for w, p in zip(weights, paths) if all(x[f] <= t if low else x[f] > t for f, low, t in p))
        score = 1 / (1 + math.exp(-margin))
        want.append((d[0] is None, d[0] or 0, round(score, 9), int(score >= 0.3)))
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0, round(x["score"], 9), x["predicted"]) for x in got.collect()) == sorted(want)


def test_mixtures_against_plain_em():
    """Proportions, likelihood and the penalised choice against loops over words."""
    import math

    import numpy as np
    r = random.Random(23)
    langs = ["aa", "bb", "cc"]
    words = [f"{x}{y}" for x in ("ban", "tor", "quil", "mes") for y in ("a", "el", "ix")]
    logp = np.log(np.random.default_rng(5).dirichlet(np.ones(langid.BUCKETS) * 0.05, 3).T + 1e-9)
    model = langid.MixtureModel(langs, logp)
    like = {w: [sum(logp[b][k] for b in langid.trigram_buckets([w])[0]) for k in range(3)] for w in words}

    def em(text, allowed):
        share = [1 / len(allowed) if k in allowed else 0.0 for k in range(3)]
        for _ in range(langid.MAX_ROUNDS):
            new = [0.0] * 3
            for w in text:
                p = [share[k] * math.exp(like[w][k] - max(like[w])) for k in range(3)]
                for k in range(3):
                    new[k] += p[k] / max(sum(p), 1e-300) / len(text)
            done = max(abs(a - b) for a, b in zip(new, share)) < 1e-4
            share = new
            if done:
                break
        total = sum(math.log(max(sum(share[k] * math.exp(like[w][k] - max(like[w])) for k in range(3)), 1e-300)) + max(like[w]) for w in text)
        return share, total

    texts = [[r.choice(words) for _ in range(r.choice([1, 3, 12, 40]))] for _ in range(40)]
    for text, (lang, score, sets) in zip(texts, model.predict([" ".join(t) for t in texts])):
        every, _ = em(text, range(3))
        alone = [sum(like[w][k] for w in text) for k in range(3)]
        chosen, best = {max(range(3), key=lambda k: alone[k])}, max(alone)
        share = [1.0 if k in chosen else 0.0 for k in range(3)]
        order = sorted(range(3), key=lambda k: -every[k])
        if max(every) < 1 - 1e-3:
            for k in (2, 3):
                got, fit = em(text, order[:k])
                fine = langid.PENALTY * math.log(len(text) + 1)
                if fit - fine * (k - 1) <= best - fine * (len(chosen) - 1):
                    break
                chosen, share, best = set(order[:k]), got, fit
        assert {x.split(":")[0] for x in sets.split(",")} == {langs[k] for k in chosen}
        assert lang == langs[max(range(3), key=lambda k: share[k])] and score == pytest.approx(max(share), abs=2e-3)


def test_letters_are_letters(spark):
    import regex
    texts = ["\u00bd \u00b2 \u2167 \u0663 12_3", "\u00bd\u00e9\u2167", "x\u00b2y z_w 3d", "\u65e5\u672c \u0e01\u0e34 \u1d2c \u01c5", "\u24b6 \u3007 \u4e00"]
    assert [sum(langid.words_of(t), []) for t in texts] == [regex.findall(r"\p{L}+", t.lower()) for t in texts]
    got = langid.predict_languages(frame(spark, [(1, texts[0], None, None, 0), (2, texts[1], None, None, 0)]), *langid.learn(
        frame(spark, [(i, "some words of one language", "en", None, 0) for i in range(4)])))
    assert {x["doc_id"]: x["lang_pred"] for x in got.collect()} == {1: "und", 2: "en"}
    rows = frame(spark, [(None, "a", None, None, 0)])
    assert rows.select(langid.held_out(), quality_model.held_out()).first() == (False, False)
    many = [(i, "text", f"l{i}", None, 0) for i in range(langid.MOST_LANGS + 1)]
    with pytest.raises(ValueError):
        langid.learn(frame(spark, many))
