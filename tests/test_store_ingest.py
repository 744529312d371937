import uuid

import pytest
from pyspark.sql import functions as F

from parley.operators import ingest as ing
from parley.operators.embed import hashed_embedder
from parley.sources.store import METADATA_TYPE, ParquetStore, StoreError, TableStore, open_store, store_backend


def _corpus(spark, texts, source="f"):
    return spark.createDataFrame([(source, i + 1, t) for i, t in enumerate(texts)], "source string, line_no long, text string")


def test_store_versions(spark, tmp_path):
    st = ParquetStore(spark, str(tmp_path / "s"), "messages")
    assert st.version() is None
    assert st.ensure_version(1) == 1 and st.version() == 1
    st.set_version(2)
    with pytest.raises(StoreError, match="found 2, expected 1"):
        st.ensure_version(1)
    other = ParquetStore(spark, str(tmp_path / "s"), "other")
    assert other.version() is None
    assert store_backend("ChromaDB") == "parquet"
    assert store_backend(" Astra-DB ") == "table"
    with pytest.raises(StoreError):
        store_backend("nope")


def test_ingest_idempotent(spark, tmp_path):
    corpus = _corpus(spark, ["hello there", "", "[1/2/25, 9:00 AM] Ann: hi Bob", "hello there", "bye now"])
    st = ParquetStore(spark, str(tmp_path / "s"))
    opts = ing.IngestOptions()
    dry = ing.ingest(corpus, st, opts, hashed_embedder(16), dry_run=True).first()
    assert (dry["chunks"], dry["kept"], dry["would_add"], dry["added"]) == (4, 3, 3, 0)
    assert st.version() is None                     # a dry run sets no version
    first = ing.ingest(corpus, st, opts, hashed_embedder(16)).first()
    assert first["added"] == 3 and st.version() == 1
    rows = {r["id"].split(":")[1]: r for r in st.read().collect()}
    meta = rows["3"]["metadata"]
    assert rows["3"]["text"] == "hi Bob" and meta["speaker"] == "Ann" and meta["timestamp"] == "1/2/25, 9:00 AM"
    assert meta["chunking"] == "message" and meta["window_size"] == 1 and meta["line"] == 3
    assert len(rows["1"]["embedding"]) == 16
    again = ing.ingest(corpus, st, opts, hashed_embedder(16)).first()
    assert again["added"] == 0 and again["skip_existing"] == 3
    assert st.ids().count() == 3


def test_ingest_window_and_limits(spark, tmp_path):
    corpus = _corpus(spark, ["a", "b", "c", "d"])
    st = ParquetStore(spark, str(tmp_path / "w"))
    o = ing.IngestOptions(chunking="sliding", window_size=2, max_messages=3)
    s = ing.ingest(corpus, st, o, hashed_embedder(8)).first()
    assert (s["messages"], s["chunks"], s["added"]) == (3, 2, 2)
    md = st.read().select("metadata.*").orderBy("start_line").collect()
    assert [(m["start_line"], m["end_line"], m["window_size"], m["chunking"]) for m in md] == [(1, 2, 2, "window"), (2, 3, 2, "window")]
    with pytest.raises(ValueError, match="no non-blank message"):
        ing.ingest(corpus, st, ing.IngestOptions(max_messages=-5), hashed_embedder(8))
    with pytest.raises(ValueError, match="chunking gave nothing"):
        ing.ingest(corpus, st, ing.IngestOptions(chunking="window", window_size=9), hashed_embedder(8))


def test_redacted_hash_dedupe_against_store(spark, tmp_path):
    corpus = _corpus(spark, ["mail me at a@b.com", "mail me at c@d.org", "x"])
    st = ParquetStore(spark, str(tmp_path / "r"))
    o = ing.IngestOptions(redact=True)
    s = ing.ingest(corpus, st, o, hashed_embedder(8)).first()
    assert s["added"] == 2 and s["skip_dedupe"] == 1
    assert sorted(r["text"] for r in st.read().collect()) == ["mail me at <EMAIL>", "x"]
    moved = _corpus(spark, ["zzz", "mail me at e@f.net"])
    s2 = ing.ingest(moved, st, o, hashed_embedder(8)).first()
    assert s2["added"] == 1                     # the redacted text is already stored


def test_store_add_upsert_rebuild(spark, tmp_path):
    st = ParquetStore(spark, str(tmp_path / "u"))
    rows = spark.createDataFrame([("a", "t1", [1.0, 0.0]), ("b", "t2", [0.0, 1.0])], "id string, text string, embedding array<float>")
    rows = rows.withColumn("metadata", F.lit(None).cast(st.read().schema["metadata"].dataType))
    assert st.add(rows.unionByName(rows)) == 2
    assert st.add(rows) == 0
    assert st.add(rows.limit(0)) == 0
    assert st.add(rows.withColumn("text", F.lit("new")).filter("id = 'a'"), mode="upsert") == 1
    assert {r["id"]: r["text"] for r in st.read().collect()} == {"a": "new", "b": "t2"}
    with pytest.raises(StoreError):
        st.rebuild(rows)
    assert st.rebuild(rows.filter("id = 'b'"), confirm=True) == 1
    with pytest.raises(StoreError):
        st.add(rows.drop("embedding"))


def test_rebuild_from_corpus_and_query(spark, tmp_path):
    st = ParquetStore(spark, str(tmp_path / "rb"))
    emb = hashed_embedder(16)
    ing.ingest(_corpus(spark, ["old one", "old two"]), st, ing.IngestOptions(), emb)
    with pytest.raises(StoreError):
        ing.rebuild_from_corpus(_corpus(spark, ["new"]), st, embedder=emb)
    s = ing.rebuild_from_corpus(_corpus(spark, ["new text", "other text"]), st, embedder=emb, confirm=True).first()
    assert s["added"] == 2 and sorted(r["text"] for r in st.read().collect()) == ["new text", "other text"]
    q = spark.createDataFrame([("q", "new text")], "query_id string, query string")
    hits = st.query(q.withColumn("qvec", emb(F.col("query"))), k=1).collect()
    assert hits[0]["text"] == "new text" and abs(hits[0]["score"] - 1.0) < 1e-6


def test_flag_chunks_invariants(spark):
    import random
    rnd = random.Random(41)
    vocab = ["hi", "hello there", "ok", "see you", "call 415-555-1234", "a@b.com", "  ", "", "hi", "w1 w2 w3"]
    for mode, fuzzy in (("message", False), ("message", True), ("window", True)):
        lines = [rnd.choice(vocab) + rnd.choice(["", " ", "  x"]) for _ in range(30)]
        n_messages = sum(bool(x.strip()) for x in lines)
        corpus = _corpus(spark, lines)
        io = ing.IngestOptions(chunking=mode, window_size=3, fuzzy_dedupe=fuzzy, redact=True)
        none = spark.createDataFrame([("none", "none")], "id string, content_hash string").limit(0)
        first = ing.flag_chunks(corpus, None, io, stored=none).collect()
        assert len(first) == (n_messages if mode == "message" else n_messages - 2)
        # exact dedupe keeps the first chunk of every text
        seen = set()
        for r in sorted(first, key=lambda r: r["start_line"]):
            assert r["exact_keep"] == (r["content_hash"] not in seen)
            assert "415" not in r["text"] and "@" not in r["text"]
            seen.add(r["content_hash"])
            assert r["keep"] == (r["exact_keep"] and (r["fuzzy_keep"] if fuzzy else True)) and r["add"] == r["keep"]
        added = [r for r in first if r["add"]]
        stored = spark.createDataFrame([(r["id"], r["content_hash"]) for r in added[::2]], "id string, content_hash string")
        again = ing.flag_chunks(corpus, None, io, stored=stored)
        got = {r["id"] for r in again.filter("add").collect()}
        assert not got & {r["id"] for r in added[::2]} and {r["id"] for r in added[1::2]} <= got | set()
        s = ing.ingest_summary(again, ing.messages_of(corpus, io)).first()
        assert (s["messages"], s["chunks"], s["would_add"]) == (n_messages, len(first), len(got))
        every = spark.createDataFrame([(r["id"], r["content_hash"]) for r in first], "id string, content_hash string")
        assert ing.flag_chunks(corpus, None, io, stored=every).filter("add").count() == 0


def _rows(spark, pairs):
    return spark.createDataFrame([(i, t, [1.0, 0.0], None) for i, t in pairs],
                                 "id string, text string, embedding array<float>, metadata struct<line:long,source:string>").select(
        "id", "text", "embedding", F.lit(None).cast(METADATA_TYPE).alias("metadata"))


def test_lost_commits_or_interrupted_writes_lose_no_rows(spark, tmp_path):
    st = ParquetStore(spark, str(tmp_path / "st"))
    st.ensure_version()
    assert st.add(_rows(spark, [("a", "x"), ("b", "y")])) == 2
    # an interrupted write: data without a commit, and a record that was not renamed
    st._write_data(_rows(spark, [("z", "half")]))
    commits = tmp_path / "st" / "messages" / "_commits"
    (commits / ".half").write_text("{")
    assert sorted(r["id"] for r in st.read().collect()) == ["a", "b"]
    assert st.add(_rows(spark, [("b", "again"), ("c", "w")])) == 1
    assert st.add(_rows(spark, [("a", "new")]), mode="upsert") == 1
    assert {r["id"]: r["text"] for r in st.read().collect()} == {"a": "new", "b": "y", "c": "w"}
    commits.rename(tmp_path / "kept")
    with pytest.raises(StoreError):
        st.add(_rows(spark, [("d", "v")]))
    with pytest.raises(StoreError):
        st.read()
    (tmp_path / "kept").rename(commits)
    assert st.read().count() == 3 and st.version() == 1


class _Late(ParquetStore):
    """Lets another writer commit between its look at the store and its own commit."""
    meanwhile = None

    def _write_data(self, rows):
        name = super()._write_data(rows)
        act, self.meanwhile = self.meanwhile, None
        if act:
            act()
        return name


def test_two_writers_lose_nothing(spark, tmp_path):
    slow, fast = _Late(spark, str(tmp_path)), ParquetStore(spark, str(tmp_path))
    fast.add(_rows(spark, [("a", "a")]))
    slow.meanwhile = lambda: fast.add(_rows(spark, [("b", "fast"), ("c", "fast")]))
    assert slow.add(_rows(spark, [("b", "slow"), ("d", "slow")])) == 1            # b is stored by now
    assert {r["id"]: r["text"] for r in fast.read().collect()} == {"a": "a", "b": "fast", "c": "fast", "d": "slow"}
    slow.meanwhile = lambda: fast.add(_rows(spark, [("e", "fast")]))
    assert slow.add(_rows(spark, [("a", "slow"), ("e", "slow")]), mode="upsert") == 2
    assert {r["id"]: r["text"] for r in fast.read().collect()} == {"a": "slow", "b": "fast", "c": "fast", "d": "slow", "e": "slow"}
    slow.meanwhile = lambda: fast.set_version(7)
    assert slow.add(_rows(spark, [("f", "slow")])) == 1 and fast.version() == 7     # the version is part of the commit


def test_readers_keep_their_folders_until_vacuum(spark, tmp_path):
    st = ParquetStore(spark, str(tmp_path))
    st.add(_rows(spark, [("a", "x")]))
    reading = st.read()
    st.rebuild(_rows(spark, [("b", "y")]), confirm=True)
    assert [r["id"] for r in reading.collect()] == ["a"]
    assert st.vacuum(keep=1) == [] and st.vacuum(keep=5, older_than_hours=0) == []
    assert len(st.vacuum(keep=1, older_than_hours=-1)) == 1
    assert [r["id"] for r in st.read().collect()] == ["b"]


def test_table_backend(spark, tmp_path):
    st = open_store(spark, f"t{uuid.uuid4().hex[:8]}", "msgs", format="Cassandra")
    assert isinstance(st, TableStore)
    assert st.add(_rows(spark, [("a", "x")])) == 1 and st.add(_rows(spark, [("a", "x"), ("b", "y")])) == 1
    assert sorted(r["id"] for r in st.read().collect()) == ["a", "b"]
    assert st.rebuild(_rows(spark, [("c", "z")]), confirm=True) == 1
    assert [r["id"] for r in st.read().collect()] == ["c"] and len(st.vacuum(keep=1, older_than_hours=-1)) == 2
    assert TableStore(spark, "a-b", "c").table != TableStore(spark, "a_b", "c").table
    assert type(open_store(spark, str(tmp_path), format="chroma")) is ParquetStore
    with pytest.raises(StoreError):
        open_store(spark, str(tmp_path), format="sqlite")
