"""Benchmark decontamination by winnowing.

Texts are cut into words; the hashes of all ``K``-word grams are winnowed: of every
``WINDOW - K + 1`` consecutive hashes the smallest is kept.  Two texts that share
``WINDOW`` words in a row keep the same smallest hash there, so joining the kept hashes of
documents and benchmark misses no shared window.  Around every joined gram the hit is
extended: all windows of ``WINDOW`` words that contain the gram are compared, word by word,
with the windows of the benchmark.  An item of fewer words is one window of its own; its
hash is looked up at every place of a document (only for the lengths that occur).

Only hashes take part in the first join (a checked small benchmark is broadcast, a larger
one shuffled); only documents with a joined hash are read a second time.

Defined cases: null texts and texts without words have no windows (documents: all counts
0; items: never found); equal ids with different texts are judged row by row, equal rows
get equal results; an item id that is null marks words but is not listed; an empty table
on either side gives no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import ascii_lower, checked_broadcast, materialise

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
K = 5
BROADCAST_HASHES = 1 << 20   # 64-bit hashes that one broadcast may hold (8 MB)
BROADCAST_GRAMS = 200_000    # grams of ten words or fewer in one broadcast


def plain_words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))


def _gram_hashes(words: Column, n: int) -> Column:
    """Hash of the gram of ``n`` words at every place; empty where there are too few words."""
    return F.when(F.size(words) >= n, F.transform(
        F.sequence(F.lit(0), F.size(words) - n),
        lambda i: F.xxhash64(F.lit(n), *[F.get(words, i + k) for k in range(n)]))).otherwise(
            F.array().cast("array<bigint>"))


def _winnowed(hashes: Column, span: int) -> Column:
    """Smallest hash of every ``span`` consecutive ones, without repeats."""
    return F.when(F.size(hashes) >= span, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.size(hashes) - span + 1), lambda i: F.array_min(F.slice(hashes, i, span))))).otherwise(
            F.array().cast("array<bigint>"))


def _gram(words: Column, start: Column, n) -> Column:
    return F.array_join(F.slice(words, start + 1, n), " ")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, n, gram): every window of every item, of ``window`` words or all it has."""
    items = benchmark.select("item_id", plain_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    items = items.withColumn("n", F.least(F.size("words"), F.lit(window)))
    grams = F.transform(F.sequence(F.lit(0), F.size("words") - F.col("n")), lambda i: _gram(F.col("words"), i, F.col("n")))
    return items.select("item_id", "n", F.explode(F.array_distinct(grams)).alias("gram"))


def benchmark_hashes(benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(n, hash): winnowed gram hashes of the long items (n = k), whole hashes of the short."""
    items = benchmark.select(plain_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    items = items.withColumn("grams", _gram_hashes(F.col("words"), k))
    long = items.select(F.lit(k).alias("n"), F.explode(_winnowed(F.col("grams"), window - k + 1)).alias("hash"))
    short = None
    for n in range(1, window):
        part = items.filter(F.size("words") == n).select(
            F.lit(n).alias("n"), F.explode(_gram_hashes(F.col("words"), n)).alias("hash"))
        short = part if short is None else short.unionAll(part)
    return (long.withColumn("whole", F.lit(False)).unionAll(short.withColumn("whole", F.lit(True)))).distinct()


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated) of every document; ``items`` holds the
    ids, as sorted strings, of the items with a window in the text."""
    grams = materialise(benchmark_windows(benchmark, window), "bench-windows")
    hashes = materialise(benchmark_hashes(benchmark, window, k), "bench-hashes")
    lengths = sorted(r["n"] for r in hashes.filter("whole").select("n").distinct().collect())   # 1 to window - 1

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    prints = rows.select("doc_id", "text_key", plain_words(F.col("text")).alias("words"))
    prints = prints.withColumn("grams", _gram_hashes(F.col("words"), k))
    kept = _winnowed(F.col("grams"), window - k + 1)
    if lengths:
        kept = F.array_distinct(F.concat(kept, *[_gram_hashes(F.col("words"), n) for n in lengths]))
    # one row per kept hash, and one (null here) that stands for the document itself; its join
    # key is arbitrary, so that these rows spread evenly where the join is a shuffle
    prints = prints.select("doc_id", "text_key", F.size("words").cast("bigint").alias("n_words"),
                           F.explode(F.concat(kept, F.array(F.lit(None).cast("bigint")))).alias("kept"))
    prints = prints.withColumn("hash", F.coalesce("kept", F.xxhash64("doc_id", "text_key")))
    keys = hashes.select("hash").distinct().withColumn("found", F.lit(True))
    met = materialise(prints.join(checked_broadcast(keys, BROADCAST_HASHES), "hash", "left").filter(F.col("kept").isNull() | F.col("found"))
                      .select("doc_id", "text_key", "n_words", "kept"), "decon-met")

    seen = (met.filter(F.col("kept").isNotNull()).groupBy("doc_id", "text_key").agg(F.collect_set("kept").alias("met"))
            .withColumnsRenamed({"doc_id": "_id", "text_key": "_key"}))
    # rows without a met hash leave before a text is moved
    named = materialise(seen.select(F.col("_id").alias("_i"), F.col("_key").alias("_k")), "decon-seen")
    rows = rows.join(checked_broadcast(named), F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("text_key") == F.col("_k")), "left_semi")
    again = rows.join(seen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    again = again.select("doc_id", "text_key", plain_words(F.col("text")).alias("words"), "met")
    again = again.withColumn("grams", _gram_hashes(F.col("words"), k))

    def places(found: Column) -> Column:
        return F.filter(F.transform(found, lambda h, i: F.when(F.array_contains("met", h), i)), lambda i: i.isNotNull())

    last = F.size("words") - window
    starts = F.array_distinct(F.flatten(F.transform(places(F.col("grams")), lambda p: F.when(
        last >= 0, F.sequence(F.greatest(p - (window - k), F.lit(0)), F.least(p, last)))
        .otherwise(F.array().cast("array<int>")))))

    def at_places(found: Column, n: int) -> Column:
        return F.transform(found, lambda s: F.struct(
            s.alias("start"), F.lit(n).alias("n"), _gram(F.col("words"), s, n).alias("gram")))

    tried = [at_places(starts, window)]
    tried += [at_places(places(_gram_hashes(F.col("words"), n)), n) for n in lengths]
    tried = again.select("doc_id", "text_key", F.explode(F.concat(*tried)).alias("w")).select("doc_id", "text_key", "w.*")
    # a short item may hit at very many places: no shuffle on the gram while the benchmark is small
    every = checked_broadcast(materialise(grams.select("n", "gram").distinct(), "bench-grams"), BROADCAST_GRAMS)
    hits = materialise(tried.join(every, ["n", "gram"]).distinct(), "decon-hits")

    spans = F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("n")).alias("end"))))
    covered = F.aggregate("spans", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("upto")), lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["upto"]))).alias("n"),
        F.greatest(acc["upto"], s["end"]).alias("upto")))["n"]
    words_hit = hits.groupBy("doc_id", "text_key").agg(spans.alias("spans")).select("doc_id", "text_key", covered.alias("n_hit"))
    items = (hits.select("doc_id", "text_key", "n", "gram").distinct().join(grams, ["n", "gram"])
             .select("doc_id", "text_key", F.col("item_id").cast("string").alias("item")).distinct()
             .groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item")).alias("items")))
    found = words_hit.join(items.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"}),
                           F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    found = materialise(found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "n_hit", "items"), "decon-found")

    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return met.filter(F.col("kept").isNull()).join(
        found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left").select(
        "doc_id", "text_key", "n_words", n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """The documents without a hit; ``marked`` is the result of ``find_hits`` for ``docs``."""
    bad = materialise(marked.filter("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(),
                      "decon-bad")
    return docs.join(checked_broadcast(bad), docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_key"]),
                     "left_anti")


HITS_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bg AS (SELECT DISTINCT item_id, n, list_slice(words, i, i + n - 1) AS gram
       FROM (SELECT item_id, words, n, unnest(range(1, len(words) - n + 2)) AS i
             FROM (SELECT *, least(len(words), 10) AS n FROM bw WHERE len(words) > 0))),
dg AS (SELECT doc_id, i, n, list_slice(words, i, i + n - 1) AS gram
       FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i
             FROM dw, (SELECT DISTINCT n FROM bg) WHERE len(words) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM dg JOIN bg USING (n, gram)),
w AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
      FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN w USING (doc_id) LEFT JOIN t USING (doc_id)
"""
