"""Quality rules with a bitmask ledger.

``build_ledger`` evaluates every rule once per document and stores its measurements
and one ``fail_mask`` (bit r set: rule r failed).  What to do with a failure is a matter
of policy: a policy version names the rules that reject, ``apply_policy`` is one
``AND`` of masks, and ``ablation`` counts from the distinct masks what each rule rejects
alone and in all, without looking at a text again.

Everything is built-in column expressions over one row; nothing is shuffled.
Five-word windows are compared by 64-bit hashes inside one text; the words in repeated
windows are found from the sorted hashes of those texts only that repeat a window.

Defined cases: null and empty texts have no words (all measures 0; the rule on few words
fails); rows are judged one by one, so repeated rows get equal results; other columns are
ignored by ``build_ledger`` unless named in ``keep``; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import WORD, space_words

WINDOW = 5
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """``failed`` is a SQL condition over the measurements."""
    bit: int
    name: str
    failed: str


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "n_words > 0 AND 10 * n_symbols > 3 * n_words"),
    Rule(3, "duplicate_lines", "n_lines > 3 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
    Rule(5, "shouting", "2 * n_upper > word_chars AND n_words >= 10"),
)
BASE = ("few_words", "repeated_windows")
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols", "word_length"),
    "v2": tuple(r.name for r in RULES),
}


def policy_mask(names: tuple[str, ...]) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[n] for n in names)


def _removed(text: Column, chars: str) -> Column:
    """Number of characters of ``text`` that are in ``chars``."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("bigint")


def window_hashes(words: Column) -> Column:
    """Hash of every window of five consecutive words."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW),
                       lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))


def covered_words(hashes: Column) -> Column:
    """Words inside windows that occur twice or more, from the window hashes."""
    # sorted by hash, a repeated window has an equal neighbour
    by_hash = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(pairs: Column) -> Column:
        return F.transform(F.filter(F.transform(pairs, lambda p, k: F.struct(
            p["i"].alias("i"),
            (F.coalesce(F.get(pairs, k - 1)["h"] == p["h"], F.lit(False))
             | F.coalesce(F.get(pairs, k + 1)["h"] == p["h"], F.lit(False))).alias("twice"))),
            lambda x: x["twice"]), lambda x: x["i"])

    starts = F.array_sort(F.aggregate(F.array(by_hash), F.array().cast("array<int>"), lambda acc, p: repeated(p)))
    # each start covers up to five words, fewer where the next one begins before
    total = F.aggregate(
        starts, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, s: F.struct((acc["n"] + F.least(F.lit(WINDOW), s - acc["last"])).alias("n"), s.alias("last")))
    return total["n"]


def build_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, measurements, fail_mask) of every document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(id_col, *keep, text.alias("_text"), space_words(text).alias("_words"))
    hashes = F.when(F.size("_words") >= WINDOW, window_hashes(F.col("_words")))
    rows = rows.withColumn("_hashes", hashes)
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(WORD))
    rows = rows.withColumn("_lines", lines)
    rows = rows.select(
        id_col, *keep,
        F.size("_words").cast("bigint").alias("n_words"),
        (F.length("_text").cast("bigint") - _removed(F.col("_text"), _SPACES)).alias("word_chars"),
        _removed(F.col("_text"), SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), covered_words(F.col("_hashes")))
        .otherwise(F.lit(0).cast("bigint")).alias("n_repeat_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        _removed(F.col("_text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"))
    mask = F.lit(0).cast("bigint")
    for rule in RULES:
        mask = mask.bitwiseOR(F.when(F.expr(rule.failed), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("bigint"))
    return rows.withColumn("fail_mask", mask)


def apply_policy(ledger: DataFrame, version: str, out: str = "kept") -> DataFrame:
    """The ledger with a boolean: no rule of the policy failed."""
    return ledger.withColumn(out, F.col("fail_mask").bitwiseAND(F.lit(policy_mask(POLICIES[version]))) == 0)


def ablation(ledger: DataFrame, version: str) -> DataFrame:
    """(rule, rejected, rejected_alone, kept_without_it) of a policy.

    Counts of distinct masks (at most 2 ** number of rules rows) come first; each rule is
    then a sum over them."""
    every = policy_mask(POLICIES[version])
    masks = ledger.groupBy("fail_mask").agg(F.count(F.lit(1)).alias("docs"))
    masks = masks.withColumn("hit", F.col("fail_mask").bitwiseAND(F.lit(every)))
    rules = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit"))
                                for r in RULES if r.name in POLICIES[version]]))
    per = masks.select("docs", "hit", rules.alias("r")).select("docs", "hit", "r.rule", "r.bit")
    sole = F.col("hit") == F.col("bit")
    return per.groupBy("rule").agg(
        F.sum(F.when(F.col("hit").bitwiseAND(F.col("bit")) != 0, F.col("docs")).otherwise(0)).alias("rejected"),
        F.sum(F.when(sole, F.col("docs")).otherwise(0)).alias("rejected_alone"),
        F.sum(F.when(sole | (F.col("hit") == 0), F.col("docs")).otherwise(0)).alias("kept_without_it"))


RULES_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, list_slice(words, i, i + 4) AS gram
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(len(lines) AS BIGINT) AS n_lines,
        CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper
      FROM w LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 10 AS f0, 100 * n_repeat_words > 20 * n_words AS f1, n_words > 0 AND 10 * n_symbols > 3 * n_words AS f2,
        n_lines > 3 AND 10 * n_dup_lines > 3 * n_lines AS f3,
        n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) AS f4,
        2 * n_upper > word_chars AND n_words >= 10 AS f5 FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper,
  CAST(f0 AS BIGINT) + 2 * CAST(f1 AS BIGINT) + 4 * CAST(f2 AS BIGINT) + 8 * CAST(f3 AS BIGINT)
    + 16 * CAST(f4 AS BIGINT) + 32 * CAST(f5 AS BIGINT) AS fail_mask,
  f0 OR f1 AS base_failed, NOT (f0 OR f1 OR f2 OR f3 OR f4 OR f5) AS kept
FROM f
"""
