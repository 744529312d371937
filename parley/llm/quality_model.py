"""Quality classifier by a sparse rule ensemble.

Statistics of a text (built-in column expressions) feed a forest of shallow trees; every
path from a root is a conjunctive rule.  Lasso logistic regression over the rules keeps a
few of them with weights, and the kept rules are compiled into one Spark column: scoring
is a projection without any Python, and the model is a short list to read.

The fit uses a bounded sample, ``TRAIN_ROWS`` labelled documents by hash of the id; the
sample is the only thing that is collected or cached, and scoring covers every row.

Defined cases: null and empty texts have statistics of 0 and a score like any other; labels
that are null are not learned; a row without an id is never held out (and has no label); an id that repeats is scored row by row; without labelled
rows the score is 0.5, with one class only its share; an empty table gives no rows; other
columns are never read for a score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import WORD, crc_fold, materialise
from parley.llm.trees import path_condition, tree_leaves

TRAIN_ROWS = 12_000
TREES = 24
DEPTH = 3
LASSO = 0.0003
THRESHOLD = 0.3
FIT_TASKS = 2
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACES = " \t\n\x0b\x0c\r"


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("double")


STATISTICS = ("log_words", "word_length", "distinct_words", "line_words", "distinct_lines", "upper", "digits",
              "symbols", "bars", "bangs", "stops", "brackets")


def statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and one double per statistic, for every document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*keep, text.alias("_t"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_w"))
    rows = rows.select("*", F.greatest(F.size("_w"), F.lit(1)).cast("double").alias("_n"),
                       F.greatest(F.length("_t") - _count(F.col("_t"), _SPACES), F.lit(1.0)).alias("_c"),
                       F.split("_t", "\n").alias("_l"))
    t, n, c = F.col("_t"), F.col("_n"), F.col("_c")
    return rows.select(
        *keep,
        F.log(n).alias("log_words"),
        (c / n).alias("word_length"),
        # logarithms: the plain share of distinct words falls with the length of a text
        (F.log1p(F.size(F.array_distinct("_w"))) / F.log1p(n)).alias("distinct_words"),
        (n / F.size("_l")).alias("line_words"),
        (F.size(F.array_distinct("_l")) / F.size("_l")).alias("distinct_lines"),
        (_count(t, _UPPER) / c).alias("upper"),
        (_count(t, "0123456789") / c).alias("digits"),
        (_count(t, "#*$%&^~=_\\@") / c).alias("symbols"),
        (_count(t, "|") / n).alias("bars"),
        (_count(t, "!?") / n).alias("bangs"),
        (_count(t, ".,;:") / n).alias("stops"),
        (_count(t, "<>{}[]()") / c).alias("brackets"))



@dataclass(frozen=True)
class RuleModel:
    """Weighted rules over ``STATISTICS``; ``paths`` as of ``trees.Leaf``."""
    intercept: float
    weights: tuple[float, ...]
    paths: tuple[tuple[tuple[int, bool, float], ...], ...]

    def score(self) -> Column:
        """Probability of label 1 as a column over the statistics."""
        features = [F.col(s) for s in STATISTICS]
        margin = F.lit(self.intercept)
        for w, path in zip(self.weights, self.paths, strict=True):
            margin = margin + F.when(path_condition(path, features), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-margin))

    def describe(self) -> list[str]:
        def say(path):
            return " and ".join(f"{STATISTICS[f]} {'<=' if low else '>'} {t:.4g}" for f, low, t in path)
        return [f"{w:+.3f} if {say(p)}" for w, p in sorted(zip(self.weights, self.paths, strict=True), key=lambda x: -abs(x[0]))]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, trees: int = TREES,
        depth: int = DEPTH, lasso: float = LASSO, text_col: str = "text") -> RuleModel:
    """Fit on at most ``rows`` labelled documents (doc_id, text) x (doc_id, label)."""
    known = labels.select("doc_id", F.col(label).cast("double").alias("label")).filter("label is not null and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = known.orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id").limit(rows)   # at most ``rows`` short rows
    sample = materialise(statistics(docs.select("doc_id", text_col).join(F.broadcast(sample), "doc_id"), ["label"], text_col),
                         "quality-sample")
    sample = sample.coalesce(FIT_TASKS)    # the fit runs hundreds of short jobs over a few thousand short rows
    seen = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")).first()
    if not seen["n"]:
        return RuleModel(0.0, (), ())
    if seen["ones"] in (0, seen["n"]):
        share = (seen["ones"] + 1) / (seen["n"] + 2)
        return RuleModel(math.log(share / (1 - share)), (), ())

    vectors = sample.select("label", array_to_vector(F.array(*STATISTICS)).alias("x"))
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=7,
                                    featureSubsetStrategy="onethird", subsamplingRate=0.7, minInstancesPerNode=5).fit(vectors)
    # every node below a root is a rule, not the leaves alone
    paths = sorted({leaf.path[:k] for leaves in tree_leaves(forest) for leaf in leaves for k in range(1, len(leaf.path) + 1)})
    if not paths:
        share = (seen["ones"] + 1) / (seen["n"] + 2)
        return RuleModel(math.log(share / (1 - share)), (), ())
    features = [F.col(s) for s in STATISTICS]
    held = F.array(*[path_condition(p, features).cast("double") for p in paths])
    table = sample.select("label", array_to_vector(held).alias("rules")).cache()
    fitted = LogisticRegression(featuresCol="rules", labelCol="label", elasticNetParam=1.0, regParam=lasso,
                                standardization=False, maxIter=100).fit(table)
    table.unpersist()
    weights = fitted.coefficients.toArray()
    used = [i for i, w in enumerate(weights) if abs(w) > 1e-6]
    return RuleModel(float(fitted.intercept), tuple(float(weights[i]) for i in used), tuple(paths[i] for i in used))


def held_out(folds: int = 5) -> Column:
    return F.coalesce(crc_fold(F.col("doc_id"), folds) == 0, F.lit(False))


def score(docs: DataFrame, model: RuleModel, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """(*keep, score, predicted) of every document."""
    scored = statistics(docs, keep).select(*keep, model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
