"""Language identification by multilingual mixture inference.

Per language, character trigrams of words (with word borders) are counted over a bounded,
documented sample of labelled texts; the log-likelihood of a word under a language is the
sum over its trigrams.  A document is a mixture: every word comes from one language,
drawn with the document's proportions, and expectation-maximisation estimates the
proportions.  Languages are then taken in order of proportion, as long as another one
raises the penalised likelihood (``PENALTY`` times log(words) per further language);
the prediction is the largest of the selected set, refitted.

Defined cases: texts that are null or have no letter are ``und`` with score 0, and so
is everything where no labelled text was given; null labels are never learned; rows are
predicted one by one (repeats get equal results); a row without an id is never held out; a
table with more than ``MOST_LANGS`` values of lang is refused; an empty table gives no rows.  Texts are
worked off in slices of bounded size; of a very long text only its distinct words are held.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import crc_fold

UNKNOWN = "und"
BUCKETS = 1 << 16            # hashed trigrams
TRAIN_PER_LANG = 3_000       # expected labelled documents per language in the sample
MAX_ROUNDS = 25
PENALTY = 4.0
SLICE_CHARS = 2_000_000
SLICE_WORDS = 400_000
MEMO_WORDS = 300_000
MOST_LANGS = 512             # learned languages: the model holds BUCKETS numbers for each
_LETTERS = re.compile(r"[^\W\d_]+")


def _numeral(c: str) -> bool:
    """A fraction, Roman numeral or the like: a word character that is neither letter nor digit."""
    return c.isnumeric() and not c.isalpha() and not c.isdecimal()


_NUMERALS = re.compile("[" + "".join(re.escape(c) for c in map(chr, range(0x10000)) if _numeral(c)) + "]")
_ASTRAL = re.compile("[\U00010000-\U0010FFFF]")


def words_of(text: str):
    """Lower-cased runs of letters, in bounded lists."""
    text = text.lower()
    if not text.isascii():
        if _NUMERALS.search(text):
            text = _NUMERALS.sub(" ", text)
        if _ASTRAL.search(text):
            text = "".join(" " if _numeral(c) else c for c in text)
    if len(text) <= SLICE_CHARS:
        yield _LETTERS.findall(text)
    else:
        hits = (m[0] for m in _LETTERS.finditer(text))
        while part := list(islice(hits, SLICE_WORDS)):
            yield part


def trigram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed trigrams, place of the first of every word); a word has at least one."""
    line = "".join(["\x02" + w + "\x03" for w in words])
    c = np.frombuffer(line.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    mixed = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    inside = (c[:-2] != 3) & (c[1:-1] != 3)
    first = np.flatnonzero(c[:-2][inside] == 2)
    return (mixed[inside] >> np.uint64(48)).astype(np.int64) % BUCKETS, first


def learn(docs: DataFrame, per_lang: int = TRAIN_PER_LANG) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities by bucket and language) from (doc_id, text, lang) rows.

    The sample is a hash threshold per language, so it holds about ``per_lang`` documents
    of each; the counts that reach the driver are at most ``BUCKETS`` per language."""
    docs = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if len(langs) > MOST_LANGS:
        raise ValueError(f"{len(langs)} values of lang: at most {MOST_LANGS} languages can be learned")
    if not langs:
        return [], np.zeros((BUCKETS, 0))
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_lang / sizes[k]))]), F.col("lang"))
    chance = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    number = {k: i for i, k in enumerate(langs)}

    def grams(parts):
        held: dict[int, np.ndarray] = {}

        def flush():
            for lang, table in held.items():
                bucket = np.flatnonzero(table)
                yield pd.DataFrame({"l": lang, "bucket": bucket, "n": table[bucket]})
            held.clear()

        for part in parts:
            for text, lang in zip(part["text"], part["lang"], strict=True):
                table = held.setdefault(number[lang], np.zeros(BUCKETS, dtype=np.int64))
                for words in words_of(text):
                    if words:
                        table += np.bincount(trigram_buckets(words)[0], minlength=BUCKETS)
                if len(held) > 64:
                    yield from flush()
        yield from flush()

    counted = (docs.filter(chance < share).select("text", "lang").mapInPandas(grams, "l long, bucket long, n long")
               .groupBy("l", "bucket").agg(F.sum("n").alias("n")).toPandas())
    table = np.zeros((BUCKETS, len(langs)))
    table[counted["bucket"], counted["l"]] = counted["n"]
    smooth = 0.5
    return langs, np.log((table + smooth) / (table.sum(axis=0) + smooth * BUCKETS))


class MixtureModel:
    def __init__(self, langs: list[str], logp: np.ndarray):
        self.langs, self.logp = langs, logp
        self.memo: dict[str, int] = {}
        self.table = np.zeros((0, len(langs)))

    def rows_of(self, words: list[str]) -> np.ndarray:
        """Rows of ``self.table`` (log-likelihoods) of words, known or new."""
        new = list(set(words) - self.memo.keys())
        if new:
            buckets, first = trigram_buckets(new)
            start = len(self.memo)
            self.table = np.concatenate([self.table, np.add.reduceat(self.logp[buckets], first, axis=0)])
            self.memo.update(zip(new, range(start, start + len(new)), strict=True))
        return np.fromiter(map(self.memo.__getitem__, words), dtype=np.int64, count=len(words))

    def counted(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, table row, count) of the distinct words of every text, sorted by document."""
        triples, words, sizes = [], [], []

        def flush() -> None:
            if words:
                key = np.repeat([d for d, _ in sizes], [n for _, n in sizes]) << 32 | self.rows_of(words)
                triples.append(np.stack(np.unique(key, return_counts=True)))
            words.clear(), sizes.clear()

        for d, text in enumerate(texts):
            for part in words_of(text or ""):
                if part:
                    words.extend(part), sizes.append((d, len(part)))
                if len(words) >= SLICE_WORDS:
                    flush()
        flush()
        if not triples:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        key, count = triples[0] if len(triples) == 1 else _merged(np.concatenate(triples, axis=1))
        return key >> 32, key & 0xFFFFFFFF, count.astype(float)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, str]]:
        out: list[tuple[str, float, str]] = []
        start = 0
        while start < len(texts):
            stop, size = start, 0
            while stop < len(texts) and (stop == start or size < SLICE_CHARS):
                size += len(texts[stop] or "")
                stop += 1
            out += self._slice(texts[start:stop])
            start = stop
        return out

    def _slice(self, texts: list[str | None]) -> list[tuple[str, float, str]]:
        if len(self.memo) > MEMO_WORDS:
            self.memo, self.table = {}, self.table[:0]
        result = [(UNKNOWN, 0.0, "")] * len(texts)
        if not self.langs:
            return result
        owner, rows, counts = self.counted(texts)
        if not len(owner):
            return result
        found, first, local = np.unique(owner, return_index=True, return_inverse=True)
        like = self.table[rows]
        pick, share, sets = select_languages(like, counts, local, first)
        for i, d in enumerate(found):
            chosen = np.flatnonzero(sets[i])
            chosen = chosen[np.argsort(-share[i, chosen], kind="stable")]
            result[d] = (self.langs[pick[i]], float(share[i, pick[i]]),
                         ",".join(f"{self.langs[j]}:{share[i, j]:.3f}" for j in chosen))
        return result


def _merged(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r, where = np.unique(pairs[0], return_inverse=True)
    return r, np.bincount(where, weights=pairs[1])


def mixture(like: np.ndarray, counts: np.ndarray, local: np.ndarray, first: np.ndarray,
            allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM over the words of documents (rows sorted by document; ``first``: their first rows).
    Returns proportions and log-likelihood per document, within the ``allowed`` languages."""
    top = like.max(axis=1)
    p = np.exp(like - top[:, None])
    total = np.add.reduceat(counts, first)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(MAX_ROUNDS):
        r = p * share[local]
        s = np.maximum(r.sum(axis=1), 1e-300)
        new = np.add.reduceat(r * (counts / s)[:, None], first, axis=0) / total[:, None]
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    s = np.maximum((p * share[local]).sum(axis=1), 1e-300)
    return share, np.add.reduceat(counts * (np.log(s) + top), first)


def select_languages(like: np.ndarray, counts: np.ndarray, local: np.ndarray,
                     first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(predicted language, proportions, selected set) per document."""
    n_docs, n_langs = len(first), like.shape[1]
    total = np.add.reduceat(counts, first)
    every, _ = mixture(like, counts, local, first, np.ones((n_docs, n_langs)))
    order = np.argsort(-every, axis=1, kind="stable")
    alone = np.add.reduceat(like * counts[:, None], first, axis=0)
    lead = alone.argmax(axis=1)                 # best set of one
    docs = np.arange(n_docs)
    sets = np.zeros((n_docs, n_langs), dtype=bool)
    sets[docs, lead] = True
    share = sets.astype(float)
    best = alone[docs, lead]
    open_docs = docs[every.max(axis=1) < 1 - 1e-3] if n_langs > 1 else docs[:0]
    for k in range(2, n_langs + 1):             # the k languages of largest proportion
        if not len(open_docs):
            break
        part = np.isin(local, open_docs)
        again = np.unique(local[part], return_index=True, return_inverse=True)
        tried = np.zeros((len(open_docs), n_langs))
        np.put_along_axis(tried, order[open_docs, :k], 1.0, axis=1)
        got, fit = mixture(like[part], counts[part], again[2], again[1], tried)
        better = fit - PENALTY * (k - 1) * np.log(total[open_docs] + 1) > \
            best[open_docs] - PENALTY * (sets[open_docs].sum(axis=1) - 1) * np.log(total[open_docs] + 1)
        won = open_docs[better]
        sets[won], share[won], best[won] = tried[better] > 0, got[better], fit[better]
        open_docs = won
    return share.argmax(axis=1), share, sets


def predict_languages(docs: DataFrame, langs: list[str], logp: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score, languages) of every document; the model (``BUCKETS`` numbers
    per language) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, logp))
    cache: dict[str, MixtureModel] = {}
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                         T.StructField("languages", T.StringType())])

    @F.arrow_udf(kind)
    def infer(texts: pa.Array) -> pa.Array:
        if not cache:
            cache["m"] = MixtureModel(*shared.value)
        rows = [r for i in range(0, len(texts), 1024) for r in cache["m"].predict(texts.slice(i, 1024).to_pylist())]
        return pa.StructArray.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()),
             pa.array([r[2] for r in rows], pa.string())], ["lang_pred", "score", "languages"])

    return docs.select("doc_id", infer("text").alias("p")).select("doc_id", "p.*")


def held_out(folds: int = 4, fold: int = 2):
    return F.coalesce(crc_fold(F.col("doc_id"), folds) == fold, F.lit(False))
