"""Replies from retrieved context (R1-R5, J5, W5-W7): a table of user messages
in, a table of turns out.

``hits(query_id, rank, id, text, score, metadata{line, source, ...})`` come from
``retrieve``.  The message that followed a hit is found by an equi-join on
``(source, line)`` with the corpus's next-message table (a halo-bucketed
``lead``), instead of re-reading the corpus for every hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.operators.order import lead_within
from parley.session import ensure_checkpoint_dir

# --- fixed values -----------------------------------------------------------
STRATEGIES = ("hybrid", "generate", "corpus")
DEFAULT_MIN_SCORE = 0.35
TEMPLATES = {
    "minimal": "minimal", "min": "minimal",
    "scaffold": "scaffold", "conversation-scaffold": "scaffold", "conversation": "scaffold",
    "few-shot": "few-shot", "fewshot": "few-shot", "retrieval-few-shot": "few-shot",
}
SCAFFOLD_HEAD = "This is a chat. Reply as YOU. Keep it short.\n\n"
MAX_EXAMPLES = 3
STOPS = ["\n", "\nUSER:", "\nYOU:"]
# ---------------------------------------------------------------------------


def strategy_name(s: str | None) -> str:
    v = str(s or "").strip().lower()
    if v not in STRATEGIES:
        raise ValueError(f"no way to reply {s!r}: hybrid, generate or corpus")
    return v


def template_name(t: str | None) -> str:
    v = str(t or "few-shot").strip().lower()
    if v not in TEMPLATES:
        raise ValueError(f"no prompt layout {t!r}: minimal, scaffold or few-shot")
    return TEMPLATES[v]


# W5
def corpus_next(corpus: DataFrame) -> DataFrame:
    """``(source, line_no, next_text)``: the following non-blank message of the
    same source (stripped only, not normalised or redacted)."""
    c = corpus.withColumn("text", tx.strip_ws("text")).filter(F.col("text") != "")
    return lead_within(c.select("source", "line_no", "text"), ["source"], "text", "next_text") \
        .select(F.col("source").cast("string").alias("source"), "line_no", "next_text")


def _next_of(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """``(_src, _line, next_text)`` of the sources the hits come from (a semi-join on the distinct hit
    sources), so a small batch of turns does not scan the whole corpus's order."""
    srcs = hits.select(F.col("metadata.source").alias("_s")).distinct()
    touched = corpus.join(srcs, F.col("source").cast("string") == F.col("_s"), "left_semi")
    return corpus_next(touched).withColumnRenamed("source", "_src").withColumnRenamed("line_no", "_line")


def _placed(hits: DataFrame) -> DataFrame:
    return (hits.withColumn("_src", F.col("metadata.source"))
                .withColumn("_line", F.col("metadata.line").cast("string").try_cast("bigint")))


def _cut(hits: DataFrame) -> DataFrame:
    """The hits are read twice, so they are written first and their retrieval runs once."""
    ensure_checkpoint_dir(hits.sparkSession)
    return hits.checkpoint(eager=True)


# J5
def next_message(hits: DataFrame, corpus: DataFrame, cut: bool = True) -> DataFrame:
    """Add ``next_text`` to each hit with integer metadata ``line`` (NULL otherwise).

    With ``cut`` the hits are written first.  Only the sources the hits come from are read."""
    hits = _cut(hits) if cut else hits
    return _placed(hits).join(_next_of(hits, corpus), ["_src", "_line"], "left").drop("_src")


def _usable(h: DataFrame) -> DataFrame:
    return h.filter(F.col("metadata").isNotNull() & F.col("_line").isNotNull() & F.col("next_text").isNotNull())


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column and take it through a generator: what is asked of it later is not moved into its
    expression, which would be evaluated again for every question."""
    return df.withColumn("_v", value).select("*", F.inline(F.array(F.struct(F.col("_v").alias(name))))).drop("_v")


def _said(hits: DataFrame, corpus: DataFrame, cut: bool = True) -> DataFrame:
    """``(query_id, rank, score, _u, _a)``: the cleaned text of every hit with a line, and the cleaned message
    that followed (NULL if none did).

    A text is cleaned once per hit, a message once, whatever is asked of them."""
    hits = _cut(hits) if cut else hits
    nxt = _once(_next_of(hits, corpus).filter(F.col("next_text").isNotNull()), "_a", tx.clean_answer("next_text")).drop("next_text")
    h = _placed(hits).filter(F.col("metadata").isNotNull() & F.col("_line").isNotNull())
    h = _once(h.select("query_id", "rank", "score", "_src", "_line", "text"), "_u", tx.clean_answer("text")).drop("text")
    return h.join(nxt, ["_src", "_line"], "left").select("query_id", "rank", "score", "_u", "_a")


def _said_of(next_hits: DataFrame) -> DataFrame:
    if "_a" in next_hits.columns:
        return next_hits
    h = _once(_once(_usable(next_hits), "_u", tx.clean_answer("text")), "_a", tx.clean_answer("next_text"))
    return h.select("query_id", "rank", "score", "_u", "_a")


# R1
def corpus_reply(hits: DataFrame, corpus: DataFrame, strategy: str = "hybrid",
                 min_score: float = DEFAULT_MIN_SCORE, next_hits: DataFrame | None = None) -> DataFrame:
    """``(query_id, reply, reply_score)``: the cleaned next message of the best
    usable hit (highest vector score, first in hit order on ties).  ``next_hits``
    is ``next_message(hits, corpus)`` when the caller already has it."""
    st = strategy_name(strategy)
    h = _said_of(next_hits) if next_hits is not None else _said(hits, corpus)
    if st == "hybrid":
        h = h.filter(F.col("score") >= F.lit(float(min_score)))
    h = h.withColumnRenamed("_a", "reply").filter((F.col("reply") != "") & (F.col("reply") != F.col("_u")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("rank"))
    return (h.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
             .select("query_id", "reply", F.col("score").alias("reply_score")))


def _wrap(user: Column, head: Column | None = None) -> Column:
    core = F.concat(F.lit("USER: "), user, F.lit("\nYOU: "))
    return core if head is None else F.concat(head, core)


# R2
def build_prompt(queries: DataFrame, hits: DataFrame, corpus: DataFrame, template: str = "few-shot",
                 next_hits: DataFrame | None = None) -> DataFrame:
    """``(query_id, prompt)`` for every query."""
    t = template_name(template)
    if t == "minimal":
        return queries.select("query_id", _wrap(F.col("query")).alias("prompt"))
    if t == "scaffold":
        return queries.select("query_id", _wrap(F.col("query"), F.lit(SCAFFOLD_HEAD)).alias("prompt"))
    nh = _said_of(next_hits) if next_hits is not None else _said(hits, corpus)
    h = nh.filter((F.col("rank") <= 2 * MAX_EXAMPLES) & (F.col("_u") != "") & (F.col("_a") != ""))
    w = Window.partitionBy("query_id").orderBy("rank")
    h = h.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= MAX_EXAMPLES)
    blocks = (h.groupBy("query_id")
               .agg(F.sort_array(F.collect_list(F.struct("rank", F.concat(F.lit("USER: "), "_u", F.lit("\nYOU: "), "_a")
                                                          .alias("b")))).alias("_bs"))
               .select("query_id", F.array_join(F.transform("_bs", lambda s: s["b"]), "\n\n").alias("_ctx")))
    q = queries.join(blocks, "query_id", "left")
    return q.select("query_id", F.when(F.col("_ctx").isNotNull(),
                                       _wrap(F.col("query"), F.concat(F.col("_ctx"), F.lit("\n\n"))))
                    .otherwise(_wrap(F.col("query"))).alias("prompt"))


# R4
def generated_answer(prompt: Column, generator, stops: list[str] | None = None) -> Column:
    """Generator hook: ``generator(prompt) -> continuation``; cut at the earliest
    stop string (searched in the continuation only)."""
    gen = generator(prompt)
    return tx.truncate_at_stops(gen, 0, STOPS + [s for s in (stops or []) if isinstance(s, str) and s])


# R3 + R5
def turns(queries: DataFrame, hits: DataFrame, corpus: DataFrame, strategy: str = "hybrid",
          template: str = "few-shot", min_score: float = DEFAULT_MIN_SCORE, generator=None,
          stops: list[str] | None = None, redact_replies: bool = False) -> DataFrame:
    """``(query_id, user, answer, used_strategy, prompt, retrieved)``.

    ``prompt`` is set on generate rows; without a generator their answer is NULL.  Replies come
    from the corpus as it is; ``redact_replies`` redacts the answers."""
    st = strategy_name(strategy)
    template_name(template)
    ensure_checkpoint_dir(queries.sparkSession)
    # the hits and what was said in them feed three branches: computed once
    hits = hits.checkpoint(eager=True)
    nh = _said(hits, corpus, cut=False).checkpoint(eager=True)
    q = queries.select("query_id", F.col("query").alias("user"))
    if st in ("corpus", "hybrid"):
        q = q.join(corpus_reply(hits, corpus, st, min_score, nh).select("query_id", "reply"), "query_id", "left")
    else:
        q = q.withColumn("reply", F.lit(None).cast("string"))
    used = F.when(F.lit(st == "corpus") | (F.lit(st == "hybrid") & F.col("reply").isNotNull()), F.lit("corpus")) \
        .otherwise(F.lit("generate"))
    q = q.withColumn("used_strategy", used)
    prompts = build_prompt(queries, hits, corpus, template, nh)
    q = q.join(prompts, "query_id", "left").withColumn(
        "prompt", F.when(F.col("used_strategy") == "generate", F.col("prompt")))
    gen = generated_answer(F.col("prompt"), generator, stops) if generator is not None else F.lit(None).cast("string")
    out = F.when(F.col("used_strategy") == "corpus", F.coalesce("reply", F.lit(""))).otherwise(gen)
    answer = tx.clean_answer(out)
    q = q.withColumn("answer", tx.redact(answer) if redact_replies else answer)
    cols = [c for c in ("text", "score", "metadata") if c in hits.columns]
    ret = (hits.groupBy("query_id")
               .agg(F.sort_array(F.collect_list(F.struct("rank", *cols))).alias("_r"))
               .select("query_id", F.transform("_r", lambda s: F.struct(*[s[c].alias(c) for c in cols]))
                       .alias("retrieved")))
    return (q.join(ret, "query_id", "left")
             .select("query_id", "user", "answer", "used_strategy", "prompt", "retrieved"))


# S16
def turn_events(turns_df: DataFrame) -> DataFrame:
    """One JSON object per line: ``{type, user, answer, used_strategy, retrieved}``."""
    return turns_df.select(F.to_json(F.struct(F.lit("turn").alias("type"), "user", "answer", "used_strategy",
                                              "retrieved")).alias("value"))


def write_turns(turns_df: DataFrame, path: str, mode: str = "append") -> None:
    """Turn events as files of JSON lines under ``path``; appended by default, as a chat goes on."""
    turn_events(turns_df).write.mode(mode).text(path)
