"""More of the query catalogue: files, sinks, stores, hooks and streams, each as a round trip
over the test tables (written to the shared checkpoint folder and read back)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.plans import sqlparts as S
from parley.plans.catalog import (REGISTRY, _FEWSHOT_SQL, _TURN_ID, _conv_hits, _json_str, _scratch, _turn_rows, conv_messages,
                                  conv_queries, conv_store_rows, doc_raw_lines, doc_stream, register, table, whatsapp_lines)
from parley.sources import corpus as C

CHATS = 8     # files that the conversations are written to


def _write_chats(lines, order: list[str], path: str) -> None:
    """``lines(chat, ..., value)`` as one text file per chat, in order."""
    lines.repartition(CHATS, "chat").sortWithinPartitions("chat", *order).select("chat", "value").write.partitionBy("chat").text(path)


def _chat_of(path_col: str):
    return F.regexp_extract(path_col, "chat=([0-9]+)", 1).cast("bigint")


# --- exports as files (S2-S4) -------------------------------------------------------

@register("telegram_files", f"""
select conv_id % {CHATS} as chat,
       row_number() over (partition by conv_id % {CHATS} order by conv_id, turn) + 1 as line_no,
       '[' || {S.TG_DATE} || '] ' || role || ': ' || {S.clean_line('text')} as text
from conversations qualify {S.clean_line('text')} <> ''
""")
def q_telegram_files(spark, sf_dir):
    """A Telegram document per chat, read by splits."""
    from parley.sources.exports import read_export
    conv = table(spark, sf_dir, "conversations").withColumn("chat", F.col("conv_id") % CHATS)
    date = F.concat(F.lit("2024-"), F.lpad((F.col("conv_id") % 12 + 1).cast("string"), 2, "0"), F.lit("-"),
                    F.lpad((F.col("turn") % 28 + 1).cast("string"), 2, "0"), F.lit("T"), F.lpad((F.col("turn") % 24).cast("string"), 2, "0"), F.lit(":00:00"))
    message = F.concat(F.lit(',\n  {"id": '), F.col("turn").cast("string"), F.lit(', "type": "message", "date": '), _json_str(date),
                       F.lit(', "from": '), _json_str(F.col("role")), F.lit(', "text": ["", {"type": "plain", "text": '), _json_str(F.col("text")), F.lit("}]}"))
    ends = conv.select("chat").distinct()
    head = ends.select("chat", F.lit(-1).cast("bigint").alias("conv_id"), F.lit(0).alias("turn"), F.lit(
        '{"name": "}{", "about": {"messages": []}, "messages": [{"type": "service", "text": "\\"}"}').alias("value"))
    tail = ends.select("chat", F.lit((1 << 62)).alias("conv_id"), F.lit(0).alias("turn"), F.lit("]}").alias("value"))
    path = _scratch(spark, "telegram")
    body = conv.select("chat", F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("int").alias("turn"), message.alias("value"))
    _write_chats(head.unionByName(body).unionByName(tail), ["conv_id", "turn"], path)
    return read_export(spark, path, "Telegram", True).select(_chat_of("source").alias("chat"), "line_no", "text")


_WA_FILE_LINES = f"""
select source % {CHATS} as source, row_number() over (partition by source % {CHATS} order by source, line_no) as line_no, text
from ({S.WA_LINES})
"""


@register("whatsapp_files", S.wa_parse(_WA_FILE_LINES).replace("select source, line_no, prefix", "select source as chat, line_no, prefix"))
def q_whatsapp_files(spark, sf_dir):
    """A WhatsApp export per chat, read by splits."""
    from parley.sources.exports import read_export
    lines = whatsapp_lines(spark, sf_dir).select((F.col("source") % CHATS).alias("chat"), "source", "line_no", F.col("text").alias("value"))
    path = _scratch(spark, "whatsapp")
    _write_chats(lines, ["source", "line_no"], path)
    return read_export(spark, path, "wa", True).select(_chat_of("source").alias("chat"), "line_no", "text")


# --- text forms that the tables do not hold by themselves (B1, B3, B4, B21, B22) -----------

_NOISY = ("replace(replace(replace(text, '. ', '.' || chr(13) || chr(10)), ', ', ',' || chr(13)), ' a', ' ' || chr(128512) || 'a')")


@register("noisy_text", f"""
select doc_id, regexp_replace(regexp_replace({S.strip_emoji(S.norm_nl(_NOISY))}, '{tx.H_SPACE}', ' ', 'g'),
                 '(?m)^[{tx.WS_CLASS_NO_NL}]+|[{tx.WS_CLASS_NO_NL}]+$', '', 'g') as text
from documents
""")
def q_noisy_text(spark, sf_dir):
    """B1, B3, B4 over documents with carriage returns and emoji put in."""
    noisy = F.col("text")
    for old, new in ((". ", ".\r\n"), (", ", ",\r"), (" a", " \U0001F600a")):
        noisy = F.replace(noisy, F.lit(old), F.lit(new))
    return table(spark, sf_dir, "documents").select("doc_id", tx.normalize_text(noisy, collapse=True, emoji=True).alias("text"))


_ROLED = ("case turn % 4 when 0 then 'YOU: ' when 1 then ' user:' when 2 then 'You:' else '' end || text || "
          "case turn % 3 when 0 then ' USER: and more' when 1 then ' you: too' else '' end")


@register("role_answers", f"select conv_id, turn, {S.clean_answer(_ROLED)} as answer from conversations")
def q_role_answers(spark, sf_dir):
    """B21, B22 over messages with role marks put in."""
    turn = F.col("turn")
    front = F.when(turn % 4 == 0, "YOU: ").when(turn % 4 == 1, " user:").when(turn % 4 == 2, "You:").otherwise("")
    back = F.when(turn % 3 == 0, " USER: and more").when(turn % 3 == 1, " you: too").otherwise("")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.clean_answer(F.concat(front, "text", back)).alias("answer"))


# --- limits ------------------------------------------------------------------------------

@register("first_half", f"""
select source, line_no, text from (select *, row_number() over (order by source, line_no) as n from ({S.CONV_MESSAGES}))
where n <= (select count(*) // 2 from ({S.CONV_MESSAGES}))
""")
def q_first_half(spark, sf_dir):
    """F4, T2 with a large N."""
    from parley.operators.retrieve import first_messages
    m = conv_messages(spark, sf_dir)
    return first_messages(m, m.count() // 2)


# --- codecs ----------------------------------------------------------------------------------

_EN_VOCAB = f"""
select c, cast(row_number() over (order by c) - 1 as integer) as id
from (select distinct c from ({S.DOC_STREAM_CHARS}) where c <> '' and source in (select doc_id from documents where lang = 'en'))
"""


def _en_chars(spark, sf_dir):
    from parley.operators import lm
    s = doc_stream(spark, sf_dir)
    en = table(spark, sf_dir, "documents").filter(F.col("lang") == "en").select(F.col("doc_id").alias("source"))
    return s, lm.vocab_list(lm.build_vocab(s.join(en, "source", "left_semi")))


@register("encode_oov_zero", f"""
with v as ({_EN_VOCAB}), e as ({S.DOC_STREAM_CHARS})
select e.source, e.line_no, count(*) as n_ids, md5(string_agg(cast(coalesce(v.id, 0) as varchar), ',' order by e.pos)) as ids_md5
from e left join v on e.c = v.c where e.c <> '' group by e.source, e.line_no
""")
def q_encode_oov_zero(spark, sf_dir):
    """Characters outside the vocabulary of the English documents become 0."""
    from parley.operators import lm
    s, chars = _en_chars(spark, sf_dir)
    e = s.select("source", "line_no", lm.encode_chars("text", chars, oov="zero").alias("ids"))
    return e.select("source", "line_no", F.size("ids").cast("long").alias("n_ids"), F.md5(F.array_join("ids", ",")).alias("ids_md5"))


@register("prompt_seed", f"""
with v as ({_EN_VOCAB}),
p as (select conv_id, turn, case when turn % 5 = 0 then '' else text end as text from conversations),
c as (select conv_id, turn, unnest(string_split(text, '')) as c, generate_subscripts(string_split(text, ''), 1) as i from p),
s as (select c.conv_id, c.turn, string_agg(cast(v.id as varchar), ',' order by c.i) as ids from c join v on v.c = c.c group by all)
select p.conv_id, p.turn, coalesce(s.ids, (select cast(id as varchar) from v where c = chr(10)), '0') as ids
from p left join s on s.conv_id = p.conv_id and s.turn = p.turn
""")
def q_prompt_seed(spark, sf_dir):
    """Prompts that cannot be encoded (every fifth is blank) become a newline."""
    from parley.operators import lm
    _s, chars = _en_chars(spark, sf_dir)
    text = F.when(F.col("turn") % 5 == 0, "").otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(lm.prompt_seed(text, chars), ",").alias("ids"))


# --- sinks --------------------------------------------------------------------------------------

@register("samples_json", "select query, n_results, result_ids from (" + REGISTRY["export_retrieval"][1] + ")")
def q_samples_json(spark, sf_dir):
    """Retrieval samples as one JSON array in ordered parts."""
    from parley.operators.retrieve import export_retrieval
    from parley.sources.exports import read_samples, write_samples
    found = export_retrieval(conv_messages(spark, sf_dir), conv_store_rows(spark, sf_dir), samples=20, k=5, seed=1337)
    path = _scratch(spark, "samples")
    write_samples(found, path, "json")
    back = read_samples(spark, path, f"query string, results {found.schema['results'].dataType.simpleString()}", "json")
    return back.select("query", F.size("results").cast("long").alias("n_results"),
                       F.array_join(F.transform("results", lambda r: r["id"]), ",").alias("result_ids"))


@register("report_file", REGISTRY["browse_report"][1])
def q_report_file(spark, sf_dir):
    """The browse report as a JSON document."""
    from parley.operators import profile
    path = _scratch(spark, "report")
    profile.write_report(profile.browse_report(C.browse_lines(doc_raw_lines(spark, sf_dir)), "both", 10, 2), path)
    rep = spark.read.json(path, multiLine=True)
    parts = [rep.select(F.lit(kind).alias("kind"), F.posexplode(kind).alias("pos", "e"))
                .select("kind", (F.col("pos") + 1).cast("int").alias("rank"), F.col("e")[label].alias("item"), F.col("e")["count"].alias("count"))
             for kind, label in (("chars", "char"), ("tokens", "token"))]
    return parts[0].unionByName(parts[1])


_EVENT = "type string, user string, answer string, used_strategy string, retrieved array<struct<text:string>>"
_EVENT_SQL = 'select \'turn\' as type, "user", answer, used_strategy, n_retrieved from (' + REGISTRY["turns_hybrid"][1] + ")"


def _events(spark, path):
    e = spark.read.text(path).select(F.from_json("value", _EVENT).alias("e")).select("e.*")
    return e.select("type", "user", "answer", "used_strategy", F.coalesce(F.size("retrieved"), F.lit(0)).cast("long").alias("n_retrieved"))


@register("turn_events", _EVENT_SQL)
def q_turn_events(spark, sf_dir):
    """Turns as JSON lines."""
    from parley.operators.reply import turns, write_turns
    path = _scratch(spark, "turns")
    write_turns(turns(conv_queries(spark, sf_dir), _conv_hits(spark, sf_dir), conv_messages(spark, sf_dir), "hybrid", "few-shot", 0.35), path)
    return _events(spark, path)


# --- hooks (R4, X1-X3) and stores (S15) ---------------------------------------------------------

@register("turns_generated", _FEWSHOT_SQL + f"""
select q.query_id, 'reply ' || cast(length(case when ctx.ctx is not null then ctx.ctx || chr(10) || chr(10) else '' end
       || 'USER: ' || q.query || chr(10) || 'YOU: ') as varchar) as answer, 'generate' as used_strategy
from ({S.CONV_QUERIES}) q left join ctx using (query_id)
""")
def q_turns_generated(spark, sf_dir):
    """A generator passed in; what it says beyond a stop string is cut."""
    from parley.operators.reply import turns
    generator = lambda prompt: F.concat(F.lit("reply "), F.char_length(prompt).cast("string"), F.lit("\nUSER: and so on"))
    t = turns(conv_queries(spark, sf_dir), _conv_hits(spark, sf_dir), conv_messages(spark, sf_dir), "generate", "few-shot", generator=generator)
    return t.select("query_id", "answer", "used_strategy")


@register("retrieve_hooks", f"""
with h as ({S.conv_hits(S.CONV_QUERIES, 12, 64)}),
r as (select *, row_number() over (partition by query_id order by length(text) desc, rank) as rr from h)
select query_id, cast(rr as integer) as rank, id, cast(length(text) as double) as rerank_score from r where rr <= 5
""")
def q_retrieve_hooks(spark, sf_dir):
    """An embedder (64 buckets) and a scorer (longest text first) passed in."""
    from parley.operators.embed import hashed_embedder
    from parley.operators.retrieve import retrieve
    hits = retrieve(conv_queries(spark, sf_dir), conv_store_rows(spark, sf_dir, 64), 5, rerank_hits=True, rerank_top_k=12,
                    embedder=hashed_embedder(64, batch=100), scorer=lambda q, text: F.char_length(text))
    return hits.select("query_id", "rank", "id", "rerank_score")


@register("store_query", f"select query_id, rank, id, round(score, 6) as score from ({S.conv_hits(S.CONV_QUERIES, 3)})")
def q_store_query(spark, sf_dir):
    """Neighbours through the store's own protocol."""
    from parley.operators.retrieve import embed_queries
    from parley.sources.store import METADATA_TYPE, open_store
    store = open_store(spark, _scratch(spark, "store"), format="chroma")
    store.ensure_version()
    rows = conv_store_rows(spark, sf_dir)
    store.add(rows.withColumn("metadata", F.lit(None).cast(METADATA_TYPE)))
    return store.query(embed_queries(conv_queries(spark, sf_dir)), k=3).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@register("store_table", f"select {_TURN_ID} as id, case when turn % 2 = 0 then text else concat(text, '!') end as text from conversations")
def q_store_table(spark, sf_dir):
    """The catalog-table backend."""
    from parley.sources.store import open_store
    rows = _turn_rows(spark, sf_dir)
    store = open_store(spark, _scratch(spark, "t").rsplit("/", 1)[1], format="Cassandra")
    store.add(rows.filter("turn % 2 = 0").drop("turn"))
    store.add(rows.withColumn("text", F.concat("text", F.lit("!"))).drop("turn"))
    return store.read().select("id", "text")


# --- pipeline and streams (P1, P3, P4, F9) -----------------------------------------------------------

@register("pipeline_counts", f"""
with m as (select text from ({S.CONV_MESSAGES})),
c as (select unnest(string_split(text || chr(10), '')) as c from m)
select (select count(*) from m) as messages, (select count(distinct text) from m) as added,
       (select count(distinct c) from c where c <> '') as vocab_size, (select cast(sum(length(text) + 1) as bigint) from m) as chars
""")
def q_pipeline_counts(spark, sf_dir):
    """The one-shot pipeline over files of messages, with its evaluation left out."""
    from parley.operators.embed import hashed_embedder
    from parley.plans.pipeline import run_pipeline
    path = _scratch(spark, "pipeline")
    conv_messages(spark, sf_dir).select((F.col("source") % CHATS).alias("chat"), F.col("text").alias("value")) \
        .repartition(CHATS, "chat").write.partitionBy("chat").text(f"{path}/in")
    r = run_pipeline(spark, f"{path}/in", "plain", f"{path}/work", embedder=hashed_embedder(16), evaluate_stage=lambda stream, n: {})
    return spark.createDataFrame([(r.messages, r.added, r.vocab_size, r.chars)], "messages long, added long, vocab_size long, chars long")


@register("stream_windows", f"""
select distinct sha1(text) || ':' || cast(start_line as varchar) || '-' || cast(end_line as varchar) as id, start_line, end_line,
       sha1(text) as content_hash from ({S.CONV_WINDOWS4})
""")
def q_stream_windows(spark, sf_dir):
    """Sliding windows over two micro-batches are those of one batch."""
    from parley.operators import ingest as ing
    from parley.operators.embed import hashed_embedder
    from parley.sources.store import ParquetStore
    from parley.streaming.streams import CORPUS_DDL, ingest_stream
    path = _scratch(spark, "stream")
    lines = conv_messages(spark, sf_dir).select(F.col("source").cast("string").alias("source"), "line_no", "text")
    store = ParquetStore(spark, f"{path}/store")
    opts = ing.IngestOptions(chunking="window", window_size=4, exact_dedupe=False)
    for n, part in enumerate(("line_no <= 3", "line_no > 3")):
        lines.filter(part).write.parquet(f"{path}/in/b{n}")
        stream = spark.readStream.schema(CORPUS_DDL).parquet(f"{path}/in/*")
        ingest_stream(stream, store, f"{path}/state", opts, hashed_embedder(8), available_now=True).awaitTermination()
    return store.read().select("id", "metadata.start_line", "metadata.end_line", "metadata.content_hash")


@register("answers_stream", f"""
select 'turn' as type, "user", answer, used_strategy, n_retrieved from ({REGISTRY['turns_hybrid'][1]})
where cast(split_part(query_id, ':', 2) as integer) % 4 <> 1
""")
def q_answers_stream(spark, sf_dir):
    """Questions as a stream; blank ones get no answer."""
    from parley.sources.store import ParquetStore
    from parley.streaming.streams import QUERY_DDL, answer_stream
    path = _scratch(spark, "answers")
    store = ParquetStore(spark, f"{path}/store")
    store.add(conv_store_rows(spark, sf_dir))
    q = conv_queries(spark, sf_dir)
    blank = F.split("query_id", ":")[1].cast("int") % 4 == 1
    q.withColumn("query", F.when(blank, "  ").otherwise(F.col("query"))).write.parquet(f"{path}/in/b0")
    stream = spark.readStream.schema(QUERY_DDL).parquet(f"{path}/in/*")
    answer_stream(stream, store, conv_messages(spark, sf_dir), f"{path}/out", f"{path}/state", available_now=True).awaitTermination()
    return _events(spark, f"{path}/out/epoch=*")
