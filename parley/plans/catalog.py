"""Query catalogue over the test tables.

Each entry is ``name -> (builder(spark, sf_dir) -> DataFrame, duckdb_sql | None)``.
Every query reads whole tables; column names are identical in both forms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.operators import profile
from parley.plans import sqlparts as S
from parley.sources import corpus as C

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, its rows over all cores.

    A row group is read by one task, however many splits its file has.  Where a table of
    fewer files than cores has its rows in fewer tasks than cores (seen from the file
    footers: the scan reads no column), they are spread round-robin; any other table is
    read as it is, without an exchange."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if len(df.inputFiles()) < cores and df.select(F.spark_partition_id().alias("task")).distinct().count() < cores:
        df = df.repartition(cores)
    return df


def doc_raw_lines(spark, sf_dir) -> DataFrame:
    return C.document_raw_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def conv_messages(spark, sf_dir) -> DataFrame:
    return C.conversation_messages(table(spark, sf_dir, "conversations"))


# --- sources and scalar projections -------------------------------------------

@register("plain_lines", f"""
select source, line_no, {S.strip('text')} as text from ({S.DOC_RAW_LINES}) where {S.strip('text')} <> ''
""")
def q_plain_lines(spark, sf_dir):
    return C.plain_lines(doc_raw_lines(spark, sf_dir))


@register("normalize_lines", f"""
select source, line_no, {S.msg_line('text')} as text from ({S.DOC_RAW_LINES}) where {S.msg_line('text')} <> ''
""")
def q_normalize_lines(spark, sf_dir):
    return C.message_lines(doc_raw_lines(spark, sf_dir))


@register("normalize_text", f"""
select doc_id,
  regexp_replace(regexp_replace({S.strip_emoji(S.norm_nl('text'))}, '{tx.H_SPACE}', ' ', 'g'),
                 '(?m)^[{tx.WS_CLASS_NO_NL}]+|[{tx.WS_CLASS_NO_NL}]+$', '', 'g') as text
from documents
""")
def q_normalize_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.normalize_text("text", collapse=True, emoji=True).alias("text"))


@register("strip_emoji", f"select doc_id, {S.strip_emoji('text')} as text from documents")
def q_strip_emoji(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.strip_emoji("text").alias("text"))


@register("clean_line", f"select conv_id, turn, {S.clean_line('text')} as text from conversations")
def q_clean_line(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.clean_line("text").alias("text"))


# --- profiling -------------------------------------------------------------------

def _sql_top(items_sql: str, label: str, top: int, min_count: int) -> str:
    return f"""
with it as ({items_sql}),
c as (select item, count(*) as cnt, min({{'s': source, 'l': line_no, 'p': pos}}) as first from it group by item)
select cast(row_number() over (order by cnt desc, first) as integer) as rank, item as {label}, cnt as count
from c where cnt >= {max(min_count, 1)} order by cnt desc, first limit {max(top, 0)}
"""


_SQL_DOC_BROWSE = f"select * from ({S.DOC_RAW_LINES}) where text <> ''"

_SQL_TOKENS = lambda lines: f"""
select source, line_no, lower(unnest(tk)) as item, generate_subscripts(tk, 1) as pos
from (select source, line_no, regexp_extract_all(text, '{S.WORD}') as tk from ({lines}))
"""
_SQL_CHARS = lambda lines: f"""
select source, line_no, unnest(ch) as item, generate_subscripts(ch, 1) as pos
from (select source, line_no, string_split(text, '') as ch from ({lines}) where text <> '')
"""


def _top_frame(counts: DataFrame, label: str, top: int, min_count: int) -> DataFrame:
    t = profile.top_items(counts, top, min_count)
    return t.select(F.col("rank").cast("int").alias("rank"), F.col("item").alias(label), "count")


@register("browse_tokens", _sql_top(_SQL_TOKENS(_SQL_DOC_BROWSE), "token", 50, 1))
def q_browse_tokens(spark, sf_dir):
    lines = C.browse_lines(doc_raw_lines(spark, sf_dir))
    return _top_frame(profile.token_counts(lines), "token", 50, 1)


@register("browse_chars", _sql_top(_SQL_CHARS(_SQL_DOC_BROWSE), "char", 50, 1))
def q_browse_chars(spark, sf_dir):
    lines = C.browse_lines(doc_raw_lines(spark, sf_dir))
    return _top_frame(profile.char_counts(lines), "char", 50, 1)


@register("browse_min_count", f"""
select item as token, count(*) as count from ({_SQL_TOKENS(S.CONV_MESSAGES)}) group by item having count(*) >= 25
""")
def q_browse_min_count(spark, sf_dir):
    counts = profile.token_counts(conv_messages(spark, sf_dir))
    return counts.filter(F.col("count") >= 25).select(F.col("item").alias("token"), "count")


# --- redaction -------------------------------------------------------------------

@register("redact_email", f"select doc_id, {S.redact_email('text')} as text from documents")
def q_redact_email(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.redact_email("text").alias("text"))


@register("redact_phone", f"select doc_id, {S.redact_phone('text')} as text from documents")
def q_redact_phone(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.redact_phone("text").alias("text"))


@register("redact_address", f"select doc_id, {S.redact_address('text')} as text from documents")
def q_redact_address(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.redact_address("text").alias("text"))


@register("redact_all", f"select doc_id, {S.redact_all('text')} as text from documents")
def q_redact_all(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.redact("text").alias("text"))


# --- inline metadata ---------------------------------------------------------------

def conv_prefixed(spark, sf_dir) -> DataFrame:
    """Conversation messages with a ``[turn] role: `` prefix."""
    conv = table(spark, sf_dir, "conversations")
    msgs = (conv.select(F.col("conv_id").alias("source"), (F.col("turn") + 1).cast("bigint").alias("line_no"),
                        "role", tx.clean_line("text").alias("text"))
                .filter(F.col("text") != ""))
    return msgs.select("source", "line_no",
                       F.concat(tx.metadata_prefix(F.col("line_no") - 1, F.col("role")), F.col("text")).alias("text"))


_m, _s, _t = S.inline_parts(S.strip("text"))


@register("inline_metadata", f"""
select source, line_no, {_m} as msg, {_s} as speaker, {_t} as timestamp from ({S.CONV_PREFIXED})
""")
def q_inline_metadata(spark, sf_dir):
    m = tx.inline_metadata("text")
    return conv_prefixed(spark, sf_dir).select("source", "line_no", m["msg"].alias("msg"),
                                               m["speaker"].alias("speaker"), m["timestamp"].alias("timestamp"))


@register("window_metadata", f"""
with p as (select source, line_no, {_m} as msg, {_s} as sp, {_t} as ts from ({S.CONV_PREFIXED})),
w as (select source, line_no as start_line,
        lead(line_no, 2) over (partition by source order by line_no) as end_line,
        [msg, lead(msg, 1) over o, lead(msg, 2) over o] as msgs,
        [sp, lead(sp, 1) over o, lead(sp, 2) over o] as sps,
        [ts, lead(ts, 1) over o, lead(ts, 2) over o] as tss
      from p window o as (partition by source order by line_no))
select source, start_line, end_line, {S.strip("array_to_string(msgs, chr(10))")} as text,
  coalesce(sps[1], sps[2], sps[3]) as speaker, coalesce(tss[1], tss[2], tss[3]) as timestamp,
  sps[1] as start_speaker, sps[3] as end_speaker, tss[1] as start_timestamp, tss[3] as end_timestamp
from w where end_line is not null
""")
def q_window_metadata(spark, sf_dir):
    from parley.operators import chunk as ch
    chunks = ch.build_chunks(conv_prefixed(spark, sf_dir), "window", 3)
    m = tx.clean_for_embedding("text")
    return chunks.select("source", "start_line", "end_line", *[m[f].alias(f) for f in (
        "text", "speaker", "timestamp", "start_speaker", "end_speaker", "start_timestamp", "end_timestamp")])


# --- chunks and hashes --------------------------------------------------------------

@register("chunk_message", f"""
select source, line_no as start_line, line_no as end_line, text, sha1(text) || ':' || cast(line_no as varchar) as id
from ({S.CONV_MESSAGES})
""")
def q_chunk_message(spark, sf_dir):
    from parley.operators import chunk as ch
    return ch.with_ids(ch.build_chunks(conv_messages(spark, sf_dir), "message"), "message")


@register("chunk_window", f"""
with w as (select source, line_no as start_line, lead(line_no, 3) over o as end_line,
             text || chr(10) || lead(text, 1) over o || chr(10) || lead(text, 2) over o || chr(10) || lead(text, 3) over o as text
           from ({S.CONV_MESSAGES}) window o as (partition by source order by line_no))
select source, start_line, end_line, text,
  sha1(text) || ':' || cast(start_line as varchar) || '-' || cast(end_line as varchar) as id
from w where end_line is not null
""")
def q_chunk_window(spark, sf_dir):
    from parley.operators import chunk as ch
    return ch.with_ids(ch.build_chunks(conv_messages(spark, sf_dir), "window", 4), "window")


@register("content_hash", "select doc_id, sha1(text) as content_hash from documents")
def q_content_hash(spark, sf_dir):
    from parley.functions import hashing as H
    return table(spark, sf_dir, "documents").select("doc_id", H.content_hash("text").alias("content_hash"))


@register("simhash", f"""
with s as ({S.simhash_sql('select doc_id, text from documents', 'doc_id', 'text')})
select k as doc_id, printf('%016x', simhash) as simhash,
  cast(simhash & 65535 as integer) as band0, cast((simhash >> 16) & 65535 as integer) as band1,
  cast((simhash >> 32) & 65535 as integer) as band2, cast((simhash >> 48) & 65535 as integer) as band3
from s
""")
def q_simhash(spark, sf_dir):
    from parley.functions import hashing as H
    d = table(spark, sf_dir, "documents").select("doc_id", H.simhash64("text").alias("h"))
    b = H.simhash_bands("h")
    return d.select("doc_id", H.simhash_hex("h").alias("simhash"), *[b[i].alias(f"band{i}") for i in range(4)])


_SQL_DOC_SH = f"""
with s as ({S.simhash_sql(f"select doc_id, text from documents where {S.strip('text')} <> ''", 'doc_id', 'text')})
select k as doc_id, simhash from s
"""


@register("near_dup_pairs", f"""
with sh as ({_SQL_DOC_SH}),
reps as (select simhash as h, min(doc_id) as node from sh group by simhash),
b as (select node, h, unnest(list_distinct({S.bands_sql('h')})) as v from reps)
select distinct x.node as a, y.node as b, cast(bit_count(xor(x.h, y.h)) as integer) as distance
from b x join b y on x.v = y.v and x.node < y.node
where bit_count(xor(x.h, y.h)) <= 6
""")
def q_near_dup_pairs(spark, sf_dir):
    from parley.functions import hashing as H
    from parley.operators import dedupe as dd
    d = table(spark, sf_dir, "documents").filter(tx.strip_ws("text") != "")
    nodes = (d.select("doc_id", H.simhash64("text").alias("simhash"))
              .groupBy("simhash").agg(F.min("doc_id").alias("node")))
    return dd.near_duplicate_pairs(nodes, "node", "simhash", 6)


@register("exact_dedupe", """
select doc_id, sha1(text) as content_hash,
  doc_id = min(doc_id) over (partition by sha1(text)) as keep
from documents
""")
def q_exact_dedupe(spark, sf_dir):
    from parley.functions import hashing as H
    from parley.operators import dedupe as dd
    d = table(spark, sf_dir, "documents").select("doc_id", H.content_hash("text").alias("content_hash"))
    return dd.exact_keep(d, "content_hash", ["doc_id"], out="keep").select("doc_id", "content_hash", "keep")


@register("fuzzy_dedupe", f"""
with recursive sh as ({_SQL_DOC_SH}),
o as (select row_number() over (order by doc_id) as i, doc_id, simhash as h from sh),
r as (select 0::bigint as i, []::ubigint[] as kept
      union all
      select o.i, case when len(list_filter(r.kept, lambda k: bit_count(xor(k, o.h)) <= 6
                  and len(list_intersect({S.bands_sql('k')}, {S.bands_sql('o.h')})) > 0)) > 0
             then r.kept else list_append(r.kept, o.h) end
      from r join o on o.i = r.i + 1),
k as (select o.doc_id from o join r on r.i = o.i join r p on p.i = o.i - 1 where len(r.kept) > len(p.kept))
select d.doc_id, d.doc_id in (select doc_id from k) as keep from documents d
""")
def q_fuzzy_dedupe(spark, sf_dir):
    from parley.functions import hashing as H
    from parley.operators import dedupe as dd
    d = table(spark, sf_dir, "documents").select("doc_id", "text", H.content_hash("text").alias("content_hash"))
    d = dd.exact_keep(d, "content_hash", ["doc_id"])
    d = dd.fuzzy_keep(d, "text", ["doc_id"], 6, eligible_col="exact_keep")
    return d.select("doc_id", (F.col("exact_keep") & F.col("fuzzy_keep")).alias("keep"))


# --- limits, samples, small projections ------------------------------------------------

@register("first_n", f"select source, line_no, text from ({S.CONV_MESSAGES}) order by source, line_no limit 100")
def q_first_n(spark, sf_dir):
    from parley.operators.retrieve import first_messages
    return first_messages(conv_messages(spark, sf_dir), 100)


@register("sample_n", f"""
select source, line_no, text from ({S.CONV_MESSAGES})
order by md5(concat_ws(':', '1337', cast(source as varchar), cast(line_no as varchar))), source, line_no limit 50
""")
def q_sample_n(spark, sf_dir):
    from parley.operators.retrieve import sample_messages
    return sample_messages(conv_messages(spark, sf_dir), 50, 1337)


@register("preview", f"""
select doc_id, case when length(p) > 140 then substr(p, 1, 137) || '...' else p end as preview
from (select doc_id, {S.strip("replace(text, chr(10), ' ')")} as p from documents)
""")
def q_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.preview("text").alias("preview"))


@register("clean_answer", f"select conv_id, turn, {S.clean_answer('text')} as answer from conversations")
def q_clean_answer(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.clean_answer("text").alias("answer"))


_STOPS = ["\n", "\nUSER:", "\nYOU:", ". "]


def _sql_stops(e: str, start: int) -> str:
    hits = ", ".join(
        f"case when instr(substr({e}, {start + 1}), {S.lit(s)}) > 0 then instr(substr({e}, {start + 1}), {S.lit(s)}) + {start} end"
        for s in _STOPS)
    return f"list_min([{hits}])"


@register("truncate_stops", f"""
select doc_id, case when {_sql_stops('text', 20)} is not null then substr(text, 1, {_sql_stops('text', 20)} - 1)
                    else text end as text
from documents
""")
def q_truncate_stops(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.truncate_at_stops(F.col("text"), 20, _STOPS).alias("text"))


@register("next_message", S.CONV_NEXT)
def q_next_message(spark, sf_dir):
    from parley.operators.reply import corpus_next
    return corpus_next(conv_messages(spark, sf_dir))


# --- embedding and retrieval ----------------------------------------------------------

def conv_store_rows(spark, sf_dir, dim: int = 384) -> DataFrame:
    """Store rows of the conversation messages (message chunks, exact dedupe)."""
    from parley.operators import ingest as ing
    from parley.operators.embed import hashed_embedder
    from parley.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    flagged = ing.flag_chunks(conv_messages(spark, sf_dir), None, ing.IngestOptions())
    # the store is a table: materialise it once, as an ingest would
    return ing.store_rows(flagged, ing.IngestOptions(), hashed_embedder(dim)).checkpoint(eager=True)


def conv_queries(spark, sf_dir) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    m = C.conversation_messages(conv)
    return m.select(F.concat_ws(":", F.col("source").cast("string"), F.col("line_no").cast("string")).alias("query_id"),
                    F.col("text").alias("query"))


@register("embed_hashed", f"""
with v as ({S.hashed_vec(f"select cast(source as varchar) || ':' || cast(line_no as varchar) as key, text from ({S.CONV_MESSAGES})", 'key', 'text')})
select k as key, bucket, round(w, 6) as value from v
""")
def q_embed_hashed(spark, sf_dir):
    from parley.operators.embed import embed
    m = conv_messages(spark, sf_dir).select(
        F.concat_ws(":", F.col("source").cast("string"), F.col("line_no").cast("string")).alias("key"), "text")
    e = embed(m, "text")
    return (e.select("key", F.posexplode("embedding").alias("bucket", "value"))
             .filter(F.col("value") != 0)
             .select("key", F.col("bucket").cast("int").alias("bucket"),
                     F.round(F.col("value").cast("double"), 6).alias("value")))


@register("knn_exact", """
with s as (select a.vec_id as query_id, b.vec_id as id,
                  list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) as score
           from embeddings a, embeddings b),
r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from s)
select query_id, cast(rank as integer) as rank, id, round(score, 6) as score from r where rank <= 6
""")
def q_knn_exact(spark, sf_dir):
    from parley.operators.retrieve import blocked_topk
    e = table(spark, sf_dir, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    c = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return blocked_topk(q, c, 6).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def _vector_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    return (e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")),
            e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label"))


@register("knn_pruned", """
with s as (select a.vec_id as query_id, b.vec_id as id,
                  list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) as score
           from embeddings a, embeddings b),
r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from s)
select query_id, cast(rank as integer) as rank, id, round(score, 6) as score from r where rank <= 6
""")
def q_knn_pruned(spark, sf_dir):
    """Exact k-NN by cells, as for query tables too large to broadcast."""
    from parley.operators.retrieve import pruned_topk
    q, c = _vector_tables(spark, sf_dir)
    return pruned_topk(q, c.drop("label"), 6).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@register("knn_approx")
def q_knn_approx(spark, sf_dir):
    """V3: cells trained on the table, probes by measured recall (random training: no twin; see
    knn_approx_given and pytest's recall)."""
    from parley.operators.retrieve import knn_approx
    q, c = _vector_tables(spark, sf_dir)
    store = c.select("id", F.col("vec").alias("embedding"))
    return knn_approx(q, store, 6).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@register("knn_approx_given", """
with c as (select label as cell, arg_min(embedding, vec_id)::DOUBLE[] as vec from embeddings group by label),
d as (select e.vec_id, c.cell, round(list_dot_product(e.embedding::DOUBLE[], c.vec), 9) as score from embeddings e, c),
o as (select *, row_number() over (partition by vec_id order by score desc, cell) as n from d),
s as (select o.vec_id as query_id, b.vec_id as id, list_dot_product(q.embedding::DOUBLE[], x.embedding::DOUBLE[]) as score
      from o join o b on b.cell = o.cell and b.n = 1 join embeddings q on q.vec_id = o.vec_id join embeddings x on x.vec_id = b.vec_id
      where o.n <= 3),
r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from s)
select query_id, cast(rank as integer) as rank, id, round(score, 6) as score from r where rank <= 6
""")
def q_knn_approx_given(spark, sf_dir):
    """V3 with given cells: the first vector of every label is a centroid, three cells are probed."""
    from parley.operators.retrieve import given_cells, knn_approx
    q, c = _vector_tables(spark, sf_dir)
    cells = given_cells(c.groupBy(F.col("label").alias("cell")).agg(F.min_by("vec", "id").alias("vec")))
    hits = knn_approx(q, c.select("id", F.col("vec").alias("embedding")), 6, nprobe=3, cells=cells)
    return hits.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@register("retrieve_topk", f"""
select query_id, rank, id, round(score, 6) as score from ({S.conv_hits(S.CONV_QUERIES, 6)})
""")
def q_retrieve_topk(spark, sf_dir):
    from parley.operators.retrieve import retrieve
    hits = retrieve(conv_queries(spark, sf_dir), conv_store_rows(spark, sf_dir), 6)
    return hits.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@register("rerank_overlap", f"""
with h as ({S.conv_hits(S.CONV_QUERIES, 20)}),
q as ({S.CONV_QUERIES}),
j as (select h.*, list_distinct(regexp_extract_all(lower(q.query), '{S.WORD}')) as a,
             list_distinct(regexp_extract_all(lower(h.text), '{S.WORD}')) as b
      from h join q using (query_id)),
s as (select *, case when len(list_distinct(list_concat(a, b))) > 0
                     then len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) else 0.0 end as rerank_score
      from j),
r as (select *, row_number() over (partition by query_id order by rerank_score desc, rank) as rr from s)
select query_id, cast(rr as integer) as rank, id, round(score, 6) as score, round(rerank_score, 6) as rerank_score
from r where rr <= 6
""")
def q_rerank_overlap(spark, sf_dir):
    from parley.operators.retrieve import retrieve
    hits = retrieve(conv_queries(spark, sf_dir), conv_store_rows(spark, sf_dir), 6, rerank_hits=True,
                    rerank_top_k=20)
    return hits.select("query_id", "rank", "id", F.round("score", 6).alias("score"),
                       F.round("rerank_score", 6).alias("rerank_score"))


_SAMPLE_Q = f"""
select cast(source as varchar) || ':' || cast(line_no as varchar) as query_id, text as query from ({S.CONV_MESSAGES})
order by md5(concat_ws(':', '1337', cast(source as varchar), cast(line_no as varchar))), source, line_no limit 20
"""


@register("export_retrieval", f"""
with h as ({S.conv_hits(_SAMPLE_Q, 5)})
select q.query_id, q.query, count(h.id) as n_results, string_agg(h.id, ',' order by h.rank) as result_ids
from ({_SAMPLE_Q}) q left join h using (query_id) group by q.query_id, q.query
""")
def q_export_retrieval(spark, sf_dir):
    from parley.operators.retrieve import export_retrieval
    ex = export_retrieval(conv_messages(spark, sf_dir), conv_store_rows(spark, sf_dir), samples=20, k=5, seed=1337)
    return ex.select("query_id", "query", F.size("results").cast("long").alias("n_results"),
                     F.array_join(F.transform("results", lambda r: r["id"]), ",").alias("result_ids"))


# --- replies ------------------------------------------------------------------------------

def _conv_hits(spark, sf_dir, k: int = 6):
    from parley.operators.retrieve import retrieve
    return retrieve(conv_queries(spark, sf_dir), conv_store_rows(spark, sf_dir), k)


_SQL_USABLE = f"""
with h as ({S.conv_hits(S.CONV_QUERIES, 6)}),
n as ({S.CONV_NEXT}),
u as (select h.*, n.next_text from h join n on n.source = h.source and n.line_no = h.line
      where n.next_text is not null)
"""


@register("corpus_reply", _SQL_USABLE + f"""
, c as (select *, {S.clean_answer('next_text')} as reply from u where score >= 0.35),
f as (select * from c where reply <> '' and reply <> {S.clean_answer('text')}),
b as (select *, row_number() over (partition by query_id order by score desc, rank) as r from f)
select query_id, reply, round(score, 6) as reply_score from b where r = 1
""")
def q_corpus_reply(spark, sf_dir):
    from parley.operators.reply import corpus_reply
    r = corpus_reply(_conv_hits(spark, sf_dir), conv_messages(spark, sf_dir), "hybrid", 0.35)
    return r.select("query_id", "reply", F.round("reply_score", 6).alias("reply_score"))


_FEWSHOT_SQL = _SQL_USABLE + f"""
, e as (select query_id, rank, {S.clean_answer('text')} as u, {S.clean_answer('next_text')} as a from u where rank <= 6),
e2 as (select *, row_number() over (partition by query_id order by rank) as n from e where u <> '' and a <> ''),
ctx as (select query_id, string_agg('USER: ' || u || chr(10) || 'YOU: ' || a, chr(10) || chr(10) order by rank) as ctx
        from e2 where n <= 3 group by query_id)
"""


def _sql_prompt(template: str) -> str:
    if template == "minimal":
        return f"select query_id, 'USER: ' || query || chr(10) || 'YOU: ' as prompt from ({S.CONV_QUERIES})"
    if template == "scaffold":
        return (f"select query_id, 'This is a chat. Reply as YOU. Keep it short.' || chr(10) || chr(10) || "
                f"'USER: ' || query || chr(10) || 'YOU: ' as prompt from ({S.CONV_QUERIES})")
    return _FEWSHOT_SQL + f"""
select q.query_id, case when ctx.ctx is not null then ctx.ctx || chr(10) || chr(10) else '' end
       || 'USER: ' || q.query || chr(10) || 'YOU: ' as prompt
from ({S.CONV_QUERIES}) q left join ctx using (query_id)
"""


def _prompt_query(template: str):
    def build(spark, sf_dir):
        from parley.operators.reply import build_prompt
        hits = _conv_hits(spark, sf_dir) if template == "few-shot" else None
        return build_prompt(conv_queries(spark, sf_dir), hits, conv_messages(spark, sf_dir), template)
    return build


register("prompt_minimal", _sql_prompt("minimal"))(_prompt_query("minimal"))
register("prompt_scaffold", _sql_prompt("scaffold"))(_prompt_query("scaffold"))
register("prompt_fewshot", _sql_prompt("few-shot"))(_prompt_query("few-shot"))


@register("turns_hybrid", _FEWSHOT_SQL + f"""
, c as (select *, {S.clean_answer('next_text')} as reply from u where score >= 0.35),
f as (select * from c where reply <> '' and reply <> {S.clean_answer('text')}),
b as (select query_id, reply from (select *, row_number() over (partition by query_id order by score desc, rank) as r
                                   from f) where r = 1),
hc as (select query_id, count(*) as n_retrieved from h group by query_id)
select q.query_id, q.query as "user",
       case when b.reply is not null then {S.clean_answer('b.reply')} end as answer,
       case when b.reply is not null then 'corpus' else 'generate' end as used_strategy,
       case when b.reply is null then
         case when ctx.ctx is not null then ctx.ctx || chr(10) || chr(10) else '' end
         || 'USER: ' || q.query || chr(10) || 'YOU: ' end as prompt,
       coalesce(hc.n_retrieved, 0) as n_retrieved
from ({S.CONV_QUERIES}) q left join b using (query_id) left join ctx using (query_id) left join hc using (query_id)
""")
def q_turns_hybrid(spark, sf_dir):
    from parley.operators.reply import turns
    t = turns(conv_queries(spark, sf_dir), _conv_hits(spark, sf_dir), conv_messages(spark, sf_dir),
              "hybrid", "few-shot", 0.35)
    return t.select("query_id", "user", "answer", "used_strategy", "prompt",
                    F.coalesce(F.size("retrieved"), F.lit(0)).cast("long").alias("n_retrieved"))


# --- language-model corpora ---------------------------------------------------------------

def doc_stream(spark, sf_dir) -> DataFrame:
    from parley.operators import lm
    return lm.stream_lines(doc_raw_lines(spark, sf_dir))


@register("vocab", f"select c as char, id from ({S.DOC_VOCAB})")
def q_vocab(spark, sf_dir):
    from parley.operators import lm
    return lm.build_vocab(doc_stream(spark, sf_dir))


@register("encode", f"""
with v as ({S.DOC_VOCAB}), e as ({S.DOC_STREAM_CHARS})
select e.source, e.line_no, count(*) as n_ids, md5(string_agg(cast(v.id as varchar), ',' order by e.pos)) as ids_md5
from e join v on e.c = v.c group by e.source, e.line_no
""")
def q_encode(spark, sf_dir):
    from parley.operators import lm
    s = doc_stream(spark, sf_dir)
    chars = lm.vocab_list(lm.build_vocab(s))
    e = s.select("source", "line_no", lm.encode_chars("text", chars).alias("ids"))
    return e.select("source", "line_no", F.size("ids").cast("long").alias("n_ids"),
                    F.md5(F.array_join("ids", ",")).alias("ids_md5"))


@register("decode", f"select source, line_no, text from ({S.DOC_STREAM})")
def q_decode(spark, sf_dir):
    from parley.operators import lm
    s = doc_stream(spark, sf_dir)
    chars = lm.vocab_list(lm.build_vocab(s))
    e = s.select("source", "line_no", lm.encode_chars("text", chars).alias("ids"))
    return e.select("source", "line_no", lm.decode_ids("ids", chars).alias("text"))


@register("oov_count", f"""
with en as (select distinct c from ({S.DOC_STREAM_CHARS}) where source in (select doc_id from documents where lang = 'en')),
a as (select c from ({S.DOC_STREAM_CHARS}) where c <> '')
select count(*) filter (where c not in (select c from en)) as oov_chars, count(*) as total_chars from a
""")
def q_oov_count(spark, sf_dir):
    from parley.operators import lm
    s = doc_stream(spark, sf_dir)
    en_ids = table(spark, sf_dir, "documents").filter(F.col("lang") == "en").select(F.col("doc_id").alias("source"))
    chars = lm.vocab_list(lm.build_vocab(s.join(en_ids, "source", "left_semi")))
    return s.agg(F.sum(lm.oov_count("text", chars)).cast("long").alias("oov_chars"),
                 F.sum(F.char_length("text")).cast("long").alias("total_chars"))


@register("pairs_corpus", f"""
with m as (select source, line_no, text from ({S.CONV_MESSAGES})),
l as (select source, line_no, text, lead(text) over (partition by source order by line_no) as nxt,
             count(*) over (partition by source) as n from m)
select source, line_no, 'USER: ' || text || chr(10) || 'YOU: ' || nxt || chr(10) || chr(10) as block
from l where nxt is not null
union all
select source, min(line_no) as line_no, 'USER: ' || chr(10) || 'YOU: ' || chr(10) as block
from l where n < 2 group by source
""")
def q_pairs_corpus(spark, sf_dir):
    from parley.operators import lm
    return lm.pairs_corpus(conv_messages(spark, sf_dir))


def _sql_seq_len(n: str, seq: int = 256) -> str:
    mr = f"greatest(16, {n} // 8)"
    return f"(case when {seq} > {mr} then greatest(16, least({seq}, {mr})) else {seq} end)"


@register("tail_split", f"""
with s as ({S.DOC_STREAM}), t as (select cast(sum(length(text)) as bigint) as n from s),
p as (select n, cast(floor(n * 0.05) as bigint) as v0, {_sql_seq_len('n')} as seq from t),
b as (select n, case when v0 < seq + 2 then 0 else v0 end as val from p)
select s.source, s.line_no, s."offset", cast(length(s.text) as bigint) as length,
       cast(least(length(s.text), greatest(0, (b.n - b.val) - s."offset")) as bigint) as train_chars,
       cast(length(s.text) - least(length(s.text), greatest(0, (b.n - b.val) - s."offset")) as bigint) as val_chars
from s, b
""")
def q_tail_split(spark, sf_dir):
    from parley.operators import lm
    s, total = lm.with_offsets(doc_stream(spark, sf_dir))
    seq, _warn = lm.fit_seq_len(total, 256)
    out, _val = lm.tail_split(s, total, 0.05, seq)
    return out.select("source", "line_no", "offset", "length", "train_chars", "val_chars")


@register("lm_meta", f"""
with s as ({S.DOC_STREAM}), t as (select cast(sum(length(text)) as bigint) as n from s),
p as (select n, cast(floor(n * 0.05) as bigint) as v0, cast({_sql_seq_len('n')} as bigint) as seq from t),
b as (select n, seq, case when v0 < seq + 2 then 0 else v0 end as val from p)
select n as chars_total, n - val as chars_train, val as chars_val,
       (select count(*) from ({S.DOC_VOCAB})) as vocab_size, seq as seq_len from b
""")
def q_lm_meta(spark, sf_dir):
    from parley.operators import lm
    s, total = lm.with_offsets(doc_stream(spark, sf_dir))
    seq, _warn = lm.fit_seq_len(total, 256)
    _f, val = lm.tail_split(s, total, 0.05, seq)
    vsize = lm.build_vocab(s).count()
    meta = lm.corpus_meta(total, total - val, val, vsize, seq)
    return spark.createDataFrame([tuple(meta.values())],
                                 "chars_total long, chars_train long, chars_val long, vocab_size long, seq_len long")


def _doc_id_lines(spark, sf_dir):
    from parley.operators import lm
    s = doc_stream(spark, sf_dir)
    chars = lm.vocab_list(lm.build_vocab(s))
    return lm.encode_corpus(s, chars)


@register("pack_sequences", f"""
with v as ({S.DOC_VOCAB}), e as ({S.DOC_STREAM_CHARS}),
f as (select e.pos as p, v.id from e join v on e.c = v.c),
n as (select (count(*) - 1) // 64 as n from f),
x as (select p // 64 as seq_id, string_agg(cast(id as varchar), ',' order by p) as x from f
      where p < (select n from n) * 64 group by 1),
y as (select (p - 1) // 64 as seq_id, string_agg(cast(id as varchar), ',' order by p) as y from f
      where p >= 1 and p <= (select n from n) * 64 group by 1)
select x.seq_id, x.x, y.y from x join y using (seq_id)
""")
def q_pack_sequences(spark, sf_dir):
    from parley.operators import lm
    ids, total = _doc_id_lines(spark, sf_dir)
    seqs = lm.pack_sequences(ids, total, 64)
    return seqs.select("seq_id", F.array_join("x", ",").alias("x"), F.array_join("y", ",").alias("y"))


@register("sample_sequences", f"""
with v as ({S.DOC_VOCAB}), e as ({S.DOC_STREAM_CHARS}),
f as (select e.pos as p, v.id from e join v on e.c = v.c),
m as (select count(*) - 65 as max_start from f),
s as (select i as seq_id, cast((('0x' || substr(md5('1337:' || cast(i as varchar)), 1, 15))::ubigint
                                 % (select max_start from m)) as bigint) as start
      from range(256) r(i)),
w as (select s.seq_id, f.p - s.start as j, f.id from s join f on f.p >= s.start and f.p <= s.start + 64)
select seq_id, string_agg(cast(id as varchar), ',' order by j) filter (where j < 64) as x,
       string_agg(cast(id as varchar), ',' order by j) filter (where j >= 1) as y
from w group by seq_id
""")
def q_sample_sequences(spark, sf_dir):
    from parley.operators import lm
    ids, total = _doc_id_lines(spark, sf_dir)
    seqs = lm.sample_sequences(ids, total, 256, 64, seed=1337)
    return seqs.select("seq_id", F.array_join("x", ",").alias("x"), F.array_join("y", ",").alias("y"))


@register("heldout_ngram", f"""
with r as (select source, line_no, pos, c,
                  substr(chr(10) || chr(10) || text, i, 2) as ctx
           from (select source, line_no, "offset" + generate_subscripts(cs, 1) - 1 as pos, unnest(cs) as c,
                        generate_subscripts(cs, 1) as i, text
                 from (select source, line_no, "offset", text, string_split(text, '') as cs from ({S.DOC_STREAM})))
           where c <> ''),
t as (select count(*) as n from r),
b as (select n, cast(floor(n * 0.05) as bigint) as held from t),
v as (select distinct c from r, b where pos < b.n - b.held),
fc as (select min(c) as fc from v),
oov as (select count(*) as oov from r where c not in (select c from v)),
m as (select pos,
             case when c in (select c from v) then c else (select fc from fc) end as c,
             (case when substr(ctx, 1, 1) in (select c from v) then substr(ctx, 1, 1) else (select fc from fc) end) ||
             (case when substr(ctx, 2, 1) in (select c from v) then substr(ctx, 2, 1) else (select fc from fc) end) as ctx
      from r),
tr as (select m.* from m, b where pos < b.n - b.held),
te as (select m.* from m, b where pos >= b.n - b.held),
cc as (select ctx, c, count(*) as n_cc from tr group by all),
cx as (select ctx, count(*) as n_c from tr group by all),
sc as (select (coalesce(cc.n_cc, 0) + 0.1) / (coalesce(cx.n_c, 0) + 0.1 * (select count(*) from v)) as p
       from te left join cc using (ctx, c) left join cx using (ctx)),
l as (select avg(-ln(p)) as loss from sc)
select (select held from b) as heldout_chars, (select oov from oov) as oov_chars,
       round(loss, 6) as loss, round(exp(loss), 6) as perplexity from l
""")
def q_heldout_ngram(spark, sf_dir):
    from parley.operators import lm
    s, total = lm.with_offsets(doc_stream(spark, sf_dir))
    ev = lm.heldout_eval(s, total, order=3, alpha=0.1, heldout_fraction=0.05, seq_len=256)
    return ev.select("heldout_chars", "oov_chars", F.round("loss", 6).alias("loss"),
                     F.round("perplexity", 6).alias("perplexity"))


# --- chat exports ---------------------------------------------------------------------------

def whatsapp_lines(spark, sf_dir) -> DataFrame:
    """The conversations rendered as WhatsApp export lines (one source per conversation):
    a system line, a header per turn with its first line, continuation lines, and a
    ``<Media omitted>`` line after every fifth turn."""
    from parley.operators.order import running_sum
    conv = table(spark, sf_dir, "conversations")
    day = F.concat_ws("/", (F.col("conv_id") % 12 + 1).cast("string"), (F.col("turn") % 28 + 1).cast("string"), F.lit("24"))
    tm = F.concat((F.col("turn") % 12 + 1).cast("string"), F.lit(":"), F.lpad(((F.col("turn") * 7) % 60).cast("string"), 2, "0"),
                  F.when(F.col("turn") % 2 == 0, F.lit(" AM")).otherwise(F.lit(" PM")))
    media = (F.col("turn") % 5 == 4)
    t = conv.select("conv_id", "turn", "role", day.alias("d"), tm.alias("tm"),
                    F.split(tx.normalize_newlines("text"), "\n", -1).alias("ls"))
    t = t.withColumn("n", F.size("ls") + F.when(media, 1).otherwise(0))
    t = running_sum(t, ["conv_id"], "n", "cum", order="turn").withColumn("start", F.col("cum") - F.col("n") + 2)
    head = F.concat(F.col("d"), F.lit(", "), F.col("tm"), F.lit(" - "), F.col("role"), F.lit(": "))
    body = t.select(F.col("conv_id").alias("source"), "start", head.alias("head"), F.posexplode("ls").alias("i", "l")) \
        .select("source", (F.col("start") + F.col("i")).cast("bigint").alias("line_no"),
                F.when(F.col("i") == 0, F.concat("head", "l")).otherwise(F.col("l")).alias("text"))
    med = t.filter(media).select(F.col("conv_id").alias("source"), (F.col("start") + F.size("ls")).cast("bigint").alias("line_no"),
                                 F.concat(head, F.lit("<Media omitted>")).alias("text"))
    sysl = conv.select(F.col("conv_id").alias("source")).distinct().select(
        "source", F.lit(1).cast("bigint").alias("line_no"),
        F.lit("1/1/24, 9:00 AM - Messages and calls are end-to-end encrypted.").alias("text"))
    return body.unionByName(med).unionByName(sysl)


@register("whatsapp_parse", S.wa_parse(S.WA_LINES))
def q_whatsapp_parse(spark, sf_dir):
    from parley.sources.exports import parse_whatsapp
    return parse_whatsapp(whatsapp_lines(spark, sf_dir), with_metadata=True)


def _json_str(c) -> F.Column:
    """A JSON string literal of ``c`` (quotes and escapes included)."""
    j = F.to_json(F.array(c))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def telegram_docs(spark, sf_dir) -> DataFrame:
    """The conversations rendered as Telegram JSON exports, one document per
    conversation: a service message, then one message per turn whose text is a
    string (even turns) or a list of a string and a ``{type, text}`` fragment."""
    conv = table(spark, sf_dir, "conversations")
    date = F.concat(F.lit("2024-"), F.lpad((F.col("conv_id") % 12 + 1).cast("string"), 2, "0"), F.lit("-"),
                    F.lpad((F.col("turn") % 28 + 1).cast("string"), 2, "0"), F.lit("T"),
                    F.lpad((F.col("turn") % 24).cast("string"), 2, "0"), F.lit(":00:00"))
    half = (F.char_length("text") / 2).cast("int")
    rich = F.concat(F.lit("["), _json_str(F.substring("text", F.lit(1), half)), F.lit(',{"type":"bold","text":'),
                    _json_str(F.expr("substring(text, cast(char_length(text) / 2 as int) + 1)")), F.lit("}]"))
    txt = F.when(F.col("turn") % 2 == 0, _json_str(F.col("text"))).otherwise(rich)
    msg = F.concat(F.lit('{"id":'), (F.col("turn") + 1).cast("string"), F.lit(',"type":"message","date":'),
                   _json_str(date), F.lit(',"from":'), _json_str(F.col("role")), F.lit(',"text":'), txt, F.lit("}"))
    msgs = conv.select("conv_id", "turn", msg.alias("m"))
    docs = msgs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "m"))).alias("ms"))
    service = '{"id":0,"type":"service","action":"create_group","text":""}'
    return docs.select(F.col("conv_id").alias("source"), F.concat(
        F.lit('{"name":"Conversation","type":"personal_chat","messages":[' + service + ","),
        F.array_join(F.transform("ms", lambda s: s["m"]), ","), F.lit("]}")).alias("json"))


@register("telegram_parse", f"""
select conv_id as source, cast(turn + 2 as bigint) as line_no,
       '[' || {S.TG_DATE} || '] ' || role || ': ' || {S.clean_line('text')} as text
from conversations where {S.clean_line('text')} <> ''
""")
def q_telegram_parse(spark, sf_dir):
    from parley.sources.exports import parse_telegram
    return parse_telegram(telegram_docs(spark, sf_dir), with_metadata=True)


# --- ingest --------------------------------------------------------------------------------

@register("ingest_dry_run", f"""
with recursive ch as ({S.CONV_WINDOWS4}),
ex as (select *, row_number() over (partition by sha1(text) order by source, start_line) = 1 as exact_keep from ch),
el as (select row_number() over (order by source, start_line) as i, source, start_line, text
       from ex where exact_keep and {S.strip('text')} <> ''),
sh as ({S.simhash_sql('select i, text from el', 'i', 'text')}),
{S.greedy_sql('select el.i, sh.simhash as h from el join sh on sh.k = el.i')},
fl as (select ex.*, exact_keep and el.i is not null and el.i in (select i from gk) as keep
       from ex left join el using (source, start_line))
select (select count(*) from ({S.CONV_MESSAGES})) as messages, count(*) as chunks,
       count(*) filter (where keep) as kept, count(*) - count(*) filter (where keep) as skip_dedupe,
       0::bigint as skip_existing, count(*) filter (where keep) as would_add,
       count(*) filter (where keep) - count(*) filter (where keep) - 0 as skip_other,
       round(1.0 - (count(*) filter (where keep)) / count(*), 6) as dedupe_rate
from fl
""")
def q_ingest_dry_run(spark, sf_dir):
    from parley.operators import ingest as ing
    msgs = conv_messages(spark, sf_dir)
    opts = ing.IngestOptions(chunking="window", window_size=4, exact_dedupe=True, fuzzy_dedupe=True)
    s = ing.ingest_summary(ing.flag_chunks(msgs, None, opts), msgs)
    return s.select("messages", "chunks", "kept", "skip_dedupe", "skip_existing", "would_add", "skip_other",
                    "dedupe_rate")


@register("ingest_chunks", f"""
with ch as (select source, line_no as start_line, line_no as end_line, text from ({S.CONV_MESSAGES})),
r as (select *, {S.redact_all('text')} as red from ch)
select source, start_line, end_line, sha1(text) || ':' || cast(end_line as varchar) as id, sha1(red) as content_hash,
       row_number() over (partition by sha1(red) order by source, start_line) = 1 as keep
from r
""")
def q_ingest_chunks(spark, sf_dir):
    from parley.operators import ingest as ing
    opts = ing.IngestOptions(chunking="message", redact=True)
    f = ing.flag_chunks(conv_messages(spark, sf_dir), None, opts)
    return f.select("source", "start_line", "end_line", "id", "content_hash", "keep")


@register("anti_existing_ids", f"""
with m as ({S.CONV_MESSAGES}),
st as (select sha1(text) || ':' || cast(line_no as varchar) as id, sha1(text) as content_hash from m where role = 'assistant'),
ch as (select source, line_no as start_line, sha1(text) || ':' || cast(line_no as varchar) as id, sha1(text) as h from m),
ex as (select *, row_number() over (partition by h order by source, start_line) = 1
                 and h not in (select content_hash from st) as exact_keep from ch)
select source, start_line, id, id in (select id from st) as existing,
       exact_keep and id not in (select id from st) as "add"
from ex
""")
def q_anti_existing_ids(spark, sf_dir):
    from parley.functions import hashing as H
    from parley.operators import ingest as ing
    conv = table(spark, sf_dir, "conversations")
    msgs = conv_messages(spark, sf_dir)
    asst = C.conversation_messages(conv.filter(F.col("role") == "assistant"))
    stored = asst.select(H.stable_id("text", "line_no").alias("id"), H.content_hash("text").alias("content_hash"))
    f = ing.flag_chunks(msgs, None, ing.IngestOptions(), stored=stored)
    return f.select("source", "start_line", "id", "existing", "add")


@register("anti_existing_hash", f"""
with l as (select source, line_no, {S.msg_line('text')} as text from ({S.DOC_RAW_LINES}) where {S.msg_line('text')} <> ''),
st as (select sha1(text) || ':' || cast(line_no as varchar) as id, sha1(text) as content_hash
       from l where source in (select doc_id from documents where lang = 'en')),
ch as (select source, line_no as start_line, sha1(text) || ':' || cast(line_no as varchar) as id, sha1(text) as h from l),
ex as (select *, row_number() over (partition by h order by source, start_line) = 1
                 and h not in (select content_hash from st) as exact_keep from ch)
select source, start_line, exact_keep, id in (select id from st) as existing,
       exact_keep and id not in (select id from st) as "add"
from ex
""")
def q_anti_existing_hash(spark, sf_dir):
    from parley.functions import hashing as H
    from parley.operators import ingest as ing
    lines = C.message_lines(doc_raw_lines(spark, sf_dir))
    en = table(spark, sf_dir, "documents").filter(F.col("lang") == "en").select(F.col("doc_id").alias("source"))
    stored = lines.join(en, "source", "left_semi").select(H.stable_id("text", "line_no").alias("id"),
                                                          H.content_hash("text").alias("content_hash"))
    f = ing.flag_chunks(lines, None, ing.IngestOptions(), stored=stored)
    return f.select("source", "start_line", "exact_keep", "existing", "add")


# --- more report shapes ---------------------------------------------------------------------

@register("browse_report", f"""
select 'chars' as kind, rank, "char" as item, count from ({_sql_top(_SQL_CHARS(_SQL_DOC_BROWSE), 'char', 10, 2)})
union all
select 'tokens' as kind, rank, token as item, count from ({_sql_top(_SQL_TOKENS(_SQL_DOC_BROWSE), 'token', 10, 2)})
""")
def q_browse_report(spark, sf_dir):
    rep = profile.browse_report(C.browse_lines(doc_raw_lines(spark, sf_dir)), "both", 10, 2)
    parts = []
    for kind, label in (("chars", "char"), ("tokens", "token")):
        parts.append(rep.select(F.lit(kind).alias("kind"), F.posexplode(kind).alias("pos", "e"))
                        .select("kind", (F.col("pos") + 1).cast("int").alias("rank"),
                                F.col("e")[label].alias("item"), F.col("e")["count"].alias("count")))
    return parts[0].unionByName(parts[1])


@register("stream_corpus", f"""
select source, line_no, {S.redact_all('text')} || chr(10) as text from ({S.DOC_RAW_LINES})
""")
def q_stream_corpus(spark, sf_dir):
    from parley.operators import lm
    return lm.stream_lines(doc_raw_lines(spark, sf_dir), redact=True)


@register("ingest_examples", f"""
select start_line, end_line, text from ({S.CONV_WINDOWS4})
qualify row_number() over (partition by sha1(text) order by source, start_line) = 1
order by source, start_line limit 5
""")
def q_ingest_examples(spark, sf_dir):
    from parley.operators import ingest as ing
    opts = ing.IngestOptions(chunking="window", window_size=4)
    return ing.ingest_examples(ing.flag_chunks(conv_messages(spark, sf_dir), None, opts), 5)


@register("label_centroid_cosine", """
with ex as (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as pos from embeddings),
c as (select label, list(m order by pos) as cent
      from (select label, pos, avg(x::DOUBLE) as m from ex group by all) group by label)
select e.vec_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], c.cent), 6) as cosine
from embeddings e join c using (label)
""")
def q_label_centroid_cosine(spark, sf_dir):
    """Each vector's cosine similarity to the mean vector of its label.
    Centroids come from a partial aggregate per (label, dimension), so a label
    holding a third of all rows costs one row per partition and dimension."""
    from parley.operators.retrieve import cosine
    e = table(spark, sf_dir, "embeddings")
    per_dim = (e.select("label", F.posexplode("embedding").alias("pos", "x"))
                .groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m")))
    cent = (per_dim.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("_c"))
                   .select("label", F.transform("_c", lambda s: s["m"]).alias("cent")))
    return (e.join(cent, "label")
             .select("vec_id", "label", F.round(cosine("embedding", "cent"), 6).alias("cosine")))


# --- store, sinks (written to the shared checkpoint folder, then read back) -------

def _scratch(spark, label: str) -> str:
    import uuid

    from parley.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _turn_rows(spark, sf_dir) -> DataFrame:
    """Conversation turns as store rows with a one-number embedding."""
    from parley.sources.store import METADATA_TYPE
    t = table(spark, sf_dir, "conversations")
    return t.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text",
                    F.array(F.length("text").cast("float")).alias("embedding"),
                    F.lit(None).cast(METADATA_TYPE).alias("metadata"), "turn")


_TURN_ID = "concat(cast(conv_id as varchar), ':', cast(turn as varchar))"


@register("store_add", f"select {_TURN_ID} as id, case when turn % 2 = 0 then text else concat(text, '!') end as text from conversations")
def q_store_add(spark, sf_dir):
    """Ids that are stored already are not added again."""
    from parley.sources.store import ParquetStore
    rows, store = _turn_rows(spark, sf_dir), ParquetStore(spark, _scratch(spark, "store"))
    store.add(rows.filter("turn % 2 = 0").drop("turn"))
    store.add(rows.withColumn("text", F.concat("text", F.lit("!"))).drop("turn"))
    return store.read().select("id", "text")


@register("store_upsert", f"select {_TURN_ID} as id, case when turn % 3 = 0 then concat(text, '!') else text end as text from conversations")
def q_store_upsert(spark, sf_dir):
    """Stored ids are replaced."""
    from parley.sources.store import ParquetStore
    rows, store = _turn_rows(spark, sf_dir), ParquetStore(spark, _scratch(spark, "store"))
    store.add(rows.drop("turn"))
    store.add(rows.filter("turn % 3 = 0").withColumn("text", F.concat("text", F.lit("!"))).drop("turn"), mode="upsert")
    return store.read().select("id", "text")


@register("store_rebuild", f"select {_TURN_ID} as id, text, 1 as schema_version from conversations where turn < 2")
def q_store_rebuild(spark, sf_dir):
    """A rebuild leaves the new rows only, under the current schema version."""
    from parley.sources.store import ParquetStore
    rows, store = _turn_rows(spark, sf_dir), ParquetStore(spark, _scratch(spark, "store"))
    store.add(rows.drop("turn"))
    store.rebuild(rows.filter("turn < 2").drop("turn"), confirm=True)
    return store.read().select("id", "text", F.lit(store.version()).alias("schema_version"))


@register("ingest_twice", f"""
with m as ({S.CONV_MESSAGES}), c as (select count(*) as n, count(distinct text) as d from m)
select 1 as run, n as messages, d as added from c union all select 2, n, 0 from c
""")
def q_ingest_twice(spark, sf_dir):
    """A second ingest of the same corpus adds nothing."""
    from parley.operators import ingest as ing
    from parley.operators.embed import hashed_embedder
    from parley.sources.store import ParquetStore
    store, corpus = ParquetStore(spark, _scratch(spark, "store")), conv_messages(spark, sf_dir)
    runs = [ing.ingest(corpus, store, embedder=hashed_embedder(16)).withColumn("run", F.lit(i)) for i in (1, 2)]
    return runs[0].unionByName(runs[1]).select("run", "messages", "added")


@register("corpus_sink", f"select source, line_no, text from ({S.CONV_MESSAGES})")
def q_corpus_sink(spark, sf_dir):
    """The canonical corpus written and read back."""
    from parley.sources import exports
    path = _scratch(spark, "corpus")
    exports.write_corpus(table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("source"), (F.col("turn") + 1).cast("bigint").alias("line_no"), "text"), path)
    return spark.read.parquet(path).select("source", "line_no", "text")
