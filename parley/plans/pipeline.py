"""One-shot pipeline (P1, X4): parse -> corpus table -> ingest -> LM corpus ->
held-out score -> retrieval for a smoke prompt.

Every stage is a keyword argument, so callers (and tests) can swap one out.
The driver only sees paths and counts; every stage writes its table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from parley.operators import ingest as ing
from parley.operators import lm
from parley.operators.retrieve import retrieve
from parley.session import ensure_checkpoint_dir
from parley.sources import exports as ex
from parley.sources.store import ParquetStore


@dataclass
class PipelineResult:
    corpus_path: str
    store_path: str
    sequences_path: str
    messages: int
    added: int
    vocab_size: int
    chars: int
    eval: dict = field(default_factory=dict)
    smoke: list = field(default_factory=list)


def _parse(spark, paths, fmt, with_metadata):
    return ex.read_export(spark, paths, fmt, with_metadata)


def _ingest(corpus, store, opts, embedder):
    return ing.ingest(corpus, store, opts, embedder).first()["added"]


def _sequences(stream, seq_len, path):
    """(vocabulary size, characters, sequence length); writes the packed sequences."""
    spark = stream.sparkSession
    offsets, total = lm.with_offsets(stream)
    seq, _small = lm.fit_seq_len(total, seq_len)
    chars = lm.vocab_list(lm.build_vocab(offsets))
    ids, n_ids = lm.encode_corpus(stream, chars)
    lm.pack_sequences(ids, n_ids, seq).write.mode("overwrite").parquet(path)
    return len(chars), total, seq


def _evaluate(stream, seq_len):
    offsets, total = lm.with_offsets(stream)
    try:
        return lm.heldout_eval(offsets, total, seq_len=seq_len).first().asDict()
    except ValueError:      # a corpus that leaves nothing to hold out
        return {}


def _smoke(spark, store, prompt, k, embedder):
    q = spark.createDataFrame([("smoke", prompt)], "query_id string, query string")
    return [r.asDict() for r in retrieve(q, store.read(), k, embedder=embedder)
            .select("rank", "id", "score", "text").orderBy("rank").collect()]


def run_pipeline(spark: SparkSession, paths, fmt: str, work_dir: str, *, with_metadata: bool = False,
                 opts: ing.IngestOptions | None = None, embedder=None, seq_len: int = 256,
                 smoke_prompt: str | None = None, k: int = 6,
                 parse: Callable = _parse, write: Callable = ex.write_corpus, ingest_stage: Callable = _ingest,
                 sequences_stage: Callable = _sequences, evaluate_stage: Callable = _evaluate,
                 smoke_stage: Callable = _smoke) -> PipelineResult:
    ensure_checkpoint_dir(spark)
    work = work_dir.rstrip("/")
    corpus_path, store_root, seq_path = f"{work}/corpus", f"{work}/store", f"{work}/sequences"
    write(parse(spark, paths, fmt, with_metadata), corpus_path)
    corpus = spark.read.parquet(corpus_path)
    messages = corpus.count()
    if messages == 0:
        raise ValueError("the corpus has no non-blank message")
    store = ParquetStore(spark, store_root, "messages")
    added = int(ingest_stage(corpus, store, opts or ing.IngestOptions(), embedder))
    stream = lm.stream_lines(corpus)
    vocab_size, total, seq = sequences_stage(stream, seq_len, seq_path)
    scored = evaluate_stage(stream, seq)
    smoke = smoke_stage(spark, store, smoke_prompt, k, embedder) if smoke_prompt else []
    return PipelineResult(corpus_path, store.path, seq_path, messages, added, vocab_size, total, scored, smoke)
