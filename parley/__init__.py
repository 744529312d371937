"""parley — message-corpus analytics as Spark DataFrame operators.

Sub-packages:

* ``parley.functions``  Column -> Column building blocks (normalising, redaction,
  hashing, SimHash, character codecs).
* ``parley.sources``    readers for chat exports and tables, sinks, the Parquet
  vector store.
* ``parley.operators``  DataFrame -> DataFrame operators (chunking, dedupe,
  profiling, embedding, retrieval, replies, language-model corpora, ingest).
* ``parley.plans``      the query catalogue over the test tables and the pipeline.
* ``parley.streaming``  Structured Streaming ingest and answering.
"""

__version__ = "0.1.0"
