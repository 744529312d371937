"""Versioned vector stores.

Layout of a Parquet store under ``root``::

    <root>/<collection>/_commits/<n>.json   commit n: schema version, data folders
    <root>/<collection>/data-<uuid>/        store rows as Parquet, written once

``store(id STRING, text STRING, embedding ARRAY<FLOAT>, metadata STRUCT<...>)``.
Every write goes to a data folder of its own and is then published by one commit record,
which holds all there is to know about a version; the highest commit is the current one.
A record is written aside and renamed to the next number, which fails if that exists:
a writer who comes second looks again at what is stored and tries the next number, so
concurrent writers lose nothing and add no id twice.  An interrupted write leaves the store
as it was.  Commits and data folders are only ever added, and a reader keeps its folders until
``vacuum`` removes those that no recent commit names.  ``add`` commits one more folder (the
anti-join reads ids only), ``upsert`` and ``rebuild`` a single fresh one.  A store whose data
lost its commits is refused, not taken for empty.  ``TableStore`` keeps the same rows in
catalog tables.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
SCHEMA_VERSION = 1
FORMATS = {"parquet": "parquet", "chroma": "parquet", "chromadb": "parquet", "chroma-db": "parquet",
           "table": "table", "catalog": "table", "cassandra": "table", "astra": "table", "astra-db": "table",
           "astradb": "table"}
# ---------------------------------------------------------------------------

META_FIELDS = [
    ("line", T.LongType()), ("start_line", T.LongType()), ("end_line", T.LongType()),
    ("chunking", T.StringType()), ("window_size", T.IntegerType()), ("source", T.StringType()),
    ("content_hash", T.StringType()), ("speaker", T.StringType()), ("timestamp", T.StringType()),
    ("start_speaker", T.StringType()), ("end_speaker", T.StringType()),
    ("start_timestamp", T.StringType()), ("end_timestamp", T.StringType()),
]
METADATA_TYPE = T.StructType([T.StructField(n, t) for n, t in META_FIELDS])
STORE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("metadata", METADATA_TYPE),
])


class StoreError(ValueError):
    pass


class Conflict(Exception):
    """Another writer committed first."""


COMMIT_TRIES = 20


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def fs_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder (none if it is missing)."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _fs_put(spark: SparkSession, folder: str, name: str, text: str) -> None:
    """Write a small file as a whole, or raise ``Conflict`` if the name is taken."""
    jvm = spark.sparkContext._jvm
    fs, target = _fs(spark, f"{folder}/{name}")
    aside = jvm.org.apache.hadoop.fs.Path(f"{folder}/.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(aside), fs.makeQualified(target), options)
    except Exception:
        fs.delete(aside, False)
        if fs.exists(target):
            raise Conflict(name) from None
        raise


class ParquetStore:
    def __init__(self, spark: SparkSession, root: str, collection: str = "messages"):
        self.spark = spark
        self.root = root.rstrip("/")
        self.collection = str(collection)
        self.path = f"{self.root}/{self.collection}"

    # --- commits ------------------------------------------------------------
    def _commits(self) -> list[int]:
        names = fs_names(self.spark, f"{self.path}/_commits")
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _entry(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/_commits/{number:020d}.json", wholetext=True).first()[0])

    def _head(self) -> dict | None:
        """The current commit, None for a store that has nothing."""
        found = self._commits()
        if found:
            return self._entry(found[-1])
        if any(n.startswith("data-") for n in fs_names(self.spark, self.path)):
            raise StoreError(f"{self.path} holds data but no commits; restore _commits, or use a new collection")
        return None

    def _commit(self, parent: dict | None, folders: list[str], schema_version: int) -> None:
        """Publish ``folders`` as the version after ``parent``, or raise ``Conflict``."""
        number = (parent["commit"] if parent else 0) + 1
        entry = {"commit": number, "collection": self.collection, "schema_version": int(schema_version), "folders": folders}
        _fs_put(self.spark, f"{self.path}/_commits", f"{number:020d}.json", json.dumps(entry))

    def _publish(self, build) -> dict:
        """Commit ``build(head) -> (folders, schema_version)``; built anew if another writer was first."""
        for _ in range(COMMIT_TRIES):
            head = self._head()
            folders, schema_version = build(head)
            try:
                self._commit(head, folders, schema_version)
                return self._entry((head["commit"] if head else 0) + 1)
            except Conflict:
                continue
        raise StoreError(f"{self.path}: other writers were first {COMMIT_TRIES} times")

    def _open(self) -> dict:
        """The current commit; a new store gets an empty first one before any data is written."""
        return self._head() or self._publish(lambda head: (head["folders"], head["schema_version"]) if head else ([], SCHEMA_VERSION))

    def _write_data(self, rows: DataFrame) -> str:
        name = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def _drop_data(self, name: str) -> None:
        fs, p = _fs(self.spark, f"{self.path}/{name}")
        fs.delete(p, True)

    def vacuum(self, keep: int = 10, older_than_hours: float = 168.0) -> list[str]:
        """Delete data folders that none of the last ``keep`` commits names and that are older
        than any reader or unfinished writer is expected to be.  Returns their names."""
        found = self._commits()[-max(1, int(keep)):]
        used = {f for n in found for f in self._entry(n)["folders"]}
        gone = []
        fs, p = _fs(self.spark, self.path)
        for status in fs.listStatus(p) if found else []:
            name = status.getPath().getName()
            if name.startswith("data-") and name not in used and status.getModificationTime() < (time.time() - older_than_hours * 3600) * 1000:
                self._drop_data(name)
                gone.append(name)
        return gone

    # S13
    def version(self) -> int | None:
        head = self._head()
        return int(head["schema_version"]) if head else None

    def set_version(self, version: int = SCHEMA_VERSION) -> None:
        self._publish(lambda head: (head["folders"] if head else [], version))

    def check_version(self, expected: int = SCHEMA_VERSION) -> None:
        cur = self.version()
        if cur is not None and int(cur) != int(expected):
            raise StoreError(f"the store has schema version: found {cur}, expected {expected}; rebuild it")

    def ensure_version(self, expected: int = SCHEMA_VERSION) -> int:
        cur = self.version()
        if cur is None:
            self.set_version(expected)
            return int(expected)
        self.check_version(expected)
        return int(cur)

    def info(self) -> dict:
        return {"schema_version": SCHEMA_VERSION, "collection": self.collection, "path": self.path,
                "found_version": self.version(), "data_version": (self._head() or {}).get("commit")}

    # --- data -----------------------------------------------------------------
    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], STORE_SCHEMA)
        return self.spark.read.schema(STORE_SCHEMA).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self) -> DataFrame:
        return self._rows((self._head() or {"folders": []})["folders"])

    # S10
    def ids(self) -> DataFrame:
        return self.read().select("id")

    @staticmethod
    def _shape(df: DataFrame) -> DataFrame:
        """Store columns and types; one row per id (the first by source, line)."""
        missing = [f.name for f in STORE_SCHEMA.fields if f.name not in df.columns]
        if missing:
            raise StoreError(f"store rows need columns {missing}")
        out = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in STORE_SCHEMA.fields])
        w = Window.partitionBy("id").orderBy(F.col("metadata.source").asc_nulls_last(),
                                             F.col("metadata.line").asc_nulls_last(), "text")
        return out.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")

    @staticmethod
    def _check(staged: DataFrame) -> None:
        bad = staged.filter(F.col("id").isNull() | F.col("text").isNull() | F.col("embedding").isNull())
        if not bad.isEmpty():
            raise StoreError("ids, texts and embeddings must have equal lengths (a row lacks one)")

    def _stage(self, rows: DataFrame) -> DataFrame:
        """Materialise rows once (embeddings are computed a single time), then check."""
        from parley.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(self.spark)
        staged = rows.checkpoint(eager=True)
        self._check(staged)
        return staged

    # S9
    def add(self, df: DataFrame, mode: str = "add") -> int:
        """Append rows; ``mode='add'`` skips ids already stored, ``'upsert'``
        replaces them.  Returns the number of rows written."""
        rows = self._shape(df)
        head = self._open()
        if mode != "upsert" and head["folders"]:
            rows = rows.join(self._rows(head["folders"]).select("id"), "id", "left_anti")
        staged, seen, written = self._stage(rows), head["commit"], 0
        if staged.isEmpty():
            return 0

        def build(now):
            nonlocal written
            if mode == "upsert":
                written = staged.count()
                kept = self._rows(now["folders"]).join(staged.select("id"), "id", "left_anti")
                return [self._write_data(kept.unionByName(staged) if now["folders"] else staged)], now["schema_version"]
            # rows of a writer who was first since the look above
            new = staged if now["commit"] == seen or not now["folders"] else staged.join(self._rows(now["folders"]).select("id"), "id", "left_anti")
            written = new.count()
            return [*now["folders"], *([self._write_data(new)] if written else [])], now["schema_version"]
        self._publish(build)
        return written

    # X3
    def query(self, queries: DataFrame, k: int = 6) -> DataFrame:
        """``queries(query_id, qvec)`` -> hits ``(query_id, rank, id, score, text, metadata)``."""
        from parley.operators.retrieve import knn
        return knn(queries, self.read(), k)

    # S14
    def rebuild(self, df: DataFrame | None, confirm: bool = False) -> int:
        """Drop this collection's rows and write ``df`` as a fresh version."""
        if not confirm:
            raise StoreError("rebuild drops every stored row; pass confirm=True")
        rows = self._stage(self._shape(df)) if df is not None else self.spark.createDataFrame([], STORE_SCHEMA)
        self._open()
        fresh = self._write_data(rows)
        self._publish(lambda head: ([fresh], SCHEMA_VERSION))     # the old folders stay for those who read them
        return rows.count()


class TableStore(ParquetStore):
    """The same store with its data in catalog tables, one per write, named after root and
    collection (their folder is the warehouse's)."""

    def __init__(self, spark: SparkSession, root: str, collection: str = "messages"):
        plain = "".join(c if c.isalnum() else "_" for c in f"{root}_{collection}").strip("_").lower()
        # names that only differ in what a table name cannot hold stay apart
        name = f"{plain}_{hashlib.sha1(f'{root}/{collection}'.encode()).hexdigest()[:8]}"
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        super().__init__(spark, f"{warehouse}/{name}_store", collection)
        self.table = name

    def _write_data(self, rows: DataFrame) -> str:
        name = super()._write_data(rows)
        self.spark.sql(f"CREATE TABLE {self.table}_{name[5:]} USING parquet LOCATION '{self.path}/{name}'")
        return name

    def _drop_data(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}_{name[5:]}")
        super()._drop_data(name)

    def _rows(self, folders: list[str]) -> DataFrame:
        out = None
        for name in folders:
            part = self.spark.table(f"{self.table}_{name[5:]}").select(*STORE_SCHEMA.names)
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], STORE_SCHEMA) if out is None else out


def store_backend(name: str) -> str:
    """Backend names and aliases."""
    v = str(name or "").strip().lower()
    if v not in FORMATS:
        raise StoreError(f"no store of kind {name!r}: parquet or table")
    return FORMATS[v]


def open_store(spark: SparkSession, path: str, collection: str = "messages", format: str = "parquet"):
    return (TableStore if store_backend(format) == "table" else ParquetStore)(spark, path, collection)
