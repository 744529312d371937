"""Secret scans with an incremental blob ledger.

Every version of every path is content-addressed (SHA-256 of the text).  The ledger in
shared storage records which (blob, rule version) pairs were scanned and what was found;
a scan reads only blobs for which a pair is missing, adds the new results, and joins all
findings of the current rule versions back to all paths that hold the blob.

The ledger is two folders of Parquet parts, ``findings/run=...`` and ``scans/run=...``.
Parts are only ever added, a run's scans last: an interrupted run leaves findings without
scans, which nobody reads, and its pairs are scanned again.  While texts are hashed, those
that hold no anchor of any rule (a string that every match of the rule contains) are told
apart; their text is not shuffled, and they are entered as scanned without findings.

Defined cases: null and empty texts have no findings; equal texts are one blob, scanned
once, and every path gets the findings; paths may repeat; other columns are ignored; an
empty table gives no rows and an empty entry.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.llm.common import checked_broadcast, found_spans, let, materialise


@dataclass(frozen=True)
class Rule:
    """A match of ``pattern`` counts if ``accept`` holds for the matched string; every
    match contains a match of ``anchor``."""
    kind: str
    version: int
    pattern: str
    anchor: str
    accept: object

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# --- fixed values: patterns of the three base kinds ----------------------------
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
# -------------------------------------------------------------------------------

BROADCAST_BLOBS = 100_000    # blobs with findings, span lists of some hundred bytes, in one broadcast
BASE_KINDS = ("assign", "access", "hex")
RULES = (
    Rule("assign", 1, ASSIGN, r"(?i:passw|secret|token|api_?key)", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
    Rule("access", 1, ACCESS, r"AKIA[A-Z0-9]{16}", lambda m: F.length(m) >= 20),
    # a run of 24 or more from its start: the same as all runs, short ones dropped
    Rule("hex", 1, r"[0-9a-f]{24,}+", r"[0-9a-f]{24}", lambda m: F.lit(True)),
    # with its body, to the end line or as far as what may stand in a body goes
    Rule("private_key", 2, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----[A-Za-z0-9+/=,:\s]*+(?:-(?!----)[A-Za-z0-9+/=,:\s]*+)*+"
                           r"(?:-----END (?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----)?",
         r"PRIVATE KEY(?: BLOCK)?-----", lambda m: F.lit(True)),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", r"eyJ[A-Za-z0-9_-]{8}", lambda m: F.lit(True)),
    Rule("issued", 1, r"(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,})",
         r"(?:gh[pousr]_|xox[abprs]-|sk_live_|AIza)", lambda m: F.lit(True)),
    Rule("url_password", 1, r"://[^\x00-\x20/:@]{1,64}:[^\x00-\x20/:@]{3,64}@", r"://", lambda m: F.lit(True)),
)
SCANS = T.StructType([T.StructField("blob", T.StringType()), T.StructField("rule", T.StringType())])
FINDINGS = T.StructType([T.StructField("blob", T.StringType()), T.StructField("rule", T.StringType()),
                         T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                         T.StructField("end", T.LongType())])


class BlobLedger:
    """Append-only record of scanned (blob, rule version) pairs and their findings."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        for part, schema in (("findings", FINDINGS), ("scans", SCANS)):
            # an empty first part, so that the folders exist and can be read
            spark.createDataFrame([], schema).coalesce(1).write.mode("ignore").parquet(f"{self.path}/{part}/run=0")

    def _read(self, part: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(T.StructType([*schema.fields, T.StructField("run", T.StringType())])).parquet(f"{self.path}/{part}")

    def scans(self) -> DataFrame:
        return self._read("scans", SCANS)

    def findings(self) -> DataFrame:
        """Findings of completed runs.  A pair that two runs scanned at once counts once."""
        done = self.scans().groupBy("blob", "rule").agg(F.min("run").alias("run"))
        return self._read("findings", FINDINGS).join(done, ["blob", "rule", "run"], "left_semi").drop("run")

    def add(self, scanned: DataFrame) -> None:
        """``scanned``: (blob, rules, spans), the rules scanned now and what they found."""
        run = uuid.uuid4().hex
        found = scanned.select("blob", F.explode("spans").alias("s")).select("blob", "s.rule", "s.kind", "s.start", "s.end")
        found.write.parquet(f"{self.path}/findings/run={run}")
        scanned.select("blob", F.explode("rules").alias("rule")).write.parquet(f"{self.path}/scans/run={run}")


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _spans(text: Column, rule: Rule) -> Column:
    kept = F.filter(found_spans(text, rule.pattern), lambda s: rule.accept(s["found"]))
    return F.transform(kept, lambda s: F.struct(F.lit(rule.key).alias("rule"), F.lit(rule.kind).alias("kind"),
                                                s["start"].alias("start"), s["end"].alias("end")))


def scan(versions: DataFrame, ledger: BlobLedger, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> None:
    """Bring the ledger up to date with the texts of ``versions``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    suspect = F.lit(False)
    for r in rules:
        suspect = suspect | text.rlike(r.anchor)
    blobs = versions.select(blob_of(F.col(text_col)).alias("blob"), F.when(suspect, text).alias("body")).dropDuplicates(["blob"])
    names = F.array(*[F.lit(r.key) for r in rules])
    known = ledger.scans().filter(F.col("rule").isin([r.key for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("known"))
    todo = (blobs.join(known, "blob", "left")
            .withColumn("rules", F.array_except(names, F.coalesce("known", F.array().cast("array<string>"))))
            .filter(F.size("rules") > 0))
    none = F.array().cast("array<struct<rule:string,kind:string,start:bigint,end:bigint>>")
    spans = [F.when(F.col("body").isNotNull() & F.array_contains("rules", r.key), _spans(F.col("body"), r)).otherwise(none)
             for r in rules]
    ledger.add(todo.select("blob", "rules", F.concat(*spans).alias("spans")))


def findings_by_path(versions: DataFrame, ledger: BlobLedger, keys: list[str], rules: tuple[Rule, ...] = RULES,
                     text_col: str = "text") -> DataFrame:
    """(*keys, blob, spans): all findings of the current rule versions for every path;
    spans in order of start, then kind as the rules are listed, then end."""
    order = {r.kind: i for i, r in enumerate(rules)}
    place = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("kind"))
    per_blob = (ledger.findings().filter(F.col("rule").isin([r.key for r in rules])).distinct()
                .groupBy("blob").agg(F.array_sort(F.collect_list(F.struct(
                    "start", place.alias("place"), "end", "kind"))).alias("spans")))
    none = F.array().cast("array<struct<start:bigint,place:int,end:bigint,kind:string>>")
    paths = versions.select(*keys, blob_of(F.col(text_col)).alias("blob"))
    # few blobs have findings: while they are few, paths of one hot blob (the empty text) stay where they are
    per_blob = checked_broadcast(materialise(per_blob, "secret-findings"), BROADCAST_BLOBS)
    return paths.join(per_blob, "blob", "left").withColumn("spans", F.coalesce("spans", none))


def redact(docs: DataFrame, found: DataFrame, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """``docs`` with every found span replaced; ``found`` as of ``findings_by_path``."""
    blobs = materialise(found.filter(F.size("spans") > 0).select(F.col("blob").alias("_blob"), F.col("spans").alias("_spans"))
                        .dropDuplicates(["_blob"]), "secret-blobs")
    blobs = checked_broadcast(blobs, BROADCAST_BLOBS)
    # overlapping spans are taken together; what lies between them stays
    parts = F.aggregate("_spans", F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit("").alias("out")), lambda acc, s: F.when(
        s["start"] >= acc["upto"], F.struct(s["end"].alias("upto"), F.concat(
            acc["out"], F.col(text_col).substr(acc["upto"].cast("int") + 1, (s["start"] - acc["upto"]).cast("int")), F.lit(mark)).alias("out")))
        .otherwise(F.struct(F.greatest(acc["upto"], s["end"]).alias("upto"), acc["out"].alias("out"))))
    whole = let(parts, lambda p: F.concat(p["out"], F.col(text_col).substr(p["upto"].cast("int") + 1, F.length(text_col))))
    joined = docs.join(blobs, blob_of(docs[text_col]) == blobs["_blob"], "left")
    return joined.withColumn(text_col, F.when(F.col("_spans").isNotNull(), whole).otherwise(F.col(text_col))).drop("_blob", "_spans")
