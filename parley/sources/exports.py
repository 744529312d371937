"""Chat-export sources and the canonical sink.

Every parser works on DataFrames, so the same code serves files and tables:

* WhatsApp: raw lines ``(source, line_no, text)``.  A header line opens a
  message; lines without a header continue it.  Every line learns its header by a
  running last value per source (two levels), lines under a header that opens no
  message leave at once, and the lines of a message are gathered with
  ``collect_list`` + ``array_sort``.
* Telegram: one JSON document per source, parsed to VARIANT; the duck-typed
  ``text`` (string, or list of strings and ``{text}`` objects) is flattened with
  ``schema_of_variant`` tests, never by casting an array to a string.  Files are not
  read whole: see ``telegram_messages``.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.operators.order import running_last, running_sum
from parley.session import ensure_checkpoint_dir
from parley.sources.corpus import lines_of, plain_lines, read_text_files

# --- fixed values -----------------------------------------------------------
PLAIN_FORMATS = ("plain", "txt", "lines")
WHATSAPP_FORMATS = ("whatsapp", "wa")
TELEGRAM_FORMATS = ("telegram", "telegram-json", "telegram_json", "tg")
MEDIA_OMITTED = "<Media omitted>"
# WhatsApp message header, Python ``re`` syntax: "M/D/YY, h:mm[ AM|PM] - body"
WA_HEADER_PATTERN = (
    r"^(?P<date>\d{1,2}/\d{1,2}/\d{2,4}),\s+"
    r"(?P<time>\d{1,2}:\d{2})(?:\s?(?P<ampm>AM|PM))?\s+-\s+(?P<body>.*)$"
)
# ---------------------------------------------------------------------------

WA_HEADER_RE = "(?d)" + tx.java_regex(WA_HEADER_PATTERN)


class ParseError(ValueError):
    pass


# S2 + W1
def parse_whatsapp(raw_lines: DataFrame, with_metadata: bool = False) -> DataFrame:
    """``(source, line_no, text)``: one row per message, ``line_no`` of its header."""
    t = F.col("text")
    hdr = t.rlike(WA_HEADER_RE)
    date = tx.strip_ws(F.regexp_extract(t, WA_HEADER_RE, 1))
    time = tx.strip_ws(F.regexp_extract(t, WA_HEADER_RE, 2))
    ampm = tx.strip_ws(F.regexp_extract(t, WA_HEADER_RE, 3))
    body = tx.strip_ws(F.regexp_extract(t, WA_HEADER_RE, 4))
    has_colon = F.locate(":", body) > 0
    name = tx.strip_ws(F.substring_index(body, ":", 1))
    x = raw_lines.withColumn("body_", body)
    msg = tx.strip_ws(F.expr("substring(body_, locate(':', body_) + 1)"))
    ts = F.concat(date, F.lit(", "), time, F.when(ampm != "", F.concat(F.lit(" "), ampm)).otherwise(F.lit("")))
    x = (x.withColumn("_opens", hdr & has_colon & (msg != "") & (msg != MEDIA_OMITTED))
          .withColumn("_part", F.when(hdr, F.when(F.col("_opens"), msg)).otherwise(tx.strip_ws(t)))
          .withColumn("_prefix", F.when(F.col("_opens"), F.concat(F.lit("["), ts, F.lit("] "), name, F.lit(": ")))))
    x = x.withColumn("_head", F.when(hdr, F.struct(F.col("line_no").alias("at"), F.col("_opens").alias("opens"))))
    x = running_last(x, ["source"], "_head", "_of")
    # lines under no header, or under one that opens no message, are not gathered
    x = x.filter(F.col("_of.opens"))
    g = (x.groupBy("source", F.col("_of.at").alias("line_no"))
          .agg(F.max("_prefix").alias("_prefix"),
               F.array_sort(F.collect_list(F.when(F.col("_part").isNotNull() & (F.col("_part") != ""),
                                                  F.struct("line_no", "_part")))).alias("_parts")))
    joined = tx.clean_line(F.array_join(F.transform("_parts", lambda p: p["_part"]), " "))
    out = g.select("source", "line_no", joined.alias("text"), "_prefix").filter(F.col("text") != "")
    text = F.concat(F.col("_prefix"), F.col("text")) if with_metadata else F.col("text")
    return out.select("source", "line_no", text.alias("text"))


# B19
def telegram_text(v) -> F.Column:
    """null -> ''; string as is; list -> strings and dicts' string ``text`` joined;
    anything else -> ''."""
    v = tx._col(v)
    kind = F.schema_of_variant(v)
    items = F.try_variant_get(v, "$", "array<variant>")

    def piece(e):
        k = F.schema_of_variant(e)
        inner = F.try_variant_get(e, "$.text", "variant")
        return (F.when(k == "STRING", F.variant_get(e, "$", "string"))
                 .when(k.startswith("OBJECT") & (F.schema_of_variant(inner) == "STRING"),
                       F.variant_get(e, "$.text", "string"))
                 .otherwise(F.lit("")))
    return (F.when(v.isNull(), F.lit(""))
             .when(kind == "STRING", F.variant_get(v, "$", "string"))
             .when(kind.startswith("ARRAY"), F.array_join(F.transform(items, piece), ""))
             .otherwise(F.lit("")))


def _str_field(m, path: str) -> F.Column:
    f = F.try_variant_get(m, path, "variant")
    return F.when(F.schema_of_variant(f) == "STRING", F.variant_get(m, path, "string"))


# S3
def parse_telegram(docs: DataFrame, with_metadata: bool = False, check: bool = True) -> DataFrame:
    """``docs(source, json)`` -> ``(source, line_no, text)``; line_no is the
    1-based position in ``messages``."""
    v = docs.select("source", F.try_parse_json("json").alias("v"))
    msgs = F.try_variant_get(F.col("v"), "$.messages", "array<variant>")
    if check:
        bad = v.filter(F.col("v").isNull() | msgs.isNull())
        if not bad.isEmpty():
            src = bad.select("source").first()[0]
            raise ParseError(f"{src}: no array of messages at the top of the document")
    ex = v.select("source", F.posexplode(msgs).alias("pos", "m"))
    return _telegram_rows(ex.select("source", (F.col("pos") + 1).cast("bigint").alias("line_no"), "m"), with_metadata)


def _telegram_rows(messages: DataFrame, with_metadata: bool) -> DataFrame:
    """``(source, line_no, m VARIANT)``, one row per entry of ``messages`` -> ``(source, line_no, text)``."""
    ex = messages.filter(F.schema_of_variant("m").startswith("OBJECT"))
    typ = F.try_variant_get(F.col("m"), "$.type", "string")
    ex = ex.filter(typ.isNull() | (typ == "message"))
    cleaned = tx.clean_line(telegram_text(F.try_variant_get(F.col("m"), "$.text", "variant")))
    out = ex.select("source", "line_no", cleaned.alias("text"),
                    _str_field(F.col("m"), "$.date").alias("_date"), _str_field(F.col("m"), "$.from").alias("_from"))
    out = out.filter(F.col("text") != "")
    text = F.concat(tx.metadata_prefix(F.coalesce("_date", F.lit("")), F.coalesce("_from", F.lit(""))),
                    F.col("text")) if with_metadata else F.col("text")
    return out.select("source", "line_no", text.alias("text"))


# --- one large JSON document as many tasks ---------------------------------------------

# what a pass over the structure of a piece knows: depth; whether "messages": was just read at depth 1;
# whether the place is inside that array; commas passed there; at the first object of the array, the commas
# and the braces before it (-1: none in this piece); braces passed; last change of ``inside`` (-1: none, 0: left, 1: entered, 2: entered and left)
_STEP = "struct<depth:bigint,armed:boolean,inside:boolean,commas:int,at:int,brace:int,braces:int,event:int>"


def _walk(structure, depth, inside) -> F.Column:
    """Follow the structural characters of a piece (``M`` stands for the key) from a known start."""
    start = F.struct(depth.cast("bigint"), F.lit(False), inside, F.lit(0), F.lit(-1), F.lit(-1), F.lit(0), F.lit(-1)).cast(_STEP)

    def step(s, c):
        opens, shuts, object_ = c.isin("{", "["), c == "]", c == "{"
        entered = (c == "[") & s["armed"]
        left = shuts & s["inside"] & (s["depth"] == 2)
        hit = object_ & s["inside"] & (s["depth"] == 2)
        return F.struct(
            s["depth"] + F.when(opens, 1).when(shuts, -1).otherwise(0),
            (c == "M") & (s["depth"] == 1),
            F.when(entered, True).when(left, False).otherwise(s["inside"]),
            s["commas"] + F.when((c == ",") & s["inside"] & (s["depth"] == 2), 1).otherwise(0),
            F.when(hit, s["commas"]).otherwise(s["at"]),
            F.when(hit, s["braces"]).otherwise(s["brace"]),
            s["braces"] + F.when(object_, 1).otherwise(0),
            F.when(entered, 1).when(left, F.when(s["event"] == 1, 2).otherwise(0)).otherwise(s["event"])).cast(_STEP)

    return F.aggregate(F.split(structure, ""), start, step)


def telegram_messages(pieces: DataFrame) -> DataFrame:
    """``(source, line_no, json)`` of every object in a document's ``messages`` array, with its
    1-based place there, from ``pieces(source, line_no, text)``: the document cut at every
    ``}``, in order.

    What a piece means depends on where it starts.  Whether that is inside a string is the
    running number of quotes, the depth a running sum of brackets outside strings, and whether
    it is inside ``messages`` the last such border before it; all of them over a narrow table
    of structural characters.  An object begins in one piece (a piece holds no end of one) and
    goes on to the piece that closes it, so its pieces meet under its place.  Texts move
    twice, by place in the document and by object; no document is read by one task."""
    ensure_checkpoint_dir(pieces.sparkSession)
    plain = F.regexp_replace("text", r"(?s)\\.", "??")         # no escapes, every place as before

    def structure(text):
        bare = F.regexp_replace(text, r'("messages"\s*+:)|"[^"]*+(?:"|\z)', "$1")
        return F.regexp_replace(F.regexp_replace(bare, r'"messages"\s*+:', "M"), r"[^M\[\]{,]", "")

    narrow = pieces.select("source", "line_no", plain.alias("_t")).select(
        "source", "line_no", (F.length("_t") - F.length(F.replace("_t", F.lit('"'), F.lit("")))).alias("quotes"),
        structure(F.col("_t")).alias("s_out"), structure(F.concat(F.lit('"'), "_t")).alias("s_in"))
    narrow = running_sum(narrow, ["source"], "quotes", "_q", inclusive=False)
    narrow = narrow.withColumn("quoted", F.col("_q") % 2 == 1).withColumn("s", F.when(F.col("quoted"), F.col("s_in")).otherwise(F.col("s_out")))

    def many(chars):
        return F.length("s") - F.length(F.translate("s", chars, ""))
    closes = F.when((F.col("_q") + F.col("quotes")) % 2 == 0, 1).otherwise(0)
    narrow = narrow.select("source", "line_no", "quoted", "s", (many("{[") - many("]") - closes).alias("change"))
    narrow = running_sum(narrow, ["source"], "change", "depth", inclusive=False)
    event = _walk(F.col("s"), F.col("depth"), F.lit(False))["event"]
    # from outside: a border that is found by leaving needs to know that the place was inside
    leaves = _walk(F.col("s"), F.col("depth"), F.lit(True))["event"]
    narrow = narrow.withColumn("_e", F.when(event >= 0, event == 1).when(leaves == 0, F.lit(False)))
    narrow = running_last(narrow, ["source"], "_e", "_inside", inclusive=False)
    walked = _walk(F.col("s"), F.col("depth"), F.coalesce("_inside", F.lit(False)))
    narrow = narrow.select("source", "line_no", "quoted", "depth", F.coalesce("_inside", F.lit(False)).alias("inside"), walked.alias("w"))
    narrow = running_sum(narrow.withColumn("_c", F.col("w.commas")), ["source"], "_c", "before", inclusive=False).drop("_c")
    narrow = narrow.checkpoint(eager=True)
    found = narrow.groupBy("source").agg(F.bool_or(F.col("inside") | (F.col("w.event") > 0)).alias("any")).filter(~F.col("any"))
    if not found.isEmpty():
        raise ParseError(f"{found.first()['source']}: no array of messages at the top of the document")

    starts = F.col("w.at") >= 0
    mine = narrow.filter(starts | (F.col("inside") & (F.col("depth") >= 3))).select(
        "source", "line_no", "quoted", starts.alias("starts"), F.col("w.brace").alias("brace"),
        (F.col("before") + F.when(starts, F.col("w.at")).otherwise(0)).alias("place"))
    rows = pieces.join(mine, ["source", "line_no"])
    # up to the brace that opens the object, in the text without escapes (of the same length)
    lead = F.when(F.col("quoted"), F.concat(F.lit('"'), plain)).otherwise(plain)
    tokens = F.regexp_extract_all(lead, F.lit(r'[^"{]++|"[^"]*+"|\{'), F.lit(0))
    skipped = F.aggregate(tokens, F.struct(F.lit(0).alias("n"), F.lit(0).alias("b"), F.lit(False).alias("done")), lambda s, t: F.struct(
        F.when(s["done"] | ((t == "{") & (s["b"] == F.col("brace"))), s["n"]).otherwise(s["n"] + F.length(t)).alias("n"),
        (s["b"] + F.when(t == "{", 1).otherwise(0)).alias("b"), (s["done"] | ((t == "{") & (s["b"] == F.col("brace")))).alias("done")))["n"]
    cut = F.substring("text", skipped - F.when(F.col("quoted"), 1).otherwise(0) + 1, F.length("text"))
    rows = rows.select("source", "place", "line_no", "starts", F.when(F.col("starts"), cut).otherwise(F.col("text")).alias("part"))
    # entries that are no objects have places, but no piece that starts one (and no text: a
    # parser that is pulled before the filter must not see them)
    objects = rows.groupBy("source", "place").agg(F.bool_or("starts").alias("ok"), F.min(F.when(F.col("starts"), F.col("line_no"))).alias("_at"),
                                                  F.array_sort(F.collect_list(F.struct("line_no", "part"))).alias("_p")).filter("ok")
    parts = F.transform(F.filter("_p", lambda p: p["line_no"] >= F.col("_at")), lambda p: p["part"])
    return objects.select("source", (F.col("place") + 1).cast("bigint").alias("line_no"),
                          F.when(F.col("ok"), F.concat(F.array_join(parts, "}"), F.lit("}"))).alias("json"))


def read_telegram(spark: SparkSession, paths, with_metadata: bool = False) -> DataFrame:
    """S3 for files of any size: ``parse_telegram`` over ``telegram_messages``.  A message that is
    no JSON fails the read."""
    found = telegram_messages(read_text_files(spark, paths, line_sep="}"))
    return _telegram_rows(found.select("source", "line_no", F.parse_json("json").alias("m")), with_metadata)


def read_json_docs(spark: SparkSession, paths) -> DataFrame:
    """Whole JSON files as ``(source=path, json)`` (bad bytes replaced)."""
    if isinstance(paths, str):
        paths = [paths]
    return (spark.read.text(list(paths), wholetext=True)
                 .select(F.input_file_name().alias("source"),
                         F.call_function("make_valid_utf8", F.col("value")).alias("json")))


# S4
def export_format(fmt: str) -> str:
    f = str(fmt or "").strip().lower()
    if f in PLAIN_FORMATS:
        return "plain"
    if f in WHATSAPP_FORMATS:
        return "whatsapp"
    if f in TELEGRAM_FORMATS:
        return "telegram"
    raise ParseError(f"cannot read exports of kind {fmt!r}")


def read_export(spark: SparkSession, paths, fmt: str = "plain", with_metadata: bool = False) -> DataFrame:
    """Parse export files into ``(source, line_no, text)``."""
    f = export_format(fmt)
    if f == "telegram":
        return read_telegram(spark, paths, with_metadata)
    raw = read_text_files(spark, paths)
    if f == "whatsapp":
        return parse_whatsapp(raw, with_metadata)
    return plain_lines(raw)


# S5
def canonical(messages: DataFrame) -> DataFrame:
    """Clean every message line (B6) and drop blanks."""
    return messages.withColumn("text", tx.clean_line("text")).filter(F.col("text") != "")


def write_corpus(messages: DataFrame, path: str, fmt: str = "parquet", partitions: int | None = None) -> None:
    """The canonical corpus, range-partitioned and sorted by (source, line_no).

    ``fmt='parquet'`` keeps the order columns; ``fmt='text'`` writes one message
    per line (order within each part file)."""
    c = canonical(messages)
    n = partitions or int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = c.repartitionByRange(n, "source", "line_no").sortWithinPartitions("source", "line_no")
    if fmt == "text":
        c.select("text").write.mode("overwrite").text(path)
    else:
        c.write.mode("overwrite").parquet(path)


# S11
def write_samples(samples: DataFrame, path: str, fmt: str = "jsonl") -> None:
    """Retrieval samples: ``jsonl`` (one object per line) or ``json`` (one array).

    The array is written by all tasks: its part files, in the order of their names, are one JSON
    document, a row per line.  ``_manifest.json`` lists the parts with their rows."""
    f = str(fmt or "jsonl").strip().lower()
    rows = samples.select("query", "results")
    if f == "jsonl":
        rows.write.mode("overwrite").json(path)
        return
    if f != "json":
        raise ValueError(f"cannot write samples as {fmt!r}: json or jsonl")
    spark = samples.sparkSession
    ensure_checkpoint_dir(spark)
    lines = rows.select(F.to_json(F.struct("query", "results")).alias("value")).checkpoint(eager=True)
    numbered = lines.select("value", F.spark_partition_id().alias("part"),
                            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    held = {r["part"]: r["n"] for r in numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}   # a number per task
    if not held:
        spark.createDataFrame([("[]",)], "value string").coalesce(1).write.mode("overwrite").text(path)
    else:
        first, last = min(held), max(held)
        head = F.when((F.col("part") == first) & (F.col("at") == 0), "[").otherwise(",")
        tail = F.when((F.col("part") == last) & (F.col("at") == held[last] - 1), "]").otherwise("")
        numbered.select(F.concat(head, "value", tail).alias("value")).write.mode("overwrite").text(path)
    manifest = {"parts": [{"part": p, "rows": n} for p, n in sorted(held.items())], "rows": sum(held.values())}
    fs, folder = _file_system(spark, path)
    out = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, "_manifest.json"), True)
    out.write(bytearray((json.dumps(manifest) + "\n").encode()))
    out.close()


def read_samples(spark: SparkSession, path: str, schema: str, fmt: str = "jsonl") -> DataFrame:
    """Samples written by ``write_samples``, as ``schema`` (of query and results)."""
    if str(fmt or "jsonl").strip().lower() == "jsonl":
        return spark.read.schema(schema).json(path)
    line = F.regexp_replace(F.regexp_replace("value", r"^[\[,]", ""), r"\]$", "")
    return spark.read.text(path).select(line.alias("value")).filter("value <> ''") \
                .select(F.from_json("value", schema).alias("v")).select("v.*")


def _file_system(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


__all__ = ["parse_whatsapp", "parse_telegram", "telegram_text", "read_export", "export_format", "canonical",
           "write_corpus", "write_samples", "read_samples", "read_telegram", "telegram_messages", "read_json_docs", "lines_of", "ParseError"]
