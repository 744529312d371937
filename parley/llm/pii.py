"""Personal data: overlapping candidates, boosted trees, calibrated thresholds.

Base spans come from four strict patterns with exact checks; they always stay.  Wide
generators propose further, overlapping spans: obfuscated or spaced forms, numbers whose
checks fail, numbers without their usual marks.  Gradient-boosted trees score every
candidate from its format (lengths, separators, checksums) and its context (neighbouring
characters, words before it); a threshold per kind is calibrated to ``PRECISION`` on all
spans and candidates that the trees were not fitted on, and selected candidates that overlap
no base span and no better candidate are added.

No labels exist for candidates, so the trees learn from the base spans of the corpus
itself, rendered anew in place with their context: positives in looser forms (other
separators, no plus sign, written-out marks), negatives with broken checks (a changed
digit, an octet out of range, a missing part), and candidates as they stand that are no base
span and pass no check of their kind.  The trees are fitted on at most about ``TRAIN_SPANS`` of
each kind and sort, by hash, so a kind is taught however rare it is beside the others; where
all kinds together have under ``LEAST_SPANS`` positives or negatives, nothing is added.  A kind
with under ``LEAST_SPANS`` positives to calibrate on takes the threshold of all kinds together.
Nothing is added of a kind that has no base span at all, or whose scores nowhere reach
``PRECISION``.

Everything runs as column expressions and Spark ML; the fitted trees are compiled into
columns.  Texts are read once, and only those that hold a digit or an @ look for spans.

Defined cases: null and empty texts have no spans; rows are judged one by one, so repeats
get equal spans; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import found_spans, materialise
from parley.llm.trees import tree_leaves, tree_value

KINDS = ("email", "ip", "card", "phone")
TRAIN_SPANS = 4_000
LEAST_SPANS = 30
PRECISION = 0.95
ROUNDS = 12
DEPTH = 4
FIT_TASKS = 2
SCORE_BINS = 4096   # of the score, per kind, for the calibration
CONTEXT = 24      # characters looked at on either side

# The four base patterns.  Where one begins with a run, it starts at the border of
# the run (or where the last match ended), which is the same leftmost match found without
# trying every place inside long runs; possessive runs never need to give back.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# wide generators: at least as loose as their base
_AT, _DOT, _PART = r"(?:@|[(\[]at[)\]]|\x20at\x20)", r"\x20?(?:\.|[(\[]dot[)\]]|\x20dot\x20)", r"\x20?[A-Za-z0-9-]{1,63}+"
WIDE = {
    "email": rf"[{_LOCAL}]{{1,64}}+\x20?{_AT}{_PART}(?:{_DOT}{_PART}){{1,4}}+",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:(?:\.|\[\.\]|\(\.\)|\x20\.\x20|-)[0-9]{1,3}+){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20./_-]{0,2}[0-9]){11,18}",
    "phone": r"(?<![0-9])(?:\+|00)?[0-9(](?:[\x20()./-]{0,2}[0-9]){6,14}",
}
LONGEST = 64 + 1 + 4 + 1 + 63 + 4 * (1 + 5 + 1 + 63)   # of a wide match: an e-mail address
_OCTET = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$"


def digits_of(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check (at most 19 digits are looked at)."""
    backwards = F.split(F.reverse(F.substring(digits, 1, 19)), "")
    total = F.aggregate(F.transform(backwards, lambda d, i: F.when(i % 2 == 0, F.coalesce(d.try_cast("int"), F.lit(0))).otherwise(
        F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.coalesce(d.try_cast("int"), F.lit(0)) + 1))),
        F.lit(0), lambda a, x: a + x)
    return (F.length(digits) > 0) & (total % 10 == 0)


def base_check(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(_OCTET)
    n = F.length(digits_of(found))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits_of(found))).otherwise(F.lit(False))
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _kept(text: Column, kind: str) -> Column:
    spans = F.filter(found_spans(text, BASE[kind]), lambda s: base_check(kind, s["found"]))
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                                                 s["found"].alias("found")))


_KEPT = "array<struct<kind:string,start:bigint,end:bigint,found:string>>"
_AROUND = "array<struct<kind:string,start:bigint,end:bigint,found:string,before:string,after:string>>"


def read_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, row, base, wide): base spans and wide candidates of every text, the latter
    with the characters around them.  ``row`` numbers the rows of the written table."""
    text = F.col("_t")
    # what every match of the wide generator contains
    marks = {"email": text.rlike(_AT + _PART + _DOT + _PART), "ip": text.rlike(r"[0-9](?:\.|\[\.\]|\(\.\)|\x20\.\x20|-)[0-9]"),
             "card": text.rlike(r"[0-9](?:[\x20./_-]{0,2}[0-9]){11}"), "phone": text.rlike(r"[0-9](?:[\x20()./-]{0,2}[0-9]){6}")}

    def around(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found"),
            text.substr(F.greatest(F.lit(1), s["start"].cast("int") - CONTEXT + 1),
                        F.least(F.lit(CONTEXT), s["start"].cast("int"))).alias("before"),
            text.substr(s["end"].cast("int") + 1, F.lit(CONTEXT)).alias("after")))

    def wide(kind: str) -> Column:
        return F.transform(found_spans(text, WIDE[kind]), lambda s: F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found")))

    base_mark = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
                 "phone": text.rlike(r"\+[0-9]")}
    base = F.concat(*[F.when(base_mark[k], _kept(text, k)).otherwise(F.array().cast(_KEPT)) for k in KINDS])
    rest = F.concat(*[F.when(marks[k], wide(k)).otherwise(F.array().cast(_KEPT)) for k in KINDS])
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"))
    rows = rows.select("doc_id", "_t", F.when(text.rlike("[0-9@]|[(\\[]at|\\x20at\\x20"), F.struct(base.alias("base"), rest.alias("wide"))).alias("s"))
    return rows.select("doc_id", F.monotonically_increasing_id().alias("row"),
                       F.coalesce(around(F.col("s.base")), F.array().cast(_AROUND)).alias("base"),
                       F.coalesce(around(F.col("s.wide")), F.array().cast(_AROUND)).alias("wide"))


FEATURES = ("is_email", "is_ip", "is_card", "is_phone", "length", "n_digits", "n_groups", "longest_group", "n_spaces", "n_marks",
            "plus", "parens", "checksum", "octets", "top_level", "left_letter", "left_digit", "right_letter", "right_digit",
            "says_mail", "says_phone", "says_card", "says_host", "says_number", "at_sign", "at_bracket", "dot_word", "local_length",
            "zeros", "trunk")


def features(spans: DataFrame) -> DataFrame:
    """``spans`` (kind, found, before, after) with one double per feature."""
    found, kind = F.col("found"), F.col("kind")
    before, after = F.lower("before"), F.col("after")
    groups = F.filter(F.split(found, "[^0-9]+"), lambda g: g != "")
    told = {
        "is_email": kind == "email", "is_ip": kind == "ip", "is_card": kind == "card", "is_phone": kind == "phone",
        "length": F.length(found), "n_digits": F.length(digits_of(found)), "n_groups": F.size(groups),
        "longest_group": F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(0)),
        "n_spaces": F.length(found) - F.length(F.translate(found, " ", "")),
        "n_marks": F.length(found) - F.length(F.translate(found, "()[]./_-@", "")),
        "plus": found.startswith("+") | found.startswith("00"), "parens": found.contains("("),
        "checksum": (kind == "card") & luhn(digits_of(found)),
        "octets": (kind == "ip") & F.regexp_replace(found, "[^0-9]+", ".").rlike(_OCTET),
        "top_level": (kind == "email") & F.lower(found).rlike(r"[a-z0-9](?:\.|\x20?[(\[]?dot[)\]]?\x20?)[a-z]{2,10}$"),
        "left_letter": before.rlike(r"\p{L}$"), "left_digit": before.rlike(r"[0-9][.,:/-]?$"),
        "right_letter": after.rlike(r"^\p{L}"), "right_digit": after.rlike(r"^[.,:/-]?[0-9]"),
        "says_mail": before.rlike("mail|contact|write|correo|courriel"), "says_phone": before.rlike("phone|tel|call|mobil|fax"),
        "says_card": before.rlike("card|visa|credit|karte|carte|tarjeta|pay"), "says_host": before.rlike(r"\bip|host|server|addr"),
        "at_sign": found.contains("@"), "at_bracket": (kind == "email") & found.rlike(r"[(\[]at[)\]]"),
        "dot_word": (kind == "email") & found.rlike(r"dot[)\]]?\x20?[A-Za-z0-9-]+$"),
        "local_length": F.when(kind == "email", F.length(F.regexp_extract(found, rf"^[{_LOCAL}]*", 0))).otherwise(F.lit(0)),
        "zeros": found.startswith("00"), "trunk": found.rlike("^0[1-9]"),
        "says_number": before.rlike(r"vers|page|isbn|order|invoice|chapter|section|no\.|id\b"),
    }
    return spans.select("*", *[told[f].cast("double").alias(f) for f in FEATURES])


def _drawn_by(*salt: str) -> list[Column]:
    """``key`` that samples are drawn by, and ``part``: documents of part 0 are never fitted on."""
    return [F.pmod(F.xxhash64(*map(F.lit, salt), "doc_id", "start", "end"), F.lit(1 << 30)).alias("key"),
            F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(3)).alias("part")]


def free_spans(scanned: DataFrame) -> DataFrame:
    """(doc_id, row, kind, start, end, found, before, after): wide candidates that overlap no base span."""
    return scanned.select("doc_id", "row", F.explode(_free("wide", "base")).alias("s")).select("doc_id", "row", "s.*")


def rendered_spans(scanned: DataFrame) -> DataFrame:
    """(kind, found, before, after, sort, label, key, part): all base spans in looser and in broken forms."""
    base = scanned.select("doc_id", F.explode("base").alias("s")).select("doc_id", "s.*").select("*", *_drawn_by("base"))
    f, k, key = F.col("found"), F.col("kind"), F.col("key")
    digit = F.pmod(F.substring(digits_of(f), -1, 1).try_cast("int") + 1 + key % 9, F.lit(10)).cast("string")
    # forms vary what the addresses of one corpus may have in common, such as the number of their parts
    bare = F.regexp_replace(f, r"^.*?([A-Za-z0-9]+)@.*?([A-Za-z0-9-]+\.[A-Za-z]+)$", "$1@$2")
    loose = F.when(k == "email", F.element_at(F.array(
        f, F.regexp_replace(f, "@", " at "), F.regexp_replace(F.regexp_replace(f, "@", " (at) "), r"\.(?=[^.]*$)", " (dot) "),
        bare, F.regexp_replace(bare, "@", " at "), F.regexp_replace(F.regexp_replace(bare, "@", " at "), r"\.", " dot "),
        F.regexp_replace(F.regexp_replace(bare, "@", "[at]"), r"\.", "[dot]")), (key % 7 + 1).cast("int")))
    loose = loose.when(k == "ip", F.element_at(F.array(f, F.regexp_replace(f, r"\.", "[.]"), F.regexp_replace(f, r"\.", " . ")), (key % 3 + 1).cast("int")))
    loose = loose.when(k == "card", F.element_at(F.array(
        digits_of(f), F.regexp_replace(digits_of(f), "(.{4})(?=.)", "$1 "), F.regexp_replace(digits_of(f), "(.{4})(?=.)", "$1."),
        F.regexp_replace(digits_of(f), "(.{4})(?=.)", "$1/")), (key % 4 + 1).cast("int")))
    grouped = [("^(.{1,2})(.{2,3})(.+)$", "$1 $2 $3"), ("^(.{2})(.{2})(.+)$", "$1 $2 $3"), ("^(.{2})(.{3})(.{2})(.+)$", "$1 $2 $3 $4"),
               ("^(.{2})(.+)$", "$1 $2")]
    spaced = F.element_at(F.array(*[F.regexp_replace(digits_of(f), a, b) for a, b in grouped]), (F.floor(key / 7) % 4 + 1).cast("int"))
    loose = loose.otherwise(F.element_at(F.array(
        f, F.regexp_replace(f, r"^\+[0-9]{1,2}\x20?", ""), F.regexp_replace(f, r"^\+", "00"), F.regexp_replace(f, r"[\x20()-]+", "."),
        F.concat(F.lit("00"), spaced), F.concat(F.lit("+"), spaced)), (key % 6 + 1).cast("int")))
    # what the generator proposes in prose: a word, at, the end of a sentence or a time of day
    broken = F.when(k == "email", F.element_at(F.array(
        F.regexp_replace(f, r"@([^.]*)\..*$", " at $1. Then"), F.regexp_replace(f, r"@.*$", " at 10.30"),
        F.regexp_replace(f, r"@(.*)\.[^.]*$", " at $1. Then"), F.regexp_replace(f, r"@(.*)\.[^.]*$", " at $1 . so"),
        F.regexp_replace(bare, r"@([^.]*)\..*$", " at $1. Then")), (key % 5 + 1).cast("int")))
    broken = broken.when(k == "ip", F.concat(F.lit("7"), F.lpad(F.regexp_extract(f, "^[0-9]+", 0), 2, "0"), F.regexp_extract(f, r"\..*$", 0)))
    broken = broken.when(k == "card", F.concat(F.expr("substring(found, 1, length(found) - 1)"), digit))
    # no mark of a phone number is left: a part, or all digits in groups
    broken = broken.otherwise(F.element_at(F.array(F.expr("substring(found, 2, 8)"), F.regexp_replace(spaced, "^0+", "1")), (key % 2 + 1).cast("int")))
    forms = F.explode(F.array(F.struct(F.lit("loose").alias("sort"), loose.alias("found"), F.lit(1.0).alias("label")),
                              F.struct(F.lit("broken").alias("sort"), broken.alias("found"), F.lit(0.0).alias("label"))))
    return base.select("kind", "before", "after", "key", "part", forms.alias("f")).select(
        "kind", "f.found", "before", "after", "f.sort", "f.label", "key", "part").filter("found is not null")


def doubtful(free: DataFrame) -> DataFrame:
    """Of ``free`` (candidates with features) those that pass no check of their kind: the others
    may well be personal data, so they teach nothing."""
    checked = (F.col("checksum") + F.col("octets") + F.col("top_level")
               + F.when(F.col("kind") == "phone", F.col("plus") + F.col("parens")).otherwise(0)) > 0
    return free.filter(~checked).select("kind", *FEATURES, F.lit("free").alias("sort"), F.lit(0.0).alias("label"), *_drawn_by("free"))


def _free(spans: str, taken: str) -> Column:
    """The spans that overlap none of the taken ones."""
    return F.filter(spans, lambda s: ~F.exists(taken, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"])))


class SpanModel:
    """Compiled trees and one threshold per kind; without trees nothing is selected."""

    def __init__(self, trees: list, weights: list[float], thresholds: dict[str, float]):
        self.trees, self.weights, self.thresholds = trees, weights, thresholds

    def margin(self) -> Column:
        columns = [F.col(f) for f in FEATURES]
        out = F.lit(0.0)
        for leaves, w in zip(self.trees, self.weights, strict=True):
            out = out + F.lit(w) * tree_value(leaves, columns)
        return 1 / (1 + F.exp(-2 * out))


def calibrate(held: DataFrame, taught: dict[str, int], precision: float = PRECISION) -> dict[str, float]:
    """Of each kind in ``taught``, the lowest score from which on the share of positives of
    ``held`` (kind, label, p) is at least ``precision``, told from totals per bin of the score;
    for kinds with under ``LEAST_SPANS`` positives there, the same over all kinds."""
    bins = (held.groupBy("kind", F.floor(F.col("p") * SCORE_BINS).alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones"), F.min("p").alias("p")))
    # short: at most SCORE_BINS + 1 rows of each kind
    bins = bins.unionByName(bins.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"), F.min("p").alias("p"))
                            .withColumn("kind", F.lit("all")))
    down = Window.partitionBy("kind").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    reached = F.sum("ones").over(down) / F.sum("n").over(down) >= precision
    seen = {r["kind"]: r for r in bins.withColumn("cut", F.when(reached, F.col("p"))).groupBy("kind")
            .agg(F.sum("ones").alias("ones"), F.min("cut").alias("cut")).collect()}    # one row per kind
    out = {}
    for kind in taught:
        own = seen.get(kind)
        told = own if own is not None and own["ones"] >= LEAST_SPANS else seen.get("all")
        if told is not None and told["cut"] is not None:
            out[kind] = max(0.5, told["cut"])
    return out


def fit(scanned: DataFrame, free: DataFrame, precision: float = PRECISION) -> SpanModel:
    """The model of the base spans of ``scanned`` and of ``free``, its free spans with features."""
    rendered = materialise(features(rendered_spans(scanned)), "pii-rendered")
    columns = ["kind", "sort", "label", "key", "part", *FEATURES]
    spans = rendered.select(*columns).unionByName(doubtful(free).select(*columns))
    counts = spans.groupBy("kind", "sort").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("part") != 0, 1)).alias("fit")).collect()
    taught = {r["kind"]: r["n"] for r in counts if r["sort"] == "loose"}
    ones = sum(taught.values())
    if ones < LEAST_SPANS or sum(r["n"] for r in counts) - ones < LEAST_SPANS:
        return SpanModel([], [], {})
    share = F.lit(0)
    for r in counts:
        upto = int((1 << 30) * min(1.0, TRAIN_SPANS / max(1, r["fit"])))
        share = F.when((F.col("kind") == r["kind"]) & (F.col("sort") == r["sort"]), F.lit(upto)).otherwise(share)
    drawn = (F.col("part") != 0) & (F.col("key") < share)
    sample = materialise(spans.filter(drawn).select("label", *FEATURES), "pii-sample")
    # some thousand short rows, over which the fit runs many short jobs
    vectors = sample.coalesce(FIT_TASKS).select("label", array_to_vector(F.array(*FEATURES)).alias("x"))
    if vectors.select("label").distinct().count() < 2:
        return SpanModel([], [], {})
    fitted = GBTClassifier(featuresCol="x", labelCol="label", maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, seed=11).fit(vectors)
    model = SpanModel(tree_leaves(fitted), list(fitted.treeWeights), {})
    held = materialise(spans.filter(~drawn).select("kind", "label", model.margin().alias("p")), "pii-held")
    model.thresholds = calibrate(held, taught, precision)
    return model


def unbeaten(scored: DataFrame) -> DataFrame:
    """The candidates (row, start, end, p, place, ...) that overlap none of higher score (of equal
    ones, of an earlier kind).  No candidate is longer than ``LONGEST``, so all that overlap one
    start within that distance."""
    near = Window.partitionBy("row").orderBy("start").rangeBetween(-LONGEST, LONGEST)
    rivals = F.collect_list(F.struct("start", "end", "p", "place")).over(near)
    beaten = F.exists("rivals", lambda o: (o["start"] < F.col("end")) & (F.col("start") < o["end"]) & (
        (o["p"] > F.col("p")) | ((o["p"] == F.col("p")) & (o["place"] < F.col("place")))))
    return scored.withColumn("rivals", rivals).filter(~beaten).drop("rivals")


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added) of every document: arrays of spans (kind, start, end, found),
    in order of kind as listed, then start."""
    scanned = materialise(read_spans(docs), "pii-spans")
    # features and score are written before anything filters on them: a filter would be pushed
    # down with a copy of every feature at every split of the trees
    free = materialise(features(free_spans(scanned)), "pii-features")
    model = fit(scanned, free)
    row = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("kind", "string"), ("start", "bigint"), ("end", "bigint"), ("found", "string"))])
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found")))
    if not model.trees or not model.thresholds:
        return scanned.select("doc_id", base.alias("base"), F.filter(F.array(row), lambda s: F.lit(False)).alias("added"))
    cut = F.element_at(F.create_map(*[F.lit(x) for kv in model.thresholds.items() for x in kv]), F.col("kind"))
    scored = materialise(free.select("row", "kind", "start", "end", "found", model.margin().alias("p")), "pii-scores")
    scored = scored.filter(F.col("p") >= cut)
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    added = (unbeaten(scored.withColumn("place", place))
             .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "start", "end", "kind", "found"))).alias("added")))
    added = added.select(F.col("row").alias("_row"), F.transform("added", lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found"))).alias("added"))
    return scanned.join(added, F.col("row") == F.col("_row"), "left").select(
        "doc_id", base.alias("base"), F.coalesce("added", F.array().cast(_KEPT)).alias("added"))


def in_order(spans: Column) -> Column:
    """Spans by kind as listed, then start."""
    return F.array_sort(F.transform(spans, lambda s: F.struct(
        F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
