"""Audit of how far the sources of a language diverge, by count cells.

Inside each language, terms that occur in at least ``MIN_DOCS`` documents are kept.  A group is
a language and a source; it, and the language as a whole, gives a term of count c the smoothed
share ``p = 1 + floor(SCALE * (c + 1) / (N + V))``, N the count of all kept terms there and V
their number.  Two shares differ by ``f = floor((p - q)^2 / q)``.

* ``term``: the kept terms that a group uses more than its language does, by f.
* ``pair``: every other source of the language, by the sum of f over all kept terms.

Shares depend on counts alone.  For ``term`` the terms of a group are therefore grouped into
cells of (group count, language count); f is evaluated once a cell, cells of one value are
merged, values are ranked by cumulative multiplicity, and only the values that reach the wanted
ranks are expanded into terms.  For ``pair`` terms with the same counts in all sources are one
profile with a multiplicity; profiles are evaluated for blocks of ``BLOCK`` x ``BLOCK`` sources
at a time, and profiles without a count in a block pair are settled by their number.

Words are counted per task in Python's own counters (bounded, flushed), everything after that
is joins and aggregates; arithmetic is in whole numbers throughout.

Defined cases: null text, lang and source read as ''; a text without terms still makes its
group occur; a language without kept terms has pairs of value 0 and no terms; repeated rows are
documents of their own; other columns are ignored; an empty table gives no rows.  A term's
counts over the sources of a language are one row.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import checked_broadcast, materialise

SCALE = 1_000_000_000
MIN_DOCS = 3
TOP_TERMS = 200
BLOCK = 64             # sources of a block
HELD_TERMS = 300_000   # counted terms that a task holds at most
PIECE = 1 << 22        # bytes of a text that are split at a time

# bytes: A-Z become a-z, other ASCII but a-z becomes a space, bytes of longer code points stay
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _words(text: bytes):
    """Lists of the terms of a text; all but the last list come from ``PIECE`` bytes or more."""
    plain, at = text.translate(_TERM_BYTES), 0
    while len(plain) - at > PIECE:
        cut = plain.find(b" ", at + PIECE)
        if cut < 0:
            break
        yield plain[at:cut].split()
        at = cut
    yield plain[at:].split() if at else plain.split()


def _count_kernel(batches):
    """(lang, source, text) -> (lang, source, term, n, docs), summed per task as far as memory goes."""
    import pyarrow as pa

    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush():
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            if terms:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                     pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()),
                     pa.array([docs[t] for t in terms], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        lang, source = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        texts = batch.column("text").cast(pa.binary())
        for i, group in enumerate(zip(lang, source)):
            n, docs = held.setdefault(group, (Counter(), Counter()))
            seen: set[bytes] = set()
            for words in _words(texts[i].as_py()):
                n.update(words)
                seen.update(words)
            docs.update(seen)
            if i % 64 == 0 and sum(len(x) for x, _ in held.values()) > HELD_TERMS:
                yield from flush()
    yield from flush()


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, total, cells array<struct<source, n>>) of every kept term; written."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = rows.mapInArrow(_count_kernel, "lang string, source string, term string, n bigint, docs bigint")
    by_source = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # terms of too few documents leave before anything is gathered
    kept = by_source.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("cells"))
    return materialise(kept.filter(F.col("docs") >= min_docs).drop("docs"), "kept-terms")


def share(n: Column, of: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (n + 1) / (of + terms))``, exact for every long ``n``."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", top, (of + terms).cast("decimal(19,0)"))


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, no, n, lang_n, terms): every occurring group with its number inside the
    language, its and the language's count of kept terms, and their number; written."""
    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    used = kept.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    langs = kept.groupBy("lang").agg(F.sum("total").alias("lang_n"), F.count(F.lit(1)).alias("terms"))
    no = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    zero = F.lit(0).cast("bigint")
    sizes = groups.join(used, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", *[F.coalesce(F.col(c), zero).alias(c) for c in ("n", "lang_n", "terms")])
    return materialise(sizes.withColumn("no", no), "group-sizes")


# --- terms of a group ----------------------------------------------------------------

def top_terms(kept: DataFrame, sizes: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, item, value, rank): of every group the first ``top`` kept terms."""
    group = ["lang", "source"]
    uses = kept.select("lang", "term", "total", F.explode("cells").alias("c")) \
               .select("lang", F.col("c.source").alias("source"), "term", F.col("c.n").alias("n"), "total")
    cells = uses.groupBy(*group, "n", "total").agg(F.count(F.lit(1)).alias("many"))
    of = sizes.select(*group, F.col("n").alias("of"), "lang_n", "terms")
    cells = cells.join(checked_broadcast(of), group)
    cells = cells.select("*", share(F.col("n"), F.col("of"), F.col("terms")).alias("p"),
                         share(F.col("total"), F.col("lang_n"), F.col("terms")).alias("q")).filter("p > q")
    cells = materialise(cells.select(*group, "n", "total", "many", gap(F.col("p"), F.col("q")).alias("value")), "count-cells")

    # every value holds a term, so the first ``top`` values hold all wanted ranks
    highest = Window.partitionBy(*group).orderBy(F.desc("value"))
    values = cells.groupBy(*group, "value").agg(F.sum("many").alias("many")) \
                  .withColumn("nth", F.row_number().over(highest)).filter(F.col("nth") <= top)
    before = F.coalesce(F.sum("many").over(highest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = values.withColumn("before", before).filter(F.col("before") < top).select(*group, "value", "before")
    wanted = materialise(cells.join(values, [*group, "value"]).select(*group, "n", "total", "value", "before"), "ranked-cells")
    found = uses.join(checked_broadcast(wanted), [*group, "n", "total"])
    place = F.row_number().over(Window.partitionBy(*group, "value").orderBy("term"))
    found = found.withColumn("place", place).filter(F.col("place") <= top)
    rank = (F.col("before") + F.col("place")).cast("int")
    return found.select(*group, F.col("term").alias("item"), "value", rank.alias("rank")).filter(F.col("rank") <= top)


# --- pairs of sources ------------------------------------------------------------------

def _shares(n, of, terms):
    """``share`` over numpy longs, by long division in steps of 1000."""
    whole, rest = divmod(n + 1, of + terms)
    for _ in range(3):
        digit, rest = divmod(rest * 1000, of + terms)
        whole = whole * 1000 + digit
    return whole + 1


def _pair_kernel(batches):
    """Profiles of a pair of source blocks -> per pair of sources the sum of f and the
    number of terms behind it, summed per task as far as memory goes."""
    import numpy as np
    import pyarrow as pa

    held: dict[tuple, list] = {}
    names = ["lang", "a", "b", "value", "many"]

    def flush():
        for (lang, i, j), (value, many) in held.items():
            a, b = np.nonzero(~np.eye(*value.shape, k=(i - j) * BLOCK, dtype=bool))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(a), pa.string()), pa.array((a + i * BLOCK).astype("int32")),
                 pa.array((b + j * BLOCK).astype("int32")), pa.array(value[a, b]), pa.array(np.full(len(a), many, "int64"))], names=names)
        held.clear()

    def counts(rows, column, width, first):
        """Rows x sources of a block, from lists of (no, n)."""
        cells = column.take(pa.array(rows))
        sizes = np.diff(np.asarray(cells.offsets))
        flat = cells.flatten()
        no, n = (np.asarray(flat.field(k)) for k in ("no", "n"))
        row, at = np.repeat(np.arange(len(rows)), sizes), no - first
        ours = (at >= 0) & (at < width)
        out = np.zeros((len(rows), width), "int64")
        out[row[ours], at[ours]] = n[ours]
        return out

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("lang", "i", "j"))))
        by: dict[tuple, list[int]] = {}
        for at, key in enumerate(keys):
            by.setdefault(key, []).append(at)
        many_of, terms_of = np.asarray(batch.column("many")), np.asarray(batch.column("terms"))
        for key, rows in by.items():
            _, i, j = key
            of_i, of_j = (np.array(batch.column(c)[rows[0]].as_py(), "int64") for c in ("of_i", "of_j"))
            terms, many = int(terms_of[rows[0]]), many_of[rows]
            p = _shares(counts(rows, batch.column("cells"), len(of_i), i * BLOCK), of_i, terms)
            q = p if i == j else _shares(counts(rows, batch.column("cells"), len(of_j), j * BLOCK), of_j, terms)
            for lo, hi, x, y in ((i, j, p, q), *(() if i == j else ((j, i, q, p),))):
                total = np.stack([((x[:, [a]] - y) ** 2 // y * many[:, None]).sum(axis=0) for a in range(x.shape[1])])
                old = held.setdefault((key[0], lo, hi), [np.zeros_like(total), 0])
                old[0] += total
                old[1] += int(many.sum())
        if len(held) > 256:
            yield from flush()
    yield from flush()


def pair_gaps(kept: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of sources of a language."""
    no = F.map_from_entries(F.collect_list(F.struct("source", "no")))
    per_lang = sizes.groupBy("lang").agg(no.alias("nos"))
    cells = kept.join(checked_broadcast(per_lang), "lang").select("lang", F.sort_array(F.transform(
        "cells", lambda c: F.struct(F.element_at("nos", c["source"]).alias("no"), c["n"].alias("n")))).alias("cells"))
    profiles = cells.groupBy("lang", "cells").agg(F.count(F.lit(1)).alias("many"))

    block = F.floor(F.col("no") / BLOCK).cast("int")
    blocks = materialise(sizes.groupBy("lang", block.alias("block")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("no", "n"))), lambda x: x["n"]).alias("of"), F.first("terms").alias("terms")), "source-blocks")
    grid = blocks.select("lang", F.col("block").alias("i"), F.col("of").alias("of_i"), "terms") \
        .join(blocks.select("lang", F.col("block").alias("j"), F.col("of").alias("of_j")), "lang").filter("i <= j")
    in_block = F.exists("cells", lambda c: F.floor(c["no"] / BLOCK).cast("int").isin(F.col("i"), F.col("j")))
    met = profiles.join(checked_broadcast(grid), "lang").filter(in_block)
    sums = met.select("lang", "i", "j", "cells", "many", "of_i", "of_j", "terms") \
        .mapInArrow(_pair_kernel, "lang string, a int, b int, value bigint, many bigint")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("many").alias("many"))

    one = sizes.select("lang", "source", F.col("no").alias("a"), F.col("n").alias("n_a"), "terms")
    other = sizes.select("lang", F.col("source").alias("item"), F.col("no").alias("b"), F.col("n").alias("n_b"))
    pairs = one.join(other, "lang").filter("a <> b").join(sums, ["lang", "a", "b"], "left")
    zero = F.lit(0).cast("bigint")
    absent = F.col("terms") - F.coalesce(F.col("many"), zero)
    unseen = gap(share(zero, F.col("n_a"), F.col("terms")), share(zero, F.col("n_b"), F.col("terms")))
    value = F.when(F.col("terms") == 0, zero).otherwise(F.coalesce(F.col("value"), zero) + F.when(absent > 0, absent * unseen).otherwise(zero))
    return pairs.select("lang", "source", "item", value.alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): the parts ``pair`` and ``term``."""
    kept = term_counts(docs, min_docs)
    sizes = group_sizes(docs, kept)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_gaps(kept, sizes).withColumn("rank", rank)
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(
        top_terms(kept, sizes, top).withColumn("part", F.lit("term")).select(*columns))


AUDIT_SQL = r"""
with d as (select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
w as (select i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term, count(*) as total from w group by lang, term having count(distinct i) >= 3),
v as (select lang, count(*) as terms, sum(total) as n from k group by lang),
c as (select w.lang, w.source, w.term, count(*) as n from w join k on w.lang = k.lang and w.term = k.term group by all),
g as (select s.lang, s.source, coalesce(sum(c.n), 0) as n from (select distinct lang, source from d) s
      left join c on c.lang = s.lang and c.source = s.source group by s.lang, s.source),
p as materialized (select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
        cast(1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (g.n + v.terms) as bigint) as p,
        cast(1 + (1000000000::hugeint * (k.total + 1)) // (v.n + v.terms) as bigint) as q
      from g join k on k.lang = g.lang join v on v.lang = g.lang
      left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
s as (select a.lang, a.source, b.source as item, cast(sum(((a.p - b.p) * (a.p - b.p)) // b.p) as bigint) as value
      from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
      from g a join g b on a.lang = b.lang and a.source <> b.source
      left join s on s.lang = a.lang and s.source = a.source and s.item = b.source),
term as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q)) // q as value from p where n > 0 and p > q)
select lang, source, part, item, value, cast(rank as integer) as rank from (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
  from (select * from pair union all select * from term))
where part = 'pair' or rank <= 200
"""
