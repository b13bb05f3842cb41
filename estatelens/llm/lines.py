"""Removal of repeated and nearly repeated lines by deletion neighbourhoods, in DataFrame operations only.

A line goes if an earlier line (smaller document id, or same document and earlier place) has
the same text, or if both have MIN_WORDS words or more and lie within one word edit: a word
inserted, deleted or replaced. Lines are judged on the input, not on what is left.

Distinct lines are found first, each with its first place. Each distinct line emits its
variants within the bound as hashed keys: itself, itself without its i-th word, and the
latter with i. Lines that agree without their i-th words differ by a replacement, whichever
they are, so each is joined with the earliest of them only; a line that is another's variant
is joined with the earliest of those it is a variant of, and they with it. So the work is
linear in a key's rows, however many they are. Pairs are verified on the words. Of two lines
within one edit one half is untouched: lines that share neither their first nor their last p
words with another (p the largest power of two that fits twice) emit nothing, and those that
share only the first, or the last, emit no variants without one of these.

Keys are counted where they are made before they travel, so a variant that a third of all
lines share is a row for each task; the join that brings the earliest line to a key's lines has
exchanges of its own, which adaptive execution can split.

Defined results: blank lines are neither compared nor counted; a document that loses no line
keeps its text as it is, in others the kept lines are joined by line feeds; spaces, tabs and
carriage returns around a line don't count; words are what single spaces separate; null texts
stay null; null ids come last; rows of one id (and of null ids) are numbered by a hash of their
texts, and the row of the lower number is the earlier one: of equal rows one, whichever it is,
keeps the lines that the others lose; a very long text, or line, is compared whole; an empty
table gives no rows; other columns are kept, columns named n_lines or n_removed are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import dealt, forget, set_aside, written

MIN_WORDS = 10
PRIME = 2**59 - 55  # five times it fits a long
STEP = 256  # prefix sums are summed in runs of so many words, so that long lines don't cost their square


def trimmed(line: Column) -> Column:
    """The line without spaces, tabs and carriage returns at its ends; few lines have any, and looking is cheaper than trimming."""
    ends = reduce(lambda a, b: a | b, [test(line, F.lit(c)) for c in " \t\r" for test in (F.startswith, F.endswith)])
    return F.when(ends, F.btrim(line, F.lit(" \t\r"))).otherwise(line)


def line_array(text: Column) -> Column:
    """The distinct lines of a text that aren't blank, in order."""
    return F.array_distinct(F.filter(F.split(text, "\n"), lambda x: trimmed(x) != ""))


def _sums(values: Column):
    """Prefix sums modulo PRIME of an array, as a function of the place (0: nothing summed)."""
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STEP).cast("int")), lambda r: F.slice(values, r * STEP + 1, F.lit(STEP)))
    add = lambda acc, x: F.concat(acc, F.array((F.element_at(acc, -1) + x) % F.lit(PRIME)))
    scan = lambda xs: F.aggregate(xs, F.array(F.lit(0).cast("long")), add)
    return F.transform(runs, scan), lambda scans: scan(F.transform(scans, lambda s: F.element_at(s, -1)))


def half(n: str) -> Column:
    """The largest power of two that fits twice into n."""
    return F.expr(f"shiftleft(1, length(bin(({n}) div 2)) - 1)")


def variant_keys(lines: DataFrame) -> DataFrame:
    """(pos, h1, key, kind) of (pos, h1, line, first, last). kind 0: the line; 1: the line without a word; 2: the same with the word's place.

    first and last: whether the line's first and last words are shared with another (0: half of
    n - 1 words, 1: of n, null: not). Where its first ones only are, the edit lies behind them,
    or in a run of one word that reaches behind them; so with the last.
    """
    value = lambda place, word: F.pmod(F.xxhash64(place, word), F.lit(PRIME))
    df = lines.withColumn("w", F.split("line", " ", -1)).withColumn("n", F.size("w"))
    # place j and, for words after a gap, place j - 1
    df = df.withColumn("here", F.transform("w", lambda x, j: value(j, x))).withColumn("back", F.transform("w", lambda x, j: value(j - 1, x)))
    for name in ("here", "back"):
        scans, offsets = _sums(F.col(name))
        df = df.withColumn(f"{name}_scan", scans)
        df = df.withColumn(f"{name}_off", offsets(F.col(f"{name}_scan")))

    def upto(name: str, j: Column) -> Column:
        r = F.floor(j / STEP).cast("int")
        return F.get(F.col(f"{name}_off"), r) + F.get(F.get(F.col(f"{name}_scan"), r), j - r * STEP)

    total = lambda name: F.element_at(f"{name}_off", -1)

    def without(j: Column) -> Column:
        after = total("back") + F.lit(2 * PRIME) - upto("back", j) - F.get(F.col("back"), j)
        return F.xxhash64(F.col("n") - 1, F.pmod(upto("here", j) + after, F.lit(PRIME)))

    row = lambda key, kind: F.struct(key.alias("key"), F.lit(kind).cast("byte").alias("kind"))
    itself = F.xxhash64("n", total("here") % F.lit(PRIME))
    shared = lambda end: F.when(F.col(end) == 0, half("n - 1")).otherwise(half("n"))
    df = df.withColumn("from", F.when(F.col("last").isNull(), F.least(shared("first"), F.col("n") - 1)).otherwise(F.lit(0)))
    df = df.withColumn("to", F.when(F.col("first").isNull(), F.greatest(F.col("n") - 1 - shared("last"), F.lit(0))).otherwise(F.col("n") - 1))
    df = df.withColumn("variants", F.transform(F.sequence("from", "to"), without))
    keys = F.concat(F.array(row(itself, 0)), F.transform(F.array_distinct("variants"), lambda v: row(v, 1)), F.transform("variants", lambda v, j: row(F.xxhash64(v, j + F.col("from")), 2)))
    return df.select("pos", "h1", F.inline(keys))


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays differ by one insertion, deletion or replacement at most."""
    i = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
    rest = lambda w, start: F.slice(w, start, F.size(w) + 1)
    return (i == 0) | (rest(a, i + 1) == rest(b, i + 1)) | (rest(a, i + 1) == rest(b, i)) | (rest(a, i) == rest(b, i + 1))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", emptied: bool = True, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the text's repeated lines removed, n_lines (lines that aren't blank) and n_removed.

    min_words: how many words lines need to be compared for nearness; 1 compares all. emptied: whether documents of which no line is left stay. (A filter on n_removed says the
    same, but Spark would push it down and compute the lines again for each line kept.)
    """
    docs, named = set_aside(docs.drop("n_lines", "n_removed").withColumn(text_col, F.col(text_col).cast("string")), [id_col, text_col])
    low, high, longest = docs.agg(F.min(F.col(id_col).cast("long")), F.max(F.col(id_col).cast("long")), F.max(F.octet_length(text_col))).first()
    low, high, stride = low or 0, high or 0, (longest or 0) + 2  # a text has no more lines than bytes and one
    most = docs.groupBy(F.col(id_col).cast("long").alias("id")).count().agg(F.max("count")).first()[0] or 1
    wide = "long" if (high - low + 2) * most * stride < 2**62 else "decimal(38,0)"
    order = F.coalesce(F.col(id_col).cast(wide) - F.lit(low).cast(wide), F.lit(str(high - low + 1)).cast(wide))  # null ids last
    docs = docs.withColumn("__order", order.cast(wide))
    docs = (_numbered(docs, text_col) if most > 1 else docs.withColumn("__row", F.lit(0))).withColumn("__place", (F.col("__order") * F.lit(most).cast(wide) + F.col("__row").cast(wide)).cast(wide))
    base = docs.select("__place", F.col(text_col).alias("text"))

    every = base.select("__place", F.posexplode(line_array(F.col("text"))).alias("i", "raw")).withColumn("line", trimmed(F.col("raw")))
    words = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    every = every.withColumn("n", words).withColumn("p", half("n - 1")).withColumn("q", half("n"))  # a neighbour may have one word more
    ends = [F.when((F.col("n") >= min_words) & (F.lit(k == "p") | (F.col("p") != F.col("q"))), F.expr(f"xxhash64({k}, substring_index(line, ' ', {sign}{k}))")).alias(f"{k}{sign}") for k in "pq" for sign in ("", "-")]
    every = every.select((F.col("__place") * F.lit(stride).cast(wide) + F.col("i").cast(wide)).cast(wide).alias("pos"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"), *ends)
    distinct = every.groupBy("h1", "h2").agg(*[F.min(c).alias(c) for c in ("pos", "p", "p-", "q", "q-")])
    distinct = written(distinct, "lines", sweep=True)

    # lines that share their first or their last words with another
    ends = distinct.select("pos", "h1", "h2", F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(c).alias("end")) for side, c in enumerate(("p", "p-", "q", "q-"))])).alias("e"))
    ends = ends.select("pos", "h1", "h2", (F.col("e.side") % 2).alias("side"), (F.col("e.side") >= 2).cast("byte").alias("size"), "e.end").filter("end is not null")
    common = ends.groupBy("side", "end").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("side", "end")
    least = lambda side: F.min(F.when(F.col("side") == side, F.col("size")))
    near = ends.join(common, ["side", "end"], "left_semi").groupBy("pos", "h1", "h2").agg(least(0).alias("first"), least(1).alias("last"))
    wanted = near.withColumn("__place", _div(F.col("pos"), stride, wide)).withColumn("i", (F.col("pos") - F.col("__place") * F.lit(stride).cast(wide)).cast("int"))
    wanted = wanted.groupBy("__place").agg(F.collect_list(F.struct("i", "pos", "h1", "h2", "first", "last")).alias("wanted"))
    texts = base.join(wanted, "__place").select(line_array(F.col("text")).alias("d"), F.explode("wanted").alias("x"))
    texts = texts.select("x.pos", "x.h1", "x.h2", "x.first", "x.last", trimmed(F.get("d", F.col("x.i"))).alias("line")).filter((F.xxhash64("line") == F.col("h1")) & (F.xxhash64(F.lit("line"), "line") == F.col("h2")))
    texts = written(texts.select("pos", "h1", "first", "last", "line"), "near-lines", sweep=True)

    keys = variant_keys(texts)
    of = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("pos"))).alias(f"by{kind}")
    earliest = keys.groupBy("key").agg(of(0), of(1), of(2), F.max("pos").alias("last")).filter("least(by0, by1, by2) < last").drop("last")
    by = F.when(F.col("kind") == 0, F.col("by1")).when(F.col("kind") == 1, F.col("by0")).otherwise(F.col("by2"))
    pairs = keys.join(earliest, "key").withColumn("by", by).filter("pos > by").select("pos", "h1", "by").distinct()
    both = pairs.join(texts.select("pos", "h1", "line"), ["pos", "h1"]).join(texts.select(F.col("pos").alias("by"), F.col("line").alias("other")), "by")
    gone = both.filter(within_one_edit(F.split("line", " ", -1), F.split("other", " ", -1))).select("pos", "h1").distinct()
    gone = written(gone, "near-lines-gone", sweep=True)  # the keys are off the disk before the documents travel
    forget(texts)

    kept = distinct.select("pos", "h1").join(gone, ["pos", "h1"], "left_anti")
    kept = kept.withColumn("__place", _div(F.col("pos"), stride, wide)).withColumn("i", (F.col("pos") - F.col("__place") * F.lit(stride).cast(wide)).cast("int"))
    kept = kept.groupBy("__place").agg(F.array_sort(F.collect_list(F.struct("i", "h1"))).alias("__kept"))
    out = docs.join(kept, "__place", "left" if emptied else "inner").withColumn("__d", line_array(F.col(text_col)))
    total = F.size(F.filter(F.split(text_col, "\n"), lambda x: trimmed(x) != ""))
    out = out.withColumn("n_lines", F.coalesce(F.when(F.col(text_col).isNotNull(), total), F.lit(0)).cast("long"))
    own = F.filter("__kept", lambda k: F.coalesce(F.xxhash64(trimmed(F.get(F.col("__d"), k["i"]))) == k["h1"], F.lit(False)))
    out = out.withColumn("__own", F.coalesce(F.transform(own, lambda k: F.get(F.col("__d"), k["i"])), F.array().cast("array<string>")))
    out = out.withColumn("n_removed", F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("__own")).cast("long"))
    out = out.withColumn(text_col, F.when(F.col("n_removed") == 0, F.col(text_col)).otherwise(F.array_join("__own", "\n")))
    return named(out, "n_lines", "n_removed")


def _numbered(docs: DataFrame, text_col: str) -> DataFrame:
    """docs, written, with __row: the number of each row among those of its __order, however many they are."""
    rows, spans = dealt(docs.withColumn("__hash", F.xxhash64(text_col)), "__order", ["__hash"], "lines-rows")
    place = F.row_number().over(Window.partitionBy("__part", "__order").orderBy("__hash", "__tie"))
    rows = rows.join(spans.select("__order", "__part", "__base"), ["__part", "__order"])
    return written(rows.withColumn("__row", F.col("__base") + place - 1).drop("__part", "__base", "__hash", "__tie"), "lines-numbered")


def _div(pos: Column, stride: int, wide: str) -> Column:
    if wide == "long":
        return F.expr(f"pos div {stride}")
    return F.floor(pos / F.lit(stride).cast(wide)).cast(wide)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_sha256 (of the text that is left; null: empty) of every document."""
    out = drop_repeated_lines(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = """
with a as (select doc_id, text, string_split(text, chr(10)) as raw from documents),
l as (select doc_id, i, raw[i] as raw, trim(raw[i], ' ' || chr(9) || chr(13)) as t from (select doc_id, raw, unnest(range(1, len(raw) + 1)) as i from a)),
n as (select * from l where t <> ''),
f as (select t, min(doc_id * 4294967296 + i) as pos from n group by t),
w as (select t, pos, string_split(t, ' ') as w from f where len(string_split(t, ' ')) >= 10),
v as (select t, pos, i, array_to_string(list_concat(w[: i - 1], w[i + 1 :]), ' ') as v from (select *, unnest(range(1, len(w) + 1)) as i from w)),
e as (select v, i, min(pos) as p from v group by all),
gone as (select t from v join e using (v, i) where p < pos union select w.t from w join v on v.v = w.t where v.pos < w.pos union select v.t from v join w on w.t = v.v where w.pos < v.pos),
kept as (select doc_id, count(*) as k, string_agg(raw, chr(10) order by i) as left_ from n join f using (t) where doc_id * 4294967296 + i = pos and t not in (select t from gone) group by doc_id),
c as (select doc_id, count(*) as n from n group by doc_id)
select a.doc_id, coalesce(n, 0) as n_lines, coalesce(n, 0) - coalesce(k, 0) as n_removed,
       sha256(coalesce(case when coalesce(n, 0) = coalesce(k, 0) then text else coalesce(left_, '') end, '')) as kept_sha256
from a left join c using (doc_id) left join kept using (doc_id)
"""
