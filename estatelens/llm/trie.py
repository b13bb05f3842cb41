"""A trie of conversations by partition refinement: which openings conversations share, and what sharing them saves.

Method: all conversations begin in one class, the root. Each turn splits the active classes by
role and text; a class is named by a digest of all its turns, which each conversation derives
for itself, so that splitting needs no look at the class. A class of a single conversation is
retired: what is left of that conversation is emitted as a chain of nodes with one child each.
A round takes as many turns as all rounds before it, at most ROUND_TURNS, so that conversations
that are copies of each other down to the end take few rounds and a task holds few turns of one.
Then the rounds are folded back, the last one first: a node's worth is given to its smallest
member, each member adds up what it was given from a depth on, and a class sums its members.

Cases: rows of null conv_id belong to no conversation and are left out; null turns come first;
turns of one number are taken in the order of the SHA-256 of role and text, so equal rows are as many equal
turns; null and empty roles and texts are alike. An empty table has no root and gives no rows.
Turns are hashed where they are read; texts don't travel, however long. Further columns aren't
looked at. A conversation of very many turns is spread over ranges of turns, a class of very
many members and a node of very many children by partial sums; the parents that many children
ask for (at most HEAVY_PARENTS) are broadcast. The digest of a node's ends runs through all its
ids in their order, which SHA-256 allows in one task only: they come as joined texts of up to
ENDS_RANGE ids each, and one such text is held at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import dealt, forget, written

ROUND_TURNS = 64
HEAVY_PARENTS = 1000
ENDS_RANGE = 65_536  # of conv_id
WORD = r"[^\x20\x09-\x0D]+"
FORK = 20  # conversations of so many ids may open with the turns of the first one


def root_class() -> Column:
    return F.lit(b"")


def digest(c: Column) -> Column:
    """128 bits of its SHA-256."""
    return F.substring(F.unhex(F.sha2(c, 256)), 1, 16)


def indexed_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, part, idx, h, words): each turn's place, from 0, in its conversation; and (conv, part, n) for each range of a conversation. Both written."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # lengths tell apart what follows them; the words are those of the text
    h = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), h.alias("order"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    rows, spans = dealt(rows.filter("conv is not null"), "conv", ["turn", "order"], "turns")
    place = F.row_number().over(Window.partitionBy("__part", "conv").orderBy("turn", "order", "__tie"))
    rows = rows.join(spans.select("conv", "__part", "__base"), ["__part", "conv"])
    rows = rows.select("conv", F.col("__part").alias("part"), (F.col("__base") + place - 1).alias("idx"), F.substring(F.unhex("order"), 1, 16).alias("h"), "words")
    return written(rows, "turns-indexed"), spans.select("conv", F.col("__part").alias("part"), F.col("__total").alias("n"))


def forked(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rebuilt conversations: (conv, part, depth, h, words) from depth 1 on, (conv, part, len) for each range, and (conv, len); all written.

    The opening is taken from the conversation whose id is the next lower multiple of FORK, h =
    crc32(id) % 4 turns of it or all that it has; the conversation's own first h turns go.
    """
    turns, spans = indexed_turns(conversations)
    h = F.crc32(F.col("conv").cast("string")) % 4
    first = F.col("conv") - F.col("conv") % FORK
    own = spans.select("conv", "n").distinct()
    of = own.select(F.col("conv").alias("first"), F.col("n").alias("first_n"))
    convs = own.withColumn("first", first).withColumn("h", h).join(of, "first", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("first_n", F.lit(0))))
    convs = written(convs.withColumn("len", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).select("conv", "first", "h", "taken", "len"), "convs")
    heads = turns.filter("idx < 3").select(F.col("conv").alias("first"), "idx", F.col("h").alias("turn_h"), "words")
    opening = convs.join(heads, "first").filter("idx < h").select("conv", F.lit(-1).alias("part"), (F.col("idx") + 1).alias("depth"), F.col("turn_h").alias("h"), "words")
    ranges = written(spans.join(convs, "conv").select("conv", "part", "taken", "len"), "ranges")
    rest = turns.join(ranges.select("conv", "part", "taken"), ["conv", "part"]).filter(F.col("idx") >= h)
    rest = rest.select("conv", "part", (F.col("idx") - h + F.col("taken") + 1).alias("depth"), "h", "words")
    ranges = ranges.select("conv", "part", "len").unionByName(convs.select("conv", F.lit(-1).alias("part"), "len"))
    return written(opening.unionByName(rest), "rebuilt"), ranges, convs.select("conv", "len")


def refine(turns: DataFrame, convs: DataFrame):
    """The rounds: members (conv, len, depth, cls, parent, words) and classes (cls, conv, depth, n, parent, words, len) of each, and the conversations that each retires (conv, after, len)."""
    active = convs.filter("len > 0").select("conv", "len", root_class().alias("cls"))
    done, rounds = 0, []
    while True:
        take = max(1, min(done, ROUND_TURNS))
        step = turns.filter(F.col("depth").between(done + 1, done + take)).select("conv", "depth", "h", "words")
        each = step.join(active, "conv").groupBy("conv").agg(F.first("cls").alias("cls"), F.first("len").alias("len"), F.sort_array(F.collect_list(F.struct("depth", "h", "words"))).alias("turns"))
        grown = F.aggregate("turns", F.array(F.struct(F.lit(0).cast("long").alias("depth"), F.col("cls").alias("cls"), F.col("cls").alias("parent"), F.lit(0).cast("long").alias("words"))), lambda way, t: F.concat(way, F.array(F.struct(t["depth"].cast("long").alias("depth"), digest(F.concat(F.element_at(way, -1)["cls"], t["h"])).alias("cls"), F.element_at(way, -1)["cls"].alias("parent"), t["words"].alias("words")))))
        members = each.select("conv", "len", F.explode(F.slice(grown, 2, take)).alias("t")).select("conv", "len", "t.depth", "t.cls", "t.parent", "t.words")
        members = written(members, "members")
        classes = members.groupBy("cls").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"), *(F.max(c).alias(c) for c in ("depth", "parent", "words", "len")))
        classes = written(classes, "classes")
        done += take
        if classes.isEmpty():
            forget(members, classes)
            return rounds
        last = members.filter((F.col("depth") == done) & (F.col("len") > done)).select("conv", "len", "cls")
        alone = classes.filter((F.col("n") == 1) & (F.col("depth") == done)).select("conv")
        retired = written(last.join(alone, "conv", "left_semi").select("conv", F.lit(done).cast("long").alias("after"), "len"), "retired")
        active = written(last.join(alone, "conv", "left_anti"), "active")
        rounds.append((members, classes, retired))


def fold(rounds) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cls, n_leaves, saved_tokens) of every class; what is left for the root (conv, leaves, saved); and (cls, n_children) of classes that others came from."""
    kids = None
    for _, classes, _ in rounds:
        count = classes.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
        kids = count if kids is None else kids.unionByName(count)
    kids = written(kids.groupBy(F.col("parent").alias("cls")).agg(F.sum("n_children").alias("n_children")), "children")
    carry, sums = None, None
    for members, classes, retired in reversed(rounds):
        worth = classes.join(kids, "cls", "left")
        childless = F.when(F.col("n") == 1, F.col("depth") == F.col("len")).otherwise(F.col("n_children").isNull())
        worth = worth.select("conv", "depth", childless.cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("words")).alias("saved"))
        given = members.select("conv", "depth", "cls").join(worth, ["conv", "depth"], "left").fillna(0, ["leaves", "saved"])
        below = retired.select("conv", F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
        below = below if carry is None else below.unionByName(carry)
        below = below.select("conv", F.lit(2**62).alias("depth"), F.lit(None).cast("binary").alias("cls"), "leaves", "saved")
        upward = Window.partitionBy("conv").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
        added = written(given.unionByName(below).withColumns({"leaves": F.sum("leaves").over(upward), "saved": F.sum("saved").over(upward)}), "folded")
        summed = added.filter("cls is not null").groupBy("cls").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
        sums = summed if sums is None else sums.unionByName(summed)
        carry = added.groupBy("conv").agg(F.max("leaves").alias("leaves"), F.max("saved").alias("saved"))
    return sums, carry, kids


def ends_digests(ends: DataFrame) -> DataFrame:
    """(cls, ends_sha256): the digest of the ids (cls, conv) of each class, ascending and joined by commas."""
    block = F.floor(F.col("conv") / ENDS_RANGE)
    texts = ends.groupBy("cls", block.alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    return texts.repartition("cls").sortWithinPartitions("cls", "block").mapInArrow(running_digests, "cls binary, ends_sha256 string")


def running_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, done, now, sha = [], [], None, None
    for batch in batches:
        for cls, ids in zip(batch.column("cls").to_pylist(), batch.column("ids"), strict=True):
            if cls != now:
                if now is not None:
                    names.append(now), done.append(sha.hexdigest())
                now, sha = cls, hashlib.sha256(ids.as_buffer())
            else:
                sha.update(b",")
                sha.update(ids.as_buffer())
        if names:
            yield pa.record_batch([pa.array(names, pa.binary()), pa.array(done, pa.string())], names=["cls", "ends_sha256"])
            names, done = [], []
    if now is not None:
        yield pa.record_batch([pa.array([now], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["cls", "ends_sha256"])


def with_parents(classes: DataFrame, kids: DataFrame, root: int) -> DataFrame:
    """The classes with parent_conv_id, the smallest member of their parent."""
    top, rest = classes.filter("depth = 1").withColumn("parent_conv_id", F.lit(root)), classes.filter("depth > 1")
    ids = classes.select(F.col("cls").alias("parent"), F.col("conv").alias("parent_conv_id"))
    # no more than HEAVY_PARENTS parents can have that many of all classes as children
    heavy = kids.filter(F.col("n_children") > classes.count() / HEAVY_PARENTS).select(F.col("cls").alias("parent"))
    hot = F.broadcast(ids.join(F.broadcast(heavy), "parent", "left_semi"))
    light = rest.join(F.broadcast(heavy), "parent", "left_anti").join(ids, "parent")
    return top.unionByName(rest.join(hot, "parent")).unionByName(light.select(top.columns))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, ranges, convs = forked(conversations)
    rounds = refine(turns, convs)
    n, root = convs.agg(F.count(F.lit(1)), F.min("conv")).first()
    schema = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
    if not n:
        return conversations.sparkSession.createDataFrame([], schema)
    ends = convs.filter("len = 0").select(root_class().alias("cls"), "conv")
    for members, _, _ in rounds:
        ends = ends.unionByName(members.filter("depth = len").select("cls", "conv"))
    ends = ends_digests(ends)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    own = F.col("conv_id"), F.col("depth"), F.col("parent_conv_id"), F.col("n_convs"), F.col("n_children"), F.col("n_leaves"), F.col("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256")
    none = F.lit(None).cast("bigint")
    if not rounds:  # turnless conversations only
        top = ends.select(F.lit(root).alias("conv_id"), F.lit(0).cast("bigint").alias("depth"), none.alias("parent_conv_id"), F.lit(n).alias("n_convs"), F.lit(0).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"), "ends_sha256")
        return top.select(*own)
    sums, carry, kids = fold(rounds)
    leaves, saved = carry.agg(F.sum("leaves"), F.sum("saved")).first()
    classes = rounds[0][1]
    for _, more, _ in rounds[1:]:
        classes = classes.unionByName(more)
    shared = with_parents(classes, kids, root).join(sums, "cls").join(kids, "cls", "left").join(ends, "cls", "left")
    shared = shared.withColumnsRenamed({"conv": "conv_id", "n": "n_convs"}).withColumn("n_children", F.when(F.col("n_convs") == 1, (F.col("depth") < F.col("len")).cast("bigint")).otherwise(F.coalesce("n_children", F.lit(0))))
    tops = convs.sparkSession.createDataFrame([(root, 0, None, n, leaves, saved, bytearray())], "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_leaves bigint, saved_tokens bigint, cls binary")
    tops = tops.join(kids, "cls", "left").join(ends, "cls", "left")
    retired = rounds[0][2]
    for _, _, more in rounds[1:]:
        retired = retired.unionByName(more)
    tails = turns.join(ranges.join(retired.select("conv", "after"), "conv"), ["conv", "part"]).filter("depth > after")
    last = F.col("depth") == F.col("len")
    tails = tails.select(F.col("conv").alias("conv_id"), "depth", F.col("conv").alias("parent_conv_id"), F.lit(1).cast("bigint").alias("n_convs"), (~last).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv").cast("string"), 256)).alias("ends_sha256"))
    return tops.select(*own).unionByName(shared.select(*own)).unionByName(tails.select(*own))


ORACLE_SQL = """
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
crc_steps AS (
  SELECT c, CAST(c AS VARCHAR) AS s, CAST(0 AS BIGINT) AS pos, CAST(4294967295 AS BIGINT) AS v FROM ids
  UNION ALL
  SELECT c, s, pos + 1,
    list_reduce(list_prepend(xor(v, CAST(ascii(s[pos + 1]) AS BIGINT)), [CAST(b AS BIGINT) FOR b IN range(8)]), lambda x, b: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)
  FROM crc_steps WHERE pos < strlen(s)
),
heads AS (SELECT c, c - c % 20 AS b, xor(v, 4294967295) % 4 AS h FROM crc_steps WHERE pos = strlen(s)),
turns AS (
  SELECT conv_id AS c, key, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS i, words
  FROM (SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL)
),
rebuilt AS (
  SELECT h.c, 0 AS own, t.i, t.key, t.words FROM heads h JOIN turns t ON t.c = h.b AND t.i <= h.h
  UNION ALL
  SELECT h.c, 1, t.i, t.key, t.words FROM heads h JOIN turns t ON t.c = h.c AND t.i > h.h
),
ways AS (
  SELECT c, row_number() OVER w AS depth, count(*) OVER (PARTITION BY c) AS len, words, string_agg(key, '') OVER w AS way
  FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY own, i ROWS UNBOUNDED PRECEDING)
),
members AS (
  SELECT c, depth, len, words, way FROM ways
  UNION ALL
  SELECT i.c, 0, coalesce(w.len, 0), 0, '' FROM ids i LEFT JOIN ways w ON w.c = i.c AND w.depth = 1
),
nodes AS (
  SELECT depth, way, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (depth = len), '')) AS ends_sha256
  FROM members GROUP BY depth, way
),
links AS (
  SELECT n.depth, n.way, p.conv_id AS parent_conv_id, p.way AS parent_way FROM nodes n
  JOIN members m ON m.c = n.conv_id AND m.depth = n.depth - 1 JOIN nodes p ON p.depth = m.depth AND p.way = m.way
),
kids AS (SELECT depth - 1 AS depth, parent_way AS way, count(*) AS n_children FROM links GROUP BY ALL),
worth AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children, (n.n_convs - 1) * n.words AS saved FROM nodes n LEFT JOIN kids k USING (depth, way)
),
below AS (
  SELECT m.depth, m.way, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(w.saved) AS saved_tokens
  FROM worth w JOIN members m ON m.c = w.conv_id AND m.depth <= w.depth GROUP BY m.depth, m.way
)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, l.parent_conv_id, w.n_convs, w.n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
  CAST(b.saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM worth w JOIN below b USING (depth, way) LEFT JOIN links l USING (depth, way)
"""
