"""A manifest of a dataset: a hash tree over its rows, built by mountain ranges, with proofs that check single rows.

Method: leaves are numbered within their tree without gathering it: ranges of (tree, order) are
counted, so that each knows the index of its first leaf. A task goes through a range with a
stack that holds, for each level, the nodes of the run begun: when a run of FANOUT is complete,
its hash is carried a level up, where it may complete another. Each completed node is a record.
Where a range begins or ends within a run, the nodes of that run, its unaligned peaks, are
marked as edges; those of all ranges are merged level by level, by tree and run, which takes
a few rows for each range and level. A tree's last run may be short, even a single node, and
is hashed as it is: nothing is padded. A tree of trees has the first ones' roots as leaves.

Proofs go from the top down: a node's path is its siblings and its parent's path, joined by
parent (FANOUT rows a key) to nodes of BLOCK_LEVELS, and a task lays the levels below over
the FANOUT ** BLOCK_LEVELS leaves of such a node.

Cases: null columns are hashed as `-`, and a null lang is a tree of its own, the first; null
ids come first in their tree and are never tampered with; rows of one id are leaves in the
order of their hashes, and equal rows are as many equal leaves. Empty and very long texts are
hashed whole where they are read, and don't travel. An empty table has no trees and gives no
rows. Further columns, whatever they are called, aren't looked at. A hot lang, or one id in
very many rows, is spread over ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import dealt, parts, written

FANOUT = 8
BLOCK_LEVELS = 4


class Manifest(NamedTuple):
    """leaves (tree, idx, h, payload), nodes (tree, level, idx, h; leaves not among them), trees (tree, n, height, root)."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame


def framed(*values: Column) -> Column:
    """All values in one text that tells them apart: `-` for null, else the length in bytes, a colon and the value."""
    texts = (v.cast("string") for v in values)
    return F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def height_of(n: Column) -> Column:
    """How often n leaves have to be drawn together until one node is left; exact, by the bits of n - 1."""
    bits = FANOUT.bit_length() - 1
    return F.when(n <= 1, F.lit(0)).otherwise(F.ceil(F.length(F.bin(n - 1)) / F.lit(bits))).cast("int")


def build(rows: DataFrame, order: list[str], name: str) -> Manifest:
    """The manifest of rows (tree, h, payload, and the columns of order)."""
    ranged, spans = dealt(rows, "tree", [*order, "h"], name)
    heads = spans.select("tree", "__part", F.lit(0).alias("kind"), F.col("__base").alias("first"), F.col("__rows").alias("rows"), F.col("__total").alias("n"))
    nothing = {n: F.lit(None).cast(ranged.schema[n].dataType) for n in [*order, "h", "__tie", "payload"]}
    missing = {n: F.lit(None).cast("bigint") for n in ("first", "rows", "n")}
    both = heads.withColumns(nothing).unionByName(ranged.withColumns({"kind": F.lit(1), **missing}))
    # the tasks: one for each range, and each range's trees one after the other
    tasks = max(24, spans.agg(F.max("__part")).first()[0] or 0)
    both = both.repartition(tasks, "__part", "tree").sortWithinPartitions("__part", "tree", "kind", *order, "h", "__tie").select("tree", "kind", "first", "rows", "n", "h", "payload")
    schema = T.StructType([*T._parse_datatype_string("tree string, level int, idx bigint, h string, edge boolean"), T.StructField("payload", ranged.schema["payload"].dataType)])
    records = written(both.mapInArrow(mountain_ranges, schema), f"{name}-records")
    trees = spans.groupBy("tree").agg(F.sum("__rows").alias("n")).withColumn("height", height_of(F.col("n")))
    trees = written(trees, f"{name}-sizes")
    top = trees.agg(F.max("height")).first()[0] or 0
    nodes, merged = records.filter("level > 0").select("tree", "level", "idx", "h"), None
    for level in range(top):
        edges = records.filter((F.col("level") == level) & F.col("edge")).select("tree", "idx", "h")
        edges = edges if merged is None else edges.unionByName(merged.select("tree", "idx", "h"))
        runs = edges.groupBy("tree", F.floor(F.col("idx") / FANOUT).alias("idx")).agg(F.sort_array(F.collect_list(F.struct(F.col("idx").alias("i"), "h"))).alias("run"))
        hashed = F.sha2(F.array_join(F.col("run.h"), ""), 256)
        merged = written(runs.select("tree", F.lit(level + 1).alias("level"), "idx", hashed.alias("h")), f"{name}-merged")
        nodes = nodes.unionByName(merged)
    leaves = records.filter("level = 0").select("tree", "idx", "h", "payload")
    tops = nodes.select("tree", "level", "h").unionByName(leaves.filter("idx = 0").select("tree", F.lit(0).alias("level"), "h"))
    trees = trees.join(tops.withColumnRenamed("level", "height").withColumnRenamed("h", "root"), ["tree", "height"])
    return Manifest(leaves, nodes, written(trees.select("tree", "n", "height", "root"), f"{name}-trees"))


def mountain_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves with their indexes, and the nodes that are complete within a range; each range is led by its head."""
    sha, join = hashlib.sha256, "".join
    lo = hi = n = at = 0
    counts: list[int] = []  # nodes of the tree by level
    runs: list[list[str]] = []
    starts: list[int] = []

    def is_edge(level: int, idx: int) -> bool:
        """Whether the run that the node belongs to reaches beyond the range."""
        if counts[level] == 1:
            return False
        width = FANOUT ** (level + 1)
        begin = idx // FANOUT * width
        return begin < lo or min(begin + width, n) > hi

    for batch in batches:
        trees, kinds, firsts, sizes, totals, hashes = (c.to_pylist() for c in batch.columns[:6])
        keep, idxs, edges, up = [], [], [], []
        for row, (tree, kind) in enumerate(zip(trees, kinds, strict=True)):
            if not kind:
                lo, n = firsts[row], totals[row]
                hi, at, counts = lo + sizes[row], lo, [n]
                while counts[-1] > 1:
                    counts.append(-(-counts[-1] // FANOUT))
                runs, starts = [[] for _ in counts], [0] * len(counts)
                continue
            keep.append(row), idxs.append(at), edges.append(is_edge(0, at))
            level, idx, h = 0, at, hashes[row]
            at += 1
            while counts[level] > 1:
                if not runs[level]:
                    starts[level] = idx
                runs[level].append(h)
                if idx % FANOUT != FANOUT - 1 and idx != counts[level] - 1:
                    break
                run, runs[level] = runs[level], []
                if starts[level] % FANOUT:
                    break  # an unaligned peak: its run began in an earlier range
                level, idx, h = level + 1, idx // FANOUT, sha(join(run).encode()).hexdigest()
                up.append((tree, level, idx, h, is_edge(level, idx)))
        kept = batch.take(pa.array(keep, pa.int64()))
        yield pa.record_batch([kept.column(0), pa.array([0] * len(keep), pa.int32()), pa.array(idxs, pa.int64()), kept.column(5), pa.array(edges, pa.bool_()), kept.column(6)], names=["tree", "level", "idx", "h", "edge", "payload"])
        if up:
            cols = [pa.array(c, t) for c, t in zip(zip(*up, strict=True), [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.bool_()], strict=True)]
            yield pa.record_batch([*cols, pa.nulls(len(up), batch.schema.field("payload").type)], names=["tree", "level", "idx", "h", "edge", "payload"])


def paths(m: Manifest, low: int, above: DataFrame) -> DataFrame:
    """(tree, idx, above) for the nodes of level low, or the roots of lower trees: what stands before and after each node on the way up, root first in `above` (tree, above) of the trees."""
    heads = m.trees.join(above, "tree").select("tree", "height", F.lit(0).cast("bigint").alias("idx"), "above")
    top = m.trees.agg(F.max("height")).first()[0] or 0
    out = heads.filter(F.col("height") == max(top, low)).drop("height")
    for level in range(top - 1, low - 1, -1):
        nodes = m.nodes.filter(F.col("level") == level).select("tree", "idx", "h") if level else m.leaves.select("tree", "idx", "h")
        nodes = nodes.join(m.trees.filter(F.col("height") > level).select("tree"), "tree", "left_semi")
        runs = nodes.groupBy("tree", F.floor(F.col("idx") / FANOUT).alias("up")).agg(F.sort_array(F.collect_list(F.struct("idx", "h"))).alias("run"))
        each = runs.select("tree", "up", F.explode("run").alias("own"), "run")
        side = lambda test: F.array_join(F.transform(F.filter("run", test), lambda x: x.h), "")
        each = each.select("tree", "up", F.col("own.idx").alias("idx"), F.struct(side(lambda x: x.idx < F.col("own.idx")).alias("before"), side(lambda x: x.idx > F.col("own.idx")).alias("after")).alias("step"))
        up = out.withColumnRenamed("idx", "up")
        out = each.join(up, ["tree", "up"]).select("tree", "idx", F.concat(F.array("step"), "above").alias("above"))
        out = out.unionByName(heads.filter(F.col("height") == level).drop("height"))
    return out.unionByName(heads.filter(F.col("height") < low).drop("height"))


def prove(m: Manifest, above: DataFrame, subject: str) -> DataFrame:
    """(tree, idx, h, payload, proof, folded, subroot): the digest of each leaf's siblings, bottom up, and the top hash that its payload's `subject` (a leaf hash; null: its own) gives with them."""
    block = FANOUT**BLOCK_LEVELS
    heads = paths(m, BLOCK_LEVELS, above).withColumnRenamed("idx", "block").join(m.trees.select("tree", "height", "root"), "tree")
    payload = m.leaves.schema["payload"].dataType
    heads = heads.select("tree", "block", F.lit(-1).cast("bigint").alias("idx"), F.lit(None).cast("string").alias("h"), F.lit(None).cast(payload).alias("payload"), "above", "height", "root")
    none = F.lit(None)
    rows = m.leaves.select("tree", F.floor(F.col("idx") / block).alias("block"), "idx", "h", "payload", none.cast(heads.schema["above"].dataType).alias("above"), none.cast("int").alias("height"), none.cast("string").alias("root"))
    tasks = parts(m.leaves.count(), 50_000, 24)
    both = heads.unionByName(rows).repartition(tasks, "tree", "block").sortWithinPartitions("tree", "block", "idx")
    schema = T.StructType([*T._parse_datatype_string("tree string, idx bigint, h string"), T.StructField("payload", payload), *T._parse_datatype_string("proof string, folded string, subroot string")])
    return both.mapInArrow(lambda batches: proofs(batches, subject), schema)


def proofs(batches: Iterator[pa.RecordBatch], subject: str) -> Iterator[pa.RecordBatch]:
    """The leaves of whole blocks with their proofs; a block's head comes first, and a block ends where another begins."""
    held: list[pa.RecordBatch] = []
    head = None
    for batch in batches:
        firsts = [i for i, x in enumerate(batch.column("idx").to_pylist()) if x < 0]
        cuts = [0, *firsts, batch.num_rows]
        for i, (begin, end) in enumerate(zip(cuts, cuts[1:], strict=False)):
            part = batch.slice(begin, end - begin)
            if i:  # begins with a head
                if head is not None:
                    yield proven(head, held, subject)
                head = part.slice(0, 1).to_pylist()[0]
                held, part = [], part.slice(1)
            if part.num_rows:
                held.append(part)
    if head is not None:
        yield proven(head, held, subject)


def proven(head: dict, held: list[pa.RecordBatch], subject: str) -> pa.RecordBatch:
    sha, join = hashlib.sha256, "".join
    rows = pa.Table.from_batches(held).combine_chunks()
    level, ups = rows.column("h").to_pylist(), []
    for _ in range(min(BLOCK_LEVELS, head["height"])):
        ups.append(level)
        level = [sha(join(level[i : i + FANOUT]).encode()).hexdigest() for i in range(0, len(level), FANOUT)]
    above = [(s["before"], s["after"]) for s in head["above"]]
    way, tail = [above], [join(b + a for b, a in above)]  # of the nodes a level up
    for nodes in reversed(ups[1:]):
        steps = [(join(nodes[i // FANOUT * FANOUT : i]), join(nodes[i + 1 : i // FANOUT * FANOUT + FANOUT])) for i in range(len(nodes))]
        way = [[s, *way[i // FANOUT]] for i, s in enumerate(steps)]
        tail = [b + a + tail[i // FANOUT] for i, (b, a) in enumerate(steps)]
    given = [p[subject] for p in rows.column("payload").to_pylist()]
    leaves = ups[0] if ups else level
    shown, folded = [], []
    for i, own in enumerate(leaves):
        at = i // FANOUT * FANOUT if ups else i
        before, after = (join(leaves[at:i]), join(leaves[i + 1 : at + FANOUT])) if ups else ("", "")
        up = i // FANOUT if ups else 0
        shown.append(sha((before + after + tail[up]).encode()).hexdigest())
        h = given[i] or own
        if ups:
            h = sha((before + h + after).encode()).hexdigest()
        for b, a in way[up]:
            h = sha((b + h + a).encode()).hexdigest()
        folded.append(h)
    columns = [rows.column(n).combine_chunks() for n in ("tree", "idx", "h", "payload")]
    return pa.record_batch([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns] + [pa.array(shown, pa.string()), pa.array(folded, pa.string()), pa.array([head["root"]] * len(shown), pa.string())], names=["tree", "idx", "h", "payload", "proof", "folded", "subroot"])


def tree_name(lang: Column) -> Column:
    """Trees by name: that of null comes first, the others in the order of their bytes."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def dataset_manifest(docs: DataFrame) -> tuple[Manifest, Manifest]:
    """The manifest of documents, with a tree for each lang, and that of their roots; payloads: (doc_id, tampered) and the first's tree."""
    doc_id, text, lang = F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")
    leaf = lambda t: F.sha2(framed(doc_id, F.col("source"), lang, F.col("n_chars"), t), 256)
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(doc_id.cast("string")) % 3 == 0, leaf(lowered))
    rows = docs.select(tree_name(lang).alias("tree"), doc_id.alias("doc_id"), leaf(text).alias("h"), F.struct(doc_id.alias("doc_id"), tampered.alias("tampered")).alias("payload"))
    m = build(rows, ["doc_id"], "manifest")
    tops = m.trees.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("h"), F.struct(F.col("tree").alias("of"), F.lit(None).cast("string").alias("tampered")).alias("payload"))
    return m, build(tops, ["of"], "manifest-of-trees")


def verify_documents(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The proof is checked on a leaf that is tampered with where 3 divides the id's CRC.
    """
    m, top = dataset_manifest(docs)
    root = top.trees.first()
    start = top.trees.select("tree", F.array().cast("array<struct<before:string,after:string>>").alias("above"))
    above = paths(top, 0, start).drop("tree").join(top.leaves.select("idx", F.col("payload.of").alias("tree")), "idx").select("tree", "above")
    out = prove(m, written(above, "manifest-above"), "tampered")
    whole = F.lit(root["root"] if root else None).cast("string")
    return out.select("payload.doc_id", F.col("h").alias("leaf"), "subroot", whole.alias("root"), F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), F.coalesce(F.col("folded") == whole, F.lit(False)).alias("verified"))


ORACLE_SQL = """
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, text, CAST(doc_id AS VARCHAR) AS i, CAST(n_chars AS VARCHAR) AS n, source FROM documents
),
framed AS (
  SELECT doc_id, lang, text,
    coalesce(strlen(i) || ':' || i, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n) || ':' || n, '-') AS front
  FROM fields
),
leaves AS (
  SELECT doc_id, lang, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(front || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS lowered
  FROM framed
),
crc_steps AS (
  SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s, CAST(0 AS BIGINT) AS pos, CAST(4294967295 AS BIGINT) AS c FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, s, pos + 1,
    list_reduce(list_prepend(xor(c, CAST(ascii(s[pos + 1]) AS BIGINT)), [CAST(b AS BIGINT) FOR b IN range(8)]), lambda x, b: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)
  FROM crc_steps WHERE pos < strlen(s)
),
crc AS (SELECT doc_id, xor(c, 4294967295) AS crc FROM crc_steps WHERE pos = strlen(s)),
placed AS (
  SELECT l.doc_id, l.leaf, CASE WHEN c.crc % 3 = 0 THEN l.lowered ELSE l.leaf END AS subject,
    coalesce('=' || l.lang, '') AS tree,
    row_number() OVER (PARTITION BY l.lang ORDER BY l.doc_id NULLS FIRST, l.leaf, l.lowered) - 1 AS idx,
    count(*) OVER (PARTITION BY l.lang) AS n
  FROM leaves l LEFT JOIN crc c ON l.doc_id = c.doc_id
),
nodes AS (
  SELECT tree, CAST(0 AS BIGINT) AS level, idx, n, leaf AS h FROM placed
  UNION ALL
  SELECT tree, any_value(level) + 1, idx // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY tree, idx // 8
),
subroots AS (
  SELECT tree, h AS subroot, level AS height, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
),
tops AS (
  SELECT CAST(0 AS BIGINT) AS level, place AS idx, n, subroot AS h FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, idx // 8, any_value((n + 7) // 8), sha256(string_agg(h, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY idx // 8
),
sides AS (
  SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY a.tree, a.level, a.idx
),
top_sides AS (
  SELECT a.level, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
  FROM tops a JOIN tops b ON a.level = b.level AND a.idx // 8 = b.idx // 8 WHERE a.n > 1 GROUP BY a.level, a.idx
),
climb AS (
  SELECT row_number() OVER () AS row, doc_id, leaf, tree, CAST(0 AS BIGINT) AS level, idx, subject AS h, '' AS proof FROM placed
  UNION ALL
  SELECT c.row, c.doc_id, c.leaf, c.tree, c.level + 1, c.idx // 8, sha256(s.before || c.h || s.after), c.proof || s.before || s.after
  FROM climb c JOIN sides s ON s.tree = c.tree AND s.level = c.level AND s.idx = c.idx
),
climb_on AS (
  SELECT c.row, c.doc_id, c.leaf, s.subroot, CAST(0 AS BIGINT) AS level, s.place AS idx, c.h, c.proof
  FROM climb c JOIN subroots s ON s.tree = c.tree AND s.height = c.level
  UNION ALL
  SELECT c.row, c.doc_id, c.leaf, c.subroot, c.level + 1, c.idx // 8, sha256(s.before || c.h || s.after), c.proof || s.before || s.after
  FROM climb_on c JOIN top_sides s ON s.level = c.level AND s.idx = c.idx
)
SELECT c.doc_id, c.leaf, c.subroot, t.h AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = t.h AS verified
FROM climb_on c JOIN tops t ON t.n = 1 AND t.level = c.level
"""
