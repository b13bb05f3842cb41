"""Near-duplicate documents from bottom-k sketches of one hash function.

A document's set is its distinct shingles of five words; its sketch is the k smallest
hashes. Inverted lists of sketch values generate overlaps. Two documents with a Jaccard
index of 0.75 or more share far more than SHARED of their sketch values (a share of 0.4
lies 4.9 standard deviations below the mean at k = 32, a chance of about 1 in 10 ** 6), so
by the prefix principle they also share one of each other's rarest k - SHARED + 1 values:
only those go into the lists, and values that many documents share stay out of them unless
most of a sketch is such values.

Each list is first compared with its hub, the member that shares most of its sketch with
others, one pair for each member. Pairs are filtered by the union sketch's estimate and
verified on the full sets of words. What this leaves apart is compared with the rest of its
hub's lists: in small groups pair by pair, in others block by block, where BLOCK members
meet in one task: there, too, inverted lists of sketch values give the overlaps, the union
sketch filters and the exact sets verify, and only links that join components are given. At
first each member is in one block, whose links leave few members of a group of near copies
outside its largest component. Then those that are still outside meet all members of the
group, a row for each member and block of the others. Equal texts (by their SHA-256) are one node
throughout. Components come from rounds over written tables.

The number of shingles is counted from 64-bit hashes; hashes that occur twice in a text are
compared by their words, and a text in which two shingles share a hash is counted word by word.

Defined results: null and wordless texts have empty sets and link with nothing; texts under
five words have one shingle, all their words; null ids come last, have a null component and
are kept as documents of their own if nothing with an id links to them; rows of one id are
separate documents.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LAST, first_of, forget, mix, set_aside, windows, written
from .components import components

SHINGLE = 5
SKETCH = 32
SHARED = 0.4
SIMILAR = 75  # hundredths
MARGIN = 0.35  # of the estimate, 4.6 standard deviations at k = 32
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL_GROUP = 4096  # pairs
BLOCK = 256
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def word_list(text: str | None) -> list[str]:
    return WORD.findall(text.translate(LOWER) if text else "")


def shingles(words: list[str], n: int = SHINGLE) -> set:
    if len(words) < n:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(n)), strict=False))


class Hasher(dict):
    """Hashes of words, kept."""

    def __missing__(self, word: str) -> int:
        out = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return out


def sketches(texts: list[str | None], hasher: Hasher, n: int, k: int) -> list[tuple[int, np.ndarray]]:
    """Each text's number of distinct shingles and its k smallest shingle hashes."""
    if len(hasher) > 300_000:
        hasher.clear()
    words = [word_list(t) for t in texts]
    sizes = np.array([len(w) for w in words])
    hashes = np.fromiter((hasher[w] for ws in words for w in ws), np.uint64, int(sizes.sum()))
    of = np.repeat(np.arange(len(texts)), sizes)
    values, at = windows(hashes, of, n)
    values >>= np.uint64(1)  # non-negative as Spark's long, so that both order them alike
    ends = np.searchsorted(of[at], np.arange(len(texts) + 1))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for i, size in enumerate(sizes):
        count = None
        if size >= n:
            order = ends[i] + np.argsort(values[ends[i] : ends[i + 1]], kind="stable")
            own = values[order]
            new = first_of(own)
            again = np.flatnonzero(~new)
            if len(again) and any((hashes[at[order[again]] + j] != hashes[at[order[again - 1]] + j]).any() for j in range(n)):
                count = len(shingles(words[i], n))
            own = own[new]
        elif size:  # fewer words than a shingle: the words and their number
            own = np.array([size], np.uint64)
            for h in hashes[starts[i] : starts[i] + size]:
                own = mix(own ^ h)
            own >>= np.uint64(1)
        else:
            own = np.zeros(0, np.uint64)
        out.append((len(own) if count is None else count, own[:k]))
    return out


def sketched(docs: DataFrame, n: int = SHINGLE, k: int = SKETCH) -> DataFrame:
    """id, node (of equal texts), size and sketch of (id, text)."""

    def run(batches):
        hasher = Hasher()
        for whole in batches:
            for batch in (whole.slice(i, 400) for i in range(0, whole.num_rows, 400)):
                found = sketches(batch.column("text").to_pylist(), hasher, n, k)
                values = pa.array(np.concatenate([v for _, v in found]).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(v) for _, v in found])]), pa.int32()), values)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("node"), pa.array([s for s, _ in found], pa.int64()), lists], names=["id", "node", "size", "sketch"])

    return docs.select("id", _node("text").alias("node"), "text").mapInArrow(run, "id bigint, node binary, size bigint, sketch array<bigint>")


def jaccard_links(pairs: DataFrame, n: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """The pairs (a, b, text_a, text_b) whose full sets of shingles reach the Jaccard index, verified on the words themselves."""

    def run(batches):
        key, right = None, set()
        for whole in batches:
            for batch in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                keep = []
                for b, text_a, text_b in zip(*(batch.column(c).to_pylist() for c in ("b", "text_a", "text_b")), strict=True):
                    if b != key:
                        key, right = b, shingles(word_list(text_b), n)
                    left = shingles(word_list(text_a), n)
                    both = len(left & right)
                    keep.append(both > 0 and 100 * both >= similar * (len(left) + len(right) - both))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def _node(text_col: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, node, size) of every document, and (node, root) of every node that links with another."""
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    docs = docs.select(ids.alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    every = written(sketched(docs), "sketches")
    nodes = every.filter("size > 0").groupBy("node").agg(F.min("id").alias("id"), F.max("size").alias("size"), F.first("sketch").alias("sketch"))
    nodes = written(nodes, "nodes")
    lists = written(postings(nodes), "postings")

    hubs = lists.groupBy("value").agg(F.max(F.struct("shared", "node"))["node"].alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = written(lists.join(hubs, "value").select(F.col("node").alias("a"), "b", "size").distinct(), "members")
    stars = members.filter("a <> b").select("a", "b")

    # the texts that pairs can ask for, once
    listed = nodes.select("id", "node").join(lists.select("node").distinct(), "node")
    texts = docs.select("id", _node("text").alias("node"), "text").join(listed, ["id", "node"], "left_semi").select("node", "text")
    texts = written(texts, "texts")
    links = verified(stars, nodes, texts)
    first = components(links)

    # what the stars have left apart, against all members of the hub's lists
    held, written_held = lying_apart(members, first)
    large = F.col("few") * F.col("all") > SMALL_GROUP
    small = held.filter(~large)
    left = small.filter("apart").select("b", F.col("a").alias("l"), F.col("root").alias("l_root"), F.col("size").alias("l_size"))
    across = left.join(small.select("b", F.col("a").alias("r"), "root", "size"), "b").filter(f"root <> l_root and 100 * least(size, l_size) >= {SIMILAR} * greatest(size, l_size)")
    across = across.select(F.greatest("l", "r").alias("a"), F.least("l", "r").alias("b")).distinct()
    more = verified(across, nodes, texts), blockwise(held.filter(large), texts, nodes, whole=False)
    linked = lambda roots, *links: components(functools.reduce(DataFrame.union, links, roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    roots = linked(first, *more)

    # in large groups few are apart by now, but for groups whose members aren't alike
    rest, written_rest = lying_apart(held.filter(large).select("b", "a", "size"), roots)
    if not rest.isEmpty():
        more = *more, blockwise(rest, texts, nodes)
        roots = linked(roots, more[-1])
    forget(nodes, lists, members, texts, links, written_held, written_rest, *more)
    return every.drop("sketch"), roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id and kept of every document."""
    every, roots = groups(docs, id_col, text_col)
    nodes = every.filter("size > 0").groupBy("node").agg(F.min("id").alias("id")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = nodes.groupBy("root").agg(F.min("id").alias("component"))
    out = every.join(nodes.join(smallest, "root").select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "id"))
    named_id = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return out.select(named_id("id").alias(id_col), F.col("size").alias("n_shingles"), named_id("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, one row of each group of near copies: that of the smallest id (of equal rows, any). Wordless texts all stay."""
    docs, named = set_aside(docs, [id_col, text_col])
    every, roots = groups(docs, id_col, text_col)
    nodes = every.filter("size > 0").groupBy("node").agg(F.min("id").alias("id")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    stays = nodes.groupBy("root").agg(F.min(F.struct("id", "node")).alias("s")).select(F.col("s.id").alias("__id"), F.col("s.node").alias("__node"))
    keyed = docs.withColumn("__id", F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))).withColumn("__node", _node(text_col))
    wordless = F.coalesce(~F.col(text_col).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    chosen = keyed.filter(~wordless).join(stays, ["__id", "__node"], "left_semi").dropDuplicates(["__id", "__node"])
    return named(chosen.unionByName(keyed.filter(wordless)))


def postings(nodes: DataFrame, k: int = SKETCH) -> DataFrame:
    """(value, node, size, shared): the inverted lists of each node's rarest sketch values that others hold too; shared: how many it has."""
    spread = nodes.select("node", "size", F.explode("sketch").alias("value"))
    often = spread.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = spread.join(often, "value").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("held"))
    sketch = F.least(F.col("size"), F.lit(k))
    need = F.greatest(F.lit(1), F.floor(sketch * SHARED))
    prefix = sketch - need + 1 - (sketch - F.size("held"))  # values that only this node holds are the rarest
    shared = shared.withColumn("prefix", prefix.cast("int")).filter("prefix > 0")
    return shared.select("node", "size", F.size("held").alias("shared"), F.explode(F.slice("held", F.lit(1), F.col("prefix"))).alias("v")).select(F.col("v.value").alias("value"), "node", "size", "shared")


def lying_apart(members: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members (b: the group, a, size) with their root, whether it's another than the group's commonest (apart), the number of such (few) and of all, without groups that have one root or are the hub's pair; and the written table."""
    held = members.join(roots.select(F.col("node").alias("a"), "root"), "a", "left").select("b", "a", "size", F.coalesce("root", "a").alias("root"))
    held = written(held, "held")
    each = held.groupBy("b", "root").agg(F.count(F.lit(1)).alias("n"))
    count = each.groupBy("b").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all")).withColumn("few", F.col("all") - F.col("most.n")).filter("few > 0 and all > 2")
    count = count.select("b", "few", "all", F.col("most.root").alias("most"))
    return held.join(count, "b").withColumn("apart", F.col("root") != F.col("most")).drop("most"), held


def blockwise(held: DataFrame, texts: DataFrame, nodes: DataFrame, whole: bool = True) -> DataFrame:
    """Links (a, b) between members (a, root) of large groups (b) that lie apart and all members of the group, in blocks; if not whole, between those of one block only, where each member is in one."""
    held = held.join(nodes.select(F.col("node").alias("a"), "sketch"), "a").join(texts.select(F.col("node").alias("a"), "text"), "a")
    parts = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    own = lambda c: F.pmod(F.xxhash64("a"), parts(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), parts(c) - 1)) if whole else F.lit(0)
    rows = held.filter("apart").select("b", own("few" if whole else "all").alias("i"), every("all").alias("j"), F.lit(0).alias("side"), "a", "root", "text", "sketch")
    others = held.select("b", every("few"), own("all"), F.lit(1), "a", "root", "text", "sketch") if whole else held.select("b", own("all"), F.lit(0), F.lit(1), "a", "root", "text", "sketch")
    rows = rows.union(others).repartition("b", "i", "j").sortWithinPartitions("b", "i", "j", "side")
    return written(rows.mapInArrow(_block_links, "a binary, b binary"), "block-links")


def _block_links(batches):
    def rows():
        for whole in batches:
            for batch in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    for _, group in itertools.groupby(rows(), key=lambda r: r[:3]):
        found = joining_links([(r[3], r[4], r[5], shingles(word_list(r[6])), np.array(r[7], np.int64)) for r in group])
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], names=["a", "b"])


def joining_links(members: list[tuple], similar: int = SIMILAR, k: int = SKETCH) -> list[tuple]:
    """Links between members of side 0 and of side 1, (side, node, root, set, sketch): as many as join their components.

    Inverted lists of the sketches' values give the overlaps; pairs that the union sketch lets
    pass, and whose components are still apart, are verified on the sets.
    """
    left, right = [m for m in members if m[0] == 0], [m for m in members if m[0] == 1]
    index: dict = {}
    for i, m in enumerate(right):
        for x in m[4].tolist():
            index.setdefault(x, []).append(i)
    index = {x: np.array(i) for x, i in index.items()}
    sizes, lengths = np.array([len(m[3]) for m in right]), np.array([len(m[4]) for m in right])
    sketches = np.full((len(right), k), NO_VALUE)
    for i, m in enumerate(right):
        sketches[i, : len(m[4])] = m[4]
    number = {r: i for i, r in enumerate(dict.fromkeys(m[2] for m in members))}
    own, its = (np.array([number[m[2]] for m in side], np.int64) for side in (left, right))  # components
    least, shingle_index, out = similar / 100 - MARGIN, {}, []
    for n, (_, node, _, shingle_set, sketch) in enumerate(left):
        met = [index[x] for x in sketch.tolist() if x in index]
        if not met or (its == own[n]).all():
            continue
        alike = 100 * np.minimum(sizes, len(shingle_set)) >= similar * np.maximum(sizes, len(shingle_set))
        overlap = np.bincount(np.concatenate(met), minlength=len(right)) * (alike & (its != own[n]))
        near = np.flatnonzero((overlap > 0) & (overlap >= np.maximum(lengths, len(sketch)) * least))  # no more than that is in the union's sketch
        near = near[shared_of_union(sketch, sketches[near], k) >= least] if len(near) else near
        if not len(near):
            continue
        if not shingle_index:
            for i, m in enumerate(right):
                for x in m[3]:
                    shingle_index.setdefault(x, []).append(i)
            shingle_index = {x: np.array(i) for x, i in shingle_index.items()}
        held = [shingle_index[x] for x in shingle_set if x in shingle_index]
        both = np.bincount(np.concatenate(held), minlength=len(right))[near] if held else np.zeros(len(near), np.int64)
        for i in near[(both > 0) & (100 * both >= similar * (len(shingle_set) + sizes[near] - both))].tolist():
            if its[i] != own[n]:
                gone = its[i]
                own[own == gone], its[its == gone] = own[n], own[n]
                out.append((node, right[i][1]))
    return out


NO_VALUE = np.iinfo(np.int64).max


def shared_of_union(sketch: np.ndarray, others: np.ndarray, k: int) -> np.ndarray:
    """For each of the others (rows, filled up with NO_VALUE) the share of the union's k smallest values that both have."""
    both = np.sort(np.concatenate([np.broadcast_to(sketch, (len(others), len(sketch))), others], axis=1), axis=1)
    again = both[:, 1:] == both[:, :-1]
    value = both != NO_VALUE
    new = value.copy()
    new[:, 1:] &= ~again
    rank = np.cumsum(new, axis=1)
    shared = (again & value[:, 1:] & (rank[:, 1:] <= k)).sum(axis=1)
    return shared / np.minimum(rank[:, -1], k)


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, k: int = SKETCH) -> DataFrame:
    """The pairs (a, b) of nodes that pass the union sketch's estimate and then the exact index; a written table."""
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("size").alias(f"size_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.filter(f"100 * least(size_a, size_b) >= {SIMILAR} * greatest(size_a, size_b)")
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, k)
    shared = F.size(F.array_intersect(union, F.array_intersect("sketch_a", "sketch_b")))
    likely = both.filter(shared >= F.size(union) * (SIMILAR / 100 - MARGIN)).select("a", "b")
    likely = written(likely, "likely")
    out = likely.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    out = out.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").sortWithinPartitions("b")
    out = written(jaccard_links(out), "links")
    forget(likely)
    return out


ORACLE_SQL = """
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as g
      from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
u as (select a, b from l union all select b, a from l),
r as (select doc_id as a, doc_id as b from documents union select r.a, u.b from r join u on r.b = u.a),
k as (select a as doc_id, min(b) as component_id from r group by a)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, component_id, d.doc_id = component_id as kept
from documents d left join n using (doc_id) join k using (doc_id)
"""
