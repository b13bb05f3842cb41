"""Removal of repeated byte strings by merging Burrows-Wheeler transforms.

Every string of LENGTH bytes that also starts earlier (smaller document id, or same document
and earlier place) goes. The suffixes of a corpus don't fit one machine, so they are dealt by
content first: the anchor of a string is the smallest hash of its ANCHOR-byte substrings, and
runs of neighbouring strings with one anchor are kept together as one piece of text. Equal
strings have equal anchors, so each bucket of anchors can be settled for itself. Pieces whose
anchor occurs once in the corpus hold no repeated string and stay at home; a piece that occurs
often travels once from each chunk of documents. An anchor that more than HOT_CHUNKS chunks
hold is dealt again by a second, longer anchor: what stands about a common passage spreads over
buckets; the passage itself is still a piece from each chunk, in one bucket.

In a bucket, pieces with a common anchor are cut into shards. Each shard gets the Burrows-
Wheeler transform of its pieces. The transforms are merged by iterative interleave refinement
(Holt and McMillan): from an interleave that is right for the first h symbols of every suffix,
one stable pass over the transforms gives the one for h + 1 (each row moves to the one before it,
in the order of the symbols passed); no suffix is compared or sorted again. The refinement also carries the blocks of suffixes that share h symbols, that is, the
common prefixes. After LENGTH passes the blocks are the repeated intervals; in each, all
strings but the earliest are marked. Marked strings go back to their chunk, which merges
them into maximal spans.

Defined results: a null text is empty; matches never cross documents; null ids come last,
rows of one id follow each other in the order of their texts; texts under LENGTH bytes keep
all; a very long text is one chunk, which a task holds; columns besides the id and the text play
no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import _CHUNK, _ID, _TEXT, LAST, BASE_INV, binaries, bucket_slices, by_id_range, chunk_tasks, distinct, first_of, from_planes, is_in, joined, mix, parts, planes, powers, prefix_sums

LENGTH = 100
ANCHOR = 64
SECOND_ANCHOR = 88
HOT_CHUNKS = 256
LONGEST_PIECE = 2048  # strings in one piece
CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 2 << 20  # of text whose anchors one bucket settles
SHARD_BYTES = 64 << 10
SPANS = "array<struct<start:bigint,end:bigint>>"
FIELDS = f"bucket int, {_CHUNK} int, keys binary, at binary, count binary, looped binary, text binary"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of so many neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


class Chunk:
    """The texts of a chunk in the order of their ids, and the pieces that their strings form."""

    def __init__(self, group: pa.Table, length: int):
        ids, texts = group.column(_ID).to_numpy(), binaries(group.column(_TEXT))
        order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
        self.ids, self.length = ids[order], length
        self.buf, self.bounds = joined([texts[i] for i in order])
        self.anchor = min(ANCHOR, length)

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First string, number of strings and anchor of each piece. Anchors are small hashes: mixed again before they are dealt."""
        self.sums = prefix_sums(self.buf)
        self.hashes = self._hashes(self.anchor)
        enough = len(self.hashes) > self.length - self.anchor
        self.least = least = sliding_min(self.hashes, self.length - self.anchor + 1) if enough else np.zeros(0, np.uint64)
        valid = np.ones(len(least), bool)
        for begin, end in zip(self.bounds[:-1], self.bounds[1:], strict=True):  # a text ends one byte before the next begins
            valid[max(begin, end - self.length) : end] = False
        return self._runs(least, valid)

    def _hashes(self, k: int) -> np.ndarray:
        n = max(0, len(self.buf) - k + 1)
        return mix((self.sums[k : k + n] - self.sums[:n]) * powers(BASE_INV, n)[:n])

    def _runs(self, least: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        new = valid.copy()
        new[1:] &= ~(valid[:-1] & (least[1:] == least[:-1]))
        start = np.flatnonzero(new)
        stop = np.flatnonzero(valid & ~np.append(valid[1:] & ~new[1:], False)) + 1 if len(valid) else start
        count = stop - start
        cut = -(-count // LONGEST_PIECE)
        part = np.arange(cut.sum()) - np.repeat(np.cumsum(cut) - cut, cut)
        start, count = np.repeat(start, cut) + part * LONGEST_PIECE, np.minimum(np.repeat(count, cut) - part * LONGEST_PIECE, LONGEST_PIECE)
        return start, count, least[start]

    def looped(self, start: np.ndarray, count: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Pieces that hold their anchor more than once, so that a string may repeat within the piece."""
        if not len(start):
            return np.zeros(0, bool)
        width = self.length - self.anchor
        # a substring is an anchor if some string around it has no smaller hash
        padded = np.concatenate([np.zeros(width, np.uint64), self.least, np.zeros(width, np.uint64)])
        at = np.flatnonzero(~sliding_min(~padded, width + 1) == self.hashes)
        met = self.hashes[at]
        near = (met[1:] == met[:-1]) & (at[1:] - at[:-1] < LONGEST_PIECE + self.length)
        out = is_in(keys, distinct(met[1:][near]))
        for i in np.flatnonzero(out):
            out[i] = np.count_nonzero(self.hashes[start[i] : start[i] + count[i] + width] == keys[i]) > 1
        return out

    def again(self, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of common anchors, dealt anew by the second anchor."""
        k = min(SECOND_ANCHOR, self.length)
        least = sliding_min(self._hashes(k), self.length - k + 1)
        valid = np.zeros(len(least), bool)
        for s, c in zip(start, count, strict=True):
            valid[s : s + c] = True
        s, c, second = self._runs(least, valid)
        return s, c, mix(second ^ np.uint64(0x9E3779B97F4A7C15))


def anchors(chunks: DataFrame, length: int, buckets: int) -> DataFrame:
    def collect(group: pa.Table) -> pa.Table:
        chunk = group.column(_CHUNK)[0].as_py()
        found = distinct(mix(Chunk(group, length).pieces()[2]))
        rows = [(b, planes(found[i:j])) for b, i, j in bucket_slices(found, buckets)]
        return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int32()), _CHUNK: pa.array([chunk] * len(rows), pa.int32()), "keys": pa.array([h for _, h in rows], pa.binary())})

    return chunks.groupBy(_CHUNK).applyInArrow(collect, f"bucket int, {_CHUNK} int, keys binary")


def shared_anchors(found: DataFrame, hot_chunks: int) -> DataFrame:
    """For each chunk its anchors that other chunks hold too, and of those the common ones."""

    def count(group: pa.Table) -> pa.Table:
        chunks, blobs = group.column(_CHUNK).to_numpy(), [from_planes(b) for b in group.column("keys").to_pylist()]
        every = np.sort(np.concatenate(blobs))
        new = np.flatnonzero(first_of(every))
        held = np.diff(np.append(new, len(every)))
        shared, hot = every[new[held > 1]], every[new[held > hot_chunks]]
        rows = []
        for c, own in zip(chunks, blobs, strict=True):
            own = own[is_in(own, shared)]
            if len(own):
                rows.append((int(c), planes(own), planes(own[is_in(own, hot)])))
        return pa.table({_CHUNK: pa.array([r[0] for r in rows], pa.int32()), "shared": pa.array([r[1] for r in rows], pa.binary()), "hot": pa.array([r[2] for r in rows], pa.binary())})

    return found.groupBy("bucket").applyInArrow(count, f"{_CHUNK} int, shared binary, hot binary")


def travelling(chunks: DataFrame, shared: DataFrame, length: int, buckets: int) -> DataFrame:
    """The pieces whose anchor occurs again, each distinct one once from each chunk; bucket -1 - b: strings marked at home, on their way through bucket b."""

    def send(own: pa.Table, answered: pa.Table) -> pa.Table:
        if not own.num_rows:
            return _piece_rows([])
        number = own.column(_CHUNK)[0].as_py()
        chunk = Chunk(own, length)
        start, count, least = chunk.pieces()
        keys = mix(least.copy())
        known = [np.sort(np.concatenate([from_planes(b) for b in answered.column(c).to_pylist()] or [np.zeros(0, np.uint64)])) for c in ("shared", "hot")]
        order = np.sort(keys)
        twice = distinct(order[1:][order[1:] == order[:-1]])
        looped = chunk.looped(start, count, least)
        chosen = is_in(keys, known[0]) | is_in(keys, twice) | looped
        hot = chosen & is_in(keys, known[1])
        plain = chosen & ~hot
        sets = [(start[plain], count[plain], keys[plain], looped[plain])]
        if hot.any():
            s, c, k = chunk.again(start[hot], count[hot])
            sets.append((s, c, k, np.ones(len(s), bool)))
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        data, first, at_home = chunk.buf.tobytes(), {}, []
        for s, c, k, loop in zip(*(np.concatenate(x).tolist() for x in zip(*sets, strict=True)), strict=True):
            piece = (k, data[s : s + c + length - 1])
            if piece in first:
                at_home.append((s, c))  # pieces come in the order of their places
            else:
                first[piece] = (s, c, loop)
        rows = []
        sent = sorted((k, *place, text) for (k, text), place in first.items())
        keys = np.array([x[0] for x in sent], np.uint64)
        for b, i, j in bucket_slices(keys, buckets):
            rows.append((b, number, keys[i:j], [x[1] for x in sent[i:j]], [x[2] for x in sent[i:j]], [x[3] for x in sent[i:j]], pack(b"".join(x[4] for x in sent[i:j]))))
        if at_home:
            rows.append((-1 - number % buckets, number, np.zeros(0, np.uint64), [s for s, _ in at_home], [c for _, c in at_home], [], b""))
        return _piece_rows(rows)

    return chunks.groupBy(_CHUNK).cogroup(shared.groupBy(_CHUNK)).applyInArrow(send, FIELDS)


def _piece_rows(rows: list[tuple]) -> pa.Table:
    blob = lambda i, kind: pa.array([np.asarray(r[i], kind).tobytes() for r in rows], pa.binary())
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), _CHUNK: pa.array([r[1] for r in rows], pa.int32()), "keys": blob(2, np.uint64), "at": blob(3, np.int64), "count": blob(4, np.int32), "looped": blob(5, np.bool_), "text": pa.array([r[6] for r in rows], pa.binary())})


# --- Burrows-Wheeler transforms ---------------------------------------------------------------


def transform(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The transform of a collection, the text place of each row, the row of each place, and the first place of each string.

    strings: distinct, in lexicographic order. The text is the strings, each ended by a
    terminator; terminators are smaller than all bytes and ordered as their strings, so that
    the n-th row that begins with a symbol is the one before the n-th row with that symbol in
    the transform, terminators included. Symbols: 0 is the terminator, b + 1 the byte b.
    """
    sizes = np.array([len(s) + 1 for s in strings])
    begin = np.cumsum(sizes) - sizes
    symbols = np.zeros(int(sizes.sum()), np.uint16)
    ends = begin + sizes - 1
    inner = np.ones(len(symbols), bool)
    inner[ends] = False
    symbols[inner] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + 1
    n = len(symbols)
    rank = symbols.astype(np.int64) + len(strings)
    rank[ends] = np.arange(len(strings))
    bits = max(len(strings) + 257, n).bit_length()
    low = (1 << bits) - 1
    if 3 * bits > 63:
        raise ValueError("a shard of more than a million bytes")
    step, place = 1, np.arange(n)
    while True:  # prefix doubling; unique terminators keep comparisons within a string
        key = rank << bits
        if step < n:
            key[: n - step] |= rank[step:]
        key = np.sort(key << bits | place)
        order = key & low
        new = first_of(key >> bits)
        rank[order] = np.cumsum(new) - 1
        if new.all():
            break
        step *= 2
    before = symbols[order - 1]
    before[rank[begin]] = 0
    return before, order, rank, begin


def merge(shards: list[np.ndarray], rows: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleaves transforms up to the first `depth` symbols of their suffixes.

    rows: of each shard, in order, those that lie `depth` symbols after the suffixes asked for.
    A pass takes each row to the one before it (its LF mapping), in the order of the symbols
    passed: stable, so what was in order by h symbols is in order by h + 1. Rows that no suffix
    asked for can reach take no part. Returns the rows (counted over all shards) of the suffixes
    asked for in their merged order, and the block of those that share `depth` symbols.
    """
    sizes = np.array([len(s) for s in shards])
    first = np.cumsum(sizes) - sizes
    every = np.concatenate(shards)
    if every.max(initial=0) < 256:
        every = every.astype(np.uint8)
    lf = np.empty(len(every), np.int32)
    for f, bwt in zip(first, shards, strict=True):
        lf[f + np.argsort(bwt if bwt.max(initial=0) > 255 else bwt.astype(np.uint8), kind="stable")] = np.arange(f, f + len(bwt), dtype=np.int32)
    row = np.concatenate([f + r for f, r in zip(first, rows, strict=True)]).astype(np.int32)
    block = np.zeros(len(row), np.int32)
    new = np.ones(len(row), bool)
    for _ in range(depth):
        symbol = every[row]
        order = np.argsort(symbol, kind="stable")
        row, symbol, block = lf[row[order]], symbol[order], block[order]
        np.not_equal(symbol[1:], symbol[:-1], out=new[1:])
        new[1:] |= block[1:] != block[:-1]
        block = np.cumsum(new, dtype=np.int32)
    return row, block


def repeated_strings(strings: list[bytes], place: np.ndarray, count: np.ndarray, length: int, shard_bytes: int) -> list[np.ndarray]:
    """For each distinct string, which of its first `count` substrings of `length` also start earlier.

    place: a number for each string's first occurrence; substring i starts at place + i.
    """
    order = sorted(range(len(strings)), key=strings.__getitem__)
    shards = min(len(strings), max(2, -(-sum(map(len, strings)) // shard_bytes)))
    made, rows, of, at = [], [], [], []
    for own in (order[x::shards] for x in range(shards)):
        bwt, text_place, row_of, begin = transform([strings[i] for i in own])
        own = np.array(own, np.int32)
        made.append(bwt)
        string = np.searchsorted(begin, text_place, side="right") - 1
        of.append(own[string])
        at.append((text_place - begin[string]).astype(np.int32))
        asked = count[own]
        places = np.repeat(begin + length - (np.cumsum(asked) - asked), asked) + np.arange(asked.sum())
        rows.append(np.sort(row_of[places]))
    row, block = merge(made, rows, length)
    of, at = np.concatenate(of)[row], np.concatenate(at)[row]
    where = place[of] + at
    new = np.flatnonzero(first_of(block))
    first = np.repeat(np.minimum.reduceat(where, new), np.diff(np.append(new, len(where)))) if len(where) else where
    ends = np.cumsum(count)
    marks = np.zeros(int(ends[-1]), bool)
    marks[(ends - count)[of] + at] = where > first
    return np.split(marks, ends[:-1])


def settled(pieces: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """Marked strings of each chunk, as first string and number of strings."""

    def settle(group: pa.Table) -> pa.Table:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        bucket = group.column("bucket")[0].as_py()
        columns = [group.column(c).to_pylist() for c in (_CHUNK, "at", "count")]
        if bucket < 0:
            return _marks([(c, np.frombuffer(a, np.int64), np.frombuffer(n, np.int32)) for c, a, n in zip(*columns, strict=True)])
        entries: dict[tuple[int, bytes], list] = {}
        by_key: dict[int, int] = {}
        rows = sorted(zip(*columns, group.column("keys").to_pylist(), group.column("looped").to_pylist(), group.column("text").to_pylist(), strict=True), key=lambda r: r[0])
        out: dict[int, list] = {}
        for chunk, at, count, keys, looped, text in rows:
            begin, text = 0, unpack(text)
            for k, a, c, loop in zip(np.frombuffer(keys, np.uint64).tolist(), np.frombuffer(at, np.int64).tolist(), np.frombuffer(count, np.int32).tolist(), np.frombuffer(looped, np.bool_).tolist(), strict=True):
                piece = (k, text[begin : begin + c + length - 1])
                begin += c + length - 1
                if piece in entries:  # an earlier chunk holds the whole piece
                    out.setdefault(chunk, []).append((a, c))
                    entries[piece][3] |= loop
                else:
                    entries[piece] = [chunk, a, c, loop]
                    by_key[k] = by_key.get(k, 0) + 1
        merged = [(piece[1], *e[:3]) for piece, e in entries.items() if by_key[piece[0]] > 1 or e[3]]
        texts = {text: (chunk, a, c) for text, chunk, a, c in merged}
        if texts:
            places = list(texts.values())
            chunk_of, at_of, count_of = np.array(places, np.int64).T
            stride = int((at_of + count_of).max()) + 1  # chunks by their rank here, so that numbers of any corpus fit
            place = np.unique(chunk_of, return_inverse=True)[1] * stride + at_of
            marks = repeated_strings(list(texts), place, count_of, length, shard_bytes)
            for (chunk, a, _), marked in zip(places, marks, strict=True):
                if marked.any():
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], marked, [False]]).view(np.int8)))
                    out.setdefault(chunk, []).extend(zip((a + edges[::2]).tolist(), (edges[1::2] - edges[::2]).tolist(), strict=True))
        return _marks([(chunk, *zip(*spans, strict=True)) for chunk, spans in out.items()])

    return pieces.groupBy("bucket").applyInArrow(settle, f"{_CHUNK} int, at binary, count binary")


def _marks(rows: list[tuple]) -> pa.Table:
    return pa.table({_CHUNK: pa.array([r[0] for r in rows], pa.int32()), "at": pa.array([np.asarray(r[1], np.int64).tobytes() for r in rows], pa.binary()), "count": pa.array([np.asarray(r[2], np.int32).tobytes() for r in rows], pa.binary())})


def drop_repeated_bytes(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", hot_chunks: int = HOT_CHUNKS, shard_bytes: int = SHARD_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, spans (removed bytes from start up to end) and kept (the remaining bytes)."""
    if length < 2:
        raise ValueError("length must be 2 or more")
    chunks, ranges, n_bytes = by_id_range(docs, id_col, text_col, chunk_bytes)
    chunks, buckets = chunks.repartition(chunk_tasks(len(ranges)), _CHUNK), parts(n_bytes, BUCKET_BYTES, 48)
    tasks = chunk_tasks(buckets)
    shared = shared_anchors(anchors(chunks, length, buckets).repartition(tasks, "bucket"), hot_chunks)
    marks = settled(travelling(chunks, shared, length, buckets).repartition(tasks, "bucket"), length, shard_bytes)

    def cut(own: pa.Table, marked: pa.Table) -> pa.Table:
        if not own.num_rows:
            return _result([], [], [], [])
        chunk = Chunk(own, length)
        delta = np.zeros(len(chunk.buf) + 1, np.int32)
        for a, c in zip(marked.column("at").to_pylist(), marked.column("count").to_pylist(), strict=True):
            a, c = np.frombuffer(a, np.int64), np.frombuffer(c, np.int32)
            np.add.at(delta, a, 1)
            np.add.at(delta, a + c + length - 1, -1)
        removed = np.cumsum(delta[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], removed, [False]]).view(np.int8)))
        of = np.searchsorted(chunk.bounds, edges[::2], side="right") - 1
        spans: list[list[dict]] = [[] for _ in chunk.ids]
        for d, a, z in zip(of.tolist(), edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            begin = int(chunk.bounds[d])
            spans[d].append({"start": a - begin, "end": z - begin})
        data = chunk.buf.tobytes()
        kept = []
        for i, gone in enumerate(spans):
            begin, end = int(chunk.bounds[i]), int(chunk.bounds[i + 1]) - 1
            left, at = [], begin
            for s in gone:
                left.append(data[at : begin + s["start"]])
                at = begin + s["end"]
            kept.append(b"".join([*left, data[at:end]]))
        return _result(chunk.ids, np.diff(chunk.bounds) - 1, spans, kept)

    out = chunks.groupBy(_CHUNK).cogroup(marks.groupBy(_CHUNK)).applyInArrow(cut, f"id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans {SPANS}, kept binary")
    return out.select(F.when(F.col("id") != LAST, F.col("id")).alias(id_col), "n_bytes", "n_removed", "n_spans", "spans", "kept")


def _result(ids, n_bytes, spans, kept) -> pa.Table:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array([n - len(k) for n, k in zip(n_bytes, kept, strict=True)], pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])


def byte_digests(docs: DataFrame) -> DataFrame:
    out = drop_repeated_bytes(docs)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
b as (select doc_id, o, least(1000, n - 99 - o) as m, substr(h, 2 * o + 1, 2198) as s from (select *, unnest(range(0, n - 99, 1000)) as o from d)),
w as (select doc_id, o + i as i, md5(substr(s, 2 * i - 1, 200)) as k from (select *, unnest(range(1, m + 1)) as i from b)),
f as (select k, min(doc_id * 4294967296 + i) as place from w group by k having count(*) > 1),
m as (select doc_id, i from w join f using (k) where doc_id * 4294967296 + i > place),
s as (select doc_id, i, coalesce(i > lag(i) over (partition by doc_id order by i) + 100, true) as new from m),
g as (select doc_id, i, sum(new::int) over (partition by doc_id order by i) as g from s),
spans as (select doc_id, min(i) as a, max(i) + 99 as b from g group by doc_id, g),
p as (select doc_id, a, b, substr(h, 2 * coalesce(lag(b) over o, 0) + 1, 2 * (a - coalesce(lag(b) over o, 0) - 1)) as piece from spans join d using (doc_id) window o as (partition by doc_id order by a)),
r as (select doc_id, count(*) as n_spans, sum(b - a + 1) as n_removed, string_agg(piece, '' order by a) as pieces, max(b) as last from p group by doc_id)
select doc_id, cast(n as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
       sha256(unhex(coalesce(pieces, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from d left join r using (doc_id)
"""
