"""Removal of repeated word windows by Rabin-Karp hashes that are counted across the corpus.

Documents are dealt to chunks that are ranges of ids, so that "starts in a document with a
smaller id" is "starts in an earlier chunk, or in this chunk with a smaller id". An id with
more text than a chunk takes is a range of several chunks, none of which is earlier. Every
window of every text is hashed. Spark brings the hashes of a bucket together: a chunk sends
each of its hashes once, however often it holds it, packed by buckets, since a row for each
hash would take twice the disk. A bucket finds the hashes that several chunks hold and
answers all but the first of them; each chunk then marks its repeated windows, and windows
that overlap or touch merge into maximal intervals of words.

A hash of one chunk is one value in one bucket, so a window that a third of all documents
share is as many values of 10 bytes as there are chunks. Windows are told apart by 80 bits: a
Rabin-Karp hash of 64 and an independent one of 16 that every match is checked by. Among 10^13
distinct windows (100 TB) some 40 false matches are to be expected, below 10^12 none.

Defined results: a null text has no words; null ids come last and count as one document, as
do rows of one id; a text shorter than a window keeps all; a very long text is one chunk, which
a task holds; columns besides the id and the text play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import _CHUNK, _ID, _TEXT, LAST, binaries, bucket_slices, by_id_range, check_windows, chunk_tasks, first_of, from_planes, hash_spans, joined, parts, planes, prefix_sums, windows, word_spans

WINDOW = 13
CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 24 << 20  # of text whose hashes one bucket counts
SPANS = "array<struct<start:int,end:int>>"


class Chunk:
    """The words and windows of a chunk's texts, in the order of their ids."""

    def __init__(self, group: pa.Table, window: int):
        ids, texts = group.column(_ID).to_numpy(), binaries(group.column(_TEXT))
        order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
        self.ids = ids[order]
        self.buf, self.bounds = joined([texts[i] for i in order])
        self.start, self.end = word_spans(self.buf)
        self.of = np.searchsorted(self.bounds, self.start, side="right") - 1
        words = hash_spans(prefix_sums(self.buf), self.start, self.end)
        self.hashes, self.at = windows(words, self.of, window)
        self.checks = check_windows(words, self.at, window)
        self.order = in_order(self.hashes, self.checks)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Each hash and its check once, in order."""
        hashes, checks = self.hashes[self.order], self.checks[self.order]
        new = first_pairs(hashes, checks)
        return hashes[new], checks[new]

    def repeated(self, foreign: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Which windows start in a document with a smaller id: in an earlier chunk (foreign, in order) or in this one."""
        hashes, checks = self.hashes[self.order], self.checks[self.order]
        new = first_pairs(hashes, checks)
        ids = self.ids[self.of[self.at[self.order]]]
        first = ids[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))] if len(new) else ids
        out = np.zeros(len(self.order), bool)
        out[self.order] = (ids > first) | among(hashes, checks, *foreign)
        return out


def in_order(hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """The order by hash and check; equal ones stay in their places."""
    order = np.argsort(hashes, kind="stable")
    h, c = hashes[order], checks[order]
    if ((h[1:] == h[:-1]) & (c[1:] < c[:-1])).any():  # two windows of one hash
        order = np.lexsort((checks, hashes))
    return order


def first_pairs(hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Which pairs, in order, differ from the one before."""
    out = first_of(hashes)
    np.logical_or(out[1:], checks[1:] != checks[:-1], out=out[1:])
    return out


def among(hashes: np.ndarray, checks: np.ndarray, own: np.ndarray, own_checks: np.ndarray) -> np.ndarray:
    """Which pairs occur among own, which are in order."""
    out = np.zeros(len(hashes), bool)
    if len(own):
        low, high = np.searchsorted(own, hashes, "left"), np.searchsorted(own, hashes, "right")
        for step in range(int((high - low).max(initial=0))):  # as good as always one
            at = np.minimum(low + step, len(own) - 1)
            out |= (low + step < high) & (own_checks[at] == checks)
    return out


def packed(hashes: np.ndarray, checks: np.ndarray) -> bytes:
    return planes(hashes) + checks.astype("<u2").tobytes()


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 10
    return from_planes(blob[: 8 * n]), np.frombuffer(blob, "<u2", n, 8 * n).astype(np.uint16)


def window_hashes(chunks: DataFrame, window: int, buckets: int) -> DataFrame:
    def collect(group: pa.Table) -> pa.Table:
        chunk = group.column(_CHUNK)[0].as_py()
        hashes, checks = Chunk(group, window).distinct()
        rows = [(b, packed(hashes[i:j], checks[i:j])) for b, i, j in bucket_slices(hashes, buckets)]
        return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int32()), _CHUNK: pa.array([chunk] * len(rows), pa.int32()), "hashes": pa.array([h for _, h in rows], pa.binary())})

    return chunks.groupBy(_CHUNK).applyInArrow(collect, f"bucket int, {_CHUNK} int, hashes binary")


def held_before(hashes: DataFrame, ranges: np.ndarray) -> DataFrame:
    """For each chunk the hashes that a chunk of an earlier range holds; ranges: that of each chunk."""

    def count(group: pa.Table) -> pa.Table:
        chunks, blobs = group.column(_CHUNK).to_numpy(), [unpacked(b) for b in group.column("hashes").to_pylist()]
        order = np.argsort(chunks)
        every, checks = (np.concatenate([blobs[i][k] for i in order]) for k in (0, 1))
        of = np.repeat(chunks[order], [len(blobs[i][0]) for i in order])
        order = in_order(every, checks)  # earlier chunks first
        every, checks, of = every[order], checks[order], of[order]
        new = first_pairs(every, checks)
        holder = of[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        again = ranges[of] > ranges[holder]
        every, checks, of = every[again], checks[again], of[again]
        order = np.argsort(of, kind="stable")
        every, checks, of = every[order], checks[order], of[order]
        cuts = np.flatnonzero(np.diff(of, prepend=-1, append=-2))
        rows = [(int(of[i]), packed(every[i:j], checks[i:j])) for i, j in zip(cuts[:-1], cuts[1:], strict=True)] if len(of) else []
        return pa.table({_CHUNK: pa.array([c for c, _ in rows], pa.int32()), "hashes": pa.array([h for _, h in rows], pa.binary())})

    return hashes.groupBy("bucket").applyInArrow(count, f"{_CHUNK} int, hashes binary")


def drop_repeated_windows(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed, spans (removed words from start up to end) and kept (kept words joined by one space)."""
    if window < 1:
        raise ValueError("window must be 1 or more")
    chunks, ranges, n_bytes = by_id_range(docs, id_col, text_col, CHUNK_BYTES)
    chunks, buckets = chunks.repartition(chunk_tasks(len(ranges)), _CHUNK), parts(n_bytes, BUCKET_BYTES, 48)
    answers = held_before(window_hashes(chunks, window, buckets).repartition(buckets, "bucket"), ranges)

    def cut(own: pa.Table, answered: pa.Table) -> pa.Table:
        if not own.num_rows:
            return _result([], [], [], [], [])
        chunk = Chunk(own, window)
        foreign = [unpacked(b) for b in answered.column("hashes").to_pylist()] or [(np.zeros(0, np.uint64), np.zeros(0, np.uint16))]
        hashes, checks = (np.concatenate(x) for x in zip(*foreign, strict=True))
        order = in_order(hashes, checks)
        marked = chunk.repeated((hashes[order], checks[order]))
        n = len(chunk.start)
        delta = np.zeros(n + 1, np.int64)
        at = chunk.at[marked]
        np.add.at(delta, at, 1)
        np.add.at(delta, at + window, -1)
        removed = np.cumsum(delta[:n]) > 0
        first = np.searchsorted(chunk.of, np.arange(len(chunk.ids) + 1))  # each document's first word
        gone = np.concatenate([[0], np.cumsum(removed)])
        # kept words and one space after each; the byte after a word is white space
        buf = chunk.buf.copy()
        buf[chunk.end] = 0x20
        edge = np.zeros(len(buf) + 1, np.int8)
        edge[chunk.start[~removed]] = 1
        edge[chunk.end[~removed] + 1] -= 1
        keep = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
        places = np.concatenate([[0], np.cumsum(keep)])[chunk.bounds]
        left = buf[keep].tobytes()
        kept = [left[i : j - 1] if j > i else b"" for i, j in zip(places[:-1], places[1:], strict=True)]
        spans: list[list[dict]] = [[] for _ in chunk.ids]
        turns = np.flatnonzero(removed & ~np.concatenate([[False], removed[:-1] & (chunk.of[1:] == chunk.of[:-1])])) if n else []
        for i in turns:
            doc = chunk.of[i]
            stop = np.flatnonzero(~removed[i : first[doc + 1]])[:1]
            spans[doc].append({"start": int(i - first[doc]), "end": int((i + stop[0] if len(stop) else first[doc + 1]) - first[doc])})
        return _result(chunk.ids, np.diff(first), np.diff(gone[first]), spans, kept)

    out = chunks.groupBy(_CHUNK).cogroup(answers.groupBy(_CHUNK)).applyInArrow(cut, f"id bigint, n_words bigint, n_removed bigint, spans {SPANS}, kept string")
    return out.select(F.when(F.col("id") != LAST, F.col("id")).alias(id_col), "n_words", "n_removed", "spans", "kept")


def _result(ids, n_words, n_removed, spans, kept) -> pa.Table:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "spans", "kept"])


def window_digests(docs: DataFrame) -> DataFrame:
    out = drop_repeated_windows(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = """
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
win as (select doc_id, i, sha256(array_to_string(w[i : i + 12], ' ')) as h
        from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d)),
f as (select h, min(doc_id) as first_doc from win group by h),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as j from win join f using (h) where doc_id > first_doc),
g as (select doc_id, list(j) as js from gone group by doc_id),
k as (select doc_id, len(w) as n, coalesce(len(js), 0) as r, list_filter(w, lambda x, j: not coalesce(list_contains(js, j), false)) as kept
      from d left join g using (doc_id))
select doc_id, cast(n as bigint) as n_words, cast(r as bigint) as n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from k
"""
