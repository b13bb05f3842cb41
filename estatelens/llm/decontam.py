"""Benchmark passages in documents, by the CGK embedding and bit-sampling LSH.

Words (runs of Unicode letters, marks and digits, lower-cased, composed) are the symbols. A
passage is a leak of an item of m words if some m consecutive words of the document lie within
EDITS * m word edits of it.

A CGK random walk maps a window and an item to strings in which few edits give few differing
places: step t writes the word in turn and moves on by a bit drawn from the walk, t and the
word. A walk begins at a window's first word, or runs backwards from its last, so all sizes of
windows that begin (or end) at a word share its first STEPS steps: every word of every text is
embedded once for each of WALKS walks in each direction, and that covers the windows of all
items' sizes. REPEATS samples of BITS places of each walk are hashed. An item is indexed under
each of its sample keys whose places are distinct words of it; a window becomes a candidate of
an item only by a key that both have. Candidates are verified by the number of common words and
then by their exact edit distance. Nothing else finds candidates. Items of so few words that the
bound allows no edit have the hash of the whole window as their key.

TARGET_RECALL is what the samples are dimensioned for: of texts that hold an item with as many
edits as the bound allows they find 0.98 and more, from 5 to 60 words; tests/llm measures it
against brute force over all windows.

The items are a stated set; their index is broadcast in blocks of BLOCK_BYTES of item texts,
each a pass over the documents' rows without shuffle, so any number of items is served.

Defined results: null and wordless texts and items leak nothing; null item ids are ids like
others and come last; at a text's end a window may be shorter than the item; equal items are
found each by its own id; of several windows that leak an item the nearest counts, of equals the
first; repeated documents are treated alike; a very long text is searched whole, the task holds
it; a column named `leaks` is replaced, other columns are kept.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BASE, hash_spans, is_in, joined, kept, mix, prefix_sums, windows, word_spans

EDITS = 0.2
TARGET_RECALL = 0.95
WALKS = 3  # in each direction
BITS = 3
REPEATS = 5
SHORT = 8  # words; a sample of a shorter item may see one word twice
STRIDE = 4  # steps between the samples' first places
STEPS = STRIDE * (REPEATS - 1) + 4 * (BITS - 1) + 1
BLOCK_BYTES = 16 << 20
BATCH_BYTES = 1 << 20
PAIRS = 1 << 18  # candidates that are verified together
LEAK = "array<struct<item_id:bigint,start:int,words:int,distance:int>>"
PAD = np.uint64(0)

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True  # of texts in which the characters beyond ASCII are letters, marks and digits


_OTHERS = re.compile(r"[^\w\x00-\x7f]+")  # no letters or digits, but perhaps marks of letters


def prepared(text: bytes | None) -> bytes:
    """Lower case; the characters beyond ASCII that are left belong to words."""
    if not text or text.isascii():
        return (text or b"").lower()
    composed = unicodedata.normalize("NFC", text.decode("utf-8", "replace").lower())
    marks = lambda run: "".join(c if unicodedata.category(c)[0] == "M" else " " for c in run[0])
    return _OTHERS.sub(marks, composed).encode("utf-8", "surrogatepass")


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the text of each."""
    buf, bounds = joined([prepared(t) for t in texts])
    start, end = word_spans(buf, _WORD[buf])
    hashes = hash_spans(prefix_sums(buf), start, end)
    return np.where(hashes == PAD, np.uint64(1), hashes), np.searchsorted(bounds, start, side="right") - 1


def allowed(m: int) -> int:
    return int(m * EDITS)


# --- the embedding and its samples -----------------------------------------------------------------


def sample_places(walk: int) -> list[list[int]]:
    """The steps that each sample of a walk looks at, the same wherever they are drawn."""
    gaps = np.random.default_rng([7, walk]).integers(2, 5, (REPEATS, BITS - 1))
    return [[r * STRIDE, *(r * STRIDE + np.cumsum(g)).tolist()] for r, g in enumerate(gaps)]


PLACES = [sample_places(w) for w in range(2 * WALKS)]


def step_bits(words: np.ndarray, walk: int) -> np.ndarray:
    """For each word the bits by which the walk moves on, one for each step."""
    return mix(words ^ np.uint64((walk + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))


def embed(words: np.ndarray, start: np.ndarray, walk: int) -> np.ndarray:
    """The places that the walk visits from each start: starts by STEPS. words must go on for STEPS more after any start."""
    bits, at = step_bits(words, walk), start.astype(np.int64)
    out = np.empty((len(start), STEPS), np.int64)
    for t in range(STEPS):
        out[:, t] = at
        at = at + (bits[at] >> np.uint64(t) & np.uint64(1)).astype(np.int64)
    return out


def window_keys(words: np.ndarray, walk: int):
    """The keys of each sample of the windows at every word but the last STEPS: the sampled places of embed, step by step."""
    bits = step_bits(words, walk).astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    at, keys = np.arange(len(words) - STEPS), {}
    for t in range(STEPS):
        due = [r for r, places in enumerate(PLACES[walk]) if t in places]
        if due:
            symbol = words.take(at, mode="clip")
            for r in due:
                keys[r] = keys[r] * BASE + symbol if r in keys else symbol
                if t == PLACES[walk][r][-1]:
                    yield tagged(keys.pop(r), walk, r)
        if t % 8 == 0:
            plane = bits[:, t // 8].copy()
        at += plane.take(at, mode="clip") >> np.uint8(t % 8) & np.uint8(1)


def tagged(keys: np.ndarray, walk: int, sample: int) -> np.ndarray:
    return mix(keys ^ np.uint64((walk * REPEATS + sample + 1) * 0xD1B54A32D192ED03 & (2**64 - 1)))


def edit_distances(a: np.ndarray, sizes: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distances of the first `sizes` symbols of each row of a and the whole row of b."""
    n, m = b.shape
    j = np.arange(m + 1, dtype=np.int32)
    row = np.broadcast_to(j, (n, m + 1)).copy()
    out = np.where(sizes == 0, m, 0).astype(np.int32)
    for i in range(1, int(sizes.max(initial=0)) + 1):
        new = row + np.int32(1)
        new[:, 1:] = np.minimum(new[:, 1:], row[:, :-1] + (a[:, i - 1, None] != b))
        row = np.minimum.accumulate(new - j, axis=1) + j  # insertions, all at once
        out = np.where(sizes == i, row[:, m], out)
    return out


class Items:
    """Benchmark items under the keys of their samples."""

    def __init__(self, ids: list[int | None], texts: list[bytes | None]):
        hashes, of = word_hashes(texts)
        cuts = np.searchsorted(of, np.arange(len(texts) + 1))
        self.ids, self.sizes = ids, np.diff(cuts)
        self.words = [hashes[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        self.of_size = {int(m): np.flatnonzero(self.sizes == m) for m in np.unique(self.sizes) if m}
        self.row = np.zeros(len(texts), np.int64)
        for which in self.of_size.values():
            self.row[which] = np.arange(len(which))
        self.rows = {m: np.stack([self.words[k] for k in which]) for m, which in self.of_size.items()}
        every = np.repeat(np.arange(len(texts)), self.sizes)
        self.bag = np.sort(self._in_item(hashes, every))
        self.exact = {m: self._table(*self._whole(m)) for m in self.of_size if not allowed(m)}
        self.table = self._table(*self._sampled())

    @staticmethod
    def _in_item(words: np.ndarray, item: np.ndarray) -> np.ndarray:
        return mix(words ^ mix(item.astype(np.uint64) + np.uint64(1)))

    @staticmethod
    def _table(keys: np.ndarray, items: np.ndarray):
        order = np.argsort(keys, kind="stable")
        shift = np.uint64(64 - min(24, max(12, (16 * len(keys)).bit_length())))
        seen = np.zeros(1 << (64 - int(shift)), bool)
        seen[keys >> shift] = True
        return keys[order], items[order], seen, shift

    def _whole(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        rows = self.rows[m]
        return windows(rows.ravel(), np.repeat(np.arange(len(rows)), m), m)[0], self.of_size[m]

    def _sampled(self) -> tuple[np.ndarray, np.ndarray]:
        keys, items = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for m, rows in self.rows.items():
            if not allowed(m):
                continue
            for walk in range(2 * WALKS):
                wide = np.zeros((len(rows), m + STEPS + 1), np.uint64)
                wide[:, :m] = rows if walk < WALKS else rows[:, ::-1]
                begin = np.arange(len(rows)) * wide.shape[1]
                visited = embed(wide.ravel(), begin, walk)
                for r, places in enumerate(PLACES[walk]):
                    at = visited[:, places]
                    fits = ((np.diff(at, axis=1) > 0).sum(axis=1) >= BITS - 1 - (m < SHORT)) & (at[:, -1] - begin < m)
                    key = np.zeros(int(fits.sum()), np.uint64)
                    for symbol in wide.ravel()[at[fits]].T:
                        key = key * BASE + symbol
                    keys.append(tagged(key, walk, r))
                    items.append(self.of_size[m][fits])
        return np.concatenate(keys), np.concatenate(items)

    def candidates(self, hashes: np.ndarray, of: np.ndarray, first: np.ndarray):
        """(item, first word, text) of windows that share a key with an item, about PAIRS of them at a time."""
        for m, table in self.exact.items():
            found, at = windows(hashes, of, m)
            for item, where in self._met(table, found, at):
                yield item, where, of[where]
        if not len(self.table[0]):
            return
        # texts apart, so that a walk doesn't read on into the next one
        place = np.arange(len(hashes)) + of
        back = len(hashes) + len(first) - 1 - place
        for walk in range(2 * WALKS):
            own = place if walk < WALKS else back
            words = np.zeros(len(hashes) + len(first) + STEPS, np.uint64)
            words[own] = hashes
            for keys in window_keys(words, walk):
                for item, where in self._met(self.table, keys[own], np.arange(len(hashes))):
                    doc = of[where]
                    yield item, where if walk < WALKS else np.maximum(where - self.sizes[item] + 1, first[doc]), doc

    @staticmethod
    def _met(table, found: np.ndarray, at: np.ndarray):
        """(item, place) of the keys that the table holds."""
        keys, items, seen, shift = table
        some = np.flatnonzero(seen.take(found >> shift, mode="clip"))
        low, high = np.searchsorted(keys, found[some], "left"), np.searchsorted(keys, found[some], "right")
        met = high > low
        some, low, count = some[met], low[met], (high - low)[met]
        part = np.cumsum(count) // PAIRS
        for p in np.unique(part):
            own = part == p
            n, ends = count[own], np.cumsum(count[own])
            yield items[np.arange(ends[-1]) + np.repeat(low[own] - (ends - n), n)], np.repeat(at[some[own]], n)

    def leaks(self, texts: list[bytes | None]) -> list[list[dict]]:
        """For each text the items that it leaks, each with the nearest window found."""
        hashes, of = word_hashes(texts)
        first = np.searchsorted(of, np.arange(len(texts) + 1))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        held, size = [], 0
        for found in self.candidates(hashes, of, first):
            held.append(found)
            size += len(found[0])
            if size > PAIRS:
                self._verify(hashes, first, held, best)
                held, size = [], 0
        self._verify(hashes, first, held, best)
        out: list[list[dict]] = [[] for _ in texts]
        for (doc, item), (distance, start, n) in best.items():
            out[doc].append({"item_id": self.ids[item], "start": int(start - first[doc]), "words": n, "distance": distance})
        return [sorted(x, key=lambda leak: (leak["item_id"] is None, leak["item_id"] or 0)) for x in out]

    def _verify(self, hashes, first, held, best) -> None:
        """Adds to best, by text and item, the nearest window among the candidates held that lies within the bound."""
        if not held:
            return
        pairs = np.stack([np.concatenate(x) for x in zip(*held, strict=True)])
        pairs = pairs[:, np.lexsort(pairs)]
        pairs = pairs[:, np.append(True, (np.diff(pairs, axis=1) != 0).any(axis=0))]
        for m in np.unique(self.sizes[pairs[0]]):
            of_size, some = pairs[:, self.sizes[pairs[0]] == m], max(1, (4 << 20) // int(m))
            for part in range(0, of_size.shape[1], some):
                item, start, doc = of_size[:, part : part + some]
                places = start[:, None] + np.arange(m)
                within = places < first[doc + 1][:, None]
                rows = np.where(within, hashes[np.minimum(places, len(hashes) - 1)], PAD)
                common = (is_in(self._in_item(rows, item[:, None]), self.bag) & within).sum(axis=1)
                near = np.flatnonzero(common >= within.sum(axis=1) - allowed(m))
                near = near[within[near].sum(axis=1) >= m - allowed(m)]
                sizes = within[near].sum(axis=1)
                distance = edit_distances(rows[near], sizes, self.rows[int(m)][self.row[item[near]]])
                for x, d, n in zip(near.tolist(), distance.tolist(), sizes.tolist(), strict=True):
                    if d <= allowed(m):
                        key, found = (int(doc[x]), int(item[x])), (d, int(start[x]), n)
                        best[key] = min(best.get(key, found), found)


def _blocks(items: DataFrame) -> list[tuple[list[int | None], list[bytes]]]:
    """The stated set of items in blocks of bounded size."""
    blocks, ids, texts, size = [], [], [], 0
    for row in items.toLocalIterator():
        text = (row[1] or "").encode()
        if ids and size + len(text) > BLOCK_BYTES:
            blocks.append((ids, texts))
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(text)
        size += len(text)
    return [*blocks, (ids, texts)] if ids else blocks


def find_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `leaks`: item_id, first word, words and edit distance of each leaked item."""
    docs = docs.drop("leaks").withColumn("leaks", F.expr(f"cast(array() as {LEAK})"))
    for ids, texts in _blocks(items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))):
        docs = docs.mapInArrow(_search(ids, texts, text_col), docs.schema)
    return docs


def _search(ids: list[int | None], item_texts: list[bytes], text_col: str):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("words", pa.int32()), ("distance", pa.int32())]))

    digest = hashlib.sha256(repr((ids, item_texts)).encode()).hexdigest()

    def run(batches):
        items = kept("items", digest, lambda: Items(ids, item_texts))
        for batch in batches:
            texts = batch.column(text_col).cast(pa.binary()).to_pylist()
            found, held, size = [], [], 0
            for text in texts:
                held.append(text)
                size += len(text or b"")
                if size > BATCH_BYTES:
                    found += items.leaks(held)
                    held, size = [], 0
            found += items.leaks(held)
            at = batch.schema.get_field_index("leaks")
            before = batch.column(at).to_pylist()
            leaks = pa.array([(x or []) + y for x, y in zip(before, found, strict=True)], kind)
            yield pa.RecordBatch.from_arrays([leaks if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return run


def leak_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items and item_ids of every document."""
    out = find_leaks(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), items)
    ids = F.array_sort(F.transform("leaks", lambda x: x["item_id"]))
    return out.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").cast("long").alias("n_items"), ids.alias("item_ids"))
