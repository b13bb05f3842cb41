"""Byte pair encoding and decoding with a contiguous rank array.

A short word is held as two flat lists: its parts, and the rank of the merge of each
part with the next. The smallest rank is searched again and again, its boundary deleted
and the two neighbouring ranks looked up anew; for words of a few dozen bytes the scan
beats any heap. Words of more than LONG parts take a heap over a linked list, whose work
doesn't grow with the square of the length. Results are those of the tokenizers library
(no special tokens added, no truncation, no padding).

The merges, the ranks and the decoding are ours throughout. Texts whose characters all lie below
SAFE_END are normalised and split here, by Python's tables, which agree with the library's there;
tables of case, classes and normal forms differ between Unicode versions, so texts with any
other character take the library's own normaliser and splitter, which the results must equal.

Defined results: a null text is the empty text; the strings of special tokens in a text
are those tokens, as in the library; null ids and repeated rows are rows like others; a very
long text, or word, is encoded whole by one task; an empty table gives an empty result; columns
named like an output are replaced, others are kept.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import kept

LONG = 200
NONE = 1 << 60
CACHED_WORDS = 300_000
SAFE_END = 0x180  # Latin letters: below, lower case and classes are those of str and unicodedata


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte: its own if visible, else the next from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in visible:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class Bpe:
    """A BPE vocabulary of the tokenizers library whose words end in a suffix and whose pieces are lower-cased words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path, self.vocab, self.suffix = path, model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in model["merges"]]
        self.rank = {a << 32 | b: rank for rank, (a, b, _) in reversed(list(enumerate(pairs)))}
        self.made = [c for _, _, c in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        alphabet = byte_alphabet()
        self.inner = [self.vocab[c] for c in alphabet]
        self.last = [self.vocab[c + self.suffix] for c in alphabet]
        self.byte_of = {c: b for b, c in enumerate(alphabet)}
        kinds = {k: "".join(re.escape(chr(c)) for c in range(SAFE_END) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
        space = r"\t\n\x0b\x0c\r \x85\xa0"
        self.unsafe = re.compile(f"[^\\x00-\\x1b\\x20-{re.escape(chr(SAFE_END - 1))}]|İ")
        self.piece = re.compile(f"[{kinds['L']}]+|[{kinds['N']}]|'(?:s|t|re|ve|m|ll|d)|[^{space}{kinds['L']}{kinds['N']}]+")
        self.words, self._library = _Words(self), None

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word, by the contiguous rank array."""
        inner = self.inner
        parts = [inner[b] for b in word]
        parts[-1] = self.last[word[-1]]
        n = len(parts) - 1
        if n >= LONG:
            return self._encode_long(parts)
        rank, made = self.rank.get, self.made
        ranks = [rank(a << 32 | b, NONE) for a, b in zip(parts, parts[1:])]
        while n:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            parts[i] = part = made[least]
            n -= 1
            del parts[i + 1], ranks[i]
            if i < n:
                ranks[i] = rank(part << 32 | parts[i + 1], NONE)
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 32 | part, NONE)
        return tuple(parts)

    def _encode_long(self, parts: list[int]) -> tuple[int, ...]:
        n, rank = len(parts), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], i, p) for i, p in enumerate(a << 32 | b for a, b in zip(parts, parts[1:])) if p in rank]
        heapq.heapify(heap)
        while heap:
            least, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or parts[i] < 0 or parts[i] << 32 | parts[j] != pair:
                continue
            parts[i], parts[j], after[i] = self.made[least], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (p := parts[left] << 32 | parts[right]) in rank:
                    heapq.heappush(heap, (rank[p], left, p))
        return tuple(p for p in parts if p >= 0)

    def runs(self, text: str) -> list:
        """Runs of characters without white space, normalised; pieces never cross it. (Four control characters are white space to str.split alone; texts with them count as unsafe.)"""
        if self.unsafe.search(text) is None and (text.isascii() or unicodedata.is_normalized("NFC", text)):
            return text.lower().split()
        if self._library is None:  # other scripts: the library's own tables of case, classes and normal forms
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        mapped = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [(bytes(map(self.byte_of.__getitem__, m)),) for m, _ in mapped]

    def encode(self, text: str) -> list[int]:
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        if self.at_special is None or "<|" not in text:
            return list(chain.from_iterable(map(self.words.__getitem__, self.runs(text))))
        out: list[int] = []
        for part in self.at_special.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out.extend(chain.from_iterable(map(self.words.__getitem__, self.runs(part))))
        return out

    def decode(self, ids: list[int]) -> str:
        """The library's text for a vocabulary without decoder: the tokens, joined by spaces."""
        return " ".join(map(self.token.__getitem__, ids))


class _Words(dict):
    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str | tuple[bytes]) -> tuple[int, ...]:
        """word: a run, still to be cut into pieces, or a tuple of one piece."""
        encode = self.bpe.encode_word
        if type(word) is not str:
            out = encode(word[0])
        elif word.isalpha():
            out = encode(word.encode())
        elif word[:-1].isalpha() and word[-1] in ".,;:!?":
            out = self[word[:-1]] + self[word[-1]]
        else:
            out = tuple(chain.from_iterable(encode(p.encode()) for p in self.bpe.piece.findall(word)))
        self[word] = out
        return out


def _loaded(path: str) -> Bpe:
    """One vocabulary and cache of words for each Python process, kept between tasks."""
    return kept("bpe", path, lambda: Bpe(path))


def encode_documents(docs: DataFrame, vocabulary: str, text_col: str = "text", keep_ids: bool = True, keep_text: bool = True) -> DataFrame:
    """docs with n_tokens, token_ids and decoded (if kept), ids_sha256 and decoded_sha256; no shuffle, rows stay where they are.

    Columns named like an output are replaced. vocabulary: a path that every executor can open, as the public
    tokenizers are installed with the library that holds them.
    """
    outputs = ["n_tokens", *["token_ids"] * keep_ids, "ids_sha256", *["decoded"] * keep_text, "decoded_sha256"]
    docs = docs.drop(*[c for c in outputs if c != text_col])
    kinds = {"n_tokens": pa.int64(), "token_ids": pa.list_(pa.int32()), "ids_sha256": pa.string(), "decoded": pa.large_string(), "decoded_sha256": pa.string()}
    ddl = {"n_tokens": "bigint", "token_ids": "array<int>", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}

    def run(batches):
        bpe, sha = _loaded(vocabulary), hashlib.sha256
        for whole in batches:
            for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                got: dict[str, list] = {c: [] for c in outputs}
                for text in batch.column(text_col).to_pylist():
                    ids = bpe.encode(text or "")
                    decoded = bpe.decode(ids)
                    got["n_tokens"].append(len(ids))
                    got["ids_sha256"].append(sha(_little_endian(ids)).hexdigest())
                    got["decoded_sha256"].append(sha(decoded.encode()).hexdigest())
                    if keep_ids:
                        got["token_ids"].append(ids)
                    if keep_text:
                        got["decoded"].append(decoded)
                others = [n for n in batch.schema.names if n not in outputs]
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in others], *[pa.array(got[c], kinds[c]) for c in outputs]], names=[*others, *outputs])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name not in outputs]
    return docs.mapInArrow(run, ", ".join([*fields, *[f"{c} {ddl[c]}" for c in outputs]]))


def _little_endian(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def token_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return encode_documents(docs, vocabulary, keep_ids=False, keep_text=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
