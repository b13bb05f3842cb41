"""Language identification by unigram pieces, summed over all segmentations.

The vocabulary of pieces is public and fixed; only the pieces' probabilities are learned,
one distribution for each language, by expectation maximisation over word counts. A word
(a letter with the letters and marks after it, lower-cased) is scored by the forward
algorithm: its probability in a language is the sum, over every way to cut it into pieces of
the vocabulary, of the product of their probabilities. Pieces don't cross words, so a text's
likelihood is the product of its words'. Words of any length are summed whole: those of more
than WIDE characters one by one, in logarithms.

The model is fitted on a bounded sample of labelled rows (SAMPLE_DOCS texts of each language,
whole); every whole text is scored.

Defined results: a null text or one without letters is `und` with score 0 (digits, fractions
and numerals are no letters); without any row to learn from every text is `und`; ties go to the
first language in code-point order; repeated rows are scored alike, and count as often as they
occur when they are learned from; a very long text is scored whole by one task; an empty table
gives no rows; columns named lang_pred, score, lang_fit or lang_share are replaced, others are
kept. score is the predicted language's share of all learned languages' probability, which is
near 1 for any long text; lang_fit and lang_share (null for `und`) tell whether the text is of
that language at all: the log-probability of a character, and the share of letters in words
that no other language explains better by a factor of e ** MARGIN.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import kept

SAMPLE_DOCS = 400
EM_ROUNDS = 3
WIDE = 32  # characters up to which products of probabilities stay within a double's range
CACHED_WORDS = 200_000
MARGIN = 2.0  # by which a word's log-probability has to be higher in another language to count as that one's
ASCII_WORD = re.compile("[a-z]+")
MARK = "▁"


def words_of(text: str | None) -> list[str]:
    """The words of a text, for learning and scoring alike."""
    if not text:
        return []
    text = text.lower()
    if text.isascii():
        return ASCII_WORD.findall(text)
    import regex

    return regex.findall(r"\p{L}[\p{L}\p{M}]*", text)


def vocabulary(path: str) -> list[str]:
    """The lower-case pieces of a sentencepiece vocabulary that hold nothing but letters, with the mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted(p for p in pieces if p.removeprefix(MARK).isalpha() or p == MARK)


class Segmenter:
    """Forward and backward sums over all segmentations, for many words of one length at a time."""

    def __init__(self, pieces: list[str]):
        self.index = {p: i + 1 for i, p in enumerate(pieces)}  # 0: no such piece
        self.size, self.longest = len(pieces) + 1, max(map(len, pieces), default=1)

    def lattice(self, words: list[str]):
        """(i, j, which words, piece of each) for every cut of the marked words; a single unknown character is piece 0."""
        n, get = len(words[0]), self.index.get
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                ids = np.fromiter((get(w[i:j], 0) for w in words), np.int32, len(words))
                at = np.flatnonzero(ids) if j - i > 1 else np.arange(len(words))
                if len(at):
                    yield i, j, at, ids[at]

    def forward(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        """prob: pieces by languages. Returns alpha: words by places by languages."""
        alpha = np.zeros((len(words), len(words[0]) + 1, prob.shape[1]))
        alpha[:, 0] = 1
        for i, j, at, ids in self.lattice(words):
            alpha[at, j] += alpha[at, i] * prob[ids]
        return alpha

    def expected(self, cuts: list, shape: tuple, weight: np.ndarray, prob: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, by language; cuts: the lattice of `shape` (words, characters); weight: words by languages."""
        alpha, beta = np.zeros((2, shape[0], shape[1] + 1, prob.shape[1]))
        alpha[:, 0], beta[:, -1] = 1, 1
        for i, j, at, ids in cuts:
            alpha[at, j] += alpha[at, i] * prob[ids]
        for i, j, at, ids in sorted(cuts, key=lambda c: -c[1]):
            beta[at, i] += beta[at, j] * prob[ids]
        share = weight / np.maximum(alpha[:, -1], 1e-300)
        out = np.zeros((self.size, prob.shape[1]))
        for i, j, at, ids in cuts:
            use = alpha[at, i] * prob[ids] * beta[at, j] * share[at]
            for k in range(prob.shape[1]):
                out[:, k] += np.bincount(ids, use[:, k], self.size)
        return out

    def ends_at(self, word: str, j: int) -> tuple[list[int], list[int]]:
        """Where the pieces of a word that end at j begin, and which they are."""
        found = [(i, self.index.get(word[i:j], 0)) for i in range(max(0, j - self.longest), j)]
        found = [(i, p) for i, p in found if p or i == j - 1]
        return [i for i, _ in found], [p for _, p in found]

    def log_forward(self, word: str, log_prob: np.ndarray) -> np.ndarray:
        """The logarithm of one word's sum over all segmentations; only the last `longest` places are held."""
        n = self.longest + 1
        held = np.full((n, log_prob.shape[1]), -np.inf)
        held[0] = 0
        for j in range(1, len(word) + 1):
            begin, ids = self.ends_at(word, j)
            held[j % n] = np.logaddexp.reduce(held[[i % n for i in begin]] + log_prob[ids], axis=0)
        return held[len(word) % n]

    def log_expected(self, word: str, weight: np.ndarray, log_prob: np.ndarray, out: np.ndarray) -> None:
        """Adds one word's expected uses to out, in logarithms."""
        cuts = [self.ends_at(word, j) for j in range(1, len(word) + 1)]
        alpha, beta = np.full((2, len(word) + 1, log_prob.shape[1]), -np.inf)
        alpha[0], beta[-1] = 0, 0
        for j, (begin, ids) in enumerate(cuts, 1):
            alpha[j] = np.logaddexp.reduce(alpha[begin] + log_prob[ids], axis=0)
        for j in range(len(word), 0, -1):
            begin, ids = cuts[j - 1]
            beta[begin] = np.logaddexp(beta[begin], beta[j] + log_prob[ids])
            out[ids] += np.exp(alpha[begin] + log_prob[ids] + beta[j] - alpha[-1]) * weight


def by_length(words: list[str], most: int = 4000):
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    start = 0
    for end in range(1, len(order) + 1):
        if end == len(order) or end - start == most or len(words[order[end]]) != len(words[order[start]]):
            yield order[start:end]
            start = end


def fit(counts: dict[str, dict[str, float]], pieces: list[str]) -> tuple[list[str], np.ndarray]:
    """Languages in order, and pieces by languages; counts: words of each language."""
    langs = sorted(counts)
    seg = Segmenter(pieces)
    held: dict[str, np.ndarray] = {}
    for k, lang in enumerate(langs):
        for word, n in counts[lang].items():
            held.setdefault(MARK + word, np.zeros(len(langs)))[k] += n
    wide, words = sorted(w for w in held if len(w) > WIDE), sorted(w for w in held if len(w) <= WIDE)
    groups = [[words[i] for i in group] for group in by_length(words)]
    lattices = [(list(seg.lattice(ws)), (len(ws), len(ws[0])), np.array([held[w] for w in ws])) for ws in groups]
    prob = np.full((seg.size, len(langs)), 1.0 / seg.size)
    for _ in range(EM_ROUNDS):
        uses, log_prob = np.full(prob.shape, 0.05), np.log(prob)
        for lattice in lattices:
            uses += seg.expected(*lattice, prob)
        for w in wide:
            seg.log_expected(w, held[w], log_prob, uses)
        prob = uses / uses.sum(axis=0)
    return langs, prob


class Identifier:
    """Scores texts; languages and pieces are the model, the cache holds words' log probabilities."""

    def __init__(self, langs: list[str], pieces: list[str], prob: np.ndarray):
        self.langs, self.prob, self.log_prob, self.seg = langs, prob, np.log(prob), Segmenter(pieces)
        self.row: dict[str, int] = {}
        self.scores = np.zeros((1024, len(langs)))
        self.sizes = np.zeros(1024, np.int64)

    def learn(self, words: list[str]) -> None:
        """Scores of words that aren't held yet."""
        if len(self.row) > CACHED_WORDS:
            self.row.clear()
        need = len(self.row) + len(words)
        if need > len(self.scores):
            self.scores = np.concatenate([self.scores[: len(self.row)], np.zeros((need, len(self.langs)))])
            self.sizes = np.concatenate([self.sizes[: len(self.row)], np.zeros(need, np.int64)])
        base = len(self.row)
        self.row.update(zip(words, range(base, base + len(words)), strict=True))
        marked = [MARK + w for w in words]
        self.sizes[base : base + len(words)] = [len(w) for w in words]
        narrow = [i for i, w in enumerate(marked) if len(w) <= WIDE]
        for group in by_length([marked[i] for i in narrow]):
            alpha = self.seg.forward([marked[narrow[i]] for i in group], self.prob)[:, -1]
            self.scores[[base + narrow[i] for i in group]] = np.log(np.maximum(alpha, 1e-300))
        for i, w in enumerate(marked):
            if len(w) > WIDE:
                self.scores[base + i] = self.seg.log_forward(w, self.log_prob)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language and score of each text."""
        return self.told(texts)[:2]

    def told(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float | None], list[float | None]]:
        """lang_pred, score, lang_fit and lang_share of each text."""
        words = [words_of(t) for t in texts]
        held = self.row
        if new := {w for ws in words for w in ws if w not in held}:
            self.learn(sorted(new) if len(held) <= CACHED_WORDS else sorted({w for ws in words for w in ws}))
        lengths = np.array([len(ws) for ws in words])
        some = np.flatnonzero(lengths)
        langs, scores, fits, shares = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts), [None] * len(texts)
        if len(some) and self.langs:
            rows = np.fromiter(map(self.row.__getitem__, chain.from_iterable(words)), np.int64, int(lengths.sum()))
            starts = np.concatenate([[0], np.cumsum(lengths[some])[:-1]])
            own, sizes = self.scores[rows], self.sizes[rows]
            total = np.add.reduceat(own, starts)
            best = total.argmax(axis=1)
            share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            letters = np.add.reduceat(sizes, starts)
            in_best = own[np.arange(len(own)), np.repeat(best, lengths[some])]
            of_best = np.add.reduceat(sizes * (in_best >= own.max(axis=1) - MARGIN), starts) / letters
            fit_ = total.max(axis=1) / (letters + lengths[some])
            for i, k, s, f, o in zip(some, best, share, fit_, of_best, strict=True):
                langs[i], scores[i], fits[i], shares[i] = self.langs[k], float(s), float(f), float(o)
        return langs, scores, fits, shares


def learn(rows: DataFrame, pieces_path: str) -> tuple[list[str], list[str], np.ndarray]:
    """The model from rows with `text`, `lang` and `doc_id`; only a bounded sample of texts leaves the executors, as word counts."""
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    held = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    pieces = vocabulary(pieces_path)
    if not held:
        return [], pieces, np.zeros((len(pieces) + 1, 0))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*chain.from_iterable((F.lit(k), F.lit(min(1.0, SAMPLE_DOCS / n))) for k, n in held.items()))
    counts: dict[str, dict[str, float]] = {k: {} for k in held}
    for lang, word, n in _worded(rows.filter(draw < share[F.col("lang")])).groupBy("lang", "word").count().collect():
        counts[lang][word] = float(n)
    langs, prob = fit(counts, pieces)
    return langs, pieces, prob


def _worded(rows: DataFrame) -> DataFrame:
    """(lang, word): the words of the rows' texts."""

    def run(batches):
        for batch in batches:
            words = [words_of(t) for t in batch.column("text").to_pylist()]
            langs = np.repeat(np.arange(len(words)), [len(w) for w in words])
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(langs)), pa.array(list(chain.from_iterable(words)), pa.string())], names=["lang", "word"])

    return rows.select("lang", "text").mapInArrow(run, "lang string, word string")


def identify(docs: DataFrame, model: tuple, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score, lang_fit and lang_share, in place of columns of these names; no shuffle."""
    docs = docs.drop("lang_pred", "score", "lang_fit", "lang_share")
    names, digest = docs.columns, hashlib.sha256(repr(model[:2]).encode() + model[2].tobytes()).hexdigest()

    def run(batches):
        scorer = kept("identifier", digest, lambda: Identifier(*model))  # with the words that other tasks have met
        for whole in batches:
            for batch in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                langs, *numbers = scorer.told(batch.column(text_col).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), *(pa.array(x, pa.float64()) for x in numbers)], names=[*names, "lang_pred", "score", "lang_fit", "lang_share"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double", "lang_fit double", "lang_share double"]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def predict_documents(docs: DataFrame, pieces_path: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learned from the documents that are not held out."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "lang")
    model = learn(docs.filter(~held_out(F.col("doc_id"))), pieces_path)
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
