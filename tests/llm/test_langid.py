import math
import random

import numpy as np
import public_tokenizers as P
from .helpers import awkward

from estatelens.llm import langid

PATH = P.path("piece_bpe_32k.model")
SYLLABLES = {"aa": ["the", "ing", "and", "wh"], "bb": ["que", "eau", "ment", "oi"], "cc": ["sch", "und", "ein", "keit"]}


def text(lang, rnd, n=40):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def corpus(n=400):
    rnd = random.Random(2)
    return [(i, text(lang := "abc"[i % 3] * 2, rnd), lang) for i in range(n)]


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba"]
    seg = langid.Segmenter(pieces)
    prob = np.random.default_rng(0).random((seg.size, 2))

    def brute(word):
        if not word:
            return np.ones(2)
        return sum((prob[seg.index.get(word[:j], 0)] * brute(word[j:]) for j in range(1, len(word) + 1) if word[:j] in seg.index or j == 1), np.zeros(2))

    words = ["▁abab", "▁baba", "▁aabb", "▁abxa"]
    assert np.allclose(seg.forward(words, prob)[:, -1], [brute(w) for w in words])


def test_expected_uses_add_up():
    seg = langid.Segmenter(["▁", "a", "ab", "▁ab"])
    prob = np.full((seg.size, 1), 0.25)
    uses = seg.expected(list(seg.lattice(["▁abab"])), (1, 5), np.array([[1.0]]), prob)
    characters = sum(uses[i, 0] * len(p) for p, i in seg.index.items()) + uses[0, 0]
    assert math.isclose(characters, 5)


def test_wide_words_are_summed_whole():
    """The sums in logarithms equal the others, and a long word's pieces may lie anywhere in it."""
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "bab"]
    seg = langid.Segmenter(pieces)
    prob = np.random.default_rng(4).random((seg.size, 2))
    for word in ("▁abab", "▁bbabxaab", "▁" + "ab" * 20):
        assert np.allclose(seg.log_forward(word, np.log(prob)), np.log(seg.forward([word], prob)[0, -1]))
        out = np.zeros(prob.shape)
        seg.log_expected(word, np.array([1.0, 2.0]), np.log(prob), out)
        assert np.allclose(out, seg.expected(list(seg.lattice([word])), (1, len(word)), np.array([[1.0, 2.0]]), prob))
    one = np.log(np.full((seg.size, 1), 1e-5))
    assert np.allclose(seg.log_forward("▁" + "x" * 5000, one), 5001 * np.log(1e-5))


def test_words():
    assert langid.words_of("Don't 12 STOP½") == ["don", "t", "stop"]
    assert langid.words_of("½ ² ①② Ⅷ _ 3") == [] == langid.words_of(None)
    assert langid.words_of("Été e\u0301te\u0301 नमस्ते") == ["été", "e\u0301te\u0301", "नमस्ते"]


def test_predictions_against_brute_force():
    rnd = random.Random(5)
    counts = {lang: {} for lang in SYLLABLES}
    for lang in SYLLABLES:
        for w in langid.words_of(text(lang, rnd, 300)):
            counts[lang][w] = counts[lang].get(w, 0) + 1
    pieces = sorted({x for xs in SYLLABLES.values() for x in xs} | set("abcdefghijklmnopqrstuvwxyz") | {langid.MARK})
    langs, prob = langid.fit(counts, pieces)
    seg = langid.Segmenter(pieces)

    def likelihood(word):
        if not word:
            return np.ones(len(langs))
        return sum((prob[seg.index.get(word[:j], 0)] * likelihood(word[j:]) for j in range(1, min(len(word), 5) + 1) if word[:j] in seg.index or j == 1), np.zeros(len(langs)))

    texts = [text(lang, rnd, 2) for lang in SYLLABLES for _ in range(4)]
    got = langid.Identifier(langs, pieces, prob).predict(texts)
    for t, lang, score in zip(texts, *got, strict=True):
        total = np.sum([np.log(likelihood(langid.MARK + w)) for w in langid.words_of(t)], axis=0)
        share = np.exp(total - total.max())
        assert lang == langs[int(total.argmax())] and math.isclose(score, 1 / share.sum(), rel_tol=1e-6)


def test_documents_against_brute_force(spark):
    """predict_documents over the real vocabulary equals plain sums over all its pieces, those that no text held included."""
    rows = corpus(90)
    probes = [(1000 + i, t, None) for i, t in enumerate(["fjord glyph", "blurb", "hjk", "the zebra quietly", "queeau xylophon", "undsch ß"])]
    df = spark.createDataFrame(rows + probes, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in langid.predict_documents(df, PATH).collect()}
    counts = {lang: {} for lang in SYLLABLES}
    import zlib

    for i, t, lang in rows:
        for w in langid.words_of(t) if zlib.crc32(str(i).encode()) % 4 != 2 else []:
            counts[lang][w] = counts[lang].get(w, 0) + 1
    pieces = langid.vocabulary(PATH)
    langs, prob = langid.fit(counts, pieces)
    index = {p: i + 1 for i, p in enumerate(pieces)}

    def likelihood(word, at=0, held=None):
        held = {len(word): np.ones(len(langs))} if held is None else held
        if at not in held:
            held[at] = sum((prob[index.get(word[at:j], 0)] * likelihood(word, j, held) for j in range(at + 1, len(word) + 1) if word[at:j] in index or j == at + 1), np.zeros(len(langs)))
        return held[at]

    for i, t, _ in probes + rows[:5]:
        total = np.sum([np.log(likelihood(langid.MARK + w)) for w in langid.words_of(t)], axis=0)
        assert got[i].lang_pred == langs[int(total.argmax())] and math.isclose(got[i].score, 1 / np.exp(total - total.max()).sum(), rel_tol=1e-6), t


def test_held_out_accuracy_and_contract(spark):
    df = spark.createDataFrame(corpus(), "doc_id bigint, text string, lang string")
    got = langid.predict_documents(df, PATH).collect()
    truth = {i: lang for i, _, lang in corpus()}
    held = [r for r in got if r.held_out]
    import zlib

    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.99
    assert all(0 <= r.score <= 1 for r in got)


def test_labels_of_held_out_rows_play_no_part(spark):
    import zlib

    rows = corpus(120)
    other = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in langid.predict_documents(spark.createDataFrame(x, "doc_id bigint, text string, lang string"), PATH).collect()} for x in (rows, other))
    assert a == b


def test_awkward_rows(spark):
    rows = [*[(i, t) for i, t, _ in corpus(60)], (1000, None), (1001, ""), (1002, "12 34 !?"), (None, "the theing"), (1003, "x" * 70_000), (1004, "中文"), (1005, "½ ② Ⅷ"), (1006, "the theing"), (1006, "the theing")]
    df = awkward(spark, rows).drop("lang").join(spark.createDataFrame([(i, lang) for i, _, lang in corpus(60)], "doc_id bigint, lang string"), "doc_id", "left")
    found = langid.predict_documents(df, PATH).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(rows) and len({r.score for r in found if r.doc_id == 1006}) == 1 and {got[i].lang_pred for i in (1000, 1001, 1002, 1005)} == {"und"} and got[1000].score == 0 and got[1003].lang_pred in SYLLABLES and got[None].lang_pred == "aa"
    assert langid.predict_documents(df.limit(0), PATH).count() == 0
    unlabelled = df.drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {r.lang_pred for r in langid.predict_documents(unlabelled, PATH).collect()} == {"und"}
