import hashlib
import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from estatelens.llm import decontam, langid, minhash
from estatelens.llm.queries import BPE_VOCABULARY, PIECE_VOCABULARY

from .test_decontam import brute_distance
from .test_langid import text

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    from estatelens.llm._common import written

    for name, stage in corpus_pipeline.STAGES:
        new = written(stage(spark, docs, DATA), name)
        out.append((name, docs, new))
        docs = new
    return out


def test_columns_and_rows(spark, stages):
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns and after.count() <= before.count(), name
    assert [n for n, _, _ in stages] == [n for n, _ in corpus_pipeline.STAGES]


def test_each_stage_against_brute_force(stages):
    _, docs, known = stages[0]
    told = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict_documents(docs, PIECE_VOCABULARY).collect()}
    assert {r.doc_id for r in known.collect()} == {i for i, (lang, score) in told.items() if lang != "und" and score >= corpus_pipeline.LEAST_SCORE}  # nothing else is wrong with these
    _, before, unique = stages[1]
    lines = [x for r in unique.select("text").collect() for x in r.text.split("\n") if x.strip()]
    assert len(set(lines)) == len(lines) and {x for r in unique.select("text").collect() for x in r.text.split("\n")} <= {x for r in before.select("text").collect() for x in r.text.split("\n")}
    _, before, apart = stages[2]
    rows = sorted((r.doc_id, r.text) for r in before.collect())
    sets = [(i, minhash.shingles(minhash.word_list(t))) for i, t in rows]
    linked = lambda a, b: bool(a & b) and 100 * len(a & b) >= 75 * len(a | b)
    kept = {r.doc_id for r in apart.collect()}
    own = [(i, s) for i, s in sets if i in kept]
    assert not any(linked(a, b) for x, (_, a) in enumerate(own) for _, b in own[:x])
    assert all(any(linked(s, t) for j, t in sets if j < i) for i, s in sets if i not in kept)
    _, before, clean = stages[3]
    from pyspark.sql import SparkSession

    texts = [decontam.prepared(r.text.encode()).decode() for r in SparkSession.active().read.parquet(f"{DATA}/benchmark.parquet").collect()]
    words = lambda text: re.findall(r"[^\W_]+", text)
    items = [words(x) for x in texts]
    left = {r.doc_id for r in clean.collect()}

    def leaks(text):
        own = words(text.lower())
        grams = set(own)
        for item in items:
            bound = decontam.allowed(len(item))
            if len(grams & set(item)) < len(set(item)) - bound:
                continue
            for s in range(len(own)):
                window = own[s : s + len(item)]
                if len(set(window) & set(item)) >= len(set(item)) - 2 * bound and brute_distance(window, item) <= bound:
                    return True
        return False

    gone = {r.doc_id for r in before.collect() if leaks(r.text)}
    assert len(gone) >= 1 and left == {r.doc_id for r in before.collect()} - gone


FOREIGN = {
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    "zh": "人人生而自由 在尊严和权利上一律平等",
    "none": "xqzj wvkk pqoz jjzx qqwv kzxj vvbq wwxz kkqj zzvx",
}


def test_language_stage_rejects_foreign_mixed_and_mislabelled(spark):
    """The stage keeps what it had and drops what is planted; without it all of that would stay."""
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    clean = docs.filter("lang is not null and length(text) > 400").orderBy("doc_id").limit(300).collect()
    words = {k: [r.text.replace("\n", " ").split(" ") for r in clean if r.lang == k] for k in ("de", "en", "es", "fr")}
    n = iter(range(10**9, 2 * 10**9))
    planted = [(next(n), t, lang) for t in FOREIGN.values() for lang in (None, "en")]
    for k in range(6):  # a word of each language in turn
        planted.append((next(n), " ".join(w for ws in zip(*(words[x][k][:80] for x in words), strict=False) for w in ws), None))
    wrong = {"de": "fr", "fr": "de", "en": "es", "es": "en"}
    planted += [(next(n), " ".join(ws[0]), wrong[k]) for k, ws in words.items()] + [(next(n), None, "en"), (next(n), "12 34 ...", None)]
    own = [(next(n), " ".join(ws[1]), lang) for k, ws in words.items() for lang in (None, k)]
    more = spark.createDataFrame([(i, t, lang, "planted", len(t or "")) for i, t, lang in planted + own], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.known_language(spark, docs.unionByName(more.select(docs.columns)), data)
    got = {r.doc_id: r.lang for r in kept.select("doc_id", "lang").collect()}
    assert not {i for i, _, _ in planted} & set(got)
    assert [got.get(i) for i, _, _ in own] == [k for k in words for _ in range(2)]
    assert {r.doc_id for r in docs.collect()} <= set(got)


def test_tokens_decode(stages):
    _, before, tokens = stages[4]
    library = Tokenizer.from_file(BPE_VOCABULARY)
    text = {r.doc_id: r.text for r in before.collect()}
    rows = tokens.collect()
    assert len(rows) == len(text)
    for r in rows:
        assert r.token_ids == library.encode(text[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.token_ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(r.token_ids, skip_special_tokens=False).encode()).hexdigest()


def test_unlabelled_documents_are_kept(spark):
    rows = [(1, "one two"), (2, None), (3, "12 - !"), (4, "Été"), (None, "three"), (5, "½ Ⅷ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("lang", F.lit(None).cast("string"))
    got = corpus_pipeline.known_language(spark, docs, DATA)
    assert got.columns == docs.columns and sorted(r.text for r in got.collect()) == ["one two", "three", "Été"]


def test_language_stage_uses_its_prediction(spark, monkeypatch):
    """Letters alone don't keep a document: one below the least score goes, and an unlabelled one gets its language. Whether it is any learned language's is left aside here."""
    monkeypatch.setattr(corpus_pipeline, "LEAST_FIT", -99.0)
    rows = [*labelled(), (900, text("bb", random.Random(1), 12), None), (901, "q", None), (902, None, None), (903, "zjzjzj", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    told = {r.doc_id: r for r in langid.predict_documents(docs, PIECE_VOCABULARY).collect()}
    got = {r.doc_id: r.lang for r in corpus_pipeline.known_language(spark, docs, DATA).collect()}
    assert got[900] == "bb" and 902 not in got and set(got) == {i for i, r in told.items() if r.score >= corpus_pipeline.LEAST_SCORE}
    scores = sorted({r.score for r in told.values() if r.lang_pred != "und"})
    monkeypatch.setattr(corpus_pipeline, "LEAST_SCORE", scores[1])
    unsure = {i for i, r in told.items() if r.lang_pred != "und" and r.score == scores[0]}
    assert unsure and {r.doc_id for r in corpus_pipeline.known_language(spark, docs, DATA).collect()} == {i for i, r in told.items() if r.lang_pred != "und"} - unsure


def labelled():
    rnd = random.Random(2)
    return [(i, text(lang := "abc"[i % 3] * 2, rnd, 25), lang) for i in range(90)]


CLASH = ["__place", "__id", "__node", "__kept", "__d", "__own", "__aside_0", "lang_pred", "score", "leaks", "n_lines", "n_removed", "n_tokens", "token_ids", "id", "node", "line", "further_column_0"]


@pytest.fixture(scope="module")
def awkward(spark):
    """Documents with nulls, ties, repeated rows, a very long text, and further columns under names that operators use."""
    rnd = random.Random(3)
    base = [(i, t, lang) for i, t, lang in labelled()]
    near = [*base[4][1].split(), "whthe"]
    long_line = " ".join(rnd.choice(["the", "ing", "and", "wh", "theing"]) + rnd.choice(["", "the", "ing"]) for _ in range(40_000))
    rows = [*base, (500, " ".join(near), "bb"), (501, base[7][1], "bb"), (501, base[7][1], "bb"), (None, base[8][1] + "\n" + text("cc", rnd, 20), "cc"), (None, None, None), (502, "", "aa"), (503, " \n\t\n", None), (504, long_line, "aa"), (505, None, "aa")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("bigint"))
    return docs.withColumns({c: F.concat_ws("/", F.lit(c), F.col("doc_id").cast("string")) for c in CLASH})


@pytest.mark.parametrize("at", range(4))
def test_stages_take_awkward_rows(spark, awkward, at):
    stage = corpus_pipeline.STAGES[at][1]
    got = stage(spark, awkward, DATA)
    rows = got.collect()
    assert got.columns == awkward.columns and got.dtypes == awkward.dtypes
    assert all(r[c] == (f"{c}/{r.doc_id}" if r.doc_id is not None else c) for r in rows for c in CLASH)
    ids = [r.doc_id for r in rows]
    if at == 0:
        assert 504 in ids and 502 not in ids and 503 not in ids and 505 not in ids and ids.count(501) == 2 and ids.count(None) == 1
    elif at == 1:
        assert 501 not in ids and 502 not in ids and 505 not in ids and 504 in ids and 500 not in ids
        assert [r.text.count("\n") for r in rows if r.doc_id is None] == [0] and all(r.n_chars == len(r.text) for r in rows)
    elif at == 2:
        assert 500 not in ids and 501 not in ids and ids.count(None) == 2 and {502, 503, 505} <= set(ids)
    else:
        assert len(ids) == awkward.count()
    assert stage(spark, awkward.limit(0), DATA).columns == awkward.columns and stage(spark, awkward.limit(0), DATA).count() == 0


def test_last_stage_takes_awkward_rows(spark, awkward):
    got = corpus_pipeline.tokens(spark, awkward, DATA)
    rows = got.collect()
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256"] and len(rows) == awkward.count()
    assert {r.n_tokens for r in rows if r.doc_id in (502, 503, 505)} == {0} and max(r.n_tokens for r in rows) > 40_000
    assert corpus_pipeline.tokens(spark, awkward.limit(0), DATA).count() == 0


def test_planted_copies_are_gone_after_both_stages(spark):
    """Copies of multi-line documents with an edited line: the line stage takes what is equal, the near-copy stage what is left alike, and no passage stays twice."""
    rnd = random.Random(8)
    sentence = lambda: " ".join("".join(rnd.choice("aeioustrnlmd") for _ in range(rnd.randint(3, 8))) for _ in range(rnd.randint(12, 20)))
    rows, groups = [], 40
    for g in range(groups):
        lines = [sentence() for _ in range(8)]
        rows.append((g, "\n".join(lines)))
        for c in range(1, 4):
            own = list(lines)
            k = rnd.randrange(8)
            words = own[k].split()
            words[rnd.randrange(len(words))] = "edited"
            own[k] = " ".join(words)
            rows.append((1000 * c + g, "\n".join(own) if c < 3 else " ".join(own)))  # the last has its lines joined
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'aa' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars")
    got = corpus_pipeline.one_of_near_copies(spark, corpus_pipeline.distinct_lines(spark, docs, DATA), DATA).collect()
    left = {r.doc_id for r in got}
    assert set(range(groups)) <= left and not {i for i in left if 1000 <= i < 3000}
    assert len(left) == groups, sorted(left)[groups:]
