import random

import numpy as np
import pytest
from .helpers import ROWS, awkward
from hypothesis import given, settings
from hypothesis import strategies as st

from estatelens.llm import decontam


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j - 1] + (x != y), before[j] + 1, row[j - 1] + 1))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 12).flatmap(lambda m: st.lists(st.tuples(st.lists(st.integers(0, 4), min_size=m, max_size=m), st.integers(0, m), st.lists(st.integers(0, 4), min_size=m, max_size=m)), min_size=1, max_size=4)))
def test_edit_distances(rows):
    a, sizes, b = (np.array(x) for x in zip(*rows, strict=True))
    assert decontam.edit_distances(a, sizes, b).tolist() == [brute_distance(x[:n], y) for x, n, y in rows]


def edited(words, edits, rnd):
    words = list(words)
    for _ in range(edits):
        k = rnd.randrange(len(words))
        words[k : k + 1] = rnd.choice([[], [f"new{rnd.randrange(10**6)}"], [words[k], "extra"]])
    return words


def word(rnd):
    return "".join(rnd.choice("aeioustrn") for _ in range(rnd.randint(2, 7)))


def planted(rnd, least, most, n):
    """Items, and documents of which every other one holds an item with as many edits as the bound allows, or fewer."""
    items = [[word(rnd) for _ in range(rnd.randint(least, most))] for _ in range(30)]
    docs = []
    for d in range(n):
        body = [word(rnd) for _ in range(rnd.randint(5, 60))]
        if d % 2:
            own = items[rnd.randrange(30)]
            at, e = rnd.randrange(len(body)), decontam.allowed(len(own))
            body[at:at] = edited(own, e if d % 4 == 1 else rnd.randint(0, e), rnd)
        docs.append(body)
    return items, docs


def truly(items, docs):
    """(document, item) by brute force over all windows of the item's size, cut at the text's end."""
    out = set()
    for d, body in enumerate(docs):
        for k, own in enumerate(items):
            bound = decontam.allowed(len(own))
            for s in range(len(body)):
                window = body[s : s + len(own)]
                if len(set(window) & set(own)) >= len(set(own)) - 2 * bound and brute_distance(window, own) <= bound:
                    out.add((d, k))
                    break
    return out


@pytest.mark.parametrize(("least", "most"), [(1, 4), (5, 7), (8, 12), (13, 24), (25, 60)])
def test_recall_against_all_windows(spark, least, most):
    rnd = random.Random(least)
    items, docs = planted(rnd, least, most, 240)
    truth = truly(items, docs)
    style = lambda d, text: text.upper() if d % 5 == 0 else text.replace(" ", ",\n") if d % 7 == 0 else text
    rows = [(d, style(d, " ".join(body))) for d, body in enumerate(docs)]
    got = decontam.leak_report(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(k, " ".join(own)) for k, own in enumerate(items)], "item_id bigint, text string")).collect()
    found = {(r.doc_id, k) for r in got for k in r.item_ids}
    assert len(truth) >= 70 and len(found & truth) / len(truth) >= decontam.TARGET_RECALL
    assert found <= truth


def test_only_the_samples_find_candidates(monkeypatch):
    rnd = random.Random(9)
    items, docs = planted(rnd, 10, 30, 60)
    texts = lambda rows: [" ".join(r).encode() for r in rows]
    found = {(d, leak["item_id"]) for d, leaks in enumerate(decontam.Items(list(range(30)), texts(items)).leaks(texts(docs))) for leak in leaks}
    truth = truly(items, docs)
    assert len(truth) >= 15 and found <= truth and len(found) / len(truth) >= decontam.TARGET_RECALL
    monkeypatch.setattr(decontam.Items, "_sampled", lambda self: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    assert not any(decontam.Items(list(range(30)), texts(items)).leaks(texts(docs)))


def test_window_keys_are_samples_of_the_embedding():
    words = np.random.default_rng(3).integers(1, 2**60, 80).astype(np.uint64)
    for walk in range(2 * decontam.WALKS):
        visited = decontam.embed(words, np.arange(80 - decontam.STEPS), walk)
        want = set()
        for r, places in enumerate(decontam.PLACES[walk]):
            key = np.zeros(len(visited), np.uint64)
            for symbol in words[visited[:, places]].T:
                key = key * decontam.BASE + symbol
            want.add(tuple(decontam.tagged(key, walk, r).tolist()))
        assert {tuple(k.tolist()) for k in decontam.window_keys(words, walk)} == want


def test_nearest_window_is_reported():
    items = decontam.Items([7, None], [b"a1 b2 c3 d4 e5 f6 g7 h8 i9 j10", b"x1 x2"])
    got = items.leaks([b"q a1 b2 c3 zz e5 f6 g7 h8 i9 j10 q x1 x2 a1 b2 c3 d4 e5 f6 g7 h8 i9 j10"])[0]
    assert got == [{"item_id": 7, "start": 14, "words": 10, "distance": 0}, {"item_id": None, "start": 12, "words": 2, "distance": 0}]


def test_punctuation_beyond_ascii_ends_words():
    items = decontam.Items([1], ["l\u00e9gende noire du ch\u00e2teau".encode()])
    for text in ("\u201cL\u00e9gende noire\u2014du CH\u00c2TEAU\u201d", "le\u0301gende\u00a0noire du cha\u0302teau", "l\u00e9gende \u00ab noire \u00bb du ch\u00e2teau."):
        assert items.leaks([text.encode()])[0], text
    assert not items.leaks(["l\u00e9gende noirex du ch\u00e2teau".encode()])[0]


def test_a_phrase_of_many_items_and_a_long_text(spark):
    """A hundred items begin alike, and a long text repeats that beginning: bounded work, exact result."""
    items = [(k, "which of the following is true about " + " ".join(f"w{k}x{i}" for i in range(12))) for k in range(100)]
    text = "which of the following is true about " * 4000 + items[41][1]
    got = decontam.leak_report(spark.createDataFrame([(1, text), (1, text)], "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert [r.item_ids for r in got] == [[41], [41]]


def test_embedding_keeps_near_windows_near():
    rnd = np.random.default_rng(1)
    a = rnd.integers(1, 2**60, (50, 60)).astype(np.uint64)
    near = a.copy()
    near[:, 10] = 7
    far = rnd.integers(1, 2**60, (50, 60)).astype(np.uint64)
    symbols = lambda x, walk=0: x.ravel()[decontam.embed(x.ravel(), np.arange(50) * 60, walk)]
    own, same, changed, other = (symbols(x) for x in (a, a.copy(), near, far))
    assert (own == same).all() and (own[:, :10] == changed[:, :10]).all()
    assert (own != changed).sum() < 0.5 * (own != other).sum()
    assert (symbols(a, 1) != own).any()


def test_awkward_rows(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven"), (2, None), (3, ""), (4, "École"), (5, "one two three four five six seven"), (None, "one two three four five six seven")], "item_id bigint, text string")
    got = decontam.leak_report(awkward(spark, ROWS), items).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r.item_ids for r in got}
    assert by[1] == [1, 5, None] and by[2] == [] and by[8] == [4] and by[9] == [] and by[6] == []
    assert decontam.leak_report(awkward(spark, []), items).count() == 0
    assert not any(r.contaminated for r in decontam.leak_report(awkward(spark, ROWS), items.limit(0)).collect())


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 20)
    items = spark.createDataFrame([(k, f"alpha{k} beta{k} gamma{k} delta{k} eps{k}") for k in range(6)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "x alpha2 beta2 gamma2 delta2 eps2 alpha5 beta5 gamma5 delta5 eps5")], "doc_id bigint, text string")
    assert decontam.leak_report(docs, items).first().item_ids == [2, 5]
