import random

from .helpers import ROWS, awkward

from estatelens.llm import minhash
from estatelens.llm.components import components


def brute(rows):
    sets = [minhash.shingles(minhash.word_list(t)) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * len(a | sets[j]):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), 2**63), 2**63 if d is None else d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = low[root(i)]
        own = 2**63 if d is None else d
        out.append((d, len(sets[i]), None if c == 2**63 else c, own == c))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    common = " ".join(rnd.choice(vocabulary) for _ in range(60))
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randint(6, 120))] for _ in range(25)]
    rows = []
    for i in range(300):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        text = " ".join(w) + (" " + common if i % 3 == 0 else "")
        rows.append((i + 50, text.upper() if i % 11 == 0 else text))
    rows += ROWS
    assert sorted(map(tuple, minhash.near_duplicates(awkward(spark, rows)).collect()), key=str) == brute(rows)


def test_large_groups_in_blocks(spark, monkeypatch):
    """Near copies of one text with many edits, some of them shared: compared in blocks, with the result of brute force."""
    monkeypatch.setattr(minhash, "SMALL_GROUP", 50)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(160):
        w = list(base)
        for k in rnd.sample(range(150), rnd.choice([1, 3, 5, 6, 8])):
            w[k] = f"x{rnd.randrange(2) if i % 4 else rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_rows_that_meet_in_blocks_grow_with_the_group(spark, monkeypatch):
    """Near copies of which each is linked with a part of the others: four times as many make not sixteen times the rows."""
    monkeypatch.setattr(minhash, "SMALL_GROUP", 50)
    monkeypatch.setattr(minhash, "BLOCK", 48)
    true, met = minhash._block_links, spark.sparkContext.accumulator(0)

    def counted(batches):
        def seen():
            for b in batches:
                met.add(b.num_rows)
                yield b

        return true(seen())

    monkeypatch.setattr(minhash, "_block_links", counted)
    rnd, seen = random.Random(4), []
    for n in (150, 600):
        rows = []
        for i in range(n):
            w = [f"w{k}" for k in range(150)]
            for k in rnd.sample(range(60, 100), 2 + i % 2):  # linked are 2 and 2, and others with an edit in common
                w[k] = f"x{rnd.randrange(10**9)}"
            rows.append((i, " ".join(w)))
        before = met.value
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
        seen.append(met.value - before)
    assert 0 < seen[1] < 6 * seen[0], seen


def test_union_sketch_estimate():
    import numpy as np

    rng = np.random.default_rng(2)
    for k, na, nb in ((32, 200, 180), (32, 10, 14), (8, 8, 3)):
        a = np.sort(rng.choice(300, na, replace=False)).astype(np.int64)
        others = [np.sort(rng.choice(300, nb, replace=False)).astype(np.int64) for _ in range(5)]
        rows = np.full((5, k), minhash.NO_VALUE)
        for i, b in enumerate(others):
            rows[i, : min(k, nb)] = b[:k]
        want = [len(set(u := np.union1d(a[:k], b[:k])[:k]) & set(a[:k]) & set(b[:k])) / len(u) for b in others]
        assert np.allclose(minhash.shared_of_union(a[:k], rows, k), want)


def test_shingles_of_one_hash_are_counted_apart(monkeypatch):
    true = minhash.windows
    monkeypatch.setattr(minhash, "windows", lambda words, of, n: (true(words, of, n)[0] & minhash.np.uint64(6), true(words, of, n)[1]))
    text = " ".join(f"w{i % 40}" for i in range(100))
    assert minhash.sketches([text], minhash.Hasher(), 5, 32)[0][0] == len(minhash.shingles(minhash.word_list(text)))


def test_one_of_each(spark):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in minhash.one_of_each(awkward(spark, ROWS)).collect())
    expected = [(1, ROWS[0][1]), (2, ""), (3, ""), (4, "  \t\n "), (6, ROWS[7][1]), (8, ROWS[9][1]), (9, "x")]
    assert got == sorted([*[(False, i, t) for i, t in expected], (True, 0, "")])
    assert minhash.one_of_each(awkward(spark, [])).count() == 0


def test_empty_table(spark):
    assert minhash.near_duplicates(awkward(spark, [])).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(70, 70), (61, 60), (60, 61)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 1 for i in range(1, 40)) and got[61] == 60 and 70 not in got
