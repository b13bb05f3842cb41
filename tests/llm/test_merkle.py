import hashlib
import random
import zlib

from estatelens.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def up(level):
    """All levels of a tree."""
    out = [level]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def climb(levels, i, h):
    proof = []
    for level in levels[:-1]:
        at = i // 8 * 8
        before, after = level[at:i], level[i + 1 : at + 8]
        proof += before + after
        h, i = H(*before, h, *after), i // 8
    return proof, h


def brute(rows):
    leaf = lambda r, text: H(field(r[0]) + field(r[3]) + field(r[2]) + field(r[4]) + field(text))
    trees = {}
    for r in rows:
        trees.setdefault("" if r[2] is None else "=" + r[2], []).append(r)
    names = sorted(trees, key=str.encode)
    leaves = {n: sorted((((r[0] is not None, r[0] or 0, leaf(r, r[1])), r) for r in trees[n]), key=lambda x: x[0]) for n in names}
    levels = {n: up([k[2] for k, _ in leaves[n]]) for n in names}
    top = up([levels[n][-1][0] for n in names])
    out = []
    for place, n in enumerate(names):
        for i, (k, r) in enumerate(leaves[n]):
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            proof, h = climb(levels[n], i, leaf(r, text))
            more, h = climb(top, place, h)
            out.append((r[0], k[2], levels[n][-1][0], top[-1][0], H(*proof, *more), h, h == top[-1][0]))
    return sorted(out, key=str)


COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_against_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    for n, langs, block in ((700, ["a", "b", None], 4), (150, [f"é{i}" for i in range(70)], 1), (1, ["x"], 4), (9, ["x"], 1), (65, [None], 1)):
        monkeypatch.setattr(merkle, "BLOCK_LEVELS", block)
        rows = [(i, rnd.choice(["Some Text", "lower", "ÄB", "", None, "x" * rnd.randint(1, 9)]), rnd.choice(langs), rnd.choice([None, "s", ""]), rnd.choice([None, 5])) for i in rnd.sample(range(10**6), n)]
        rows += [(None, "N", rows[0][2], None, 1), (None, None, rows[0][2], None, 1), rows[0], rows[0], (rows[0][0], "Other", rows[0][2], None, None)] if n > 1 else []
        got = merkle.verify_documents(spark.createDataFrame(rows, COLUMNS).repartition(7)).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows)
        assert any(not r.verified for r in got) or n < 20


def test_awkward_rows(spark):
    rows = [(1, "Very Long " * 300_000, "en", "s", 3), (2, None, None, None, None), (None, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 AS tree", "2 AS idx", "3 AS h", "4 AS payload", "5 AS __part", "6 AS __tie", "7 AS kind")
    assert sorted(map(tuple, merkle.verify_documents(df).collect()), key=str) == brute(rows)
    empty = merkle.verify_documents(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
