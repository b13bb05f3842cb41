import hashlib
import random
import re
import zlib

from estatelens.llm import trie


def brute(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            key = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()
            turns.setdefault(c, []).append(((turn is not None, turn or 0, key), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(xs)] for c, xs in turns.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (c % 20 if c >= 0 else -(-c % 20))
        rebuilt[c] = tuple(own.get(first, [])[:h] + own[c][h:])
    members = {}
    for c, way in rebuilt.items():
        for d in range(len(way) + 1):
            members.setdefault(way[:d], []).append(c)
    kids = {}
    for way in members:
        if way:
            kids.setdefault(way[:-1], []).append(way)
    saved = {w: (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", w[-1][1])) if w else 0 for w, m in members.items()}
    out = []
    for w, m in members.items():
        below = [v for v in members if v[: len(w)] == w]
        ends = ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(w))))
        out.append((min(m), len(w), min(members[w[:-1]]) if w else None, len(m), len(kids.get(w, [])), sum(v not in kids for v in below), sum(saved[v] for v in below), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = "conv_id bigint, turn bigint, role string, text string"


def test_against_brute_force(spark):
    rnd = random.Random(4)
    rows = []
    for c in [*rnd.sample(range(-30, 90), 70)]:
        rows += [(c, rnd.choice([None, k, k, k]), rnd.choice(["user", "assistant", None, ""]), rnd.choice(["a b", "c", "", None, " x\ty "])) for k in range(rnd.choice([1, 1, 2, 3, 5]))]
    rows += [(c, k, "user", f"same {k}") for c in (1000, 1020, 1040, 1060, 200_000, 70_000) for k in range(12)]  # copies down to the end, ids of several ranges
    rows += [(2000, k, "user", f"own {k}") for k in range(40)] + [(None, 1, "user", "none")] + [(3000, 1, "user", "twice")] * 3
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, COLUMNS)
    assert sorted(map(tuple, trie.prefix_trie(df).collect()), key=str) == brute(rows)


def test_awkward_rows(spark):
    rows = [(1, 0, "user", "long " * 200_000), (1, 1, None, None), (21, 5, "user", None), (None, None, None, None)]
    df = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 AS depth", "2 AS cls", "3 AS h", "4 AS __part", "5 AS n")
    assert sorted(map(tuple, trie.prefix_trie(df).collect()), key=str) == brute(rows)
    empty = trie.prefix_trie(df.limit(0))
    assert empty.count() == 0 and "ends_sha256" in empty.columns and trie.prefix_trie(df.filter("conv_id is null")).count() == 0
    alone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 4 > 1 and c % 20)  # loses its only turn, and there is none to begin with
    rows = [(alone, 0, "user", "gone")]
    assert list(map(tuple, trie.prefix_trie(spark.createDataFrame(rows, COLUMNS)).collect())) == brute(rows)
