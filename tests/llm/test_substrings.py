import hashlib
import random
import re

import numpy as np
import pytest
from .helpers import ROWS, awkward

from estatelens.llm import _common, substrings


def brute(rows, n):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    rank = [2**63 if i is None else i for i, _ in rows]
    first = {}
    for r, w in zip(rank, words, strict=True):
        for j in range(len(w) - n + 1):
            key = tuple(w[j : j + n])
            first[key] = min(first.get(key, r), r)
    out = []
    for (i, _), r, w in zip(rows, rank, words, strict=True):
        gone = {x for j in range(len(w) - n + 1) if first[tuple(w[j : j + n])] < r for x in range(j, j + n)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(df, n):
    from pyspark.sql import functions as F

    out = substrings.drop_repeated_windows(df, n)
    return sorted((tuple(r) for r in out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()), key=str)


@pytest.mark.parametrize("n", [3, 13])
def test_equals_brute_force(spark, n):
    rnd = random.Random(n)
    vocabulary = ["a", "bb", "été", "d", "eee"]
    passages = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(5, 40))) for _ in range(8)]
    rows = [(rnd.randint(0, 200), rnd.choice([" ", "\n", "\t "]).join(rnd.choice(passages) if rnd.random() < 0.6 else " ".join(str(rnd.random()) for _ in range(5)) for _ in range(rnd.randint(0, 6)))) for _ in range(120)] + ROWS
    assert run(awkward(spark, rows), n) == brute(rows, n)


def test_spans_are_maximal(spark):
    text = " ".join(map(str, range(40)))
    out = substrings.drop_repeated_windows(spark.createDataFrame([(1, text), (2, "x " + text + " y")], "doc_id bigint, text string"))
    got = {r.doc_id: r for r in out.collect()}
    assert [tuple(s) for s in got[2].spans] == [(1, 41)] and got[2].kept == "x y" and not got[1].spans


def test_chunks_are_bounded_by_bytes(spark):
    """Null ids, one id and neighbours with long texts, each more than a chunk takes."""
    rows = [(i, f"{i} " * 5) for i in range(400)] + [(i, f"long {i} " * 200) for i in range(400, 440)] + [(None, f"null {i} " * 40) for i in range(150)] + [(7, f"same {i % 3} " * 40) for i in range(150)]
    chunks, ranges, n_bytes = _common.by_id_range(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", 4000)
    got = sorted(tuple(r) for r in chunks.collect())
    assert sorted((i, t) for _, i, t in got) == sorted((_common.LAST if i is None else i, t) for i, t in rows) and n_bytes == sum(len(t) for _, t in rows)
    sizes, held = {}, {}
    for c, i, t in got:
        sizes[c] = sizes.get(c, 0) + len(t)
        held.setdefault(int(ranges[c]), set()).add(i)
    assert max(sizes.values()) < 4000 + max(len(t) for _, t in rows)
    assert [(i, t) for _, i, t in got] == sorted((i, t) for _, i, t in got)  # chunks follow ids and texts
    assert len({i for ids in held.values() for i in ids}) == sum(map(len, held.values()))  # an id is in one range


def test_split_ids_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 600)
    rnd = random.Random(8)
    passages = [" ".join(rnd.choice("abcdefgh") for _ in range(20)) for _ in range(12)]
    rows = [(rnd.choice([None, 3, 7, rnd.randint(0, 60)]), " ".join(rnd.choice(passages) for _ in range(rnd.randint(0, 4)))) for _ in range(200)]
    assert run(awkward(spark, rows), 13) == brute(rows, 13)


def test_hashes_that_collide_are_told_apart(spark, monkeypatch):
    """With hashes of 16 bits the second hash decides."""
    true = _common.windows

    def coarse(words, of, n):
        hashes, at = true(words, of, n)
        return hashes & np.uint64(0xFFFF << 48), at

    monkeypatch.setattr(substrings, "windows", coarse)
    rnd = random.Random(4)
    passages = [" ".join(rnd.choice("abcdefgh") for _ in range(20)) for _ in range(12)]
    rows = [(i, " ".join(rnd.choice(passages) for _ in range(rnd.randint(0, 4)))) for i in range(120)]
    assert run(spark.createDataFrame(rows, "doc_id bigint, text string"), 13) == brute(rows, 13)


def test_empty_table(spark):
    assert run(awkward(spark, []), 13) == []
