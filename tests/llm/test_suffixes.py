import hashlib
import random

import numpy as np
import pytest
from .helpers import ROWS, awkward
from pyspark.sql import functions as F

from estatelens.llm import suffixes


def brute(rows, n):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (2**63 if r[0] is None else r[0], (r[1] or "").encode())):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - n + 1):
            if b[j : j + n] in seen:
                gone[j : j + n] = b"\x01" * n
            seen.add(b[j : j + n])
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def run(df, n, **more):
    out = suffixes.drop_repeated_bytes(df, n, **more)
    return sorted((tuple(r) for r in out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(50)]
    lines = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 30))) for _ in range(10)]
    made = [(i, "\n".join(rnd.choice(lines) if rnd.random() < 0.6 else " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 40))) for _ in range(rnd.randint(0, 6)))) for i in range(20, 90)]
    return [*made, (500, "a" * 900), (501, "ab" * 300), (502, "xyzzy" * 500), (21, made[1][1]), (22, "other " + made[3][1]), *[r for r in ROWS if len(r[1] or "") < 1000]]


@pytest.mark.parametrize("more", [{}, {"hot_chunks": 1, "chunk_bytes": 700}, {"shard_bytes": 300}])
@pytest.mark.parametrize("n", [30, 100])
def test_equals_brute_force(spark, rows, n, more):
    assert run(awkward(spark, rows), n, **more) == brute(rows, n)


def test_split_ids_equal_brute_force(spark, rows):
    rnd = random.Random(9)
    shared = [text for _, text in rows if text and len(text) > 200][:12]
    more = [(rnd.choice([None, 30]), rnd.choice(shared)[: rnd.choice([150, 256, 300, 900])]) for _ in range(60)]
    assert run(awkward(spark, rows + more), 30, chunk_bytes=700) == brute(rows + more, 30)


def test_empty_table(spark):
    assert run(awkward(spark, []), 100) == []


def test_transform_inverts_and_merge_orders_suffixes():
    rnd = random.Random(1)
    strings = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(6, 30))).encode() for _ in range(60)})
    shards = [strings[0::3], strings[1::3], strings[2::3]]
    made, rows, texts = [], [], []
    for own in shards:
        bwt, order, row_of, begin = suffixes.transform(own)
        text = b"".join(s + b"\x00" for s in own)
        starts = [b + i for b, s in zip(begin.tolist(), own, strict=True) for i in range(len(s) - 5)]
        made.append(bwt)
        rows.append(np.sort(row_of[np.array(starts) + 6]))
        texts += [text[p : p + 6] for p in order.tolist()]
    row, block = suffixes.merge(made, rows, 6)
    prefixes = [texts[r] for r in row.tolist()]
    assert prefixes == sorted(prefixes)
    assert [a == b for a, b in zip(block[1:], block[:-1], strict=True)] == [a == b for a, b in zip(prefixes[1:], prefixes[:-1], strict=True)]


def test_chunk_numbers_of_a_large_corpus(spark):
    """Pieces of chunks beyond 2^23 are put in order like those of small ones."""
    from zstandard import ZstdCompressor

    text = bytes(range(60, 90)) * 4

    def piece(chunk, key, own):
        n = len(own) - 9
        return (0, chunk, np.array([7], np.int64).tobytes(), np.array([n], np.int32).tobytes(), np.array([key], np.uint64).tobytes(), np.array([False]).tobytes(), ZstdCompressor().compress(own))

    def marks(first, second):
        rows = [piece(first, 1, text[:60]), piece(second, 1, b"x" + text[:60])]
        df = spark.createDataFrame(rows, "bucket int, chunk int, at binary, count binary, keys binary, looped binary, text binary")
        df = df.withColumnRenamed("chunk", suffixes._CHUNK)
        return {r[0]: (bytes(r["at"]), bytes(r["count"])) for r in suffixes.settled(df, 10, 1 << 20).collect()}

    small, large = marks(0, 1), marks(2**30, 2**31 - 2)
    assert small[1] == large[2**31 - 2] and np.frombuffer(small[1][0], np.int64).min() == 7 + 1
