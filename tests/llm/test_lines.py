import hashlib
import random
import time

import pytest
from .helpers import ROWS, awkward

from estatelens.llm import lines
from estatelens.llm._common import SWEEP


def near(a, b):
    a, b = a.split(" "), b.split(" ")
    if min(len(a), len(b)) < lines.MIN_WORDS or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def brute(rows):
    trim = lambda t: [x.strip(" \t\r") for x in (t or "").split("\n")]
    first = {}
    for i, t in sorted(rows, key=lambda r: 2**63 if r[0] is None else r[0]):
        for j, x in enumerate(trim(t)):
            if x:
                first.setdefault(x, (2**63 if i is None else i, j))
    order = sorted(first, key=first.get)
    gone = {x for k, x in enumerate(order) if any(near(x, y) for y in order[:k])}
    out = []
    for i, t in rows:
        own, raw = trim(t), (t or "").split("\n")
        seen, keep = set(), []
        for j, x in enumerate(own):
            if x and x not in seen and first[x][0] == (2**63 if i is None else i) and x not in gone:
                keep.append(j)
            seen.add(x)
        n = sum(bool(x) for x in own)
        text = t or "" if len(keep) == n else "\n".join(raw[j] for j in keep)
        out.append((i, n, n - len(keep), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rnd = random.Random(8)
    base = [[f"w{rnd.randint(0, 30)}" for _ in range(rnd.randint(6, 24))] for _ in range(12)]

    def line():
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2])):
            k = rnd.randrange(len(w))
            w[k : k + 1] = rnd.choice([[], [f"n{rnd.randint(0, 9)}"], [w[k], f"n{rnd.randint(0, 9)}"]])
        return rnd.choice(["", " ", "\t"]) + " ".join(w)

    rows = [(i, "\n".join(rnd.choice(["", line(), line(), line()]) for _ in range(rnd.randint(0, 7)))) for i in range(90)] + [(900 + i, t) for i, (_, t) in enumerate(ROWS)]
    assert sorted(map(tuple, lines.line_report(awkward(spark, rows)).collect()), key=str) == brute(rows)


def test_lines_two_edits_from_the_earliest_but_one_from_another(spark):
    k = [f"k{i}" for i in range(14)]
    rows = [(1, " ".join([*k, "tail"])), (2, " ".join(["a", *k])), (3, " ".join(["b", *k]))]
    got = {r.doc_id: r.n_removed for r in lines.line_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 1}


def test_a_very_long_line(spark):
    w = [f"w{i}" for i in range(6000)]
    v = [*w[:3000], "other", *w[3001:]]
    rows = [(1, " ".join(w)), (2, " ".join(v)), (3, " ".join([*v, "more", "words"]))]
    got = {r.doc_id: r.n_removed for r in lines.line_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


def test_awkward_rows(spark):
    df = awkward(spark, ROWS)
    out = lines.drop_repeated_lines(df)
    assert out.count() == len(ROWS) and set(df.columns) <= set(out.columns)
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert (2, None) in got and (4, "  \t\n ") in got and (None, "") in got and (9, "x") in got
    assert lines.line_report(awkward(spark, [])).count() == 0


@pytest.mark.parametrize("ids", [(-(2**62), 2**62), (5, 6)])
def test_ids_of_any_size(spark, ids):
    rows = [(ids[1], "same line\nown b"), (ids[0], "same line\nown a")]
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in lines.line_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {ids[0]: (2, 0), ids[1]: (2, 1)}


def test_rows_of_one_id(spark):
    """Rows of one id, and of null id, keep a shared line once, whatever their hashes; equal rows have one winner."""
    first = "shared line that all of these rows begin with, whatever they end with"
    rows = [(i, f"{first}\nown line {i} {k}") for i in (5, None) for k in range(400)] + [(7, "twice"), (7, "twice"), (7, None), (7, None), (3, "three")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).selectExpr("*", "1 as __row", "2 as __order", "3 as __tie", "4 as __part", "5 as __hash")
    out = lines.drop_repeated_lines(df)
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()]
    assert len(got) == len(rows) and out.columns == [*df.columns, "n_lines", "n_removed"]
    whole = [g for g in got if g[1] and g[1].startswith(first)]
    assert len(whole) == 1 and whole[0][0] == 5 and whole[0][3] == 0
    assert sorted(g[1] for g in got if g[0] is None) == sorted(f"own line None {k}" for k in range(400)) and all(g[3] == 1 for g in got if g[0] is None)
    assert sorted((g[1] or "", g[2], g[3]) for g in got if g[0] == 7) == [("", 0, 0), ("", 0, 0), ("", 1, 1), ("twice", 1, 0)]


def test_edits_at_every_place(spark):
    """Lines that share only their first or only their last words with another, runs of one word, and lengths about powers of two."""
    rnd, texts = random.Random(4), []
    for n in (10, 11, 15, 16, 17, 31, 32, 33):
        for k in range(n):
            w = [rnd.choice(["a", f"x{n}.{k}.{j}"]) if k % 2 else f"y{n}.{k}.{j}" for j in range(n)]
            other = [w[:k] + w[k + 1 :], [*w[:k], "new", *w[k + 1 :]], [*w[:k], "new", *w[k:]]][rnd.randrange(3)]
            texts += [" ".join(w), " ".join(other)]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    got = sorted(map(tuple, lines.line_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    assert got == brute(rows) and sum(r[2] for r in got) >= 150


def test_one_sided_lines_emit_no_variants_of_the_shared_words(spark):
    line = " ".join(f"w{i}" for i in range(40))
    own = spark.createDataFrame([(1, 1, 0, None, line), (2, 2, None, 1, line), (3, 3, 0, 0, line)], "pos bigint, h1 bigint, first int, last int, line string")
    rows = lines.variant_keys(own).filter("kind > 0").groupBy("pos", "kind").count().collect()
    assert {(r.pos, r.kind): r["count"] for r in rows} == {(1, 1): 24, (1, 2): 24, (2, 1): 24, (2, 2): 24, (3, 1): 40, (3, 2): 40}


def shuffle_bytes(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in files if f.getName().startswith("shuffle_")}


def test_keys_are_off_the_disk_before_the_documents_travel(spark):
    """What is left to run makes no keys, and the shuffle files of what ran before are gone, whether or not the driver collects its garbage."""
    rnd = random.Random(6)
    rows = [(i, "\n".join(f"k{i % 20} " + " ".join(f"w{rnd.randint(0, 1)}" for _ in range(12)) for _ in range(4))) for i in range(400)]
    docs, before = spark.createDataFrame(rows, "doc_id bigint, text string"), shuffle_bytes(spark)
    setting = spark.conf.get(SWEEP)
    out = lines.drop_repeated_lines(docs)
    assert spark.conf.get(SWEEP) == setting and "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    for _ in range(50):  # they go in the background
        left = sum(n for name, n in shuffle_bytes(spark).items() if name not in before)
        if left < 30_000:  # ids and sizes, which the driver asks for first
            break
        time.sleep(0.2)
    assert left < 30_000
    assert out.filter("n_removed > 0").count() > 0
