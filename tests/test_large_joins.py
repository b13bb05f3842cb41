"""Joins and numbering that split hot keys, against brute force on small tables and small cells."""

import random

import pytest
from pyspark.sql import functions as F

from estatelens.functions import text
from estatelens.operators import numbering, overlap, relational, substring
from estatelens.plans import scoring


@pytest.mark.parametrize("range_rows", [9, 1000])
def test_numbers_within_a_hot_key(spark, range_rows):
    rows = [("hot" if i % 3 else None if i % 5 == 0 else f"k{i % 4}", i * 37 % 101) for i in range(101)]
    df = spark.createDataFrame(rows, "k string, i int")
    got = {(r.k, r.i): (r.place, r.total) for r in numbering.numbered(df, "k", ["i"], "place", "total", range_rows).collect()}
    want = {}
    for k in {k for k, _ in rows}:
        own = sorted(i for x, i in rows if x == k)
        want |= {(k, i): (n, len(own)) for n, i in enumerate(own, 1)}
    assert got == want
    assert numbering.numbered(df.limit(0), "k", ["i"], "place", "total").count() == 0


def brute_overlap(sets, least):
    out = set()
    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and shared and shared / max(len(sets[a]), len(sets[b])) >= least:
                out.add((a, b, shared, shared / max(len(sets[a]), len(sets[b]))))
    return out


@pytest.mark.parametrize("least", [0.01, 0.5, 0.8, 1.0])
def test_overlap_with_an_element_of_all_sets(spark, least):
    rng = random.Random(int(least * 100))
    sets = {n: {"all"} | {f"e{rng.randrange(14)}" for _ in range(rng.randrange(9))} for n in range(40)}
    sets |= {100 + n: {f"w{i}" for i in range(25)} | {f"x{n}"} for n in range(3)}
    rows = [(n, e) for n, s in sets.items() for e in s for _ in range(1 + (e == "all"))] + [(7, None), (None, "all")]
    df = spark.createDataFrame(rows, "i int, e string")
    got = overlap.set_overlap_pairs(df, "i", "e", least, cell_rows=5, range_rows=11)
    assert {tuple(r) for r in got.collect()} == brute_overlap(sets, least)


def test_overlap_of_nothing(spark):
    assert overlap.set_overlap_pairs(spark.createDataFrame([], "i int, e string"), "i", "e", 0.5).count() == 0


def test_containment(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abA.=") for _ in range(n))
    needles = [(i, rng.choice("gh"), word(rng.choice([0, 1, 2, 3, 5, 8, 11]))) for i in range(60)] + [(900, "g", None), (901, None, "a"), (0, "g", "ab"), (0, "g", "ab")]
    hays = [(i, rng.choice("gh"), word(rng.randrange(30))) for i in range(60)] + [(i, g, "x" + t + "y") for i, (_, g, t) in enumerate(needles[:30], 100) if t] + [(902, "g", None), (903, "g", "")]
    got = substring.containment_pairs(spark.createDataFrame(needles, "needle_id int, grp string, text string"), spark.createDataFrame(hays, "hay_id int, grp string, text string"))
    want = {(n, h) for n, g, t in needles for h, k, u in hays if g is not None and g == k and None not in (t, u) and t in u}
    found = [tuple(r) for r in got.collect()]
    assert set(found) == want and len(found) == len(want) > 100


def test_location_pairs_are_those_of_the_rules(spark):
    """Every finding with every location of its type, by the rules themselves."""
    rng = random.Random(8)
    name = lambda: rng.choice(["Orders", "orders_daily", "x", "board.A", "cards"])
    findings = [(f"f{i}", rng.choice(["s", "t"]), [f"{rng.choice(['model', 'dashboard'])}.{name()}" for _ in range(rng.randrange(3))], [(f"file:///a/{name()}.sql", rng.choice([f"model={name()}/col=v", name(), ""])) for _ in range(rng.randrange(3))]) for i in range(30)]
    located = [(i // 2, "defects", f"d{i // 2}", "st"[i // 2 % 2], rng.choice([None, f"a/{name()}.sql", f"{name()}.yml"]), rng.choice([None, "", f"MODEL={name()}", f"dashboard={name()}/x=1", f"zz {name()}"]), 2) for i in range(24)]
    located += located[:3]
    f = spark.createDataFrame(findings, "id string, defect_type string, asset_ids array<string>, evidence array<struct<uri string, locator string>>")
    m = spark.createDataFrame(located, "place int, expected string, id string, type string, path string, locator string, n_locations int")
    side = f.select(F.col("id").alias("finding"), F.col("defect_type").alias("type"), "asset_ids", F.expr("transform(evidence, e -> e.locator)").alias("ls"), F.expr("transform(evidence, e -> e.uri)").alias("us"))
    met = text.location_matches(F.coalesce("locator", F.lit("")), F.coalesce("path", F.lit("")), F.col("ls"), F.col("asset_ids"), F.col("us"))
    want = m.join(side, "type").filter(met).groupBy("place", "finding").count()
    got = scoring.location_matches(f, m).select("place", "finding", "matched")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 20


@pytest.mark.parametrize("seed", range(3))
def test_items_take_findings_in_order(spark, seed):
    rng = random.Random(seed)
    matches = [(p, f"f{f}", rng.randrange(4)) for p in range(12) for f in range(9) if rng.random() < 0.4]
    used, want = set(), {}
    for p in range(12):
        own = sorted((-n, f) for q, f, n in matches if q == p and n and f not in used)
        if own:
            want[p] = own[0][1]
            used.add(own[0][1])
    got = scoring.assigned(spark.createDataFrame(matches, "place int, finding string, matched int"))
    assert {r.place: r.finding for r in got.collect()} == want
    assert scoring.assigned(spark.createDataFrame([], "place int, finding string, matched int")).count() == 0


def test_sets_without_overlap_are_no_candidates(spark, monkeypatch):
    """Sets that share rare elements but can't reach the overlap don't leave the join; those that can do."""
    rng = random.Random(3)
    sets = {n: {f"e{x}" for x in rng.sample(range(300), 40)} for n in range(80)}
    sets |= {100 + n: set(sorted(sets[n])[:30]) | {f"y{n}.{i}" for i in range(n)} for n in range(12)}
    met, own = [], overlap._candidates
    monkeypatch.setattr(overlap, "_candidates", lambda *a: met.append(own(*a)) or met[-1])
    got = overlap.set_overlap_pairs(spark.createDataFrame([(n, e) for n, s in sets.items() for e in s], "i int, e string"), "i", "e", 0.5)
    want = brute_overlap(sets, 0.5)
    assert {tuple(r) for r in got.collect()} == want and len(want) >= 12
    assert len(want) <= met[0].count() < 100


def test_first_match_joins_one_row_of_each_value(spark, monkeypatch):
    """Many rows on both sides of one value meet as one row each; rows without a place come last."""
    left = spark.createDataFrame([(k, 1 if k < 40 else k % 7 + 2) for k in range(60)] + [(90, None), (91, 50)], "k int, v int")
    rows = [(None if n == 200 else n, 1 if n >= 200 else n % 5 + 1 if n > 30 else 50) for n in range(31, 400)] + [(None, 50), (45, None)]
    right = spark.createDataFrame(rows, "n int, v int")
    joined, own = [], type(left).join
    monkeypatch.setattr(type(left), "join", lambda self, other, *a, **b: joined.append(other) or own(self, other, *a, **b))
    got = {r.k: r.match and r.match.n for r in relational.first_match(left, right, "k", [("v", "v"), ("k", "n")], "n").collect()}
    value = {r.k: r.v for r in left.collect()}
    want = {}
    for k, v in value.items():
        met = [(rank, n is None, n or 0) for rank, eq in enumerate((lambda n, x: v is not None and x == v, lambda n, x: n == k)) for n, x in rows if eq(n, x)]
        want[k] = next((None if none else n for _, none, n in sorted(met)), None)
    assert got == want and want[91] is None and len({*want.values()}) > 4
    values = {x for _, x in rows}, {n for n, _ in rows}
    assert [j.count() for j in joined[:2]] == [len(v - {None}) for v in values]
