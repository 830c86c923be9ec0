"""Near-duplicate groups and survivors against brute force and on edge cases."""

import random
from datetime import datetime
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from citeflow.llm import neardup
from citeflow.llm.neardup import candidates, equal_links, groups, representatives, similar, size_bands
from citeflow.llm.survivor import layers, survivors
from citeflow.llm.works import lost, p6_records


def brute(rows, threshold, least):
    sets = {i: set(t or []) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) >= least and len(x & y) / len(x | y) >= threshold - 1e-12:
            parent[find(b)] = find(a)
    out = {}
    for i in sets:
        out.setdefault(find(i), set()).add(i)
    return {frozenset(v) for v in out.values() if len(v) > 1}


def as_groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r.component, set()).add(r.id)
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("threshold,least,seed", [(0.65, 5, 1), (0.8, 5, 2), (0.5, 1, 3)])
def test_groups_match_brute_force(spark, threshold, least, seed):
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(6)]
    rows = []
    for i in range(220):
        if rows and rng.random() < 0.6:
            base = list(rows[rng.randrange(len(rows))][1])
            for _ in range(rng.randrange(0, 6)):
                k = rng.randrange(3)
                if k == 0 and len(base) > 1:
                    base.pop(rng.randrange(len(base)))
                elif k == 1:
                    base.append(f"n{rng.randrange(500)}")
                else:
                    base[rng.randrange(len(base))] = f"n{rng.randrange(500)}"
            rng.shuffle(base)
        else:
            base = rng.sample(common, rng.randrange(0, 7)) + [f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 16))]
        rows.append((i, list(dict.fromkeys(base)) or ["x"]))
    docs = spark.createDataFrame(rows, "id long, tokens array<string>")
    assert as_groups(groups(docs, "id", "tokens", threshold, least).collect()) == brute(rows, threshold, least)


def test_long_records_and_many_sizes(spark):
    rng = random.Random(9)
    rows = []
    for i, n in enumerate([5, 7, 8, 12, 30, 80, 300, 900, 2500]):
        base = [f"t{i}_{k}" for k in range(n)]
        rows += [(10 * i, base), (10 * i + 1, base[: max(1, int(n * 0.7))]), (10 * i + 2, base[: n // 2])]
        rng.shuffle(base)
    docs = spark.createDataFrame(rows, "id long, tokens array<string>")
    assert as_groups(groups(docs, "id", "tokens", 0.65, 5).collect()) == brute(rows, 0.65, 5)


def test_hot_copies_are_one_representative(spark):
    rows = [(i, ["a", "b", "c", "d", "e"]) for i in range(300)] + [(1000, ["a", "b", "c", "d", "e", "f"]), (1001, ["z"] * 9)]
    docs = spark.createDataFrame(rows, "id long, tokens array<string>")
    reps, links = representatives(docs, "id", "tokens", 5)
    assert reps.count() == 3 and links.count() == 302  # nine words, of which one is distinct, are a record too
    assert similar(reps, 0.65).count() == 1
    got = groups(docs, "id", "tokens", 0.65, 5).collect()
    assert {r.component for r in got} == {0} and len(got) == 301


def test_nulls_empty_repeats_and_clashing_names(spark):
    words = ["a", "b", "c", "d", "e"]
    rows = [(1, words, "x"), (1, words, "x"), (2, None, "y"), (3, [], "y"), (4, words[:4], None), (None, words, "z"), (5, words + ["f"], "x")]
    docs = spark.createDataFrame(rows, "id long, tokens array<string>, rid string")
    got = groups(docs, "id", "tokens", 0.65, 5, same=equal_links(docs, "id", "rid")).collect()
    assert as_groups(got) == {frozenset({1, 5}), frozenset({2, 3})}
    assert groups(docs.limit(0), "id", "tokens", 0.65, 5).count() == 0


def test_repeated_words_count_for_the_least_length(spark):
    rows = [(1, ["a", "b", "c", "d", "d"]), (2, ["a", "b", "c", "d", "d", "d"]), (3, ["a", "b", "c", "d"])]
    docs = spark.createDataFrame(rows, "id long, tokens array<string>")
    assert as_groups(groups(docs, "id", "tokens", 0.65, 5).collect()) == {frozenset({1, 2})}


def test_hot_words_and_colliding_bands_lose_nothing(spark, monkeypatch):
    """Titles of few words that all share, so that groups are hot at each level
    and end within them; and bands so few that most records have collisions."""
    rng = random.Random(11)
    rows = [(i, rng.sample([f"c{k}" for k in range(11)], rng.randrange(1, 7))) for i in range(260)]
    docs = spark.createDataFrame(rows, "id long, tokens array<string>")
    for few, levels, bands in ((2, 3, 20), (4, 8, -60)):
        for name, value in (("FEW", few), ("LEVELS", levels), ("BANDS", bands)):
            monkeypatch.setattr(neardup, name, value)
        if bands < 0:
            monkeypatch.setattr(neardup.math, "log2", lambda _: 3.0)  # eight bands
        assert as_groups(groups(docs, "id", "tokens", 0.6, 2).collect()) == brute(rows, 0.6, 2)
        monkeypatch.undo()


def test_candidates_grow_with_the_records(spark):
    """A skeleton of common words and six rare ones: pairs to compare for each
    record do not grow with the number of records."""
    rng, common = random.Random(12), [f"c{k}" for k in range(30)]
    per = []
    for n in (300, 1500):
        rows = [(i, rng.sample(common, 9) + [f"r{rng.randrange(n * 2)}" for _ in range(6)]) for i in range(n)]
        reps, _ = representatives(spark.createDataFrame(rows, "id long, tokens array<string>"), "id", "tokens", 5)
        per.append(candidates(reps, 0.65).count() / n)
    assert per[1] <= max(1.5 * per[0], neardup.FEW * 8)


def test_levels_are_done_one_by_one(spark):
    """What is left to run after the join are scans of its checkpointed pairs,
    so that no stage of a level waits in the driver for those of all others."""
    rows = [(i, [f"c{k}" for k in range(5)] + [f"w{i}", f"v{i % 9}"]) for i in range(90)]
    reps, _ = representatives(spark.createDataFrame(rows, "id long, tokens array<string>"), "id", "tokens", 5)
    got = candidates(reps, 0.65)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "Exchange" not in plan and "Join" not in plan
    assert {(r.rid_a, r.rid_b) for r in got.collect()} >= {(a, b) for a, b in combinations(range(90), 2) if a % 9 == b % 9}


def test_everyday_words_open_no_level(spark, monkeypatch):
    """Titles of rare words and of everyday ones, which all share: no similar pair
    begins its common words with the latter, so their hot groups are given up."""
    rng, common = random.Random(13), [f"c{k}" for k in range(14)]
    rows = []
    for i in range(240):
        if i % 4 == 3:
            base = list(rows[-1][1])
            base[rng.randrange(5)] = f"n{i}"
        else:
            base = [f"r{i}_{k}" for k in range(5)] + rng.sample(common, 12)
        rows.append((i, base))
    monkeypatch.setattr(neardup, "FEW", 4)
    docs = spark.createDataFrame(rows, "id long, tokens array<string>")
    reps, _ = representatives(docs, "id", "tokens", 5)
    plan = candidates(reps, 0.65)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") <= 3  # nothing to begin with, then two levels; they were nine
    want = brute(rows, 0.65, 5)
    assert as_groups(groups(docs, "id", "tokens", 0.65, 5).collect()) == want and len(want) == 60


def test_small_hot_groups_end_the_levels(spark, monkeypatch):
    """A few groups little larger than FEW are compared, not extended."""
    rows = [(i, [f"g{i if i > 6 else 0}_{k}" for k in range(8)] + [f"w{i}"]) for i in range(200)]
    monkeypatch.setattr(neardup, "FEW", 5)
    reps, _ = representatives(spark.createDataFrame(rows, "id long, tokens array<string>"), "id", "tokens", 5)
    got = candidates(reps, 0.65)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 3  # nothing to begin with, the first level, its hot groups; they were eight
    assert {(r.rid_a, r.rid_b) for r in got.collect()} == set(combinations(range(7), 2))


def test_one_row_of_band_values_a_record(spark):
    """Records are sketched once, not once for each size band they meet, and the
    sketches are not another checkpointed copy of the table."""
    reps, _ = representatives(spark.createDataFrame([(i, [f"w{i}_{k}" for k in range(9)]) for i in range(40)], "id long, tokens array<string>"), "id", "tokens", 5)
    recs, several = neardup.sketches(reps, 0.65)
    assert (recs.count(), several) == (40, 0)
    assert "MapInArrow" in recs._jdf.queryExecution().executedPlan().toString()


def test_size_bands_hold_similar_sizes_together():
    for t in (0.5, 0.65, 0.8, 0.95):
        ends = size_bands(t, 500)
        band = lambda n: next(i for i, e in enumerate(ends) if n <= e)
        for n in range(1, 501):
            for m in range(n, min(500, int(n / t)) + 1):
                assert band(m) - band(n) <= 1


def test_layers_match_brute_force():
    rng = random.Random(4)
    for _ in range(40):
        points = [(rng.randrange(4), rng.randrange(4), rng.randrange(3)) for _ in range(rng.randrange(1, 14))]
        left, want, depth = set(points), {}, 0
        dominates = lambda a, b: a != b and all(x >= y for x, y in zip(a, b))
        while left:
            depth += 1
            front = {p for p in left if not any(dominates(q, p) for q in left)}
            want |= dict.fromkeys(front, depth)
            left -= front
        assert layers(points) == [want[p] for p in points]


SCHEMA = "work long, entry_id long, title string, tags array<string>, year int, at timestamp, trust int, k string"


def test_survivor_and_filling(spark):
    at = lambda d: datetime(2025, 1, d)
    rows = [
        (1, 10, "old", ["a"], None, at(1), 1, "k"), (1, 11, None, None, 2001, at(9), 8, "k"), (1, 12, "new", ["b"], 1999, at(5), 1, "k"),
        (2, 20, None, None, None, None, None, None), (3, 30, "t", [], 1, at(1), 2, None), (3, 31, "u", [], 1, at(1), 2, None), (None, 40, "x", None, 1, at(1), 9, "k"), (4, None, "x", None, 1, at(1), 9, "k"),
    ]
    got = {r.work: r for r in survivors(spark.createDataFrame(rows, SCHEMA), "work", "entry_id", ["title", "tags", "year"], "at", "trust").collect()}
    assert (got[1].entry_id, got[1].title, got[1].tags, got[1].year, sorted(got[1].filled), got[1].records) == (11, "new", ["b"], 2001, ["tags", "title"], 3)
    assert (got[2].entry_id, got[2].title, got[2].filled, got[2].trust) == (20, None, [], 0)
    assert (got[3].entry_id, got[3].title, got[3].records) == (30, "t", 2)  # a tie goes to the least key


def test_policy_and_skyline_decide_together(spark):
    at = lambda d: datetime(2025, 1, d)
    rows = [
        # Nobody is trusted enough: the most complete of the skyline; 11 ties with 12 by the policy and has the lesser id, but 12 dominates it.
        (1, 11, "a", ["x"], None, at(5), 3, None), (1, 12, "b", ["x"], None, at(5), 4, None), (1, 13, "c", None, None, at(5), 7, None),
        # Several are: the most complete of them, not the most complete of all.
        (2, 21, "a", ["x"], 1, at(5), 7, None), (2, 22, "b", ["x"], None, at(4), 8, None), (2, 23, "c", None, None, at(6), 8, None),
        # One is: it wins whatever the others have.
        (3, 31, "a", ["x"], 1, at(9), 7, None), (3, 32, None, None, None, at(1), 8, None),
    ]
    got = {r.work: r for r in survivors(spark.createDataFrame(rows, SCHEMA), "work", "entry_id", ["title", "tags", "year"], "at", "trust").collect()}
    assert {w: r.entry_id for w, r in got.items()} == {1: 12, 2: 22, 3: 32}
    assert (got[3].title, got[3].tags, got[3].year) == ("a", ["x"], 1)


def test_survivors_of_nothing_and_of_a_hot_group(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert survivors(empty, "work", "entry_id", ["title"], "at", "trust").count() == 0
    hot = spark.range(3000).select(F.lit(1).cast("long").alias("work"), F.col("id").alias("entry_id"), F.lit("t").alias("title"), F.lit(None).cast("array<string>").alias("tags"), (F.col("id") % 5).cast("int").alias("year"), F.timestamp_seconds(F.col("id") * 4000).alias("at"), (F.col("id") % 3).cast("int").alias("trust"), F.lit("x").alias("k"))
    r = survivors(hot, "work", "entry_id", ["title", "year"], "at", "trust").head()
    assert r.records == 3000 and r.entry_id == 2999


def test_superseded_by_own_link_or_by_another(spark):
    doi = "10.1000/{}".format
    rows = [
        (1, doi("a"), doi("B"), None), (2, doi("b"), None, None),  # 1 says that 2 supersedes it
        (3, doi("c"), None, None), (4, doi("d"), None, [doi("c"), doi("d"), None]),  # 4 says so of 3, and of itself
        (5, doi("e"), doi("e"), None), (6, doi("f"), doi("zz"), [doi("a")]),  # only itself; nobody; a record of another work
        (7, doi("g"), None, [doi("g")]), (8, doi("g"), None, None),  # two records of one DOI
        (1, doi("a"), None, None), (9, doi("h"), doi("b"), None), (10, None, None, [doi("h")]),
    ]
    entries = spark.createDataFrame(rows, "entry_id long, doi string, superseded_by string, supersedes array<string>")
    of = spark.createDataFrame([(i, {5: 5, 6: 5, 7: 7, 8: 7}.get(i, 1)) for i in range(1, 10)], "entry_id long, component long")
    assert sorted(r.entry_id for r in lost(entries, of).collect()) == [1, 3, 8, 9]


def test_survivors_scan_the_entries_once_at_last(spark):
    """What is left to run after the groups is one scan, not one for each link."""
    plan = p6_records(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") <= 6
