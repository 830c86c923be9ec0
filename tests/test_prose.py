"""Marks, anchors, markup, fuzzy names and co-location."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from citeflow.operators import anchors, fuzzy, markup


def test_nearest_sidecars_against_brute_force(spark):
    import re

    rng = random.Random(1)
    texts = ["".join(rng.choice(["word ", "[@k%d] " % rng.randrange(9), "<!-- claim:c%d --> " % rng.randrange(9), "more text "]) for _ in range(12)) for _ in range(60)] + ["", None, "no marks [@a]"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.nth): (r.cited, r.claim) for r in anchors.nearest_sidecars(docs, "doc_id", "text").collect()}
    want = {}
    for i, t in enumerate(texts):
        cites = [(m.start(), m[1]) for m in re.finditer(r"\[@([\w\-:]+)\]", t or "")]
        marks = [(m.start(), m[1]) for m in re.finditer(r"<!-- claim:([\w\-]+)", t or "")]
        for n, (at, key) in enumerate(cites):
            if len(cites) == len(marks):
                claim = marks[n][1]
            else:
                claim = min(marks, key=lambda m: (abs(m[0] - at), m[0]))[1] if marks else None
            want[i, n] = (key, claim)
    assert got == want


def test_sidecars_and_anchors(spark):
    df = spark.createDataFrame([("a <!-- claim:c1 --> b <!-- claim:c2 type:inference -->", "As shown by Berg et al. (2019)", "berg", 2020), (None, "no name here 5", "x", None)], "t string, s string, f string, y int")
    rows = df.select(anchors.sidecars(F.col("t")).alias("m"), anchors.anchor(F.col("s")).alias("a"), anchors.disagrees(anchors.anchor(F.col("s")), F.col("f"), F.col("y")).alias("d")).collect()
    assert [tuple(x) for x in rows[0].m] == [("c1", "factual"), ("c2", "inference")] and rows[1].m == []
    assert tuple(rows[0].a) == ("Berg", 2019) and rows[0].d == ["year"] and rows[1].d == []


def test_markup(spark):
    xml = '<article><abstract><p>Short &amp; plain</p></abstract><sec id="s1"><title>1. Introduction</title><p>Intro <b>text</b></p></sec><sec><title>Methods</title><p>m</p></sec>' + '<table-wrap><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td><i>2</i></td></tr></table></table-wrap>' * 6 + '<fig id="f"><label>Fig 1</label><caption><p>Cap</p></caption><graphic xlink:href="a.png"/></fig></article>'
    df = spark.createDataFrame([(xml,), (None,), ("",)], "x string")
    rows = df.select(markup.abstract(F.col("x")), markup.section(F.col("x"), ["introduction", "background"]), markup.tables(F.col("x")), markup.figures(F.col("x"))).collect()
    assert rows[0][0] == "Short plain" and rows[0][1] == "Intro text"
    assert len(rows[0][2]) == 5 and rows[0][2][0] == [["A", "B"], ["1", "2"]]
    assert [tuple(f) for f in rows[0][3]] == [(1, "Fig 1", "Cap", "a.png")]
    assert rows[1][:2] == ("", "") and rows[1][2] == [] and rows[2][3] == []


def test_nested_sections_and_broken_markup(spark):
    nested = "<sec><title>Methods</title><p>a</p></sec><sec id='s'><title>Background and aims</title><p>one</p><sec><title>Part</title><p>two</p></sec><p>three</p></sec><sec><title>Results</title><p>four</p></sec>"
    rows = [(nested,), ("<sec><title>Background</title><p>open " + "x" * 9000,), ("<abstract",), ("<sec></sec></sec>",), ("<table-wrap><tr><td>1</td>",)]
    df = spark.createDataFrame(rows, "x string")
    got = df.select(markup.section(F.col("x"), ["background"], None), markup.abstract(F.col("x")), markup.tables(F.col("x"), None)).collect()
    assert got[0][0] == "one Part two three" and len(got[1][0]) == 9005
    assert [r[1] for r in got] == [""] * 5 and got[4][2] == [[["1"]]] and got[3][0] == ""


def test_closest_names(spark):
    want = spark.createDataFrame([("t", "gap-11"), ("t", "gap-11"), ("t", None), ("u", "zzz")], "topic string, gap string")
    have = spark.createDataFrame([("t", "gap-1"), ("t", "gap-10"), ("t", "other"), ("t", "gap-2"), ("u", "gap-1"), (None, "gap-11")], "topic string, gap string")
    got = [(r.declared, round(r.ratio, 6), r.rank, r.sure) for r in fuzzy.closest(want, have, "topic", "gap").orderBy("rank").collect()]
    ratio = lambda a: round(SequenceMatcher(None, "gap-11", a).ratio(), 6)
    order = sorted(["gap-1", "gap-10", "gap-2"], key=lambda a: (-ratio(a), a))
    assert got == [(a, ratio(a), i + 1, ratio(a) >= 0.8) for i, a in enumerate(order)]


def test_colocation(spark):
    text = "In all 1,200 men " + "x " * 200 + "of 30 women, 45.5 percent and 1200 more"
    rows = [(["30", "45.5"], text), (["1200", "30"], text), (["1200", "99"], text), ([], text), (["1"], None), (None, text)]
    df = spark.createDataFrame(rows, "n array<string>, t string")
    got = [r[0] for r in df.select(anchors.colocated(F.col("n"), F.col("t"), 60)).collect()]
    assert got[0] is not None and "45.5" in got[0] and got[1] is not None and got[2:] == [None, None, None, None]
